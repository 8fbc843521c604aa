"""Arrow batches of texts are bounded by bytes, not only by rows."""

import pyarrow as pa
from pyspark.sql import functions as F

from gatherline.llm.common import BATCH_BYTES, keyed_documents

BOUND = "spark.sql.execution.arrow.maxBytesPerBatch"


def _largest(docs):
    def size(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.nbytes])], names=["n"])

    return keyed_documents(docs).mapInArrow(size, "n long").agg(F.max("n")).first()[0]


def test_batches_of_texts_are_bounded(spark):
    docs = spark.range(200, numPartitions=1).select(F.col("id").alias("doc_id"), F.repeat(F.lit("x"), 100_000).alias("text"))
    spark.conf.unset(BOUND)
    assert _largest(docs) < BATCH_BYTES + 300_000


def test_own_bound_stands(spark):
    docs = spark.range(200, numPartitions=1).select(F.col("id").alias("doc_id"), F.repeat(F.lit("x"), 100_000).alias("text"))
    spark.conf.set(BOUND, 1 << 20)
    try:
        assert _largest(docs) < (1 << 20) + 300_000
    finally:
        spark.conf.unset(BOUND)
