"""Operator 3: exact duplicates by an exchange of Golomb-coded fingerprints.

Partitions send sorted, compressed fingerprints to the owners of hash ranges and receive bitmaps of duplicates
(exchange.py). Only suspects, rows whose bit is set, are shuffled with their text, and only after equal texts of a
task were added up: grouping by the text itself is the verification byte by byte.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import free_names, keyed_documents, lower_ascii, sized_join, texts_of, written
from .exchange import keyed_pass, repeated_keys


#: Rows that are alike and dealt out together.
PORTION = 100_000


def _keys(texts: list[bytes], _batch: pa.RecordBatch) -> tuple[dict, np.ndarray, np.ndarray]:
    plain = [lower_ascii(t) for t in texts]
    keys = np.fromiter((xxhash.xxh3_64_intdigest(t) for t in plain), np.uint64, len(plain))
    return {"sha": [hashlib.sha256(t).digest() for t in plain]}, keys, np.ones(len(plain), np.int64)


def _normalised(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        plain = [lower_ascii(t) for t in texts_of(batch.column(batch.schema.get_field_index("text")))]
        yield pa.RecordBatch.from_pydict({"doc_id": batch.column(batch.schema.get_field_index("doc_id")), "norm": pa.array(plain, pa.binary()), "sha": pa.array([hashlib.sha256(t).digest() for t in plain], pa.binary())})


def exact_duplicates(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: ``doc_id, keep_id, group_size, kept, text_sha256``.

    Texts are equal when identical after lower-casing A-Z; null counts as empty. Of equal texts the row with the
    largest id stays (null ids count as smallest); rows that repeat the same id and text are rows of their own in
    group_size, and exactly one of them is kept, as of texts that share the id and differ in case. An empty table gives
    no rows. Groups are formed by the text itself, and joined back to the rows by its SHA-256.
    """
    return _verdicts(spark, docs, id_col, text_col).select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("sha")).alias("text_sha256"))


def without_duplicates(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, all columns as they are."""
    none, rid, fp = names = free_names(docs, "__none", "__rid", "__fp")
    gone = written(spark, _verdicts(spark, docs, id_col, text_col).where("not kept").select(F.col("doc_id").isNull().alias(none), F.col("rid").alias(rid), F.col("fp").alias(fp), "again").distinct(), "dropped")
    keyed = docs.withColumns({none: F.col(id_col).isNull(), rid: F.coalesce(F.col(id_col).cast("long"), F.lit(-1)), fp: F.xxhash64(text_col)})
    left = sized_join(keyed, gone.select(*names), names, "left_anti")
    # rows that repeat the one that stays are the exception, and only they are compared by their text
    again = gone.where("again").select(*names)
    if again.limit(1).count():
        left = left.unionByName(sized_join(keyed, again, names, "left_semi").dropDuplicates([*names, text_col]))
    return left.drop(*names)


def _verdicts(spark: SparkSession, docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """A row for each document with what exact_duplicates says; ``again``: it repeats, id and text, the row that stays."""
    keyed = keyed_documents(docs, id_col, text_col)
    table = keyed_pass(spark, keyed, _keys, "sha binary", "fingerprints")
    suspects = written(spark, repeated_keys(table).select("rid", "fp").distinct(), "suspects")
    texts = sized_join(keyed, suspects, ["rid", "fp"], "left_semi").select("doc_id", "text").mapInArrow(_normalised, "doc_id long, norm binary, sha binary")
    groups = texts.groupBy("norm", "sha").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size")).where("group_size > 1")
    groups = written(spark, groups.select("sha", "keep_id", "group_size"), "groups")
    rows = table.where("owner < 0").select("doc_id", "rid", "fp", "sha")
    out = sized_join(rows, groups, ["sha"], "left").select("doc_id", "rid", "fp", F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"), F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"), "sha")
    # several rows may have the id that stays: the least hash of the text decides, and of rows with that any one
    stays = F.col("doc_id").eqNullSafe(F.col("keep_id"))
    extra = written(spark, out.where(stays & (F.col("group_size") > 1)).groupBy("sha").agg(F.count("*").alias("copies"), F.min("fp").alias("first")).where("copies > 1"), "repeated_rows")
    out = sized_join(out, extra, ["sha"], "left")
    same = stays & F.coalesce(F.col("fp") == F.col("first"), F.lit(False))
    single = out.where(~same).select("doc_id", "rid", "fp", "keep_id", "group_size", (stays & F.col("copies").isNull()).alias("kept"), "sha", F.lit(False).alias("again"))
    # rows that are alike come as a count, which is dealt out again in portions
    alike = out.where(same).groupBy("doc_id", "rid", "fp", "keep_id", "group_size", "sha").agg(F.count("*").alias("rows"))
    portion = alike.withColumn("from", F.explode(F.sequence(F.lit(1).cast("long"), F.col("rows"), F.lit(PORTION).cast("long")))).repartition("sha", "from")
    nth = portion.withColumn("nth", F.explode(F.sequence("from", F.least(F.col("rows"), F.col("from") + PORTION - 1))))
    return single.unionByName(nth.select("doc_id", "rid", "fp", "keep_id", "group_size", (F.col("nth") == 1).alias("kept"), "sha", (F.col("nth") > 1).alias("again")))
