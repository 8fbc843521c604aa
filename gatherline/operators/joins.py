"""Joins whose broadcast side is counted before, and tables written to cut the lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows up to which a side counts as small.
SMALL_ROWS = 200_000
#: Rows of a group up to which one task may sort it as it is.
TASK_ROWS = 2_000_000


def small(df: DataFrame, rows: int = SMALL_ROWS) -> DataFrame:
    """``df`` with a broadcast hint if it has at most ``rows`` rows, else as it is, for a join by shuffle."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def largest_group(df: DataFrame, keys: list[str]) -> int:
    """Rows of the largest group, or of all rows without keys."""
    counts = df.groupBy(*keys).agg(F.count("*").alias("n"))
    return counts.agg(F.max("n")).first()[0] or 0


def materialized(spark: SparkSession, df: DataFrame) -> DataFrame:
    """Cut the lineage: write the rows below the folder that spark.checkpoint.dir names, and read them again.

    Only in local mode, where that is unset, a private folder is made. What is read carries nothing of the old plan along, so
    loops of many rounds plan each round alike.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the whole cluster shares")
        base = tempfile.mkdtemp(prefix="gatherline-")
        spark.conf.set("spark.checkpoint.dir", base)
    path = f"{base.rstrip('/')}/gatherline/{spark.sparkContext.applicationId}/{uuid.uuid4().hex}/rows"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
