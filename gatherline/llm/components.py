"""Connected components of a written edge table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import settled


def connected(spark: SparkSession, edges: DataFrame, rounds: int = 60) -> DataFrame:
    """``node, root`` for each node of ``edges`` (long columns a, b): root is the least node of its component.

    Every round joins edges with one minimum per node: no neighbour list is ever gathered, so a node with a third of
    all edges costs no more than others. Rounds grow with the logarithm of the component's size.
    """
    # a: the larger end, b: the smaller
    now = settled(spark, edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    state = None
    for _ in range(rounds):
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        # large star: neighbours above a node hang on its least neighbour
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        # small star: a node and its neighbours below hang on the least of them
        down = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(down, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").unionByName(down.select("a", F.col("m").alias("b"))).distinct()
        now = settled(spark, small, "edges")
        new = now.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.lit(0))).first()
        if state == new:
            break
        state = new
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return settled(spark, now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots), "roots")
