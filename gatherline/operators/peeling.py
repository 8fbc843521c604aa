"""Longest paths of large directed graphs by rounds of joins: layers are peeled from the sinks, long paths are contracted."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Layers that are peeled between two contractions.
LAYERS = 8


def _renamed(df: DataFrame, **names: str) -> DataFrame:
    return df.select(*[F.col(c).alias(names.get(c, c)) for c in df.columns])


def _peeled(edges: DataFrame, ready: DataFrame, keys: list[str]) -> DataFrame:
    """One layer: ``ready`` nodes leave. Rows of what remains (``done`` false) and of the nodes that are ready now.

    ``edges``: keys, ``src, dst, w, b``: the depth of ``src`` is at least ``b``, and at least ``w`` more than that of ``dst``.
    """
    met = edges.join(_renamed(ready, node="dst"), [*keys, "dst"], "left").withColumn("d", F.col("w") + F.col("depth"))
    each = met.groupBy(*keys, "src").agg(F.greatest(F.max("b"), F.max("d")).alias("b"), F.count_if(F.col("d").isNull()).alias("left"))
    now = each.where("left = 0").select(*keys, F.col("src"), F.lit(None).cast("string").alias("dst"), F.lit(0).cast("long").alias("w"), "b", F.lit(True).alias("done"))
    rest = met.where("d is null").drop("b", "d", "depth").join(each.where("left > 0"), [*keys, "src"])
    return rest.select(*keys, "src", "dst", "w", "b", F.lit(False).alias("done")).unionByName(now)


def _contracted(edges: DataFrame, keys: list[str], cut: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, DataFrame]:
    """(edges without the nodes that one edge leaves, ``src, dst, w, b`` of each of these towards the end of its path).

    Pointer jumping: after n rounds a node points 2^n nodes ahead. Paths that end in a ring of such nodes stay.
    """
    single = edges.groupBy(*keys, "src").agg(F.count("*").alias("n"), F.max("dst").alias("dst"), F.max("w").alias("w"), F.max("b").alias("b")).where("n = 1")
    jumps = cut(single.select(*keys, "src", "dst", "w", "b"))
    for _ in range(max(1, math.ceil(math.log2(max(2, jumps.count()))) + 1)):
        ahead = _renamed(jumps, src="dst", dst="dst2", w="w2", b="b2")
        both = jumps.join(ahead, [*keys, "dst"], "left")
        moving = F.col("dst2").isNotNull()
        jumps = cut(both.select(*keys, "src", F.coalesce("dst2", "dst").alias("dst"), (F.col("w") + F.coalesce("w2", F.lit(0))).alias("w"), F.when(moving, F.greatest("b", F.col("w") + F.col("b2"))).otherwise(F.col("b")).alias("b"), moving.alias("moving")))
        still = jumps.where("moving").limit(1).count()
        jumps = jumps.drop("moving")
        if not still:
            break
    ended = cut(jumps.join(_renamed(jumps.select(*keys, "src"), src="dst"), [*keys, "dst"], "left_anti"))
    gone = ended.select(*keys, "src")
    via = _renamed(ended, src="dst", dst="dst2", w="w2", b="b2")
    rest = edges.join(gone, [*keys, "src"], "left_anti").join(via, [*keys, "dst"], "left")
    rest = rest.select(*keys, "src", F.coalesce("dst2", "dst").alias("dst"), (F.col("w") + F.coalesce("w2", F.lit(0))).alias("w"), F.greatest("b", F.col("w") + F.col("b2")).alias("b"))
    return cut(rest.groupBy(*keys, "src", "dst").agg(F.max("w").alias("w"), F.max("b").alias("b"))), ended


def finite_depths(edges: DataFrame, keys: list[str], cut: Callable[[DataFrame], DataFrame], layers: int = LAYERS) -> DataFrame:
    """``keys, node, depth``: nodes of the longest path that starts at each node, but for nodes that lead to a cycle.

    ``edges``: keys, ``src, dst`` (strings). ``cut`` writes a table and cuts its lineage. A layer is one join over the
    edges that are left; after every ``layers`` of them all paths without branches shrink to one edge, in rounds that grow with the
    logarithm of their length.
    """
    one = F.lit(1).cast("long")
    edges = cut(edges.select(*keys, "src", "dst").where("src is not null and dst is not null").distinct().select("*", one.alias("w"), one.alias("b")))
    sinks = edges.select(*keys, F.col("dst").alias("node")).distinct().join(_renamed(edges.select(*keys, "src").distinct(), src="node"), [*keys, "node"], "left_anti")
    ready = cut(sinks.withColumn("depth", one))
    found, ended, layer = [ready], [], 0
    while True:
        layer += 1
        step = cut(_peeled(edges, ready, keys))
        ready = step.where("done").select(*keys, F.col("src").alias("node"), F.col("b").alias("depth"))
        edges = step.where("not done").drop("done")
        count = {r["done"]: r["count"] for r in step.groupBy("done").count().collect()}
        found.append(ready)
        if not count.get(False) or not count.get(True):
            break  # nothing is left, or all that is left leads to a cycle
        if layer % layers == 0:
            edges, paths = _contracted(edges, keys, cut)
            ended.append(paths)
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    for paths in reversed(ended):
        more = paths.join(_renamed(out, node="dst"), [*keys, "dst"]).select(*keys, F.col("src").alias("node"), F.greatest("b", F.col("w") + F.col("depth")).alias("depth"))
        out = out.unionByName(more)
    return out

