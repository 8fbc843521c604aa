"""Distributions and projections of metrics."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import finite
from .joins import TASK_ROWS, largest_group, small
from .placement import by_ranges, earlier


def pool_seed_final(seed: DataFrame, final: DataFrame) -> DataFrame:
    """Seed and final designs with a ``stage``; either side empty is an error."""
    for name, side in (("seed", seed), ("final", final)):
        if side.limit(1).count() == 0:
            raise ValueError(f"no {name} design passes")
    return seed.withColumn("stage", F.lit("seed")).unionByName(final.withColumn("stage", F.lit("final")), allowMissingColumns=True)


def metric_summary(records: DataFrame, stage: str, metrics: list[str], passing: Column, positive: tuple[str, ...] = ()) -> DataFrame:
    """Per metric and stage, over passing records: ``n, missing, min, max, degenerate``; ``positive`` metrics use values above 0."""
    long = records.where(passing).select(stage, *[finite(m).alias(m) for m in metrics]).unpivot([stage], metrics, "metric", "value")
    if positive:
        long = long.withColumn("value", F.when(~F.col("metric").isin(*positive) | (F.col("value") > 0), F.col("value")))
    out = long.groupBy("metric", stage).agg(F.count("value").alias("n"), F.count_if(F.col("value").isNull()).alias("missing"), F.min("value").alias("min"), F.max("value").alias("max"))
    close = F.abs(F.col("max") - F.col("min")) <= F.greatest(F.lit(1e-9) * F.greatest(F.abs("max"), F.abs("min")), F.lit(1e-12))
    return out.withColumn("degenerate", (F.col("n") < 2) | F.coalesce(close, F.lit(True)))


#: Density: steps a bandwidth into which many different values are binned, and bandwidths beyond which a kernel is nothing.
STEPS, REACH = 512, 8


def metric_density(values: DataFrame, keys: list[str], value: str, points: int = 200, distinct: int = 100_000) -> DataFrame:
    """Gaussian density of each group on an even grid from its least to its largest value: ``x, density``.

    Bandwidth is Scott's; groups with fewer than two values or no spread have no rows. Equal values are counted first. In a group
    of more than ``distinct`` different ones, each is shared linearly between its two neighbours on a lattice of 512 steps
    a bandwidth (an error of some 10^-7 of the density), so what follows does not grow with the rows. A value then
    adds to the grid points within 8 bandwidths, named by their numbers; values and grid are never joined.
    """
    stats = values.groupBy(*keys).agg(F.count(value).alias("__n"), F.stddev_samp(value).alias("__s"), F.min(value).cast("double").alias("__lo"), F.max(value).cast("double").alias("__hi"), F.approx_count_distinct(value).alias("__kinds")).where("__n >= 2 and __s > 0")
    stats = stats.withColumns({"__h": F.col("__s") * F.pow("__n", F.lit(-0.2)), "__gap": (F.col("__hi") - F.col("__lo")) / (points - 1)})
    counted = values.where(F.col(value).isNotNull()).groupBy(*keys, F.col(value).cast("double").alias("__v")).agg(F.count("*").cast("double").alias("__times"))
    counted = counted.join(small(stats), keys) if keys else counted.crossJoin(F.broadcast(stats))  # one row without keys
    step = F.col("__h") / STEPS
    at = (F.col("__v") - F.col("__lo")) / step
    low = F.floor(at)
    share = lambda i, part: F.struct((F.col("__lo") + i * step).alias("v"), (F.col("__times") * part).alias("times"))
    points_of = F.when(F.col("__kinds") > distinct, F.array(share(low, 1 - (at - low)), share(low + 1, at - low))).otherwise(F.array(F.struct(F.col("__v").alias("v"), F.col("__times").alias("times"))))
    own = ["__n", "__h", "__lo", "__gap"]
    binned = counted.select(*keys, *own, F.explode(points_of).alias("__p")).groupBy(*keys, *own, F.col("__p.v").alias("__v")).agg(F.sum("__p.times").alias("__times"))
    place, reach = (F.col("__v") - F.col("__lo")) / F.col("__gap"), REACH * F.col("__h") / F.col("__gap")
    first, last = F.greatest(F.lit(0), F.ceil(place - reach)), F.least(F.lit(points - 1), F.floor(place + reach))
    # where kernels are narrower than the grid, a value may reach no point
    met = binned.where(first <= last).select("*", F.explode(F.sequence(first, last)).alias("__i"))
    x = F.col("__lo") + F.col("__gap") * F.col("__i")
    z = (x - F.col("__v")) / F.col("__h")
    kernel = F.col("__times") * F.exp(-z * z / 2) / (F.col("__h") * F.col("__n") * np.sqrt(2 * np.pi))
    sums = met.groupBy(*keys, "__i").agg(F.sum(kernel).alias("density"))
    grid = stats.select(*keys, "__lo", "__hi", F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("__i"))
    grid = grid.withColumn("x", F.col("__lo") + (F.col("__hi") - F.col("__lo")) * F.col("__i") / (points - 1)).drop("__lo", "__hi")
    return grid.join(sums, [*keys, "__i"], "left").select(*keys, "x", F.coalesce("density", F.lit(0.0)).alias("density"))


def mquantiles(values: DataFrame, keys: list[str], value: str, probs: tuple[float, ...], alpha: float = 0.4, beta: float = 0.4) -> DataFrame:
    """Plotting-position quantiles: ``prob, quantile``.

    Values are sorted by ranges; the ranges' counts tell in which range, and at which place of it, the wanted ranks lie. Groups
    that one task can sort take one window.
    """
    df = values.where(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("__v"))
    at = lambda n: n * F.col("prob") + alpha + F.col("prob") * (1 - alpha - beta)
    if largest_group(df, keys) <= TASK_ROWS:
        by = Window.partitionBy(*keys)
        ranked = df.select(*keys, "__v", F.lead("__v").over(by.orderBy("__v")).alias("__up"), F.row_number().over(by.orderBy("__v")).alias("__r"), F.count("*").over(by).alias("__n"))
        ranked = ranked.withColumn("prob", F.explode(F.array(*map(F.lit, probs))))
        k = F.floor(F.greatest(F.lit(1.0), F.least(at(F.col("__n")), F.col("__n") - 1.0)))
        g = F.least(F.lit(1.0), F.greatest(F.lit(0.0), at(F.col("__n")) - k))
        return ranked.where(F.col("__r") == k).select(*keys, "prob", ((1 - g) * F.col("__v") + g * F.coalesce("__up", "__v")).alias("quantile"))
    placed = by_ranges(df, [*keys, "__v"], TASK_ROWS)
    sizes = placed.groupBy(*keys, "__range").agg(F.count("*").alias("__m"), F.min("__nth").alias("__begin"))
    sizes = sizes.withColumn("__off", F.coalesce(F.sum("__m").over(earlier(keys)), F.lit(0))).withColumn("__n", F.sum("__m").over(Window.partitionBy(*(keys or [F.lit(0)]))))
    want = sizes.withColumn("prob", F.explode(F.array(*map(F.lit, probs))))
    a = at(F.col("__n"))
    k = F.floor(F.greatest(F.lit(1.0), F.least(a, F.col("__n") - 1.0))).cast("long")
    want = want.withColumns({"__k": k, "__g": F.least(F.lit(1.0), F.greatest(F.lit(0.0), a - k))})
    want = want.withColumn("__e", F.explode(F.array(F.struct(F.lit(0).alias("up"), F.col("__k").alias("rank")), F.struct(F.lit(1).alias("up"), F.least(F.col("__k") + 1, F.col("__n")).alias("rank")))))
    inside = F.col("__e.rank") - F.col("__off")
    want = want.where((inside > 0) & (inside <= F.col("__m"))).select(*keys, "prob", "__g", "__e.up", "__range", (F.col("__begin") + inside - 1).alias("__nth"))
    found = placed.select("__range", "__nth", "__v").join(small(want), ["__range", "__nth"])
    both = found.groupBy(*keys, "prob", "__g").agg(F.max(F.when(F.col("up") == 0, F.col("__v"))).alias("__low"), F.max(F.when(F.col("up") == 1, F.col("__v"))).alias("__high"))
    return both.select(*keys, "prob", ((1 - F.col("__g")) * F.col("__low") + F.col("__g") * F.col("__high")).alias("quantile"))


def describe_stats(values: DataFrame, keys: list[str], value: str) -> DataFrame:
    """count, mean, population deviation, least and largest."""
    return values.groupBy(*keys).agg(F.count(value).alias("count"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"), F.min(value).alias("min"), F.max(value).alias("max"))


def complete_vectors(records: DataFrame, metrics: list[str]) -> tuple[DataFrame, DataFrame]:
    """(records with all metrics, the others with the names that are ``missing``)."""
    df = records.withColumns({m: finite(m) for m in metrics})
    gone = F.array_compact(F.array(*[F.when(F.col(m).isNull(), F.lit(m)) for m in metrics]))
    df = df.withColumn("missing", gone)
    return df.where(F.size("missing") == 0).drop("missing"), df.where(F.size("missing") > 0)


def scale_metrics(vectors: DataFrame, metrics: list[str]) -> DataFrame:
    """log1p of columns without negatives whose corrected skew is above 1, then z-scores with the population deviation."""
    skew = lambda c: F.skewness(c) * F.sqrt(F.count(c) * (F.count(c) - 1)) / F.nullif(F.count(c) - 2, F.lit(0))
    one = vectors.agg(*[f(m).alias(f"{m}__{n}") for m in metrics for f, n in ((F.min, "min"), (skew, "skew"))]).first()
    logged = {m: one[f"{m}__min"] is not None and one[f"{m}__min"] >= 0 and (one[f"{m}__skew"] or 0) > 1 for m in metrics}
    df = vectors.withColumns({m: F.log1p(m) if logged[m] else F.col(m).cast("double") for m in metrics})
    two = df.agg(*[f(m).alias(f"{m}__{n}") for m in metrics for f, n in ((F.avg, "mean"), (F.stddev_pop, "std"))]).first()
    return df.withColumns({m: (F.col(m) - F.lit(two[f"{m}__mean"])) / F.lit(two[f"{m}__std"] or 1.0) for m in metrics})


def pca_project(vectors: DataFrame, metrics: list[str], k: int = 2) -> tuple[DataFrame, list[float]]:
    """(rows with ``pc1 … pck``, share of variance of each). Signs: the largest loading is positive.

    One aggregate gives sums and products of the columns; the small symmetric matrix is solved on the driver.
    """
    pairs = [(i, j) for i in range(len(metrics)) for j in range(i, len(metrics))]
    row = vectors.agg(F.count("*").alias("n"), *[F.sum(m).alias(f"s{i}") for i, m in enumerate(metrics)], *[F.sum(F.col(metrics[i]) * F.col(metrics[j])).alias(f"p{i}_{j}") for i, j in pairs]).first()
    n = max(1, row["n"])
    mean = np.array([(row[f"s{i}"] or 0.0) / n for i in range(len(metrics))])
    cov = np.zeros((len(metrics), len(metrics)))
    for i, j in pairs:
        cov[i, j] = cov[j, i] = (row[f"p{i}_{j}"] or 0.0) / n - mean[i] * mean[j]
    values, axes = np.linalg.eigh(cov)
    order = np.argsort(-values)[:k]
    out = {}
    for c, o in enumerate(order):
        axis = axes[:, o] * np.sign(axes[np.argmax(np.abs(axes[:, o])), o])
        out[f"pc{c + 1}"] = reduce(lambda a, b: a + b, [(F.col(m) - float(mu)) * float(w) for m, mu, w in zip(metrics, mean, axis, strict=True)])
    return vectors.withColumns(out), [float(values[o] / max(values.sum(), 1e-300)) for o in order]


def hull(xy: np.ndarray) -> np.ndarray:
    """Vertices of the convex hull, in order; fewer than three for points on a line."""
    pts = np.unique(xy, axis=0)
    if len(pts) < 3:
        return pts

    def half(order) -> list:
        side: list = []
        for p in order:
            while len(side) > 1 and (side[-1][0] - side[-2][0]) * (p[1] - side[-2][1]) - (side[-1][1] - side[-2][1]) * (p[0] - side[-2][0]) <= 0:
                side.pop()
            side.append(p)
        return side[:-1]

    return np.array(half(pts) + half(pts[::-1]))


def group_hulls(points: DataFrame, key: str, x: str, y: str) -> DataFrame:
    """Hull vertices of each group: key, ``vertex, x, y``; groups of fewer than three distinct or of collinear points have none.

    Tasks reduce their points to partial hulls first; the hull of these is the group's.
    """
    kind = points.schema[key].dataType.simpleString()
    base = points.where(finite(x).isNotNull() & finite(y).isNotNull()).select(F.col(key).alias("key"), F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))

    def partial(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            rows = [pd.DataFrame({"key": pdf["key"][:0], "x": pdf["x"][:0], "y": pdf["y"][:0]})]
            for k, g in pdf.groupby("key", dropna=False):
                h = hull(g[["x", "y"]].to_numpy())
                rows.append(pd.DataFrame({"key": [k] * len(h), "x": h[:, 0], "y": h[:, 1]}))
            # values only: a chunked string column can't be sent back
            every = pd.concat(rows, ignore_index=True)
            yield every.assign(key=pd.Series(every["key"].tolist(), dtype=object))

    def final(pdf: pd.DataFrame) -> pd.DataFrame:
        h = hull(pdf[["x", "y"]].to_numpy())
        if len(h) < 3:
            h = h[:0].reshape(0, 2)
        return pd.DataFrame({"key": pd.Series([pdf["key"].iloc[0]] * len(h), dtype=object), "vertex": range(len(h)), "x": h[:, 0], "y": h[:, 1]})

    few = base.mapInPandas(partial, f"key {kind}, x double, y double")
    return few.groupBy("key").applyInPandas(final, f"key {kind}, vertex int, x double, y double").withColumnRenamed("key", key)
