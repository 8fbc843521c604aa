"""Quotas, exact-size samples and splits in a seeded order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .joins import small


def order_key(seed: int, key: str) -> Column:
    """The order that stands for chance: md5 of seed and id, the same in every engine."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")))


def exact_rank(df: DataFrame, seed: int, key: str, groups: list[str] | None = None, digits: int = 3) -> DataFrame:
    """``rank`` (from 0) of each row in seeded order, within groups or over all, and ``total``.

    Rows are numbered within buckets of the hash's first digits; the buckets' sizes, a small table, give the offsets.
    No window ever holds a whole group.
    """
    groups = groups or []
    # a seen null groups with itself
    df = df.withColumn("__h", order_key(seed, key)).withColumn("__b", F.substring("__h", 1, digits))
    sizes = df.groupBy(*groups, "__b").agg(F.count("*").alias("__n"))
    before = Window.partitionBy(*(groups or [F.lit(0)])).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy(*(groups or [F.lit(0)]))
    sizes = sizes.withColumns({"__off": F.coalesce(F.sum("__n").over(before), F.lit(0)), "total": F.sum("__n").over(every)}).drop("__n")
    keys = [*groups, "__b"]
    right = sizes.select(*[F.col(k).alias(f"__r_{k}") for k in keys], "__off", "total")
    same = [F.col(k).eqNullSafe(F.col(f"__r_{k}")) for k in keys]
    within = F.row_number().over(Window.partitionBy(*keys).orderBy("__h", key)) - 1
    out = df.withColumn("__w", within).join(right, same)
    return out.withColumn("rank", F.col("__off") + F.col("__w")).drop("__h", "__b", "__w", "__off", *[f"__r_{k}" for k in keys])


def proportional_quotas(counts: DataFrame, source: str, count: str, size: int | None) -> DataFrame:
    """``quota`` of each source by largest remainder: min(size, all) rows in proportion to the counts; None sets no limit."""
    if size is not None and size < 0:
        raise ValueError("size must not be negative")
    if size is None:
        return counts.select(source, count, F.col(count).alias("quota"))
    every = Window.partitionBy(F.lit(0))  # a row per source
    total = F.sum(count).over(every)
    target = F.least(F.lit(size), total)
    wide = lambda c: c.cast("decimal(19,0)")  # noqa: E731  the product of two counts is beyond a long
    exact = wide(target) * wide(F.col(count))
    rest = F.pmod(exact, wide(total))
    df = counts.withColumns({"__floor": ((exact - rest) / wide(total)).cast("long"), "__rest": rest, "__target": target})
    left = F.col("__target") - F.sum("__floor").over(every)
    nth = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("__rest"), F.desc(count), source))
    df = df.withColumns({"__left": left, "__nth": nth})
    return df.select(source, count, F.coalesce(F.least(F.col(count), F.col("__floor") + (F.col("__nth") <= F.col("__left")).cast("long")), F.lit(0)).alias("quota"))


def sample_by_quota(df: DataFrame, quotas: DataFrame, source: str, key: str, seed: int) -> DataFrame:
    """Exactly ``quota`` rows of each source, in seeded order; a null quota leaves a source as it is."""
    ranked = exact_rank(df, seed, key, [source]).drop("total")
    return ranked.join(small(quotas.select(source, "quota")), source).where(F.col("quota").isNull() | (F.col("rank") < F.col("quota"))).drop("rank", "quota")


def split_by_count(df: DataFrame, key: str, val: float, test: float, seed: int, held_out: bool = False) -> DataFrame:
    """``split``: train int(n(1 - val - test)), val int(n val), test the rest; with a held-out test set: train int(n(1 - val)), val int(n val)."""
    n, r = F.col("total"), F.col("rank")
    train = F.floor(n * (1 - val - (0 if held_out else test)) + 1e-9)
    cut = train + F.floor(n * val + 1e-9)
    label = F.when(r < train, "train").when(r < cut, "val").otherwise(F.lit(None) if held_out else F.lit("test"))
    return exact_rank(df, seed, key).withColumn("split", label).drop("rank", "total")


def kfold_split(df: DataFrame, key: str, test: float, fold: int, seed: int, val: float = 0.0) -> DataFrame:
    """int(1/test) folds of int(n test) rows, the last takes the rest; ``fold`` is the test set, the others split by ``val``."""
    folds = int(1 / test + 1e-9)
    size = F.greatest(F.floor(F.col("total") * test + 1e-9), F.lit(1))
    df = exact_rank(df, seed, key).withColumn("fold", F.least(F.floor(F.col("rank") / size), F.lit(folds - 1)).cast("int")).withColumn("__size", size)
    start = F.lit(fold) * F.col("__size")
    stop = F.when(F.lit(fold) == folds - 1, F.col("total")).otherwise(start + F.col("__size"))
    rest = F.col("total") - (stop - start)
    place = F.when(F.col("rank") < start, F.col("rank")).otherwise(F.col("rank") - (stop - start))
    label = F.when(F.col("fold") == fold, "test").when(place < F.floor(rest * (1 - val) + 1e-9), "train").otherwise("val")
    return df.withColumn("split", label).drop("rank", "total", "__size")


def holdout_by_kernel(df: DataFrame, kernel: str, kernels: list[str]) -> DataFrame:
    """``split``: test for the listed kernels, else train."""
    return df.withColumn("split", F.when(F.col(kernel).isin(*kernels), "test").otherwise("train") if kernels else F.lit("train"))


def kernel_subset(df: DataFrame, kernel: str, kernels: list[str] | None = None) -> DataFrame:
    """Rows of the listed kernels; by default of the first in sort order."""
    if kernels:
        return df.where(F.col(kernel).isin(*kernels))
    return df.join(F.broadcast(df.agg(F.min(kernel).alias(kernel))), kernel, "left_semi")
