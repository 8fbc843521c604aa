"""Pass rates: effective samples, pools, estimators by stage, schedules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import is_pass, pass_at_k


def effective_samples(records: DataFrame, pool: list[str], sample: str, suffix: str) -> DataFrame:
    """One record per pool and sample: a retry beats the original, the greatest suffix beats other retries."""
    order = Window.partitionBy(*pool, sample).orderBy((F.coalesce(F.col(suffix), F.lit("")) == "").cast("int"), F.desc(suffix))
    return records.withColumn("__nth", F.row_number().over(order)).where("__nth = 1").drop("__nth")


def pool_counts(records: DataFrame, pool: list[str], status: str | Column = "status") -> DataFrame:
    """``total, passed`` of each pool; pools without a record don't occur."""
    return records.groupBy(*pool).agg(F.count("*").alias("total"), F.count_if(is_pass(status)).alias("passed"))


def stage_summary(pools: DataFrame, by: list[str], ks: tuple[int, ...] = (1, 8)) -> DataFrame:
    """Per stage: pools, samples, passed, and in percent the means over pools of pass@k and of the passing share."""
    means = [(100 * F.avg(pass_at_k("total", "passed", k))).alias(f"pass_at_{k}") for k in ks]
    return pools.groupBy(*by).agg(F.count("*").alias("num_designs"), F.sum("total").alias("num_samples"), F.sum("passed").alias("num_passed"), *means, (100 * F.avg(F.col("passed") / F.col("total"))).alias("average_passing_percent"))


def target_sequences(iters: DataFrame, seed: list[str], iteration: str, target: str) -> DataFrame:
    """``sequence`` of targets of each seed in numeric iteration order; rows without a target are passed over."""
    rows = iters.where(F.col(target).isNotNull() & (F.col(target) != ""))
    pairs = F.array_sort(F.collect_list(F.struct(F.col(iteration).alias("i"), F.col(target).alias("t"))))
    return rows.groupBy(*seed).agg(F.transform(pairs, lambda p: p["t"]).alias("sequence"))


def majority_schedule(iters: DataFrame, group: list[str], seed: str, iteration: str, target: str) -> DataFrame:
    """The most common target sequence of each group, and how many seeds have it; ties go to the smallest seed."""
    found = target_sequences(iters, [*group, seed], iteration, target)
    counted = found.groupBy(*group, "sequence").agg(F.count("*").alias("num_seeds"), F.min(seed).alias("first_seed"))
    best = F.max_by("sequence", F.struct("num_seeds", -F.col("first_seed")))
    return counted.groupBy(*group).agg(best.alias("sequence"), F.max("num_seeds").alias("num_seeds"))


def planned_targets(sequence: str | Column, requested: str | Column) -> Column:
    """Distinct targets in plan order, then the requested ones that the plan lacks."""
    get = lambda c: F.col(c) if isinstance(c, str) else c
    return F.array_distinct(F.concat(get(sequence), get(requested)))


def schedule_regions(iters: DataFrame, keys: list[str], iteration: str, target: str) -> DataFrame:
    """Runs of one target: keys, ``start, end`` (inclusive), ``target, length``."""
    order = Window.partitionBy(*keys).orderBy(iteration)
    new = (~F.col(target).eqNullSafe(F.lag(target).over(order))) | F.lag(iteration).over(order).isNull()
    df = iters.withColumn("__island", F.sum(new.cast("int")).over(order))
    df = df.groupBy(*keys, "__island").agg(F.min(iteration).alias("start"), F.max(iteration).alias("end"), F.first(target).alias("target"), F.count("*").alias("length"))
    return df.drop("__island")


def region_bounds(regions: DataFrame, keys: list[str]) -> DataFrame:
    """Half-open ``spans`` per target, and all distinct boundaries, sorted."""
    span = F.struct(F.col("start"), (F.col("end") + 1).alias("stop"))
    per = regions.groupBy(*keys, "target").agg(F.array_sort(F.collect_list(span)).alias("spans"))
    every = regions.groupBy(*keys).agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.array(F.col("start"), F.col("end") + 1))))).alias("boundaries"))
    return per.join(every, keys)


def schedule_label(regions: DataFrame, keys: list[str]) -> DataFrame:
    """``(name) xN`` of all regions, joined by arrows."""
    part = F.concat(F.lit("("), F.col("target"), F.lit(") x"), F.col("length").cast("string"))
    pairs = F.array_sort(F.collect_list(F.struct(F.col("start").alias("s"), part.alias("p"))))
    label = F.array_join(F.transform(pairs, lambda x: x["p"]), " → ")
    return regions.groupBy(*keys).agg(F.when(label == "", "N/A").otherwise(label).alias("label"))


def contiguous_prefix(iters: DataFrame, keys: list[str], iteration: str) -> DataFrame:
    """Iterations 0, 1, 2, … up to the first that is missing."""
    order = Window.partitionBy(*keys).orderBy(iteration)
    return iters.withColumn("__nth", F.row_number().over(order) - 1).where(F.col("__nth") == F.col(iteration)).drop("__nth")


def expand_schedule(df: DataFrame, keys: list[str], targets: str, iterations: str | int) -> DataFrame:
    """``iteration, target, next_target``: the i-th target, repeated as often as the i-th count (or one count for all) says."""
    t = F.col(targets)
    if isinstance(iterations, int):
        many = F.transform(t, lambda _: F.lit(iterations))
    else:
        many = F.when(F.size(iterations) == F.size(t), F.col(iterations)).otherwise(F.raise_error(F.lit("as many counts as targets are needed")).cast("array<int>"))
    plan = F.flatten(F.zip_with(t, many, lambda x, n: F.array_repeat(x, n)))
    return df.select(*keys, plan.alias("__plan")).select(*keys, "__plan", F.posexplode("__plan").alias("iteration", "target")).select(*keys, "iteration", "target", F.try_element_at("__plan", F.col("iteration") + 2).alias("next_target"))
