"""Roll-ups over seeds and runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import finite, is_exact_pass, normalize_target_list


def rollup_summary(seeds: DataFrame, iters: DataFrame, by: list[str], seed: str, iteration: str, status: str, target: str) -> DataFrame:
    """Per group: seeds generated and passing (exact status), and the nested map seed → {seed_design, iters}."""
    own = iters.groupBy(*by, seed).agg(F.map_from_entries(F.collect_list(F.struct(F.concat(F.lit("iter_"), F.col(iteration).cast("string")).alias("key"), F.struct(F.col(status).alias("Status"), F.col(target).alias("Target")).alias("value")))).alias("iters"))
    rows = seeds.join(own, [*by, seed], "left")
    entry = F.struct(F.col(seed).cast("string").alias("key"), F.struct(F.struct(F.col(status).alias("Status")).alias("seed_design"), F.col("iters")).alias("value"))
    return rows.groupBy(*by).agg(F.count("*").alias("num_generated_seed_designs"), F.count_if(is_exact_pass(status)).alias("num_passing_seed_designs"), F.map_from_entries(F.collect_list(entry)).alias("eval_data_by_seed"))


def trajectory_means(long: DataFrame, by: list[str], position: str, value: str, positions: int = 10, missing: float | None = None) -> DataFrame:
    """Mean over seeds of a metric at positions 0 to ``positions`` - 1; NaN counts as missing, which is left out or set."""
    number = finite(value) if missing is None else F.coalesce(finite(value), F.lit(missing))
    return long.where(F.col(position).between(0, positions - 1)).groupBy(*by, position).agg(F.avg(number).alias("mean_value"), F.count(number).alias("num_values"))


def active_segments(plan: DataFrame, keys: list[str], iteration: str, target: str, of: str | Column) -> DataFrame:
    """``segment, active``: whether the step from position k to k + 1 was planned for the target ``of``."""
    of = F.lit(of) if isinstance(of, str) else of
    return plan.select(*keys, F.col(iteration).alias("segment"), F.coalesce(F.col(target) == of, F.lit(False)).alias("active"))


def merge_runs(summaries: DataFrame, run: str, domain: str, model: str, targets: str, seed: str, by_domain: bool = True) -> DataFrame:
    """Groups of runs with one model and target list: ``label, num_runs, seeds`` (keys prefixed by run, and by domain if pooled)."""
    plan = F.array_sort(F.map_entries(normalize_target_list(targets)))
    name = F.concat_ws(":", F.col(run), *([] if by_domain else [F.col(domain)]), F.col(seed).cast("string"))
    rows = summaries.withColumn("target_plan", plan).where(F.size("target_plan") > 0)
    keys = [*([domain] if by_domain else []), model, "target_plan"]
    out = rows.groupBy(*keys).agg(F.array_sort(F.collect_set(run)).alias("runs"), F.array_sort(F.collect_set(name)).alias("seeds"))
    few = F.size("runs") <= 3
    label = F.when(few, F.array_join("runs", " + ")).otherwise(F.concat(F.element_at("runs", 1), F.lit(" + "), (F.size("runs") - 1).cast("string"), F.lit(" more")))
    return out.where(F.size("seeds") > 0).withColumn("label", label)
