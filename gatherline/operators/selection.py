"""Frontiers, scores, rankings and best samples."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import is_pass
from .joins import TASK_ROWS, largest_group
from .placement import by_ranges, earlier, with_group_ranges

#: Rows that a task adds up at once, about.
SUM_ROWS = 500_000


def _keep_frontier(df: DataFrame, part: list[str | Column], x: str, y: str) -> DataFrame:
    before = Window.partitionBy(*part).orderBy(F.col(x), F.desc(y)).rowsBetween(Window.unboundedPreceding, -1)
    least = F.min(y).over(before)
    return df.withColumn("__least", least).where(F.col("__least").isNull() | (F.col(y) < F.col("__least"))).drop("__least")


def pareto_frontier(points: DataFrame, x: str, y: str, keys: list[str] | None = None) -> DataFrame:
    """Points whose y is below that of all before them, by x ascending and y descending.

    Rows without a number are dropped. The table is sorted by ranges; a running minimum of y over a group's ranges, a
    small table, drops most points at once, and the rest only meets points of its own range. So neither a hot key nor a
    frontier that holds all rows brings everything into one task. Groups that one task can sort go without ranges, but
    are pruned in salted parts before they meet.
    """
    keys = keys or []
    usable = points.where(F.col(x).isNotNull() & F.col(y).isNotNull() & ~F.isnan(F.col(x).cast("double")) & ~F.isnan(F.col(y).cast("double")))
    if largest_group(usable, keys) <= TASK_ROWS:
        salted = usable.withColumn("__salt", F.pmod(F.xxhash64(x, y), F.lit(64)))
        return _keep_frontier(_keep_frontier(salted, [*keys, "__salt"], x, y).drop("__salt"), keys or [F.lit(0)], x, y)
    placed = by_ranges(usable, [*keys, F.col(x), F.desc(y)], TASK_ROWS)
    lows = placed.groupBy(*keys, "__range").agg(F.min(y).alias("__low"))
    lows = lows.select(*keys, "__range", F.min("__low").over(earlier(keys)).alias("__low"))
    ahead = with_group_ranges(placed, lows, keys).where(F.col("__low").isNull() | (F.col(y) < F.col("__low"))).drop("__low", "__nth")
    return _keep_frontier(ahead, [*keys, "__range"], x, y).drop("__range")


def _with_next(front: DataFrame, keys: list[str]) -> DataFrame:
    """``__then``: what ``__here`` holds in the group's next row by x ascending and y descending; null in the last one."""
    order = [F.col("__x"), F.desc("__y")]
    if largest_group(front, keys) <= TASK_ROWS:
        return front.withColumn("__then", F.lead("__here").over(Window.partitionBy(*(keys or [F.lit(0)])).orderBy(*order)))
    placed = by_ranges(front, [*keys, *order], TASK_ROWS)
    first = placed.groupBy(*keys, "__range").agg(F.min_by("__here", "__nth").alias("__first"))
    first = first.select(*keys, "__range", F.lead("__first").over(Window.partitionBy(*(keys or [F.lit(0)])).orderBy("__range")).alias("__after"))
    inside = F.lead("__here").over(Window.partitionBy(*keys, "__range").orderBy("__nth"))
    return with_group_ranges(placed, first, keys).withColumn("__then", F.coalesce(inside, F.col("__after"))).drop("__after", "__range", "__nth")


def pareto_score(points: DataFrame, x: str, y: str, keys: list[str]) -> DataFrame:
    """Frontier score of each key: ``n_points, n_frontier, range_x, range_y, d_left, d_right, max_gap, length, score, gap_ratio``.

    The frontier is scaled by the range of all points; the score relates end distances and the largest gap to the
    curve's length. Fewer than three frontier points or an empty range give null. A frontier that no task can sort is
    sorted by ranges: the last point of a range meets the first one of the group's next range.
    """
    number = lambda c: F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double"))
    ranges = points.groupBy(*keys).agg(F.count("*").alias("n_points"), *[f(number(c)).alias(n) for c, a in ((x, "x"), (y, "y")) for f, n in ((F.min, f"__lo_{a}"), (F.max, f"__hi_{a}"))])
    front = pareto_frontier(points, x, y, keys).select(*keys, F.col(x).cast("double").alias("__x"), F.col(y).cast("double").alias("__y"))
    df = front.join(ranges, keys)
    scaled = lambda a: (F.col(f"__{a}") - F.col(f"__lo_{a}")) / F.nullif(F.col(f"__hi_{a}") - F.col(f"__lo_{a}"), F.lit(0.0))
    df = df.withColumns({"__nx": scaled("x"), "__ny": scaled("y")})
    df = _with_next(df.withColumn("__here", F.struct("__nx", "__ny", F.col("__x").alias("x"), F.col("__y").alias("y"))), keys)
    gap = F.sqrt(F.pow(F.col("__then.__nx") - F.col("__nx"), 2) + F.pow(F.col("__then.__ny") - F.col("__ny"), 2))
    df = df.withColumns({"__gap": gap, "__next": F.when(F.col("__then").isNotNull(), F.struct("__then.x", "__then.y"))})
    far = lambda a, b: F.min(F.sqrt(F.pow(F.col("__nx") - a, 2) + F.pow(F.col("__ny") - b, 2)))
    first_gap = F.min_by(F.struct(F.struct(F.col("__x").alias("x"), F.col("__y").alias("y")).alias("from"), F.col("__next").alias("to")), F.struct(-F.col("__gap"), F.col("__x"))).alias("gap_points")
    agg = df.groupBy(*keys).agg(F.count("*").alias("n_frontier"), far(0, 1).alias("d_left"), far(1, 0).alias("d_right"), F.max("__gap").alias("max_gap"), F.sum("__gap").alias("length"), first_gap)
    ends = F.col("d_left") + F.col("d_right")
    enough = F.col("n_frontier") >= 3
    out = ranges.join(agg, keys, "left").withColumn("n_frontier", F.coalesce("n_frontier", F.lit(0)))
    return out.select(
        *keys, "n_points", "n_frontier", (F.col("__hi_x") - F.col("__lo_x")).alias("range_x"), (F.col("__hi_y") - F.col("__lo_y")).alias("range_y"), "d_left", "d_right", "max_gap", "length", "gap_points",
        F.when(enough, (ends + F.col("max_gap")) / (ends + F.col("length"))).alias("score"), F.when(enough & (F.col("length") > 0), F.col("max_gap") / F.col("length")).alias("gap_ratio"),
    )


def rank_candidates(pred: DataFrame, key: list[str], value: str = "y_pred", k: int | None = 50, digits: int | None = None) -> DataFrame:
    """Keys by the sum of their predictions, ascending, ties by key; the first ``k``, or all.

    ``digits``: sums are rounded to so many decimals before they are compared. Rows are dealt by key and value first, so that no
    task adds up more than about ``SUM_ROWS`` keys, however few files there are.
    """
    rows = pred.select(*dict.fromkeys([*key, value]))
    tasks = max(int(pred.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows.count() // SUM_ROWS))
    score = F.sum(value)
    out = rows.repartition(tasks, *key, value).groupBy(*key).agg((score if digits is None else F.round(score, digits)).alias("score")).orderBy("score", *key)
    return out.limit(k) if k is not None else out


def best_sample(records: DataFrame, by: list[str], metric: str, size: str, sample: str, status: str | Column = "status") -> DataFrame:
    """Of the passing samples of each iteration the one with the largest (metric, size); ties: the smallest sample."""
    order = Window.partitionBy(*by).orderBy(F.desc(metric), F.desc(size), sample)
    return records.where(is_pass(status)).withColumn("__nth", F.row_number().over(order)).where("__nth = 1").drop("__nth")


def best_by_pareto(records: DataFrame, by: list[str], scores: list[str], sample: str, status: str | Column = "status", missing: float = 1.0) -> DataFrame:
    """Of the passing samples the one with the least sum of scores, where a missing score counts ``missing``."""
    total = reduce(lambda a, b: a + b, [F.coalesce(F.col(s).cast("double"), F.lit(missing)) for s in scores])
    df = records.where(is_pass(status)).withColumn("pareto_sum", total)
    order = Window.partitionBy(*by).orderBy("pareto_sum", sample)
    return df.withColumn("__nth", F.row_number().over(order)).where("__nth = 1").drop("__nth")


def loss_curve(history: DataFrame, keys: list[str], epoch: str = "epoch", loss: str = "loss") -> DataFrame:
    """Each epoch with ``improved`` (beats all earlier losses; never the first) and ``best_epoch`` (first of the minimum)."""
    before = Window.partitionBy(*keys).orderBy(epoch).rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy(*keys)
    improved = F.coalesce(F.col(loss) < F.min(loss).over(before), F.lit(False))
    return history.withColumns({"improved": improved, "best_epoch": F.min_by(epoch, F.struct(loss, epoch)).over(every)})


def stop_epoch(history: DataFrame, keys: list[str], split: str = "split", epoch: str = "epoch", loss: str = "loss", patience: int = 50, splits: tuple[str, ...] = ("train", "test")) -> DataFrame:
    """First epoch with more than ``patience`` losses whose last ``patience`` are all equal, in every split."""
    order = Window.partitionBy(*keys, split).orderBy(epoch)
    tail = order.rowsBetween(-(patience - 1), 0)
    flat = (F.min(loss).over(tail) == F.max(loss).over(tail)) & (F.row_number().over(order) > patience)
    df = history.where(F.col(split).isin(*splits)).withColumn("__flat", flat)
    both = df.groupBy(*keys, epoch).agg((F.count_if("__flat") == len(splits)).alias("__flat"))
    return both.groupBy(*keys).agg(F.min(F.when(F.col("__flat"), F.col(epoch))).alias("stop_epoch"))


def unique_names(df: DataFrame, scope: list[str], name: str, order: list[str]) -> DataFrame:
    """``unique_name``: the second and later use of a name in a scope gets _1, _2, …"""
    nth = F.row_number().over(Window.partitionBy(*scope, name).orderBy(*order)) - 1
    return df.withColumn("unique_name", F.when(nth == 0, F.col(name)).otherwise(F.concat(F.col(name), F.lit("_"), nth.cast("string"))))
