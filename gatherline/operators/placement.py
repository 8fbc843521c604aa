"""Places of rows in an order, without a task that holds a whole group.

Rows are sorted by ranges: each range is one task of about ``TASK_ROWS`` rows, whatever the groups are. What a group needs to
know across ranges (counts before, least value before, first row after) comes from a table with one row per group and range.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import joins


def by_ranges(df: DataFrame, order: list[str | Column], rows: int | None = None) -> DataFrame:
    """The rows with ``__range`` (which grows with the order) and ``__nth`` (their place in it, from 0).

    Rows that are equal in ``order`` are told apart by their place in the input, so that many of them are spread over ranges.
    The result is written: the sample that sets the ranges is drawn once.
    """
    parts = max(1, -(-df.count() // (rows or joins.TASK_ROWS)))
    by = [*order, F.col("__tie")]
    placed = df.withColumn("__tie", F.monotonically_increasing_id()).repartitionByRange(parts, *by).sortWithinPartitions(*by)
    placed = placed.withColumn("__at", F.monotonically_increasing_id())
    placed = placed.withColumns({"__range": F.shiftright("__at", 33).cast("int"), "__nth": F.col("__at").bitwiseAND((1 << 33) - 1)})
    return joins.materialized(df.sparkSession, placed.drop("__tie", "__at"))


def earlier(keys: list[str], at: str = "__range") -> Window:
    """What comes before the row in a table with one row per group and range."""
    return Window.partitionBy(*(keys or [F.lit(0)])).orderBy(at).rowsBetween(Window.unboundedPreceding, -1)


def with_group_ranges(df: DataFrame, per: DataFrame, keys: list[str], at: str = "__range") -> DataFrame:
    """``df`` joined with ``per``, which has one row per group and range; null keys are groups like others."""
    on = [F.col(c).eqNullSafe(F.col(f"__k_{c}")) for c in (*keys, at)]
    renamed = per.select(*[F.col(c).alias(f"__k_{c}") for c in (*keys, at)], *[c for c in per.columns if c not in (*keys, at)])
    return df.join(joins.small(renamed), on).drop(*[f"__k_{c}" for c in (*keys, at)])


def value_buckets(df: DataFrame, key: str, value: str, rows: int, out: str) -> DataFrame:
    """``df`` with the number of its value's bucket, which grows with the value within the key's rows.

    A bucket takes the values that begin within ``rows`` rows of the order; a value with as many rows has one of its own. The
    distinct values are counted and placed, and rows find their bucket by the value.
    """
    placed = by_ranges(df.groupBy(key, value).agg(F.count("*").alias("__n")), [key, value])
    per = placed.groupBy(key, "__range").agg(F.sum("__n").alias("__m"))
    per = per.select(key, "__range", F.coalesce(F.sum("__m").over(earlier([key])), F.lit(0)).alias("__off"))
    inside = Window.partitionBy(key, "__range").orderBy("__nth").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum("__n").over(inside), F.lit(0))
    known = with_group_ranges(placed.withColumn("__before", before), per, [key])
    number = 2 * F.floor((F.col("__off") + F.col("__before")) / rows) + (F.col("__n") >= rows).cast("long")
    known = known.select(F.col(key).alias("__k"), F.col(value).alias("__v"), number.alias(out))
    return df.join(joins.small(known), F.col(key).eqNullSafe(F.col("__k")) & F.col(value).eqNullSafe(F.col("__v"))).drop("__k", "__v")
