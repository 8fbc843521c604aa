"""Ranked candidates: rounding, ties, and how many keys a task adds up."""

from pyspark.sql import functions as F

from gatherline.operators import selection as sl


def test_rounded_sums_tie_by_key(spark):
    rows = [("b", 0.3), ("c", 0.1), ("c", 0.2), ("a", 0.2), ("a", 0.1), (None, 0.1), ("d", None)]
    df = spark.createDataFrame(rows, "k string, v double")
    got = [tuple(r) for r in sl.rank_candidates(df, ["k"], "v", k=None, digits=6).collect()]
    assert got == [("d", None), (None, 0.1), ("a", 0.3), ("b", 0.3), ("c", 0.3)]


def test_one_task_adds_up_few_keys(spark, monkeypatch):
    monkeypatch.setattr(sl, "SUM_ROWS", 100)
    df = spark.range(2000, numPartitions=1).select((F.col("id") % 1000).alias("k"), F.lit(1.0).alias("v"))
    got = sl.rank_candidates(df, ["k"], "v", k=None)
    assert "REPARTITION_BY_NUM" in (plan := got._jdf.queryExecution().executedPlan().toString()) and ", 20), REPARTITION_BY_NUM" in plan
    assert got.count() == 1000 and got.agg(F.sum("score")).first()[0] == 2000
