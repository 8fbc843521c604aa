"""Pairs of seed and final designs are joined by shuffle."""

from gatherline.operators import codegraph as cg


def test_seeds_are_never_broadcast(spark):
    final = spark.createDataFrame([(0, "seed_design_1_iter_3"), (0, "seed_design_2_iter_3"), (0, "seed_design_1_iter_2")], "grp long, name string")
    seed = spark.createDataFrame([(0, "seed_design_1"), (1, "seed_design_2")], "grp long, name string")
    pairs, left = cg.pair_seed_final(final, seed, ["grp"], "name", 3)
    for df in (pairs, left):
        assert "BroadcastHashJoin" not in df._jdf.queryExecution().executedPlan().toString()
    assert [tuple(r) for r in pairs.select("seed_id", "seed_name").collect()] == [(1, "seed_design_1")]
    assert [r["seed_id"] for r in left.collect()] == [2]
