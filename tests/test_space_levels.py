"""Levels of parameters without the driver: deep dependencies, circles, and many spaces with a plan of one size."""

import random

import pytest

from gatherline.operators import space as ds

SCHEMA = "space string, param string, option string, parent_param string, parent_option string"


def test_levels_of_deep_and_wide_spaces(spark):
    rng = random.Random(24)
    rows, want = [], {}
    for s in range(6):
        names = [f"p{i}" for i in range(30)]
        rng.shuffle(names)
        for i, name in enumerate(names):
            parent = names[i - 1] if s == 0 and i else rng.choice(names[:i]) if i and rng.random() < 0.7 else None
            want[f"s{s}", name] = 0 if parent is None else want[f"s{s}", parent] + 1
            rows += [(f"s{s}", name, o, parent, o if parent else None) for o in "ab"]
    got = {(r.space, r.param): r.level for r in ds.leveled(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == want and max(want.values()) == 29


def test_circles_are_an_error(spark):
    rows = [("s", "a", "1", "b", "1"), ("s", "b", "1", "c", "1"), ("s", "c", "1", "a", "1"), ("s", "d", "1", None, None)]
    with pytest.raises(ValueError, match="parameters of s depend on each other"):
        ds.design_space_size(spark.createDataFrame(rows, SCHEMA))


def test_many_spaces_make_no_longer_plan(spark):
    def plan(n):
        ids = spark.range(n)
        free = ids.selectExpr("concat('s', id) AS space", "concat('a', id) AS param", "explode(array('1', '2')) AS option", "cast(null AS string) AS parent_param", "cast(null AS string) AS parent_option")
        under = ids.selectExpr("concat('s', id) AS space", "concat('b', id) AS param", "explode(array('x', 'y', 'z')) AS option", "concat('a', id) AS parent_param", "'1' AS parent_option")
        other = ids.selectExpr("concat('s', id) AS space", "concat('b', id) AS param", "'w' AS option", "concat('a', id) AS parent_param", "'2' AS parent_option")
        size = ds.design_space_size(free.unionAll(under).unionAll(other))
        assert size.where("num_points = 4").count() == n
        return len(size._jdf.queryExecution().optimizedPlan().toString())

    assert abs(plan(30_000) - plan(10)) < 200
