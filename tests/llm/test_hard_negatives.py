"""Operator 12 against scoring every anchor with every row."""

import collections
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from gatherline.llm.hard_negatives import Walk, mine_hard_negatives

SCHEMA = "vec_id long, embedding array<float>, label int, row string, block int, asks int, anchor string"


def plain(rows, every, positives=5, negatives=10, low=30, high=90):
    sound = [(i, l, [math.floor(256 * float(x)) for x in v]) for i, v, l in rows if i is not None and l is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    out = collections.Counter()
    for n, (i, l, v) in enumerate(sound):
        if i % every:
            continue
        scored = sorted((-dot(v, w), j, m == l) for k, (j, m, w) in enumerate(sound) if k != n)
        for p, j, _ in [s for s in scored if s[2]][:positives]:
            fit = [s for s in scored if not s[2] and low * -p <= 100 * -s[0] <= high * -p][:negatives]
            out.update((i, j, rank, s[1], -p, -s[0]) for rank, s in enumerate(fit, 1))
    return out


def rows(n=700, dim=12, scale=1.0):
    rng = np.random.default_rng(12)
    middle = rng.normal(size=(9, dim))
    v = np.round(scale * (middle[rng.integers(0, 9, n)] + 0.7 * rng.normal(size=(n, dim))) * 8) / 16
    out = [(i, v[i].astype(np.float32).tolist(), int(rng.integers(0, 4))) for i in range(n)]
    out += [(1000 + i, out[20][1], i % 3) for i in range(150)]  # one very common vector: ties by id
    out += [(20, out[20][1], out[20][2]), (40, out[40][1], 3), (41, out[41][1], out[41][2])]  # ids that repeat
    out += [(None, out[1][1], 1), (2000, None, 1), (2020, out[1][1], None), (2040, [None] * dim, 1), (2060, [float("nan")] * dim, 1), (2080, [float("-inf")] * dim, 1)]
    return [*out, (2100, [0.0] * dim, 1), (2120, [], 2), (2140, [1.0], 0), (2160, [1e30] + [0.0] * (dim - 1), 77), (-20, [-1.0] * dim, -5), (2180, out[3][1] + [0.5], 1)]


@pytest.mark.parametrize("block_rows,seeds", [(1 << 14, 16), (64, 2), (64, 1 << 30)])
def test_against_scoring_all(spark, block_rows, seeds):
    held = lambda x: 2.0**18 if x is not None and math.isfinite(x) and abs(x) > 1e29 else x
    bounded = [(i, v and [held(x) for x in v], l) for i, v, l in rows()]
    df = spark.createDataFrame([(i, v, l, "x", 1, 2, "y") for i, v, l in rows()], SCHEMA).repartition(3)
    got = mine_hard_negatives(spark, df, F.col("vec_id") % 20 == 0, block_rows=block_rows, seeds=seeds)
    want = plain(bounded, 20)
    assert collections.Counter(tuple(r) for r in got.collect()) == want and len(want) > 800
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]


def test_large_components_and_few_rows(spark):
    data = [(i, v, l) for i, v, l in rows(60, 6, 3000.0) if v is None or len(v) == 6 and not any(x is not None and abs(x) > 1e29 for x in v)]
    df = spark.createDataFrame([(i, v, l, "x", 1, 2, "y") for i, v, l in data], SCHEMA)
    got = mine_hard_negatives(spark, df, F.col("vec_id") % 5 == 0, positives=3, negatives=4, low=-50, high=70)
    assert collections.Counter(tuple(r) for r in got.collect()) == plain(data, 5, 3, 4, -50, 70)


def test_no_anchors_and_no_rows(spark):
    df = spark.createDataFrame([(1, [1.0], 1, "", 1, 1, "")], SCHEMA)
    assert mine_hard_negatives(spark, df, F.col("vec_id") % 20 == 0).count() == 0
    assert mine_hard_negatives(spark, df, F.lit(True)).count() == 0  # nothing else is there
    assert mine_hard_negatives(spark, df.where("false"), F.lit(True)).count() == 0


def test_walks_stop_early():
    """Anchors of a narrow cluster leave most of a list unread, and lose nothing by it."""
    rng = np.random.default_rng(1)
    middle = np.array([100.0, 0, 0, 0])
    own = np.round(middle + rng.normal(size=(30, 4)) * 2).astype(np.int32)
    other = np.round(rng.normal(size=(40000, 4)) * 60).astype(np.int32)
    units = own / np.linalg.norm(own, axis=1)[:, None]
    piece = (np.arange(30), np.zeros(30, np.int64), own, np.array([1.0, 0, 0, 0]), float(np.arccos(units[:, 0]).max()), np.full((30, 1), -(10**9)), np.full((30, 1), 10**9))
    walk = Walk(piece, 5, True)
    walk.through(1 << 20, (np.arange(40000), np.zeros(40000, np.int64), other, None))
    assert walk.scored < 30 * 40000 / 3
    score = own.astype(np.int64) @ other.T.astype(np.int64)
    for a in range(30):
        want = sorted(zip(-score[a], range(40000)))[:5]
        mine = walk.held[0] == a
        assert sorted(zip((-walk.held[1][mine]).tolist(), walk.held[2][mine].tolist())) == [(int(s), i) for s, i in want]
