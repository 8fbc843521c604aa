"""Depths and pruned graphs by joins against walks, and long chains in few rounds."""

import random

import pytest
from pyspark.sql import functions as F

from gatherline.operators import codegraph as cg
from gatherline.operators.peeling import finite_depths


@pytest.fixture
def rounds(monkeypatch):
    """How many tables were written to cut the lineage."""
    made = []
    plain = cg.materialized
    monkeypatch.setattr(cg, "materialized", lambda spark, df: made.append(1) or plain(spark, df))
    return made


def walk(edges):
    """Depth by recursion, functions in order of name; one met again while open counts 1."""
    graph = {}
    for a, b in sorted(set(edges)):
        graph.setdefault(a, []).append(b)
        graph.setdefault(b, [])
    known = {}

    def depth(v, open_):
        if v in open_:
            return 1
        if v not in known:
            known[v] = 1 + max((depth(u, open_ | {v}) for u in graph[v]), default=0)
        return known[v]

    return max((depth(v, frozenset()) for v in sorted(graph)), default=0)


def graphs():
    rng = random.Random(20)
    out = {}
    for k in range(14):
        n = rng.randrange(2, 12)
        up = [(rng.randrange(n), rng.randrange(n)) for _ in range(rng.randrange(1, 3 * n))]
        out[f"acyclic{k}"] = [(f"f{min(e):02}", f"f{max(e):02}") for e in up if e[0] != e[1]] or [("f00", "f01")]
        out[f"any{k}"] = [(f"f{a:02}", f"f{b:02}") for a, b in up]
        out[f"chains{k}"] = [(f"c{j}_{i:03}", f"c{j}_{i + 1:03}") for j in range(3) for i in range(rng.randrange(5, 12))] + [(f"c0_{rng.randrange(5):03}", f"c1_{rng.randrange(5):03}"), ("c1_000", "c2_000")]
    return out | {"ring": [(f"r{i}", f"r{(i + 1) % 9}") for i in range(9)], "tail": [(f"t{i}", f"t{i + 1}") for i in range(10)] + [("t10", "t6")], "self": [("a", "a")]}


def test_depths_against_a_walk(spark):
    rows = [(k, a, b) for k, edges in graphs().items() for a, b in edges] + [("nulls", None, "a"), ("nulls", "a", None), (None, "x", "y")]
    calls = spark.createDataFrame(rows, "k string, caller string, callee string")
    got = {r.k: r.max_call_chain_depth for r in cg.call_chain_depth(calls, ["k"]).collect() if r.k is not None}
    assert got == {k: walk(e) for k, e in graphs().items()} | {"nulls": 0}


def test_acyclic_designs_need_no_python(spark):
    rows = [(k, a, b) for k, edges in graphs().items() if k.startswith("acyclic") for a, b in edges]
    plan = cg.call_chain_depth(spark.createDataFrame(rows, "k string, caller string, callee string"), ["k"])._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "InPandas" not in plan


@pytest.mark.parametrize("layers", [2, 100])
def test_depth_of_each_node(spark, layers):
    rows = [(k, a, b) for k, edges in graphs().items() for a, b in edges]
    got = {(r.k, r.node): r.depth for r in finite_depths(spark.createDataFrame(rows, "k string, src string, dst string"), ["k"], lambda df: cg.materialized(spark, df), layers).collect()}
    want = {}
    for k, edges in graphs().items():
        left, level = set(edges), 0
        alive = {x for e in edges for x in e}
        while True:
            level += 1
            sinks = alive - {a for a, _ in left}
            if not sinks:
                break
            want |= {(k, s): level for s in sinks}
            alive -= sinks
            left = {e for e in left if e[1] in alive}
    assert got == want


def test_long_chains_take_few_rounds(spark, rounds):
    n = 100_000
    chain = spark.range(n).selectExpr("'long' AS k", "lpad(id, 7, '0') AS caller", "lpad(id + 1, 7, '0') AS callee")
    assert cg.call_chain_depth(chain, ["k"]).first().max_call_chain_depth == n + 1
    assert len(rounds) < 40
    rounds.clear()
    nodes = spark.range(n + 1).selectExpr("'long' AS design_id", "cast(id AS string) AS node_id")
    edges = spark.range(n).selectExpr("'long' AS design_id", "cast(id AS string) AS src", "cast(id + 1 AS string) AS dst")
    ring = spark.createDataFrame([("long", "10", "5")], "design_id string, src string, dst string")
    left, kept = cg.prune_sinks(spark, nodes, edges.unionByName(ring))
    assert left.where(F.col("node_id").cast("int") <= 10).count() == left.count() == 11 and kept.count() == 11
    assert len(rounds) < 40
