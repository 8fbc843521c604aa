"""Every registered query of the record, report and graph operators against its SQL on the smallest tables."""

import math
import os

import duckdb
import pytest

from gatherline.plans import queries as q

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables here")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for name in os.listdir(DATA):
        c.execute(f"create view {name.split('.')[0]} as select * from '{DATA}/{name}'")
    return c


def _rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    plain = lambda v: None if isinstance(v, float) and math.isnan(v) else v + 0.0 if isinstance(v, float) else v
    return sorted([tuple(plain(r[i]) for i in order) for r in data], key=str)


@pytest.mark.parametrize("name", sorted(q.ORACLES))
def test_query_matches_sql(spark, con, name):
    df = q.QUERIES[name](spark, DATA)
    got = _rows(df.columns, [tuple(r) for r in df.collect()])
    found = con.execute(q.ORACLES[name])
    columns = [d[0] for d in found.description]
    assert sorted(columns) == sorted(df.columns)
    assert got == _rows(columns, found.fetchall())


@pytest.mark.parametrize("name", sorted(set(q.QUERIES) - set(q.ORACLES)))
def test_query_without_sql_runs(spark, name):
    assert q.QUERIES[name](spark, DATA).count() > 0


def test_plans_keep_python_to_the_helpers(spark):
    helpers = {"a10_regression_report", "a11_kendall_tau", "a19_flatten_ast", "a20_call_chain_depth", "f10_group_hulls", "u1_predict_batches", "x1_sampled_points"}
    for name in sorted(set(q.QUERIES) - helpers - {"g3_prune_sinks"}):
        plan = q.QUERIES[name](spark, DATA)._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "InPandas" not in plan, name
