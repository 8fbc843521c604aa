"""Operators on small hand-made tables."""

import json
import math
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from gatherline.functions import scalars as sc
from gatherline.functions import text as tx
from gatherline.operators import codegraph as cg
from gatherline.operators import evalreport as er
from gatherline.operators import features as ft
from gatherline.operators import joins as jn
from gatherline.operators import passrate as pr
from gatherline.operators import placement as pl
from gatherline.operators import profile as pf
from gatherline.operators import sampling as sp
from gatherline.operators import selection as sl
from gatherline.operators import space as ds
from gatherline.sources import readers as rd
from gatherline.sources import writers as wr


def one(df):
    return df.collect()[0]


def rounded(df, *columns):
    return df.withColumns({c: F.round(c, 9) for c in columns})


@pytest.mark.parametrize(("n", "c", "at1", "at8"), [(16, 3, 18.75, 90.0), (16, 1, 6.25, 50.0), (16, 8, 50.0, 99.99223), (16, 10, 62.5, 100.0)])
def test_published_seed_rows(spark, n, c, at1, at8):
    pools = spark.createDataFrame([("d", "Seed", n, c)], "domain string, stage string, total long, passed long")
    row = one(pr.stage_summary(pools, ["domain", "stage"]))
    assert round(row.pass_at_1, 4) == at1 and round(row.pass_at_8, 5) == round(at8, 5)
    assert row.pass_at_1 == pytest.approx(row.average_passing_percent)


def test_pass_at_k_edges(spark):
    df = spark.createDataFrame([(4, 0), (4, 4)], "n long, c long")
    assert [r[0] for r in df.select(sc.pass_at_k("n", "c", 2)).collect()] == [0.0, 1.0]
    with pytest.raises(Exception, match="pass@k"):
        spark.createDataFrame([(2, 3)], "n long, c long").select(sc.pass_at_k("n", "c", 1)).collect()
    with pytest.raises(ValueError, match="positive"):
        sc.pass_at_k("n", "c", 0)


def test_retry_beats_original(spark):
    df = spark.createDataFrame([(1, 3, "", "Fail"), (1, 3, "__fix", " pass "), (1, 3, "__a", "Fail"), (1, 4, None, None)], "pool int, idx int, suffix string, status string")
    got = {r.idx: r.status for r in pr.effective_samples(df, ["pool"], "idx", "suffix").collect()}
    assert got == {3: " pass ", 4: None}
    assert tuple(one(pr.pool_counts(pr.effective_samples(df, ["pool"], "idx", "suffix"), ["pool"]))) == (1, 2, 1)


def test_nested_numeric(spark):
    docs = ['{"a":{"x":3}}', '{"a":{"x":"3"}}', '{"a":{"x":true}}', '{"a":7}', "broken", None, '{"a":{"x":2.5}}', '{"a":{"x":null}}']
    df = spark.createDataFrame([(d,) for d in docs], "j string")
    assert [r[0] for r in df.select(sc.nested_numeric("j", ("a", "x"), 2.0)).collect()] == [6.0, None, None, None, None, None, 5.0, None]


def test_coerce_number(spark):
    df = spark.createDataFrame([(x,) for x in (" 12 ", "", "abc", None, "1e3", "1.0f", "-inf", "nan")], "s string")
    got = [r[0] for r in df.select(sc.coerce_number("s", -1.0)).collect()]
    assert got[:7] == [12.0, -1.0, -1.0, -1.0, 1000.0, -1.0, -math.inf] and math.isnan(got[7])


def test_natural_order(spark):
    df = spark.createDataFrame([(x,) for x in ("b10", "b2", "a3", "b02x")], "s string")
    assert [r.s for r in df.orderBy(sc.natural_sort_key("s")).collect()] == ["a3", "b2", "b02x", "b10"]


def test_full_bundle(spark):
    names = ["top.txt", "kernel_description.md", "opt_template.tcl", "hls_eval_config.toml", "k.h", "k.cpp", "k_tb.cpp"]
    df = spark.createDataFrame([(names,), (names[:-1],), (None,)], "n array<string>")
    assert [r[0] for r in df.select(tx.check_bundle("n", "full")).collect()] == [True, False, False]


def test_code_blocks_last_wins(spark):
    text = '<OUTPUT_CODE name="a"> 1 </OUTPUT_CODE>\n<OUTPUT_CODE name="a">\n2\n</OUTPUT_CODE>'
    df = spark.createDataFrame([(text,), ("none",)], "t string").select(tx.extract_code_blocks("t").alias("m"))
    assert [r.m for r in df.collect()] == [{"a": "2"}, None]


def test_directive_without_label_fails(spark):
    df = spark.createDataFrame([("d", "set_directive_pipeline top")], "id string, t string")
    with pytest.raises(Exception, match="without a label"):
        tx.parse_directives(df, "t", ["id"]).collect()


def test_frontier_ties(spark):
    rows = [(1.0, 5.0), (1.0, 4.0), (2.0, 4.0), (3.0, 1.0), (None, 0.0), (float("nan"), 0.0), (4.0, 1.0)]
    df = spark.createDataFrame(rows, "x double, y double")
    got = sl.pareto_frontier(df, "x", "y")
    assert sorted(map(tuple, got.collect())) == [(1.0, 4.0), (1.0, 5.0), (3.0, 1.0)]
    again = sl.pareto_frontier(got, "x", "y")
    assert sorted(map(tuple, again.collect())) == [(1.0, 4.0), (1.0, 5.0), (3.0, 1.0)]


def test_score_needs_three_points(spark):
    df = spark.createDataFrame([("a", 0.0, 1.0), ("a", 1.0, 0.0), ("b", 0.0, 1.0), ("b", 0.5, 0.5), ("b", 1.0, 0.0)], "k string, x double, y double")
    got = {r.k: r for r in sl.pareto_score(df, "x", "y", ["k"]).collect()}
    assert got["a"].score is None and got["b"].score == pytest.approx(0.5) and got["b"].gap_ratio == pytest.approx(0.5)


def test_stop_epoch(spark):
    rows = [(s, e, 1.0 / min(e, 3)) for s in ("train", "test") for e in range(1, 60)]
    df = spark.createDataFrame([("r", *r) for r in rows], "run string, split string, epoch int, loss double")
    assert one(sl.stop_epoch(df, ["run"])).stop_epoch == 52


def test_regions_round_trip(spark):
    seq = ["a", "a", "b", "a", "a", "a"]
    df = spark.createDataFrame([(1, i, t) for i, t in enumerate(seq)], "s int, i int, t string")
    regions = sorted(pr.schedule_regions(df, ["s"], "i", "t").collect(), key=lambda r: r.start)
    assert [r.target for r in regions for _ in range(r.length)] == seq
    assert one(pr.schedule_label(pr.schedule_regions(df, ["s"], "i", "t"), ["s"])).label == "(a) x2 → (b) x1 → (a) x3"


@pytest.mark.parametrize("size", [0, 1, 7, 10, 50])
def test_quotas_add_up(spark, size):
    df = spark.createDataFrame([("a", 5), ("b", 3), ("c", 2)], "s string, n long")
    got = sp.proportional_quotas(df, "s", "n", size).collect()
    assert sum(r.quota for r in got) == min(size, 10) and all(0 <= r.quota <= r.n for r in got)


def test_splits_are_disjoint_and_exact(spark):
    df = spark.range(103)
    got = sp.split_by_count(df, "id", 0.1, 0.2, 5).groupBy("split").count().collect()
    assert {r.split: r["count"] for r in got} == {"train": 72, "val": 10, "test": 21}
    folds = sp.kfold_split(df, "id", 0.25, 3, 5, 0.2)
    assert {r.fold: r["count"] for r in folds.groupBy("fold").count().collect()} == {0: 25, 1: 25, 2: 25, 3: 28}


def test_tau_of_itself(spark):
    df = spark.createDataFrame([("k", float(i % 17), float(-(i % 17))) for i in range(80)], "k string, x double, y double")
    assert one(er.kendall_tau(df, "k", "x", "x")).tau == pytest.approx(1.0)
    assert one(er.kendall_tau(df, "k", "x", "y")).tau == pytest.approx(-1.0)


def test_tau_against_pairs(spark):
    rng = np.random.default_rng(4)
    x, y = rng.integers(0, 30, 300), rng.integers(0, 30, 300)
    s = np.sign(x[:, None] - x) * np.sign(y[:, None] - y)
    want = s.sum() / np.sqrt((np.sign(x[:, None] - x) != 0).sum() * (np.sign(y[:, None] - y) != 0).sum())
    df = spark.createDataFrame([("k", float(a), float(b)) for a, b in zip(x, y, strict=True)], "k string, x double, y double")
    assert one(er.kendall_tau(df, "k", "x", "y", bucket_rows=40)).tau == pytest.approx(want)


def test_hull_of_hull(spark):
    rng = np.random.default_rng(1)
    pts = rng.normal(size=(200, 2))
    df = spark.createDataFrame([("a", *map(float, p)) for p in pts] + [("line", float(i), float(i)) for i in range(5)], "k string, x double, y double")
    got = pf.group_hulls(df, "k", "x", "y").collect()
    assert {r.k for r in got} == {"a"}
    mine = np.array([[r.x, r.y] for r in got])
    assert len(pf.hull(mine)) == len(mine)
    inside = lambda p: all((b[0] - a[0]) * (p[1] - a[1]) - (b[1] - a[1]) * (p[0] - a[0]) >= -1e-9 for a, b in zip(pf.hull(mine), np.roll(pf.hull(mine), -1, axis=0), strict=True))
    assert all(inside(p) for p in pts)


def test_call_chains(spark):
    rows = [("chain", "a", "b"), ("chain", "b", "c"), ("chain", "c", "d"), ("self", "a", "a"), ("two", "a", "b"), ("two", "b", "a")]
    got = {r.k: r.max_call_chain_depth for r in cg.call_chain_depth(spark.createDataFrame(rows, "k string, caller string, callee string"), ["k"]).collect()}
    assert got == {"chain": 4, "self": 2, "two": 3}


def test_prune_twice(spark):
    nodes = spark.createDataFrame([("d", x) for x in "abcd"], "design_id string, node_id string")
    edges = spark.createDataFrame([("d", "a", "b"), ("d", "b", "a"), ("d", "b", "c"), ("d", "c", "d")], "design_id string, src string, dst string")
    n, e = cg.prune_sinks(spark, nodes, edges)
    assert sorted(r.node_id for r in n.collect()) == ["a", "b"] and e.count() == 2


def test_block_nodes_count(spark):
    nodes = spark.createDataFrame([("d", str(i), i % 2, i % 3, "t", 0, "f") for i in range(11)], "design_id string, node_id string, block int, function int, text string, type int, full_text string")
    edges = spark.createDataFrame([("d", 0, "0", "1", 0, 0)], "design_id string, edge_id long, src string, dst string, flow int, position int")
    n, e = cg.add_block_nodes(nodes, edges)
    assert n.count() == 11 + 6 and e.count() == 1 + 22
    numbered, _ = ft.edge_index(nodes, edges)
    assert [r.node_id for r in numbered.orderBy("idx").collect()][:4] == ["0", "1", "10", "2"]


def test_array_directive_rows(spark):
    nodes = spark.createDataFrame([("d", "1", 0, 0, "buf", 1, "x"), ("d", "2", 0, 0, "pseudo_block", 4, "b")], "design_id string, node_id string, block int, function int, text string, type int, full_text string")
    directives = spark.createDataFrame([("d", 5, "array_partition", "buf", "raw")], "design_id string, line int, kind string, var string, raw string")
    anchors = cg.anchor_array_directives(directives, nodes)
    assert [r.anchor for r in anchors.collect()] == [2]
    new, edges = cg.array_pragma_rows(directives, anchors, nodes)
    assert one(new).node_id == "3" and sorted((r.src, r.dst, r.position) for r in edges.collect()) == [("2", "3", 2), ("3", "2", 2)]


def test_space_with_children(spark):
    rows = [("s", "a", "1", None, None), ("s", "a", "2", None, None), ("s", "b", "x", "a", "1"), ("s", "b", "y", "a", "1"), ("s", "b", "z", "a", "2"), ("s", "c", "0", None, None)]
    df = spark.createDataFrame(rows, "space string, param string, option string, parent_param string, parent_option string")
    assert one(ds.design_space_size(df)).num_points == 3
    assert sorted(r.point_key for r in ds.enumerate_points(df).collect()) == ["a-1.b-x.c-NA", "a-1.b-y.c-NA", "a-2.b-z.c-NA"]
    with pytest.raises(ValueError, match="give n"):
        ds.enumerate_points(df, most=2)


def test_missing_member_fails(spark):
    have = spark.createDataFrame([("a",), ("b",)], "d string")
    with pytest.raises(Exception, match="not available: z; available: a, b"):
        cg.missing_members(spark.createDataFrame([("z",)], "d string"), have, "d").collect()


def test_record_tree(spark, tmp_path):
    def put(path, text):
        p = tmp_path / "run__2025-01-02_03-04-05/m/astro" / path / "single_eval_data.json"
        p.parent.mkdir(parents=True)
        p.write_text(text)

    put("seed_designs/seed_design_3", json.dumps({"status": "Pass", "kernel_ast_out": {"num_functions": 4}}))
    put("feedback_runs/seed_design_3/iter_0_samples/sample_1", json.dumps({"status": "Fail"}))
    put("feedback_runs/seed_design_3/iter_0_samples/sample_1__fix", json.dumps({"status": " pass "}))
    rows = rd.read_eval_records(spark, str(tmp_path)).collect()
    assert sorted((r.stage, r.seed, r.iteration, r.sample_idx, r.retry_suffix) for r in rows if r.stage != "seed_designs") == [("feedback_runs", 3, 0, 1, ""), ("feedback_runs", 3, 0, 1, "__fix")]
    assert {(r.run, r.model, r.domain) for r in rows} == {("run__2025-01-02_03-04-05", "m", "astro")}
    metric = rd.read_eval_records(spark, str(tmp_path)).where("stage = 'seed_designs'").select(sc.nested_numeric("kernel_ast_out", ("num_functions",)))
    assert one(metric)[0] == 4.0
    put("feedback_runs/seed_design_3/iter_0_samples/sample_2", "{broken")
    with pytest.raises(Exception, match="(?i)malformed|corrupt|parse"):
        rd.read_eval_records(spark, str(tmp_path)).collect()
    assert rd.read_eval_records(spark, str(tmp_path), "lenient").where("status is null").count() == 1


def test_synced_records_read_each_file_once(spark, tmp_path):
    base, root, store = tmp_path / "in/run__2025-01-02_03-04-05/m/astro/seed_designs", str(tmp_path / "in"), str(tmp_path / "store")

    def put(n, text):
        path = base / f"seed_design_{n}/iter_0_samples/sample_0/single_eval_data.json"
        path.parent.mkdir(parents=True)
        path.write_text(text)
        return path

    first = put(1, json.dumps({"status": "Pass"}))
    assert rd.sync_eval_records(spark, root, store).count() == 1
    first.unlink()  # what was read stays in the store
    put(2, json.dumps({"status": "Fail"}))
    for _ in range(2):
        got = rd.sync_eval_records(spark, root, store)
        assert sorted((r.seed, r.status, r.run, r.model) for r in got.collect()) == [(1, "Pass", "run__2025-01-02_03-04-05", "m"), (2, "Fail", "run__2025-01-02_03-04-05", "m")]
    assert got.columns == rd.read_eval_records(spark, root).columns
    broken = put(3, "{broken")
    with pytest.raises(Exception, match="(?i)malformed|corrupt|parse"):
        rd.sync_eval_records(spark, root, store)
    broken.write_text(json.dumps({"status": "Pass"}))
    assert sorted(r.seed for r in rd.sync_eval_records(spark, root, store).collect()) == [1, 2, 3]


def test_domain_summaries(spark, tmp_path):
    path = tmp_path / "run__x/m/astro/domain_eval_data_summary.json"
    path.parent.mkdir(parents=True)
    it = lambda t: {"Path": "p", "Status": "Pass", "Target": t, "target_result": {"num_functions": 2}}
    path.write_text(json.dumps({"target_list": {"a": "2 iteration(s)"}, "eval_data_by_seed": {"seed_design_0": {"seed_design": {"target_results": {"num_functions": 1}}, "iters": {"iter_10": it("b"), "iter_2": it("a"), "bad": it("c")}}}}))
    got = rd.read_domain_summaries(spark, str(tmp_path)).orderBy("position").collect()
    assert [(r.position, r.target, r.model, r.domain) for r in got] == [(0, None, "unknown_model", "astro"), (3, "a", "unknown_model", "astro"), (11, "b", "unknown_model", "astro")]


def test_qor_tables(spark, tmp_path):
    header = [c.strip().split("`")[1] for c in rd.QOR.split(",")]
    for name in ("one", "two"):
        (tmp_path / name).mkdir()
        (tmp_path / name / "data_all.csv").write_text(",".join(header) + "\nd1,n" + ",1" * (len(header) - 2) + "\n")
    got = rd.read_qor_tables(spark, [f"{tmp_path}/*/data_all.csv"]).collect()
    assert sorted(r.dataset for r in got) == ["one", "two"]
    with zipfile.ZipFile(tmp_path / "three.zip", "w") as z:
        z.write(tmp_path / "one" / "data_all.csv", "x/data_all.csv")
    assert [(r.dataset, r.design_id) for r in rd.read_qor_tables(spark, [f"{tmp_path}/three.zip"], archive=True).collect()] == [("three", "d1")]
    with pytest.raises(FileNotFoundError):
        rd.read_qor_tables(spark, [f"{tmp_path}/none/*.csv"])
    targets = rd.read_qor_tables(spark, [f"{tmp_path}/one/data_all.csv"]).select(*[c.alias(n) for n, c in sc.map_qor_targets("off").items()])
    assert one(targets)["perf"] == 1.0 and one(targets)["impl-BRAM"] == 3.0


def test_node_link_graph(spark, tmp_path):
    node = lambda i: {"id": str(i), "block": 0, "function": 0, "text": "t", "type": 0, "features": {"full_text": [f"f{i}"]}}
    (tmp_path / "a.json").write_text(json.dumps({"nodes": [node(0), node(1)], "links": [{"source": "0", "target": "1", "flow": 0, "position": 0}]}))
    (tmp_path / "b.json").write_text(json.dumps({"nodes": [node(0)], "edges": []}))
    nodes, edges = rd.read_node_link_graphs(spark, str(tmp_path))
    assert nodes.count() == 3 and [tuple(r) for r in edges.collect()] == [("a", 0, "0", "1", 0, 0)]
    (tmp_path / "c.json").write_text(json.dumps({"nodes": [node(0)]}))
    with pytest.raises(Exception, match="no edges"):
        rd.read_node_link_graphs(spark, str(tmp_path))[1].collect()


def test_gexf_graph(spark, tmp_path):
    (tmp_path / "d1.gexf").write_text(
        '<gexf><graph><attributes class="node"><attribute id="0" title="text" type="string"/><attribute id="1" title="type" type="long"/></attributes>'
        '<attributes class="edge"><attribute id="2" title="flow" type="long"/><attribute id="3" title="position" type="long"/></attributes>'
        '<nodes><node id="10" label="x"><attvalues><attvalue for="0" value="icmp"/><attvalue for="1" value="0"/></attvalues></node><node id="2" label="y"/></nodes>'
        '<edges><edge id="0" source="10" target="2"><attvalues><attvalue for="2" value="1"/><attvalue for="3" value="4"/></attvalues></edge></edges></graph></gexf>'
    )
    designs = spark.createDataFrame([("d1",), ("d2",)], "design_id string")
    nodes, edges, gone = rd.read_gexf_graphs(spark, str(tmp_path), designs)
    assert sorted((r.node_id, r.text, r.type) for r in nodes.collect()) == [("10", "icmp", 0), ("2", None, None)]
    assert [(r.src, r.dst, r.flow, r.position) for r in edges.collect()] == [("10", "2", 1, 4)] and [r.design_id for r in gone.collect()] == ["d2"]


def test_report_with_unknown_unit(spark):
    xml = "<p><PerformanceEstimates><SummaryOfTimingAnalysis><unit>hr</unit><EstimatedClockPeriod>1</EstimatedClockPeriod></SummaryOfTimingAnalysis></PerformanceEstimates></p>"
    with pytest.raises(Exception, match="unknown clock unit"):
        rd.parse_synth_reports(spark.createDataFrame([(xml,)], "x string"), "x").select("clock_period").collect()


def test_runs(spark):
    df = spark.createDataFrame([("run__2024",), ("run__2025",), ("other",)], "run string")
    assert [r.run for r in rd.select_runs(df).collect()] == ["run__2025"]
    with pytest.raises(ValueError, match="x"):
        rd.select_runs(df, ["x"])


def test_csv_files(spark, tmp_path):
    pools = spark.createDataFrame([("d", "Feedback 10", 8, 2), ("d", "Seed", 16, 3), ("d", "Feedback 2", 8, 8)], "domain string, stage string, total long, passed long")
    wr.write_stage_csv(pr.stage_summary(pools, ["domain", "stage"]).drop("average_passing_percent"), f"{tmp_path}/s")
    text = next((tmp_path / "s").glob("part-*.csv")).read_text().splitlines()
    assert text[0] == "domain,stage,num_designs,num_samples,num_passed,pass@1,pass@8"
    assert [x.split(",")[1] for x in text[1:]] == ["Seed", "Feedback 2", "Feedback 10"] and text[1] == "d,Seed,1,16,3,18.750000,90.000000"


def test_graph_samples_are_written(spark, tmp_path):
    nodes = spark.createDataFrame([("d", "0", "x")], "design_id string, node_id string, text string")
    edges = spark.createDataFrame([("d", "0", "0")], "design_id string, src string, dst string")
    labels = spark.createDataFrame([("d", 1.0, "one", "train")], "design_id string, perf double, dataset string, split string")
    ft.write_graph_samples(nodes, edges, labels, ft.fit_dictionaries({"text": nodes.select("text")}), str(tmp_path / "t"))
    assert spark.read.parquet(str(tmp_path / "t/nodes")).where("split = 'train'").count() == 1


def test_packed_samples(spark, tmp_path):
    nodes = spark.createDataFrame([(f"d{i % 5}", str(i), "x") for i in range(40)] + [("none", "0", "y")], "design_id string, node_id string, text string")
    edges = spark.createDataFrame([("d1", 1, "6", "1"), ("d1", 0, "1", "6")], "design_id string, edge_id long, src string, dst string")
    labels = spark.createDataFrame([(f"d{i}", float(i), "one", "test" if i == 4 else "train") for i in range(5)] + [("bare", 9.0, "one", "train"), ("d1", 1.0, "one", "train")], "design_id string, perf double, dataset string, split string")
    path = str(tmp_path / "t")
    ft.write_graph_samples(nodes, edges, labels, ft.fit_dictionaries({"text": nodes.select("text")}), path, files=2)
    got = {r.design_id: r for r in ft.read_graph_samples(spark, path).collect()}
    assert set(got) == {"d0", "d1", "d2", "d3", "d4", "bare"} and got["bare"].nodes == [] and got["d0"].edges == [] and got["d3"].perf == 3.0
    assert [e.edge_id for e in got["d1"].edges] == [0, 1] and [n.node_id for n in got["d1"].nodes] == sorted(str(i) for i in range(40) if i % 5 == 1)
    few = ft.read_graph_samples(spark, path, ["d2"], "split = 'train'")
    assert one(few).design_id == "d2" and "In(design_id" in few._jdf.queryExecution().toString() or "EqualTo(design_id,d2)" in few._jdf.queryExecution().toString()


def test_density_of_many_values_is_binned(spark):
    rng = np.random.default_rng(7)
    v = rng.gamma(2.0, 3.0, 4000)
    df = spark.createDataFrame([("g", float(x)) for x in v] + [("far", float(x)) for x in [0.0] * 500 + [1e6]] + [("one", 1.0), ("same", 2.0), ("same", 2.0)], "k string, v double")
    plain, binned = ({(r.k, round(r.x, 6)): r.density for r in pf.metric_density(df, ["k"], "v", distinct=n).collect()} for n in (10**6, 1000))
    h = v.std(ddof=1) * len(v) ** -0.2
    grid = np.linspace(v.min(), v.max(), 200)
    want = np.exp(-(((grid[:, None] - v) / h) ** 2) / 2).sum(1) / (h * len(v) * np.sqrt(2 * np.pi))
    assert [plain["g", round(float(x), 6)] for x in grid] == pytest.approx(want.tolist(), abs=1e-12)
    assert [binned["g", round(float(x), 6)] for x in grid] == pytest.approx(want.tolist(), abs=1e-7)
    assert len(plain) == len(binned) == 400 and plain["far", 0.0] > 0 and {k for k, _ in plain} == {"g", "far"}
    assert one(pf.metric_density(df.where("k = 'g'").select("v"), [], "v").agg(F.sum("density"))).asDict()["sum(density)"] == pytest.approx(want.sum())


def test_scope_and_sparse(spark):
    nodes = spark.createDataFrame([("d", "0", "pseudo_block", "x"), ("d", "1", "parallel", "PARALLEL factor=4"), ("d", "2", "add", "y")], "design_id string, node_id string, text string, full_text string")
    edges = spark.createDataFrame([("d", 0, "0", "1"), ("d", 1, "0", "2")], "design_id string, edge_id long, src string, dst string")
    got = {r.node_id: (list(r.scope), r.in_scope) for r in ft.pragma_scope_vector(nodes, edges).collect()}
    assert got["0"] == ([0.0, 0.0, 1.0, 4.0], True) and got["2"] == ([0.0] * 4, False)
    d = ft.fit_dictionaries({"text": nodes.where("text <> 'add'").select("text")})
    rows = {r.node_id: r.v for r in ft.one_hot(nodes, d, ["text"], ft.widths(d)).select("node_id", ft.sparse_to_array("features").alias("v")).collect()}
    assert rows["1"] == [1.0, 0.0] and rows["2"] == [0.0, 0.0]


def test_pca_axes(spark):
    rng = np.random.default_rng(0)
    a = rng.normal(size=500)
    df = spark.createDataFrame([(float(x), float(2 * x + e)) for x, e in zip(a, rng.normal(size=500) * 0.01, strict=True)], "a double, b double")
    out, shares = pf.pca_project(df, ["a", "b"])
    assert shares[0] > 0.999 and out.select(F.corr("pc1", "b")).first()[0] > 0.999


def test_rollup_and_merge(spark):
    from gatherline.operators import trajectory as tj

    seeds = spark.createDataFrame([("g", 1, "Pass"), ("g", 2, "pass")], "g string, seed int, status string")
    iters = spark.createDataFrame([("g", 1, 0, "Pass", "a")], "g string, seed int, it int, status string, target string")
    row = one(tj.rollup_summary(seeds, iters, ["g"], "seed", "it", "status", "target"))
    assert (row.num_generated_seed_designs, row.num_passing_seed_designs) == (2, 1) and row.eval_data_by_seed["1"].iters["iter_0"].Target == "a"


def test_ranks_and_frontiers_by_ranges_equal_those_of_one_window(spark, monkeypatch):
    """Large groups take another way than small ones; both give the same rows."""
    rng = np.random.default_rng(12)
    rows = [(int(k), float(x), float(y)) for k, x, y in zip(rng.integers(0, 3, 3000), rng.choice([1.0, *rng.normal(size=400)], 3000), np.where(rng.random(3000) < 0.3, 5.0, rng.normal(size=3000)), strict=True)]
    rows += [(9, float(i), float(-i)) for i in range(300)] + [(10, 1.0, 2.0), (11, None, 1.0), (11, 2.0, float("nan"))]
    df = spark.createDataFrame(rows, "k int, x double, y double")
    fns = [
        lambda: pf.mquantiles(df, ["k"], "y", (0.01, 0.3, 0.5, 0.7, 0.999)), lambda: sl.pareto_frontier(df.select("x", "y"), "x", "y"), lambda: sl.pareto_frontier(df, "x", "y", ["k"]),
        lambda: rounded(sl.pareto_score(df, "x", "y", ["k"]), "d_left", "d_right", "max_gap", "length", "score", "gap_ratio"),
    ]
    tau = lambda rows: rounded(er.kendall_tau(df.where("not isnan(y)"), "k", "x", "y", bucket_rows=rows), "tau")
    few = [sorted(map(str, df.collect())) for df in [*(fn() for fn in fns), tau(10_000)]]
    for module in (pf, sl, jn):
        monkeypatch.setattr(module, "TASK_ROWS", 150)
    many = [sorted(map(str, df.collect())) for df in [*(fn() for fn in fns), tau(90)]]
    assert few == many and all(few)


def test_rows_that_are_all_equal_are_spread_over_ranges(spark):
    df = spark.range(1000).select(F.lit("k").alias("k"), F.lit(1.0).alias("v"))
    got = pl.by_ranges(df, ["k", "v"], rows=100).groupBy("__range").agg(F.count("*").alias("n"), F.max("__nth").alias("last")).collect()
    assert len(got) > 5 and sum(r.n for r in got) == 1000 and max(r.n for r in got) < 400 and all(r.last == r.n - 1 for r in got)


def test_tau_of_heavy_values_by_buckets(spark):
    rows = [("k", 1.0, float(i % 7)) for i in range(200)] + [("k", float(i), 3.0) for i in range(150)] + [("k", float(i % 40), float(i * 7 % 31)) for i in range(250)] + [("j", 1.0, 1.0), (None, 2.0, 1.0)]
    df = spark.createDataFrame(rows, "k string, x double, y double")
    plain, cut = ({r.k: r.tau for r in er.kendall_tau(df, "k", "x", "y", bucket_rows=n).collect()} for n in (10_000, 25))
    assert plain["k"] == pytest.approx(cut["k"]) and plain["j"] is None and cut["j"] is None and set(plain) == set(cut)


def test_samples_of_a_huge_space_are_drawn_without_enumeration(spark):
    rows = [("s", f"p{i:02}", str(o), None, None) for i in range(40) for o in range(10)]  # 10^40 points
    rows += [("t", "a", "1", None, None), ("t", "a", "2", None, None), ("t", "b", "x", "a", "1"), ("t", "b", "y", "a", "1"), ("t", "b", "z", "a", "2"), ("t", "c", "u", None, None), ("t", "c", "v", None, None)]
    df = spark.createDataFrame(rows, "space string, param string, option string, parent_param string, parent_option string")
    got = ds.enumerate_points(df, n=5).collect()
    assert len({r.point_key for r in got if r.space == "s"}) == 5 and all(len(r.point) == 40 for r in got if r.space == "s")
    every = {r.point_key for r in ds.enumerate_points(df.where("space = 't'")).collect()}
    assert {r.point_key for r in ds.enumerate_points(df, n=100).where("space = 't'").collect()} == every and len(every) == 6
    few = [r.point_key for r in got if r.space == "t"]
    assert len(few) == len(set(few)) == 5 and set(few) <= every
