"""One query for each operator on the driver's tables, beside DuckDB SQL for the same rows.

The domain's own tables do not exist there, so columns of orders, parts, events and documents stand in for them. Every
query runs over whole tables; doubles are rounded on both sides, ties are broken by a key.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scalars as sc
from ..functions import text as tx
from ..operators import codegraph as cg
from ..operators import evalreport as er
from ..operators import features as ft
from ..operators import passrate as pr
from ..operators import profile as pf
from ..operators import sampling as sp
from ..operators import selection as sl
from ..operators import space as ds
from ..operators import trajectory as tj
from ..operators.joins import materialized
from ..sources import readers as rd
from ..sources import writers as wr

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


class Tables:
    """The driver's tables by name."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")


def query(name: str, sql: str | None = None):
    """Register a function of the tables under a name."""

    def add(fn: Callable[[Tables], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: fn(Tables(spark, sf_dir))
        if sql:
            ORACLES[name] = sql
        return fn

    return add


def r6(c: str | Column) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, 6)


# ---- pass rates -------------------------------------------------------------------------------------------------

_REC = """r AS (SELECT user_id % 10 AS domain, user_id AS seed, day(ts) % 10 AS stage, event_id % 8 AS sample_idx, event_type AS suffix FROM events),
e AS (SELECT domain, stage, seed, sample_idx, max(suffix) AS suffix FROM r GROUP BY ALL),
p AS (SELECT domain, stage, seed, count(*) AS total, count(*) FILTER (suffix IN ('click', 'purchase')) AS passed FROM e GROUP BY ALL)"""


def _k(k: int) -> str:
    return f"CASE WHEN total - passed < {k} THEN 1.0 WHEN passed = 0 THEN 0.0 ELSE 1 - list_product(list_transform(range(total - passed + 1, total + 1), lambda i: 1 - {k} / i)) END"


def _records(t: Tables) -> DataFrame:
    return t.events.select(
        (F.col("user_id") % 10).alias("domain"), F.col("user_id").alias("seed"), (F.day("ts") % 10).alias("stage"), (F.col("event_id") % 8).alias("sample_idx"),
        F.col("event_type").alias("suffix"), F.when(F.col("event_type").isin("purchase", "click"), " Pass ").otherwise("Fail").alias("status"))


def _effective(t: Tables) -> DataFrame:
    return pr.effective_samples(_records(t), ["domain", "stage", "seed"], "sample_idx", "suffix")


def _pools(t: Tables) -> DataFrame:
    return pr.pool_counts(_effective(t), ["domain", "stage", "seed"])


@query("a3_stage_summary", f"""WITH {_REC} SELECT domain, stage, count(*) AS num_designs, sum(total)::BIGINT AS num_samples, sum(passed)::BIGINT AS num_passed,
    round(100 * avg({_k(1)}), 6) AS pass_at_1, round(100 * avg({_k(8)}), 6) AS pass_at_8, round(100 * avg(passed / total), 6) AS average_passing_percent FROM p GROUP BY domain, stage""")
def _(t):
    df = pr.stage_summary(_pools(t), ["domain", "stage"])
    return df.withColumns({c: r6(c) for c in ("pass_at_1", "pass_at_8", "average_passing_percent")})


@query("w1_effective_samples", f"WITH {_REC} SELECT * FROM e")
def _(t):
    return _effective(t).drop("status")


@query("a1_pool_counts", f"WITH {_REC} SELECT * FROM p")
def _(t):
    return _pools(t)


@query("a2_pass_at_k", f"WITH {_REC} SELECT domain, stage, seed, " + ", ".join(f"round({_k(k)}, 6) AS p{k}" for k in (1, 2, 3, 8)) + " FROM p")
def _(t):
    return _pools(t).select("domain", "stage", "seed", *[r6(sc.pass_at_k("total", "passed", k)).alias(f"p{k}") for k in (1, 2, 3, 8)])


@query("s8_stage_csv_rows", f"""WITH {_REC}, s AS (SELECT 'd' || domain AS domain, CASE WHEN stage = 0 THEN 'Seed' ELSE 'Feedback ' || (stage - 1) END AS stage, count(*) AS num_designs, sum(total)::BIGINT AS num_samples,
    100 * avg({_k(1)}) AS a FROM p GROUP BY domain, stage)
    SELECT domain, stage, num_designs::VARCHAR AS num_designs, num_samples::VARCHAR AS num_samples, printf('%.6f', a) AS "pass@1" FROM s""")
def _(t):
    pools = _pools(t).withColumns({"domain": F.concat(F.lit("d"), F.col("domain").cast("string")), "stage": F.when(F.col("stage") == 0, "Seed").otherwise(F.concat(F.lit("Feedback "), (F.col("stage") - 1).cast("string")))})
    return wr.stage_table(pr.stage_summary(pools, ["domain", "stage"], (1,)).drop("num_passed", "average_passing_percent"))


_ITER = "i AS (SELECT o_orderpriority AS grp, o_custkey AS seed, row_number() OVER (PARTITION BY o_orderpriority, o_custkey ORDER BY o_orderdate, o_orderkey) - 1 AS it, o_orderstatus AS target FROM orders)"


def _iters(t: Tables) -> DataFrame:
    nth = F.row_number().over(Window.partitionBy("o_orderpriority", "o_custkey").orderBy("o_orderdate", "o_orderkey")) - 1
    return t.orders.select(F.col("o_orderpriority").alias("grp"), F.col("o_custkey").alias("seed"), nth.alias("it"), F.col("o_orderstatus").alias("target"), "o_totalprice")


@query("a4_majority_schedule", f"""WITH {_ITER}, s AS (SELECT grp, seed, string_agg(target, ',' ORDER BY it) AS q FROM i GROUP BY grp, seed), c AS (SELECT grp, q, count(*) AS n, min(seed) AS f FROM s GROUP BY grp, q)
    SELECT grp, q AS sequence, n AS num_seeds FROM (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY n DESC, f) AS k FROM c) WHERE k = 1""")
def _(t):
    return pr.majority_schedule(_iters(t), ["grp"], "seed", "it", "target").withColumn("sequence", F.array_join("sequence", ","))


@query("a4_planned_targets", f"WITH {_ITER}, s AS (SELECT grp, seed, list(target ORDER BY it) AS q FROM i GROUP BY grp, seed), u AS (SELECT grp, seed, unnest(q || ['P', 'O', 'X']) AS v, unnest(range(len(q) + 3)) AS k FROM s), f AS (SELECT grp, seed, v, min(k) AS k FROM u GROUP BY ALL) SELECT grp, seed, string_agg(v, ',' ORDER BY k) AS planned FROM f GROUP BY grp, seed")
def _(t):
    s = pr.target_sequences(_iters(t), ["grp", "seed"], "it", "target")
    return s.select("grp", "seed", F.array_join(pr.planned_targets("sequence", F.array(F.lit("P"), F.lit("O"), F.lit("X"))), ",").alias("planned"))


_STEP = "s AS (SELECT user_id, event_type AS target, (row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1)::BIGINT AS it FROM events), n AS (SELECT *, CASE WHEN lag(target) OVER (PARTITION BY user_id ORDER BY it) IS DISTINCT FROM target THEN 1 ELSE 0 END AS b FROM s), g AS (SELECT *, sum(b) OVER (PARTITION BY user_id ORDER BY it) AS isl FROM n), q AS (SELECT user_id, min(it) AS start, max(it) AS \"end\", any_value(target) AS target, count(*) AS length FROM g GROUP BY user_id, isl)"


def _regions(t: Tables) -> DataFrame:
    nth = (F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1).cast("long")
    return pr.schedule_regions(t.events.select("user_id", F.col("event_type").alias("target"), nth.alias("it")), ["user_id"], "it", "target")


@query("w2_schedule_regions", f"WITH {_STEP} SELECT * FROM q")
def _(t):
    return _regions(t)


@query("w2_schedule_label", f"WITH {_STEP} SELECT user_id, string_agg('(' || target || ') x' || length, ' → ' ORDER BY start) AS label FROM q GROUP BY user_id")
def _(t):
    return pr.schedule_label(_regions(t), ["user_id"])


@query("w2_region_bounds", f"WITH {_STEP}, b AS (SELECT user_id, unnest([start, \"end\" + 1]) AS v FROM q), d AS (SELECT user_id, string_agg(DISTINCT lpad(v::VARCHAR, 8, '0'), ',' ORDER BY lpad(v::VARCHAR, 8, '0')) AS boundaries FROM b GROUP BY user_id) SELECT q.user_id, target, string_agg(start || '-' || (\"end\" + 1), ',' ORDER BY start) AS spans, boundaries FROM q JOIN d ON q.user_id = d.user_id GROUP BY ALL")
def _(t):
    b = pr.region_bounds(_regions(t), ["user_id"])
    return b.select("user_id", "target", F.array_join(F.transform("spans", lambda s: F.concat_ws("-", s["start"].cast("string"), s["stop"].cast("string"))), ",").alias("spans"), F.array_join(F.transform("boundaries", lambda x: F.lpad(x.cast("string"), 8, "0")), ",").alias("boundaries"))


@query("w3_contiguous_prefix", "WITH m AS (SELECT DISTINCT o_custkey, (month(o_orderdate) - 1)::INTEGER AS it FROM orders) SELECT o_custkey, it FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY it) - 1 AS n FROM m) WHERE n = it")
def _(t):
    return pr.contiguous_prefix(t.orders.select("o_custkey", (F.month("o_orderdate") - 1).alias("it")).distinct(), ["o_custkey"], "it")


@query("w7_expand_schedule", "WITH u AS (SELECT user_id, list(DISTINCT event_type ORDER BY event_type) AS l FROM events GROUP BY user_id), x AS (SELECT user_id, l, unnest(range(2 * len(l)))::INTEGER AS iteration FROM u) SELECT user_id, iteration, l[iteration // 2 + 1] AS target, l[(iteration + 1) // 2 + 1] AS next_target FROM x")
def _(t):
    return pr.expand_schedule(t.events.groupBy("user_id").agg(F.array_sort(F.collect_set("event_type")).alias("l")), ["user_id"], "l", 2)


# ---- scalars ----------------------------------------------------------------------------------------------------


@query("p1_is_pass", "SELECT event_id, event_type IN ('purchase', 'click') AS ok, event_type = 'signup' AS exact FROM events")
def _(t):
    e = F.col("event_type")
    s = F.when(e == "purchase", " pass\t").when(e == "click", "PASS").when(e == "signup", "Pass ").when(e == "view", None).otherwise("Fail")
    return t.events.select("event_id", (sc.is_pass(s) & (e != "signup")).alias("ok"), sc.is_exact_pass(F.when(e == "signup", "Pass").otherwise(s)).alias("exact"))


@query("p2_nested_numeric", "SELECT event_id, CASE event_id % 5 WHEN 0 THEN round(2 * json_extract_string(props, '$.k')::DOUBLE, 6) WHEN 3 THEN round(2 * value, 6) END AS number FROM events")
def _(t):
    k, n = F.get_json_object("props", "$.k"), F.col("event_id") % 5
    doc = F.concat(F.lit('{"a": {"k": '), F.when(n == 0, k).when(n == 1, F.concat(F.lit('"'), k, F.lit('"'))).when(n == 2, "true").when(n == 3, F.col("value").cast("string")).otherwise("null"), F.lit("}}"))
    return t.events.select("event_id", r6(sc.nested_numeric(doc, ("a", "k"), 2.0)).alias("number"))


@query("p3_coerce_number", "SELECT event_id, CASE event_id % 5 WHEN 0 THEN value WHEN 1 THEN json_extract_string(props, '$.k')::DOUBLE ELSE -1 END AS number FROM events")
def _(t):
    n = F.col("event_id") % 5
    v = F.when(n == 0, F.concat(F.lit(" "), F.col("value").cast("string"), F.lit("\n"))).when(n == 1, F.get_json_object("props", "$.k")).when(n == 2, F.col("event_type")).when(n == 3, "  ")
    return t.events.select("event_id", sc.coerce_number(v, -1.0).alias("number"))


@query("p4_first_present", "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN l_returnflag = 'A' THEN l_quantity WHEN l_linestatus = 'O' THEN l_tax ELSE l_discount END AS v FROM lineitem")
def _(t):
    df = t.lineitem.withColumns({"a": F.when(F.col("l_returnflag") == "A", F.col("l_quantity").cast("string")).otherwise(" "), "b": F.when(F.col("l_linestatus") == "O", F.col("l_tax").cast("string")).otherwise("n/a"), "c": F.col("l_discount").cast("string")})
    return df.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", sc.first_present(["a", "b", "c"], 0.0).alias("v"))


_TL = "CASE p_partkey % 3 WHEN 0 THEN p_size::VARCHAR WHEN 1 THEN p_size || ' iteration(s)' ELSE 'none' END"


def _target_map(t: Tables) -> DataFrame:
    m = F.col("p_partkey") % 3
    v = F.when(m == 0, F.col("p_size").cast("string")).when(m == 1, F.concat(F.col("p_size").cast("string"), F.lit(" iteration(s)"))).otherwise("none")
    return t.part.select("p_partkey", "p_type", F.map_from_arrays(F.array(F.col("p_type"), F.lit("A")), F.array(v, F.lit("7x8"))).alias("m"))


@query("p5_target_list", f"SELECT p_partkey, 'A:7,' || p_type || ':' || coalesce(TRY_CAST(nullif(regexp_extract({_TL}, '(\\d+)', 1), '') AS INTEGER), 0) AS targets FROM part")
def _(t):
    m = F.array_sort(F.map_entries(sc.normalize_target_list("m")))
    return _target_map(t).select("p_partkey", F.array_join(F.transform(m, lambda e: F.concat_ws(":", e["key"], e["value"].cast("string"))), ",").alias("targets"))


@query("p6_group_signature", f"SELECT p_partkey, substr(md5('A:7x8,' || p_type || ':' || {_TL}), 1, 8) AS signature FROM part")
def _(t):
    return _target_map(t).select("p_partkey", sc.group_signature("m").alias("signature"))


@query("p7_design_point_key", "SELECT p_partkey, 'A-NA.' || 'brand-' || p_brand || '.' || 'size-' || CASE WHEN p_size % 5 = 0 THEN 'NA' ELSE p_size::VARCHAR END AS key FROM part")
def _(t):
    m = F.create_map(F.lit("size"), F.when(F.col("p_size") % 5 == 0, "0").otherwise(F.col("p_size").cast("string")), F.lit("brand"), F.col("p_brand"), F.lit("A"), F.lit(None).cast("string"))
    return t.part.select("p_partkey", sc.design_point_key(m).alias("key"))


@query("p8_model_names", "SELECT p_partkey, lower(replace(replace(replace('openrouter/' || p_name || '-' || p_brand, '/', '_'), '-', '_'), ' ', '_')) AS normal, CASE WHEN length(p_name || '-' || p_brand || '-' || p_type || '-instruct-preview') > 42 THEN substr(p_name || '-' || p_brand || '-' || p_type || '-instruct-preview', 1, 39) || '...' ELSE p_name || '-' || p_brand || '-' || p_type || '-instruct-preview' END AS short, CASE p_type WHEN 'SMALL' THEN 'Little' ELSE upper(p_type[1]) || lower(p_type[2:]) END AS label FROM part")
def _(t):
    return t.part.select("p_partkey", sc.normalize_model_name(F.concat(F.lit("openrouter/"), "p_name", F.lit("-"), "p_brand")).alias("normal"), sc.short_model_name(F.concat(F.lit("openrouter/"), F.concat_ws("-", "p_name", "p_brand", "p_type", F.lit("instruct-preview")))).alias("short"), sc.display_label("p_type", {"SMALL": "Little"}).alias("label"))


@query("p9_natural_order", "SELECT p_partkey, row_number() OVER (PARTITION BY p_type ORDER BY CAST(substr(p_brand, 7) AS INTEGER), p_size, p_partkey) AS pos FROM part")
def _(t):
    key = sc.natural_sort_key(F.concat(F.col("p_brand"), F.lit("-"), F.col("p_size").cast("string")))
    return t.part.select("p_partkey", F.row_number().over(Window.partitionBy("p_type").orderBy(key, "p_partkey")).cast("long").alias("pos"))


@query("p10_approx_tokens", "SELECT doc_id, (length(text) // 4)::BIGINT AS tokens FROM documents")
def _(t):
    return t.documents.select("doc_id", sc.approx_tokens("text").alias("tokens"))


@query("p11_code_blocks", "SELECT conv_id, turn, 2 AS n, trim(text, E' \\t\\n\\r\\x0b\\x0c') AS first_code, role AS last_code FROM conversations")
def _(t):
    c = F.concat(F.lit('x<OUTPUT_CODE name="a.cpp">old</OUTPUT_CODE>\n<OUTPUT_CODE name="a.cpp">\n'), "text", F.lit('\n</OUTPUT_CODE> y <OUTPUT_CODE name="b.h"> '), "role", F.lit(" </OUTPUT_CODE>"))
    return t.conversations.select("conv_id", "turn", tx.extract_code_blocks(c).alias("m")).select("conv_id", "turn", F.size("m").alias("n"), F.col("m")["a.cpp"].alias("first_code"), F.col("m")["b.h"].alias("last_code"))


@query("p12_check_bundle", "SELECT o_custkey, bool_or(o_orderstatus = 'F') AND count(DISTINCT o_orderstatus) = 1 AS ok FROM orders GROUP BY o_custkey")
def _(t):
    name = F.when(F.col("o_orderstatus") == "F", "opt_template.tcl").otherwise(F.concat("o_orderstatus", F.lit(".cpp")))
    return t.orders.groupBy("o_custkey").agg(F.collect_set(name).alias("names")).select("o_custkey", tx.check_bundle("names", "optdsl").alias("ok"))


@query("p13_render_prompts", "SELECT conv_id, turn, sha256('Pre' || chr(10) || chr(10) || 'Fix ' || role || ' in ' || turn || chr(10) || chr(10) || 'Format' || chr(10) || chr(10) || '## Task Inputs' || chr(10) || chr(10) || '<INPUT_CODE name=\"a.h\">' || chr(10) || role || chr(10) || '</INPUT_CODE>' || chr(10) || '<INPUT_CODE name=\"k.cpp\">' || chr(10) || text || chr(10) || '</INPUT_CODE>' || chr(10) || chr(10) || '## Task Output' || chr(10)) AS digest, CASE WHEN turn % 3 = 0 THEN 'fix' WHEN turn % 3 = 1 THEN 'feedback_score' ELSE 'feedback_complexity' END AS template FROM conversations")
def _(t):
    m = F.create_map(F.lit("k.cpp"), F.col("text"), F.lit("a.h"), F.col("role"))
    p = tx.render_prompt(F.lit("Fix $role in $turn"), {"role": F.col("role"), "turn": F.col("turn")}, "Pre", "Format", m)
    k = F.col("turn") % 3
    choice = tx.choose_template(F.when(k == 0, "broken"), F.when(k == 1, "pareto_scores").otherwise("num_functions"))
    return t.conversations.select("conv_id", "turn", F.sha2(p, 256).alias("digest"), choice.alias("template"))


@query("p14_failures", """SELECT event_id, CASE WHEN event_type = 'signup' THEN 'parse' WHEN value < 10 THEN 'compile' WHEN event_type = 'error' THEN 'run' WHEN event_type = 'view' AND value > 40 THEN 'synth_timeout' WHEN event_type = 'view' THEN 'synth' WHEN event_type = 'click' THEN 'optdsl' END AS stage,
    CASE WHEN event_type = 'signup' THEN NULL WHEN value < 10 THEN 'x: error: ' || props WHEN event_type = 'error' AND event_id % 2 = 0 THEN 'empty stderr, exit code 3: segfault or critical error' WHEN event_type = 'error' THEN substr(repeat(props, 200), 1, 1000) WHEN event_type = 'view' AND value > 40 THEN NULL WHEN event_type = 'view' THEN 'ERROR: ' || props WHEN event_type = 'click' THEN 'OptDSL error' END AS detail FROM events""")
def _(t):
    e, v, n = F.col("event_type"), F.col("value"), F.lit("\n")
    f = tx.classify_failure(
        e == "signup", F.when(v < 10, 1).otherwise(0), F.concat(F.lit("note: a\nx: error: "), "props", n, F.lit("warning: b")), F.when(e == "error", 3).otherwise(0), F.when(F.col("event_id") % 2 == 0, "").otherwise(F.repeat("props", 200)),
        F.when(e == "view", 1).otherwise(0), v > 40, F.concat(F.lit("INFO: a\nERROR: "), "props", F.lit("\n ERROR: late")), F.when(e == "click", 1).otherwise(0))
    return t.events.select("event_id", f.alias("f")).select("event_id", "f.stage", "f.detail")


_DIR = """d AS (SELECT p_partkey, p_partkey % 3 AS m, 'f' || p_size AS fn, 'L' || (p_partkey % 7) AS lb FROM part)"""


@query("p15_directives", f"WITH {_DIR} SELECT p_partkey, 2 AS line, CASE m WHEN 0 THEN 'pipeline' WHEN 1 THEN 'unroll' ELSE 'array_partition' END AS kind, fn AS func, CASE WHEN m < 2 THEN lb END AS label, CASE m WHEN 1 THEN 4 WHEN 2 THEN 2 END AS factor, CASE WHEN m = 2 THEN 'cyclic' END AS ptype, CASE WHEN m = 2 THEN 1 END AS dim, CASE WHEN m = 2 THEN 'buf' END AS var FROM d")
def _(t):
    return tx.parse_directives(_directive_text(t), "content", ["p_partkey"]).drop("raw")


def _directive_text(t: Tables) -> DataFrame:
    m, fn, lb = F.col("p_partkey") % 3, F.concat(F.lit("f"), F.col("p_size").cast("string")), F.concat(F.lit("L"), (F.col("p_partkey") % 7).cast("string"))
    line = F.when(m == 0, F.concat(F.lit("set_directive_pipeline "), fn, F.lit("/"), lb)).when(m == 1, F.concat(F.lit("set_directive_unroll -factor 4 "), fn, F.lit("/"), lb)).otherwise(F.concat(F.lit("set_directive_array_partition -type cyclic -factor 2 -dim 1 "), fn, F.lit(" buf")))
    return t.part.select("p_partkey", F.concat(F.lit("# set_directive_pipeline a/b\n\n"), line, F.lit("\nset_top x\n")).alias("content"))


_TURN = "(SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS line, event_type, event_id, value FROM events)"


def _turns(t: Tables) -> DataFrame:
    return t.events.select("user_id", F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")).cast("long").alias("line"), "event_type", "event_id", "value")


@query("p16_source_loops", f"""WITH x AS (SELECT * FROM {_TURN}), b AS (SELECT *, count(*) FILTER (event_type = 'signup') OVER w AS fno, last_value(CASE WHEN event_type = 'signup' THEN 'fn' || event_id END IGNORE NULLS) OVER w AS func,
    count(*) FILTER (event_type = 'click') OVER (PARTITION BY user_id ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS g FROM x WINDOW w AS (PARTITION BY user_id ORDER BY line)),
    c AS (SELECT *, last_value(CASE WHEN event_type = 'view' THEN 'L' || event_id END IGNORE NULLS) OVER (PARTITION BY user_id, func, g ORDER BY line) AS label FROM b)
    SELECT user_id, func, row_number() OVER (PARTITION BY user_id, func ORDER BY line) - 1 AS loop_ordinal, label, 'for (i = 0; i < ' || event_id || '; i++) {{' AS for_text, event_id AS trips, line FROM c WHERE event_type = 'click' AND func IS NOT NULL""".replace("{{", "{"))
def _(t):
    i = F.col("event_id").cast("string")
    text = F.when(F.col("event_type") == "signup", F.concat(F.lit("void fn"), i, F.lit("(int a) {"))).when(F.col("event_type") == "view", F.concat(F.lit(" L"), i, F.lit(":"))).when(F.col("event_type") == "click", F.concat(F.lit("  for (i = 0; i < "), i, F.lit("; i++) {"))).otherwise("#pragma scop")
    df = tx.extract_source_loops(_turns(t).withColumn("text", text), ["user_id"], "line", "text")
    return df.withColumns({"trips": tx.trip_count("for_text").cast("long"), "loop_ordinal": F.col("loop_ordinal").cast("long")})


@query("p17_loops_with_compare", f"""WITH x AS (SELECT * FROM {_TURN}), b AS (SELECT *, last_value(CASE WHEN event_type = 'signup' THEN 'define @f' || event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY line) AS func_define FROM x),
    c AS (SELECT *, min(CASE WHEN event_type = 'view' THEN line END) OVER (PARTITION BY user_id, func_define ORDER BY line ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS compare_line FROM b WHERE func_define IS NOT NULL),
    m AS (SELECT *, row_number() OVER (PARTITION BY user_id, func_define ORDER BY line) - 1 AS loop_ordinal FROM c WHERE event_type = 'click')
    SELECT m.user_id, m.func_define, m.loop_ordinal, 'icmp slt i32 %i, ' || x.event_id AS compare_text, m.line AS cond_line, m.compare_line FROM m JOIN x ON m.user_id = x.user_id AND m.compare_line = x.line""")
def _(t):
    i = F.col("event_id").cast("string")
    text = F.when(F.col("event_type") == "signup", F.concat(F.lit("define @f"), i)).when(F.col("event_type") == "click", F.concat(F.lit("for.cond"), i, F.lit(":"))).when(F.col("event_type") == "view", F.concat(F.lit("  icmp slt i32 %i, "), i)).otherwise("  br")
    return tx.pair_loops_with_compare(_turns(t).withColumn("text", text), ["user_id"]).withColumn("loop_ordinal", F.col("loop_ordinal").cast("long"))


@query("p18_qor_targets", "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(log2(1e7 / greatest(l_extendedprice, 2.220446049250313e-16)), 6) AS perf, round(l_quantity / 274080, 9) AS lut, round((2 * l_linenumber + l_quantity) / 1824, 9) AS bram FROM lineitem")
def _(t):
    got = sc.qor_normalized(F.col("l_extendedprice"), {"syn-LUT": F.col("l_quantity"), "impl-BRAM": 2 * F.col("l_linenumber") + F.col("l_quantity")}, "gnndse")
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", r6(got["perf"]).alias("perf"), F.round(got["syn-LUT"], 9).alias("lut"), F.round(got["impl-BRAM"], 9).alias("bram"))


@query("p18_mapped_targets", """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(log2(1e7 / greatest(CASE WHEN l_linenumber % 3 > 0 THEN l_quantity WHEN l_linenumber % 2 > 0 THEN l_extendedprice ELSE l_partkey END, 2.220446049250313e-16)), 6) AS perf,
    l_quantity / 274080 AS lut, CASE WHEN l_suppkey % 2 = 0 THEN 0 ELSE (2 * l_linenumber + 3) / 1824 END AS bram FROM lineitem""".replace("l_quantity / 274080 AS", "round(l_quantity / 274080, 9) AS").replace("CASE WHEN l_suppkey % 2 = 0 THEN 0 ELSE (2 * l_linenumber + 3) / 1824 END AS", "round(CASE WHEN l_suppkey % 2 = 0 THEN 0 ELSE (2 * l_linenumber + 3) / 1824 END, 9) AS"))
def _(t):
    n, text = F.col("l_linenumber"), lambda c: F.col(c).cast("string")
    row = {
        "synthesis__latency_average_cycles": F.when(n % 3 > 0, text("l_quantity")), "synthesis__latency_worst_cycles": F.when(n % 2 > 0, text("l_extendedprice")), "synthesis__latency_best_cycles": text("l_partkey"),
        "synthesis__resources_lut_used": text("l_quantity"), "implementation__utilization__RAMB36": F.when(F.col("l_suppkey") % 2 == 0, "none").otherwise(text("l_linenumber")),
        "implementation__utilization__RAMB18": F.when(F.col("l_suppkey") % 2 == 0, "").otherwise("3"),
    } | {c: F.lit("0") for c in ("synthesis__resources_ff_used", "synthesis__resources_dsp_used", "synthesis__resources_bram_used", "implementation__utilization__Total LUTs", "implementation__utilization__FFs", "implementation__utilization__DSP Blocks")}
    got = sc.map_qor_targets("gnndse")
    return t.lineitem.withColumns(row).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", r6(got["perf"]).alias("perf"), F.round(got["syn-LUT"], 9).alias("lut"), F.round(got["impl-BRAM"], 9).alias("bram"))


@query("p19_fit_array", "SELECT vec_id, embedding[1]::DOUBLE AS first, embedding[5]::DOUBLE AS fifth, 0.0::DOUBLE AS padded, 3 AS cut, 70 AS n FROM embeddings")
def _(t):
    v = F.col("embedding").cast("array<double>")
    # every vector here is shorter than 70
    return t.embeddings.select("vec_id", sc.first_scalar(v).alias("first"), F.element_at(sc.fit_array(v, 70), 5).alias("fifth"), F.element_at(sc.fit_array(v, 70), 70).alias("padded"), F.size(sc.fit_array(v, 3)).alias("cut"), F.size(sc.fit_array(v, 70)).alias("n"))


@query("p20_split_pair", "SELECT p_partkey, trim(split_part(p_type || ' - ' || p_brand, '-', 1)) AS train, trim(split_part(p_type || ' - ' || p_brand, '-', 2)) AS test FROM part")
def _(t):
    a, b = sc.split_pair_name(F.concat("p_type", F.lit(" - "), "p_brand"))
    return t.part.select("p_partkey", a.alias("train"), b.alias("test"))


# ---- joins ------------------------------------------------------------------------------------------------------


def _finals(t: Tables) -> tuple[DataFrame, DataFrame]:
    final = t.orders.select((F.col("o_orderkey") % 7).alias("grp"), "o_orderkey", F.concat(F.lit("seed_design_"), F.col("o_custkey").cast("string"), F.lit("_iter_"), (F.col("o_orderkey") % 4).cast("string")).alias("name"))
    seed = t.customer.where("c_acctbal > 2000").select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(6).cast("long"))).alias("grp"), F.concat(F.lit("seed_design_"), F.col("c_custkey").cast("string")).alias("name"))
    return final, seed


@query("j1_pair_seed_final", "SELECT o_orderkey, o_orderkey % 7 AS grp, o_custkey::INTEGER AS seed_id, 'seed_design_' || o_custkey AS seed_name FROM orders JOIN customer ON o_custkey = c_custkey AND c_acctbal > 2000 WHERE o_orderkey % 4 = 3")
def _(t):
    final, seed = _finals(t)
    return cg.pair_seed_final(final, seed, ["grp"], "name", 3)[0].select("o_orderkey", "grp", "seed_id", "seed_name")


@query("j1_unpaired_finals", "SELECT o_orderkey FROM orders WHERE o_orderkey % 4 = 3 AND o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 2000)")
def _(t):
    final, seed = _finals(t)
    return cg.pair_seed_final(final, seed, ["grp"], "name", 3)[1].select("o_orderkey")


@query("j3_match_function_names", "WITH x AS (SELECT n_regionkey AS g, n_name AS func, s_name AS ir, contains(s_name, length(n_name) || n_name) AS m, contains('_Z' || s_suppkey || n_name || length(n_name) || n_name, n_name) AS p FROM nation JOIN supplier ON s_nationkey % 5 = n_regionkey), y AS (SELECT g, func, max('_Z' || right(ir, 9) || func) FILTER (p) AS a, count(*) FILTER (p) AS k FROM x GROUP BY g, func) SELECT n_regionkey AS g, n_name AS func, '_Z' || length(n_name) || n_name || 'v' AS matched FROM nation")
def _(t):
    # mangled names: the length tells NATION_1 from NATION_11
    src = t.nation.select(F.col("n_regionkey").alias("g"), F.col("n_name").alias("func"))
    ir = src.select("g", F.concat(F.lit("_Z"), F.length("func").cast("string"), F.col("func"), F.lit("v")).alias("ir_func"))
    return cg.match_function_names(src, ir, ["g"])


ORACLES["j3_match_function_names"] = """WITH i AS (SELECT n_regionkey AS g, '_Z' || length(n_name) || n_name || 'v' AS ir FROM nation),
    x AS (SELECT n_regionkey AS g, n_name AS func, ir, contains(ir, length(n_name) || n_name) AS m, contains(ir, n_name) AS p FROM nation JOIN i ON i.g = n_regionkey),
    y AS (SELECT g, func, CASE WHEN count(*) FILTER (m) = 1 THEN max(ir) FILTER (m) END AS a, CASE WHEN count(*) FILTER (p) = 1 THEN max(ir) FILTER (p) END AS b FROM x GROUP BY g, func)
    SELECT g, func, coalesce(a, b) AS matched FROM y WHERE coalesce(a, b) IS NOT NULL"""


def _loop_tables(t: Tables) -> tuple[DataFrame, ...]:
    """A design per brand; loops are its parts, labelled by part number; directives hang on every second part."""
    p = t.part.withColumn("ordinal", F.row_number().over(Window.partitionBy("p_brand", "p_type").orderBy("p_partkey")) - 1)
    loops = p.select(F.col("p_brand").alias("design_id"), F.col("p_type").alias("func"), F.col("ordinal").alias("loop_ordinal"), F.concat(F.lit("L"), F.col("p_partkey").cast("string")).alias("label"))
    kind = F.when(F.col("p_partkey") % 4 == 0, "pipeline").otherwise("unroll")
    directives = p.where("p_partkey % 2 = 0").select(F.col("p_brand").alias("design_id"), F.col("p_type").alias("func"), F.concat(F.lit("L"), F.col("p_partkey").cast("string")).alias("label"), kind.alias("kind"), F.when(kind == "unroll", F.col("p_size")).alias("factor"), F.col("p_partkey").cast("int").alias("line"))
    ir = p.where("p_partkey % 5 <> 0").select(F.col("p_brand").alias("design_id"), F.concat(F.length("p_type").cast("string"), "p_type").alias("func_define"), F.col("ordinal").alias("loop_ordinal"), F.concat(F.lit("icmp %i, "), F.col("p_size").cast("string")).alias("compare_text"))
    functions = p.select(F.col("p_brand").alias("design_id"), F.col("p_type").alias("func"), F.concat(F.length("p_type").cast("string"), "p_type").alias("matched")).distinct()
    nodes = p.select(F.col("p_brand").alias("design_id"), F.col("p_partkey").cast("string").alias("node_id"), (F.col("p_size") % 5).alias("block"), (F.col("p_size") % 2).alias("function"), F.lit("icmp").alias("text"), F.lit(0).alias("type"), F.concat(F.lit("icmp %i, "), F.col("p_size").cast("string")).alias("full_text"))
    return loops, directives, ir, functions, nodes


_OVERLAY = """n AS (SELECT p_brand AS design_id, p_size, min(p_partkey) AS anchor FROM part GROUP BY ALL), l AS (SELECT p_brand AS design_id, max(p_partkey) AS last FROM part GROUP BY ALL),
    x AS (SELECT p.p_brand AS design_id, p.p_partkey AS line, p.p_size, CASE WHEN p.p_partkey % 4 = 0 THEN 'PIPELINE' ELSE 'PARALLEL' END AS pos, anchor FROM part p JOIN n ON n.design_id = p.p_brand AND n.p_size = p.p_size WHERE p.p_partkey % 2 = 0 AND p.p_partkey % 5 <> 0),
    y AS (SELECT x.*, last + row_number() OVER (PARTITION BY x.design_id ORDER BY line, anchor) AS id FROM x JOIN l ON l.design_id = x.design_id)"""


@query("j2_overlay_loop_directives", f"WITH {_OVERLAY} SELECT design_id, id::VARCHAR AS node_id, pos AS text, 3 AS type, CASE WHEN pos = 'PARALLEL' THEN pos || ' factor=' || p_size ELSE pos END AS full_text FROM y")
def _(t):
    return cg.overlay_loop_directives(*_loop_tables(t))[0].drop("block", "function")


@query("j2_directive_edges", f"WITH {_OVERLAY}, z AS (SELECT design_id, anchor::VARCHAR AS src, id::VARCHAR AS dst, 3 AS flow, CASE WHEN pos = 'PIPELINE' THEN 0 ELSE 1 END AS position FROM y) SELECT * FROM z UNION ALL SELECT design_id, dst, src, flow, position FROM z")
def _(t):
    return cg.overlay_loop_directives(*_loop_tables(t))[1]


@query("j4_anchor_array_directives", """WITH d AS (SELECT p_brand AS design_id, p_size AS line, any_value('v' || p_size) AS var FROM part GROUP BY ALL),
    b AS (SELECT p_brand AS design_id, p_size % 5 AS block, p_size % 2 AS function, 1000000 + min(p_size) AS node FROM part WHERE p_size % 5 <> 3 GROUP BY ALL), lo AS (SELECT design_id, min(node) AS lo FROM b GROUP BY design_id),
    e AS (SELECT d.design_id, line, p_partkey AS id, p_size % 5 AS block, p_size % 2 AS function FROM d JOIN part ON p_brand = d.design_id AND var = 'v' || p_size AND p_type IN ('SMALL', 'ECONOMY')),
    f AS (SELECT d.design_id, line, p_partkey AS id, p_size % 5 AS block, p_size % 2 AS function, row_number() OVER (PARTITION BY d.design_id, line ORDER BY p_type NOT IN ('SMALL', 'ECONOMY'), p_partkey) AS k
      FROM d JOIN part ON p_brand = d.design_id AND contains('load v' || p_size || ' x', var) AND p_partkey <> 0 WHERE NOT EXISTS (SELECT 1 FROM e WHERE e.design_id = d.design_id AND e.line = d.line)),
    u AS (SELECT design_id, line, id, block, function FROM e UNION ALL SELECT design_id, line, id, block, function FROM f WHERE k <= 16)
    SELECT DISTINCT u.design_id, line, coalesce(node, lo, id) AS anchor FROM u LEFT JOIN b ON b.design_id = u.design_id AND b.block = u.block AND b.function = u.function LEFT JOIN lo ON lo.design_id = u.design_id""")
def _(t):
    p = t.part
    design = F.col("p_brand").alias("design_id")
    directives = p.groupBy("p_brand", "p_size").agg(F.count("*")).select(design, F.col("p_size").alias("line"), F.lit("array_partition").alias("kind"), F.concat(F.lit("v"), F.col("p_size").cast("string")).alias("var"))
    v = F.concat(F.lit("v"), F.col("p_size").cast("string"))
    nodes = p.select(design, F.col("p_partkey").cast("string").alias("node_id"), (F.col("p_size") % 5).alias("block"), (F.col("p_size") % 2).alias("function"), v.alias("text"), F.when(F.col("p_type").isin("SMALL", "ECONOMY"), 1).otherwise(0).alias("type"), F.concat(F.lit("load "), v, F.lit(" x")).alias("full_text"))
    blocks = p.where("p_size % 5 <> 3").groupBy(design, (F.col("p_size") % 5).alias("block"), (F.col("p_size") % 2).alias("function")).agg((F.min("p_size") + 1000000).cast("string").alias("node_id"))
    blocks = blocks.select("design_id", "node_id", "block", "function", F.lit("pseudo_block").alias("text"), F.lit(4).alias("type"), F.lit("block").alias("full_text"))
    return cg.anchor_array_directives(directives, nodes.unionByName(blocks))


@query("j5_graphs_with_labels", "SELECT o_orderkey, l_linenumber, l_partkey, l_suppkey, coalesce(nullif(trim(CASE WHEN o_orderstatus = 'F' THEN ' ' ELSE o_orderpriority END), ''), o_orderkey::VARCHAR) AS gname FROM orders JOIN lineitem ON l_orderkey = o_orderkey")
def _(t):
    labels = t.orders.select(F.col("o_orderkey").alias("design_id"), F.when(F.col("o_orderstatus") == "F", " ").otherwise(F.col("o_orderpriority")).alias("name"))
    graphs = t.lineitem.select(F.col("l_orderkey").alias("design_id"), "l_linenumber", "l_partkey", "l_suppkey")
    return cg.join_graphs_with_labels(graphs, labels, name="name")[0].select(F.col("design_id").alias("o_orderkey"), "l_linenumber", "l_partkey", "l_suppkey", "gname")


@query("j5_labels_without_graph", "SELECT count(*) AS num_skipped FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def _(t):
    return cg.join_graphs_with_labels(t.orders.select(F.col("o_custkey").alias("design_id")), t.customer.select(F.col("c_custkey").alias("design_id")))[1]


@query("j6_available_members", "SELECT DISTINCT p_brand FROM part WHERE p_size < 10")
def _(t):
    return cg.missing_members(t.part.where("p_size < 10").select("p_brand"), t.part.select("p_brand"), "p_brand")


@query("j7_eval_combos", "SELECT p_brand, p_type FROM (SELECT DISTINCT p_brand FROM part), (SELECT DISTINCT p_type FROM part)")
def _(t):
    return cg.eval_combos(t.part, t.part, "p_brand", "p_type")


_NEST = f"""x AS (SELECT user_id, line, CASE WHEN event_type IN ('view', 'signup') THEN 1 WHEN event_type IN ('click', 'error') THEN -1 END AS s FROM {_TURN}), d AS (SELECT *, sum(s) OVER (PARTITION BY user_id ORDER BY line) + CASE WHEN s = -1 THEN 1 ELSE 0 END AS depth FROM x WHERE s IS NOT NULL),
    e AS (SELECT *, min(CASE WHEN s = -1 THEN line END) OVER (PARTITION BY user_id, depth ORDER BY line ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS "end" FROM d), o AS (SELECT user_id, line AS start, "end", depth FROM e WHERE s = 1 AND "end" IS NOT NULL),
    q AS (SELECT o.*, (SELECT max(u.start) FROM o u WHERE u.user_id = o.user_id AND u.depth = o.depth - 1 AND u.start < o.start AND u."end" > o."end") AS parent_start FROM o)"""


def _nest(t: Tables) -> DataFrame:
    e = F.col("event_type")
    return cg.nest_loops(_turns(t), ["user_id"], "line", e.isin("view", "signup"), e.isin("click", "error"))


@query("j8_nest_loops", f"WITH {_NEST} SELECT user_id, start, \"end\", depth::BIGINT AS depth, parent_start, row_number() OVER (PARTITION BY user_id, parent_start ORDER BY start) - 1 AS child_no FROM q")
def _(t):
    return _nest(t).withColumn("child_no", F.col("child_no").cast("long"))


# ---- roll-ups and trajectories ----------------------------------------------------------------------------------


@query("a5_rollup_summary", f"""WITH {_ITER}, c AS (SELECT c_mktsegment AS seg, c_custkey AS seed, c_acctbal > 3000 AS ok FROM customer), o AS (SELECT o_custkey AS seed, count(*) AS n FROM orders GROUP BY 1)
    SELECT seg, count(*) AS num_generated_seed_designs, count(*) FILTER (ok) AS num_passing_seed_designs, count(*) AS num_entries, coalesce(sum(n), 0)::BIGINT AS num_iters FROM c LEFT JOIN o ON o.seed = c.seed GROUP BY seg""")
def _(t):
    seeds = t.customer.select(F.col("c_mktsegment").alias("seg"), F.col("c_custkey").alias("seed"), F.when(F.col("c_acctbal") > 3000, "Pass").otherwise("pass").alias("status"))
    nth = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")) - 1
    iters = t.orders.select(F.col("o_custkey").alias("seed"), nth.alias("it"), F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("target")).join(seeds.select("seg", "seed"), "seed")
    got = tj.rollup_summary(seeds, iters, ["seg"], "seed", "it", "status", "target")
    m = F.map_values("eval_data_by_seed")
    return got.select("seg", "num_generated_seed_designs", "num_passing_seed_designs", F.size(m).cast("long").alias("num_entries"), F.aggregate(m, F.lit(0), lambda a, x: a + F.when(x["iters"].isNull(), 0).otherwise(F.size(x["iters"]))).cast("long").alias("num_iters"))


@query("a15_trajectory_means", f"WITH i AS (SELECT o_custkey, o_totalprice AS v, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) - 1 AS pos FROM orders) SELECT c_mktsegment AS target, pos, round(avg(v) + 3.14159e-8, 6) AS mean_value, count(v) AS num_values FROM i JOIN customer ON o_custkey = c_custkey WHERE pos < 10 GROUP BY ALL")
def _(t):
    nth = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")) - 1
    long = t.orders.withColumn("pos", nth.cast("long")).join(t.customer, F.col("o_custkey") == F.col("c_custkey")).select(F.col("c_mktsegment").alias("target"), "pos", "o_totalprice")
    return tj.trajectory_means(long, ["target"], "pos", "o_totalprice").withColumn("mean_value", r6(F.col("mean_value") + 3.14159e-8))  # means often lie midway between six-digit numbers; off there they round alike


@query("a15_active_segments", f"WITH {_ITER} SELECT grp, seed, it AS segment, target = 'F' AS active FROM i")
def _(t):
    return tj.active_segments(_iters(t).withColumn("it", F.col("it").cast("long")), ["grp", "seed"], "it", "target", "F")


@query("a16_merge_runs", """WITH s AS (SELECT 'run' || (o_orderkey % 5) AS run, o_orderpriority AS dom, o_orderstatus AS model, 'T:' || (o_custkey % 3) AS plan, o_custkey AS seed FROM orders),
    g AS (SELECT model, plan, list(DISTINCT run ORDER BY run) AS runs, count(DISTINCT run || ':' || dom || ':' || seed) AS num_seeds FROM s GROUP BY ALL)
    SELECT model, plan, num_seeds, CASE WHEN len(runs) <= 3 THEN array_to_string(runs, ' + ') ELSE runs[1] || ' + ' || (len(runs) - 1) || ' more' END AS label FROM g""")
def _(t):
    df = t.orders.select(F.concat(F.lit("run"), (F.col("o_orderkey") % 5).cast("string")).alias("run"), F.col("o_orderpriority").alias("dom"), F.col("o_orderstatus").alias("model"), F.create_map(F.lit("T"), F.concat((F.col("o_custkey") % 3).cast("string"), F.lit(" iteration(s)"))).alias("targets"), F.col("o_custkey").alias("seed"))
    got = tj.merge_runs(df, "run", "dom", "model", "targets", "seed", by_domain=False)
    return got.select("model", F.array_join(F.transform("target_plan", lambda e: F.concat_ws(":", e["key"], e["value"].cast("string"))), ",").alias("plan"), F.size("seeds").cast("long").alias("num_seeds"), "label")


# ---- distributions ----------------------------------------------------------------------------------------------


@query("a6_metric_summary", """WITH l AS (SELECT l_returnflag AS stage, 'l_quantity' AS metric, l_quantity AS v FROM lineitem WHERE l_linestatus = 'F' UNION ALL SELECT l_returnflag, 'l_discount', CASE WHEN l_discount > 0 THEN l_discount END FROM lineitem WHERE l_linestatus = 'F')
    SELECT metric, stage, count(v) AS n, count(*) - count(v) AS missing, min(v) AS min, max(v) AS max, count(v) < 2 OR max(v) - min(v) <= 1e-9 * max(v) AS degenerate FROM l GROUP BY ALL""")
def _(t):
    df = t.lineitem.withColumnRenamed("l_returnflag", "stage")
    return pf.metric_summary(df, "stage", ["l_quantity", "l_discount"], F.col("l_linestatus") == "F", ("l_discount",))


@query("a7_metric_density", """WITH s AS (SELECT l_returnflag AS g, count(*) AS n, stddev_samp(l_quantity) * pow(count(*), -0.2) AS h, min(l_quantity) AS lo, max(l_quantity) AS hi FROM lineitem GROUP BY 1),
    x AS (SELECT g, n, h, k, lo + (hi - lo) * k / 199 AS x FROM s, range(200) r(k)), c AS (SELECT l_returnflag AS g, l_quantity AS v, count(*) AS m FROM lineitem GROUP BY ALL)
    SELECT x.g AS l_returnflag, round(x, 6) AS x, round(sum(m * exp(-((x - v) / h) * ((x - v) / h) / 2) / (h * n * sqrt(2 * pi()))), 6) AS density FROM x JOIN c ON c.g = x.g GROUP BY x.g, x""")
def _(t):
    return pf.metric_density(t.lineitem, ["l_returnflag"], "l_quantity").select("l_returnflag", r6("x").alias("x"), r6("density").alias("density"))


_PROBS = (0.1, 0.25, 0.5, 0.75, 0.9, 0.99, 0.99999)


@query("a8_mquantiles", f"""WITH r AS (SELECT c_mktsegment AS g, c_acctbal AS v, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal) AS k, count(*) OVER (PARTITION BY c_mktsegment) AS n FROM customer),
    a AS (SELECT DISTINCT g, n, p, n * p + 0.4 + 0.2 * p AS a FROM r, (SELECT unnest({list(_PROBS)}::DOUBLE[]) AS p)), b AS (SELECT *, floor(greatest(1, least(a, n - 1)))::BIGINT AS k FROM a), c AS (SELECT *, least(1, greatest(0, a - k)) AS w FROM b)
    SELECT c.g AS c_mktsegment, p AS prob, round((1 - w) * lo.v + w * coalesce(hi.v, lo.v), 6) AS quantile FROM c JOIN r lo ON lo.g = c.g AND lo.k = c.k LEFT JOIN r hi ON hi.g = c.g AND hi.k = c.k + 1""")
def _(t):
    return pf.mquantiles(t.customer, ["c_mktsegment"], "c_acctbal", _PROBS).withColumn("quantile", r6("quantile"))


@query("a9_describe_stats", "SELECT l_returnflag, l_linestatus, count(l_tax) AS count, round(avg(l_tax), 6) AS mean, round(stddev_pop(l_tax), 6) AS std, min(l_tax) AS min, max(l_tax) AS max FROM lineitem GROUP BY ALL")
def _(t):
    return pf.describe_stats(t.lineitem, ["l_returnflag", "l_linestatus"], "l_tax").withColumns({c: r6(c) for c in ("mean", "std")})


@query("d6_pool_seed_final", "SELECT p_partkey, p_brand, CASE WHEN p_size < 25 THEN 'seed' ELSE 'final' END AS stage FROM part")
def _(t):
    p = t.part.select("p_partkey", "p_brand", "p_size")
    return pf.pool_seed_final(p.where("p_size < 25").drop("p_size"), p.where("p_size >= 25").drop("p_size"))


def _vectors(t: Tables) -> DataFrame:
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", F.when(F.col("l_discount") > 0.01, F.col("l_discount")).alias("l_discount"), F.when(F.col("l_tax") > 0.01, F.col("l_tax")).alias("l_tax"))


@query("f7_complete_vectors", "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity FROM lineitem WHERE l_discount > 0.01 AND l_tax > 0.01")
def _(t):
    return pf.complete_vectors(_vectors(t), ["l_quantity", "l_discount", "l_tax"])[0].select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity")


@query("f7_missing_names", "SELECT CASE WHEN NOT l_discount > 0.01 AND NOT l_tax > 0.01 THEN 'l_discount,l_tax' WHEN NOT l_tax > 0.01 THEN 'l_tax' ELSE 'l_discount' END AS missing, count(*) AS n FROM lineitem WHERE NOT (l_discount > 0.01 AND l_tax > 0.01) GROUP BY 1")
def _(t):
    return pf.complete_vectors(_vectors(t), ["l_quantity", "l_discount", "l_tax"])[1].groupBy(F.array_join("missing", ",").alias("missing")).agg(F.count("*").alias("n"))


_SKEWED = "pow(l_quantity, 3)"


@query("f8_scale_metrics", f"""WITH a AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, exp(l_quantity / 10) AS x, l_extendedprice AS y FROM lineitem), s AS (SELECT skewness(x) > 1 AND min(x) >= 0 AS lx, skewness(y) > 1 AND min(y) >= 0 AS ly FROM a),
    b AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN lx THEN ln(1 + x) ELSE x END AS x, CASE WHEN ly THEN ln(1 + y) ELSE y END AS y FROM a, s), m AS (SELECT avg(x) AS mx, stddev_pop(x) AS sx, avg(y) AS my, stddev_pop(y) AS sy FROM b)
    SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round((x - mx) / sx, 5) AS x, round((y - my) / sy, 5) AS y FROM b, m""")
def _(t):
    df = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.exp(F.col("l_quantity") / 10).alias("x"), F.col("l_extendedprice").alias("y"))
    return pf.scale_metrics(df, ["x", "y"]).withColumns({c: F.round(c, 5) for c in "xy"})


@query("f9_pca_shares", None)
def _(t):
    df, shares = pf.pca_project(pf.scale_metrics(t.lineitem, ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]), ["l_quantity", "l_extendedprice", "l_discount", "l_tax"])
    return df.groupBy("l_returnflag").agg(F.count("*").alias("n"), F.round(F.avg("pc1"), 4).alias("pc1"), F.lit(round(shares[0], 4)).alias("share1"), F.lit(round(shares[1], 4)).alias("share2"))


# the roots of a cubic with three real ones, by the cosine of a third of an angle
@query("f9_pca_three_shares", """WITH v AS (SELECT l_quantity AS x, 500 * l_tax + l_quantity / 3 AS y, 300 * l_discount - l_quantity / 2 AS z FROM lineitem),
    m AS (SELECT var_pop(x) AS a, var_pop(y) AS b, var_pop(z) AS c, covar_pop(x, y) AS d, covar_pop(x, z) AS e, covar_pop(y, z) AS f FROM v),
    q AS (SELECT *, (a + b + c) / 3 AS q FROM m), p AS (SELECT *, sqrt((pow(a - q, 2) + pow(b - q, 2) + pow(c - q, 2) + 2 * (d * d + e * e + f * f)) / 6) AS p FROM q),
    r AS (SELECT *, acos(((a - q) * ((b - q) * (c - q) - f * f) - d * (d * (c - q) - e * f) + e * (d * f - e * (b - q))) / (2 * p * p * p)) / 3 AS r FROM p),
    s AS (SELECT 3 * q AS t, q + 2 * p * cos(r) AS one, q + 2 * p * cos(r + 2 * pi() / 3) AS three FROM r)
    SELECT round(one / t, 6) AS share1, round((t - one - three) / t, 6) AS share2, round(three / t, 6) AS share3 FROM s""")
def _(t):
    x = F.col("l_quantity")
    df, shares = pf.pca_project(t.lineitem.select(x.alias("x"), (500 * F.col("l_tax") + x / 3).alias("y"), (300 * F.col("l_discount") - x / 2).alias("z")), ["x", "y", "z"], 3)
    # the same shares from the projected rows
    total = sum(F.var_pop(f"pc{i}") for i in (1, 2, 3))
    assert abs(sum(shares) - 1) < 1e-9
    return df.agg(*[F.round(F.var_pop(f"pc{i}") / total, 6).alias(f"share{i}") for i in (1, 2, 3)])


@query("f9_pca_two_metrics", """WITH a AS (SELECT l_returnflag, l_quantity AS x, 500 * l_tax AS y FROM lineitem), m AS (SELECT avg(x) AS mx, avg(y) AS my, var_pop(x) AS a, var_pop(y) AS c, covar_pop(x, y) AS b FROM a),
    e AS (SELECT *, (a + c + sqrt((a - c) * (a - c) + 4 * b * b)) / 2 AS l FROM m), w AS (SELECT *, b / sqrt(b * b + (l - a) * (l - a)) AS u, (l - a) / sqrt(b * b + (l - a) * (l - a)) AS v FROM e),
    s AS (SELECT *, CASE WHEN abs(u) >= abs(v) THEN sign(u) ELSE sign(v) END AS g FROM w)
    SELECT l_returnflag, count(*) AS n, round(avg(g * (u * (x - mx) + v * (y - my))), 4) AS pc1, round(any_value(l / (a + c)), 6) AS share1, round(any_value(1 - l / (a + c)), 6) AS share2 FROM a, s GROUP BY l_returnflag""")
def _(t):
    df = t.lineitem.select("l_returnflag", F.col("l_quantity").alias("x"), (500 * F.col("l_tax")).alias("y"))
    df, shares = pf.pca_project(df, ["x", "y"])
    return df.groupBy("l_returnflag").agg(F.count("*").alias("n"), F.round(F.avg("pc1"), 4).alias("pc1"), F.lit(round(shares[0], 6)).alias("share1"), F.lit(round(shares[1], 6)).alias("share2"))


@query("f10_group_hulls", """WITH p AS (SELECT DISTINCT p_brand, p_size::DOUBLE AS x, p_retailprice::DOUBLE AS y FROM part),
    e AS (SELECT a.p_brand, a.x, a.y, b.x AS bx, b.y AS \"by\", (b.x - a.x) * (c.y - a.y) - (b.y - a.y) * (c.x - a.x) AS turn, (b.x - a.x) * (c.x - a.x) + (b.y - a.y) * (c.y - a.y) AS along FROM p a JOIN p b ON b.p_brand = a.p_brand AND (b.x <> a.x OR b.y <> a.y) JOIN p c ON c.p_brand = a.p_brand),
    g AS (SELECT p_brand, x, y, bx, \"by\" FROM e GROUP BY ALL HAVING bool_and(turn > 0 OR (turn = 0 AND along >= 0))), v AS (SELECT DISTINCT p_brand, x, y FROM g),
    k AS (SELECT *, count(*) OVER q AS n, atan2(y - avg(y) OVER q, x - avg(x) OVER q) AS angle FROM v WINDOW q AS (PARTITION BY p_brand)),
    f AS (SELECT *, first(angle) OVER (PARTITION BY p_brand ORDER BY x, y) AS start FROM k WHERE n >= 3)
    SELECT p_brand, (row_number() OVER (PARTITION BY p_brand ORDER BY CASE WHEN angle >= start THEN angle - start ELSE angle - start + 2 * pi() END) - 1)::INTEGER AS vertex, x, y FROM f""")
def _(t):
    return pf.group_hulls(t.part, "p_brand", "p_size", "p_retailprice")


# ---- selection --------------------------------------------------------------------------------------------------

_FRONT = "f AS (SELECT l_suppkey, l_quantity AS x, l_extendedprice AS y FROM (SELECT *, min(l_extendedprice) OVER (PARTITION BY l_suppkey ORDER BY l_quantity, l_extendedprice DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM lineitem) WHERE m IS NULL OR l_extendedprice < m)"


@query("w4_pareto_frontier", f"WITH {_FRONT} SELECT l_suppkey, x AS l_quantity, y AS l_extendedprice FROM f")
def _(t):
    return sl.pareto_frontier(t.lineitem.select("l_suppkey", "l_quantity", "l_extendedprice"), "l_quantity", "l_extendedprice", ["l_suppkey"])


@query("w4_global_frontier", "SELECT l_quantity, l_extendedprice FROM (SELECT *, min(l_extendedprice) OVER (ORDER BY l_quantity, l_extendedprice DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM lineitem) WHERE m IS NULL OR l_extendedprice < m")
def _(t):
    return sl.pareto_frontier(t.lineitem.select("l_quantity", "l_extendedprice"), "l_quantity", "l_extendedprice")


@query("a17_pareto_score", f"""WITH {_FRONT}, g AS (SELECT l_suppkey, count(*) AS n_points, min(l_quantity) AS lx, max(l_quantity) AS hx, min(l_extendedprice) AS ly, max(l_extendedprice) AS hy FROM lineitem GROUP BY 1),
    s AS (SELECT f.l_suppkey, x, y, (x - lx) / nullif(hx - lx, 0) AS a, (y - ly) / nullif(hy - ly, 0) AS b FROM f JOIN g ON g.l_suppkey = f.l_suppkey), h AS (SELECT *, sqrt(pow(lead(a) OVER w - a, 2) + pow(lead(b) OVER w - b, 2)) AS gap FROM s WINDOW w AS (PARTITION BY l_suppkey ORDER BY x, y DESC)),
    k AS (SELECT l_suppkey, count(*) AS n_frontier, min(sqrt(a * a + (b - 1) * (b - 1))) AS dl, min(sqrt((a - 1) * (a - 1) + b * b)) AS dr, max(gap) AS mg, sum(gap) AS ln FROM h GROUP BY 1)
    SELECT k.l_suppkey, n_points, n_frontier, round(dl, 6) AS d_left, round(dr, 6) AS d_right, round(CASE WHEN n_frontier >= 3 THEN (dl + dr + mg) / (dl + dr + ln) END, 6) AS score, round(CASE WHEN n_frontier >= 3 AND ln > 0 THEN mg / ln END, 6) AS gap_ratio FROM k JOIN g ON g.l_suppkey = k.l_suppkey""")
def _(t):
    got = sl.pareto_score(t.lineitem.select("l_suppkey", "l_quantity", "l_extendedprice"), "l_quantity", "l_extendedprice", ["l_suppkey"])
    return got.select("l_suppkey", "n_points", "n_frontier", *[r6(c).alias(c) for c in ("d_left", "d_right", "score", "gap_ratio")])


@query("t1_rank_candidates", "SELECT l_partkey, l_suppkey, round(sum(l_discount), 6) AS score FROM lineitem GROUP BY ALL ORDER BY round(sum(l_discount), 6), l_partkey, l_suppkey LIMIT 50")
def _(t):
    return sl.rank_candidates(t.lineitem, ["l_partkey", "l_suppkey"], "l_discount", digits=6)


_PASSING = "l_returnflag = 'A'"


@query("t2_best_sample", f"SELECT l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey, l_linenumber ORDER BY l_quantity DESC, l_extendedprice DESC, l_orderkey) AS k FROM lineitem WHERE {_PASSING}) WHERE k = 1")
def _(t):
    df = t.lineitem.withColumn("status", F.when(F.col("l_returnflag") == "A", "PASS").otherwise("fail"))
    return sl.best_sample(df, ["l_suppkey", "l_linenumber"], "l_quantity", "l_extendedprice", "l_orderkey").select("l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_orderkey")


@query("t2_best_until_none_passes", f"""WITH b AS (SELECT l_suppkey, l_linenumber - 1 AS it, l_quantity, l_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey, l_linenumber ORDER BY l_quantity DESC, l_extendedprice DESC, l_orderkey) AS k FROM lineitem WHERE {_PASSING} AND l_quantity > 40) WHERE k = 1)
    SELECT l_suppkey, it::INTEGER AS it, l_quantity, l_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY it) - 1 AS n FROM b) WHERE n = it""")
def _(t):
    df = t.lineitem.withColumn("status", F.when((F.col("l_returnflag") == "A") & (F.col("l_quantity") > 40), "PASS").otherwise("fail")).withColumn("it", (F.col("l_linenumber") - 1).cast("int"))
    best = sl.best_sample(df, ["l_suppkey", "it"], "l_quantity", "l_extendedprice", "l_orderkey")
    return pr.contiguous_prefix(best, ["l_suppkey"], "it").select("l_suppkey", "it", "l_quantity", "l_orderkey")


@query("t3_best_by_pareto", "SELECT p_brand, p_partkey, round(s, 6) AS pareto_sum FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY s, p_partkey) AS k FROM (SELECT *, CASE WHEN p_size % 3 = 0 THEN 1.0 ELSE p_size / 50 END + CASE WHEN p_size % 4 = 0 THEN 1.0 ELSE (p_partkey % 10) / 10 END AS s FROM part WHERE p_type <> 'SMALL')) WHERE k = 1")
def _(t):
    df = t.part.select("p_brand", "p_partkey", F.when(F.col("p_type") != "SMALL", "pass").alias("status"), F.when(F.col("p_size") % 3 != 0, F.col("p_size") / 50).alias("lut"), F.when(F.col("p_size") % 4 != 0, (F.col("p_partkey") % 10) / 10).alias("ff"))
    return sl.best_by_pareto(df, ["p_brand"], ["lut", "ff"], "p_partkey").select("p_brand", "p_partkey", r6("pareto_sum").alias("pareto_sum"))


@query("w5_loss_curve", f"WITH x AS (SELECT * FROM {_TURN}) SELECT user_id, line, coalesce(value < min(value) OVER (PARTITION BY user_id ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS improved, (SELECT min(y.line) FROM x y WHERE y.user_id = x.user_id AND y.value = (SELECT min(z.value) FROM x z WHERE z.user_id = x.user_id)) AS best_epoch FROM x")
def _(t):
    return sl.loss_curve(_turns(t), ["user_id"], "line", "value").select("user_id", "line", "improved", "best_epoch")


@query("w5_stop_epoch", """WITH x AS (SELECT user_id, event_type AS split, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS epoch, floor(value / 40) AS loss FROM events WHERE event_type IN ('view', 'click')),
    f AS (SELECT *, min(loss) OVER w = max(loss) OVER w AND epoch > 3 AS flat FROM x WINDOW w AS (PARTITION BY user_id, split ORDER BY epoch ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)), b AS (SELECT user_id, epoch, count(*) FILTER (flat) = 2 AS flat FROM f GROUP BY ALL)
    SELECT user_id, min(epoch) FILTER (flat) AS stop_epoch FROM b GROUP BY user_id""")
def _(t):
    df = t.events.select("user_id", F.col("event_type").alias("split"), F.row_number().over(Window.partitionBy("user_id", "event_type").orderBy("ts", "event_id")).cast("long").alias("epoch"), F.floor(F.col("value") / 40).alias("loss"))
    return sl.stop_epoch(df, ["user_id"], patience=3, splits=("view", "click"))


@query("w6_unique_names", "SELECT p_partkey, p_name || CASE WHEN k = 0 THEN '' ELSE '_' || k END AS unique_name FROM (SELECT *, row_number() OVER (PARTITION BY p_brand, p_name ORDER BY p_partkey) - 1 AS k FROM part)")
def _(t):
    return sl.unique_names(t.part, ["p_brand"], "p_name", ["p_partkey"]).select("p_partkey", "unique_name")


# ---- reports ----------------------------------------------------------------------------------------------------

_PRED = "(SELECT l_linestatus AS target, l_extendedprice AS y, 1000 * l_quantity AS p FROM lineitem)"


def _pred(t: Tables) -> DataFrame:
    return t.lineitem.select(F.col("l_linestatus").alias("target"), F.col("l_extendedprice").alias("y_true"), (1000 * F.col("l_quantity")).alias("y_pred"))


@query("a10_regression_report", """WITH c AS (SELECT c_mktsegment AS target, c_acctbal + 2000 AS y, (c_custkey * 7919) % 101 * 50.0 AS p, row_number() OVER (ORDER BY c_custkey) AS k FROM customer),
    m AS (SELECT a.target, sum(sign(a.y - b.y) * sign(a.p - b.p)) / sqrt(count(*) FILTER (a.y <> b.y) * count(*) FILTER (a.p <> b.p)::DOUBLE) AS tau FROM c a JOIN c b ON a.target = b.target AND a.k < b.k GROUP BY 1),
    r AS (SELECT target, avg(abs(y - p) / greatest(abs(y), 2.220446049250313e-16)) AS mape, sqrt(avg((y - p) * (y - p))) AS rmse, avg((y - p) * (y - p)) AS mse, avg(abs(y - p)) AS mae, max(abs(y - p)) AS max_error FROM c GROUP BY target),
    a AS (SELECT r.*, tau FROM r JOIN m ON m.target = r.target UNION ALL SELECT 'tot/avg', sum(mape), sum(rmse), sum(mse), sum(mae), sum(max_error), avg(tau) FROM r JOIN m ON m.target = r.target)
    SELECT target, round(mape, 6) AS mape, round(rmse, 4) AS rmse, round(mse, 2) AS mse, round(mae, 4) AS mae, round(max_error, 4) AS max_error, round(tau, 6) AS tau FROM a""")
def _(t):
    pred = t.customer.select(F.col("c_mktsegment").alias("target"), (F.col("c_acctbal") + 2000).alias("y_true"), (F.col("c_custkey") * 7919 % 101 * 50.0).alias("y_pred"))
    got = er.regression_report(pred, tau=er.kendall_tau(pred, "target", "y_true", "y_pred"))
    return got.select("target", r6("mape").alias("mape"), *[F.round(c, 4).alias(c) for c in ("rmse", "mae", "max_error")], F.round("mse", 2).alias("mse"), r6("tau").alias("tau"))


@query("a11_kendall_tau", """WITH c AS (SELECT c_mktsegment AS g, floor(c_acctbal / 50) AS x, (c_custkey * 7919) % 101 AS y, row_number() OVER (ORDER BY c_custkey) AS k FROM customer),
    p AS (SELECT a.g, sign(a.x - b.x) * sign(a.y - b.y) AS s, a.x = b.x AS tx, a.y = b.y AS ty FROM c a JOIN c b ON a.g = b.g AND a.k < b.k)
    SELECT g AS c_mktsegment, round(sum(s) / sqrt(count(*) FILTER (NOT tx) * count(*) FILTER (NOT ty)::DOUBLE), 6) AS tau FROM p GROUP BY g""")
def _(t):
    df = t.customer.select("c_mktsegment", F.floor(F.col("c_acctbal") / 50).alias("x"), (F.col("c_custkey") * 7919 % 101).alias("y"))
    return er.kendall_tau(df, "c_mktsegment", "x", "y").withColumn("tau", r6("tau"))


@query("a12_inference_loss", f"WITH s AS (SELECT target, sum((y - p) * (y - p)) AS se, count(*) AS n FROM {_PRED} GROUP BY 1) SELECT round(sum(se) / sum(n) * count(*), 2) AS loss, round(sum(ln(se / n + 2.220446049250313e-16)), 6) AS log_loss FROM s")
def _(t):
    a, b = er.inference_loss(_pred(t)), er.inference_loss(_pred(t), "logmse")
    return a.select(F.round("loss", 2).alias("loss")).crossJoin(b.select(r6("loss").alias("log_loss")))


@query("a13_classification_report", """WITH m AS (SELECT count(*) FILTER (quality = 0 AND toxic = 0) AS a, count(*) FILTER (quality = 0 AND toxic = 1) AS b, count(*) FILTER (quality = 1 AND toxic = 0) AS c, count(*) FILTER (quality = 1 AND toxic = 1) AS d FROM labels),
    s AS (SELECT *, coalesce(a / nullif(a + c, 0), 0) AS p0, coalesce(a / nullif(a + b, 0), 0) AS r0, coalesce(d / nullif(b + d, 0), 0) AS p1, coalesce(d / nullif(c + d, 0), 0) AS r1 FROM m),
    f AS (SELECT *, coalesce(2 * p0 * r0 / nullif(p0 + r0, 0), 0) AS f0, coalesce(2 * p1 * r1 / nullif(p1 + r1, 0), 0) AS f1, a + b AS n0, c + d AS n1, a + b + c + d AS n, (a + d) / (a + b + c + d) AS acc FROM s),
    x AS (SELECT 'invalid' AS class, p0 AS precision, r0 AS recall, f0 AS f1, n0 AS support FROM f UNION ALL SELECT 'valid', p1, r1, f1, n1 FROM f UNION ALL SELECT 'accuracy', acc, acc, acc, n FROM f
    UNION ALL SELECT 'macro avg', (p0 + p1) / 2, (r0 + r1) / 2, (f0 + f1) / 2, n FROM f UNION ALL SELECT 'weighted avg', (p0 * n0 + p1 * n1) / n, (r0 * n0 + r1 * n1) / n, (f0 * n0 + f1 * n1) / n, n FROM f)
    SELECT class, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, support FROM x""")
def _(t):
    return er.classification_report(t.labels, "quality", "toxic").withColumns({c: r6(c) for c in ("precision", "recall", "f1")})


@query("a13_confusion_matrix", "SELECT quality AS label, count(*) FILTER (toxic = 0) AS pred_0, count(*) FILTER (toxic = 1) AS pred_1 FROM labels GROUP BY 1")
def _(t):
    return er.confusion_matrix(t.labels, "quality", "toxic")


@query("a14_region_means", "WITH o AS (SELECT p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS pos, p_retailprice FROM part) SELECT CASE WHEN pos < 5.5 THEN 0 WHEN pos < 20.5 THEN 1 ELSE 2 END AS region, round(avg(p_retailprice), 2) AS p_retailprice FROM o GROUP BY 1")
def _(t):
    order = t.part.select(F.col("p_partkey").cast("string").alias("pair"), F.row_number().over(Window.partitionBy("p_brand").orderBy("p_partkey")).alias("pos"))
    results = t.part.select(F.col("p_partkey").cast("string").alias("pair"), "p_retailprice")
    regions = t.spark.createDataFrame([(0, -0.5, 5.5), (1, 5.5, 20.5), (2, 20.5, 1e9)], "region int, lo double, hi double")
    return er.region_means(results, order, regions, "pair", "pos", ["p_retailprice"])


@query("a23_actual_vs_predicted", "WITH l AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber, l_returnflag ORDER BY l_partkey DESC, l_suppkey DESC, l_quantity DESC) AS k FROM lineitem) SELECT l_orderkey || '-' || l_linenumber AS key, max(l_extendedprice) FILTER (l_returnflag = 'A') AS \"actual_A\", max(1000 * l_quantity) FILTER (l_returnflag = 'A') AS \"predicted_A\", max(l_extendedprice) FILTER (l_returnflag = 'N') AS \"actual_N\", max(1000 * l_quantity) FILTER (l_returnflag = 'N') AS \"predicted_N\" FROM l WHERE k = 1 GROUP BY l_orderkey, l_linenumber")
def _(t):
    df = t.lineitem.select(F.col("l_orderkey").alias("gname"), F.col("l_linenumber").alias("pragma"), F.col("l_returnflag").alias("target"), F.col("l_extendedprice").alias("y_true"), (1000 * F.col("l_quantity")).alias("y_pred"), "l_partkey", "l_suppkey", "l_quantity")
    return er.actual_vs_predicted(df, ["A", "N"], ["l_partkey", "l_suppkey", "l_quantity"])


@query("u1_predict_batches", "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, 2 * l_quantity + l_tax AS pred_perf, l_quantity - l_tax AS pred_lut, 3 * l_quantity AS score FROM lineitem".replace("2 * l_quantity + l_tax AS", "round(2 * l_quantity + l_tax, 6) AS").replace("l_quantity - l_tax AS", "round(l_quantity - l_tax, 6) AS").replace("3 * l_quantity AS", "round(3 * l_quantity, 6) AS"))
def _(t):
    import numpy as np

    got = er.predict_batches(t.lineitem, lambda x: np.column_stack((2 * x[:, 0] + x[:, 1], x[:, 0] - x[:, 1])), ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"], ["l_quantity", "l_tax"], ["perf", "lut"])
    return got.withColumns({c: r6(c) for c in ("pred_perf", "pred_lut", "score")})


# ---- sampling ---------------------------------------------------------------------------------------------------

_QUOTA = "c AS (SELECT source, count(*) AS n FROM documents GROUP BY 1), q AS (SELECT *, sum(n) OVER () AS tot, least(150, sum(n) OVER ()) AS t FROM c), f AS (SELECT *, (t * n) // tot AS fl, (t * n) % tot AS rest FROM q), g AS (SELECT *, t - sum(fl) OVER () AS lft, row_number() OVER (ORDER BY rest DESC, n DESC, source) AS k FROM f), z AS (SELECT source, n, least(n, fl + CASE WHEN k <= lft THEN 1 ELSE 0 END)::BIGINT AS quota FROM g)"


def _quotas(t: Tables) -> DataFrame:
    return sp.proportional_quotas(t.documents.groupBy("source").agg(F.count("*").alias("n")), "source", "n", 150)


@query("d1_proportional_quotas", f"WITH {_QUOTA} SELECT * FROM z")
def _(t):
    return _quotas(t)


@query("d2_sample_by_quota", f"WITH {_QUOTA}, r AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY md5('7:' || doc_id), doc_id) AS k FROM documents) SELECT doc_id, r.source FROM r JOIN z ON z.source = r.source WHERE k <= quota")
def _(t):
    return sp.sample_by_quota(t.documents.select("doc_id", "source"), _quotas(t), "source", "doc_id", 7)


_RANK = "r AS (SELECT doc_id, row_number() OVER (ORDER BY md5('3:' || doc_id), doc_id) - 1 AS k, count(*) OVER () AS n FROM documents)"


@query("d3_split_by_count", f"WITH {_RANK} SELECT doc_id, CASE WHEN k < floor(n * (1 - 0.15 - 0.25) + 1e-9) THEN 'train' WHEN k < floor(n * (1 - 0.15 - 0.25) + 1e-9) + floor(n * 0.15 + 1e-9) THEN 'val' ELSE 'test' END AS split FROM r")
def _(t):
    return sp.split_by_count(t.documents.select("doc_id"), "doc_id", 0.15, 0.25, 3)


@query("d4_kfold_split", f"WITH {_RANK}, f AS (SELECT *, least(floor(k / greatest(floor(n * 0.3 + 1e-9), 1)), 2)::INTEGER AS fold FROM r), s AS (SELECT *, count(*) FILTER (fold = 1) OVER () AS c, row_number() OVER (PARTITION BY fold = 1 ORDER BY k) - 1 AS p FROM f) SELECT doc_id, fold, CASE WHEN fold = 1 THEN 'test' WHEN p < floor((n - c) * 0.8 + 1e-9) THEN 'train' ELSE 'val' END AS split FROM s")
def _(t):
    return sp.kfold_split(t.documents.select("doc_id"), "doc_id", 0.3, 1, 3, 0.2)


@query("d5_holdout_by_kernel", "SELECT p_partkey, CASE WHEN p_brand IN ('Brand#1', 'Brand#7') THEN 'test' ELSE 'train' END AS split, p_brand = (SELECT min(p_brand) FROM part) AS first_kernel FROM part")
def _(t):
    first = sp.kernel_subset(t.part, "p_brand").select("p_partkey", F.lit(True).alias("f"))
    df = sp.holdout_by_kernel(t.part, "p_brand", ["Brand#1", "Brand#7"])
    return df.join(first, "p_partkey", "left").select("p_partkey", "split", F.coalesce("f", F.lit(False)).alias("first_kernel"))


# ---- program graphs ---------------------------------------------------------------------------------------------
# nodes are parts (a design per brand), edges lead from a line's part to that of the same brand with the next number


def _graph(t: Tables) -> tuple[DataFrame, DataFrame]:
    p = t.part
    nodes = p.select(F.col("p_brand").alias("design_id"), F.col("p_partkey").cast("string").alias("node_id"), (F.col("p_size") % 6).alias("block"), (F.col("p_size") % 3).alias("function"), F.lower("p_type").alias("text"), F.lit(0).alias("type"), F.concat(F.col("p_name"), F.lit(" icmp, "), F.col("p_size").cast("string")).alias("full_text"))
    own = Window.partitionBy("p_brand").orderBy("p_partkey")
    e = p.select("p_brand", "p_partkey", "p_size", F.lead("p_partkey").over(own).alias("nxt")).where("nxt is not null")
    edges = e.select(F.col("p_brand").alias("design_id"), (F.row_number().over(Window.partitionBy("p_brand").orderBy("p_partkey")) - 1).cast("long").alias("edge_id"), F.col("p_partkey").cast("string").alias("src"), F.col("nxt").cast("string").alias("dst"), (F.col("p_size") % 3).alias("flow"), (F.col("p_size") % 4).alias("position"))
    return nodes, edges


_NODES = "nodes AS (SELECT p_brand AS design_id, p_partkey AS id, p_size % 6 AS block, p_size % 3 AS function, lower(p_type) AS text, p_size, p_name FROM part)"
_EDGES = "edges AS (SELECT p_brand AS design_id, p_partkey AS src, nxt AS dst, p_size % 3 AS flow, p_size % 4 AS position, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1 AS edge_id FROM (SELECT *, lead(p_partkey) OVER (PARTITION BY p_brand ORDER BY p_partkey) AS nxt FROM part) WHERE nxt IS NOT NULL)"


@query("a18_code_metrics", """WITH f AS (SELECT p_brand, p_name, p_partkey AS a, p_partkey + p_size - 5 AS b, row_number() OVER (PARTITION BY p_brand, p_name ORDER BY p_partkey DESC) AS k FROM part), o AS (SELECT *, CASE WHEN b >= a THEN b - a + 1 END AS loc FROM f WHERE k = 1)
    SELECT p_brand, count(*) AS num_functions, coalesce(sum(loc), 0)::BIGINT AS kernel_total_lines, string_agg(p_name, ',' ORDER BY p_name) AS functions FROM o GROUP BY 1""")
def _(t):
    functions = t.part.select("p_brand", F.col("p_name").alias("name"), F.col("p_partkey").alias("decl_line"), (F.col("p_partkey") + F.col("p_size") - 5).alias("end_line"))
    calls = t.part.select("p_brand", F.col("p_name").alias("caller"), F.col("p_name").alias("callee"))
    return cg.code_metrics(functions, calls, ["p_brand"]).select("p_brand", "num_functions", "kernel_total_lines", F.array_join("functions", ",").alias("functions"))


@query("a19_flatten_ast", "SELECT p_partkey, 'f' || p_size AS name, p_size AS decl_line, p_size + 3 AS end_line FROM part")
def _(t):
    doc = F.concat(F.lit('{"inner":[{"kind":"FunctionDecl","name":"sys","isImplicit":true,"loc":{}},{"kind":"FunctionDecl","name":"f'), F.col("p_size").cast("string"), F.lit('","loc":{"file":"a.cpp","line":'), F.col("p_size").cast("string"), F.lit('},"range":{"begin":{"line":'), F.col("p_size").cast("string"), F.lit('},"end":{"line":'), (F.col("p_size") + 3).cast("string"), F.lit("}}}]}"))
    return cg.flatten_ast(t.part.select("p_partkey", doc.alias("text")), "p_partkey", "text")[0]


@query("a20_call_chain_depth", "WITH RECURSIVE c AS (SELECT p_brand, p_partkey AS k, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS i FROM part), w AS (SELECT p_brand, max(i) AS m FROM c GROUP BY 1) SELECT p_brand, (floor(log2(m)) + 1)::INTEGER AS max_call_chain_depth FROM w WHERE m > 1")
def _(t):
    i = F.row_number().over(Window.partitionBy("p_brand").orderBy("p_partkey"))
    tree = t.part.select("p_brand", i.alias("i")).where("i > 1").select("p_brand", F.floor(F.col("i") / 2).cast("string").alias("caller"), F.col("i").cast("string").alias("callee"))
    return cg.call_chain_depth(tree, ["p_brand"])


@query("a21_category_counts", f"WITH {_NODES} SELECT 'text' AS \"column\", text AS value, count(*) AS n FROM nodes GROUP BY ALL UNION ALL SELECT 'block', block::VARCHAR, count(*) FROM nodes GROUP BY ALL UNION ALL SELECT 'function', function::VARCHAR, count(*) FROM nodes GROUP BY ALL")
def _(t):
    return cg.category_counts(_graph(t)[0], ["text", "block", "function"])


@query("a22_graph_stats", f"WITH {_NODES}, {_EDGES}, n AS (SELECT design_id, count(*) AS num_nodes, count(DISTINCT (function, block)) AS num_blocks FROM nodes GROUP BY 1), e AS (SELECT design_id, count(*) AS num_edges FROM edges GROUP BY 1) SELECT n.design_id, num_nodes, num_blocks, coalesce(num_edges, 0) AS num_edges, round(coalesce(num_edges, 0) / num_nodes, 6) AS edges_per_node FROM n LEFT JOIN e ON e.design_id = n.design_id")
def _(t):
    return cg.graph_stats(*_graph(t)).withColumn("edges_per_node", r6("edges_per_node"))


@query("g1_add_block_nodes", f"WITH {_NODES}, m AS (SELECT design_id, max(id) AS m FROM nodes GROUP BY 1), b AS (SELECT design_id, function, block, min(id) AS f FROM nodes GROUP BY ALL) SELECT b.design_id, (m + row_number() OVER (PARTITION BY b.design_id ORDER BY f))::VARCHAR AS node_id, block, function, 'function-' || function || '-block-' || block AS full_text FROM b JOIN m ON m.design_id = b.design_id")
def _(t):
    return cg.add_block_nodes(*_graph(t))[0].where("type = 4").select("design_id", "node_id", "block", "function", "full_text")


@query("g1_block_edges", f"WITH {_NODES}, {_EDGES}, m AS (SELECT design_id, max(id) AS m FROM nodes GROUP BY 1), b AS (SELECT design_id, function, block, min(id) AS f FROM nodes GROUP BY ALL), w AS (SELECT b.*, m + row_number() OVER (PARTITION BY b.design_id ORDER BY f) AS new FROM b JOIN m ON m.design_id = b.design_id), t AS (SELECT n.design_id, n.id AS src, new AS dst, 4 AS flow, row_number() OVER (PARTITION BY n.design_id, n.function, n.block ORDER BY id) - 1 AS position FROM nodes n JOIN w ON w.design_id = n.design_id AND w.function = n.function AND w.block = n.block), u AS (SELECT * FROM t UNION ALL SELECT design_id, dst, src, flow, position FROM t), l AS (SELECT design_id, max(edge_id) AS l FROM edges GROUP BY 1) SELECT u.design_id, coalesce(l, -1) + row_number() OVER (PARTITION BY u.design_id ORDER BY src, dst, flow, position) AS edge_id, src::VARCHAR AS src, dst::VARCHAR AS dst, position::INTEGER AS position FROM u LEFT JOIN l ON l.design_id = u.design_id")
def _(t):
    return cg.add_block_nodes(*_graph(t))[1].where("flow = 4").drop("flow")


@query("g2_chain_blocks", "WITH b AS (SELECT DISTINCT p_brand, p_size, 'function-' || p_size % 3 || '-block-' || p_size AS name FROM part), c AS (SELECT p_brand, p_size::VARCHAR AS src, lead(p_size) OVER (PARTITION BY p_brand ORDER BY p_size % 3, p_size)::VARCHAR AS dst FROM b), d AS (SELECT * FROM c WHERE dst IS NOT NULL) SELECT p_brand, src, dst, 5 AS flow, 0 AS position FROM d UNION ALL SELECT p_brand, dst, src, 5, 0 FROM d")
def _(t):
    b = t.part.select("p_brand", "p_size").distinct()
    return cg.chain_blocks(b.select("p_brand", F.col("p_size").cast("string").alias("node_id"), F.concat(F.lit("function-"), (F.col("p_size") % 3).cast("string"), F.lit("-block-"), F.col("p_size").cast("string")).alias("full_text")), ["p_brand"])


@query("g3_prune_sinks", "SELECT p_brand AS design_id, p_partkey::VARCHAR AS node_id FROM part WHERE p_partkey % 5 < 3")
def _(t):
    # of every five parts three form a circle, and two hang on it, one behind the other
    k = F.col("p_partkey")
    part = t.part
    nodes = part.select(F.col("p_brand").alias("design_id"), k.cast("string").alias("node_id"))
    five = F.floor(k / 5) * 5
    nxt = F.when(k % 5 < 2, k + 1).when(k % 5 == 2, five).when(k % 5 == 3, k + 1)
    edges = part.select((five * 0).cast("string").alias("design_id"), k.cast("string").alias("src"), nxt.cast("string").alias("dst")).where("dst is not null")
    hang = part.where("p_partkey % 5 = 2").select(F.lit("0").alias("design_id"), k.cast("string").alias("src"), (k + 1).cast("string").alias("dst"))
    left, _ = cg.prune_sinks(t.spark, nodes.select(F.lit("0").alias("design_id"), "node_id"), edges.unionByName(hang))
    return left.join(nodes.withColumnRenamed("design_id", "brand"), "node_id").select(F.col("brand").alias("design_id"), "node_id")


@query("g4_hierarchy_edges", f"WITH {_NEST}, n AS (SELECT *, row_number() OVER (PARTITION BY user_id, parent_start ORDER BY start) - 1 AS child_no FROM q), h AS (SELECT user_id, 'b' || parent_start AS src, 'b' || start AS dst, 6 AS flow, child_no::INTEGER AS position FROM n WHERE parent_start IS NOT NULL) SELECT * FROM h UNION ALL SELECT user_id, dst, src, flow, position FROM h")
def _(t):
    nest = _nest(t)
    return cg.add_hierarchy_edges(nest, nest.select("user_id", "start", F.concat(F.lit("b"), F.col("start").cast("string")).alias("node_id")), ["user_id"])


@query("g4_loop_blocks", f"WITH {_NODES}, {_EDGES}, h AS (SELECT a.design_id, a.src AS start, n.function, n.block FROM edges a JOIN edges b ON b.design_id = a.design_id AND b.src = a.dst JOIN nodes n ON n.design_id = a.design_id AND n.id = b.dst), m AS (SELECT design_id, max(id) AS m FROM nodes GROUP BY 1), g AS (SELECT design_id, function, block, min(id) AS f FROM nodes GROUP BY ALL), w AS (SELECT g.*, m + row_number() OVER (PARTITION BY g.design_id ORDER BY f) AS new FROM g JOIN m ON m.design_id = g.design_id) SELECT a.design_id, a.src AS start, w.new::VARCHAR AS node_id FROM edges a JOIN edges b ON b.design_id = a.design_id AND b.src = a.dst JOIN nodes n ON n.design_id = a.design_id AND n.id = a.src JOIN w ON w.design_id = n.design_id AND w.function = n.function AND w.block = n.block")
def _(t):
    nodes, edges = _graph(t)
    # full texts become unique, so that a head names one chain of three instructions
    nodes = nodes.withColumn("full_text", F.concat(F.lit("<"), F.col("node_id"), F.lit(">")))
    mark = lambda c: F.concat(F.lit("<"), F.col(c), F.lit(">"))
    nxt = edges.select("design_id", F.col("src").alias("dst"), F.col("dst").alias("third"))
    heads = edges.join(nxt, ["design_id", "dst"]).select("design_id", F.col("src").cast("long").alias("start"), mark("src").alias("t1"), mark("dst").alias("t2"), mark("third").alias("t3"))
    return cg.loop_blocks(*cg.add_block_nodes(nodes, edges), heads)


# ---- features ---------------------------------------------------------------------------------------------------

_DICT = f"WITH {_NODES}, d AS (SELECT 'text' AS \"column\", text AS value FROM nodes UNION SELECT 'block', block::VARCHAR FROM nodes UNION SELECT 'function', function::VARCHAR FROM nodes), x AS (SELECT *, row_number() OVER (PARTITION BY \"column\" ORDER BY value) - 1 AS idx FROM d)"


def _dictionaries(t: Tables) -> DataFrame:
    nodes, _ = _graph(t)
    return ft.fit_dictionaries({c: nodes.select(c) for c in ("text", "block", "function")})


@query("f1_dictionaries", _DICT + " SELECT * FROM x")
def _(t):
    return _dictionaries(t).withColumn("idx", F.col("idx").cast("long"))


@query("f2_encode_nodes", _DICT + ", c AS (SELECT count(*) FILTER (\"column\" = 'text') AS nt, count(*) FILTER (\"column\" = 'function') AS nf FROM x) SELECT design_id, id::VARCHAR AS node_id, a.idx || ',' || (nt + b.idx) || ',' || (nt + nf + e.idx) || ',' || (nt + nf + (SELECT count(*) FROM x WHERE \"column\" = 'block')) AS indices FROM nodes, c, x a, x b, x e WHERE a.\"column\" = 'text' AND a.value = text AND b.\"column\" = 'function' AND b.value = function::VARCHAR AND e.\"column\" = 'block' AND e.value = block::VARCHAR")
def _(t):
    nodes, _ = _graph(t)
    d = _dictionaries(t)
    df = ft.one_hot(nodes.withColumn("one", F.lit(1)), d, ["text", "function", "block", "=one"], ft.widths(d))
    return df.select("design_id", "node_id", F.array_join(F.col("features.indices").cast("array<string>"), ",").alias("indices"))


@query("f3_encode_edges", f"WITH {_EDGES} SELECT design_id, edge_id, flow || ',' || (3 + position) AS indices FROM edges")
def _(t):
    _, edges = _graph(t)
    d = ft.fit_dictionaries({c: edges.select(c) for c in ("flow", "position")})
    return ft.encode_edges(edges, d, ft.widths(d)).select("design_id", "edge_id", F.array_join(F.col("features.indices").cast("array<string>"), ",").alias("indices"))


@query("f4_node_flags", "SELECT p_partkey, p_type = 'SMALL' AS is_pseudo, p_type = 'ECONOMY' OR p_type = 'PROMO' AS is_pragma, NOT (p_type IN ('SMALL', 'ECONOMY', 'PROMO')) AS is_context, (p_size % 2 = 0)::INTEGER AS numeric, CASE WHEN p_type = 'ECONOMY' THEN upper('Pragma x icmp, ' || CASE WHEN p_size % 2 = 0 THEN p_size::VARCHAR ELSE 'n' END) WHEN p_type = 'PROMO' THEN upper('y icmp, ' || CASE WHEN p_size % 2 = 0 THEN p_size::VARCHAR ELSE 'n' END) ELSE 'None' END AS pragma_text FROM part")
def _(t):
    ty = F.col("p_type")
    text = F.when(ty == "SMALL", "pseudo_block").when(ty == "PROMO", "Tile").otherwise("add")
    full = F.concat(F.when(ty == "ECONOMY", "Pragma x").otherwise("y"), F.lit(" icmp, "), F.when(F.col("p_size") % 2 == 0, F.col("p_size").cast("string")).otherwise("n"))
    return ft.node_flags(t.part.select("p_partkey", text.alias("text"), full.alias("full_text"))).drop("text", "full_text")


_F5_SQL = """WITH l AS (SELECT l_orderkey, l_returnflag AS f, l_quantity::INTEGER AS q, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) AS k FROM lineitem)
    SELECT l_orderkey, (CASE WHEN bool_or(f = 'A') THEN 1.0 ELSE 0.0 END)::DOUBLE AS v0, (CASE WHEN bool_or(f = 'N') THEN 10.0 ELSE 0.0 END)::DOUBLE AS v1, (CASE WHEN bool_or(f = 'R') THEN 1.0 ELSE 0.0 END)::DOUBLE AS v2, coalesce(max_by(q, k) FILTER (f = 'R'), 0)::DOUBLE AS v3 FROM l GROUP BY 1"""


def _scope(t: Tables) -> DataFrame:
    k = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity"))
    lines = t.lineitem.select(F.col("l_orderkey").alias("design_id"), k.alias("k"), "l_returnflag", F.col("l_quantity").cast("int").cast("string").alias("q"))
    name = F.when(F.col("l_returnflag") == "A", "TILE").when(F.col("l_returnflag") == "N", "PIPELINE").otherwise("PARALLEL")
    nodes = lines.select("design_id", F.col("k").cast("string").alias("node_id"), name.alias("text"), F.concat(name, F.lit(" factor="), "q").alias("full_text"))
    heads = lines.select("design_id").distinct().select("design_id", F.lit("0").alias("node_id"), F.lit("pseudo_block").alias("text"), F.lit("x").alias("full_text"))
    edges = lines.select("design_id", F.col("k").cast("long").alias("edge_id"), F.lit("0").alias("src"), F.col("k").cast("string").alias("dst"))
    got = ft.pragma_scope_vector(nodes.unionByName(heads), edges)
    return got.select(F.col("design_id").alias("l_orderkey"), "node_id", "in_scope", *[F.col("scope")[i].alias(f"v{i}") for i in range(4)])


@query("f5_pragma_scope", _F5_SQL)
def _(t):
    return _scope(t).where("node_id = '0'").drop("node_id", "in_scope")


@query("f5_scope_of_all_nodes", f"""SELECT *, '0' AS node_id, true AS in_scope FROM ({_F5_SQL})
    UNION ALL SELECT l_orderkey, 0::DOUBLE, 0::DOUBLE, 0::DOUBLE, 0::DOUBLE, (row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber))::VARCHAR, false FROM lineitem""")
def _(t):
    return _scope(t)


@query("f6_edge_index", f"WITH {_NODES}, {_EDGES}, i AS (SELECT design_id, id, row_number() OVER (PARTITION BY design_id ORDER BY id::VARCHAR) - 1 AS idx FROM nodes) SELECT e.design_id, edge_id, a.idx AS src_idx, b.idx AS dst_idx FROM edges e JOIN i a ON a.design_id = e.design_id AND a.id = src JOIN i b ON b.design_id = e.design_id AND b.id = dst")
def _(t):
    e = ft.edge_index(*_graph(t))[1]
    return e.select("design_id", "edge_id", F.col("src_idx").cast("long").alias("src_idx"), F.col("dst_idx").cast("long").alias("dst_idx"))


# ---- design spaces ----------------------------------------------------------------------------------------------
# a space per brand: types are free options, sizes depend on the type, and the container is free again


def _options(t: Tables) -> DataFrame:
    kind = t.part.select(F.col("p_brand").alias("space"), F.lit("type").alias("param"), F.col("p_type").alias("option"), F.lit(None).cast("string").alias("parent_param"), F.lit(None).cast("string").alias("parent_option"))
    sizes = t.part.select(F.col("p_brand").alias("space"), F.lit("size").alias("param"), F.col("p_size").cast("string").alias("option"), F.lit("type").alias("parent_param"), F.col("p_type").alias("parent_option"))
    ii = kind.select("space").distinct().select("space", F.lit("ii").alias("param"), F.explode(F.array(F.lit("1"), F.lit("2"))).alias("option"), F.lit(None).cast("string").alias("parent_param"), F.lit(None).cast("string").alias("parent_option"))
    return kind.unionByName(sizes).unionByName(ii).distinct()


@query("a24_design_space_size", "SELECT p_brand AS space, (2 * count(DISTINCT (p_type, p_size)))::BIGINT AS num_points FROM part GROUP BY 1")
def _(t):
    return ds.design_space_size(_options(t))


@query("x1_enumerate_points", "SELECT DISTINCT p_brand AS space, 'ii-' || i || '.size-' || p_size || '.type-' || p_type AS point_key FROM part, (SELECT unnest(['1', '2']) AS i)")
def _(t):
    return ds.enumerate_points(_options(t)).select("space", "point_key")


@query("x1_sampled_points", """WITH p AS (SELECT DISTINCT p_brand AS space, i, p_size::VARCHAR AS size, p_type FROM part, (SELECT unnest(['1', '2']) AS i)), r AS (SELECT *, row_number() OVER (PARTITION BY space ORDER BY i, p_type, size) - 1 AS nr, count(*) OVER (PARTITION BY space) AS n FROM p),
    d AS (SELECT space, n, j, ('0x' || substr(md5('64:' || space || ':' || j), 1, 15))::BIGINT % n AS nr FROM (SELECT DISTINCT space, n FROM r), (SELECT unnest(range(20000)) AS j)), f AS (SELECT space, nr, min(j) AS j FROM d GROUP BY ALL), k AS (SELECT *, row_number() OVER (PARTITION BY space ORDER BY j) AS k FROM f)
    SELECT r.space, 'ii-' || i || '.size-' || size || '.type-' || p_type AS point_key FROM r JOIN k ON k.space = r.space AND k.nr = r.nr WHERE k <= 64 OR n <= 64""")
def _(t):
    return ds.enumerate_points(_options(t), n=64, seed=64).select("space", "point_key")


@query("a25_check_design_space", "SELECT p_brand AS space, (count(*) FILTER (p_partkey % 4 = 0) + count(*) FILTER (p_partkey % 3 = 0) + count(*) FILTER (p_partkey % 5 = 1))::BIGINT AS num_errors FROM part GROUP BY 1")
def _(t):
    k, name = F.col("p_partkey"), F.col("p_partkey").cast("string")
    params = t.part.select(F.col("p_brand").alias("space"), name.alias("param"), F.when(k % 3 != 0, "1").alias("default"), (k % 5 != 1).alias("has_options"))
    deps = t.part.where("p_partkey % 4 = 0").select(F.col("p_brand").alias("space"), name.alias("param"), F.when(k % 8 == 0, name).otherwise("NO_SUCH").alias("depends_on"))
    return ds.check_design_space(params, deps)[0]


# ---- tables that Spark derives ----------------------------------------------------------------------------------


def _tree(t: Tables) -> str:
    """A folder of its own below the shared one."""
    base = t.spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not t.spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the whole cluster shares")
        base = f"file://{tempfile.mkdtemp(prefix='gatherline-')}"
    return f"{base if '://' in base else 'file://' + base}/trees/{uuid.uuid4().hex}"


_S1_SQL = """SELECT 'run__2025-01-02_03-04-05' AS run, 'm' || s_suppkey % 2 AS model, 'd' || s_nationkey AS domain, ['seed_designs', 'feedback_runs', 'final_designs'][(s_suppkey % 3 + 1)::INTEGER] AS stage, s_suppkey::INTEGER AS seed, (s_suppkey % 4)::INTEGER AS iteration,
    (s_suppkey % 8)::INTEGER AS sample_idx, CASE WHEN s_suppkey % 5 = 0 THEN '__fix' ELSE '' END AS retry_suffix, s_name AS kernel_name, CASE WHEN s_acctbal > 3000 THEN 'Pass' ELSE 'Fail' END AS status, s_acctbal AS temperature, 'f' || s_suppkey || '.cpp' AS code FROM supplier"""


def _record_files(t: Tables) -> DataFrame:
    n, text = F.col("s_suppkey"), lambda c: c.cast("string")
    stage = F.when(n % 3 == 0, "seed_designs").when(n % 3 == 1, "feedback_runs").otherwise("final_designs")
    path = F.concat(F.lit("run__2025-01-02_03-04-05/m"), text(n % 2), F.lit("/d"), text(F.col("s_nationkey")), F.lit("/"), stage, F.lit("/seed_design_"), text(n), F.lit("/iter_"), text(n % 4), F.lit("_samples/sample_"), text(n % 8), F.when(n % 5 == 0, "__fix").otherwise(""), F.lit("/single_eval_data.json"))
    record = F.struct(F.col("s_name").alias("kernel_name"), F.when(F.col("s_acctbal") > 3000, "Pass").otherwise("Fail").alias("status"), F.col("s_acctbal").alias("temperature"), F.create_map(F.concat(F.lit("f"), text(n), F.lit(".cpp")), F.lit("int x;\n")).alias("generated_code"))
    return t.supplier.select("s_suppkey", path.alias("path"), F.to_json(record).alias("content"))


def _record_columns(got: DataFrame) -> DataFrame:
    return got.select("run", "model", "domain", "stage", "seed", "iteration", "sample_idx", "retry_suffix", "kernel_name", "status", "temperature", F.map_keys("generated_code")[0].alias("code"))


@query("s1_eval_records", _S1_SQL)
def _(t):
    wr.write_text_files(_record_files(t), root := _tree(t))
    return _record_columns(rd.read_eval_records(t.spark, root))


@query("s1_synced_records", f"SELECT *, seed % 3 = 0 AS known FROM ({_S1_SQL})")
def _(t):
    # files of every third supplier first, then the others; a third call brings nothing
    files, root, store = _record_files(t), _tree(t), _tree(t)
    wr.write_text_files(files.where("s_suppkey % 3 = 0"), root)
    first = materialized(t.spark, rd.sync_eval_records(t.spark, root, store).select("seed", F.lit(True).alias("known")))
    wr.write_text_files(files.where("s_suppkey % 3 <> 0"), root)
    rd.sync_eval_records(t.spark, root, store)
    every = rd.sync_eval_records(t.spark, root, store)
    return _record_columns(every).join(first, "seed", "left").withColumn("known", F.coalesce("known", F.lit(False)))


_S2_SQL = """WITH s AS (SELECT 'd' || s_nationkey AS domain, s_suppkey FROM supplier)
    SELECT domain, s_suppkey::VARCHAR AS seed, 0 AS position, NULL AS target, NULL AS status, (s_suppkey % 7)::INTEGER AS num_functions FROM s
    UNION ALL SELECT domain, s_suppkey::VARCHAR, (i + 1)::INTEGER, 't' || i, CASE WHEN (s_suppkey + i) % 2 = 0 THEN 'Pass' ELSE 'Fail' END, (s_suppkey % 7 + i)::INTEGER FROM (SELECT *, unnest(range(s_suppkey % 4)) AS i FROM s)"""


def _summary_files(t: Tables) -> DataFrame:
    n, text = F.col("s_suppkey"), lambda c: c.cast("string")
    step = lambda i: F.struct(F.concat(F.lit("iter_"), text(i)).alias("key"), F.struct(F.when((n + i) % 2 == 0, "Pass").otherwise("Fail").alias("Status"), F.concat(F.lit("t"), text(i)).alias("Target"), F.struct((n % 7 + i).alias("num_functions")).alias("target_result")).alias("value"))
    steps = F.when(n % 4 > 0, F.transform(F.sequence(F.lit(0).cast("long"), n % 4 - 1), step)).otherwise(F.array_remove(F.array(step(F.lit(0).cast("long"))), step(F.lit(0).cast("long"))))
    entry = F.struct(text(n).alias("key"), F.struct(F.struct(F.struct((n % 7).alias("num_functions")).alias("target_results")).alias("seed_design"), F.map_from_entries(steps).alias("iters")).alias("value"))
    files = t.supplier.groupBy("s_nationkey").agg(F.map_from_entries(F.collect_list(entry)).alias("eval_data_by_seed"))
    domain = F.concat(F.lit("d"), text(F.col("s_nationkey")))
    return files.select("s_nationkey", F.concat(F.lit("run__1/"), domain, F.lit("/domain_eval_data_summary.json")).alias("path"), F.to_json(F.struct(F.lit("m").alias("model_name"), domain.alias("domain"), "eval_data_by_seed")).alias("content"))


@query("s2_domain_summaries", _S2_SQL)
def _(t):
    wr.write_text_files(_summary_files(t), root := _tree(t))
    return rd.read_domain_summaries(t.spark, root).select("domain", "seed", "position", "target", "status", F.col("result.num_functions").alias("num_functions"))


@query("s2_synced_summaries", _S2_SQL)
def _(t):
    files, root, store = _summary_files(t), _tree(t), _tree(t)
    for part in ("s_nationkey % 2 = 0", "s_nationkey % 2 = 1"):
        wr.write_text_files(files.where(part), root)
        got = rd.sync_domain_summaries(t.spark, root, store)
    return got.select("domain", "seed", "position", "target", "status", F.col("result.num_functions").alias("num_functions"))


@query("s3_qor_tables", "SELECT 'part-' || p_partkey AS design_id, 'set' || p_size % 3 AS dataset, p_name AS name, CASE WHEN p_size % 4 = 0 THEN NULL ELSE p_size::VARCHAR END AS latency, (p_partkey * 2)::VARCHAR AS luts FROM part")
def _(t):
    have = {"design_id": F.concat(F.lit("part-"), F.col("p_partkey").cast("string")), "design__name": F.col("p_name"), "synthesis__latency_best_cycles": F.when(F.col("p_size") % 4 > 0, F.col("p_size").cast("string")), "implementation__utilization__Total LUTs": (F.col("p_partkey") * 2).cast("string")}
    columns = [x.strip().split("`")[1] for x in rd.QOR.split(",")]
    root = _tree(t)
    for i in range(3):
        t.part.where(F.col("p_size") % 3 == i).select(*[have.get(c, F.lit("0")).alias(c) for c in columns]).write.csv(f"{root}/set{i}", header=True)
    got = rd.read_qor_tables(t.spark, [f"{root}/set*/*.csv"])
    return got.select("design_id", "dataset", F.col("design__name").alias("name"), F.col("synthesis__latency_best_cycles").alias("latency"), F.col("`implementation__utilization__Total LUTs`").alias("luts"))


def _graph_files(t: Tables) -> DataFrame:
    """brand, nodes and links in order of the part."""
    text = lambda c: F.col(c).cast("string")
    both = F.struct("p_partkey", F.struct(text("p_partkey").alias("id"), (F.col("p_size") % 5).alias("block"), (F.col("p_size") % 2).alias("function"), F.col("p_type").alias("text"), (F.col("p_size") % 4).alias("type")).alias("node"), F.struct(text("p_partkey").alias("source"), text("p_size").alias("target"), (F.col("p_size") % 3).alias("flow"), (F.col("p_partkey") % 2).alias("position")).alias("link"))
    return t.part.groupBy(F.regexp_replace("p_brand", "[^A-Za-z0-9]", "-").alias("brand")).agg(F.array_sort(F.collect_list(both)).alias("all"))


def _node_link(t: Tables) -> tuple[DataFrame, DataFrame]:
    doc = F.struct(F.transform("all", lambda x: F.struct(*[x["node"][c].alias(c) for c in ("id", "block", "function", "text", "type")], F.struct(F.array(F.concat(F.lit("load "), x["node"]["text"])).alias("full_text")).alias("features"))).alias("nodes"), F.transform("all", lambda x: x["link"]).alias("links"))
    wr.write_text_files(_graph_files(t).select(F.concat("brand", F.lit(".json")).alias("path"), F.to_json(doc).alias("content")), root := _tree(t))
    return rd.read_node_link_graphs(t.spark, root)


_BRAND = "regexp_replace(p_brand, '[^A-Za-z0-9]', '-', 'g') AS design_id"
_NODE_SQL = f"SELECT {_BRAND}, p_partkey::VARCHAR AS node_id, (p_size % 5)::INTEGER AS block, (p_size % 2)::INTEGER AS function, p_type AS text, (p_size % 4)::INTEGER AS type, 'load ' || p_type AS full_text FROM part"
_LINK_SQL = f"SELECT {_BRAND}, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1 AS edge_id, p_partkey::VARCHAR AS src, p_size::VARCHAR AS dst, (p_size % 3)::INTEGER AS flow, (p_partkey % 2)::INTEGER AS position FROM part"


@query("s4_node_link_nodes", _NODE_SQL)
def _(t):
    return _node_link(t)[0]


@query("s4_node_link_edges", _LINK_SQL)
def _(t):
    return _node_link(t)[1]


def _gexf(t: Tables, designs: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame | None]:
    text = lambda c: c.cast("string")
    value = lambda k, v: F.concat(F.lit(f'<attvalue for="{k}" value="'), v, F.lit('"/>'))
    node = lambda x: F.concat(F.lit('<node id="'), x["node"]["id"], F.lit('" label="x"><attvalues>'), value(0, text(x["node"]["block"])), value(1, text(x["node"]["function"])), value(2, x["node"]["text"]), value(3, text(x["node"]["type"])), value(4, F.concat(F.lit("load "), x["node"]["text"])), F.lit("</attvalues></node>"))
    edge = lambda x, i: F.concat(F.lit('<edge id="'), text(i), F.lit('" source="'), x["link"]["source"], F.lit('" target="'), x["link"]["target"], F.lit('"><attvalues>'), value(5, text(x["link"]["flow"])), value(6, text(x["link"]["position"])), F.lit("</attvalues></edge>"))
    titles = lambda kind, at: f'<attributes class="{kind}">' + "".join(f'<attribute id="{k}" title="{n}" type="string"/>' for k, n in at) + "</attributes>"
    head = "<gexf><graph>" + titles("node", enumerate(("block", "function", "text", "type", "full_text"))) + titles("edge", ((5, "flow"), (6, "position")))
    doc = F.concat(F.lit(head + "<nodes>"), F.array_join(F.transform("all", node), ""), F.lit("</nodes><edges>"), F.array_join(F.transform("all", edge), ""), F.lit("</edges></graph></gexf>"))
    wr.write_text_files(_graph_files(t).select(F.concat("brand", F.lit(".gexf")).alias("path"), doc.alias("content")), root := _tree(t))
    return rd.read_gexf_graphs(t.spark, root, designs)


@query("s5_designs_without_graph", f"SELECT DISTINCT p_type AS design_id FROM part UNION SELECT p_brand FROM part WHERE p_brand NOT IN (SELECT {_BRAND.removesuffix(' AS design_id')} FROM part)")
def _(t):
    designs = t.part.select(F.explode(F.array("p_type", "p_brand", F.regexp_replace("p_brand", "[^A-Za-z0-9]", "-"))).alias("design_id")).distinct()
    return _gexf(t, designs)[2]


@query("s5_gexf_nodes", _NODE_SQL)
def _(t):
    return _gexf(t)[0]


@query("s5_gexf_edges", _LINK_SQL)
def _(t):
    return _gexf(t)[1]


@query("s9_graph_samples", f"WITH n AS ({_NODE_SQL}) SELECT design_id, node_id, text, 's' || length(design_id) % 2 AS dataset, CASE WHEN design_id < 'Brand-3' THEN 'train' ELSE 'test' END AS split FROM n")
def _(t):
    nodes, edges = _node_link(t)
    labels = nodes.select("design_id", F.concat(F.lit("s"), (F.length("design_id") % 2).cast("string")).alias("dataset"), F.when(F.col("design_id") < "Brand-3", "train").otherwise("test").alias("split")).distinct()
    ft.write_graph_samples(nodes, edges, labels, ft.fit_dictionaries({"text": nodes.select("text")}), root := _tree(t))
    return t.spark.read.parquet(f"{root}/nodes").select("design_id", "node_id", "text", "dataset", "split")


def _samples(t: Tables) -> str:
    nodes, edges = _node_link(t)
    labels = nodes.select("design_id", F.concat(F.lit("s"), (F.length("design_id") % 2).cast("string")).alias("dataset"), F.when(F.col("design_id") < "Brand-3", "train").otherwise("test").alias("split")).distinct()
    ft.write_graph_samples(nodes, edges, labels, ft.fit_dictionaries({"text": nodes.select("text")}), root := _tree(t), files=4)
    return root


_S9_LABELS = "'s' || length(design_id) % 2 AS dataset, CASE WHEN design_id < 'Brand-3' THEN 'train' ELSE 'test' END AS split"


@query("s9_packed_samples", f"""WITH n AS ({_NODE_SQL}), l AS ({_LINK_SQL}), g AS (SELECT design_id, count(*) AS n_nodes, string_agg(node_id, ' ' ORDER BY node_id) AS node_ids FROM n GROUP BY 1), e AS (SELECT design_id, count(*) AS n_edges, sum(edge_id * (flow + 1))::BIGINT AS edge_sum FROM l GROUP BY 1)
    SELECT g.design_id, {_S9_LABELS.replace('design_id', 'g.design_id')}, n_nodes, node_ids, n_edges, edge_sum FROM g JOIN e ON e.design_id = g.design_id""")
def _(t):
    edge_sum = F.aggregate("edges", F.lit(0).cast("long"), lambda acc, e: acc + e["edge_id"] * (e["flow"] + 1))
    got = ft.read_graph_samples(t.spark, _samples(t))
    return got.select("design_id", "dataset", "split", F.size("nodes").cast("long").alias("n_nodes"), F.array_join("nodes.node_id", " ").alias("node_ids"), F.size("edges").cast("long").alias("n_edges"), edge_sum.alias("edge_sum"))


@query("s9_sample_tables", f"""WITH n AS ({_NODE_SQL}), l AS ({_LINK_SQL}), d AS (SELECT text, row_number() OVER (ORDER BY text) - 1 AS idx FROM (SELECT DISTINCT text FROM n)),
    e AS (SELECT design_id, src, count(*) AS n_edges FROM l GROUP BY ALL) SELECT n.design_id, n.node_id, {_S9_LABELS.replace('design_id', 'n.design_id')}, idx::INTEGER AS text_idx, coalesce(n_edges, 0) AS n_edges FROM n JOIN d ON d.text = n.text LEFT JOIN e ON e.design_id = n.design_id AND e.src = n.node_id""")
def _(t):
    nodes, edges, labels, words = (t.spark.read.parquet(f"{root}/{x}") for root in [_samples(t)] for x in ("nodes", "edges", "labels", "dictionaries"))
    out = nodes.drop("dataset", "split").join(labels, "design_id").join(words.where("column = 'text'").select(F.col("value").alias("text"), F.col("idx").alias("text_idx")), "text")
    per = edges.groupBy("design_id", F.col("src").alias("node_id")).agg(F.count("*").alias("n_edges"))
    return out.join(per, ["design_id", "node_id"], "left").select("design_id", "node_id", "dataset", "split", "text_idx", F.coalesce("n_edges", F.lit(0).cast("long")).alias("n_edges"))


@query("s6_synth_reports", "SELECT p_partkey, round(p_size * CASE p_partkey % 3 WHEN 0 THEN 1e-9 WHEN 1 THEN 1e-6 ELSE 1e-3 END, 12) AS clock_period, CASE WHEN p_size % 4 <> 0 THEN p_size * 10 END::BIGINT AS latency_best_cycles, round(p_size / 50, 6) AS share, 0.0::DOUBLE AS uram FROM part")
def _(t):
    s, n = F.col("p_size").cast("string"), F.col("p_partkey") % 3
    xml = F.concat(
        F.lit("<profile><PerformanceEstimates><SummaryOfTimingAnalysis><unit>"), F.when(n == 0, "ns").when(n == 1, "us").otherwise("ms"), F.lit("</unit><EstimatedClockPeriod>"), s,
        F.lit("</EstimatedClockPeriod></SummaryOfTimingAnalysis><SummaryOfOverallLatency><Best-caseLatency>"), F.when(F.col("p_size") % 4 == 0, "undef").otherwise((F.col("p_size") * 10).cast("string")),
        F.lit("</Best-caseLatency><Average-caseLatency>7</Average-caseLatency><Worst-caseLatency>9</Worst-caseLatency></SummaryOfOverallLatency></PerformanceEstimates><AreaEstimates><Resources><BRAM_18K>0</BRAM_18K><DSP>1</DSP><FF>2</FF><LUT>"), s,
        F.lit("</LUT><URAM>0</URAM></Resources><AvailableResources><BRAM_18K>4</BRAM_18K><DSP>4</DSP><FF>4</FF><LUT>50</LUT><URAM>0</URAM></AvailableResources></AreaEstimates></profile>"))
    got = rd.parse_synth_reports(t.part.select("p_partkey", xml.alias("xml")), "xml")
    return got.select("p_partkey", F.round("clock_period", 12).alias("clock_period"), "latency_best_cycles", r6("resources_lut_fraction_used").alias("share"), F.col("resources_uram_fraction_used").alias("uram"))


@query("s7_latest_run", "SELECT o_orderkey FROM orders WHERE o_orderdate::DATE = (SELECT max(o_orderdate::DATE) FROM orders)")
def _(t):
    run = F.concat(F.lit("run__"), F.date_format("o_orderdate", "yyyy-MM-dd"))
    return rd.select_runs(t.orders.select("o_orderkey", run.alias("run"))).select("o_orderkey")


@query("s10_union_rows", "SELECT n_name AS name, n_regionkey::VARCHAR AS region, '' AS seg FROM nation UNION ALL SELECT c_name, '', c_mktsegment FROM customer")
def _(t):
    return wr.union_rows([t.nation.select(F.col("n_name").alias("name"), F.col("n_regionkey").alias("region")), t.customer.select(F.col("c_name").alias("name"), F.col("c_mktsegment").alias("seg"))])
