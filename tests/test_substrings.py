"""The gram index against looking into every text, and a design that is too large for all pairs."""

import random
import time

import pytest
from pyspark.sql import functions as F

from gatherline.operators import codegraph as cg
from gatherline.operators.substrings import holding


@pytest.mark.parametrize("width", [1, 2, 6])
def test_against_all_pairs(spark, width):
    rng = random.Random(width)
    word = lambda n: "".join(rng.choice("abé1") for _ in range(n))
    texts = [(rng.randrange(3), word(rng.randrange(0, 25))) for _ in range(150)] + [(0, None), (None, "a"), (1, "abab" * 400)]
    patterns = [(rng.randrange(3), word(rng.randrange(0, 9))) for _ in range(120)] + [(0, None), (None, "a"), (5, "a"), (1, "b" + "ab" * 30)]
    got = holding(spark.createDataFrame(texts, "k int, t string"), spark.createDataFrame(patterns, "k int, p string"), ["k"], "t", "p", width).collect()
    want = {(k, t, p) for k, t in texts for q, p in patterns if k is not None and k == q and t is not None and p is not None and p in t}
    assert {tuple(r) for r in got} == want and len(got) == len(want) > 500


def test_names_of_a_large_design(spark):
    n = 100_000
    src = spark.range(n).select(F.lit("d").alias("g"), F.concat(F.lit("compute_kernel_"), F.lpad("id", 6, "0")).alias("func"))
    ir = src.select("g", F.concat(F.lit("_Z"), F.length("func").cast("string"), "func", F.lit("Pfi")).alias("ir_func"))
    began = time.time()
    found = cg.match_function_names(src, ir, ["g"])
    assert found.where(F.col("matched") == F.concat(F.lit("_Z21"), "func", F.lit("Pfi"))).count() == n
    assert time.time() - began < 60


def test_array_directives_in_a_large_design(spark):
    n = 60_000
    nodes = spark.range(n).selectExpr("'d' AS design_id", "cast(id AS string) AS node_id", "1 AS block", "2 AS function", "'load' AS text", "cast(id % 2 AS int) AS type", "concat('%', id, ' = load float, ptr @buffer_', lpad(id % 30000, 6, '0')) AS full_text")
    arrays = spark.range(20_000).selectExpr("'d' AS design_id", "'array_partition' AS kind", "cast(id AS int) AS line", "concat('buffer_', lpad(id, 6, '0')) AS var", "'raw' AS raw")
    anchors = cg.anchor_array_directives(arrays, nodes).groupBy("line").agg(F.sort_array(F.collect_list("anchor")).alias("at"))
    assert anchors.where(F.col("at") == F.array(F.col("line").cast("long"), (F.col("line") + 30_000).cast("long"))).count() == 20_000 - 1  # node 0 is no anchor
