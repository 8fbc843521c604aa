"""Operator 6 on large groups of unlike sets: what travels is bounded, and nothing stays on disk that is not read again."""

import os
import random
import time

from gatherline.llm import common, jaccard_join

CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def _sharing_lines(seed, unlike=160, pairs=10):
    """Unlike documents that share a few common lines with many others, and near copies of some; the expected components."""
    rng = random.Random(seed)
    pool = [" ".join(f"common{line}w{i}" for i in range(14)) for line in range(8)]
    rows, expected = [], {}
    for doc in range(unlike):
        own = [f"own{doc}w{i}" for i in range(60)]
        lines = [*rng.sample(pool, 5), *(" ".join(own[i : i + 20]) for i in (0, 20, 40))]
        rows.append((doc, "\n".join(lines)))
        expected[doc] = doc
        if doc < pairs:
            lines[-1] += " more"
            rows.append((1000 + doc, "\n".join(lines)))
            expected[1000 + doc] = doc
    return rows, expected


def test_additions_that_many_share_come_last(spark, monkeypatch):
    rows, expected = _sharing_lines(1)
    monkeypatch.setattr(jaccard_join, "CLUSTER_NODES", 8)
    sent, within = [], jaccard_join._within

    def counted(spark, clusters, sets, share):
        sent.append(clusters.count())
        return within(spark, clusters, sets, share)

    monkeypatch.setattr(jaccard_join, "_within", counted)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in jaccard_join.similar_components(spark, docs, 5, 80).collect()}
    assert got == expected
    assert len(sent) > 1  # there were clusters too large for a task
    assert sum(sent[1:]) < len(rows)  # a set's elements travel once for each cluster it is in


def _shuffled_bytes(spark):
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString("\n").split("\n")
    return {f: os.path.getsize(f) for f in files if os.path.basename(f).startswith("shuffle_")}


def _tables(spark):
    top = f"{common.shared_dir(spark)}/gatherline/{spark.sparkContext.applicationId}".removeprefix("file:").replace("//", "/")
    return {(folder, name) for folder, names, _ in os.walk(top) for name in names}


def test_no_shuffle_and_no_consumed_table_stays(spark):
    rows, expected = _sharing_lines(2, unlike=1000, pairs=100)
    spark.conf.unset(CLEANUP)
    before, there = _shuffled_bytes(spark), _tables(spark)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = jaccard_join.similar_components(spark, docs, 4, 85)
    common.settled(spark, spark.range(500_000).repartition(4, "id"), "dealt")
    for _ in range(50):  # the files go in the background
        left = sum(n for f, n in _shuffled_bytes(spark).items() if f not in before)
        if left < 50_000:
            break
        time.sleep(0.2)
    tables = {t for _, t in _tables(spark) - there}
    assert left < 50_000
    assert "rows" in tables and not {"signatures", "nodes", "sets"} & tables
    assert spark.conf.get(CLEANUP, None) is None  # the session's own shuffles are as before
    for _ in range(2):
        assert {r.doc_id: r.component_id for r in out.collect()} == expected


def test_small_clusters_in_passes(spark, monkeypatch):
    rows, expected = _sharing_lines(3)
    monkeypatch.setattr(jaccard_join, "PASS_ELEMENTS", 1)
    tags, settled = [], jaccard_join.settled
    monkeypatch.setattr(jaccard_join, "settled", lambda s, df, tag: tags.append(tag) or settled(s, df, tag))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in jaccard_join.similar_components(spark, docs, 5, 80).collect()} == expected
    assert tags.count("small") == 1 and tags.count("links") > 1  # one round, no more at a time than the sets hold
