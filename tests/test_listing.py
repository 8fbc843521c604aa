"""Folders are listed in few tasks, however many there are."""

import pytest
from pyspark.sql import functions as F

from gatherline.sources import readers as rd
from gatherline.sources import writers as wr

LISTING = "spark.sql.sources.parallelPartitionDiscovery.parallelism"


@pytest.fixture
def record_tree(spark, tmp_path):
    n = F.col("id").cast("string")
    path = F.concat(F.lit("run__2025-01-02_03-04-05/m/d/seed_designs/seed_design_"), n, F.lit("/iter_0_samples/sample_0/single_eval_data.json"))
    files = spark.range(60).select(path.alias("path"), F.lit('{"kernel_name": "k"}').alias("content"))
    wr.write_text_files(files, root := f"file://{tmp_path}/tree")
    return root


def _tasks(spark, group, run):
    spark.sparkContext.setJobGroup(group, group)
    try:
        run()
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    tracker = spark.sparkContext.statusTracker()
    return [tracker.getStageInfo(s).numTasks for j in tracker.getJobIdsForGroup(group) for s in tracker.getJobInfo(j).stageIds]


def test_folders_are_listed_in_few_tasks(spark, record_tree):
    spark.conf.unset(LISTING)
    tasks = _tasks(spark, "listing", lambda: rd.read_eval_records(spark, record_tree))
    assert tasks and max(tasks) <= 2 * spark.sparkContext.defaultParallelism
    assert rd.read_eval_records(spark, record_tree).select("seed").distinct().count() == 60


def test_own_number_of_listing_tasks_stands(spark, record_tree):
    spark.conf.set(LISTING, 3)
    try:
        assert max(_tasks(spark, "own listing", lambda: rd.read_eval_records(spark, record_tree))) == 3
    finally:
        spark.conf.unset(LISTING)
