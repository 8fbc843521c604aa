"""Readers (S1-S7)."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EXECUTION = "return_code int, stdout string, stderr string, t0 double, t1 double, execution_time double, timeout boolean"
RECORD = f"""
kernel_name string, eval_type string, eval_id string, status string, error_message string, model_name string,
model_name_normalized string, temperature double, seed_design_name string, seed_design_tags array<string>, prompt string,
model_timeout boolean, prompt_too_long boolean, llm_execution_time struct<t0:double,t1:double,execution_time:double>,
raw_output string, can_parse_output boolean, generated_code map<string,string>,
c_compile_out struct<data_execution:struct<{EXECUTION}>>, c_run_out struct<data_execution:struct<{EXECUTION}>>,
vitis_hls_tool_out string, kernel_ast_out string, opt_dsl_out string, _corrupt_record string
""".replace("return_code int", "return_code:int").replace("stdout string", "stdout:string").replace("stderr string", "stderr:string").replace("t0 double, t1 double, execution_time double, timeout boolean", "t0:double, t1:double, execution_time:double, timeout:boolean")

RESULT = "struct<num_functions:int,max_call_chain_depth:int,average_function_lines:double,pareto_scores:struct<LUTs_vs_latency:double,FFs_vs_latency:double>>"
SUMMARY = f"""
model_name string, domain string, target_list map<string,string>, num_generated_seed_designs int, num_passing_seed_designs int,
num_samples_per_iteration int, eval_data_by_seed map<string, struct<seed_design: struct<eval_id:string,kernel_name:string,path:string,target_results:{RESULT}>,
iters: map<string, struct<Path:string,Status:string,Target:string,target_result:{RESULT}>>>>
"""

# Names of the files.
RECORD_FILE, SUMMARY_FILE = "single_eval_data.json", "domain_eval_data_summary.json"

QOR = ", ".join(
    f"`{c}` string"
    for c in (
        "design_id", "design__name", "synthesis__latency_best_cycles", "synthesis__latency_average_cycles", "synthesis__latency_worst_cycles",
        "synthesis__resources_lut_used", "synthesis__resources_ff_used", "synthesis__resources_dsp_used", "synthesis__resources_bram_used",
        "implementation__utilization__Total LUTs", "implementation__utilization__FFs", "implementation__utilization__DSP Blocks",
        "implementation__utilization__RAMB36", "implementation__utilization__RAMB18",
    )
)

GRAPH = "nodes array<struct<id:string,block:int,function:int,text:string,type:int,features:struct<full_text:array<string>>>>, links array<struct<source:string,target:string,flow:int,position:int>>, edges array<struct<source:string,target:string,flow:int,position:int>>"


def path_columns(df: DataFrame, path: str = "__path") -> DataFrame:
    """``run, model, domain, stage, seed, iteration, sample_idx, retry_suffix`` out of a record's path."""
    p = F.col(path)
    part = lambda pattern, i=1: F.nullif(F.regexp_extract(p, pattern, i), F.lit(""))
    tail = r"/([^/]+)/([^/]+)/(seed_designs|feedback_runs|final_designs)/"
    sample = r"/sample_(\d+)([^/]*)/[^/]*$"
    return df.withColumns({
        "run": part(r"/(run__\d{4}-\d{2}-\d{2}_\d{2}-\d{2}-\d{2})/"), "model": part(tail, 1), "domain": part(tail, 2), "stage": part(tail, 3),
        "seed": part(r"/seed_design_(\d+)(?:/|_iter_)").try_cast("int"), "iteration": part(r"/iter_(\d+)_samples/").try_cast("int"),
        "sample_idx": part(sample).try_cast("int"), "retry_suffix": F.when(p.rlike(sample), F.regexp_extract(p, sample, 2)),
    })


def _few_listing_tasks(spark: SparkSession) -> None:
    """From now on the session lists folders in few tasks, if it has no number of its own.

    Spark's own number is a task for each of up to 10,000 folders, whose results reach the driver: many times the list itself.
    """
    name = "spark.sql.sources.parallelPartitionDiscovery.parallelism"
    if spark.conf.get(name, None) is None:
        spark.conf.set(name, 2 * spark.sparkContext.defaultParallelism)


def _json_files(spark: SparkSession, schema: str, name: str, mode: str, stream: bool = False):
    """A reader of all files of this name below a folder, in one batch or as a stream of files."""
    _few_listing_tasks(spark)
    reader = (spark.readStream if stream else spark.read).schema(schema).option("multiLine", True).option("recursiveFileLookup", True).option("pathGlobFilter", name)
    return reader.option("mode", "FAILFAST" if mode == "strict" else "PERMISSIVE")


def _records(df: DataFrame) -> DataFrame:
    return path_columns(df.withColumn("__path", F.col("_metadata.file_path"))).drop("__path")


def _summaries(df: DataFrame) -> DataFrame:
    path = F.col("_metadata.file_path")
    df = df.withColumns({
        "run": F.nullif(F.regexp_extract(path, r"/(run__[^/]+)/", 1), F.lit("")),
        "domain": F.coalesce("domain", F.regexp_extract(path, r"/([^/]+)/[^/]+$", 1)), "model": F.coalesce("model_name", F.lit("unknown_model")),
    })
    return df.select("run", "model", "domain", "target_list", "eval_data_by_seed")


def _positions(summaries: DataFrame) -> DataFrame:
    seeds = summaries.select("run", "model", "domain", "target_list", F.explode("eval_data_by_seed").alias("seed", "entry"))
    first = seeds.select("run", "model", "domain", "target_list", "seed", F.lit(0).alias("position"), F.lit(None).cast("string").alias("target"), F.lit(None).cast("string").alias("status"), F.col("entry.seed_design.target_results").alias("result"))
    iters = seeds.select("run", "model", "domain", "target_list", "seed", F.explode("entry.iters").alias("key", "it"))
    number = F.regexp_extract("key", r"^iter_(\d+)$", 1).try_cast("int")
    later = iters.withColumn("n", number).where("n is not null").select("run", "model", "domain", "target_list", "seed", (F.col("n") + 1).alias("position"), F.col("it.Target").alias("target"), F.col("it.Status").alias("status"), F.col("it.target_result").alias("result"))
    return first.unionByName(later)


def _synced(rows: DataFrame, store: str) -> DataFrame:
    """Append what the stream of files has not brought before to the Parquet store, by run and model; all rows of the store.

    The stream's checkpoint beside the rows is the list of files read. A call that fails leaves no row, and the next one
    reads its files again.
    """
    spark = rows.sparkSession
    sink = rows.writeStream.format("parquet").partitionBy("run", "model").option("checkpointLocation", f"{store}/checkpoint")
    sink.trigger(availableNow=True).start(f"{store}/rows").awaitTermination()
    return spark.read.schema(rows.schema).parquet(f"{store}/rows").select(*rows.columns)


def read_eval_records(spark: SparkSession, root: str, mode: str = "strict") -> DataFrame:
    """All evaluation records below a folder, with the keys that their paths carry.

    ``strict`` fails on bad JSON; ``lenient`` gives an empty record. Tool outputs stay JSON text, for nested_numeric.
    """
    return _records(_json_files(spark, RECORD, RECORD_FILE, mode).json(root))


def sync_eval_records(spark: SparkSession, root: str, store: str, mode: str = "strict", files_at_once: int = 100_000) -> DataFrame:
    """As read_eval_records, but each file is read once: what it holds is kept in ``store`` as Parquet, by run and model.

    A call reads the files that are new since the last one, ``files_at_once`` a step. A file that changes after it was read is
    not read again. Each root needs a store of its own.
    """
    return _synced(_records(_json_files(spark, RECORD, RECORD_FILE, mode, stream=True).option("maxFilesPerTrigger", files_at_once).json(root)), store)


def read_domain_summaries(spark: SparkSession, root: str) -> DataFrame:
    """One row per run, model, domain, seed and position: 0 is the seed design, then the iterations in numeric order."""
    return _positions(_summaries(_json_files(spark, SUMMARY, SUMMARY_FILE, "lenient").json(root)))


def sync_domain_summaries(spark: SparkSession, root: str, store: str, files_at_once: int = 100_000) -> DataFrame:
    """As read_domain_summaries, with a store as that of sync_eval_records."""
    return _positions(_synced(_summaries(_json_files(spark, SUMMARY, SUMMARY_FILE, "lenient", stream=True).option("maxFilesPerTrigger", files_at_once).json(root)), store))


def _files(spark: SparkSession, patterns: list[str]) -> list[str]:
    """Sorted distinct files of all patterns; one that matches nothing is an error."""
    found: set[str] = set()
    for p in patterns:
        path = spark._jvm.org.apache.hadoop.fs.Path(p)
        hits = path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path)
        if not hits:
            raise FileNotFoundError(p)
        found |= {str(h.getPath()) for h in hits}
    return sorted(found)


def read_qor_tables(spark: SparkSession, paths: list[str], archive: bool = False) -> DataFrame:
    """Quality-of-result tables as text columns, each row with its ``dataset``; a row without design_id is an error.

    ``archive``: each path is a zip file with ``data_all.csv``, or a single entry that ends in it.
    """
    files = _files(spark, paths)
    if archive:

        def unpack(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            names = [x.strip().split("`")[1] for x in QOR.split(",")]
            for pdf in parts:
                for path, content in zip(pdf["path"], pdf["content"], strict=True):
                    with zipfile.ZipFile(io.BytesIO(content)) as z:
                        own = [n for n in z.namelist() if n == "data_all.csv"] or [n for n in z.namelist() if n.endswith("data_all.csv")]
                        if len(own) != 1:
                            raise ValueError(f"{path}: {len(own)} tables")
                        table = pd.read_csv(z.open(own[0]), dtype=str, keep_default_na=False)
                    yield table.reindex(columns=names).assign(dataset=path.rsplit("/", 1)[-1].rsplit(".", 1)[0])

        df = spark.read.format("binaryFile").load(files).select("path", "content").mapInPandas(unpack, QOR + ", dataset string")
    else:
        df = spark.read.csv(files, schema=QOR, header=True, enforceSchema=False).withColumn("dataset", F.regexp_extract(F.col("_metadata.file_path"), r"/([^/]+)/[^/]+$", 1))
    sure = F.when(F.coalesce(F.trim("design_id"), F.lit("")) == "", F.raise_error(F.lit("a row without design_id")).cast("string")).otherwise(F.col("design_id"))
    return df.withColumn("design_id", sure)


def graph_tables(df: DataFrame, key: str = "design_id") -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of rows with the columns of a node-link document; neither ``links`` nor ``edges`` is an error."""
    n = df.select(key, F.explode("nodes").alias("n"))
    nodes = n.select(key, F.col("n.id").alias("node_id"), "n.block", "n.function", "n.text", "n.type", F.try_element_at("n.features.full_text", F.lit(1)).alias("full_text"))
    have = F.coalesce("links", "edges")
    kind = df.schema["links"].dataType.simpleString()
    sure = F.when(have.isNull(), F.raise_error(F.concat(F.lit("no edges in "), F.col(key).cast("string"))).cast(kind)).otherwise(have)
    edges = df.select(key, F.posexplode(sure).alias("edge_id", "e")).select(key, F.col("edge_id").cast("long").alias("edge_id"), F.col("e.source").alias("src"), F.col("e.target").alias("dst"), "e.flow", "e.position")
    return nodes, edges


def read_node_link_graphs(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Node-link JSON files, a design each (named by its file)."""
    df = spark.read.schema(GRAPH).option("multiLine", True).option("recursiveFileLookup", True).json(path)
    return graph_tables(df.withColumn("design_id", F.regexp_extract(F.col("_metadata.file_path"), r"/([^/]+?)(?:\.json)?$", 1)))


GEXF = """
graph struct<
  attributes: array<struct<_class:string, attribute: array<struct<_id:string,_title:string,_type:string>>>>,
  nodes: struct<node: array<struct<_id:string,_label:string, attvalues: struct<attvalue: array<struct<_for:string,_value:string>>>>>>,
  edges: struct<edge: array<struct<_id:string,_source:string,_target:string, attvalues: struct<attvalue: array<struct<_for:string,_value:string>>>>>>
>"""


def read_gexf_graphs(spark: SparkSession, path: str, designs: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame | None]:
    """(nodes, edges, designs without a graph) of GEXF files, a design each; ids are text, a design in two files is an error."""
    df = spark.read.format("xml").option("rowTag", "gexf").schema(GEXF).load(path)
    df = df.withColumn("design_id", F.regexp_extract(F.col("_metadata.file_path"), r"/([^/]+?)\.gexf$", 1))

    def attributes(kind: str):
        mine = F.filter("graph.attributes", lambda a: a["_class"] == kind)
        return F.map_from_entries(F.transform(F.flatten(F.transform(mine, lambda a: a["attribute"])), lambda a: F.struct(a["_id"], a["_title"])))

    def values(x):
        return F.coalesce(F.map_from_entries(F.transform(x, lambda v: F.struct(v["_for"], v["_value"]))), F.expr("cast(map() as map<string,string>)"))

    def named(x, titles):
        return F.transform_keys(x, lambda k, _: F.coalesce(F.try_element_at(titles, k), k))

    n = df.select("design_id", attributes("node").alias("t"), F.explode("graph.nodes.node").alias("n")).withColumn("a", named(values(F.col("n.attvalues.attvalue")), F.col("t")))
    get = lambda k, kind="string": F.try_element_at("a", F.lit(k)).try_cast(kind)
    nodes = n.select("design_id", F.col("n._id").alias("node_id"), get("block", "int").alias("block"), get("function", "int").alias("function"), get("text").alias("text"), get("type", "int").alias("type"), get("full_text").alias("full_text"))
    e = df.select("design_id", attributes("edge").alias("t"), F.posexplode("graph.edges.edge").alias("edge_id", "e")).withColumn("a", named(values(F.col("e.attvalues.attvalue")), F.col("t")))
    edges = e.select("design_id", F.col("edge_id").cast("long").alias("edge_id"), F.col("e._source").alias("src"), F.col("e._target").alias("dst"), get("flow", "int").alias("flow"), get("position", "int").alias("position"))
    gone = designs.join(df.select("design_id").distinct(), "design_id", "left_anti") if designs is not None else None
    return nodes, edges, gone


REPORT = """PerformanceEstimates struct<SummaryOfTimingAnalysis:struct<unit:string,EstimatedClockPeriod:double>,
SummaryOfOverallLatency:struct<`Best-caseLatency`:string,`Average-caseLatency`:string,`Worst-caseLatency`:string>>,
AreaEstimates struct<Resources:struct<BRAM_18K:long,DSP:long,FF:long,LUT:long,URAM:long>,AvailableResources:struct<BRAM_18K:long,DSP:long,FF:long,LUT:long,URAM:long>>"""


def parse_synth_reports(df: DataFrame, xml: str) -> DataFrame:
    """Columns of synthesis reports: clock, latencies in cycles and seconds, resources used, in total and as a share.

    Clock units are ns, us or ms, any other is an error; a latency that is no whole number is null; a resource of which
    there is none has share 0 and must not be used.
    """
    r = df.withColumn("__r", F.from_xml(F.col(xml), REPORT))
    unit = F.col("__r.PerformanceEstimates.SummaryOfTimingAnalysis.unit")
    scale = F.when(unit == "ns", 1e-9).when(unit == "us", 1e-6).when(unit == "ms", 1e-3).otherwise(F.raise_error(F.concat(F.lit("unknown clock unit: "), F.coalesce(unit, F.lit("none")))).cast("double"))
    r = r.withColumn("clock_period", F.col("__r.PerformanceEstimates.SummaryOfTimingAnalysis.EstimatedClockPeriod") * scale)
    for name, tag in (("best", "Best"), ("average", "Average"), ("worst", "Worst")):
        cycles = F.trim(F.col(f"__r.PerformanceEstimates.SummaryOfOverallLatency.`{tag}-caseLatency`")).try_cast("long")
        r = r.withColumn(f"latency_{name}_cycles", cycles).withColumn(f"latency_{name}_seconds", F.col(f"latency_{name}_cycles") * F.col("clock_period"))
    for name, tag in (("lut", "LUT"), ("ff", "FF"), ("dsp", "DSP"), ("bram", "BRAM_18K"), ("uram", "URAM")):
        used, total = F.col(f"__r.AreaEstimates.Resources.{tag}"), F.col(f"__r.AreaEstimates.AvailableResources.{tag}")
        share = F.when(total != 0, used / total).when(used == 0, 0.0).otherwise(F.raise_error(F.lit(f"{name} used, but there is none")).cast("double"))
        r = r.withColumns({f"resources_{name}_used": used, f"resources_{name}_total": total, f"resources_{name}_fraction_used": share})
    return r.drop("__r")


def select_runs(df: DataFrame, names: list[str] | None = None, run: str = "run") -> DataFrame:
    """Rows of the latest ``run__*`` by name, or of the named runs, each of which must be there."""
    if names is None:
        latest = df.where(F.col(run).startswith("run__")).agg(F.max(run).alias(run))
        return df.join(F.broadcast(latest), run, "left_semi")
    have = {r[run] for r in df.where(F.col(run).isin(*names)).select(run).distinct().collect()}
    if gone := [n for n in names if n not in have]:
        raise ValueError(f"runs not found: {', '.join(gone)}")
    return df.where(F.col(run).isin(*names))
