"""Feature tables of program graphs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .codegraph import materialized
from .joins import small

NODE_NUMERIC = "numeric"
PRAGMA_TEXTS = ("pipeline", "parallel", "tile")


def fit_dictionaries(tables: dict[str, DataFrame]) -> DataFrame:
    """``column, value, idx``: sorted distinct values of each named single-column table, numbered from 0.

    Values are counted down to distinct ones before they meet; a dictionary is as long as its column has values. They
    are sorted by ranges and numbered by the ranges' sizes, so that no task holds a whole dictionary.
    """
    rows = None
    for name, df in tables.items():
        part = df.select(F.lit(name).alias("column"), F.col(df.columns[0]).cast("string").alias("value")).where("value is not null").distinct()
        rows = part if rows is None else rows.unionByName(part)
    placed = materialized(rows.sparkSession, rows.orderBy("column", "value").withColumn("__at", F.monotonically_increasing_id()))
    part, inside = F.shiftright("__at", 33), F.col("__at").bitwiseAND((1 << 33) - 1)
    # one row for each range
    ranges = placed.groupBy(part.alias("__part")).agg(F.count("*").alias("__n"))
    ranges = ranges.select("__part", F.coalesce(F.sum("__n").over(Window.partitionBy(F.lit(0)).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__off"))
    numbered = placed.withColumn("__part", part).join(small(ranges), "__part").select("column", "value", (F.col("__off") + inside).alias("__at"))
    first = numbered.groupBy("column").agg(F.min("__at").alias("__first"))
    return numbered.join(small(first), "column").select("column", "value", (F.col("__at") - F.col("__first")).cast("int").alias("idx"))


def widths(dictionaries: DataFrame) -> dict[str, int]:
    """Entries of each dictionary."""
    return {r["column"]: r["n"] for r in dictionaries.groupBy("column").agg(F.count("*").alias("n")).collect()}


def one_hot(df: DataFrame, dictionaries: DataFrame, parts: list[str], size: dict[str, int], out: str = "features") -> DataFrame:
    """``out``: sparse concatenation of the one-hot codes of ``parts``, in their order; "=c" takes column c as a number.

    A value that is not in its dictionary gives zeros. Never dense: instruction texts are many.
    """
    at, pairs = 0, []
    for part in parts:
        if part.startswith("="):
            c = F.col(part[1:]).cast("double")
            pairs.append(F.when(F.coalesce(c, F.lit(0.0)) != 0, F.struct(F.lit(at).alias("i"), c.alias("v"))))
            at += 1
            continue
        own = dictionaries.where(F.col("column") == part).select(F.col("value").alias(f"__v_{part}"), F.col("idx").alias(f"__i_{part}"))
        df = df.join(own, F.col(part).cast("string") == F.col(f"__v_{part}"), "left").drop(f"__v_{part}")
        pairs.append(F.when(F.col(f"__i_{part}").isNotNull(), F.struct((F.col(f"__i_{part}") + at).alias("i"), F.lit(1.0).alias("v"))))
        at += size.get(part, 0)
    kept = F.array_compact(F.array(*pairs))
    vector = F.struct(F.lit(at).alias("size"), F.transform(kept, lambda x: x["i"]).alias("indices"), F.transform(kept, lambda x: x["v"]).alias("values"))
    return df.withColumn(out, vector).drop(*[f"__i_{p}" for p in parts])


def encode_nodes(nodes: DataFrame, dictionaries: DataFrame, size: dict[str, int]) -> DataFrame:
    """Node features: type, pragma text, the numeric flag, instruction text, function and block, in this order."""
    return one_hot(nodes, dictionaries, ["type", "pragma_text", "=" + NODE_NUMERIC, "text", "function", "block"], size)


def encode_edges(edges: DataFrame, dictionaries: DataFrame, size: dict[str, int], with_position: bool = True) -> DataFrame:
    """Edge features: flow and, if asked for, position; a missing attribute counts as 0."""
    df = edges.withColumns({"flow": F.coalesce("flow", F.lit(0)), "position": F.coalesce("position", F.lit(0))})
    return one_hot(df, dictionaries, ["flow", "position"] if with_position else ["flow"], size)


def node_flags(nodes: DataFrame, text: str = "text", full_text: str = "full_text") -> DataFrame:
    """``is_pseudo, is_pragma, is_context, numeric, pragma_text`` of each node."""
    t, f = F.coalesce(F.col(text), F.lit("")), F.coalesce(F.col(full_text), F.lit(""))
    pseudo = t.contains("pseudo")
    pragma = F.lower(f).contains("pragma") | F.lower(t).isin(*PRAGMA_TEXTS)
    number = f.contains("icmp") & F.trim(F.element_at(F.split(f, ","), -1)).rlike(r"^\d+$")
    return nodes.withColumns({
        "is_pseudo": pseudo, "is_pragma": pragma, "is_context": ~pragma & ~pseudo, "numeric": number.cast("int"),
        "pragma_text": F.when(pragma, F.upper(F.when(f != "", f).otherwise(t))).otherwise("None"),
    })


def pragma_scope_vector(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``scope`` of pseudo nodes: [1 if a tile succeeds it, 10 if a pipeline, 1 if a parallel, its factor], and ``in_scope``.

    Of several successors of one kind the last counts; other nodes have zeros.
    """
    nxt = nodes.select("design_id", F.col("node_id").alias("dst"), F.lower("text").alias("__t"), F.upper("full_text").alias("__f")).where(F.col("__t").isin(*PRAGMA_TEXTS))
    pseudo = nodes.where(F.coalesce(F.col("text"), F.lit("")).contains("pseudo")).select("design_id", F.col("node_id").alias("src"))
    hit = edges.select("design_id", "edge_id", "src", "dst").join(pseudo, ["design_id", "src"], "left_semi").join(nxt, ["design_id", "dst"])
    factor = F.coalesce(F.regexp_extract("__f", r"FACTOR=\s*(\d+)", 1).try_cast("double"), F.lit(0.0))
    has = lambda t: F.max((F.col("__t") == t).cast("int"))
    last = F.max_by(F.when(F.col("__t") == "parallel", factor), F.when(F.col("__t") == "parallel", F.col("edge_id")))
    scope = F.array(has("tile") * 1.0, has("pipeline") * 10.0, has("parallel") * 1.0, F.coalesce(last, F.lit(0.0)))
    found = hit.groupBy("design_id", F.col("src").alias("node_id")).agg(scope.alias("scope"))
    out = nodes.join(found, ["design_id", "node_id"], "left")
    return out.withColumns({"in_scope": F.col("scope").isNotNull(), "scope": F.coalesce("scope", F.array(*[F.lit(0.0)] * 4))})


def edge_index(nodes: DataFrame, edges: DataFrame, key: str = "design_id") -> tuple[DataFrame, DataFrame]:
    """(nodes with ``idx``: 0 … n-1 in order of their ids as text; edges as ``src_idx, dst_idx``). Parallel edges stay."""
    numbered = nodes.withColumn("idx", F.row_number().over(Window.partitionBy(key).orderBy(F.col("node_id").cast("string"))) - 1)
    at = lambda end: numbered.select(key, F.col("node_id").alias(end), F.col("idx").alias(f"{end}_idx"))
    return numbered, edges.join(at("src"), [key, "src"]).join(at("dst"), [key, "dst"])


def write_graph_samples(nodes: DataFrame, edges: DataFrame, labels: DataFrame, dictionaries: DataFrame, path: str, mode: str = "overwrite", by: tuple[str, ...] = ("dataset", "split"), files: int | None = None) -> None:
    """Write a training set: nodes, edges, labels (by data set and split), dictionaries, and ``samples``.

    ``samples`` has a row per design of the labels: its label columns, ``nodes`` and ``edges`` (arrays in order of their ids;
    empty if it has none). All but the dictionaries are sorted by design within ranges of designs, so that the statistics
    of a file's row groups find one design, and a reader streams whole samples. ``files``: ranges a table (default:
    ``spark.sql.shuffle.partitions``). A design is a sample for one worker, so it may be one row. Labels that repeat a design
    keep one row of it in ``samples``, and nodes and edges without a label are in none of the tables.
    """
    parts = files or int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    one = labels.dropDuplicates(["design_id"])
    place = one.select("design_id", *by)

    def put(df: DataFrame, name: str, *order: str) -> None:
        df.repartitionByRange(parts, "design_id").sortWithinPartitions(*by, "design_id", *order).write.mode(mode).partitionBy(*by).parquet(f"{path}/{name}")

    ids = lambda df, *names: [c for c in names if c in df.columns]
    put(nodes.drop(*by).join(place, "design_id"), "nodes", *ids(nodes, "node_id"))
    put(edges.drop(*by).join(place, "design_id"), "edges", *ids(edges, "edge_id", "src", "dst"))
    put(labels, "labels")

    def packed(df: DataFrame, name: str, *order: str) -> DataFrame:
        cols = [*order, *[c for c in df.columns if c not in (*order, "design_id", *by)]]
        return df.groupBy("design_id").agg(F.sort_array(F.collect_list(F.struct(*cols))).alias(name))

    samples = one.drop("nodes", "edges").join(packed(nodes, "nodes", *ids(nodes, "node_id")), "design_id", "left").join(packed(edges, "edges", *ids(edges, "edge_id", "src", "dst")), "design_id", "left")
    put(samples.withColumns({c: F.coalesce(c, F.array().cast(samples.schema[c].dataType)) for c in ("nodes", "edges")}), "samples")
    dictionaries.coalesce(1).write.mode(mode).parquet(f"{path}/dictionaries")


def read_graph_samples(spark: SparkSession, path: str, designs: list[str] | None = None, where: str | None = None) -> DataFrame:
    """Packed samples; ``designs`` are looked up by the row groups' statistics, ``where`` picks data sets and splits."""
    df = spark.read.parquet(f"{path}/samples")
    df = df.where(where) if where else df
    return df.where(F.col("design_id").isin(designs)) if designs is not None else df


def sparse_to_array(vector: str | Column) -> Column:
    """A sparse vector written out, for small widths."""
    v = F.col(vector) if isinstance(vector, str) else vector
    return F.transform(F.sequence(F.lit(0), v["size"] - 1), lambda i: F.coalesce(F.try_element_at(F.map_from_arrays(v["indices"], v["values"]), i), F.lit(0.0)))
