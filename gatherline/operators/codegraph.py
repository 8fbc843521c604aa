"""Program graphs: joins of directives, loops and nodes, and graph tables."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .joins import materialized, small
from .peeling import finite_depths
from .substrings import holding

NODE_COLUMNS = ("node_id", "block", "function", "text", "type", "full_text")
# Kinds of nodes and edges, and positions of directive edges.
PRAGMA_NODE, BLOCK_NODE, VARIABLE_NODE = 3, 4, 1
PRAGMA_FLOW, BLOCK_FLOW, CHAIN_FLOW, NEST_FLOW = 3, 4, 5, 6
DIRECTIVE_POSITIONS = {"PIPELINE": 0, "PARALLEL": 1, "TILE": 2}


def pair_seed_final(final: DataFrame, seed: DataFrame, by: list[str], name: str, final_iter: int) -> tuple[DataFrame, DataFrame]:
    """(final designs named ``seed_design_N_iter_K`` with their passing seed, those without one).

    Both sides may be large, and Spark's guess of the seeds' size may be far too low, so the join is by shuffle, never broadcast.
    """
    pattern = r"^seed_design_(\d+)_iter_(\d+)$"
    rows = final.withColumns({"seed_id": F.regexp_extract(name, pattern, 1).try_cast("int"), "final_iter": F.regexp_extract(name, pattern, 2).try_cast("int")}).where(F.col("final_iter") == final_iter)
    seeds = seed.withColumn("seed_id", F.regexp_extract(name, r"^seed_design_(\d+)$", 1).try_cast("int")).select(*by, "seed_id", F.col(name).alias("seed_name")).hint("merge")
    return rows.join(seeds, [*by, "seed_id"]), rows.join(seeds, [*by, "seed_id"], "left_anti")


def match_function_names(src: DataFrame, ir: DataFrame, keys: list[str], name: str = "func", ir_name: str = "ir_func") -> DataFrame:
    """Source function → the one IR function whose name holds it mangled (length and name), else the one that holds it plainly.

    A name that holds it mangled holds it plainly too, so one search by grams finds both.
    """
    pairs = holding(ir, src, keys, ir_name, name)
    mangled = F.col(ir_name).contains(F.concat(F.length(name).cast("string"), F.col(name)))
    pick = lambda hit: F.when(F.count_if(hit) == 1, F.max(F.when(hit, F.col(ir_name))))
    found = pairs.groupBy(*keys, name).agg(pick(mangled).alias("__m"), pick(F.lit(True)).alias("__p"))
    return found.select(*keys, name, F.coalesce("__m", "__p").alias("matched")).where("matched is not null")


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.unionByName(edges.withColumns({"src": F.col("dst"), "dst": F.col("src")}))


def overlay_loop_directives(loops: DataFrame, directives: DataFrame, ir_loops: DataFrame, functions: DataFrame, nodes: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(pragma nodes, their edges both ways, directives without an anchor) for pipeline, unroll and tile directives.

    Source loops meet directives by function and label, IR loops by ordinal in the matched function, graph nodes by the
    compare text (first such node). ``functions``: match_function_names of the designs. Ids continue after the last.
    """
    kind = F.upper("kind")
    position = F.when(kind == "UNROLL", "PARALLEL").otherwise(kind)
    placed = loops.join(directives.where("label is not null").select("design_id", "func", "label", "kind", "factor", "line"), ["design_id", "func", "label"])
    placed = placed.join(functions.select("design_id", "func", F.col("matched").alias("func_define")), ["design_id", "func"], "left").join(ir_loops.select("design_id", "func_define", "loop_ordinal", "compare_text"), ["design_id", "func_define", "loop_ordinal"], "left")
    first = nodes.groupBy("design_id", F.col("full_text").alias("compare_text")).agg(F.min(F.col("node_id").cast("long")).alias("anchor"))
    placed = placed.join(first, ["design_id", "compare_text"], "left").withColumn("position_name", position)
    return _pragma_rows(placed, nodes)


def _pragma_rows(placed: DataFrame, nodes: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """One node of type pragma per anchored directive, and two edges."""
    names = F.create_map(*[F.lit(x) for p in DIRECTIVE_POSITIONS.items() for x in p])
    last = nodes.groupBy("design_id").agg(F.max(F.col("node_id").cast("long")).alias("last_id"))
    order = Window.partitionBy("design_id").orderBy("line", "anchor")
    good = placed.where("anchor is not null").join(last, "design_id").withColumn("new_id", F.col("last_id") + F.row_number().over(order))
    text = F.when(F.col("factor").isNotNull(), F.concat(F.col("position_name"), F.lit(" factor="), F.col("factor").cast("string"))).otherwise(F.col("position_name"))
    at = nodes.select("design_id", F.col("node_id").cast("long").alias("anchor"), "block", "function").dropDuplicates(["design_id", "anchor"])
    good = good.join(at, ["design_id", "anchor"], "left")
    new = good.select("design_id", F.col("new_id").cast("string").alias("node_id"), "block", "function", F.col("position_name").alias("text"), F.lit(PRAGMA_NODE).alias("type"), text.alias("full_text"))
    edges = good.select("design_id", F.col("anchor").cast("string").alias("src"), F.col("new_id").cast("string").alias("dst"), F.lit(PRAGMA_FLOW).alias("flow"), F.try_element_at(names, "position_name").alias("position"))
    return new, _both_ways(edges), placed.where("anchor is null")


def anchor_array_directives(directives: DataFrame, nodes: DataFrame, most: int = 16) -> DataFrame:
    """``design_id, line, anchor``: block nodes that an array directive hangs on.

    Nodes of the variable, else up to ``most`` whose full text holds it (variables first, lowest id, not id 0), each
    mapped to the block node of its function and block, else to the lowest block node, else to itself.
    """
    arrays = directives.where("kind = 'array_partition'").select("design_id", "line", "var")
    own = nodes.select("design_id", F.col("node_id").cast("long").alias("id"), "block", "function", "text", "type", "full_text")
    exact = arrays.join(own.where(F.col("type") == VARIABLE_NODE), (arrays["design_id"] == own["design_id"]) & (F.col("var") == F.col("text"))).select(arrays["design_id"], "line", "id", "block", "function")
    left = arrays.join(exact.select("design_id", "line").distinct(), ["design_id", "line"], "left_anti")
    loose = left.join(holding(own, left, ["design_id"], "full_text", "var"), ["design_id", "var"]).join(own.where("id <> 0"), ["design_id", "full_text"])
    nth = F.row_number().over(Window.partitionBy("design_id", "line").orderBy((F.col("type") != VARIABLE_NODE).cast("int"), "id"))
    loose = loose.withColumn("nth", nth).where(F.col("nth") <= most).select("design_id", "line", "id", "block", "function")
    blocks = own.where(F.col("type") == BLOCK_NODE).select("design_id", "block", "function", F.col("id").alias("block_node"))
    lowest = blocks.groupBy("design_id").agg(F.min("block_node").alias("lowest"))
    used = exact.unionByName(loose).join(blocks, ["design_id", "block", "function"], "left").join(lowest, "design_id", "left")
    return used.select("design_id", "line", F.coalesce("block_node", "lowest", "id").alias("anchor")).distinct()


def array_pragma_rows(directives: DataFrame, anchors: DataFrame, nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(TILE nodes, one per anchored array directive; edges to all its anchors both ways)."""
    last = nodes.groupBy("design_id").agg(F.max(F.col("node_id").cast("long")).alias("last_id"))
    hung = directives.join(anchors.select("design_id", "line").distinct(), ["design_id", "line"], "left_semi").join(last, "design_id")
    hung = hung.withColumn("new_id", F.col("last_id") + F.row_number().over(Window.partitionBy("design_id").orderBy("line")))
    new = hung.select("design_id", F.col("new_id").cast("string").alias("node_id"), F.lit(None).cast("int").alias("block"), F.lit(None).cast("int").alias("function"), F.lit("TILE").alias("text"), F.lit(PRAGMA_NODE).alias("type"), F.col("raw").alias("full_text"))
    edges = anchors.join(hung.select("design_id", "line", "new_id"), ["design_id", "line"])
    edges = edges.select("design_id", F.col("anchor").cast("string").alias("src"), F.col("new_id").cast("string").alias("dst"), F.lit(PRAGMA_FLOW).alias("flow"), F.lit(DIRECTIVE_POSITIONS["TILE"]).alias("position"))
    return new, _both_ways(edges)


def join_graphs_with_labels(graphs: DataFrame, labels: DataFrame, key: str = "design_id", name: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(graphs with labels and ``gname``: the design's name, else its id; labels without a graph, counted)."""
    gname = F.coalesce(F.nullif(F.trim(F.col(name)), F.lit("")), F.col(key).cast("string")) if name else F.col(key).cast("string")
    return graphs.join(labels, key).withColumn("gname", gname), labels.join(graphs.select(key).distinct(), key, "left_anti").agg(F.count("*").alias("num_skipped"))


def missing_members(requested: DataFrame | None, available: DataFrame, key: str) -> DataFrame:
    """The available names, or those requested; a requested name that is absent is an error that lists both sets."""
    have = available.select(key).distinct()
    if requested is None:
        return have
    want = requested.select(key).distinct()
    gone = want.join(have, key, "left_anti").agg(F.array_sort(F.collect_set(key)).alias("gone"))
    every = have.agg(F.array_sort(F.collect_set(key)).alias("every"))
    text = F.concat(F.lit("not available: "), F.array_join(F.col("gone").cast("array<string>"), ", "), F.lit("; available: "), F.array_join(F.col("every").cast("array<string>"), ", "))
    guard = gone.crossJoin(every).select(F.when(F.size("gone") > 0, F.raise_error(text)).otherwise(F.lit("")).alias("__ok"))  # one row by one row
    return want.crossJoin(F.broadcast(guard)).where("__ok = ''").drop("__ok")


def eval_combos(designs: DataFrame, models: DataFrame, design: str, model: str) -> DataFrame:
    """All pairs of a design and a model, sorted: two short name lists, and the product is the feature."""
    return designs.select(design).distinct().crossJoin(small(models.select(model).distinct())).orderBy(design, model)


def nest_loops(lines: DataFrame, keys: list[str], line_no: str, is_open, is_close) -> DataFrame:
    """Opening and closing lines matched as brackets: keys, ``start, end, depth, parent_start, child_no`` (from 0)."""
    order = Window.partitionBy(*keys).orderBy(line_no)
    df = lines.withColumn("__step", F.when(is_open, 1).when(is_close, -1)).where("__step is not null")
    depth = F.sum("__step").over(order) + F.when(F.col("__step") == -1, 1).otherwise(0)
    df = df.withColumn("depth", depth)
    level = Window.partitionBy(*keys, "depth").orderBy(line_no).rowsBetween(1, Window.unboundedFollowing)
    df = df.withColumn("end", F.min(F.when(F.col("__step") == -1, F.col(line_no))).over(level))
    spans = df.where("__step = 1 and end is not null").select(*keys, F.col(line_no).alias("start"), "end", "depth")
    # the parent is the nearest earlier opening line one level up, if it is still open
    at = F.struct(F.col("start").alias("start"), F.col("end").alias("end"))
    events = spans.select(*keys, F.col("depth").alias("__level"), "start", "end", "depth", at.alias("__open")).unionByName(spans.select(*keys, (F.col("depth") - 1).alias("__level"), "start", "end", "depth", F.lit(None).cast(spans.select(at).schema[0].dataType).alias("__open")))
    before = Window.partitionBy(*keys, "__level").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    out = events.withColumn("__up", F.last("__open", ignorenulls=True).over(before)).where("__open is null")
    out = out.withColumn("parent_start", F.when(F.col("__up.end") > F.col("end"), F.col("__up.start")))
    nth = F.row_number().over(Window.partitionBy(*keys, "parent_start").orderBy("start")) - 1
    return out.select(*keys, "start", "end", "depth", "parent_start", nth.alias("child_no"))


def code_metrics(functions: DataFrame, calls: DataFrame, keys: list[str]) -> DataFrame:
    """Per design: ``num_functions, kernel_total_lines, average_function_lines, functions, edges``.

    The last declaration of a name wins; lines are null where they make no sense; calls keep to known functions.
    """
    last = Window.partitionBy(*keys, "name").orderBy(F.desc("decl_line"))
    own = functions.withColumn("__nth", F.row_number().over(last)).where("__nth = 1")
    loc = F.when(F.col("end_line") >= F.col("decl_line"), F.col("end_line") - F.col("decl_line") + 1)
    per = own.groupBy(*keys).agg(F.count("*").alias("num_functions"), F.coalesce(F.sum(loc), F.lit(0)).alias("kernel_total_lines"), F.bround(F.coalesce(F.avg(loc), F.lit(0.0)), 2).alias("average_function_lines"), F.array_sort(F.collect_set("name")).alias("functions"))
    names = own.select(*keys, "name")
    good = calls.where(~F.col("callee").startswith("operator")).join(names.withColumnRenamed("name", "caller"), [*keys, "caller"], "left_semi").join(names.withColumnRenamed("name", "callee"), [*keys, "callee"], "left_semi")
    edges = good.groupBy(*keys).agg(F.array_sort(F.collect_set(F.struct("caller", "callee"))).alias("edges"))
    return per.join(edges, keys, "left")


def _walk(doc: dict) -> tuple[list[tuple], list[tuple]]:
    """Functions and calls of a syntax tree, depth first, from the first entry of the main file on."""
    functions, calls, started = [], [], False
    top = doc.get("inner") or []
    for entry in top:
        where = entry.get("loc") or {}
        started = started or (not entry.get("isImplicit") and ("file" in where or "file" in (where.get("expansionLoc") or {})))
        if not started:
            continue
        stack = [(entry, None)]
        while stack:
            node, caller = stack.pop()
            kind, name = node.get("kind"), node.get("name")
            if kind == "FunctionDecl" and name:
                loc, rng = node.get("loc") or {}, node.get("range") or {}
                functions.append((name, loc.get("line") or (rng.get("begin") or {}).get("line"), (rng.get("end") or {}).get("line")))
                caller = name
            elif kind == "DeclRefExpr" and caller:
                ref = node.get("referencedDecl") or {}
                if ref.get("kind") == "FunctionDecl" and ref.get("name"):
                    calls.append((caller, ref["name"]))
            stack += [(x, caller) for x in reversed(node.get("inner") or []) if isinstance(x, dict)]
    return functions, calls


def flatten_ast(docs: DataFrame, key: str, text: str) -> tuple[DataFrame, DataFrame]:
    """(functions: name, decl_line, end_line; calls: caller, callee) of syntax trees in JSON, one document a row."""
    kind = docs.schema[key].dataType.simpleString()
    schema = f"key {kind}, is_call boolean, a string, b string, decl_line int, end_line int"

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            rows = []
            for k, t in zip(pdf["key"], pdf["text"], strict=True):
                functions, calls = _walk(json.loads(t) if t else {})
                rows += [(k, False, n, None, d, e) for n, d, e in functions] + [(k, True, a, b, None, None) for a, b in calls]
            out = pd.DataFrame(rows, columns=["key", "is_call", "a", "b", "decl_line", "end_line"])
            yield out.astype({"decl_line": "Int32", "end_line": "Int32"})

    flat = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInPandas(run, schema)
    functions = flat.where("not is_call").select(F.col("key").alias(key), F.col("a").alias("name"), "decl_line", "end_line")
    return functions, flat.where("is_call").select(F.col("key").alias(key), F.col("a").alias("caller"), F.col("b").alias("callee"))


def call_chain_depth(calls: DataFrame, keys: list[str]) -> DataFrame:
    """``max_call_chain_depth``: longest chain of calls of each design, in functions. A function met again while open counts one and stops.

    Functions that lead to no cycle get their depth by joins. Only designs with a cycle are walked, each in one task, and only the
    functions that lead to one, in order of name. Calls with a null name are left out; a design without calls has 0.
    """
    spark, cut = calls.sparkSession, lambda df: materialized(calls.sparkSession, df)
    named = F.col("src").isNotNull() & F.col("dst").isNotNull()
    # one key that is never null, so that designs with a null key meet themselves
    edges = cut(calls.select(*keys, F.to_json(F.struct(*keys)).alias("__key"), F.col("caller").cast("string").alias("src"), F.col("callee").cast("string").alias("dst")).distinct())
    known = cut(finite_depths(edges.where(named), ["__key"], cut))
    longest = edges.select(*keys, "__key").distinct().join(known.groupBy("__key").agg(F.max("depth").alias("__a")), "__key", "left")
    open_ = edges.where(named).join(known.select("__key", F.col("node").alias("src")), ["__key", "src"], "left_anti")
    walked = F.lit(None).cast("int")
    if open_.limit(1).count():
        below = open_.join(known.select("__key", F.col("node").alias("dst"), "depth"), ["__key", "dst"], "left")
        own = below.groupBy("__key", "src").agg(F.max("depth").alias("below"), F.collect_list(F.when(F.col("depth").isNull(), F.col("dst"))).alias("open"))
        longest, walked = longest.join(_walked_depth(own, ["__key"]), "__key", "left"), F.col("__b")
    return longest.select(*keys, F.greatest(F.coalesce("__a", F.lit(0)), F.coalesce(walked, F.lit(0))).cast("int").alias("max_call_chain_depth"))


def _walked_depth(functions: DataFrame, keys: list[str]) -> DataFrame:
    """``__b``: the depth of designs with cycles. ``src``, the functions it calls that lead to a cycle, and the depth ``below`` it otherwise."""
    kinds = ", ".join(f"`{k}` {functions.schema[k].dataType.simpleString()}" for k in keys)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        graph = {a: sorted(b) for a, b in zip(pdf["src"], pdf["open"], strict=True)}
        below = {a: 0 if pd.isna(d) else int(d) for a, d in zip(pdf["src"], pdf["below"], strict=True)}
        known: dict[str, int] = {}
        for root in sorted(graph):
            # (name, callees left, best so far); an open name that is met again counts 1
            open_, stack = {root}, [[root, iter(graph[root]), below[root]]] if root not in known else []
            while stack:
                top = stack[-1]
                nxt = next(top[1], None)
                if nxt is None:
                    stack.pop()
                    open_.discard(top[0])
                    known[top[0]] = top[2] + 1
                    if stack:
                        stack[-1][2] = max(stack[-1][2], known[top[0]])
                elif nxt in open_:
                    top[2] = max(top[2], 1)
                elif nxt in known:
                    top[2] = max(top[2], known[nxt])
                else:
                    open_.add(nxt)
                    stack.append([nxt, iter(graph[nxt]), below[nxt]])
        return pd.DataFrame({**{k: [pdf[k].iloc[0]] for k in keys}, "__b": [max(known.values(), default=0)]})

    return functions.groupBy(*keys).applyInPandas(run, f"{kinds}, __b int")


def category_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """``column, value, n`` of each distinct value."""
    text = df.select(*[F.col(c).cast("string").alias(c) for c in columns])
    return text.unpivot([], columns, "column", "value").groupBy("column", "value").agg(F.count("*").alias("n"))


def graph_stats(nodes: DataFrame, edges: DataFrame, key: str = "design_id") -> DataFrame:
    """Per design: ``num_nodes, num_edges, edges_per_node, num_blocks``."""
    n = nodes.groupBy(key).agg(F.count("*").alias("num_nodes"), F.count_distinct("function", "block").alias("num_blocks"))
    e = edges.groupBy(key).agg(F.count("*").alias("num_edges"))
    out = n.join(e, key, "left").withColumn("num_edges", F.coalesce("num_edges", F.lit(0)))
    return out.withColumn("edges_per_node", F.col("num_edges") / F.greatest("num_nodes", F.lit(1)))


def add_block_nodes(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges with one block node for each (function, block), in order of first node, tied to its members both ways.

    An edge's position is the member's rank inside the block.
    """
    own = nodes.withColumn("__id", F.col("node_id").cast("long"))
    per = Window.partitionBy("design_id")
    last = own.groupBy("design_id").agg(F.max("__id").alias("__last"))
    blocks = own.groupBy("design_id", "function", "block").agg(F.min("__id").alias("__first")).join(last, "design_id")
    blocks = blocks.withColumn("__new", F.col("__last") + F.row_number().over(per.orderBy("__first")))
    new = blocks.select("design_id", F.col("__new").cast("string").alias("node_id"), "block", "function", F.lit("pseudo_block").alias("text"), F.lit(BLOCK_NODE).alias("type"), F.concat(F.lit("function-"), F.col("function").cast("string"), F.lit("-block-"), F.col("block").cast("string")).alias("full_text"))
    rank = F.row_number().over(Window.partitionBy("design_id", "function", "block").orderBy("__id")) - 1
    ties = own.withColumn("position", rank).join(blocks.select("design_id", "function", "block", "__new"), ["design_id", "function", "block"])
    more = ties.select("design_id", F.col("node_id").alias("src"), F.col("__new").cast("string").alias("dst"), F.lit(BLOCK_FLOW).alias("flow"), "position")
    return nodes.select("design_id", *NODE_COLUMNS).unionByName(new), _numbered(edges, _both_ways(more))


def _numbered(edges: DataFrame, more: DataFrame) -> DataFrame:
    """``edges`` and new ones, whose ids continue after the last of their design."""
    last = edges.groupBy("design_id").agg(F.max("edge_id").alias("__last"))
    nth = F.row_number().over(Window.partitionBy("design_id").orderBy(F.col("src").cast("long"), F.col("dst").cast("long"), "flow", "position"))
    more = more.join(last, "design_id", "left").withColumn("edge_id", F.coalesce("__last", F.lit(-1)) + nth)
    cols = ["design_id", "edge_id", "src", "dst", "flow", "position"]
    return edges.select(*cols).unionByName(more.select(*[F.col(c).cast(edges.schema[c].dataType).alias(c) for c in cols]))


def chain_blocks(blocks: DataFrame, keys: list[str], name: str = "full_text") -> DataFrame:
    """Neighbouring block nodes in natural order of name, linked both ways: keys, ``src, dst, flow, position``."""
    from ..functions.scalars import natural_sort_key

    order = Window.partitionBy(*keys).orderBy(natural_sort_key(name))
    edges = blocks.withColumn("dst", F.lead("node_id").over(order)).where("dst is not null")
    return _both_ways(edges.select(*keys, F.col("node_id").alias("src"), "dst", F.lit(CHAIN_FLOW).alias("flow"), F.lit(0).alias("position")))


def prune_sinks(spark: SparkSession, nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges after removing nodes without outgoing edges until there is none.

    What goes are the nodes from which no path leads to a cycle (peeling.py: layers of joins, and contraction of paths,
    so that long chains take few rounds).
    """
    edges = materialized(spark, edges.join(nodes.select("design_id", F.col("node_id").alias("dst")).distinct(), ["design_id", "dst"], "left_semi"))
    ends = edges.select("design_id", F.col("src").cast("string").alias("src"), F.col("dst").cast("string").alias("dst"))
    gone = materialized(spark, finite_depths(ends, ["design_id"], lambda df: materialized(spark, df)).select("design_id", F.col("node").alias("dst")))
    left = edges.join(gone, ["design_id", "dst"], "left_anti")
    return nodes.join(left.select("design_id", F.col("src").alias("node_id")).distinct(), ["design_id", "node_id"], "left_semi"), left


def add_hierarchy_edges(nest: DataFrame, blocks: DataFrame, keys: list[str]) -> DataFrame:
    """Edges both ways between the block nodes of a loop and of its parent; the position is the child's number.

    ``nest``: keys, ``start, parent_start, child_no``; ``blocks``: keys, ``start, node_id`` of each loop's block. A loop
    whose block is not found is an error.
    """
    at = blocks.select(*keys, "start", "node_id")
    child = nest.where("parent_start is not null").join(at.withColumnRenamed("node_id", "dst"), [*keys, "start"], "left")
    both = child.join(at.select(*keys, F.col("start").alias("parent_start"), F.col("node_id").alias("src")), [*keys, "parent_start"], "left")
    sure = lambda c: F.when(F.col(c).isNull(), F.raise_error(F.concat(F.lit("no block for the loop at line "), F.col("start").cast("string"))).cast("string")).otherwise(F.col(c))
    return _both_ways(both.select(*keys, sure("src").alias("src"), sure("dst").alias("dst"), F.lit(NEST_FLOW).alias("flow"), F.col("child_no").alias("position")))


def loop_blocks(nodes: DataFrame, edges: DataFrame, heads: DataFrame) -> DataFrame:
    """``design_id, start, node_id``: the block node of each loop, by its first three instructions along neighbours.

    ``heads``: design_id, start, t1, t2, t3 (texts). The first node whose text holds t1 and from which an edge leads to
    one with t2 and on to one with t3 names the block.
    """
    text = nodes.select("design_id", F.col("node_id").alias("n"), F.col("full_text").alias("f"), "function", "block", "type")
    step = edges.select("design_id", F.col("src").alias("n"), F.col("dst").alias("m"))
    plain = text.where(F.col("type") != BLOCK_NODE)
    hit = heads.join(holding(plain, heads, ["design_id"], "f", "t1"), ["design_id", "t1"]).join(plain, ["design_id", "f"]).select("design_id", "start", "t2", "t3", "n", "function", "block")
    for t in ("t2", "t3"):
        nxt = text.select("design_id", F.col("n").alias("m"), F.col("f").alias("g"))
        hit = hit.join(step, ["design_id", "n"]).join(nxt, ["design_id", "m"]).where(F.col("g").contains(F.col(t))).drop("n", "g").withColumnRenamed("m", "n")
    block = text.where(F.col("type") == BLOCK_NODE).select("design_id", "function", "block", F.col("n").alias("node_id"))
    found = hit.join(block, ["design_id", "function", "block"])
    return found.groupBy("design_id", "start").agg(F.min_by("node_id", F.col("node_id").cast("long")).alias("node_id"))
