"""Text: code blocks, file contracts, prompts, failure messages, directives and loops."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scalars import _col

CODE_BLOCK = r'(?s)<OUTPUT_CODE name="([^"]+)">(.*?)</OUTPUT_CODE>'

#: Files of a full bundle: ending → how many.
FULL_CODE = {".h": 1, ".cpp": 2, "_tb.cpp": 1, ".txt": 1, ".md": 1, ".tcl": 1, ".toml": 1}
FULL_CODE_NAMES = ("top.txt", "kernel_description.md", "opt_template.tcl", "hls_eval_config.toml")


def extract_code_blocks(c: str | Column, pattern: str = CODE_BLOCK) -> Column:
    """File → trimmed code of all tagged blocks; the last of a repeated name wins; no block gives null."""
    names = F.regexp_extract_all(_col(c), F.lit(pattern), F.lit(1))
    codes = F.transform(F.regexp_extract_all(_col(c), F.lit(pattern), F.lit(2)), lambda x: F.btrim(x, F.lit(" \t\n\r\x0b\x0c")))
    pairs = F.arrays_zip(names.alias("k"), codes.alias("v"))
    last = F.filter(pairs, lambda e, i: ~F.array_contains(F.slice(names, i + 2, F.greatest(F.size(names), F.lit(1))), e["k"]))
    return F.when(F.size(names) > 0, F.map_from_entries(last))


def check_bundle(names: str | Column, contract: str = "full") -> Column:
    """Whether an array of file names keeps a contract: ``full``, ``optdsl`` or ``directory``."""
    names = _col(names)
    count = lambda *ends: F.size(F.filter(names, lambda n: F.array_contains(F.array(*[n.endswith(e) for e in ends]), True)))
    if contract == "full":
        ok = (F.size(names) == 7) & F.lit(True)
        for end, many in FULL_CODE.items():
            ok &= count(end) == many
        for name in FULL_CODE_NAMES:
            ok &= F.array_contains(names, name)
    elif contract == "optdsl":
        ok = (F.size(names) == 1) & F.array_contains(names, "opt_template.tcl")
    elif contract == "directory":
        ok = (count("_tb.cpp") == 1) & (count(".cpp") - count("_tb.cpp") == 1) & (count(".h", ".hpp", ".hh") == 1)
    else:
        raise ValueError(f"unknown contract {contract}")
    return F.coalesce(ok, F.lit(False))


def render_prompt(template: str | Column, values: dict[str, Column], preamble: str, output_format: str, inputs: Column | None = None) -> Column:
    """Preamble, the template with each ``$name`` replaced, the output format, and inputs as tagged blocks in name order."""
    body = _col(template) if isinstance(template, str) and not template.startswith("$$") else F.lit(template)
    for name, value in sorted(values.items(), key=lambda kv: -len(kv[0])):
        body = F.replace(body, F.lit("$" + name), F.coalesce(value.cast("string"), F.lit("")))
    parts = [F.lit(preamble), body, F.lit(output_format)]
    if inputs is not None:
        blocks = F.transform(F.array_sort(F.map_entries(inputs)), lambda e: F.concat(F.lit('<INPUT_CODE name="'), e["key"], F.lit('">\n'), e["value"], F.lit("\n</INPUT_CODE>")))
        parts += [F.concat(F.lit("## Task Inputs\n\n"), F.array_join(blocks, "\n"))]
    return F.concat_ws("\n\n", *parts, F.lit("## Task Output\n"))


def choose_template(error: str | Column, target: str | Column, scored: tuple[str, ...] = ("pareto_scores",), sized: tuple[str, ...] = ("num_functions", "max_call_chain_depth", "average_function_lines")) -> Column:
    """Which prompt comes next: fix_optdsl, fix, feedback_score or feedback_complexity; an unknown target is an error."""
    error, target = _col(error), _col(target)
    return (
        F.when(F.lower(error) == "optdsl error", "fix_optdsl").when(error.isNotNull(), "fix").when(target.isin(*scored), "feedback_score").when(target.isin(*sized), "feedback_complexity")
        .otherwise(F.raise_error(F.concat(F.lit("unknown target "), F.coalesce(target, F.lit("null")))))
    )


def matching_lines(c: str | Column, keep) -> Column:
    return F.array_join(F.filter(F.split(_col(c), "\n"), keep), "\n")


def classify_failure(parse_error: Column, compile_code: Column, compile_out: Column, run_code: Column, run_err: Column, synth_code: Column, synth_timeout: Column, synth_out: Column, optdsl_code: Column, model_timeout: Column | None = None, prompt_too_long: Column | None = None) -> Column:
    """``struct<stage, detail>`` of the first stage that failed; null where all passed."""
    row = lambda stage, detail: F.struct(F.lit(stage).alias("stage"), detail.cast("string").alias("detail"))
    out = F.when(F.coalesce(model_timeout if model_timeout is not None else F.lit(False), F.lit(False)), row("model_timeout", F.lit(None)))
    out = out.when(F.coalesce(prompt_too_long if prompt_too_long is not None else F.lit(False), F.lit(False)), row("prompt_too_long", F.lit(None)))
    out = out.when(F.coalesce(parse_error, F.lit(False)), row("parse", F.lit(None)))
    out = out.when(compile_code != 0, row("compile", matching_lines(compile_out, lambda x: x.contains("error: "))))
    out = out.when(run_code != 0, row("run", F.when(F.coalesce(run_err, F.lit("")) == "", F.concat(F.lit("empty stderr, exit code "), run_code.cast("string"), F.lit(": segfault or critical error"))).otherwise(F.substring(run_err, 1, 1000))))
    out = out.when((synth_code != 0) & F.coalesce(synth_timeout, F.lit(False)), row("synth_timeout", F.lit(None)))
    out = out.when(synth_code != 0, row("synth", matching_lines(synth_out, lambda x: x.startswith("ERROR: "))))
    return out.when(optdsl_code == 1, row("optdsl", F.lit("OptDSL error")))


def parse_directives(df: DataFrame, text: str, keys: list[str]) -> DataFrame:
    """One row per directive line: keys, ``line, kind, func, label, factor, ptype, dim, var, raw``.

    Blank lines, comments and other commands are passed over; a pipeline or unroll target without a slash is an error.
    """
    lines = df.select(*keys, F.posexplode(F.split(text, "\n")).alias("line", "raw")).withColumn("raw", F.btrim("raw", F.lit(" \t\r")))
    kind = F.regexp_extract("raw", r"^set_directive_(pipeline|unroll|array_partition)\b", 1)
    lines = lines.where((F.col("raw") != "") & ~F.col("raw").startswith("#")).withColumn("kind", kind).where("kind <> ''")
    words = F.split("raw", r"\s+")
    last, before = F.element_at(words, -1), F.try_element_at(words, F.lit(-2))
    option = lambda name, pattern: F.nullif(F.regexp_extract("raw", rf"-{name}\s+({pattern})", 1), F.lit(""))
    array = F.col("kind") == "array_partition"
    target = F.when(array, None).when(last.contains("/"), last).otherwise(F.raise_error(F.concat(F.lit("target without a label: "), F.col("raw"))).cast("string"))
    return lines.select(
        *keys, "line", "kind", F.when(array, before).otherwise(F.substring_index(target, "/", 1)).alias("func"), F.substring_index(target, "/", -1).alias("label"),
        option("factor", r"\d+").cast("int").alias("factor"), F.when(array, option("type", r"\w+")).alias("ptype"), F.when(array, option("dim", r"\d+").cast("int")).alias("dim"), F.when(array, last).alias("var"), "raw",
    )


def trip_count(c: str | Column) -> Column:
    """Iterations of a ``for`` header: the number right of the comparison; null if it is none, 0 when counting down."""
    middle = F.try_element_at(F.split(_col(c), ";"), F.lit(2))
    side = F.regexp_extract(F.replace(middle, F.lit(" "), F.lit("")), r"^.*(?:<=|>=|<|>)(.*)$", 1)
    compared = middle.rlike(r"<=|>=|<|>")
    return F.when(compared, F.regexp_extract(side, r"^(\d+)$", 1).try_cast("int")).when(middle.contains("--"), 0).otherwise(F.raise_error(F.concat(F.lit("no comparison in "), _col(c))).cast("int"))


def extract_source_loops(lines: DataFrame, keys: list[str], line_no: str, text: str) -> DataFrame:
    """``for`` loops per function in order: keys, ``func, loop_ordinal, label, for_text, line``.

    ``lines`` has a row per source line. A line ``name:`` labels the next loop; lines with ``scop`` are passed over.
    """
    ordered = Window.partitionBy(*keys).orderBy(line_no)
    func = F.regexp_extract(text, r"\b\w+\s+(\w+)\s*\([^)]*\)\s*\{", 1)
    df = lines.where(~F.col(text).contains("scop")).withColumn("__func", F.last(F.nullif(func, F.lit("")), ignorenulls=True).over(ordered))
    label = F.nullif(F.regexp_extract(text, r"^\s*(\w+)\s*:\s*$", 1), F.lit(""))
    loop = F.col(text).rlike(r"\bfor\s*\(")
    # a label holds until the next loop: both are numbered by the loops before them
    before = F.coalesce(F.sum(loop.cast("int")).over(ordered.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    df = df.withColumn("__at", before).withColumn("__label", label)
    inner = Window.partitionBy(*keys, "__func", "__at").orderBy(line_no)
    df = df.withColumn("label", F.last("__label", ignorenulls=True).over(inner)).where(loop & F.col("__func").isNotNull())
    number = F.row_number().over(Window.partitionBy(*keys, "__func").orderBy(line_no)) - 1
    return df.select(*keys, F.col("__func").alias("func"), number.alias("loop_ordinal"), "label", F.trim(text).alias("for_text"), F.col(line_no).alias("line"))


def pair_with_next(lines: DataFrame, keys: list[str], line_no: str, is_open: Column, is_match: Column, is_stop: Column | None = None) -> DataFrame:
    """Each opening line with the next matching one: keys, ``ordinal, open_line, match_line``.

    With ``is_stop``, an opening line that meets a stop before its match is an error; one without a match is left out.
    """
    after = Window.partitionBy(*keys).orderBy(line_no).rowsBetween(1, Window.unboundedFollowing)
    df = lines.withColumn("__open", is_open).withColumn("match_line", F.min(F.when(is_match, F.col(line_no))).over(after))
    df = df.withColumn("__stop", F.min(F.when(is_stop, F.col(line_no))).over(after) if is_stop is not None else F.lit(None).cast("long"))
    df = df.where("__open").withColumn("ordinal", F.row_number().over(Window.partitionBy(*keys).orderBy(line_no)) - 1)
    bad = F.col("__stop").isNotNull() & (F.col("match_line").isNull() | (F.col("__stop") < F.col("match_line")))
    line = F.when(bad, F.raise_error(F.concat(F.lit("no comparison before the body, line "), F.col(line_no).cast("string"))).cast("long")).otherwise(F.col("match_line"))
    return df.select(*keys, "ordinal", F.col(line_no).alias("open_line"), line.alias("match_line")).where("match_line is not null")


def pair_loops_with_compare(lines: DataFrame, keys: list[str], line_no: str = "line", text: str = "text") -> DataFrame:
    """In IR text, each ``for.cond`` line of a function with its next ``icmp``."""
    head = Window.partitionBy(*keys).orderBy(line_no)
    func = F.last(F.when(F.col(text).startswith("define"), F.col(text)), ignorenulls=True).over(head)
    df = lines.withColumn("func_define", func).where("func_define is not null")
    found = pair_with_next(df, [*keys, "func_define"], line_no, F.col(text).rlike(r"^for\.cond\d*:"), F.col(text).contains("icmp"), F.col(text).rlike(r"^for\.body"))
    compare = lines.select(*keys, F.col(line_no).alias("match_line"), F.trim(text).alias("compare_text"))
    return found.join(compare, [*keys, "match_line"]).select(*keys, "func_define", F.col("ordinal").alias("loop_ordinal"), "compare_text", F.col("open_line").alias("cond_line"), F.col("match_line").alias("compare_line"))
