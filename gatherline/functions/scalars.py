"""Column functions: flags, numbers out of loose input, keys and labels. Everything stays in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BLANKS = " \t\n\r\x0b\x0c"
EPS = 2.220446049250313e-16

# Where the nine standard metrics lie in an evaluation record.
METRIC_PATHS = {
    "latency_average_cycles": ("vitis_hls_tool_out", "data_tool"),
    "resources_lut_used": ("vitis_hls_tool_out", "data_tool"),
    "resources_ff_used": ("vitis_hls_tool_out", "data_tool"),
    "resources_dsp_used": ("vitis_hls_tool_out", "data_tool"),
    "resources_bram_used": ("vitis_hls_tool_out", "data_tool"),
    "num_functions": ("kernel_ast_out",),
    "max_call_chain_depth": ("kernel_ast_out",),
    "kernel_total_lines": ("kernel_ast_out",),
    "average_function_lines": ("kernel_ast_out",),
}

# Display names of targets and domains.
TARGET_LABELS = {
    "num_functions": "# of Func.",
    "max_call_chain_depth": "Max Call Depth",
    "average_function_lines": "Avg. Func. LoC",
    "pareto_scores": "Pareto Score",
}
DOMAIN_LABELS = {
    "ml_ai": "Machine Learning / AI",
    "sci_sim": "Scientific Simulation",
    "fin_model": "Financial Modeling",
    "eng_sim": "Engineering Simulation",
    "data_big": "Data Analytics / Big Data",
    "gfx_render": "Graphics Rendering",
    "crypto_bc": "Cryptography / Blockchain",
    "telecom_sp": "Telecommunications / Signal Processing",
    "astro": "Astronomy / Astrophysics",
    "health_med": "Healthcare / Medical Imaging",
}

# What the target device has of each resource.
DEVICE_TOTALS = {"LUT": 274080, "FF": 548160, "DSP": 2520, "BRAM": 1824}


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def finite(c: str | Column) -> Column:
    """Null for null, NaN and infinities."""
    c = _col(c).cast("double")
    return F.when(F.isnan(c) | (F.abs(c) == float("inf")), None).otherwise(c)


def is_pass(status: str | Column) -> Column:
    """Whether the trimmed, lower-cased status is 'pass'; never null."""
    return F.coalesce(F.lower(F.btrim(_col(status), F.lit(BLANKS))) == "pass", F.lit(False))


def is_exact_pass(status: str | Column) -> Column:
    """The strict form that seed roll-ups use."""
    return F.coalesce(_col(status) == "Pass", F.lit(False))


def nested_numeric(json: str | Column, path: tuple[str, ...], scale: float = 1.0) -> Column:
    """The finite number at ``path`` of a JSON text, times ``scale``; booleans, numeric strings and gaps are null."""
    where = "$" + "".join(f"['{p}']" for p in path)
    doc = F.try_parse_json(_col(json))
    kind = F.schema_of_variant(F.try_variant_get(doc, where, "variant"))
    number = F.try_variant_get(doc, where, "double") * scale
    return F.when(kind.rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL)"), finite(number))


def coerce_number(c: str | Column, default: float | None = None, kind: str = "string") -> Column:
    """A loose value as a double; null, float NaN, blank and unparsable text give ``default``. ``kind``: its type."""
    c = _col(c)
    if kind == "boolean":
        got = c.cast("double")
    elif kind == "string":
        text = F.lower(F.btrim(c, F.lit(BLANKS)))
        got = F.when(text.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)(e[+-]?\d+)?$"), text.try_cast("double"))
        got = F.when(text.rlike(r"^[+-]?nan$"), F.lit(float("nan"))).when(text.rlike(r"^\+?inf(inity)?$"), F.lit(float("inf"))).when(text.rlike(r"^-inf(inity)?$"), F.lit(float("-inf"))).otherwise(got)
    else:
        got = F.nanvl(c.cast("double"), F.lit(None).cast("double"))
    return F.coalesce(got, F.lit(default).cast("double"))


def first_present(columns: list[str], default: float | None = None) -> Column:
    """The first of some loose text columns that holds a number."""
    return F.coalesce(*[coerce_number(c) for c in columns], F.lit(default).cast("double"))


def normalize_target_list(m: str | Column) -> Column:
    """Map of text: each value's first run of digits as an int, 0 where there is none; a null map is empty."""
    got = F.transform_values(_col(m), lambda _, v: F.coalesce(F.regexp_extract(v, r"(\d+)", 1).try_cast("int"), F.lit(0)))
    return F.coalesce(got, F.expr("cast(map() as map<string,int>)"))


def group_signature(m: str | Column) -> Column:
    """First 8 hex digits of the md5 of ``k:v`` pairs in key order."""
    pairs = F.transform(F.array_sort(F.map_entries(_col(m))), lambda e: F.concat_ws(":", e["key"], e["value"].cast("string")))
    return F.substring(F.md5(F.array_join(pairs, ",")), 1, 8)


def design_point_key(m: str | Column) -> Column:
    """``param-value`` pairs by name, joined by dots; null, 0 and empty values read NA."""
    value = lambda e: F.when(e["value"].isNull() | e["value"].cast("string").isin("", "0"), "NA").otherwise(e["value"].cast("string"))
    return F.array_join(F.transform(F.array_sort(F.map_entries(_col(m))), lambda e: F.concat_ws("-", e["key"], value(e))), ".")


def normalize_model_name(c: str | Column) -> Column:
    return F.lower(F.translate(_col(c), "/- ", "___"))


def short_model_name(c: str | Column) -> Column:
    c = F.replace(_col(c), F.lit("openrouter/"), F.lit(""))
    return F.when(F.length(c) > 42, F.concat(F.substring(c, 1, 39), F.lit("..."))).otherwise(c)


def display_label(c: str | Column, labels: dict[str, str]) -> Column:
    """A known label, else blanks for underscores and capitals for first letters."""
    c = _col(c)
    plain = F.initcap(F.translate(c, "_", " "))
    if not labels:
        return plain
    known = F.create_map(*[F.lit(x) for pair in labels.items() for x in pair])
    return F.coalesce(F.try_element_at(known, c), plain)


def natural_sort_key(c: str | Column) -> Column:
    """A text that sorts as people sort: a run of digits counts as a number, and is led by its length (six places)."""
    runs = F.regexp_extract_all(_col(c), F.lit(r"(\d+|\D+)"), F.lit(1))
    number = lambda r: F.regexp_replace(r, "^0+(?=.)", "")
    led = F.transform(runs, lambda r: F.when(r.rlike(r"^\d+$"), F.concat(F.lpad(F.length(number(r)).cast("string"), 6, "0"), number(r))).otherwise(r))
    return F.array_join(led, "")


def approx_tokens(c: str | Column) -> Column:
    return F.floor(F.length(_col(c)) / 4).cast("long")


def fit_array(c: str | Column, n: int | Column, zero: float = 0.0) -> Column:
    """Padded with zeros or cut to length n; null is empty."""
    n = F.lit(n) if isinstance(n, int) else n
    return F.slice(F.concat(F.coalesce(_col(c), F.expr("cast(array() as array<double>)")), F.array_repeat(F.lit(zero), n)), F.lit(1), n)


def fit_matrix(c: str | Column, rows: int, columns: int) -> Column:
    """A list of rows, each fitted to ``columns``, cut or padded to ``rows``."""
    full = F.transform(F.coalesce(_col(c), F.expr("cast(array() as array<array<double>>)")), lambda r: fit_array(r, columns))
    return F.slice(F.concat(full, F.array_repeat(F.array_repeat(F.lit(0.0), columns), rows)), 1, rows)


def first_scalar(c: str | Column) -> Column:
    """An array's first element, 0 for none."""
    return F.coalesce(F.try_element_at(_col(c), F.lit(1)), F.lit(0.0))


def split_pair_name(c: str | Column) -> tuple[Column, Column]:
    """"Train-Test" as two trimmed columns."""
    parts = F.split(_col(c), "-", 2)
    return F.trim(F.try_element_at(parts, F.lit(1))), F.trim(F.try_element_at(parts, F.lit(2)))


def pass_at_k(n: str | Column, c: str | Column, k: int) -> Column:
    """Unbiased chance that k of n samples, c of which pass, hold a passing one. Counts that make no sense are an error."""
    n, c = _col(n).cast("long"), _col(c).cast("long")
    if k <= 0:
        raise ValueError("k must be positive")
    bad = (n <= 0) | (c < 0) | (c > n)
    none = F.aggregate(F.sequence(n - c + 1, n), F.lit(1.0), lambda acc, i: acc * (1 - F.lit(k) / i))
    # sequence counts down when its end is below its start, so that c = 0 needs a case of its own
    good = F.when(n - c < k, 1.0).when(c == 0, 0.0).otherwise(1 - none)
    return F.when(bad, F.raise_error(F.concat(F.lit("pass@k of n="), n.cast("string"), F.lit(", c="), c.cast("string"))).cast("double")).otherwise(good)


def map_qor_targets(norm: str = "gnndse", latency: tuple[str, ...] = ("average", "worst", "best"), prefix: str = "synthesis__latency_{}_cycles") -> dict[str, Column]:
    """Training targets out of a quality-of-result row: name → column.

    ``gnndse``: latency becomes log2(1e7 / cycles), resources shares of the device; ``off`` and ``logmse``: as they are.
    """
    if norm not in ("gnndse", "off", "logmse"):
        raise ValueError(f"unknown normalisation {norm}")
    perf = first_present([prefix.format(x) for x in latency], 0.0)
    raw = {
        "syn-LUT": coerce_number("synthesis__resources_lut_used", 0.0),
        "syn-FF": coerce_number("synthesis__resources_ff_used", 0.0),
        "syn-DSP": coerce_number("synthesis__resources_dsp_used", 0.0),
        "syn-BRAM": coerce_number("synthesis__resources_bram_used", 0.0),
        "impl-LUT": coerce_number("`implementation__utilization__Total LUTs`", 0.0),
        "impl-FF": coerce_number("implementation__utilization__FFs", 0.0),
        "impl-DSP": coerce_number("`implementation__utilization__DSP Blocks`", 0.0),
        "impl-BRAM": 2 * coerce_number("implementation__utilization__RAMB36", 0.0) + coerce_number("implementation__utilization__RAMB18", 0.0),
    }
    return qor_normalized(perf, raw, norm)


def qor_normalized(perf: Column, resources: dict[str, Column], norm: str) -> dict[str, Column]:
    if norm == "gnndse":
        perf = F.log2(F.lit(1e7) / F.greatest(perf, F.lit(EPS)))
        resources = {k: v / DEVICE_TOTALS[k.split("-")[1]] for k, v in resources.items()}
    return {"perf": perf} | resources | {"quality": F.lit(0.0), "speedup": F.lit(0.0)}
