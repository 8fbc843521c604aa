"""Design spaces as option tables.

``options``: space, param, option, parent_param, parent_option (both null for a free parameter).
"""

from __future__ import annotations

import hashlib
import json
import math

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .codegraph import materialized

#: Points that enumerate_points makes without a sample size.
MOST_POINTS = 10_000_000


def design_space_size(options: DataFrame) -> DataFrame:
    """``space, num_points``: the product over free parameters, each the sum over its options of the product over its children.

    Levels of dependency are folded from the leaves up, all spaces at once, a written table a level; options are counted before. Only
    the deepest level reaches the driver.
    """
    spark = options.sparkSession
    rows = options.select("space", "param", "option", "parent_param", "parent_option").distinct()
    rows = materialized(spark, leveled(rows).withColumn("ways", F.lit(1).cast("double")))
    for level in range(rows.agg(F.max("level")).first()[0] or 0, 0, -1):
        mine, rest = rows.where(F.col("level") == level), rows.where(F.col("level") < level)
        child = mine.groupBy("space", F.col("parent_param").alias("param"), F.col("parent_option").alias("option"), F.col("param").alias("child")).agg(F.sum("ways").alias("ways"))
        # every option of the parent needs each child; a child without options under it leaves no point
        needed = mine.select("space", F.col("parent_param").alias("param"), F.col("param").alias("child")).distinct()
        full = rest.join(needed, ["space", "param"], "left").join(child.withColumnRenamed("ways", "child_ways"), ["space", "param", "option", "child"], "left")
        product = F.aggregate(F.collect_list(F.when(F.col("child").isNotNull(), F.coalesce("child_ways", F.lit(0.0)))), F.lit(1.0), lambda a, x: a * x)
        rows = materialized(spark, full.groupBy("space", "param", "option", "parent_param", "parent_option", "level").agg((F.first("ways") * product).alias("ways")))
    per = rows.groupBy("space", "param").agg(F.sum("ways").alias("n"))
    return per.groupBy("space").agg(F.aggregate(F.collect_list("n"), F.lit(1.0), lambda a, x: a * x).cast("long").alias("num_points"))


def leveled(rows: DataFrame) -> DataFrame:
    """``rows`` with the ``level`` of each parameter: free ones are 0, others one more than the parameter they depend on.

    Pointer doubling on the table of parameters: after n rounds each knows its distance from the one 2^n above it, so rounds grow with
    the logarithm of the depth. Parameters that depend on each other in a circle are an error.
    """
    spark = rows.sparkSession
    above = F.max("parent_param")
    far = rows.groupBy("space", "param").agg(above.alias("above"), F.when(above.isNull(), 0).otherwise(1).alias("level"))
    far = materialized(spark, far)
    most = far.groupBy("space").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    for _ in range(most.bit_length() + 1):
        if not far.where("above is not null").limit(1).count():
            break
        ahead = far.select("space", F.col("param").alias("above"), F.col("above").alias("__above"), F.col("level").alias("__level"))
        step = far.join(ahead, ["space", "above"], "left")
        far = materialized(spark, step.select("space", "param", F.col("__above").alias("above"), (F.col("level") + F.coalesce("__level", F.lit(0))).alias("level")))
    else:
        circle = far.where("above is not null").select("space").first()
        if circle:
            raise ValueError(f"parameters of {circle['space']} depend on each other in a circle")
    return rows.join(far.select("space", "param", "level"), ["space", "param"])


def check_design_space(params: DataFrame, deps: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(``space, num_errors``; ``space, param, children`` distinct and in order).

    Errors: a parameter that depends on itself or on an unknown one, or lacks options or a default.
    """
    own = deps.where(F.col("param") == F.col("depends_on")).select("space")
    unknown = deps.join(params.select("space", F.col("param").alias("depends_on")), ["space", "depends_on"], "left_anti").select("space")
    lacking = params.select("space", F.explode(F.array_compact(F.array(F.when(~F.coalesce("has_options", F.lit(False)), "options"), F.when(F.col("default").isNull(), "default"))))).select("space")
    errors = own.unionAll(unknown).unionAll(lacking).groupBy("space").agg(F.count("*").alias("n"))
    every = params.select("space").distinct().join(errors, "space", "left").select("space", F.coalesce("n", F.lit(0)).alias("num_errors"))
    children = deps.groupBy("space", F.col("depends_on").alias("param")).agg(F.array_sort(F.collect_set("param")).alias("children"))
    return every, children


def enumerate_points(options: DataFrame, n: int | None = None, seed: int = 64, most: int = MOST_POINTS) -> DataFrame:
    """``space, point`` (map), ``point_key``: all points of each space, or ``n`` of each by seeded draws.

    All points: the n-th parameters of all spaces are joined on together, free ones before those that depend on them; more than ``most`` points
    in all without ``n`` is an error. A sample enumerates nothing: see sample_points.
    """
    from ..functions.scalars import design_point_key

    if n is not None:
        return sample_points(options, n, seed).withColumn("point_key", design_point_key("point"))
    total = design_space_size(options).agg(F.sum("num_points")).first()[0] or 0
    if total > most:
        raise ValueError(f"{total} points; give n to sample")
    rows = options.select("space", "param", F.col("option").cast("string").alias("option"), "parent_param", F.col("parent_option").cast("string").alias("parent_option")).distinct()
    place = F.dense_rank().over(Window.partitionBy("space").orderBy("level", "param"))  # the parameters of one space
    rows = materialized(options.sparkSession, leveled(rows).withColumn("place", place))
    points = rows.select("space").distinct().withColumn("point", F.expr("cast(map() as map<string,string>)"))
    for nth in range(1, (rows.agg(F.max("place")).first()[0] or 0) + 1):
        mine = rows.where(F.col("place") == nth).select(F.col("space").alias("__s"), "param", "option", "parent_param", "parent_option")
        has = mine.select(F.col("__s").alias("space")).distinct().withColumn("__has", F.lit(True))
        points = points.join(has, "space", "left")
        fits = F.col("parent_param").isNull() | (F.try_element_at("point", F.col("parent_param")) == F.col("parent_option"))
        grown = points.where("__has").join(mine, (F.col("space") == F.col("__s")) & fits).select("space", F.map_concat("point", F.create_map("param", "option")).alias("point"))
        points = grown.unionByName(points.where("__has is null").select("space", "point"))
    return points.withColumn("point_key", design_point_key("point"))


def sample_points(options: DataFrame, n: int, seed: int = 64) -> DataFrame:
    """``space, point``: ``n`` distinct points of each space, or all if it has no more, whatever its size.

    Points are numbered in order of their options, free parameters first (then by name), options as text. The j-th draw
    is the number that md5 of seed, space and j gives, modulo the number of points; draws that repeat are passed over. A
    task decodes the numbers of a space from its options, which are few.
    """
    kind = options.schema["space"].dataType.simpleString()

    def draw(pdf: pd.DataFrame) -> pd.DataFrame:
        space = pdf["space"].iloc[0]
        params: dict[str, list[tuple[str, str | None, str | None]]] = {}
        for name, option, parent, of in sorted(set(zip(pdf["param"], pdf["option"], pdf["parent_param"], pdf["parent_option"], strict=True)), key=lambda r: tuple("" if x is None else x for x in r)):
            params.setdefault(name, []).append((option, parent, of))
        parent_of = {name: rows[0][1] for name, rows in params.items()}

        def depth(name: str) -> int:
            steps = 0
            while parent_of.get(name) is not None:
                name, steps = parent_of[name], steps + 1
                if steps > len(params):
                    raise ValueError(f"parameters of {space} depend on each other in a circle")
            return steps

        order = sorted(params, key=lambda p: (depth(p), p))
        children = {p: [c for c in order if parent_of[c] == p] for p in params}

        def ways(name: str, option: str) -> int:
            """Points below an option of a parameter."""
            return math.prod(sum(ways(c, o) for o, _, of in params[c] if of == option) for c in children[name])

        total = math.prod(sum(ways(p, o) for o, _, _ in params[p]) for p in order if parent_of[p] is None)
        numbers: dict[int, None] = dict.fromkeys(range(total)) if total <= n else {}
        j = 0
        while len(numbers) < min(n, total):
            digest = hashlib.md5(f"{seed}:{space}:{j}".encode()).hexdigest()
            numbers.setdefault(int(digest[:15] if total < 1 << 48 else digest, 16) % total)
            j += 1
        points = []
        for number in numbers:
            point: dict[str, str] = {}
            # completions of what is chosen: those below chosen options, times those of free parameters to come
            below = total
            for p in order:
                if parent_of[p] is not None and parent_of[p] not in point:
                    continue
                fitting = [o for o, parent, of in params[p] if parent is None or of == point[parent]]
                each = {o: ways(p, o) for o in fitting}
                if not sum(each.values()):
                    continue
                rest = below // sum(each.values())
                for o in fitting:
                    if number < each[o] * rest:
                        point[p], below = o, each[o] * rest
                        break
                    number -= each[o] * rest
            points.append(json.dumps(point))
        return pd.DataFrame({"space": [space] * len(points), "point": points})

    rows = options.select("space", "param", F.col("option").cast("string").alias("option"), "parent_param", F.col("parent_option").cast("string").alias("parent_option")).distinct()
    drawn = rows.groupBy("space").applyInPandas(draw, f"space {kind}, point string")
    return drawn.select("space", F.from_json("point", "map<string,string>").alias("point"))
