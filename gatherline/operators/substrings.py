"""Which texts hold which patterns: an index of fixed-width grams in place of a theta join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Characters of a gram; a shorter pattern is a gram by itself.
WIDTH = 6


def _grams(text: str | Column, width: Column) -> Column:
    """The distinct substrings of ``width`` characters; of width 0 the empty one."""
    text = F.col(text) if isinstance(text, str) else text
    last = F.length(text) - width + 1
    each = F.transform(F.sequence(F.lit(1), last), lambda i: F.substring(text, i, width))
    return F.when(width == 0, F.array(F.lit(""))).when(last > 0, F.array_distinct(each)).otherwise(F.array().cast("array<string>"))


def holding(texts: DataFrame, patterns: DataFrame, keys: list[str], text: str, pattern: str, width: int = WIDTH) -> DataFrame:
    """Distinct ``keys, text, pattern`` where the text of the same keys contains the pattern.

    Of a pattern's grams the one that the fewest texts have is looked up, by equality; what is found is verified. A
    pattern with a gram that no text has needs no look-up. So candidates are as few as the rarest gram allows, whatever the
    number of texts, and the index has one row per character of a distinct text. Nulls hold nothing and are
    held by nothing; an empty pattern is in every text.
    """
    own = texts.select(*keys, text).where(F.col(text).isNotNull()).distinct().withColumn("__tid", F.xxhash64(text))
    asked = patterns.select(*keys, pattern).where(F.col(pattern).isNotNull()).distinct().withColumn("__w", F.least(F.length(pattern), F.lit(width)))
    at = [*keys, "__w", "__gram"]
    wanted = asked.withColumn("__gram", F.explode(_grams(pattern, F.col("__w"))))
    index = own.join(asked.select(*keys, "__w").distinct(), keys).select(*keys, "__w", "__tid", F.explode(_grams(text, F.col("__w"))).alias("__gram"))
    index = index.join(wanted.select(*at).distinct(), at, "left_semi")
    many = index.groupBy(*at).agg(F.count("*").alias("__n"))
    best = wanted.join(many, at, "left").groupBy(*keys, "__w", pattern).agg(F.min(F.struct(F.coalesce("__n", F.lit(0)).alias("n"), F.col("__gram").alias("gram"))).alias("__best"))
    rare = best.where("__best.n > 0").select(*keys, "__w", pattern, F.col("__best.gram").alias("__gram"))
    found = rare.join(index, at).select(*keys, pattern, "__tid")
    return found.join(own, [*keys, "__tid"]).where(F.col(text).contains(F.col(pattern))).select(*keys, text, pattern)
