"""Stage functions keep the user's columns, whatever their names; test items keep their ids on both ways of joining."""

import random

import pytest

from gatherline.llm import decontam, jaccard_join, langid
from gatherline.llm.exact_dedup import without_duplicates


def words(rng, n):
    return " ".join(f"w{rng.randrange(3000)}" for _ in range(n))


@pytest.mark.parametrize("stage", [
    lambda s, d, t: langid.in_known_language(s, d), lambda s, d, t: without_duplicates(s, d), lambda s, d, t: jaccard_join.one_of_each(s, d, n=5, share=80), decontam.without_overlap,
])
def test_columns_with_names_of_the_stages(spark, stage):
    rng = random.Random(3)
    rows = [(i, words(rng, 60), "en", f"mine {i}", i, -i, None, "x", "y") for i in range(30)] + [(31, None, "en", "mine 31", 31, -31, None, "x", "y")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, __text string, __rid long, __fp int, __none string, keeps string, root string")
    tests = spark.createDataFrame([(1, words(rng, 30))], "item_id long, text string")
    got = stage(spark, df, tests)
    assert got.columns == df.columns
    assert {tuple(r) for r in got.collect()} | {rows[-1]} == set(rows)


@pytest.mark.parametrize("block_tokens", [5, decontam.BLOCK_TOKENS])
def test_ids_of_items(spark, block_tokens):
    rng = random.Random(4)
    items = [(-5, words(rng, 30)), (7, words(rng, 30)), (None, words(rng, 30)), (-5, words(rng, 30)), (-1, "single phrase of five words"), (0, None)]
    docs = [(n, f"{words(rng, 20)} {t} {words(rng, 20)}") for n, (_, t) in enumerate(items) if t] + [(9, f"{items[0][1]} {items[1][1]}")]
    found = decontam.contaminated(spark, spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), block_tokens=block_tokens)
    assert sorted(((r.doc_id, r.item_id) for r in found.collect()), key=str) == sorted([(0, -5), (1, 7), (2, None), (3, -5), (4, -1), (9, -5), (9, 7)], key=str)
