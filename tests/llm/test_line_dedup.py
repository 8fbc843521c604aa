"""Operator 11 against counting lines in a dictionary, both ways of probing; its perfect hash by itself."""

import collections
import hashlib
import random

import numpy as np
import pytest

from gatherline.llm import perfect_hash
from gatherline.llm.common import unpacked
from gatherline.llm.line_dedup import drop_shared_lines, line_index, probe, shard_arrays

SCHEMA = "doc_id long, text string, owner int, mask string, shard int, rid int"
BLANK = " \t\n\x0b\x0c\r"


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)


def plain(rows, min_docs, min_chars):
    split = [(t or "").split("\n") for _, t in rows]
    key = lambda x: lower(x.strip(BLANK))
    seen = collections.Counter(k for lines in split for k in {key(x) for x in lines})
    out = collections.Counter()
    for (i, _), lines in zip(rows, split, strict=True):
        kept = [x for x in lines if len(key(x)) < min_chars or seen[key(x)] < min_docs]
        out[i, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest(), "\n".join(kept)] += 1
    return out


def rows():
    rng = random.Random(11)
    pool = ["Shared line", " shared LINE\t", "é", "É", "\xa0nbsp\xa0", "x", "", "  ", "\r", "Über", "über", "long " * 900, "a\x0bb"] + [f"line {i}" for i in range(60)]
    out = [(i, "\n".join(rng.choice(pool) for _ in range(rng.randrange(1, 25)))) for i in range(120)]
    out += [(i, "\n".join(f"own {i} {j}" for j in range(3)) + "\n") for i in range(120, 150)]
    return [*out, (200, None), (201, ""), (202, "\n"), (203, "\n" * 4000), (None, "Shared line"), (None, None), (5, out[5][1]), (5, out[5][1]), (-3, "x\nx\nx")]


@pytest.mark.parametrize("min_docs,min_chars", [(10, 1), (3, 2), (1, 1), (300, 5)])
@pytest.mark.parametrize("broadcast_bytes,shard_lines", [(1 << 25, 2_000_000), (0, 40)])
def test_against_counting(spark, min_docs, min_chars, broadcast_bytes, shard_lines):
    df = spark.createDataFrame([(i, t, 1, "m", 2, 3) for i, t in rows()], SCHEMA).repartition(5)
    got = drop_shared_lines(spark, df, min_docs, min_chars, with_text=True, broadcast_bytes=broadcast_bytes, shard_lines=shard_lines)
    assert collections.Counter(map(tuple, got.collect())) == plain(rows(), min_docs, min_chars)


@pytest.mark.parametrize("broadcast_bytes", [1 << 25, 0])
def test_empty_tables_and_texts(spark, broadcast_bytes):
    assert drop_shared_lines(spark, spark.createDataFrame([], SCHEMA), broadcast_bytes=broadcast_bytes).count() == 0
    got = drop_shared_lines(spark, spark.createDataFrame([(1, None, 1, "", 1, 1), (None, "", 1, "", 1, 1)], SCHEMA), min_docs=1, broadcast_bytes=broadcast_bytes).collect()
    assert sorted(map(tuple, got), key=str) == [(1, 1, 0, hashlib.sha256(b"").hexdigest()), (None, 1, 0, hashlib.sha256(b"").hexdigest())]


def test_index_counts_documents(spark):
    from gatherline.llm.common import keyed_documents

    df = spark.createDataFrame([(i, "one\none\n" + ("two" if i % 2 else f"only {i}"), 1, "", 1, 1) for i in range(8)], SCHEMA)
    index, _, _ = line_index(spark, keyed_documents(df), 100, 1)
    held = np.concatenate([unpacked(r.arrays)[2] for r in index.collect()])
    assert sorted(held.tolist()) == [1, 1, 1, 1, 4, 8]


@pytest.mark.parametrize("n", [0, 1, 2, 63, 5000, 200_000])
def test_perfect_hash(n):
    rng = np.random.default_rng(n)
    keys = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2))
    levels = perfect_hash.build(keys)
    assert sorted(perfect_hash.slots(levels, keys).tolist()) == list(range(len(keys)))
    assert n < 5000 or 64 * len(levels[1]) < 5 * len(keys)
    counts = rng.integers(1, 400, len(keys))
    arrays = unpacked(shard_arrays(keys, counts, 300))
    assert (probe(arrays, keys) == np.minimum(counts, 300)).all()
    others = keys + np.uint64(1)
    assert (probe(arrays, others) > 0).mean() < 0.001 if n else not len(probe(arrays, others))
