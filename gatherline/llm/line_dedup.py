"""Operator 11: lines that many documents share are dropped, found in sharded perfect-hash arrays.

1. One pass hashes each document's distinct line keys; a chunk of documents sends every shard (a range of the hash
   space) one coded list of its distinct hashes, with how many of its documents have each (exchange.py).
2. A shard adds the lists up and builds a minimal perfect hash over its distinct hashes (perfect_hash.py), which numbers
   two compact arrays: a fingerprint of 16 bits, and the number of documents, which stops at the threshold.
3. Documents probe the arrays. Where their counted size fits a broadcast, in the pass that writes the result. Else
   the chunks' lists, packed as they are, meet the arrays of their shard and are answered with one bit a hash.

Lines are never joined, and no row stands for a single line.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BROADCAST_BYTES, bits, blocks, keyed_documents, lower_ascii, packed, shuffle_partitions, sized_join, unbits, unpacked, written
from .exchange import expanded, golomb_decode, keyed_pass
from .hashing import U, mix, owner_of
from .perfect_hash import build, slots

#: Lines of the table for each shard, about: what one task holds decoded.
SHARD_LINES = 2_000_000
_BLANK = b" \t\n\v\f\r"
_MARK = 0xD1B54A32D192ED03


def line_keys(text: bytes, min_chars: int = 1) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """(lines, hash of each line's key, whether the key has ``min_chars`` code points)."""
    keys = [x.strip(_BLANK) for x in lower_ascii(text).split(b"\n")]
    long = [len(k) >= min_chars and (min_chars < 2 or len(k.decode()) >= min_chars) for k in keys]
    return text.split(b"\n"), np.fromiter(map(xxhash.xxh3_64_intdigest, keys), U, len(keys)), np.array(long, bool)


def _fingerprint(keys: np.ndarray) -> np.ndarray:
    return (mix(keys ^ U(_MARK)) >> U(48)).astype(np.uint16)


def shard_arrays(keys: np.ndarray, counts: np.ndarray, most: int) -> bytes:
    """Perfect hash, fingerprints and counts (up to ``most``) of a shard's distinct hashes."""
    levels = build(keys)
    at = slots(levels, keys)
    prints, held = np.zeros(len(keys), np.uint16), np.zeros(len(keys), np.min_scalar_type(most))
    prints[at], held[at] = _fingerprint(keys), np.minimum(counts, most)
    return packed((levels, prints, held))


def probe(arrays: tuple, keys: np.ndarray) -> np.ndarray:
    """How many documents have each hash, up to the threshold; 0 for hashes that no line has (but one in 2^16)."""
    levels, prints, held = arrays
    at = slots(levels, keys)
    known = at >= 0
    known[known] = prints[at[known]] == _fingerprint(keys[known])
    out = np.zeros(len(keys), np.int64)
    out[known] = held[at[known]]
    return out


class LineIndex:
    """The shards' arrays in a worker."""

    def __init__(self, rows: dict[int, bytes], shards: int):
        self.shards, self.rows, self.open = shards, rows, {}

    def counts(self, keys: np.ndarray) -> np.ndarray:
        """Of sorted hashes, which so lie shard by shard."""
        out, cut = np.zeros(len(keys), np.int64), np.searchsorted(owner_of(keys, self.shards), np.arange(self.shards + 1))
        for s in np.flatnonzero(np.diff(cut)).tolist():
            if s in self.rows:
                arrays = self.open.get(s) or self.open.setdefault(s, unpacked(self.rows[s]))
                out[cut[s] : cut[s + 1]] = probe(arrays, keys[cut[s] : cut[s + 1]])
        return out


def _of_shard(rows: pd.DataFrame, most: int) -> pd.DataFrame:
    lists = [unpacked(p) for p in rows["payload"]]
    keys, place = np.unique(np.concatenate([golomb_decode(x) for x, _ in lists]), return_inverse=True)
    counts = np.bincount(place, np.concatenate([n for _, n in lists]).astype(float), len(keys)).astype(np.int64)
    return pd.DataFrame({"shard": rows["owner"].iloc[:1], "n": [len(keys)], "arrays": [shard_arrays(keys, counts, most)]})


def _answers(lists: pd.DataFrame, index: pd.DataFrame, least: int) -> pd.DataFrame:
    """A shard: the chunks' lists against its arrays, one bit for each hash."""
    arrays = unpacked(index["arrays"].iloc[0])
    out, n = [], []
    for payload in lists["payload"]:
        hit = probe(arrays, golomb_decode(unpacked(payload)[0])) >= least
        out.append(packed((bits(hit), bits(np.zeros(len(hit), bool)))))
        n.append(len(hit))
    return pd.DataFrame({"chunk": lists["chunk"], "owner": lists["owner"], "payload": out, "n": n})


def _kept(doc: list, texts: list[bytes], min_chars: int, gone_of: Callable, with_text: bool) -> pa.RecordBatch:
    """``gone_of(lists)``: for each document which of its distinct sorted hashes go."""
    out: dict[str, list] = {"doc_id": doc, "n_lines": [], "n_dropped": [], "kept_sha256": []} | ({"kept_text": []} if with_text else {})
    found = [line_keys(t, min_chars) for t in texts]
    distinct = [np.unique(keys[long], return_inverse=True) for _, keys, long in found]
    for text, (lines, _, long), (_, place), flags in zip(texts, found, distinct, gone_of([d for d, _ in distinct]), strict=True):
        gone = np.zeros(len(lines), bool)
        gone[long] = flags[place]
        kept = b"\n".join([x for x, g in zip(lines, gone.tolist(), strict=True) if not g]) if gone.any() else text
        out["n_lines"].append(len(lines))
        out["n_dropped"].append(int(gone.sum()))
        out["kept_sha256"].append(hashlib.sha256(kept).hexdigest())
        if with_text:
            out["kept_text"].append(kept.decode())
    return pa.RecordBatch.from_pydict({k: pa.array(v, pa.string() if k.startswith("kept") else pa.int64()) for k, v in out.items()})


def _parts(flags: np.ndarray, like: list[np.ndarray]) -> list[np.ndarray]:
    return np.split(flags, np.cumsum([len(x) for x in like])[:-1])


def line_index(spark: SparkSession, keyed: DataFrame, min_docs: int, min_chars: int, shard_lines: int = SHARD_LINES) -> tuple[DataFrame, DataFrame, int]:
    """(the shards' arrays ``shard, n, arrays``; the pass over the documents; the number of shards)."""
    text = F.col("text").cast("string")
    lines = keyed.agg(F.sum(F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + 1)).first()[0] or 0
    shards = max(shuffle_partitions(spark), -(-lines // shard_lines))

    def keys_of(texts: list[bytes], _batch: pa.RecordBatch) -> tuple[dict, np.ndarray, np.ndarray]:
        found = [line_keys(t, min_chars) for t in texts]
        distinct = [np.unique(keys[long]) for _, keys, long in found]
        return {}, np.concatenate(distinct), np.array([len(x) for x in distinct], np.int64)

    table = keyed_pass(spark, keyed, keys_of, "", "line_hashes", owners=shards)
    made = table.where("owner >= 0").select("owner", "payload").groupBy("owner").applyInPandas(lambda rows: _of_shard(rows, min_docs), "shard int, n long, arrays binary")
    return written(spark, made, "line_index"), table, shards


def drop_shared_lines(
    spark: SparkSession, docs: DataFrame, min_docs: int = 10, min_chars: int = 1, id_col: str = "doc_id", text_col: str = "text",
    with_text: bool = False, broadcast_bytes: int = BROADCAST_BYTES, shard_lines: int = SHARD_LINES,
) -> DataFrame:
    """One row per document: ``doc_id, n_lines, n_dropped, kept_sha256`` (and ``kept_text``).

    A text is split at line breaks (null and empty texts are one empty line). A line's key is the line without ASCII
    white space at its ends and with A-Z in lower case. All lines whose key has at least ``min_chars`` code points and
    is found in at least ``min_docs`` documents go; a line that one document repeats counts once. The others stay,
    joined by line breaks. Rows that repeat an id or a whole document are documents of their own, null ids too; other
    columns are left behind; an empty table gives no rows. Keys are equal if their 64-bit hashes are.
    """
    keyed = keyed_documents(docs, id_col, text_col)
    index, table, shards = line_index(spark, keyed, min_docs, min_chars, shard_lines)
    schema = "doc_id long, n_lines long, n_dropped long, kept_sha256 string" + (", kept_text string" if with_text else "")
    if (index.agg(F.sum(F.length("arrays"))).first()[0] or 0) <= broadcast_bytes:
        held = spark.sparkContext.broadcast({r["shard"]: bytes(r["arrays"]) for r in index.collect()})

        def probed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            arrays = LineIndex(held.value, shards)

            def gone(lists: list[np.ndarray]) -> list[np.ndarray]:
                keys, place = np.unique(np.concatenate(lists), return_inverse=True)  # a block's hashes are probed together
                return _parts((arrays.counts(keys) >= min_docs)[place], lists)

            for batch, texts in blocks(batches):
                yield _kept(batch.column(batch.schema.get_field_index("doc_id")).to_pylist(), texts, min_chars, gone, with_text)

        return keyed.mapInArrow(probed, schema)
    lists = table.where("owner >= 0").select("chunk", "owner", "payload")
    answers = lists.groupBy("owner").cogroup(index.groupBy("shard")).applyInPandas(lambda a, b: _answers(a, b, min_docs), "chunk long, owner int, payload binary, n long")
    masks = written(spark, expanded(table, answers).groupBy("rid", "fp").agg(F.first("mask").alias("mask")), "line_masks")

    def masked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in blocks(batches):
            mask = batch.column(batch.schema.get_field_index("mask")).to_pylist()
            gone = lambda lists, mask=mask: [unbits(m, len(x)) if m else np.zeros(len(x), bool) for m, x in zip(mask, lists, strict=True)]
            yield _kept(batch.column(batch.schema.get_field_index("doc_id")).to_pylist(), texts, min_chars, gone, with_text)

    return sized_join(keyed, masks, ["rid", "fp"], "left", "mask").select("doc_id", "text", "mask").mapInArrow(masked, schema)
