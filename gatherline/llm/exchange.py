"""Golomb-coded exchange of hashes: which of my keys occur anywhere else?

Each chunk of a table (a bounded run of rows of one partition) sorts its distinct keys, cuts them by owner (a range of
the hash space) and sends every owner one Golomb-Rice coded list. An owner decodes all lists, finds the keys that
occur twice, and answers every chunk with one bit a key. Only the coded lists and the bitmaps travel; a key held by
a third of all rows is sent once a chunk. No list of all keys meets in one place. Owners also flag keys that occur
more often than a given number of times: the callers' hot groups.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from .common import bits, blocks, packed, shuffle_partitions, unbits, unpacked, written
from .hashing import U, owner_of

#: Keys that a chunk holds at most (one row may exceed it).
CHUNK_KEYS = 1 << 20


def golomb_encode(keys: np.ndarray) -> bytes:
    """Sorted distinct 64-bit keys as Rice-coded gaps: quotients in unary, remainders in b bits."""
    n = len(keys)
    if not n:
        return b""
    gaps = np.diff(keys, prepend=U(0))
    b = max(0, min(63, int(np.log2(max(1.0, float(keys[-1] - keys[0]) / n)))))
    quotient = (gaps >> U(b)).astype(np.int64)
    first, quotient[0] = gaps[0], 0
    unary = np.zeros(int(quotient.sum()) + n, np.uint8)
    unary[np.cumsum(quotient + 1) - 1] = 1
    rest = gaps & U((1 << b) - 1)
    low = np.unpackbits(rest.astype(">u8").view(np.uint8).reshape(n, 8), axis=1)[:, 64 - b :] if b else np.zeros((n, 0), np.uint8)
    head = np.array([n, b, len(unary)], "<u8").tobytes() + np.array([first], "<u8").tobytes()
    return head + np.packbits(unary).tobytes() + np.packbits(low.ravel()).tobytes()


def golomb_decode(data: bytes) -> np.ndarray:
    if not data:
        return np.zeros(0, U)
    n, b, length = (int(x) for x in np.frombuffer(data, "<u8", 3))
    first = np.frombuffer(data, "<u8", 1, 24)[0]
    at = 32 + (length + 7) // 8
    ones = np.flatnonzero(np.unpackbits(np.frombuffer(data, np.uint8, at - 32, 32), count=length))
    gaps = (np.diff(ones, prepend=-1) - 1).astype(U) << U(b)
    if b:
        wide = np.zeros((n, 64), np.uint8)
        wide[:, 64 - b :] = np.unpackbits(np.frombuffer(data, np.uint8, offset=at), count=n * b).reshape(n, b)
        gaps |= np.packbits(wide, axis=1).view(">u8").ravel().astype(U)
    gaps[0] = first
    return np.cumsum(gaps, dtype=U)


def key_bits(rows: int) -> int:
    """Bits that tell the keys of this many rows apart: with up to 2^8 keys a row, one in 2^14 meets another by chance."""
    return min(64, max(32, -(-(max(1, rows).bit_length() + 8 + 14) // 8) * 8))


def messages(held: list[np.ndarray], owners: int, key_bits: int = 64) -> list[tuple[int, bytes]]:
    """(owner, coded list) for the keys of a chunk: sorted, distinct, with how often the chunk has each."""
    keys, counts = np.unique(np.concatenate(held), return_counts=True)
    cut = np.searchsorted(owner_of(keys, owners), np.arange(owners + 1))
    keys = keys >> U(64 - key_bits)
    return [(o, packed((golomb_encode(keys[a:b]), counts[a:b].astype(np.uint8 if counts[a:b].max() < 256 else np.uint32)))) for o, (a, b) in enumerate(zip(cut[:-1], cut[1:], strict=True)) if b > a]


def keyed_pass(spark: SparkSession, docs: DataFrame, keys_of: Callable, extra: str, tag: str, chunk_keys: int = CHUNK_KEYS, block_bytes: int = 1 << 20, key_bits: int = 64, owners: int | None = None) -> DataFrame:
    """One pass over the texts that writes, side by side, a row per document and the messages to the owners.

    ``keys_of(texts, batch)`` returns (extra columns as a dict of lists, all keys, keys of each text). The table has
    ``chunk, owner, doc_id, rid, fp, payload`` and the extra columns; owner is -1 in a document's row, whose payload
    holds its keys. Of each key only the first ``key_bits`` bits are kept where equality is verified later on.
    """
    cut, wide = U(((1 << key_bits) - 1) << (64 - key_bits)), key_bits // 8
    owners = owners or shuffle_partitions(spark)
    names = [x.split()[0] for x in extra.split(",") if x]
    schema = "chunk long, owner int, doc_id long, rid long, fp long, payload binary" + (f", {extra}" if extra else "")
    target = pa.schema([("chunk", pa.int64()), ("owner", pa.int32()), ("doc_id", pa.int64()), ("rid", pa.int64()), ("fp", pa.int64()), ("payload", pa.binary())])

    def message(chunk: int, held: list[np.ndarray]) -> pa.RecordBatch:
        rows = messages(held, owners, key_bits)
        none = [None] * len(rows)
        return pa.RecordBatch.from_pydict({"chunk": [chunk] * len(rows), "owner": [r[0] for r in rows], "doc_id": none, "rid": none, "fp": none, "payload": [r[1] for r in rows]}, target)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 24
        held, count, types = [], 0, None
        for batch, texts in blocks(batches, block_bytes):
            more, keys, each = keys_of(texts, batch)
            ends = np.cumsum(each)
            keys = keys & cut
            short = keys if wide == 8 else np.ascontiguousarray(keys.astype(">u8").view(np.uint8).reshape(-1, 8)[:, :wide])
            payload = [short[e - n : e].tobytes() for e, n in zip(ends, each, strict=True)]
            cols = {c: batch.column(batch.schema.get_field_index(c)) for c in ("doc_id", "rid", "fp")}
            out = pa.RecordBatch.from_pydict({"chunk": pa.array([chunk] * len(texts), pa.int64()), "owner": pa.array([-1] * len(texts), pa.int32())} | cols | {"payload": pa.array(payload, pa.binary())} | more)
            types = out.schema
            yield out
            held.append(keys)
            count += len(keys)
            if count >= chunk_keys:
                yield widened(message(chunk, held), types, names)
                chunk, held, count = chunk + 1, [], 0
        if count:
            yield widened(message(chunk, held), types, names)

    return written(spark, docs.mapInArrow(run, schema), tag)


def widened(base: pa.RecordBatch, types: pa.Schema, names: list[str]) -> pa.RecordBatch:
    cols = [base.column(base.schema.get_field_index(f.name)) if f.name not in names else pa.nulls(base.num_rows, f.type) for f in types]
    return pa.RecordBatch.from_arrays(cols, schema=types)


def _counted(rows: pd.DataFrame) -> list[np.ndarray]:
    """An owner: decode all lists and add up; for each list how often each of its keys occurs anywhere."""
    lists, times = [], []
    for payload in rows["payload"]:
        coded, counts = unpacked(payload)
        lists.append(golomb_decode(coded))
        times.append(counts)
    every = np.concatenate(lists)
    order = np.argsort(every, kind="stable")
    ranked = every[order]
    head = np.flatnonzero(np.concatenate(([True], ranked[1:] != ranked[:-1])))
    total = np.add.reduceat(np.concatenate(times)[order].astype(np.int64), head)
    count = np.empty(len(every), np.int64)
    count[order] = np.repeat(total, np.diff(np.append(head, len(ranked))))
    return np.split(count, np.cumsum([len(x) for x in lists])[:-1])


def _answer(rows: pd.DataFrame, hot_above: int) -> pd.DataFrame:
    """An owner's flags of the keys that occur twice, and of those that occur too often."""
    counts = _counted(rows)
    out = [packed((bits(part > 1), bits(part > hot_above))) for part in counts]
    return pd.DataFrame({"chunk": rows["chunk"], "owner": rows["owner"], "payload": out, "n": [len(x) for x in counts]})


def _graded(rows: pd.DataFrame) -> pd.DataFrame:
    """An owner's levels of the keys: 1 for a key that occurs once, 2 for up to three times, 3 for up to seven, and so on."""
    counts = _counted(rows)
    return pd.DataFrame({"chunk": rows["chunk"], "owner": rows["owner"], "payload": [packed(np.frexp(part)[1].astype(np.uint8)) for part in counts]})


def _widened_keys(data: bytes, wide: int) -> np.ndarray:
    """64-bit keys from their first bytes."""
    if wide == 8:
        return np.frombuffer(data, U)
    out = np.zeros((len(data) // wide, 8), np.uint8)
    out[:, :wide] = np.frombuffer(data, np.uint8).reshape(-1, wide)
    return out.view(">u8").ravel().astype(U)


def _expand(mine: pd.DataFrame, answers: pd.DataFrame, carry: list[str], wide: int) -> pd.DataFrame:
    """A chunk: line its sorted keys up with the owners' bitmaps, and keep for each row the keys that repeat."""
    answers = answers.sort_values("owner")
    held = _widened_keys(b"".join(mine["payload"]), wide)
    ends = np.cumsum([len(x) // wide for x in mine["payload"]])
    flags, hot = [np.zeros(0, bool)], [np.zeros(0, bool)]
    for p, n in zip(answers["payload"], answers["n"], strict=True):
        twice, often = unpacked(p)
        flags.append(unbits(twice, n))
        hot.append(unbits(often, n))
    _, place = np.unique(held, return_inverse=True)
    hit = np.concatenate(flags)[place] if len(held) else np.zeros(0, bool)
    often = np.concatenate(hot)[place] if len(held) else np.zeros(0, bool)
    edge = np.concatenate(([0], ends)).astype(np.int64)

    def part(mask: np.ndarray) -> list[bytes]:
        kept, cut = held[mask], np.concatenate(([0], np.cumsum(mask)))[edge]
        return [kept[a:b].tobytes() for a, b in zip(cut[:-1], cut[1:], strict=True)]

    some = np.diff(np.concatenate(([0], np.cumsum(hit)))[edge]) > 0
    out = mine[["doc_id", "rid", "fp", *carry]].assign(payload=part(hit & ~often), hot=part(often), mask=[bits(hit[a:b]) for a, b in zip(edge[:-1], edge[1:], strict=True)])
    return out.loc[some]


def repeated_keys(table: DataFrame, hot_above: int = 1 << 60, carry: tuple[str, ...] = (), key_bits: int = 64) -> DataFrame:
    """``doc_id, rid, fp``, the ``carry`` columns, ``payload, hot, mask``: documents with keys that occur anywhere else.

    ``payload`` has those keys, but for the ones that occur more than ``hot_above`` times, which are in ``hot``; ``mask``
    has a bit for each of the document's keys. ``table`` comes from keyed_pass.
    """
    answers = table.where("owner >= 0").select("chunk", "owner", "payload").groupBy("owner").applyInPandas(lambda r: _answer(r, hot_above), "chunk long, owner int, payload binary, n long")
    return expanded(table, answers, carry, key_bits)


def expanded(table: DataFrame, answers: DataFrame, carry: tuple[str, ...] = (), key_bits: int = 64) -> DataFrame:
    """The owners' ``answers`` (``chunk, owner, payload, n``) brought back to the documents that they say something of."""
    rows = table.where("owner < 0").select("chunk", "doc_id", "rid", "fp", "payload", *carry)
    more = "".join(f", {c} {table.schema[c].dataType.simpleString()}" for c in carry)
    return rows.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInPandas(lambda a, b: _expand(a, b, list(carry), key_bits // 8), f"doc_id long, rid long, fp long{more}, payload binary, hot binary, mask binary")


def _leveled(mine: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
    """A chunk: line its sorted keys up with the owners' levels."""
    held = np.frombuffer(b"".join(mine["payload"]), U)
    edge = np.concatenate(([0], np.cumsum([len(x) // 8 for x in mine["payload"]]))).astype(np.int64)
    level = np.concatenate([np.zeros(0, np.uint8), *(unpacked(p) for p in answers.sort_values("owner")["payload"])])
    level = level[np.unique(held, return_inverse=True)[1]]
    return pd.DataFrame({"doc_id": mine["doc_id"], "levels": [level[a:b].tobytes() for a, b in zip(edge[:-1], edge[1:], strict=True)]})


def key_levels(table: DataFrame) -> DataFrame:
    """``doc_id, levels``: a byte for each of the row's keys, the bit length of how often the key occurs in ``table`` (from keyed_pass, with whole keys)."""
    answers = table.where("owner >= 0").select("chunk", "owner", "payload").groupBy("owner").applyInPandas(_graded, "chunk long, owner int, payload binary")
    rows = table.where("owner < 0").select("chunk", "doc_id", "payload")
    return rows.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInPandas(_leveled, "doc_id long, levels binary")
