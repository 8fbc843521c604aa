"""Operator 8: substring removal over bytes, by merging the Burrows-Wheeler transforms of shards.

Segments of one anchor are aligned at it, as rows of a matrix. Its Burrows-Wheeler transform is positional: at each
column, the symbols of that column in the order of the rows' reversed prefixes. A shard (one task's segments) builds
its own transform and sends each bucket the part that belongs to it; the rows themselves are not sent.

A bucket merges the transforms of all shards as in the interleave refinement of multi-string BWTs: an interleave
vector says which shard comes next; it starts as one shard after another, and each column refines it by a stable sort
of the merged symbols alone. Each shard's symbols are consumed in its own order, so no suffix is sorted again. The
common lengths of neighbours follow: equal symbols add one to the least length between them, others give zero.
Neighbours that share 200 bytes up to a column are a repeated interval, and the window that ends there is removed.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from .common import keyed_documents
from .repeats import ByteUnits, covered_intervals, remove_spans

#: Stands for a place outside a segment. It differs from every byte.
OUTSIDE = 256


def build(matrix: np.ndarray) -> np.ndarray:
    """Positional BWT of the columns of ``matrix`` (columns by rows)."""
    order = np.arange(matrix.shape[1])
    out = np.empty_like(matrix)
    for c, column in enumerate(matrix):
        out[c] = column[order]
        order = order[np.argsort(out[c], kind="stable")]
    return out


def split(matrix: np.ndarray, bucket_of: np.ndarray) -> np.ndarray:
    """As ``build``, with each column cut by bucket: a bucket's part is the BWT of its own rows."""
    order = np.arange(matrix.shape[1])
    out = np.empty_like(matrix)
    groups = bucket_of.astype(np.uint16)
    for c, column in enumerate(matrix):
        symbols = column[order]
        out[c] = symbols[np.argsort(groups[order], kind="stable")]
        order = order[np.argsort(symbols, kind="stable")]
    return out


def _range_min(values: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """min(values[low:high+1]) for each pair."""
    width = high - low + 1
    level = np.frexp(width.astype(np.float64))[1] - 1
    out = np.empty(len(low), values.dtype)
    table, at = values, 0
    for lv in range(int(level.max()) + 1 if len(level) else 0):
        if lv:
            half = 1 << (lv - 1)
            table = np.minimum(table[:-half], table[half:])
        mine = np.flatnonzero(level == lv)
        if len(mine):
            out[mine] = np.minimum(table[low[mine]], table[high[mine] - (1 << lv) + 1])
        at += len(mine)
        if at == len(low):
            break
    return out


def merge(transforms: list[np.ndarray], window: int, often: np.ndarray) -> np.ndarray:
    """Merge BWTs (columns by rows) and return rows by columns: whether the window that ends there repeats.

    ``often``: rows that stand for several equal segments; all their windows repeat.
    """
    sizes = [t.shape[1] for t in transforms]
    n, columns = sum(sizes), transforms[0].shape[0]
    symbols_of = np.concatenate(transforms, axis=1) if len(transforms) > 1 else transforms[0]
    interleave = np.repeat(np.arange(len(sizes), dtype=np.uint16 if len(sizes) < 1 << 16 else np.uint32), sizes)
    row = np.arange(n)
    depth = np.int16 if columns < 32_000 else np.int32
    common = np.zeros(n, depth)  # with the neighbour above
    out = np.zeros((columns, n), bool)
    merged = np.empty(n, symbols_of.dtype)
    for c in range(columns):
        # the next symbol of each shard, where the interleave names that shard
        merged[np.argsort(interleave, kind="stable")] = symbols_of[c]
        nxt = np.argsort(merged, kind="stable")
        inside = merged[nxt] != OUTSIDE
        equal = (merged[nxt[1:]] == merged[nxt[:-1]]) & inside[1:]
        fresh = np.zeros(n, depth)
        i = np.flatnonzero(equal) + 1
        low, high = nxt[i - 1] + 1, nxt[i]
        near = low == high
        least = np.empty(len(i), depth)
        least[near] = common[low[near]]
        far = ~near
        if far.any():
            least[far] = _range_min(common, low[far], high[far])
        fresh[i] = least + 1
        common, interleave, row = fresh, interleave[nxt], row[nxt]
        deep = common >= window
        deep[:-1] |= deep[1:]
        out[c, row[deep]] = True
    out |= often[None, :]
    return out.T


def _matrix(rows: dict, columns: int, width: int) -> np.ndarray:
    """The segments as columns by rows, each with its anchor at column ``width - 1``."""
    n = len(rows["length"])
    out = np.full((columns, n), OUTSIDE, np.uint16)
    edge = np.concatenate(([0], np.cumsum(rows["length"])))
    for a in range(0, n, 1000):  # bounds the index
        lead, length = rows["lead"][a : a + 1000], rows["length"][a : a + 1000]
        part = np.full((len(lead), columns), OUTSIDE, np.uint16)
        begin = np.arange(len(lead)) * columns + (width - 1) - lead
        own = edge[a : a + len(lead) + 1] - edge[a]
        part.ravel()[np.arange(own[-1]) + np.repeat(begin - own[:-1], length)] = rows["data"][edge[a] : edge[a] + own[-1]]
        out[:, a : a + len(lead)] = part.T
    return out


def packer(window: int, width: int):
    columns = width - 1 + window

    def pack(rows: dict, cut: np.ndarray) -> list[dict]:
        n = len(rows["length"])
        group = np.repeat(np.arange(len(cut)), np.diff(np.append(cut, n)))
        transform = split(_matrix(rows, columns, width), group)
        ends = [*cut[1:], n]
        return [{"bwt": np.ascontiguousarray(transform[:, a:b]), "lead": rows["lead"][a:b], "often": rows["often"][a:b]} for a, b in zip(cut, ends, strict=True)]

    return pack


def solver(window: int, width: int):
    def solve(messages: list[dict]) -> list[np.ndarray]:
        repeated = merge([m["bwt"] for m in messages], window, np.concatenate([m["often"] for m in messages]))
        # the window at offset j of a row starts at column (width - 1 - lead + j) and ends window - 1 further on
        lead = np.concatenate([m["lead"] for m in messages])
        out = np.zeros((len(lead), width), bool)
        for a in range(0, len(lead), 4000):
            column = (width - 1 - lead[a : a + 4000])[:, None] + np.arange(width) + window - 1
            inside = column < repeated.shape[1]
            out[a : a + 4000] = np.take_along_axis(repeated[a : a + 4000], np.where(inside, column, 0), axis=1) & inside
        return np.split(out, np.cumsum([len(m["lead"]) for m in messages])[:-1])

    return solve


def remove_repeated_bytes(spark: SparkSession, docs: DataFrame, window: int = 200, k: int = 32, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False) -> DataFrame:
    """Remove each byte covered by a ``window``-byte string that also starts anywhere else.

    Returns ``doc_id, n_bytes, n_removed, n_spans, kept_sha256`` (and ``kept`` binary, if asked for). Null and empty
    texts have no bytes and the hash of the empty string; an empty table gives no rows; every row is a document of its
    own, also one that repeats another whole. Bytes are compared as they are: removal may cut a character.
    """
    keyed = keyed_documents(docs, id_col, text_col)
    schema = "n_bytes long, n_removed long, n_spans long, kept_sha256 string" + (", kept binary" if with_text else "")

    def report(text: bytes, spans: np.ndarray) -> list:
        left, at = [], 0
        for a, b in spans.tolist():
            left.append(text[at:a])
            at = b
        joined = b"".join([*left, text[at:]])
        return [len(text), len(text) - len(joined), len(spans), hashlib.sha256(joined).hexdigest(), *([joined] if with_text else [])]

    def per_text(texts: list[bytes], _counts: np.ndarray) -> dict:
        made = [report(t, np.zeros((0, 2), np.int64)) for t in texts]
        return dict(zip([x.split()[0] for x in schema.split(", ")], map(list, zip(*made, strict=True)), strict=True))

    units, width = ByteUnits(window, k), window - k + 1
    table, spans = covered_intervals(spark, keyed, units, packer(window, width), solver(window, width), per_text, schema, "bytes")
    return remove_spans(keyed, table, spans, report, schema)
