"""Operator 4: substring removal over words, by prefix-partitioned suffix trees.

A suffix here is the text from the start of a window on, as deep as the window is long (no deeper node matters). It
goes to the group of its anchor, the least 8-gram of the window: suffixes that agree to the window's depth always
meet, and a hash range of anchors is a group that fits a worker. Where an anchor has too many suffixes its prefix
grows to the whole window (repeats.py). Within a group the tree is built top-down, the
write-only way: all suffixes of one root are split by their next words, a node of one suffix is a leaf and is
dropped at once, the rest are split again by a longer prefix, until nodes reach the window's depth. Suffixes are
taken in portions of whole roots that fit ``PORTION``, so a prefix grows only as long as its group needs. Each deep
node with two suffixes is a repeat; every window below it is removed.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from .common import keyed_documents
from .hashing import Words
from .repeats import WordUnits, covered_intervals, remove_spans

#: Suffixes whose subtrees are built at a time.
PORTION = 500_000
#: Words that one split looks at.
STEP = 3


def _pack(rows: dict, cut: np.ndarray) -> list[dict]:
    ends = [*cut[1:], len(rows["length"])]
    begin = np.concatenate(([0], np.cumsum(rows["length"])))
    return [{c: rows[c][a:b] for c in ("length", "lead", "many", "often")} | {"data": rows["data"][begin[a] : begin[b]].tobytes()} for a, b in zip(cut, ends, strict=True)]


def deep_nodes(words: np.ndarray, begin: np.ndarray, root: np.ndarray, often: np.ndarray, window: int) -> np.ndarray:
    """Which suffixes hang below a node of depth ``window`` with two leaves (or one that stands for several copies).

    ``words``: dense word ids; ``begin``: where each suffix starts; ``root``: suffixes of different roots differ.
    """
    repeated = often.copy()
    alive, node, depth = np.arange(len(begin)), root.astype(np.int64), 0
    size = int(words.max()) + 1 if len(words) else 1
    step = max(1, min(STEP, int(62 // max(1, np.log2(size)))))
    while depth < window and len(alive):
        take = min(step, window - depth)
        code = words[begin[alive] + depth].astype(np.int64)
        for j in range(1, take):
            code = code * size + words[begin[alive] + depth + j]
        _, code = np.unique(code, return_inverse=True)
        branch = node * (int(code.max()) + 1) + code
        _, node, leaves = np.unique(branch, return_inverse=True, return_counts=True)
        inner = leaves[node] > 1  # a node with one suffix is a leaf: it gets no deeper
        alive, node = alive[inner], node[inner]
        depth += take
    repeated[alive] = True
    return repeated


def solver(window: int, width: int):
    def solve(messages: list[dict]) -> list[np.ndarray]:
        # the words of all rows
        _, ids = np.unique(np.concatenate([h for m in messages for h in _word_hashes(m)]), return_inverse=True)
        many = np.concatenate([m["many"] for m in messages])
        lead = np.concatenate([m["lead"] for m in messages])
        often = np.concatenate([m["often"] for m in messages])
        row_begin = np.concatenate(([0], np.cumsum(many + window - 1)))[:-1]
        out = np.zeros((len(many), width), bool)
        # a root: the anchor's words, and how far before them the suffix starts
        anchor = np.column_stack([ids[row_begin + lead + j] for j in range(window - width + 1)])
        anchor = np.unique(anchor, axis=0, return_inverse=True)[1].ravel() if len(anchor) else np.zeros(0, np.int64)
        order = np.argsort(anchor, kind="stable")
        total = np.cumsum(many[order])
        begin = 0
        while begin < len(order):
            end = int(np.searchsorted(total, (total[begin - 1] if begin else 0) + PORTION, "right"))
            end = max(end, begin + 1)
            while end < len(order) and anchor[order[end]] == anchor[order[end - 1]]:
                end += 1  # whole roots
            rows = order[begin:end]
            suffix_row = np.repeat(rows, many[rows])
            offset = np.arange(len(suffix_row)) - np.repeat(np.concatenate(([0], np.cumsum(many[rows])))[:-1], many[rows])
            root = anchor[suffix_row] * width + (lead[suffix_row] - offset)
            root = np.unique(root, return_inverse=True)[1]
            out[suffix_row, offset] = deep_nodes(ids, row_begin[suffix_row] + offset, root, often[suffix_row], window)
            begin = end
        return np.split(out, np.cumsum([len(m["many"]) for m in messages])[:-1])

    return solve


def _word_hashes(message: dict, rows: int = 1000) -> Iterator[np.ndarray]:
    """The hashes of the words of the message's segments, a number of segments at a time."""
    edge = np.concatenate(([0], np.cumsum(message["length"])))
    for a in range(0, len(edge) - 1, rows):
        part = edge[a : a + rows + 1]
        yield Words([message["data"][x:y] for x, y in zip(part[:-1], part[1:], strict=True)]).hash


def remove_repeated_words(spark: SparkSession, docs: DataFrame, window: int = 35, k: int = 8, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False) -> DataFrame:
    """Remove each word covered by a ``window``-word sequence that also starts anywhere else.

    Returns ``doc_id, n_words, n_removed, kept_sha256`` (and ``kept_text``, if asked for: kept words joined by one
    space). Null and empty texts have no words and the hash of the empty string; an empty table gives no rows; every row
    is a document of its own, also one that repeats another whole. Words are equal if their 64-bit hashes are.
    """
    keyed = keyed_documents(docs, id_col, text_col)
    schema = "n_words long, n_removed long, kept_sha256 string" + (", kept_text string" if with_text else "")

    def report(text: bytes, spans: np.ndarray) -> list:
        words = text.split()
        if len(spans):
            keep = np.ones(len(words), bool)
            for a, b in spans:
                keep[a:b] = False
            left = [words[i] for i in np.flatnonzero(keep)]
        else:
            left = words
        joined = b" ".join(left)
        return [len(words), len(words) - len(left), hashlib.sha256(joined).hexdigest(), *([joined.decode("utf-8", "replace")] if with_text else [])]

    def per_text(texts: list[bytes], _counts: np.ndarray) -> dict:
        made = [report(t, np.zeros((0, 2), np.int64)) for t in texts]
        return dict(zip([x.split()[0] for x in schema.split(", ")], map(list, zip(*made, strict=True)), strict=True))

    units = WordUnits(window, k)
    table, spans = covered_intervals(spark, keyed, units, _pack, solver(window, window - k + 1), per_text, schema, "words")
    return remove_spans(keyed, table, spans, report, schema)
