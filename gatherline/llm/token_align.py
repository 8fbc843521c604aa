"""Operator 13: alignment of two tokenizers' tokens by the bytes they stand for.

1. Each text is tokenized twice. Tokens of both kinds end where a run of white space begins, so a text is taken apart
   there, each distinct unit is tokenized once, and a worker remembers it (``Units``).
2. In Arrow, for a block of documents at once: the id lists are flattened with their parents; cumulative sums of token
   lengths, begun anew at each list, give the ends; a full outer hash join on (document, end) meets the two sides. In
   the order of the key, each row is one link: the stretch that ends there belongs to one token of each side. Rows
   that both sides have are the ends of groups.
3. ``Table.group_by`` counts the pairs of a chunk of documents; Spark adds up the chunks' counts, finds the highest of
   each B id, and sends every chunk the answers for its own pairs. No link travels alone.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import blocks, keyed_documents, packed, sized_join, unpacked, written

#: Links whose pairs are counted together before they are sent on, about.
CHUNK_LINKS = 2_000_000
#: Units, and bytes of units, that a worker remembers. A longer unit is never remembered.
CACHE_UNITS, CACHE_BYTES, LONG_UNIT = 1_000_000, 32 << 20, 256
#: New units that are tokenized as one text.
TOGETHER = 500

_UNIT = re.compile(rb"[ \t\n]+[^ \t\n]*")
#: White space of other kinds, which some tokens hold together with other characters: a text that has any is tokenized as a whole.
_OTHER_SPACE = re.compile("|".join(map(chr, (0x0B, 0x0C, 0x0D, *range(0x1C, 0x20), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000))).encode())
_SPACE_MARK = "▁"


def byte_level_alphabet() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable ones themselves, the rest from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(0x100 + i): b for i, b in enumerate(rest)}


def byte_level_tokens(path: str) -> list[bytes]:
    """The bytes of each id of a byte-level tokenizers file."""
    with open(path, encoding="utf-8") as f:
        entries = json.load(f)["model"]["vocab"]
    alphabet, out = byte_level_alphabet(), [b""] * (max(entries.values()) + 1)
    for token, i in entries.items():
        out[i] = bytes(alphabet[c] for c in token) if all(c in alphabet for c in token) else token.encode()
    return out


def piece_tokens(model) -> list[bytes]:
    """The bytes of each id of a sentencepiece model; control and unknown pieces have none."""
    out = []
    for i in range(model.get_piece_size()):
        piece = model.id_to_piece(i)
        if model.is_byte(i):
            out.append(bytes([int(piece[3:5], 16)]))
        else:
            out.append(b"" if model.is_control(i) or model.is_unknown(i) else piece.replace(_SPACE_MARK, " ").encode())
    return out


class Tokenizers:
    """Both tokenizers of a worker, and the ids of the units seen so far, in two flat arrays."""

    def __init__(self, path_a: str, path_b: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        self.bytes_a, self.bytes_b = byte_level_tokens(path_a), piece_tokens(self.b)
        self.len_a, self.len_b = (pa.array(list(map(len, x)), pa.int64()) for x in (self.bytes_a, self.bytes_b))
        self.text_a, self.text_b = (pa.array([str(i) for i in range(len(x))]) for x in (self.bytes_a, self.bytes_b))
        # a line break stands before each unit, as it is never part of a longer piece: what follows it is the unit's own
        self.lead = self.b.encode("\n", num_threads=1)
        inner = [p for p in (self.b.id_to_piece(i) for i in range(self.b.get_piece_size())) if re.search(f"[^{_SPACE_MARK}]{_SPACE_MARK}|[ \t\n]", p)]
        self.by_unit = not inner and len(self.lead) == 2 and [self.bytes_b[i] for i in self.lead] == [b" ", b"\n"]
        self.forget()

    def forget(self) -> None:
        self.at: dict[bytes, int] = {}
        self.held = 0
        self.ids = [np.zeros(0, np.int32), np.zeros(0, np.int32)]
        self.count = [np.zeros(0, np.int64), np.zeros(0, np.int64)]
        self.good = np.zeros(0, bool)

    def encode(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Ids of both kinds for a run of units (or any text that begins with a space)."""
        a = np.array(self.a.encode(text, add_special_tokens=False).ids, np.int32)
        b = self.b.encode("\n" + text, num_threads=1)[2:] if self.by_unit else self.b.encode(text[1:], num_threads=1)
        return a, np.array(b, np.int32)

    def cut(self, units: list[bytes]) -> Iterator[tuple[list[np.ndarray], list[np.ndarray], list[bool]]]:
        """For each side the units' ids and how many each has; and whether both sides give back the unit's bytes.

        Units are tokenized as one text, and by halves where that text does not come back.
        """
        whole = b"".join(units)
        edge = np.cumsum([len(u) for u in units])
        ids, count, good = self.encode(whole.decode()), [], True
        for flat, table in zip(ids, (self.bytes_a, self.bytes_b), strict=True):
            parts = list(map(table.__getitem__, flat.tolist()))
            end = np.cumsum([len(x) for x in parts])
            at = np.searchsorted(end, edge)
            good = good and b"".join(parts) == whole and bool((end[at] == edge).all())
            count.append(np.diff(at, prepend=-1))
        if good:
            yield list(ids), count, [True] * len(units)
        elif len(units) == 1:
            yield [np.zeros(0, np.int32)] * 2, [np.zeros(1, np.int64)] * 2, [False]
        else:
            half = len(units) // 2
            yield from self.cut(units[:half])
            yield from self.cut(units[half:])

    def learn(self, units: list[bytes]) -> None:
        """Remember units; those with white space of other kinds are tokenized each by itself."""
        alone = [u for u in units if not self.by_unit or _OTHER_SPACE.search(u)]
        if alone:
            apart = set(alone)
            units = [u for u in units if u not in apart]
        runs = [*(units[i : i + TOGETHER] for i in range(0, len(units), TOGETHER)), *([u] for u in alone)]
        parts = [x for run in runs for x in self.cut(run)]
        for u in chain.from_iterable(runs):
            self.at[u] = len(self.at)
            self.held += len(u)
        for side in range(2):
            self.ids[side] = np.concatenate((self.ids[side], *(p[0][side] for p in parts)))
            self.count[side] = np.concatenate((self.count[side], *(p[1][side] for p in parts)))
        self.good = np.concatenate((self.good, np.array([x for p in parts for x in p[2]], bool)))

    def lists(self, texts: list[bytes]) -> tuple[pa.ListArray, pa.ListArray]:
        """Each text's ids by both tokenizers; none where the text has no tokens."""
        if len(self.at) > CACHE_UNITS or self.held > CACHE_BYTES:
            self.forget()
        units, each = [], np.zeros(len(texts), np.int64)
        for i, t in enumerate(texts):
            if t:
                mine = _UNIT.findall(b" " + t) if self.by_unit and not _OTHER_SPACE.search(t) else [b" " + t]
                each[i] = len(mine)
                units += mine
        at = self.at
        new = [u for u in dict.fromkeys(units) if u not in at]
        self.learn(new)
        row = np.fromiter(map(at.__getitem__, units), np.int64, len(units))
        edge = np.concatenate(([0], np.cumsum(each)))
        bad = np.concatenate(([0], np.cumsum(~self.good[row])))[edge]
        kept = np.repeat(np.diff(bad) == 0, each)
        out = []
        for side in range(2):
            begin = np.concatenate(([0], np.cumsum(self.count[side])))
            n = np.where(kept, self.count[side][row], 0)
            end = np.concatenate(([0], np.cumsum(n)))
            flat = self.ids[side][np.arange(end[-1]) + np.repeat(begin[row] - end[:-1], n)]
            out.append(pa.ListArray.from_arrays(pa.array(end[edge].astype(np.int32)), pa.array(flat)))
        if any(len(u) > LONG_UNIT for u in new):
            self.forget()
        return out[0], out[1]


def ends(ids: pa.ListArray, lengths: pa.Array) -> tuple[pa.Array, pa.Array, pa.Array]:
    """(id, key) of each token and their order: key is the list's number and the byte at which the token ends."""
    flat, parent = pc.list_flatten(ids), pc.list_parent_indices(ids)
    total = pc.cumulative_sum(pc.take(lengths, flat))
    starts = pc.cast(ids.offsets.slice(0, len(ids)), pa.int64())
    before = pc.take(pa.concat_arrays([pa.array([0], pa.int64()), total]), starts)  # the sum up to each list
    own = pc.subtract(total, pc.take(before, parent))
    return flat, pc.add(pc.shift_left(pc.cast(parent, pa.int64()), 32), own), pa.array(np.arange(len(flat), dtype=np.int32))


def align(a_ids: pa.ListArray, b_ids: pa.ListArray, tok: Tokenizers) -> tuple[pa.Table, np.ndarray, np.ndarray, list[str]]:
    """(links with ``doc, pair``; groups and links of each list; what is hashed for each list)."""
    a, a_key, a_at = ends(a_ids, tok.len_a)
    b, b_key, b_at = ends(b_ids, tok.len_b)
    left, right = pa.table({"key": a_key, "a": a, "i": a_at}), pa.table({"key": b_key, "b": b, "j": b_at})
    both = left.join(right, "key", join_type="full outer", use_threads=False).combine_chunks().sort_by("key")
    doc = pc.cast(pc.shift_right(both["key"], 32), pa.int32())
    shared = pc.and_(pc.is_valid(both["i"]), pc.is_valid(both["j"]))
    # a stretch that ends within a token belongs to the next end of that side
    link_a, link_b = (pc.cast(pc.fill_null_backward(both[c]), pa.int64()) for c in "ab")
    links = pa.table({"doc": doc, "pair": pc.add(pc.shift_left(link_a, 32), link_b)})
    n_links = np.bincount(doc.to_numpy(), minlength=len(a_ids))
    last = both.filter(shared)
    n_groups = np.bincount(pc.shift_right(last["key"], 32).to_numpy(), minlength=len(a_ids))

    def joined(ids: pa.Array, texts: pa.Array, at: str) -> pa.Array:
        cut = np.concatenate(([0], last[at].to_numpy() + 1)).astype(np.int32)
        return pc.binary_join(pa.ListArray.from_arrays(pa.array(cut), pc.take(texts, ids)), ",")

    groups = pc.binary_join_element_wise(joined(a, tok.text_a, "i"), joined(b, tok.text_b, "j"), "|")
    cut = np.concatenate(([0], np.cumsum(n_groups))).astype(np.int32)
    whole = pc.binary_join(pa.ListArray.from_arrays(pa.array(cut), groups), ";").to_pylist()
    return links, n_groups, n_links, whole


_loaded: dict[tuple[str, str], Tokenizers] = {}

_ROW = "chunk long, a int, b int, n long, place int, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, payload binary"


def _aligned(keyed: DataFrame, path_a: str, path_b: str, chunk_links: int, block_bytes: int) -> DataFrame:
    """Side by side: a row for each document (``place`` null), and one for each pair of a chunk with its number of links.

    A document's payload has its pairs, by their place in the chunk, and how many of its links hold each.
    """
    schema = pa.schema([("chunk", pa.int64()), ("a", pa.int32()), ("b", pa.int32()), ("n", pa.int64()), ("place", pa.int32()), ("doc_id", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()), ("n_links", pa.int64()), ("groups_sha256", pa.string()), ("payload", pa.binary())])

    def batch_of(n: int, cols: dict) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(cols[f.name], f.type) if f.name in cols else pa.nulls(n, f.type) for f in schema], schema=schema)

    def flushed(chunk: int, docs: list[dict], counted: list[pa.Table]) -> Iterator[pa.RecordBatch]:
        table = pa.concat_tables(counted).combine_chunks()
        coded = pc.dictionary_encode(table["pair"]).combine_chunks()
        coded = coded if isinstance(coded, pa.DictionaryArray) else coded.chunk(0) if coded.num_chunks else pa.array([], pa.int64()).dictionary_encode()
        place, times, doc = coded.indices.to_numpy(), table["pair_count"].to_numpy(), table["doc"].to_numpy()
        order = np.argsort(doc, kind="stable")
        place, times, doc = place[order].astype(np.uint32), times[order].astype(np.uint32), doc[order]
        columns = {k: np.concatenate([d[k] for d in docs]) for k in ("n_a", "n_b", "n_groups", "n_links")}
        columns |= {k: list(chain.from_iterable(d[k] for d in docs)) for k in ("doc_id", "groups_sha256")}
        n = len(columns["doc_id"])
        cut = np.searchsorted(doc, np.arange(n + 1))
        columns |= {"chunk": np.full(n, chunk), "payload": [packed((place[x:y], times[x:y])) if y > x else b"" for x, y in zip(cut[:-1], cut[1:], strict=True)]}
        yield batch_of(n, columns)
        pairs = coded.dictionary.to_numpy()
        if len(pairs):
            total = np.bincount(place, times, len(pairs)).astype(np.int64)
            yield batch_of(len(pairs), {"chunk": np.full(len(pairs), chunk), "a": (pairs >> 32).astype(np.int32), "b": (pairs & 0xFFFFFFFF).astype(np.int32), "n": total, "place": np.arange(len(pairs))})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = _loaded.get((path_a, path_b)) or _loaded.setdefault((path_a, path_b), Tokenizers(path_a, path_b))
        chunk = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 24
        docs, counted, base, held = [], [], 0, 0
        for batch, texts in blocks(batches, block_bytes):
            a_ids, b_ids = tok.lists(texts)
            links, n_groups, n_links, whole = align(a_ids, b_ids, tok)
            each = links.group_by(["doc", "pair"], use_threads=False).aggregate([("pair", "count")])
            counted.append(pa.table({"doc": pc.add(pc.cast(each["doc"], pa.int64()), base), "pair": each["pair"], "pair_count": each["pair_count"]}))
            docs.append({
                "doc_id": batch.column(batch.schema.get_field_index("doc_id")).to_pylist(), "n_a": np.diff(a_ids.offsets.to_numpy()), "n_b": np.diff(b_ids.offsets.to_numpy()), "n_groups": n_groups, "n_links": n_links,
                "groups_sha256": [hashlib.sha256(x.encode()).hexdigest() if x else "" for x in whole],
            })
            base, held = base + len(texts), held + links.num_rows
            if held >= chunk_links:
                yield from flushed(chunk, docs, counted)
                chunk, docs, counted, base, held = chunk + 1, [], [], 0, 0
        if docs:
            yield from flushed(chunk, docs, counted)

    return keyed.mapInArrow(run, _ROW)


def _looked_up(docs: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
    """A chunk: its documents' pairs against what Spark found for the chunk's pairs."""
    count, best = np.zeros(len(answers), np.int64), np.zeros(len(answers), bool)
    at = answers["place"].to_numpy(np.int64)
    count[at], best[at] = answers["total"].to_numpy(np.int64), answers["best"].to_numpy(bool)
    n_best, count_sum = [], []
    for payload in docs["payload"]:
        place, times = unpacked(payload) if payload else (np.zeros(0, np.int64), np.zeros(0, np.int64))
        n_best.append(int(times[best[place]].sum()))
        count_sum.append(int((times.astype(np.int64) * count[place]).sum()))
    return docs.drop(columns=["chunk", "payload"]).assign(n_best=np.array(n_best, np.int64), count_sum=np.array(count_sum, np.int64))


def _pairs(table: DataFrame) -> DataFrame:
    """``a, b, total, best``: how many links hold each pair, and whether none with the same B id has more."""
    totals = table.where("place is not null").groupBy("a", "b").agg(F.sum("n").alias("total"))
    return totals.withColumn("best", F.col("total") == F.max("total").over(Window.partitionBy("b")))  # an id meets at most the other vocabulary


def pair_counts(spark: SparkSession, docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The alignment table itself: ``a, b, total, best`` for each pair of ids that any link holds."""
    return _pairs(written(spark, _aligned(keyed_documents(docs, id_col, text_col), path_a, path_b, CHUNK_LINKS, 1 << 20), "aligned"))


def align_tokens(spark: SparkSession, docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text", chunk_links: int = CHUNK_LINKS, block_bytes: int = 1 << 20) -> DataFrame:
    """One row per document: ``doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256``.

    ``path_a``: a byte-level tokenizers file, which gets a space and the text; ``path_b``: a sentencepiece model, which
    adds the space itself. Special tokens' strings are plain text. Null and empty texts, and texts that either side
    does not give back byte by byte, have no tokens: zeros and an empty string. A link is a pair of tokens whose byte
    ranges overlap, and ties for the highest count all count as best. Rows that repeat an id, or null ids, are
    documents of their own and count in the corpus; other columns are left behind; an empty table gives no rows.
    """
    table = written(spark, _aligned(keyed_documents(docs, id_col, text_col), path_a, path_b, chunk_links, block_bytes), "aligned")
    pairs = written(spark, _pairs(table), "pairs")
    answers = sized_join(table.where("place is not null").select("chunk", "place", "a", "b"), pairs, ["a", "b"], "inner").select(F.col("chunk").alias("of"), "place", "total", "best")
    rows = table.where("place is null").select("chunk", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "payload")
    out = rows.groupBy("chunk").cogroup(answers.groupBy("of")).applyInPandas(_looked_up, "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, n_best long, count_sum long")
    return out.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
