"""Operator 10: benchmark decontamination by spaced seeds.

A seed is a fixed mask over token positions; tokens at its ignored positions may differ. The tokens under each mask,
at each place of every test item and every document, are hashed; equal hashes of a document and an item are hits. On
each hit's diagonal (same shift between the two texts) the tokens are compared one by one, and of the stretches that
keep the share of equal tokens the one with the most of them is taken.

Test items of up to ``block_tokens`` tokens are indexed in one broadcast table, whose size is counted before. Beyond that
the hashes are joined by shuffle: documents, read once, send the hashes that a bitmap of all test hashes lets through
(its size is bounded; the fuller it gets, the more passes), the join gives diagonals, and only documents with some meet
their items' texts for the comparison.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import blocks, free_names, keyed_documents, lower_ascii, sized_join, written
from .hashing import _BASE, U, byte_values, mix, prefix_sums, span_hash

#: Masks of weight 7. Together they hit any 13 tokens with two substitutions, and every stretch with 13 equal tokens
#: that make up four fifths of it (tested).
MASKS = ("1111111", "11101111", "1110011011", "1101100111", "11010010111", "111010010011", "11010101011")
#: Tokens that must agree (of an item with fewer, all its tokens), and the share of the stretch that must.
LEAST_MATCHED = 13
LEAST_SHARE = 0.8
#: Test tokens whose hashes are broadcast at most (about 60 bytes each); more are joined by shuffle.
BLOCK_TOKENS = 400_000
#: Bits of the filter for each test hash, and the logarithm of its largest number of bits and of its pieces.
FILTER_RATIO, FILTER_BITS, FILTER_PIECES = 16, 30, 6
#: Hits that are expanded at a time.
HITS = 1 << 20

_FOUND = ("item_id", "n_matched", "n_tokens", "doc_start", "item_start")
_WORD_BYTE = np.zeros(256, bool)
_WORD_BYTE[[*range(ord("a"), ord("z") + 1), *range(ord("0"), ord("9") + 1), *range(0x80, 0x100)]] = True


def tokens(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the tokens (letters and digits, A-Z lower-cased) of all texts, and the text each is in."""
    data = lower_ascii(b" ".join(texts))
    buf = np.frombuffer(data, np.uint8)
    begin_of = np.concatenate(([0], np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1)))[: len(texts)]
    inside = np.zeros(len(buf) + 2, np.int8)
    inside[1:-1] = _WORD_BYTE[buf]
    edges = np.flatnonzero(np.diff(inside))
    begin, end = edges[::2], edges[1::2]
    if not len(begin):
        return np.zeros(0, U), np.zeros(0, np.int64)
    return mix(span_hash(prefix_sums(byte_values(buf)), begin, end)), np.searchsorted(begin_of, begin, "right") - 1


def seed_hashes(hashes: np.ndarray, text: np.ndarray, mask: str, salt: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, place) of the mask at each place where it stays within a text."""
    n = len(hashes) - len(mask) + 1
    if n <= 0:
        return np.zeros(0, U), np.zeros(0, np.int64)
    total = np.full(n, salt, U)
    for j, c in enumerate(mask):
        if c == "1":
            total = total * U(_BASE) + hashes[j : j + n]
    place = np.flatnonzero(text[:n] == text[len(mask) - 1 :][:n])
    return mix(total[place]), place


def best_stretch(equal: np.ndarray, share: Fraction) -> tuple[int, int, int]:
    """(begin, end, matches) of the stretch with the most matches among all in which they make up ``share``.

    It begins and ends with a match; ties go to the first end. Without any match it is empty.
    """
    score = np.concatenate(([0], np.cumsum(np.where(equal, share.denominator, 0) - share.numerator)))
    count = np.concatenate(([0], np.cumsum(equal)))
    # a stretch keeps the share if its score is not negative: for each end, the first begin with no larger sum
    begins = np.searchsorted(-np.minimum.accumulate(score), -score, "left")
    end = int(np.argmax(count - count[begins]))
    begin = int(begins[end])
    matched = int(count[end] - count[begin])
    return begin + int(np.argmax(equal[begin:end])) if matched else end, end, matched


def _lengths(masks: tuple[str, ...]) -> range:
    """Lengths of items that are looked up whole, as no mask fits."""
    return range(1, min(map(len, masks)))


def _seeds(hashes: np.ndarray, text: np.ndarray, masks: tuple[str, ...]) -> tuple[np.ndarray, np.ndarray]:
    """(hash, place) of all masks at all places."""
    found = [seed_hashes(hashes, text, m, i + 1) for i, m in enumerate(masks)]
    return np.concatenate([k for k, _ in found]), np.concatenate([p for _, p in found])


def _whole(hashes: np.ndarray, text: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, place) of each run of ``n`` tokens, as shorter items are looked up."""
    key, place = seed_hashes(hashes, text, "1" * n, 0)
    return mix(key + U(n)), place


def _index(items: list[tuple[int, bytes]], masks: tuple[str, ...]) -> dict:
    hashes, text = tokens([t for _, t in items])
    key, place = _seeds(hashes, text, masks)
    order = np.argsort(key, kind="stable")
    counts = np.bincount(text, minlength=len(items))
    first = np.cumsum(counts) - counts
    # items shorter than the shortest mask are looked up whole: by their length, sorted hashes and the items
    whole = {}
    for n in _lengths(masks):
        mine = np.flatnonzero(counts == n)
        if len(mine):
            k, _ = _whole(hashes[first[mine][:, None] + np.arange(n)].ravel(), np.repeat(mine, n), n)
            by = np.argsort(k, kind="stable")
            whole[n] = (k[by], mine[by])
    return {"whole": whole, "key": key[order], "place": place[order], "hashes": hashes, "text": text, "first": np.concatenate(([0], np.cumsum(counts))), "ids": np.array([i for i, _ in items], np.int64)}


def contaminated(spark: SparkSession, docs: DataFrame, items: DataFrame, masks: tuple[str, ...] = MASKS, least_matched: int = LEAST_MATCHED, least_share: float = LEAST_SHARE, block_tokens: int = BLOCK_TOKENS, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """One row for each document and test item that overlap: ``doc_id, item_id, n_matched, n_tokens, doc_start, item_start``.

    An overlap is a stretch without insertions in which at least ``least_matched`` tokens (or all tokens of a shorter
    item) agree, and ``least_share`` of the stretch; the one with the most equal tokens is given, from its first to its
    last equal one. ``n_tokens`` is its length, the starts count tokens. Items with fewer tokens than the shortest mask
    are looked for whole. Nulls and empty texts match nothing; items that repeat an id or a text each match; ties go to
    the first diagonal and the first stretch on it. Documents without an overlap have no row; rows that repeat a
    document give rows again.
    """
    return _found(spark, docs, items, masks, least_matched, least_share, block_tokens, id_col, text_col, item_col, item_text_col).drop("rid", "fp")


def _found(spark: SparkSession, docs: DataFrame, items: DataFrame, masks: tuple[str, ...] = MASKS, least_matched: int = LEAST_MATCHED, least_share: float = LEAST_SHARE, block_tokens: int = BLOCK_TOKENS, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """The rows of ``contaminated`` with the documents' ``rid`` and ``fp``."""
    keyed = keyed_documents(docs, id_col, text_col)
    tests = items.select(F.col(item_col).cast("long").alias("item_id"), F.col(item_text_col).cast("binary").alias("body")).where("body is not null")
    size = tests.agg(F.sum(F.length("body") / 2 + 1)).first()[0] or 0  # a token and what parts it from the next
    if size > block_tokens:
        return _joined(spark, keyed, tests, masks, least_matched, least_share)
    small = tests.collect()
    names = spark.sparkContext.broadcast([r["item_id"] for r in small])  # hits carry an item's place in this list
    index = spark.sparkContext.broadcast(_index([(n, bytes(r["body"])) for n, r in enumerate(small)], masks))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in blocks(batches):
            rows = _overlaps(texts, index.value, masks, least_matched, least_share)
            if rows:
                cols = list(zip(*rows, strict=True))
                cols[1] = [names.value[i] for i in cols[1]]
                at = pa.array(cols[0], pa.int64())
                yield pa.RecordBatch.from_pydict({n: batch.column(batch.schema.get_field_index(n)).take(at) for n in ("doc_id", "rid", "fp")} | {n: pa.array(v, pa.int64()) for n, v in zip(_FOUND, cols[1:], strict=True)})

    return keyed.mapInArrow(find, "doc_id long, rid long, fp long, " + ", ".join(f"{c} long" for c in _FOUND))


def _joined(spark: SparkSession, keyed: DataFrame, tests: DataFrame, masks: tuple[str, ...], least_matched: int, least_share: float) -> DataFrame:
    """As ``_found``, by a shuffle join of the hashes."""
    tests = written(spark, tests.withColumn("item", F.monotonically_increasing_id()), "items")

    def item_seeds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes, text = tokens([x or b"" for x in batch.column(1).to_pylist()])
            counts = np.bincount(text, minlength=batch.num_rows)
            first = np.cumsum(counts) - counts
            keys, places = _seeds(hashes, text, masks)
            found = [(keys, places)]
            for n in _lengths(masks):
                at = np.flatnonzero(counts[text] == n)
                k, p = _whole(hashes[at], text[at], n)
                found.append((k, at[p]))
            keys, places = np.concatenate([k for k, _ in found]), np.concatenate([p for _, p in found])
            of = text[places]
            yield pa.RecordBatch.from_pydict({"key": keys.view(np.int64), "item": batch.column(0).take(pa.array(of)), "item_place": places - first[of]})

    seeds = written(spark, tests.select("item", "body").mapInArrow(item_seeds, "key long, item long, item_place long"), "item_seeds")
    level = int(np.clip(int(seeds.count() * FILTER_RATIO).bit_length(), FILTER_PIECES + 3, FILTER_BITS))
    inside = level - FILTER_PIECES

    def bitmap(pdf: pd.DataFrame) -> pd.DataFrame:
        bits_ = np.zeros(1 << inside, bool)
        bits_[pdf["bit"].to_numpy()] = True
        return pd.DataFrame({"piece": pdf["piece"].iloc[:1], "bits": [np.packbits(bits_).tobytes()]})

    piece, bit = F.shiftrightunsigned("key", 64 - FILTER_PIECES), F.shiftrightunsigned("key", 64 - level).bitwiseAND((1 << inside) - 1)
    marks = seeds.select(piece.alias("piece"), bit.alias("bit")).distinct().groupBy("piece").applyInPandas(bitmap, "piece long, bits binary")
    filled = np.zeros((1 << FILTER_PIECES, 1 << inside >> 3), np.uint8)
    for r in marks.collect():  # 2^FILTER_BITS bits at most
        filled[r["piece"]] = np.frombuffer(r["bits"], np.uint8)
    passes = spark.sparkContext.broadcast(filled.ravel())

    def doc_seeds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in blocks(batches):
            hashes, text = tokens(texts)
            first = np.searchsorted(text, np.arange(len(texts)))
            for key, place in [seed_hashes(hashes, text, m, i + 1) for i, m in enumerate(masks)] + [_whole(hashes, text, n) for n in _lengths(masks)]:
                at = (key >> U(64 - level)).astype(np.int64)
                good = (passes.value[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 == 1
                key, place = key[good], place[good]
                of = pa.array(text[place])
                yield pa.RecordBatch.from_pydict({"key": key.view(np.int64), "rid": batch.column(batch.schema.get_field_index("rid")).take(of), "fp": batch.column(batch.schema.get_field_index("fp")).take(of), "place": place - first[text[place]]})

    hits = keyed.mapInArrow(doc_seeds, "key long, rid long, fp long, place long").join(seeds, "key")
    # rows that repeat a document have the same diagonals
    shifts = hits.select("rid", "fp", "item", (F.col("place") - F.col("item_place")).alias("shift")).distinct()
    shifts = shifts.groupBy("rid", "fp", "item").agg(F.collect_list("shift").alias("shifts"))
    shifts = written(spark, sized_join(shifts, tests, ["item"], "inner", "body").select("rid", "fp", "item", "item_id", "body", "shifts"), "diagonals")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        share, last, mine = Fraction(str(least_share)), None, np.zeros(0, U)
        for batch in batches:
            col = {f.name: batch.column(i) for i, f in enumerate(batch.schema)}
            rows, at = [], []
            for i, (key, body, shifts_) in enumerate(zip(zip(col["rid"].to_pylist(), col["fp"].to_pylist(), strict=True), col["body"].to_pylist(), col["shifts"].to_pylist(), strict=True)):
                if key != last:  # a document's rows are neighbours after the join
                    last, mine = key, tokens([col["text"][i].as_py() or b""])[0]
                best = _best(mine, tokens([body])[0], sorted(shifts_), least_matched, share)
                if best:
                    at.append(i)
                    rows.append(best)
            picked = {c: col[c].take(pa.array(at, pa.int64())) for c in ("doc_id", "rid", "fp", "item_id")}
            yield pa.RecordBatch.from_pydict(picked | {c: pa.array([r[j] for r in rows], pa.int64()) for j, c in enumerate(_FOUND[1:])})

    pairs = keyed.hint("merge").join(shifts, ["rid", "fp"]).select("doc_id", "rid", "fp", "text", "item_id", "body", "shifts")
    return pairs.mapInArrow(compare, "doc_id long, rid long, fp long, " + ", ".join(f"{c} long" for c in _FOUND))


def _best(mine: np.ndarray, item: np.ndarray, shifts: list[int], least_matched: int, share: Fraction) -> tuple | None:
    """(matched, tokens, start in the document, start in the item) of the best stretch on any of the diagonals."""
    best, need = None, min(least_matched, len(item))
    for shift in shifts:
        lo, hi = max(0, -shift), min(len(item), len(mine) - shift)
        equal = item[lo:hi] == mine[lo + shift : hi + shift]
        if np.count_nonzero(equal) < need:
            continue
        begin, end, matched = best_stretch(equal, share)
        if matched >= need and (best is None or matched > best[0]):
            best = (matched, end - begin, lo + begin + shift, lo + begin)
    return best


def _overlaps(texts: list[bytes], index: dict, masks: tuple[str, ...], least_matched: int, least_share: float) -> list[tuple]:
    hashes, text = tokens(texts)
    first = np.concatenate(([0], np.cumsum(np.bincount(text, minlength=len(texts)))))
    short, hits = [], []
    for n, (keys, of) in index["whole"].items():
        key, place = _whole(hashes, text, n)
        some = np.flatnonzero(keys[np.minimum(np.searchsorted(keys, key), len(keys) - 1)] == key)
        # the first place in each document is enough
        _, once = np.unique(np.column_stack((text[place[some]], key[some].view(np.int64))), axis=0, return_index=True)
        for j in np.sort(some[once]).tolist():
            p, d = int(place[j]), int(text[place[j]])
            for t in of[np.searchsorted(keys, key[j], "left") : np.searchsorted(keys, key[j], "right")].tolist():
                short.append((d, int(index["ids"][t]), n, n, p - int(first[d]), 0))
    for i, mask in enumerate(masks if len(index["key"]) else ()):
        key, place = seed_hashes(hashes, text, mask, i + 1)
        low = np.searchsorted(index["key"], key, "left")
        some = np.flatnonzero(index["key"][np.minimum(low, len(index["key"]) - 1)] == key)
        low = low[some]
        many = np.searchsorted(index["key"], key[some], "right") - low
        total = np.cumsum(many)
        a = 0
        while a < len(some):  # a portion of hits at a time: seeds may be common, but diagonals recur
            b = max(a + 1, int(np.searchsorted(total, (total[a - 1] if a else 0) + HITS, "right")))
            n = many[a:b]
            at = np.repeat(low[a:b] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
            from_, to = np.repeat(place[some[a:b]], n), index["place"][at]
            hits.append(np.unique(np.column_stack((text[from_], index["text"][to], from_ - to)), axis=0))
            a = b
    found = []
    if hits:
        diagonal = np.unique(np.concatenate(hits), axis=0)
        cut = np.flatnonzero(np.diff(diagonal[:, 0], prepend=-1) | np.diff(diagonal[:, 1], prepend=-1))
        share = Fraction(str(least_share))
        for a, b in zip(cut.tolist(), [*cut[1:].tolist(), len(diagonal)], strict=True):
            d, t = diagonal[a, :2].tolist()
            item, mine = index["hashes"][index["first"][t] : index["first"][t + 1]], hashes[first[d] : first[d + 1]]
            best = _best(mine, item, [x + int(index["first"][t]) - int(first[d]) for x in diagonal[a:b, 2].tolist()], least_matched, share)
            if best:
                found.append((d, int(index["ids"][t]), *best))
    return short + found


def without_overlap(spark: SparkSession, docs: DataFrame, items: DataFrame, **how) -> DataFrame:
    """The rows of ``docs`` that overlap with no item, all columns as they are; rows are told apart by id and text."""
    rid, fp = names = free_names(docs, "__rid", "__fp")
    hit = written(spark, _found(spark, docs, items, **how).select(F.col("rid").alias(rid), F.col("fp").alias(fp)).distinct(), "contaminated")
    keys = {rid: F.coalesce(F.col(how.get("id_col", "doc_id")).cast("long"), F.lit(-1)), fp: F.xxhash64(how.get("text_col", "text"))}
    return sized_join(docs.withColumns(keys), hit, names, "left_anti").drop(*names)
