"""Operator 2: packing of token pieces by non-negative least squares over the length histogram.

1. One pass tokenizes every document, cuts it at multiples of the window, and keeps of each piece its length, the CRC of its
   ids and, packed, the ids of those that may be cut again.
2. Piece lengths are rounded up to bins. All combinations of up to ``depth`` bins that fill the window exactly are
   the columns of a matrix; least squares with non-negative repeat counts fits them to the histogram. The counts are
   rounded down to what the histogram can supply, and the residual pieces are packed greedily by their exact lengths, longest
   first. Lengths for which that leaves more than ``spare`` of a window open are laid end to end on a tape, which is cut into
   windows and, at its end, into powers of two. So no sequence is padded by more than the rounding of a combination or
   ``spare``. This works on the histogram alone, whose size does not depend on the data's.
3. Pieces get their rank within the bin, longest first, from counts per length and salt (no window over a whole bin, which may
   hold a third of all rows), and the plan turns (bin, rank) into a sequence, or into a place on the tape.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import blocks, kept, keyed_documents, lower_ascii, sized_join, written
from .hashing import U, byte_values, mix, prefix_sums, span_hash

WINDOW = 4096
BIN = 16
DEPTH = 3
#: A greedy sequence may leave one part in so many of its window open.
SPARE = 64
END_ID = 2
#: Pieces of one bin that are ranked together, about.
SALT_ROWS = 500_000
#: Units whose ids a worker remembers, and how many new ones are tokenized as one text.
CACHE_UNITS, TOGETHER = 2_000_000, 512

_PIECE_COLUMNS = ("doc_id", "start", "length", "ids_crc32", "doc_tokens")
_PIECE = ", ".join(f"{c} long" for c in _PIECE_COLUMNS)

_SPACE, _LETTER, _DIGIT, _OTHER, _ODD = range(5)
_KIND = np.full(256, _ODD, np.uint8)
_KIND[:128] = _OTHER
_KIND[[*range(ord("a"), ord("z") + 1), *range(ord("A"), ord("Z") + 1)]] = _LETTER
_KIND[ord("0") : ord("9") + 1] = _DIGIT
_KIND[list(b" \t\n\v\f\r")] = _SPACE
#: Second bytes of the letters U+00C0 to U+00FF, whose first byte is 0xC3.
_SECOND = np.zeros(256, bool)
_SECOND[[x for x in range(0x80, 0xC0) if x not in (0x97, 0xB7)]] = True


class Units:
    """What the tokenizer takes apart from each other: runs of letters, single digits, runs of the rest, contractions.

    They are found for a whole block at once. A word with other characters than ASCII and the letters of Latin-1, or
    with the beginning of a special token, is one unit, left to the tokenizer as it is ("odd").
    """

    def __init__(self, texts: list[bytes]):
        data = b" ".join(texts)
        self.raw = np.frombuffer(data, np.uint8)
        buf = np.frombuffer(lower_ascii(data), np.uint8)
        n = len(buf)
        kind = np.zeros(n + 4, np.uint8)
        kind[:n] = _KIND[buf]
        lead = np.flatnonzero(buf[:-1] == 0xC3) if n else np.zeros(0, np.int64)
        lead = lead[_SECOND[buf[lead + 1]]]
        if len(lead):
            kind[lead] = kind[lead + 1] = _LETTER
            buf = buf.copy()
            buf[lead + 1] |= np.where(buf[lead + 1] < 0x9F, 0x20, 0).astype(np.uint8)
        inside = kind != _SPACE
        edge = np.flatnonzero(np.diff(np.concatenate(([False], inside)).view(np.int8)))
        word_begin, word_end = edge[::2], edge[1::2]
        odd = np.concatenate((np.flatnonzero(kind == _ODD), np.flatnonzero((buf[:-1] == ord("<")) & (buf[1:] == ord("|"))) if n else np.zeros(0, np.int64)))
        odd = np.unique(np.searchsorted(word_begin, odd, "right") - 1)
        start = inside.copy()
        start[1:] &= (kind[1:] != kind[:-1]) | (kind[1:] == _DIGIT)
        padded = np.concatenate((buf, np.zeros(4, np.uint8)))
        mark = np.flatnonzero(start & (padded == ord("'")))
        one, two = padded[mark + 1], padded[mark + 2]
        for size, which in ((2, np.isin(one, np.frombuffer(b"stmd", np.uint8))), (3, (one == ord("r")) & (two == ord("e")) | (one == ord("v")) & (two == ord("e")) | (one == ord("l")) & (two == ord("l")))):
            at = mark[which]
            start[at + 1] = False
            start[at + size] = inside[at + size]
        if len(odd):
            cover = np.zeros(n + 5, np.int8)
            cover[word_begin[odd]] = 1
            cover[word_end[odd]] -= 1
            start &= ~np.cumsum(cover[:-1], dtype=np.int8).view(bool)
            start[word_begin[odd]] = True
        self.buf = buf
        self.begin = np.flatnonzero(start)
        self.end = np.flatnonzero(inside[:-1] & (start[1:] | ~inside[1:])) + 1
        self.hash = mix(span_hash(prefix_sums(byte_values(buf)), self.begin, self.end)) if n else np.zeros(0, U)
        self.odd = np.zeros(len(self.begin), bool)
        self.odd[np.searchsorted(self.begin, word_begin[odd])] = True
        for i in np.flatnonzero(self.odd).tolist():
            self.hash[i] = xxhash.xxh3_64_intdigest(self.text(i), 1)
        text_begin = np.concatenate(([0], np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1)))
        self.first = np.searchsorted(self.begin, text_begin[: len(texts) + 1])

    def text(self, i: int) -> bytes:
        return (self.raw if self.odd[i] else self.buf)[self.begin[i] : self.end[i]].tobytes()


class Vocabulary:
    """Ids of the units met so far, by hash: a large sorted array, a small one of the latest, and all ids in a row."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.clear()

    def clear(self) -> None:
        self.keys = [np.zeros(0, U), np.zeros(0, U)]
        self.rows = [np.zeros(0, np.int64), np.zeros(0, np.int64)]
        self.begin, self.count, self.ids = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32)

    def _find(self, keys: np.ndarray) -> np.ndarray:
        out = np.full(len(keys), -1)
        for have, rows in zip(self.keys, self.rows, strict=True):
            if len(have):
                at = np.minimum(np.searchsorted(have, keys), len(have) - 1)
                hit = have[at] == keys
                out[hit] = rows[at[hit]]
        return out

    def _encode(self, units: list[str], odd: list[str]) -> list[np.ndarray]:
        found: list[np.ndarray] = []
        for i in range(0, len(units), TOGETHER):
            part = units[i : i + TOGETHER]
            made = self.tokenizer.encode(" ".join(part), add_special_tokens=False)
            word, ids = np.array(made.word_ids, np.int64), np.array(made.ids, np.uint32)
            edge = np.searchsorted(word, np.arange(len(part) + 1))
            if len(word) and word[-1] == len(part) - 1 and (np.diff(edge) > 0).all():
                found += [ids[a:b] for a, b in zip(edge[:-1], edge[1:], strict=True)]
            else:
                found += self._encode([], part)
        for i in range(0, len(odd), 2000):
            found += [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(odd[i : i + 2000], add_special_tokens=False)]
        return found

    def rows_of(self, units: Units) -> np.ndarray:
        """For each unit its row in ``begin`` and ``count``; new ones are tokenized."""
        if len(self.count) > CACHE_UNITS:
            self.clear()
        keys, first, place = np.unique(units.hash, return_index=True, return_inverse=True)
        row = self._find(keys)
        new = np.flatnonzero(row < 0)
        if len(new):
            new = np.concatenate((new[~units.odd[first[new]]], new[units.odd[first[new]]]))
            strings = [units.text(i).decode("utf-8", "replace") for i in first[new].tolist()]
            plain = int((~units.odd[first[new]]).sum())
            made = self._encode(strings[:plain], strings[plain:])
            count = np.fromiter(map(len, made), np.int64, len(made))
            row[new] = np.arange(len(made)) + len(self.count)
            self.begin = np.concatenate((self.begin, len(self.ids) + np.cumsum(count) - count))
            self.count = np.concatenate((self.count, count))
            self.ids = np.concatenate((self.ids, *made))
            self._merge(1, keys[new], row[new])
            if len(self.keys[1]) > 10_000 + len(self.keys[0]) // 4:
                self._merge(0, self.keys[1], self.rows[1])
                self.keys[1], self.rows[1] = np.zeros(0, U), np.zeros(0, np.int64)
        return row[place]

    def _merge(self, level: int, keys: np.ndarray, rows: np.ndarray) -> None:
        keys, rows = np.concatenate((self.keys[level], keys)), np.concatenate((self.rows[level], rows))
        order = np.argsort(keys, kind="stable")
        self.keys[level], self.rows[level] = keys[order], rows[order]


def token_ids(texts: list[bytes], path: str) -> list[bytes]:
    """Each text's ids as little-endian 32-bit bytes, without the end id.

    The tokenizer drops white space and no token spans what it splits at, so each distinct unit is tokenized once.
    """
    vocabulary = kept(f"vocabulary of {path}", lambda: Vocabulary(path))
    units = Units(texts)
    row = vocabulary.rows_of(units)
    count = vocabulary.count[row]
    end = np.concatenate(([0], np.cumsum(count)))
    ids = vocabulary.ids[np.arange(end[-1]) + np.repeat(vocabulary.begin[row] - end[:-1], count)].astype("<u4")
    cut = end[units.first]
    return [ids[a:b].tobytes() for a, b in zip(cut[:-1], cut[1:], strict=True)]


def least_squares(matrix: np.ndarray, target: np.ndarray, rounds: int = 3000, tol: float = 1e-6) -> np.ndarray:
    """Non-negative x that minimises |matrix x - target|: the active-set method."""
    n = matrix.shape[1]
    x, passive = np.zeros(n), np.zeros(n, bool)
    gain = matrix.T @ target
    for _ in range(rounds):
        open_ = np.where(passive, -np.inf, gain)
        j = int(np.argmax(open_))
        if open_[j] <= tol * max(1.0, np.abs(target).max()):
            break
        passive[j] = True
        while True:
            cols = np.flatnonzero(passive)
            z = np.linalg.lstsq(matrix[:, cols], target, rcond=None)[0]
            if (z > 0).all():
                x[:] = 0
                x[cols] = z
                break
            bad = z <= 0
            step = np.min(x[cols][bad] / np.maximum(x[cols][bad] - z[bad], 1e-300))
            x[cols] += step * (z - x[cols])
            passive[cols[(x[cols] <= 1e-12) & bad]] = False
            x[~passive] = 0
            if not passive.any():
                break
        gain = matrix.T @ (target - matrix @ x)
    return x


def combinations(top: int, depth: int) -> list[tuple[int, ...]]:
    """Multisets of up to ``depth`` bins (1..top) whose sum is ``top``."""
    found: list[tuple[int, ...]] = []

    def grow(left: int, least: int, have: tuple[int, ...]) -> None:
        if left == 0:
            found.append(have)
        elif len(have) < depth:
            if len(have) == depth - 1:
                if left >= least:
                    found.append((*have, left))
                return
            for b in range(least, left + 1):
                grow(left - b, b, (*have, b))

    grow(top, 1, ())
    return list(dict.fromkeys(found))


def plan(lengths: np.ndarray, width: int = BIN, depth: int = DEPTH) -> tuple[list[tuple[list[tuple[int, int, int]], int]], list[tuple[int, int, int]]]:
    """What becomes of all pieces; ``lengths[n]`` of them have length n (the last index is the window).

    Pieces of a bin stand in a queue, longest first. Sequences: (intervals, repeats), an interval being (bin, first place in
    its queue, pieces a sequence). Tape: (length, first place, number of pieces).
    """
    window = len(lengths) - 1
    top = -(-window // width)
    bin_of = np.minimum(-(-np.arange(window + 1) // width), top)
    # where each length begins in its bin's queue, and where the queue goes on
    begin = np.zeros(window + 1, np.int64)
    for b in range(1, top + 1):
        own = np.flatnonzero(bin_of == b)[::-1]
        begin[own] = np.cumsum(lengths[own]) - lengths[own]
    histogram = np.bincount(bin_of, weights=lengths, minlength=top + 1).astype(np.int64)
    used = np.zeros(top + 1, np.int64)
    out: list[tuple[list[tuple[int, int, int]], int]] = []

    def take(pattern: tuple[int, ...], times: int) -> None:
        bins, many = np.unique(pattern, return_counts=True)
        out.append(([(int(b), int(used[b]), int(m)) for b, m in zip(bins, many, strict=True)], times))
        used[bins] += many * times

    full = int(lengths[window])
    if full:
        take((top,), full)
    left = histogram - used
    patterns = [p for p in combinations(top, depth) if len(p) > 1 and all(left[b] for b in p)]
    if patterns:
        rows = np.flatnonzero(left)
        row = {int(b): i for i, b in enumerate(rows)}
        matrix = np.zeros((len(rows), len(patterns)))
        for j, p in enumerate(patterns):
            for b in p:
                matrix[row[b], j] += 1
        x = least_squares(matrix, left[rows].astype(float))
        for j in np.argsort(-x, kind="stable"):
            bins, many = np.unique(patterns[j], return_counts=True)
            times = min(int(round(x[j])), int(((histogram - used)[bins] // many).min()))
            if times > 0:
                take(patterns[j], times)
    # the rest by exact lengths: fill a window with the longest pieces that still fit, as often as the supply allows
    gone = np.clip(used[bin_of] - begin, 0, lengths)
    tape = []
    while (gone < lengths).any():
        room, pattern = window, {}
        supply = lengths - gone
        longest = int(np.flatnonzero(supply)[-1])
        while room > 0 and len(fits := np.flatnonzero(supply[: room + 1])):
            n = int(fits[-1])
            pattern[n] = min(int(supply[n]), room // n)
            supply[n] -= pattern[n]
            room -= n * pattern[n]
        if room > window // SPARE:
            tape.append((longest, int(begin[longest] + gone[longest]), int(lengths[longest] - gone[longest])))
            gone[longest] = lengths[longest]
            continue
        times = min(int(lengths[n] - gone[n]) // m for n, m in pattern.items())
        out.append(([(int(bin_of[n]), int(begin[n] + gone[n]), m) for n, m in pattern.items()], times))
        for n, m in pattern.items():
            gone[n] += m * times
    return out, tape


def tape_ends(total: int, window: int) -> np.ndarray:
    """Ends of the sequences that the last part of a tape is cut into: powers of two, the largest first."""
    rest, at, ends = total % window, total - total % window, []
    for bit in reversed(range(rest.bit_length())):
        if rest >> bit & 1:
            at += 1 << bit
            ends.append(at)
    return np.array(ends, np.int64)


def _pieces(keyed: DataFrame, tokenizer: str, window: int) -> DataFrame:
    schema = f"{_PIECE}, ids binary"
    end = np.array([END_ID], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        small = zstandard.ZstdCompressor(level=1)
        for batch, texts in blocks(batches):
            ids = batch.column(batch.schema.get_field_index("doc_id")).to_pylist()
            rows, kept_ids = [], []
            for doc, data in zip(ids, token_ids(texts, tokenizer), strict=True):
                data += end
                n = len(data) // 4
                for a in range(0, n, window):
                    piece = data[4 * a : 4 * (a + window)]
                    rows.append((doc, a, len(piece) // 4, zlib.crc32(piece), n))
                    kept_ids.append(small.compress(piece) if len(piece) < 4 * window else None)
            yield pa.RecordBatch.from_arrays([*(pa.array(v, pa.int64()) for v in zip(*rows, strict=True)), pa.array(kept_ids, pa.binary())], names=[*_PIECE_COLUMNS, "ids"])

    return keyed.mapInArrow(run, schema)


def pack_documents(spark: SparkSession, docs: DataFrame, tokenizer: str, window: int = WINDOW, width: int = BIN, depth: int = DEPTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset``.

    ``tokenizer``: path of a tokenizers file. A document's ids end with id 2; null and empty texts have that id alone.
    Documents are cut at multiples of ``window``, and where the tape is cut. Within a sequence pieces stand without gaps.
    A sequence that is shorter than the window is to be padded to it, unless its length is a power of two.
    Rows that repeat an id are documents of their own; an empty table gives no rows.
    """
    top = -(-window // width)
    pieces = written(spark, _pieces(keyed_documents(docs, id_col, text_col), tokenizer, window), "pieces")
    bin_of = F.least(F.ceil(F.col("length") / width), F.lit(top)).cast("int")
    salts = max(8, -(-pieces.count() // SALT_ROWS))
    pieces = pieces.select("*", bin_of.alias("bin"), F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(salts)).alias("salt"))
    counts = written(spark, pieces.groupBy("bin", "length", "salt").agg(F.count("*").alias("n")), "length_counts")
    # at most ``window`` counts reach the driver
    lengths = np.zeros(window + 1, np.int64)
    for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect():
        lengths[r["length"]] = r["n"]
    earlier = Window.partitionBy("bin").orderBy(F.desc("length"), "salt").rowsBetween(Window.unboundedPreceding, -1)
    before = written(spark, counts.select("length", "salt", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before")), "length_ranks")
    sequences, tape = plan(lengths, width, depth)
    # for each bin: intervals of its queue, and of each the first sequence and how many pieces a sequence takes; or, with 0
    # pieces, where it begins on the tape
    intervals: dict[int, list[tuple[int, int, int]]] = {}
    sequence = position = 0
    for parts, times in sequences:
        for b, low, many in parts:
            intervals.setdefault(b, []).append((low, sequence, many))
        sequence += times
    for n, low, many in tape:
        intervals.setdefault(min(-(-n // width), top), []).append((low, position, 0))
        position += n * many
    lookup = {b: tuple(np.array(x, np.int64) for x in zip(*sorted(v), strict=True)) for b, v in intervals.items()}
    ends, whole, taped = tape_ends(position, window), position // window, [n for n, _, _ in tape]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        big = zstandard.ZstdDecompressor()
        for batch in batches:
            col = {c: batch.column(batch.schema.get_field_index(c)) for c in (*_PIECE_COLUMNS, "bin", "rank", "ids")}
            length, bins, rank = (col[c].to_numpy(zero_copy_only=False) for c in ("length", "bin", "rank"))
            out, at = np.zeros(len(rank), np.int64), np.full(len(rank), -1, np.int64)
            for b in np.unique(bins):
                mine = np.flatnonzero(bins == b)
                low, base, many = lookup[int(b)]
                i = np.searchsorted(low, rank[mine], "right") - 1
                on_tape = many[i] == 0
                out[mine] = base[i] + (rank[mine] - low[i]) // np.maximum(many[i], 1)
                at[mine[on_tape]] = (base[i] + (rank[mine] - low[i]) * length[mine])[on_tape]
            plain = np.flatnonzero(at < 0)
            yield pa.RecordBatch.from_arrays([*(col[c].take(pa.array(plain)) for c in _PIECE_COLUMNS), pa.array(out[plain])], names=[*_PIECE_COLUMNS, "sequence_id"])
            rows = []
            for j in np.flatnonzero(at >= 0).tolist():
                doc, start, n, crc, total = (col[c][j].as_py() for c in _PIECE_COLUMNS)
                p, data = int(at[j]), None
                stop = p + n
                while p < stop:
                    if p < whole * window:
                        s, edge = p // window, (p // window + 1) * window
                    else:
                        s = int(np.searchsorted(ends, p, "right"))
                        s, edge = whole + s, int(ends[s])
                    size = min(edge, stop) - p
                    if size < n:
                        data = data or big.decompress(col["ids"][j].as_py())
                        k = p - int(at[j])
                        crc = zlib.crc32(data[4 * k : 4 * (k + size)])
                    rows.append((doc, start + p - int(at[j]), size, crc, total, sequence + s))
                    p += size
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(v, pa.int64()) for v in zip(*rows, strict=True)], names=[*_PIECE_COLUMNS, "sequence_id"])

    nth = F.row_number().over(Window.partitionBy("length", "salt").orderBy("doc_id", "start", "ids_crc32"))
    # ids go along only with pieces that may lie on the tape
    ids = F.when(F.col("length").isin(taped), F.col("ids")) if taped else F.lit(None).cast("binary")
    ranked = sized_join(pieces.withColumn("ids", ids).withColumn("nth", nth), before, ["length", "salt"], "inner")
    ranked = ranked.select(*_PIECE_COLUMNS, "bin", (F.col("nth") - 1 + F.col("before")).alias("rank"), "ids")
    placed = ranked.mapInArrow(place, f"{_PIECE}, sequence_id long")
    inside = Window.partitionBy("sequence_id").orderBy(F.desc("length"), "doc_id", "start", "ids_crc32").rowsBetween(Window.unboundedPreceding, -1)
    return placed.withColumn("offset", F.coalesce(F.sum("length").over(inside), F.lit(0))).select(*_PIECE_COLUMNS, "sequence_id", "offset")
