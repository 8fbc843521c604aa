"""Operator 7: interpolated modified Kneser-Ney n-gram model, counted in Spark, in sorted hash arrays.

1. Words are counted: every owner (a range of word hashes) writes a sorted array of hashes and one of counts to the
   shared folder. A word's id is its place in all ranges.
2. Tasks count n-grams of the highest order over large runs of training text, and send each as ids, sorted and
   compressed, to the owner of its word before the last; a word with a large share of all tokens is split further by
   the last word. There all orders down to two are complete: what follows from an n-gram, its context and the n-gram
   without its first word, has the same word before the last. Only context totals of split words, and how many words
   a word follows, are sent on and added up by further owners.
3. For each order an owner writes sorted hash arrays of n-grams with their counts (of the highest order) or numbers of
   distinct words before them (of the others), and of contexts with totals and numbers of n-grams by count.
4. Workers map the arrays into memory and look up the distinct n-grams of a block of text.

Nothing of the model passes through the driver but totals, file names and the words that are split.
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Iterator
from urllib.parse import urlparse

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import blocks, fold, keyed_documents, lower_ascii, packed, shuffle_partitions, table_path, unpacked, written
from .exchange import golomb_decode, golomb_encode
from .hashing import _BASE, U, Words, mix, owner_of

#: Stands for the end of a text; no word has this hash but by chance.
END = U(0x1F83D9ABFB41BD6B)
#: Words of the longest n-grams.
ORDER = 3
#: Tokens whose n-grams a task counts before it sends them.
RUN_TOKENS = 2_000_000


def text_tokens(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(token hashes with an end after each text, tokens of each text)."""
    words = Words([lower_ascii(t) for t in texts])
    n = words.counts + 1
    tokens = np.full(int(n.sum()), END, U)
    is_word = np.ones(len(tokens), bool)
    is_word[np.cumsum(n) - 1] = False
    tokens[is_word] = words.hash
    return tokens, n


def _local(uri: str) -> str | None:
    parts = urlparse(uri)
    return parts.path if parts.scheme in ("", "file") else None


def save_arrays(uri: str, arrays: dict[str, np.ndarray]) -> None:
    """One file of several arrays. A repeated task does no harm: it writes to a name of its own, then renames."""
    head, at = {}, 0
    for name, a in arrays.items():
        head[name] = (a.dtype.str, at, a.size)
        at += -(-a.nbytes // 8) * 8
    first = json.dumps(head).encode()
    first += b" " * (-len(first) % 8)
    parts = [np.array([len(first)], "<u8").tobytes(), first]
    for a in arrays.values():
        parts += [np.ascontiguousarray(a).tobytes(), b"\0" * (-a.nbytes % 8)]
    path = _local(uri)
    if path:
        os.makedirs(os.path.dirname(path), exist_ok=True)
        own = f"{path}.{uuid.uuid4().hex}"
        with open(own, "wb") as out:
            out.writelines(parts)
        os.replace(own, path)
    else:
        from pyarrow import fs

        store, path = fs.FileSystem.from_uri(uri)
        store.create_dir(os.path.dirname(path), recursive=True)
        own = f"{path}.{uuid.uuid4().hex}"
        with store.open_output_stream(own) as out:
            for p in parts:
                out.write(p)
        store.move(own, path)


def load_arrays(uri: str) -> dict[str, np.ndarray]:
    """Memory-mapped where the shared folder is mounted, else read."""
    path = _local(uri)
    if path:
        data = np.memmap(path, np.uint8, "r").view(np.ndarray)
    else:
        from pyarrow import fs

        store, path = fs.FileSystem.from_uri(uri)
        with store.open_input_file(path) as f:
            data = np.frombuffer(f.read(), np.uint8)
    base = 8 + int(data[:8].view("<u8")[0])
    head = json.loads(bytes(data[8:base]))
    return {name: data[base + at : base + at + np.dtype(kind).itemsize * n].view(kind) for name, (kind, at, n) in head.items()}


def hash_array(keys: np.ndarray, values: np.ndarray) -> dict[str, np.ndarray]:
    """Sorted distinct keys with rows of values, as arrays.

    The first bits of a key say in which short stretch it is, the next 32 are stored. Values are codes into the table
    of their distinct rows: most n-grams occur once.
    """
    n = len(keys)
    bits = max(0, n.bit_length() - 3)
    bucket = (keys >> U(64 - bits)).astype(np.int64) if bits else np.zeros(n, np.int64)
    rest = ((keys << U(bits)) >> U(32)).astype("<u4")
    first = np.searchsorted(bucket, np.arange((1 << bits) + 1)).astype("<u4" if n < 1 << 32 else "<u8")
    values = values.reshape(n, values.shape[1] if values.ndim > 1 else 1).astype(np.int64)
    width = values.shape[1]
    if n and int(values.max()) < 1 << (62 // width):  # rows as one number each
        row = values[:, 0]
        for c in range(1, width):
            row = row * (1 << (62 // width)) + values[:, c]
        # most rows are alike: they need no sorting
        common = row == np.median(row[:: max(1, n // 1000)]).astype(np.int64)
        index, other = distinct(mix(row[~common].astype(U)))
        kinds, code = values[~common][index], np.zeros(n, np.int64)
        code[~common] = other
        if common.any():
            code[common] = len(kinds)
            kinds = np.concatenate((kinds, values[np.argmax(common)][None]))
    else:
        kinds, code = np.unique(values, axis=0, return_inverse=True)
    small = "<u1" if len(kinds) <= 1 << 8 else "<u2" if len(kinds) <= 1 << 16 else "<u4"
    return {"first": first, "rest": rest, "code": code.ravel().astype(small), "kinds": kinds.astype("<i8").ravel()}


def find(array: dict[str, np.ndarray], keys: np.ndarray, width: int) -> np.ndarray:
    """Rows of values of ``keys``, zeros where absent."""
    out = np.zeros((len(keys), width), np.int64)
    if not len(array["rest"]):
        return out
    bits = (len(array["first"]) - 1).bit_length() - 1
    bucket = (keys >> U(64 - bits)).astype(np.int64) if bits else np.zeros(len(keys), np.int64)
    rest = ((keys << U(bits)) >> U(32)).astype(np.uint32)
    begin, end = array["first"][bucket].astype(np.int64), array["first"][bucket + 1].astype(np.int64)
    place = np.full(len(keys), -1)
    open_ = np.flatnonzero(begin < end)
    begin, end, rest = begin[open_], end[open_], rest[open_]
    # a stretch has four to eight keys, evenly spread: look where the key should be, then go on in its direction
    at = begin + ((rest.astype(np.int64) * (end - begin)) >> 32)
    have = array["rest"][at]
    hit = have == rest
    place[open_[hit]] = at[hit]
    for step in (1, -1):
        side = np.flatnonzero(have < rest if step > 0 else have > rest)
        which, here, stop, mine = open_[side], at[side] + step, (end if step > 0 else begin - 1)[side], rest[side]
        while len(which):
            inside = here != stop
            which, here, stop, mine = which[inside], here[inside], stop[inside], mine[inside]
            found = array["rest"][here]
            same = found == mine
            place[which[same]] = here[same]
            more = found < mine if step > 0 else found > mine
            which, here, stop, mine = which[more], here[more] + step, stop[more], mine[more]
    found = np.flatnonzero(place >= 0)
    out[found] = array["kinds"].reshape(-1, width)[array["code"][place[found]]]
    return out


def sorting(keys: np.ndarray) -> np.ndarray:
    """An order that sorts 64-bit keys (not stable).

    Places are sorted along in the low bits of the keys, which is several times as fast as argsort; if two keys differ in
    these bits alone, argsort it is.
    """
    low = max(1, len(keys).bit_length())
    mask = U((1 << low) - 1)
    if len(keys) and int(keys.max()).bit_length() + low <= 64:
        return (np.sort((keys << U(low)) | np.arange(len(keys), dtype=U)) & mask).astype(np.int64)
    order = (np.sort((keys & ~mask) | np.arange(len(keys), dtype=U)) & mask).astype(np.int64)
    ranked = keys[order]
    return order if (ranked[1:] >= ranked[:-1]).all() else np.argsort(keys)


def distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(a place of each distinct key, in order of the keys; which of them each key is)."""
    order = sorting(keys.astype(U))
    ranked = keys[order]
    head = np.concatenate(([True], ranked[1:] != ranked[:-1]))[: len(keys)]
    place = np.empty(len(keys), np.int64)
    place[order] = np.cumsum(head) - 1
    return order[head], place


def by_owner(owner: np.ndarray, owners: int) -> tuple[np.ndarray, np.ndarray]:
    """(order that brings each owner's rows together, where each owner's begin)."""
    order = np.argsort(owner.astype(np.uint16) if owners < 1 << 16 else owner, kind="stable")  # a radix sort
    return order, np.concatenate(([0], np.cumsum(np.bincount(owner, minlength=owners))))


def _summed(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys, and the sums of their rows of values."""
    if not len(keys):
        return keys, values
    order = sorting(keys.astype(U))
    keys = keys[order]
    head = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    if values.ndim == 1:
        return keys[head], np.add.reduceat(values[order], head)
    return keys[head], np.column_stack([np.add.reduceat(c[order], head) for c in values.T])


def _small(values: np.ndarray) -> np.ndarray:
    return values.astype(np.uint8 if len(values) == 0 or values.max() < 256 else np.uint32 if values.max() < 1 << 32 else np.uint64)


def chained(columns: list[np.ndarray]) -> np.ndarray:
    """Hash of the ids in a row."""
    key = np.full(len(columns[0]), len(columns), U)
    for c in columns:
        key = mix(key * U(_BASE) + c.astype(U) + U(1))
    return key


def lagged(ids: np.ndarray, n: np.ndarray, order: int, begin: int) -> list[np.ndarray]:
    """The ``order`` - 1 ids before each token, farthest first, and its own; ``begin`` where the text has none."""
    inside = np.arange(len(ids)) - np.repeat(np.cumsum(n) - n, n)
    columns = []
    for lag in range(order - 1, 0, -1):
        c = np.full(len(ids), begin, ids.dtype)
        c[lag:] = np.where(inside[lag:] >= lag, ids[:-lag], begin)
        columns.append(c)
    return [*columns, ids]


class Vocabulary:
    """Words with their counts, in files by range of the hash. Ids go on from range to range."""

    def __init__(self, base: str, sizes: dict[int, int], owners: int, tokens: int):
        self.base, self.sizes, self.owners, self.tokens = base, sizes, owners, tokens
        self.starts = np.concatenate(([0], np.cumsum([sizes.get(o, 0) for o in range(owners)])))
        self.size = int(self.starts[-1])
        self.begin, self.unknown = self.size + 1, self.size
        self._open: dict[int, dict] = {}

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_open": {}}

    def lookup(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(id, count) of sorted distinct word hashes."""
        ids, counts = np.full(len(keys), self.unknown), np.zeros(len(keys), np.int64)
        cut = np.searchsorted(owner_of(keys, self.owners), np.arange(self.owners + 1))
        for o in self.sizes:
            a, b = cut[o], cut[o + 1]
            if b > a and self.sizes[o]:
                if o not in self._open:
                    self._open[o] = load_arrays(f"{self.base}/words/{o}")
                have = self._open[o]["keys"]
                at = np.minimum(np.searchsorted(have, keys[a:b]), len(have) - 1)
                hit = np.flatnonzero(have[at] == keys[a:b])
                ids[a + hit], counts[a + hit] = self.starts[o] + at[hit], self._open[o]["counts"][at[hit]]
        return ids, counts

    def ids(self, tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        index, place = distinct(tokens)
        ids, counts = self.lookup(tokens[index])
        return ids[place], counts[place]


def _owner(before: np.ndarray, last: np.ndarray, owners: int, split: np.ndarray) -> np.ndarray:
    """Owner of n-grams by the word before the last, of split words by both."""
    key = mix(before.astype(U) + U(1))
    some = np.isin(before, split)
    key[some] = mix(key[some] * U(_BASE) + last[some].astype(U))
    return owner_of(key, owners)


def _planes(column: np.ndarray) -> bytes:
    """A column byte by byte, all lowest bytes first: sorted columns compress well so."""
    wide = 4 if len(column) == 0 or int(column.max()) < 1 << 32 else 8
    return bytes([wide]) + column.astype(f"<u{wide}").view(np.uint8).reshape(-1, wide).T.tobytes()


def _unplaned(data: bytes) -> np.ndarray:
    wide = data[0]
    return np.ascontiguousarray(np.frombuffer(data, np.uint8, offset=1).reshape(wide, -1).T).view(f"<u{wide}").ravel().astype(np.int64)


def encode_grams(columns: list[np.ndarray], times: np.ndarray) -> bytes:
    """N-grams sorted by the word before the last, then the last: these two as differences."""
    before, last = columns[-2], columns[-1]
    step = np.diff(before, prepend=0)
    fresh = np.concatenate(([True], step[1:] != 0)) if len(step) else np.zeros(0, bool)
    return packed(([_planes(step), _planes(np.where(fresh, last, np.diff(last, prepend=0))), *map(_planes, columns[:-2])], _small(times)))


def decode_grams(payload: bytes) -> tuple[list[np.ndarray], np.ndarray]:
    planes, times = unpacked(payload)
    step, last, *rest = map(_unplaned, planes)
    fresh = np.concatenate(([True], step[1:] != 0)) if len(step) else np.zeros(0, bool)
    total = np.cumsum(last)
    head = np.flatnonzero(fresh)
    total -= np.repeat(total[head] - last[head], np.diff(np.append(head, len(last))))
    return [*rest, np.cumsum(step), total], times.astype(np.int64)


def _send_words(batches: Iterator[pa.RecordBatch], owners: int) -> Iterator[pa.RecordBatch]:
    held: list[np.ndarray] = []
    count = 0

    def flush() -> pa.RecordBatch:
        words = np.concatenate(held)
        index, place = distinct(words)
        words, times = words[index], np.bincount(place, minlength=len(index))
        cut = np.searchsorted(owner_of(words, owners), np.arange(owners + 1))
        rows = [(o, packed((golomb_encode(words[a:b]), _small(times[a:b])))) for o, (a, b) in enumerate(zip(cut[:-1], cut[1:], strict=True)) if b > a]
        return pa.RecordBatch.from_pydict({"owner": pa.array([r[0] for r in rows], pa.int32()), "payload": pa.array([r[1] for r in rows], pa.binary())})

    for _, texts in blocks(batches):
        held.append(text_tokens(texts)[0])
        count += len(held[-1])
        if count >= RUN_TOKENS:
            yield flush()
            held, count = [], 0
    if count:
        yield flush()


def vocabulary(spark: SparkSession, keyed: DataFrame, base: str) -> tuple[Vocabulary, np.ndarray]:
    """The words, and the ids of those that are split: more than one in twice as many tokens as there are owners."""
    owners = shuffle_partitions(spark)

    def merge(rows: pd.DataFrame) -> pd.DataFrame:
        owner = int(rows["owner"].iloc[0])
        coded = [unpacked(p) for p in rows["payload"]]
        words, count = _summed(np.concatenate([golomb_decode(k) for k, _ in coded]), np.concatenate([n.astype(np.int64) for _, n in coded]))
        save_arrays(f"{base}/words/{owner}", {"keys": words.astype("<u8"), "counts": count.astype("<i8")})
        return pd.DataFrame({"owner": [owner], "words": [len(words)], "tokens": [int(count.sum())]})

    sent = keyed.select("text").mapInArrow(lambda b: _send_words(b, owners), "owner int, payload binary")
    found = sent.groupBy("owner").applyInPandas(merge, "owner int, words long, tokens long").collect()
    words = Vocabulary(base, {r["owner"]: r["words"] for r in found}, owners, sum(r["tokens"] for r in found))

    def frequent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for o in batch.column(0).to_pylist():
                if words.sizes.get(o):
                    have = load_arrays(f"{base}/words/{o}")
                    often = np.flatnonzero(have["counts"] * 2 * owners > words.tokens)
                    end = have["keys"][often] == END
                    yield pa.RecordBatch.from_pydict({"id": pa.array(np.concatenate((words.starts[o] + often, np.full(int(end.sum()), words.begin))), pa.int64())})

    split = spark.range(owners, numPartitions=owners).mapInArrow(frequent, "id long").collect()
    return words, np.array(sorted(r["id"] for r in split), np.int64)


def _send_grams(batches: Iterator[pa.RecordBatch], words: Vocabulary, split: np.ndarray, order: int) -> Iterator[pa.RecordBatch]:
    held: list[list[np.ndarray]] = []
    count = 0

    def flush() -> pa.RecordBatch:
        columns = [np.concatenate(c) for c in zip(*held, strict=True)]
        index, place = distinct(chained(columns))
        columns, times = [c[index] for c in columns], np.bincount(place, minlength=len(index))
        by = sorting((columns[-2].astype(U) << U(32)) + columns[-1].astype(U)) if words.begin < 1 << 32 else np.lexsort((columns[-1], columns[-2]))
        columns, times = [c[by] for c in columns], times[by]
        by, cut = by_owner(_owner(columns[-2], columns[-1], words.owners, split), words.owners)
        columns, times = [c[by] for c in columns], times[by]
        rows = [(o, encode_grams([c[a:b] for c in columns], times[a:b])) for o, (a, b) in enumerate(zip(cut[:-1], cut[1:], strict=True)) if b > a]
        return pa.RecordBatch.from_pydict({"owner": pa.array([r[0] for r in rows], pa.int32()), "payload": pa.array([r[1] for r in rows], pa.binary())})

    kind = np.uint32 if words.begin < 1 << 32 else np.int64
    for _, texts in blocks(batches):
        tokens, n = text_tokens(texts)
        held.append([c.astype(kind) for c in lagged(words.ids(tokens)[0], n, order, words.begin)])
        count += len(tokens)
        if count >= RUN_TOKENS:
            yield flush()
            held, count = [], 0
    if count:
        yield flush()


def _levels(columns: list[np.ndarray], times: np.ndarray) -> Iterator[tuple[list[np.ndarray], np.ndarray, np.ndarray]]:
    """(columns, keys, counts) of distinct n-grams, from the highest order to two; lower ones count the words before."""
    keys = chained(columns)
    while True:
        index, place = distinct(keys)
        times = np.bincount(place, weights=times, minlength=len(index)).astype(np.int64)
        keys, columns = keys[index], [c[index] for c in columns]
        yield columns, keys, times
        if len(columns) == 2:
            return
        columns = columns[1:]
        keys, times = chained(columns), np.ones(len(keys), np.int64)


def _classes(values: np.ndarray) -> list[int]:
    """How many values are 1, 2, 3, 4."""
    return np.bincount(np.minimum(values, 5), minlength=6)[1:5].tolist()


class Model:
    """Array files and totals: enough to score text."""

    def __init__(self, words: Vocabulary, split: np.ndarray, order: int, totals: dict):
        self.words, self.split, self.order, self.t = words, split, order, totals
        self.d = {n: discounts(totals["times"][n]) for n in range(1, order + 1)}
        self._open: dict[str, dict] = {}

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_open": {}}

    def _find(self, kind: str, keys: np.ndarray, owner: np.ndarray, width: int) -> np.ndarray:
        """Rows of values from the files ``kind``, for keys that need not be distinct."""
        few = max(1, self.words.owners.bit_length())
        by = sorting((owner.astype(U) << U(64 - few)) | (keys >> U(few)))  # look-ups in order of the keys stay in the cache
        cut = np.concatenate(([0], np.cumsum(np.bincount(owner, minlength=self.words.owners))))
        keys, out = keys[by], np.zeros((len(keys), width), np.int64)
        for o in np.flatnonzero(np.diff(cut)).tolist():
            if o in self.t["files"][kind]:
                uri = f"{self.words.base}/{kind}/{o}"
                if uri not in self._open:
                    self._open[uri] = load_arrays(uri)
                out[by[cut[o] : cut[o + 1]]] = find(self._open[uri], keys[cut[o] : cut[o + 1]], width)
        return out

    def _follows(self, ids: np.ndarray) -> np.ndarray:
        """How many distinct words each word follows."""
        index, place = distinct(ids)
        known, out = ids[index], np.zeros(len(index), np.int64)
        cut = np.searchsorted(known, self.words.starts)
        for o in self.t["files"]["follows"]:
            a, b = cut[o], cut[o + 1]
            if b > a:
                uri = f"{self.words.base}/follows/{o}"
                if uri not in self._open:
                    self._open[uri] = load_arrays(uri)
                out[a:b] = self._open[uri]["follows"][known[a:b] - self.words.starts[o]]
        return out[place]

    def score(self, texts: list[bytes]) -> dict[str, np.ndarray]:
        tokens, n = text_tokens(texts)
        t, first = self.t, np.cumsum(n) - n
        if not self.words.tokens:
            zero = np.zeros(len(texts))
            return {"n_tokens": n, "n_known": np.zeros(len(texts), np.int64), "base_score": zero, "score": zero}
        ids, count = self.words.ids(tokens)
        columns = lagged(ids, n, self.order, self.words.begin)
        # lowest order: distinct words followed, smoothed with an even share for each known word and one unknown
        follows, kinds = self._follows(ids), max(1, t["kinds"])
        spare = sum(d * x for d, x in zip(self.d[1], t["follow_classes"], strict=True)) / kinds
        p = np.maximum(follows - _discount(follows, self.d[1]), 0) / kinds + spare / (self.words.size + 1)
        by_gram = _owner(columns[-2], columns[-1], self.words.owners, self.split)
        plain = _owner(columns[-2], columns[-1], self.words.owners, self.split[:0])
        in_split = np.isin(columns[-2], self.split)
        for k in range(2, self.order + 1):
            mine = columns[self.order - k :]
            c = self._find(f"grams{k}", chained(mine), by_gram, 1)[:, 0]
            context = chained(mine[:-1])
            stats = np.zeros((len(ids), 4), np.int64)
            for where, kind, owner in ((~in_split, f"contexts{k}", plain), (in_split, f"split{k}", owner_of(context, self.words.owners))):
                some = np.flatnonzero(where)
                stats[some] = self._find(kind, context[some], owner[some], 4)
            total = np.maximum(stats[:, 0], 1)
            seen = np.maximum(c - _discount(c, self.d[k]), 0) / total + (stats[:, 1:] * self.d[k]).sum(axis=1) / total * p
            p = np.where(stats[:, 0] > 0, seen, p)
        base = np.log10((count + 0.1) / (self.words.tokens + 0.1 * (self.words.size + 1)))
        return {"n_tokens": n, "n_known": np.add.reduceat(count > 0, first, dtype=np.int64), "base_score": np.add.reduceat(base, first), "score": np.add.reduceat(np.log10(p), first)}


def discounts(times: list[int]) -> list[float]:
    """Modified Kneser-Ney discounts for counts 1, 2, 3+, from how many n-grams occur once to four times."""
    n1, n2, n3, n4 = (max(1, x) for x in times)
    y = n1 / (n1 + 2 * n2)
    raw = [1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3]
    return [float(min(max(d, 0.05), i + 0.95)) for i, d in enumerate(raw)]


def _discount(counts: np.ndarray, d: list[float]) -> np.ndarray:
    return np.array([0.0, *d])[np.minimum(counts, 3)]


def fit(spark: SparkSession, keyed: DataFrame, order: int = ORDER) -> Model:
    """Count the texts of ``keyed`` (column text) and write the arrays."""
    if order < 2:
        raise ValueError("the order is 2 at least")
    base = table_path(spark, "lm")
    words, split = vocabulary(spark, keyed, base)
    shared = spark.sparkContext.broadcast((words, split))  # names of files, sizes, and few words
    sent = keyed.select("text").mapInArrow(lambda b: _send_grams(b, *shared.value, order), "owner int, payload binary")

    def merge(rows: pd.DataFrame) -> pd.DataFrame:
        words, split = shared.value
        owner = int(rows["owner"].iloc[0])
        parts = [decode_grams(p) for p in rows["payload"]]
        columns = [np.concatenate(c) for c in zip(*(p[0] for p in parts), strict=True)]
        times = np.concatenate([p[1] for p in parts])
        del parts
        out: list[tuple[str, int, bytes]] = []
        numbers = {}
        for columns, keys, times in _levels(columns, times):  # noqa: B020
            k = len(columns)
            save_arrays(f"{base}/grams{k}/{owner}", hash_array(keys, times))
            numbers[k] = _classes(times)
            context = chained(columns[:-1])
            stats = np.column_stack((times, times == 1, times == 2, times >= 3)).astype(np.int64)
            cut_up = np.isin(columns[-2], split)
            whole, sums = _summed(context[~cut_up], stats[~cut_up])
            save_arrays(f"{base}/contexts{k}/{owner}", hash_array(whole, sums))
            part, sums = _summed(context[cut_up], stats[cut_up])
            cut = np.searchsorted(owner_of(part, words.owners), np.arange(words.owners + 1))
            out += [(f"split{k}", o, packed((golomb_encode(part[a:b]), [_small(x) for x in sums[a:b].T]))) for o, (a, b) in enumerate(zip(cut[:-1], cut[1:], strict=True)) if b > a]
        index, place = distinct(columns[-1])
        met, follow = columns[-1][index], np.bincount(place, minlength=len(index))
        cut = np.searchsorted(met, words.starts)
        out += [("follows", o, packed((_planes(met[a:b] - words.starts[o]), _small(follow[a:b])))) for o, (a, b) in enumerate(zip(cut[:-1], cut[1:], strict=True)) if b > a]
        out.append(("file", owner, packed((numbers, len(columns[0])))))
        return pd.DataFrame(out, columns=["kind", "owner", "payload"])

    merged = written(spark, sent.groupBy("owner").applyInPandas(merge, "kind string, owner int, payload binary"), "lm_words")

    def collect(rows: pd.DataFrame) -> pd.DataFrame:
        words, _ = shared.value
        owner, kind = int(rows["owner"].iloc[0]), rows["kind"].iloc[0]
        parts = [unpacked(p) for p in rows["payload"]]
        if kind == "follows":
            follows = np.zeros(words.sizes[owner], np.int64)
            for planes, n in parts:
                follows[_unplaned(planes)] += n.astype(np.int64)
            save_arrays(f"{base}/follows/{owner}", {"follows": follows.astype("<u4" if follows.max() < 1 << 32 else "<u8")})
            told = (_classes(follows), [int((follows == 1).sum()), int((follows == 2).sum()), int((follows >= 3).sum())])
        else:
            keys, sums = _summed(np.concatenate([golomb_decode(k) for k, _ in parts]), np.concatenate([np.column_stack([c.astype(np.int64) for c in v]) for _, v in parts]))
            save_arrays(f"{base}/{kind}/{owner}", hash_array(keys, sums))
            told = None
        return pd.DataFrame({"kind": [kind], "owner": [owner], "payload": [packed(told)]})

    further = merged.where("kind <> 'file'").groupBy("kind", "owner").applyInPandas(collect, "kind string, owner int, payload binary").collect()
    own = [(r["owner"], *unpacked(bytes(r["payload"]))) for r in merged.where("kind = 'file'").collect()]
    files: dict[str, set[int]] = {f"{name}{k}": {o for o, _, _ in own} for name in ("grams", "contexts") for k in range(2, order + 1)}
    files |= {"follows": set()} | {f"split{k}": set() for k in range(2, order + 1)}
    low = [unpacked(bytes(r["payload"])) for r in further if r["kind"] == "follows"]
    for r in further:
        files[r["kind"]].add(r["owner"])
    total = lambda rows, n: [int(sum(x)) for x in zip(*rows, strict=True)] if rows else [0] * n
    times = {k: total([numbers[k] for _, numbers, _ in own], 4) for k in range(2, order + 1)} | {1: total([x[0] for x in low], 4)}
    return Model(words, split, order, {"files": files, "times": times, "kinds": sum(n for _, _, n in own), "follow_classes": total([x[1] for x in low], 3)})


def score_documents(spark: SparkSession, docs: DataFrame, order: int = ORDER, folds: int = 10, held_out: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: ``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity``.

    The model of n-grams of up to ``order`` words learns from all documents outside the held-out fold and scores all.
    Null and empty texts are the end token alone; without training text both scores are 0. ``perplexity`` is
    10^(-score / n_tokens). Rows that repeat a document are counted and scored each time; an empty table gives no rows.
    """
    keyed = keyed_documents(docs, id_col, text_col).withColumn("held_out", fold("doc_id", folds) == held_out)
    model = fit(spark, keyed.where("not held_out"), order)
    held = spark.sparkContext.broadcast(model)  # names of files and totals
    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, perplexity double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in blocks(batches, 4 << 20):
            got = held.value.score(texts)
            col = {c: batch.column(batch.schema.get_field_index(c)) for c in ("doc_id", "held_out")}
            col |= {"n_tokens": pa.array(got["n_tokens"].astype(np.int64)), "n_known": pa.array(got["n_known"]), "train_tokens": pa.array(np.full(len(texts), held.value.words.tokens, np.int64))}
            yield pa.RecordBatch.from_pydict(col | {"base_score": pa.array(got["base_score"]), "score": pa.array(got["score"]), "perplexity": pa.array(10 ** (-got["score"] / got["n_tokens"]))})

    return keyed.mapInArrow(run, schema)
