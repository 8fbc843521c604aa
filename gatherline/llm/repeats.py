"""The frame of both substring removers: bring text that may repeat together, let a solver find what does.

A window (35 words, 200 bytes) belongs to its anchor: its least k-gram. Equal windows have equal anchors at the same
distance from their start, so windows of different anchors never need to meet.

1. Every document lists its anchors; a Golomb-coded exchange tells which occur anywhere else. What has none is done.
2. The others are read again; each run of windows with one repeated anchor becomes a segment of text. Equal
   segments of a task collapse to one with a flag, before anything is shuffled (a passage that a third of all
   documents share is sent once a task). Segments go to a bucket of the anchor's hash, packed by the solver.
3. The solver finds, in each bucket, the windows that occur twice. Its answer returns as bits to the task
   ("shard") that sent the segment, where the places of its copies were kept.
4. Anchors that occur more than ``HOT`` times (a passage of many documents, each with other text around it) would
   bring too much together. There the prefix grows to the whole window: the windows of hot anchors go through the same
   exchange by their own hashes, and those that occur anywhere else become segments of one window each, keyed by that
   hash. Equal ones of a task collapse as above, and the same solver decides.
5. Repeated windows of a document are merged to covered intervals. Rows that repeat a document count like all others.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import blocks, packed, shuffle_partitions, texts_of, unbits, unpacked, written
from .exchange import CHUNK_KEYS, key_bits, keyed_pass, messages, repeated_keys
from .hashing import U, Words, anchors, byte_values, gather, gram_hash, mix, owner_of, prefix_sums, span_hash


@dataclass
class Segments:
    """Runs of windows with one anchor. Starts and places are counted in units from the start of the block."""

    key: np.ndarray  # hash of the anchor, mixed once more: anchors are least hashes, and would crowd in the first range
    place: np.ndarray
    first: np.ndarray  # start of the first window
    last: np.ndarray  # start of the last one
    text: np.ndarray  # which text of the block
    base: np.ndarray  # the text's first unit
    same: np.ndarray  # hash of the whole segment
    byte_begin: np.ndarray
    byte_end: np.ndarray
    sums: np.ndarray  # prefix sums of the block's units, for hashes of windows
    unit_begin: np.ndarray  # where each unit of the block begins and ends
    unit_end: np.ndarray


class ByteUnits:
    """Texts as sequences of bytes."""

    def __init__(self, window: int, k: int):
        self.window, self.k = window, k

    def segments(self, texts: list[bytes]) -> tuple[Segments, np.ndarray, np.ndarray]:
        """The segments, the block's bytes, and each text's number of units."""
        buf = np.frombuffer(b"".join(texts), np.uint8)
        counts = np.fromiter(map(len, texts), np.int64, len(texts))
        first = np.concatenate(([0], np.cumsum(counts)))
        values = byte_values(buf)
        grams = gram_hash(values, self.k)
        ok = np.zeros(max(0, len(buf) - self.window + 1), bool)
        change = np.zeros(len(ok) + 1, np.int32)
        room = np.flatnonzero(counts >= self.window)
        np.add.at(change, first[room], 1)
        np.add.at(change, first[room] + counts[room] - self.window + 1, -1)
        ok[:] = np.cumsum(change)[:-1] > 0
        place, a, b = anchors(grams, ok, self.window, self.k)
        text = np.searchsorted(first, a, "right") - 1
        text = np.minimum(text, len(texts) - 1)
        sums = prefix_sums(values) if len(a) else np.zeros(1, U)
        same = span_hash(sums, a, b + self.window) if len(a) else np.zeros(0, U)
        return Segments(mix(grams[place]) if len(a) else np.zeros(0, U), place, a, b, text, first[text], same, a, b + self.window, sums, np.arange(len(buf)), np.arange(1, len(buf) + 1)), buf, counts


class WordUnits:
    """Texts as sequences of words."""

    def __init__(self, window: int, k: int):
        self.window, self.k = window, k

    def segments(self, texts: list[bytes]) -> tuple[Segments, np.ndarray, np.ndarray]:
        words = Words(texts)
        grams = gram_hash(words.hash, self.k)
        n = max(0, len(words.hash) - self.window + 1)
        ok = words.text[:n] == words.text[self.window - 1 :][:n]
        place, a, b = anchors(grams, ok, self.window, self.k)
        text = words.text[a]
        sums = prefix_sums(words.hash)
        same = span_hash(sums, a, b + self.window) if len(a) else np.zeros(0, U)
        begin = words.begin[a] if len(a) else a
        end = words.end[b + self.window - 1] if len(a) else a
        return Segments(mix(grams[place]) if len(a) else np.zeros(0, U), place, a, b, text, words.first[text], same, begin, end, sums, words.begin, words.end), words.buf, words.counts


#: Occurrences of an anchor up to which its segments meet in one bucket.
HOT = 2000
#: A shard is closed at this many distinct segments.
SHARD_SEGMENTS = 12_000
#: Bytes of text that are looked at together, and occurrences of anchors in a bucket: both bound a worker's memory.
BLOCK_BYTES, BUCKET_SEGMENTS = 1 << 19, 20_000


def covered_intervals(spark: SparkSession, keyed: DataFrame, units: ByteUnits | WordUnits, pack: Callable, solve: Callable, per_text: Callable, extra: str, tag: str) -> tuple[DataFrame, DataFrame]:
    """(a row per document with the ``extra`` columns of ``per_text``; the covered intervals of documents that have some).

    ``pack(shard rows of all buckets)`` makes each bucket's message; ``solve(list of messages)`` returns for each
    message a boolean matrix, rows by offsets: whether the window at that offset of the row's segment repeats.
    """
    window, width = units.window, units.window - units.k + 1

    def keys_of(texts: list[bytes], _batch: pa.RecordBatch) -> tuple[dict, np.ndarray, np.ndarray]:
        seg, _, counts = units.segments(texts)
        return per_text(texts, counts), seg.key, np.bincount(seg.text, minlength=len(texts))

    kept = key_bits(keyed.count())
    cut_key = U(((1 << kept) - 1) << (64 - kept))
    table = keyed_pass(spark, keyed, keys_of, extra, f"{tag}_anchors", block_bytes=BLOCK_BYTES, key_bits=kept)
    known = written(spark, repeated_keys(table, HOT, key_bits=kept).select("rid", "fp", "payload", "hot"), f"{tag}_repeated")
    anchors_known = known.agg(F.sum(F.length("payload") + F.length("hot"))).first()[0] or 0
    known = written(spark, known.groupBy("rid", "fp").agg(F.first("payload").alias("payload"), F.first("hot").alias("hot")), f"{tag}_known")
    # by shuffle at every size: what repeats is a share of all documents
    again = keyed.select("rid", "fp", "text").join(known.hint("merge"), ["rid", "fp"])
    owners = shuffle_partitions(spark)
    buckets = max(4 * owners, -(-anchors_known // (8 * BUCKET_SEGMENTS)))

    def rows(kind: str, chunk: list, owner: list, payload: list, rid: list | np.ndarray | None = None, fp: list | np.ndarray | None = None, starts: list | None = None) -> pa.RecordBatch:
        n = len(chunk)
        ids = [pa.array(x, pa.int64()) if x is not None else pa.nulls(n, pa.int64()) for x in (None, rid, fp)]
        return pa.RecordBatch.from_arrays([pa.array([kind] * n, pa.string()), pa.array(chunk, pa.int64()), pa.array(owner, pa.int32()), *ids, pa.array(payload, pa.binary()), pa.array(starts, pa.binary()) if starts is not None else pa.nulls(n, pa.binary())], names=["kind", "chunk", "owner", "doc_id", "rid", "fp", "payload", "starts"])

    def hot_messages(name: int, held: list[np.ndarray]) -> pa.RecordBatch:
        found = messages(held, owners)
        return rows("hot", [name] * len(found), [o for o, _ in found], [p for _, p in found])

    def hot_rows(name: int, ids: np.ndarray, seg: Segments, buf: np.ndarray, use: np.ndarray) -> tuple[pa.RecordBatch, np.ndarray]:
        """A row for each document with windows of hot anchors, and the hashes of these; the row carries their text."""
        use = use[np.argsort(seg.text[use], kind="stable")]
        many, length = seg.last[use] - seg.first[use] + 1, seg.byte_end[use] - seg.byte_begin[use]
        start = np.arange(int(many.sum())) + np.repeat(seg.first[use] - np.concatenate(([0], np.cumsum(many)))[:-1], many)
        keys = mix(span_hash(seg.sums, start, start + window))
        data, at = gather(buf, seg.byte_begin[use], length), np.cumsum(length) - length
        begin = seg.unit_begin[start] + np.repeat(at - seg.byte_begin[use], many)
        end = seg.unit_end[start + window - 1] + np.repeat(at - seg.byte_begin[use], many)
        own = start - np.repeat(seg.base[use], many)
        texts, head = np.unique(seg.text[use], return_index=True)
        windows, total = np.concatenate(([0], np.cumsum(many))), np.concatenate((at, [int(length.sum())]))
        payload, places = [], []
        for a, b in zip(head, [*head[1:], len(use)], strict=True):
            part = slice(windows[a], windows[b])
            payload.append(keys[part].tobytes())
            places.append(packed((own[part].astype(np.int32), (begin[part] - total[a]).astype(np.int32), (end[part] - begin[part]).astype(np.int32), data[total[a] : total[b]])))
        return rows("hot", [name] * len(texts), [-1] * len(texts), payload, ids[texts, 0], ids[texts, 1], places), keys

    def shard(name: int, held: list[dict]) -> pa.RecordBatch:
        docs = np.concatenate([x["doc"] for x in held]).astype(np.int64)
        joined = {c: np.concatenate([x[c] for x in held]) for c in ("owner_doc", "key", "same", "lead", "first", "many")}
        ident = mix(mix(joined["key"] ^ mix(joined["same"])) + joined["lead"].astype(U) * U(1 << 20) + joined["many"].astype(U))
        _, index, inverse, times = np.unique(ident, return_index=True, return_inverse=True, return_counts=True)
        bucket = owner_of(joined["key"][index], buckets)
        order = np.argsort(bucket, kind="stable")
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        index, bucket, times = index[order], bucket[order], times[order]
        lengths = np.concatenate([x["length"] for x in held])
        starts = np.cumsum(lengths) - lengths
        data = np.concatenate([x["data"] for x in held])
        cut = np.flatnonzero(np.diff(bucket, prepend=-1))
        picked = {"data": gather(data, starts[index], lengths[index]), "length": lengths[index], "lead": joined["lead"][index], "many": joined["many"][index], "often": times > 1}
        parts = pack(picked, cut)
        places = {"docs": docs, "doc": joined["owner_doc"], "first": joined["first"], "many": joined["many"], "row": rank[inverse]}
        return rows("cold", [name] * (1 + len(cut)), [-1, *bucket[cut].tolist()], [packed(places), *map(packed, parts)])

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 24
        held, count, hot_keys, hot_count = [], 0, [], 0
        for batch, texts in blocks(batches, BLOCK_BYTES):
            rid, fp, known_keys, hot = (batch.column(batch.schema.get_field_index(c)) for c in ("rid", "fp", "payload", "hot"))
            ids = np.column_stack((rid.to_numpy(), fp.to_numpy()))
            seg, buf, _ = units.segments(texts)
            wanted = np.unique(np.frombuffer(b"".join(known_keys.to_pylist()), U))
            common = np.unique(np.frombuffer(b"".join(hot.to_pylist()), U))
            short = seg.key & cut_key
            often = np.isin(short, common)  # a hot anchor is hot for all
            if often.any():
                out, keys = hot_rows(name, ids, seg, buf, np.flatnonzero(often))
                yield out
                hot_keys.append(keys)
                hot_count += len(keys)
            use = np.flatnonzero(np.isin(short, wanted) & ~often)
            if len(use):
                length = seg.byte_end[use] - seg.byte_begin[use]
                at = sum(len(x["doc"]) for x in held)
                held.append({"doc": ids, "owner_doc": seg.text[use] + at, "key": seg.key[use], "same": seg.same[use], "lead": seg.place[use] - seg.first[use], "first": seg.first[use] - seg.base[use], "many": seg.last[use] - seg.first[use] + 1, "length": length, "data": gather(buf, seg.byte_begin[use], length)})
                count += len(use)
            if count >= SHARD_SEGMENTS or hot_count >= CHUNK_KEYS:
                if count:
                    yield shard(name, held)
                if hot_count:
                    yield hot_messages(name, hot_keys)
                name, held, count, hot_keys, hot_count = name + 1, [], 0, [], 0
        if count:
            yield shard(name, held)
        if hot_count:
            yield hot_messages(name, hot_keys)

    sent = written(spark, again.mapInArrow(shards, "kind string, chunk long, owner int, doc_id long, rid long, fp long, payload binary, starts binary"), f"{tag}_segments")

    def window_shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Shards of the windows of hot anchors that the exchange has found anywhere else."""
        name = (1 << 60) + ((TaskContext.get().partitionId() if TaskContext.get() else 0) << 24)
        held, count = [], 0
        for batch in batches:
            for rid, fp, keys, places, mask in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                keys = np.frombuffer(keys, U)
                own, begin, length, data = unpacked(places)
                mask = unbits(mask, len(own))
                own, begin, length = own[mask].astype(np.int64), begin[mask].astype(np.int64), length[mask].astype(np.int64)
                nothing = np.zeros(len(keys), np.int64)
                held.append({"doc": np.array([[rid, fp]], np.int64), "owner_doc": nothing + len(held), "key": mix(keys), "same": keys, "lead": nothing, "first": own, "many": nothing + 1, "length": length, "data": gather(data, begin, length)})
                count += len(keys)
                if count >= SHARD_SEGMENTS:
                    yield shard(name, held).select(["chunk", "owner", "payload"])
                    name, held, count = name + 1, [], 0
        if count:
            yield shard(name, held).select(["chunk", "owner", "payload"])

    hot = repeated_keys(sent.where("kind = 'hot'"), carry=("starts",))
    hot = written(spark, hot.select("rid", "fp", "payload", "starts", "mask").mapInArrow(window_shards, "chunk long, owner int, payload binary"), f"{tag}_windows")
    cold = sent.where("kind = 'cold'").select("chunk", "owner", "payload").unionByName(hot).select(F.col("chunk").alias("shard"), F.col("owner").alias("bucket"), "payload")

    def answer(rows: pd.DataFrame) -> pd.DataFrame:
        found = solve([unpacked(x) for x in rows["payload"]])
        return pd.DataFrame({"shard": rows["shard"], "bucket": rows["bucket"], "payload": [packed(np.packbits(x, axis=1)) for x in found]})

    def intervals(mine: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        out = {"rid": [], "fp": [], "payload": []}
        for payload in mine["payload"]:
            places = unpacked(payload)
            flags = np.concatenate([unpacked(x) for x in answers.sort_values("bucket")["payload"]])
            flags = np.unpackbits(flags, axis=1, count=width).astype(bool)
            docs, starts = [], []
            for a in range(0, len(places["row"]), 50_000):  # bounds the unpacked matrix
                part = slice(a, a + 50_000)
                occurrence, offset = np.nonzero(flags[places["row"][part]] & (np.arange(width) < places["many"][part, None]))
                docs.append(places["doc"][part][occurrence])
                starts.append(places["first"][part][occurrence] + offset)
            doc, start = np.concatenate(docs), np.concatenate(starts)
            if not len(doc):
                continue
            order = np.lexsort((start, doc))
            doc, start = doc[order], start[order]
            head = np.concatenate(([True], (np.diff(doc) != 0) | (np.diff(start) > window)))
            tail = np.append(head[1:], True)
            doc, spans = doc[head], np.column_stack((start[head], start[tail] + window)).astype(np.int64)
            cut = np.flatnonzero(np.diff(doc, prepend=-1))
            for a, b in zip(cut, [*cut[1:], len(doc)], strict=True):
                rid, fp = places["docs"][doc[a]]
                out["rid"].append(rid)
                out["fp"].append(fp)
                out["payload"].append(spans[a:b].tobytes())
        return pd.DataFrame(out)

    answers = cold.where("bucket >= 0").groupBy("bucket").applyInPandas(answer, "shard long, bucket int, payload binary")
    spans = cold.where("bucket < 0").select("shard", "payload").groupBy("shard").cogroup(answers.groupBy("shard")).applyInPandas(intervals, "rid long, fp long, payload binary")
    # a document's spans of all shards, one after another; rows repeated whole have the same
    spans = spans.groupBy("rid", "fp").agg(F.unhex(F.concat_ws("", F.transform(F.collect_set("payload"), F.hex))).alias("payload"))
    return table.where("owner < 0").drop("chunk", "owner", "payload"), written(spark, spans, f"{tag}_spans")


def merged_spans(spans: np.ndarray) -> np.ndarray:
    """Intervals as they are covered: sorted, with overlapping and touching ones put together."""
    if len(spans) < 2:
        return spans.astype(np.int64)
    spans = spans[np.argsort(spans[:, 0], kind="stable")]
    reach = np.maximum.accumulate(spans[:, 1])
    head = np.flatnonzero(np.concatenate(([True], spans[1:, 0] > reach[:-1])))
    return np.column_stack((spans[head, 0], reach[np.append(head[1:] - 1, len(spans) - 1)])).astype(np.int64)


def remove_spans(keyed: DataFrame, table: DataFrame, spans: DataFrame, cut: Callable, schema: str) -> DataFrame:
    """Rows without a span as ``table`` has them, the others re-read and cut: ``cut(text, spans)`` gives the columns of ``schema``."""
    names = [x.split()[0] for x in schema.split(",")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            payload = batch.column(batch.schema.get_field_index("payload")).to_pylist()
            made = [cut(t, merged_spans(np.frombuffer(p, np.int64).reshape(-1, 2))) for t, p in zip(texts_of(batch.column(batch.schema.get_field_index("text"))), payload, strict=True)]
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column(batch.schema.get_field_index("doc_id"))} | dict(zip(names, map(list, zip(*made, strict=True)), strict=True)) if made else {"doc_id": pa.array([], pa.int64())} | {n: [] for n in names})

    hit = keyed.select("doc_id", "rid", "fp", "text").join(spans.hint("merge"), ["rid", "fp"])
    whole = table.join(spans.select("rid", "fp").hint("merge"), ["rid", "fp"], "left_anti")
    return whole.select("doc_id", *names).unionByName(hit.select("doc_id", "text", "payload").mapInArrow(run, f"doc_id long, {schema}"))
