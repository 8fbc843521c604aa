"""Operator 12: hard negatives by lists that the anchors of a cluster share.

1. Rows become whole numbers and are packed into blocks, a matrix each. Anchors are clustered by direction (spherical
   k-means; the centres are fitted to a bounded sample, which decides about speed alone).
2. A cluster's anchors, in pieces of a bounded size, meet the blocks by a shuffle on (group of blocks, group of pieces).
   For a piece and a block the candidates are sorted once, by what none of the piece's anchors can exceed: the length
   times the cosine of the angle to the centre less the widest angle of the piece. Every anchor walks that list, scored
   a stretch at a time by one product of matrices, until the bound falls below the least score that could still enter
   its result: then no later candidate can.
3. Anchor by anchor, Spark ranks what the walks brought. Positives come first; their scores are the bands of the second
   walk. With many blocks, a few of them are walked before the others, and the scores found there are lower bounds
   that let all later walks stop early. They leave nothing out: a walk stops only where its bound is certain.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import packed, unpacked, written

#: Rows of a block as a power of two, and components of a block, at most.
BLOCK_BITS, BLOCK_VALUES = 14, 1 << 22
#: Anchors of a piece, about; pieces and blocks of a group; candidates of a list scored at a time.
PIECE, PIECES, BLOCKS, STRETCH = 512, 64, 2, 4096
#: Anchors to which the centres are fitted, and centres, at most.
SAMPLE, CENTRES = 4096, 256
#: One block in so many is walked first, where there are more blocks than this.
SEEDS = 16
#: Components are held within this, so that a score of up to 1024 of them is exact.
MOST = 1 << 26
_NONE = np.iinfo(np.int64).min // 4


def _matrix(rows: list[np.ndarray]) -> np.ndarray:
    """Vectors as the rows of a matrix; shorter ones are filled with zeros."""
    out = np.zeros((len(rows), max(map(len, rows), default=0)), np.int32)
    for i, r in enumerate(rows):
        out[i, : len(r)] = r
    return out


def _same_width(*parts: np.ndarray) -> list[np.ndarray]:
    width = max(p.shape[1] for p in parts)
    return [np.pad(p, ((0, 0), (0, width - p.shape[1]))) for p in parts]


def _blocks(vectors: DataFrame, rows: int) -> DataFrame:
    """``block, payload``: (ids, labels, whole numbers, anchor flags) of bounded runs of rows, as they are read."""
    target = pa.schema([("block", pa.int64()), ("payload", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 24
        held: list[tuple] = []
        count = values = 0

        def flushed() -> pa.RecordBatch:
            ids, labels, flags = (np.concatenate([h[k] for h in held]) for k in (0, 1, 3))
            matrix = np.concatenate(_same_width(*(h[2] for h in held)))
            return pa.RecordBatch.from_arrays([pa.array([block]), pa.array([packed((ids, labels, matrix, flags))], pa.binary())], schema=target)

        for batch in batches:
            for begin in range(0, batch.num_rows, 1024):
                part = batch.slice(begin, 1024)
                lists = part.column(3)
                flat = pc.list_flatten(lists).to_numpy(zero_copy_only=False).astype(np.float64)
                whole = np.clip(np.floor(flat * 256), -MOST, MOST).astype(np.int32)
                each = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
                matrix = whole.reshape(len(each), -1) if len(each) and each.min() == each.max() else _matrix(np.split(whole, np.cumsum(each)[:-1]))
                if held and (count + len(each) > rows or values + matrix.size > BLOCK_VALUES):
                    yield flushed()
                    block, held, count, values = block + 1, [], 0, 0
                held.append((part.column(0).to_numpy(), part.column(1).to_numpy(), matrix, part.column(2).to_numpy(zero_copy_only=False).astype(bool)))
                count, values = count + len(each), values + matrix.size
        if held:
            yield flushed()

    return vectors.mapInArrow(run, "block long, payload binary")


def _units(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(rows of length one, lengths); a row of zeros stays."""
    wide = matrix.astype(np.float64)
    length = np.sqrt((wide * wide).sum(1))
    return wide / np.where(length > 0, length, 1)[:, None], length


def centres(matrix: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    """Directions of ``k`` clusters of the rows: spherical k-means from evenly chosen rows."""
    units, _ = _units(matrix)
    middle = units[np.linspace(0, len(units) - 1, k).astype(int)]
    for _ in range(rounds):
        near = np.argmax(units @ middle.T, 1)
        total = np.zeros_like(middle)
        np.add.at(total, near, units)
        fresh, length = _units(total)
        middle = np.where(length[:, None] > 0, fresh, middle)
    return middle


def _anchors(blocks: DataFrame) -> DataFrame:
    """``row, anchor_id, label, vector``: the anchors of all blocks; ``row`` is where it stands."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, payload in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids, labels, matrix, flags = unpacked(payload)
                at = np.flatnonzero(flags)
                yield pa.RecordBatch.from_pydict({"row": pa.array((block << BLOCK_BITS) + at), "anchor_id": pa.array(ids[at]), "label": pa.array(labels[at]), "vector": pa.array([matrix[i].tobytes() for i in at], pa.binary())})

    return blocks.mapInArrow(run, "row long, anchor_id long, label long, vector binary")


def _vectors(column: pd.Series) -> np.ndarray:
    return _matrix([np.frombuffer(x, np.int32) for x in column])


def _clustered(anchors: DataFrame, middle: np.ndarray) -> DataFrame:
    """Anchors with the nearest centre and the angle to it."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            if len(f):
                units, centre = _same_width(_units(_vectors(f["vector"]))[0], middle)
                cosine = units @ centre.T
                near = np.argmax(cosine, 1)
                yield f.assign(cluster=near.astype(np.int32), angle=np.arccos(np.clip(cosine[np.arange(len(f)), near], -1, 1)))

    return anchors.mapInPandas(run, "row long, anchor_id long, label long, vector binary, cluster int, angle double")


def _pieces(anchors: DataFrame, middle: np.ndarray, sizes: dict[int, int]) -> DataFrame:
    """``piece, payload``: the anchors of a cluster, or of a part of one that is large, with what each asks for.

    ``asks``: an array of (ask, low, high), the bands of whole scores whose best rows are wanted.
    """
    parts = {c: -(-n // PIECE) for c, n in sizes.items()}
    first = dict(zip(parts, np.cumsum([0, *parts.values()]).tolist(), strict=False))
    of = F.create_map(*(F.lit(int(x)) for c in parts for x in (c, parts[c])))
    base = F.create_map(*(F.lit(int(x)) for c in first for x in (c, first[c])))
    piece = (base[F.col("cluster")] + F.pmod(F.xxhash64("row"), of[F.col("cluster")])).cast("int")

    def pack(f: pd.DataFrame) -> pd.DataFrame:
        width = max(map(len, f["asks"]))
        low, high = np.full((len(f), width), 1, np.int64), np.zeros((len(f), width), np.int64)
        for i, asks in enumerate(f["asks"]):
            for a in asks:
                low[i, a["ask"]], high[i, a["ask"]] = a["low"], a["high"]
        payload = packed((f["row"].to_numpy(), f["label"].to_numpy(), _vectors(f["vector"]), middle[f["cluster"].iloc[0]], float(f["angle"].max()), low, high))
        return pd.DataFrame({"piece": f["piece"].iloc[:1], "payload": [payload]})

    return anchors.where(F.size("asks") > 0).withColumn("piece", piece).groupBy("piece").applyInPandas(pack, "piece int, payload binary")


class Walk:
    """The anchors of a piece on their way through the lists: the best rows of each ask so far."""

    def __init__(self, piece: tuple, k: int, same_label: bool):
        self.row, self.label, self.matrix, self.centre, self.angle, self.low, self.high = piece
        self.k, self.same = k, same_label
        self.length = _units(self.matrix)[1]
        self.asks = self.low.shape[1]
        self.least = np.where(self.low <= self.high, self.low, np.iinfo(np.int64).max)  # what could still enter
        self.held = [np.zeros(0, np.int64)] * 3  # ask (anchor by anchor), score, id
        self.scored = 0

    def through(self, block: int, content: tuple) -> None:
        ids, labels, matrix, _ = content
        mine, other, middle = _same_width(self.matrix, matrix, self.centre[None])
        units, length = _units(other)
        apart = np.arccos(np.clip(units @ middle[0], -1, 1)) - self.angle - 1e-6
        bound = length * (np.cos(np.maximum(apart, 0)) + 1e-9)
        order = np.argsort(-bound, kind="stable")
        widest = self.length.max() * length.max()
        kind = np.float32 if widest < 1 << 24 else np.float64 if widest < 1 << 53 else np.int64  # products are exact
        mine, other = mine.astype(kind), other.astype(kind)
        for at in range(0, len(order), STRETCH):
            reach = self.length * bound[order[at]]
            alive = np.flatnonzero(reach + 0.5 + 1e-9 * np.abs(reach) >= self.least.min(1))
            if not len(alive):
                return  # certified: nothing further down can enter any result
            some = order[at : at + STRETCH]
            score = mine[alive] @ other[some].T
            self.scored += score.size
            wanted = (score >= self.least[alive].min(1)[:, None]) & (score <= self.high[alive].max(1)[:, None])
            wanted &= (self.label[alive][:, None] == labels[some]) == self.same
            if self.same:
                wanted &= self.row[alive][:, None] != (block << BLOCK_BITS) + some
            a, c = np.nonzero(wanted)
            if len(a):
                self.add(alive[a], score[a, c].astype(np.int64), ids[some[c]])

    def add(self, anchor: np.ndarray, score: np.ndarray, found: np.ndarray) -> None:
        parts = [self.held]
        for j in range(self.asks):
            fits = (score >= self.least[anchor, j]) & (score <= self.high[anchor, j])
            parts.append([anchor[fits] * self.asks + j, score[fits], found[fits]])
        ask, score, found = (np.concatenate([p[i] for p in parts]) for i in range(3))
        order = np.lexsort((found, -score, ask))
        ask, score, found = ask[order], score[order], found[order]
        rank = np.arange(len(ask)) - np.searchsorted(ask, ask)
        best = rank < self.k
        self.held = [ask[best], score[best], found[best]]
        last = rank == self.k - 1
        self.least.ravel()[ask[last]] = score[last]


def _walked(left: pd.DataFrame, right: pd.DataFrame, k: int, same_label: bool) -> pd.DataFrame:
    """A cell: its pieces through its blocks, one block unpacked at a time."""
    walks = [Walk(unpacked(p), k, same_label) for p in right["payload"]]
    for block, payload in zip(left["block"], left["payload"], strict=True):
        content = unpacked(payload)
        for w in walks:
            w.through(int(block), content)
    out = [pd.DataFrame({"row": w.row[w.held[0] // w.asks], "ask": w.held[0] % w.asks, "id": w.held[2], "score": w.held[1]}) for w in walks]
    return pd.concat(out) if out else pd.DataFrame({"row": [], "ask": [], "id": [], "score": []})


def _best(blocks: DataFrame, pieces: DataFrame, n_blocks: int, n_pieces: int, k: int, same_label: bool) -> DataFrame:
    """``row, ask, id, score, rank``: the first ``k`` rows of each ask over all blocks."""
    g, h = max(1, -(-n_blocks // BLOCKS)), max(1, -(-n_pieces // PIECES))
    left = blocks.select(F.pmod(F.xxhash64("block"), F.lit(g)).alias("g"), F.explode(F.sequence(F.lit(0), F.lit(h - 1))).alias("h"), "block", "payload")
    right = pieces.select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(g - 1).cast("long"))).alias("of"), F.pmod("piece", F.lit(h)).alias("part"), "piece", "payload")
    found = left.groupBy("g", "h").cogroup(right.groupBy("of", "part")).applyInPandas(lambda a, b: _walked(a, b, k, same_label), "row long, ask int, id long, score long")
    order = Window.partitionBy("row", "ask").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _answered(spark: SparkSession, blocks: DataFrame, n_blocks: int, anchors: DataFrame, middle: np.ndarray, sizes: dict[int, int], k: int, same_label: bool, seeds: int, tag: str) -> DataFrame:
    n_pieces = sum(-(-n // PIECE) for n in sizes.values())
    if n_blocks > seeds:
        some = blocks.where(F.pmod(F.xxhash64("block"), F.lit(seeds)) == 0)
        first = _best(some, _pieces(anchors, middle, sizes), max(1, n_blocks // seeds), n_pieces, k, same_label)
        floor = written(spark, first.where(F.col("rank") == k).groupBy("row").agg(F.map_from_entries(F.collect_list(F.struct("ask", "score"))).alias("floor")), f"{tag}_floor")
        raised = F.transform("asks", lambda a: F.struct(a["ask"].alias("ask"), F.greatest(a["low"], F.element_at("floor", a["ask"])).alias("low"), a["high"].alias("high")))
        anchors = anchors.join(floor, "row", "left").withColumn("asks", F.when(F.col("floor").isNull(), F.col("asks")).otherwise(raised))
    return written(spark, _best(blocks, written(spark, _pieces(anchors, middle, sizes), f"{tag}_pieces"), n_blocks, n_pieces, k, same_label), tag)


def mine_hard_negatives(
    spark: SparkSession, vectors: DataFrame, anchor: Column, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90,
    id_col: str = "vec_id", label_col: str = "label", vector_col: str = "embedding", block_rows: int = 1 << BLOCK_BITS, seeds: int = SEEDS,
) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``.

    ``anchor``: a condition on the columns of ``vectors``; the rows that fulfil it are anchors. Components x become
    floor(256 x), and a score is the inner product of such vectors. An anchor's positives are the ``positives`` other
    rows of its label with the highest scores; the negatives of an anchor and a positive are the ``negatives`` rows of other labels with the
    highest scores from ``low`` to ``high`` hundredths of the positive's. Ties go to the smaller id; fewer rows are
    returned where there are fewer.

    Rows with a null id, label or vector, or with a null or non-finite component, take no part. A vector shorter than
    another counts as filled up with zeros; components are held within 2^26. Rows that repeat an id are rows of their
    own: a copy of an anchor can be its positive, and each copy that is an anchor has its own results. Other columns are left behind; an empty table, or
    one without anchors, gives no rows.
    """
    x = F.col(vector_col)
    sound = F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & x.isNotNull() & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    rows = vectors.where(F.coalesce(sound, F.lit(False))).select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"), F.coalesce(anchor, F.lit(False)).alias("anchor"), x.cast("array<double>").alias("vector"))
    blocks = written(spark, _blocks(rows, min(block_rows, 1 << BLOCK_BITS)), "vector_blocks")
    n_blocks = blocks.count()
    anchors = written(spark, _anchors(blocks), "anchors")
    count = anchors.count()
    if not count:
        return spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    sample = anchors.select("row", "vector").orderBy(F.xxhash64("row"), "row").limit(SAMPLE).toPandas()
    middle = centres(_vectors(sample["vector"]), max(1, min(CENTRES, len(sample), round(count**0.5))))
    anchors = written(spark, _clustered(anchors, middle), "clustered")
    sizes = {r["cluster"]: r["count"] for r in anchors.groupBy("cluster").count().orderBy("cluster").collect()}  # as many as centres

    everything = F.array(F.struct(F.lit(0).alias("ask"), F.lit(_NONE).cast("long").alias("low"), F.lit(-_NONE).cast("long").alias("high")))
    near = _answered(spark, blocks, n_blocks, anchors.withColumn("asks", everything), middle, sizes, positives, True, seeds, "positives")
    # scores are whole, so the band's ends are too; a negative score leaves none
    score = F.col("score")
    ask = F.struct((F.col("rank") - 1).alias("ask"), F.expr(f"-(({-low} * score - pmod({-low} * score, 100)) DIV 100)").alias("low"), F.expr(f"({high} * score - pmod({high} * score, 100)) DIV 100").alias("high"))
    asks = near.where(score >= 0).groupBy("row").agg(F.collect_list(ask).alias("asks"))
    asking = written(spark, anchors.join(asks, "row").withColumn("asks", F.filter("asks", lambda a: a["low"] <= a["high"])), "bands")
    far = _answered(spark, blocks, n_blocks, asking, middle, sizes, negatives, False, seeds, "negatives")
    named = near.join(anchors.select("row", "anchor_id"), "row").select("row", (F.col("rank") - 1).alias("ask"), "anchor_id", F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    return far.join(named, ["row", "ask"]).select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
