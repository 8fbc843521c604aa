"""Operator 1: quality classifier with supervised subword embeddings.

A word is itself and its character n-grams, hashed to buckets, and so is each pair of neighbouring words. Each bucket has
a learned vector; a document is the average of its features' vectors, and a softmax layer gives the classes. Vectors and layer are trained by stochastic
gradient descent in numpy on a bounded sample of labelled rows. As everything after the average is linear up to the
softmax, scoring needs one number per bucket; that vector is what workers get.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import blocks, fold, keyed_documents, packed, sized_join, unpacked, written
from .hashing import _BASE, U, Words, byte_values, mix, prefix_sums, span_hash
from .wordscores import WordScores, spans

BUCKETS = 1 << 17
DIMENSIONS = 10
EPOCHS = 8
RATE = 0.5
GRAMS = (3, 4, 5)
#: Labelled rows the classifier is fitted on at most.
SAMPLE_ROWS = 3000
THRESHOLD = 0.7


def word_features(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(bucket of each feature, word of each feature): the word and its character n-grams, with marked ends."""
    buf, edge = spans([b"<" + w + b">" for w in words])
    begin, end = edge[:-1], edge[1:]
    sums = prefix_sums(byte_values(buf))
    found = [(mix(span_hash(sums, begin, end)), np.arange(len(words)))]
    for n in GRAMS:
        starts = np.arange(max(0, len(buf) - n + 1))
        word = np.searchsorted(begin, starts, "right") - 1
        ok = starts + n <= end[word] if len(starts) else np.zeros(0, bool)
        starts, word = starts[ok], word[ok]
        found.append((mix(span_hash(sums, starts, starts + n) + U(n)), word))
    return (np.concatenate([h for h, _ in found]) % U(BUCKETS)).astype(np.int64), np.concatenate([w for _, w in found])


def pair_features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, text) of each pair of neighbouring words."""
    words = Words(texts)
    inside = words.text[1:] == words.text[:-1]
    key = mix(words.hash[:-1] * U(_BASE) + words.hash[1:])[inside]
    return (key % U(BUCKETS)).astype(np.int64), words.text[1:][inside]


def document_features(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(distinct buckets, share of each)."""
    words = Counter(text.split())
    if not words:
        return np.zeros(0, np.int32), np.zeros(0, np.float32)
    bucket, word = word_features(list(words))
    weight = np.bincount(bucket, weights=np.fromiter(words.values(), float, len(words))[word], minlength=BUCKETS)
    weight += np.bincount(pair_features([text])[0], minlength=BUCKETS)
    some = np.flatnonzero(weight)
    return some.astype(np.int32), (weight[some] / weight.sum()).astype(np.float32)


class Classifier:
    """Per bucket the difference of the two classes' logits, and the bias."""

    def __init__(self, logit: np.ndarray, bias: float):
        self.logit, self.bias = logit, bias

    @classmethod
    def trained(cls, samples: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, epochs: int = EPOCHS, rate: float = RATE, seed: int = 1) -> Classifier:
        """Stochastic gradient descent, one document at a time, with a rate that falls to zero."""
        rng = np.random.default_rng(seed)
        vectors = rng.uniform(-1 / DIMENSIONS, 1 / DIMENSIONS, (BUCKETS, DIMENSIONS)).astype(np.float32)
        layer, bias = np.zeros((2, DIMENSIONS), np.float32), np.zeros(2, np.float32)
        steps, total = 0, max(1, epochs * len(samples))
        for _ in range(epochs):
            for i in rng.permutation(len(samples)):
                bucket, share = samples[i]
                pace = rate * (1 - steps / total)
                steps += 1
                rows = vectors[bucket]
                hidden = share @ rows
                score = layer @ hidden + bias
                p = np.exp(score - score.max())
                p /= p.sum()
                p[int(labels[i])] -= 1  # gradient of the loss by the scores
                back = p @ layer
                layer -= pace * np.outer(p, hidden)
                bias -= pace * p
                # shares are tiny, and a bucket's step is scaled up to the size of a word's
                vectors[bucket] -= (pace * 50) * share[:, None] * back
        return cls((vectors @ (layer[1] - layer[0])).astype(np.float64), float(bias[1] - bias[0]))

    def score_words(self, words: list[bytes]) -> np.ndarray:
        """Per word: sum of its features' logits, and their number."""
        bucket, word = word_features(words)
        return np.column_stack((np.bincount(word, weights=self.logit[bucket], minlength=len(words)), np.bincount(word, minlength=len(words))))


def fit(spark: SparkSession, docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Classifier:
    """Train on the ``sample_rows`` labelled rows outside the held-out fold with the smallest hash of the id."""
    marked = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull() & (fold(id_col, 4) != 2))
    marked = marked.groupBy(F.col(id_col).cast("long").alias("rid")).agg(F.min(F.col(label_col).cast("int")).alias("label"))
    chosen = written(spark, marked.orderBy(F.xxhash64("rid"), "rid").limit(sample_rows), "quality_sample")

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in blocks(batches):
            yield pa.RecordBatch.from_pydict({"label": batch.column(batch.schema.get_field_index("label")), "payload": pa.array([packed(document_features(t)) for t in texts], pa.binary()), "order": batch.column(batch.schema.get_field_index("fp"))})

    keyed = sized_join(keyed_documents(docs, id_col, text_col), chosen, ["rid"], "inner").select("label", "fp", "text")
    rows = keyed.mapInArrow(features, "label int, payload binary, order long").collect()
    rows.sort(key=lambda r: (r["order"], r["label"]))
    kept = [(unpacked(bytes(r["payload"])), r["label"]) for r in rows]
    kept = [x for x in kept if len(x[0][0])]
    return Classifier.trained([x[0] for x in kept], np.array([x[1] for x in kept], np.int64))


def score_quality(spark: SparkSession, docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """One row per document: ``doc_id, held_out, score, predicted``.

    Score is the probability of label 1, over the whole text; null and empty texts get the bias alone. Labels other
    than 0 and 1 and null ids teach nothing; a document with both labels counts as 0. Without labels every score is
    0.5. Rows that repeat a document are scored alike; an empty table gives no rows.
    """
    model = spark.sparkContext.broadcast(fit(spark, docs, labels, sample_rows, id_col, text_col, label_col))
    keyed = keyed_documents(docs, id_col, text_col).withColumn("held_out", fold("doc_id", 4) == 2)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = WordScores(model.value.score_words, 2)
        for batch, texts in blocks(batches):
            totals = table.totals([t.split() for t in texts])
            bucket, of = pair_features(texts)
            totals += np.column_stack((np.bincount(of, weights=model.value.logit[bucket], minlength=len(texts)), np.bincount(of, minlength=len(texts))))
            logit = totals[:, 0] / np.maximum(totals[:, 1], 1) + model.value.bias
            score = 1 / (1 + np.exp(-np.clip(logit, -500, 500)))
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column(batch.schema.get_field_index("doc_id")), "held_out": batch.column(batch.schema.get_field_index("held_out")), "score": pa.array(score), "predicted": pa.array((score >= threshold).astype(np.int32))})

    return keyed.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")
