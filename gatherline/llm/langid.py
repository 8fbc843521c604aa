"""Operator 5: language identification by character language models.

Each language gets an interpolated Kneser-Ney model of character n-grams inside space-padded, lower-cased words,
counted in Spark over a bounded sample of labelled rows. All n-grams lie in one sorted array of hashes, with a column
of discounted probabilities and one of back-off weights for each language. A document's score in a language is its
cross-entropy per character; the lowest wins.

Rejection of text that no language explains is calibrated on rows kept out of the counts. They are cut into runs of 1,
2, 4, 8 and 16 words; for each language and size (power of two of letters) the median and a high quantile of the
cross-entropy of these pieces tell how far it spreads, and text further out than ``REJECT_SPREADS`` such distances is
rejected. Short pieces spread widely, so a short text must be far stranger than a long one. Text beyond the largest size
has the limit of that size: it may be as strange throughout as one of its pieces.
"""

from __future__ import annotations

import re
import sys
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import blocks, bounded_batches, fold, free_names, keyed_documents, release, runs, sized_join, written
from .hashing import U, mix, prefix_sums, span_hash
from .wordscores import WordScores

ORDER = 5
#: Labelled rows per language that the model is fitted on at most (three quarters counted, a quarter for calibration).
SAMPLE_ROWS = 1000
#: A text is rejected beyond the median by so many times the distance from there to this quantile of held-back pieces.
REJECT_SPREADS, REJECT_QUANTILE = 6.0, 0.99
#: Nats per character that the distance is at least, as pieces may all be alike.
LEAST_SPREAD = 0.1
#: Pieces of each length that a held-back row gives at most, and the largest size (power of two of letters).
PIECES, MOST_SIZE = 4, 6
UNKNOWN = "und"

#: Runs of what counts as alphanumeric, less decimal digits: letters, and a few other numbers such as superscripts.
_WORD = re.compile(r"[^\W\d_]+")
_OTHER_NUMBERS = re.compile("[" + "".join(c for c in map(chr, range(0x80, sys.maxunicode + 1)) if c.isalnum() and not c.isalpha() and not c.isdecimal()) + "]+")
_BEGIN, _END = "\x02", "\x03"


def letters(text: bytes) -> list[str]:
    """The runs of letters, in lower case."""
    words = _WORD.findall(text.decode("utf-8", "replace").lower())
    if not words or "".join(words).isalpha():
        return words
    return [w for x in words for w in _OTHER_NUMBERS.split(x) if w]


def _hashes(strings: list[str]) -> np.ndarray:
    points = np.frombuffer("".join(strings).encode("utf-32-le"), np.uint32).astype(U)
    ends = np.cumsum(np.fromiter(map(len, strings), np.int64, len(strings)))
    return mix(span_hash(prefix_sums(mix(points + U(1))), np.concatenate(([0], ends[:-1])), ends))


class Model:
    """Sorted n-gram hashes with, per language, discounted probability and back-off weight."""

    def __init__(self, counts: dict[str, dict[str, int]], order: int = ORDER):
        self.order, self.langs = order, sorted(counts)
        tables = {lang: self._smoothed(c) for lang, c in counts.items()}
        grams = sorted({g for t, b, _ in tables.values() for g in chain_keys(t, b)})
        keys = _hashes(grams) if grams else np.zeros(0, U)
        by = np.argsort(keys)
        self.keys = keys[by]
        self.alpha = np.zeros((len(grams) + 1, len(self.langs)))
        self.back = np.ones((len(grams) + 1, len(self.langs)))
        place = {g: i for i, g in enumerate(np.array(grams, object)[by])} if grams else {}
        self.base = np.zeros(len(self.langs))
        for j, lang in enumerate(self.langs):
            alpha, back, base = tables[lang]
            for g, v in alpha.items():
                self.alpha[place[g], j] = v
            for g, v in back.items():
                self.back[place[g], j] = v
            self.base[j] = base

    def _smoothed(self, raw: dict[str, int]) -> tuple[dict, dict, float]:
        """(discounted probability of each n-gram, back-off weight of each context, probability of the unseen)."""
        level: dict[int, dict[str, int]] = {n: {} for n in range(1, self.order + 1)}
        for g, c in raw.items():
            level[len(g)][g] = c
        for n in range(self.order - 1, 0, -1):  # continuation counts: in how many longer n-grams it ends
            for g in level[n + 1]:
                level[n][g[1:]] = level[n].get(g[1:], 0) + 1
        alpha: dict[str, float] = {}
        back: dict[str, float] = {}
        base = 1.0
        for n, table in level.items():
            times = Counter(table.values())
            d = times[1] / (times[1] + 2 * times[2]) if times[1] and times[2] else 0.5
            total: dict[str, int] = defaultdict(int)
            types: dict[str, int] = defaultdict(int)
            for g, c in table.items():
                total[g[:-1]] += c
                types[g[:-1]] += 1
            for g, c in table.items():
                alpha[g] = (c - d) / total[g[:-1]]
            if n == 1:
                base = d * types[""] / total[""] / 1000 if table else 1.0  # shared by 1000 characters
            else:
                back.update({h: d * types[h] / total[h] for h in total})
        return alpha, back, base

    def score_words(self, words: list[str]) -> np.ndarray:
        """Per word: log probability in each language, then the number of characters with the end."""
        strings = [_BEGIN + w + _END for w in words]
        points = np.frombuffer("".join(strings).encode("utf-32-le"), np.uint32).astype(U)
        lengths = np.fromiter(map(len, strings), np.int64, len(strings))
        begin = np.concatenate(([0], np.cumsum(lengths)))[:-1]
        inside = np.arange(len(points)) - np.repeat(begin, lengths)
        sums = prefix_sums(mix(points + U(1)))
        where = np.arange(len(points))
        p = np.tile(self.base, (len(points), 1))
        context = np.full(len(points), len(self.keys))
        for n in range(1, self.order + 1):
            fits = np.flatnonzero(inside >= n - 1)
            key = mix(span_hash(sums, where[fits] - n + 1, where[fits] + 1))
            at = np.searchsorted(self.keys, key)
            at[self.keys[np.minimum(at, len(self.keys) - 1)] != key] = len(self.keys) if len(self.keys) else 0
            found = np.full(len(points), len(self.keys))
            found[fits] = at
            if n == 1:
                p += self.alpha[found]
            else:
                p[fits] = self.alpha[at] + self.back[context[fits - 1]] * p[fits]
            context = found
        logs = np.log(np.maximum(p, 1e-12))
        logs[inside == 0] = 0
        return np.column_stack((np.add.reduceat(logs, begin, axis=0), lengths - 1))


def chain_keys(*dicts: dict) -> Iterator[str]:
    for d in dicts:
        yield from d


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, n-gram, count) of a task: full-length n-grams, and shorter ones that begin a word."""
    counts: dict[str, Counter] = defaultdict(Counter)
    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            words = Counter(letters(text or b""))
            mine = counts[lang]
            for w, c in words.items():
                s = _BEGIN + w + _END
                for i in range(1, len(s)):
                    mine[s[max(0, i - ORDER + 1) : i + 1]] += c
    rows = [(lang, g, c) for lang, table in counts.items() for g, c in table.items()]
    for i in range(0, len(rows), 50_000):
        cols = list(zip(*rows[i : i + 50_000], strict=True))
        yield pa.RecordBatch.from_pydict({"lang": pa.array(cols[0], pa.string()), "gram": pa.array(cols[1], pa.string()), "n": pa.array(cols[2], pa.int64())})


def _sampled(ids: DataFrame, spark: SparkSession, sample_rows: int) -> DataFrame:
    """Of each language the rows with the least hash, ``nth`` in that order.

    A language's number of rows gives the hash below which at least twice as many lie; only those are ranked.
    """
    ids = ids.withColumn("hash", F.xxhash64("rid", "fp"))
    counts = written(spark, ids.groupBy("lang").agg(F.count("*").alias("rows")), "lang_counts")
    share = F.shiftrightunsigned("hash", 1) / F.lit(float(1 << 63))
    few = sized_join(ids, counts, ["lang"], "inner").where(share * F.col("rows") < 2 * sample_rows + 100).dropDuplicates(["lang", "rid", "fp"])
    nth = F.row_number().over(Window.partitionBy("lang").orderBy(F.shiftrightunsigned("hash", 1), "rid", "fp"))
    return few.withColumn("nth", nth).where(F.col("nth") <= sample_rows).select("rid", "fp", "lang", "nth")


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of 1, 2, 4, ... words of each text, evenly spread."""
    for batch in batches:
        found = []
        for text in batch.column(0).to_pylist():
            words = letters(text or b"")
            for size in (1, 2, 4, 8, 16):
                many = len(words) // size
                found += [" ".join(words[i * size : (i + 1) * size]).encode() for i in range(0, many, max(1, -(-many // PIECES)))]
        yield pa.RecordBatch.from_pydict({"text": pa.array(found, pa.binary())})


def fit(spark: SparkSession, docs: DataFrame, sample_rows: int = SAMPLE_ROWS, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", folds: int = 4, held_out: int = 2) -> tuple[Model, dict[str, np.ndarray]]:
    """The model, and for each language and size of text the cross-entropy beyond which text is rejected.

    Learns from rows with a language outside the held-out fold: of each language the ``sample_rows`` rows with the
    smallest hash of id and text. What reaches the driver is bounded by that sample.
    """
    ids = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & (fold(id_col, folds) != held_out))
    ids = ids.select(F.coalesce(F.col(id_col).cast("long"), F.lit(-1)).alias("rid"), F.xxhash64(text_col).alias("fp"), F.col(lang_col).alias("lang"))
    chosen = written(spark, _sampled(ids, spark, sample_rows), "lang_sample")
    texts = sized_join(keyed_documents(docs, id_col, text_col), chosen, ["rid", "fp"], "inner").dropDuplicates(["rid", "fp", "lang"])
    texts = written(spark, texts.select("lang", "text", "nth"), "lang_texts")
    grams = texts.where("nth % 4 != 0").select("lang", "text").mapInArrow(_count, "lang string, gram string, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    counts: dict[str, dict[str, int]] = defaultdict(dict)
    for r in grams.toLocalIterator():
        counts[r["lang"]][r["gram"]] = r["n"]
    model = Model(counts)
    if not counts:
        return model, {}
    # written, so that no task needs two Python workers: idle ones stay in memory
    pieces = written(spark, texts.where("nth % 4 = 0").select("text").mapInArrow(_pieces, "text binary"), "lang_pieces")
    scored = classify(spark, pieces, model, {}, keep=()).where("n_letters > 0")
    size = F.least(F.floor(F.log2("n_letters")), F.lit(MOST_SIZE)).cast("int").alias("size")
    at = F.percentile_approx("cross_entropy", [0.5, REJECT_QUANTILE], 10_000).alias("at")
    limits: dict[str, np.ndarray] = {}
    for r in scored.groupBy(F.col("lang_pred").alias("lang"), size).agg(at).collect():
        mine = limits.setdefault(r["lang"], np.full(MOST_SIZE + 1, -np.inf))
        middle, high = r["at"]
        mine[r["size"]] = middle + REJECT_SPREADS * max(high - middle, LEAST_SPREAD)
    for lang, mine in limits.items():
        # a shorter text may be as strange as a longer one; sizes beyond all pieces have the limit of the largest
        mine = np.maximum.accumulate(mine[::-1])[::-1]
        limits[lang] = np.where(mine > -np.inf, mine, mine[mine > -np.inf][-1])
    return model, limits


def classify(spark: SparkSession, keyed: DataFrame, model: Model, limits: dict[str, np.ndarray], keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns with ``lang_pred, score, cross_entropy, n_letters, rejected``; the model is broadcast (its size is that of the sample's n-grams)."""
    held = spark.sparkContext.broadcast(model)
    schema = ", ".join([*(f"`{c}` {keyed.schema[c].dataType.simpleString()}" for c in keep), "lang_pred string", "score double", "cross_entropy double", "n_letters long", "rejected boolean"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        table = WordScores(held.value.score_words, len(held.value.langs) + 1)
        for batch, texts in blocks(batches):
            cols = {c: batch.column(batch.schema.get_field_index(c)) for c in keep}
            yield pa.RecordBatch.from_pydict(cols | {c: pa.array(v) for c, v in verdicts(held.value, table, texts, limits).items()})

    return keyed.mapInArrow(run, schema)


def verdicts(model: Model, table: WordScores, texts: list[bytes], limits: dict[str, np.ndarray]) -> dict:
    """What ``classify`` says of each text, as columns."""
    words = [letters(t) for t in texts]
    count = np.array([sum(map(len, w)) for w in words], np.int64)
    if not model.langs:
        none = np.zeros(len(texts))
        return {"lang_pred": [UNKNOWN] * len(texts), "score": none, "cross_entropy": none, "n_letters": count, "rejected": np.ones(len(texts), bool)}
    totals = table.totals(words)
    n = totals[:, -1]
    some = n > 0
    ce = -totals[:, :-1] / np.maximum(n, 1)[:, None]
    best = np.argmin(ce, axis=1)
    entropy = ce[np.arange(len(texts)), best]
    score = 1 / np.exp(-(ce - entropy[:, None]) * np.sqrt(np.maximum(n, 1))[:, None]).sum(axis=1)
    pred = [model.langs[b] if ok else UNKNOWN for b, ok in zip(best, some, strict=True)]
    size = np.minimum(np.frexp(np.maximum(count, 1).astype(float))[1] - 1, MOST_SIZE)
    limit = np.array([limits[p][k] if p in limits else np.inf for p, k in zip(pred, size, strict=True)])
    rejected = ~some | (entropy > limit)
    return {"lang_pred": pred, "score": np.where(some, score, 0.0), "cross_entropy": np.where(some, entropy, 0.0), "n_letters": count, "rejected": rejected}


def identify(spark: SparkSession, docs: DataFrame, sample_rows: int = SAMPLE_ROWS, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """One row per document: ``doc_id, held_out, lang_pred, score, cross_entropy, n_letters, rejected``.

    ``lang_pred`` is a learned language, or ``und`` for null texts and texts without a letter (score 0). ``rejected``
    is true for those, and where the cross-entropy is far above what its language shows on held-back text of that size. Ties go
    to the first language in order of name. Without labelled rows every text is ``und``. Rows that repeat a document
    are scored alike; an empty table gives no rows.
    """
    model, limits = fit(spark, docs, sample_rows, id_col, text_col, lang_col)
    keyed = keyed_documents(docs, id_col, text_col).withColumn("held_out", fold("doc_id", 4) == 2)
    return classify(spark, keyed, model, limits, keep=("doc_id", "held_out"))


def in_known_language(spark: SparkSession, docs: DataFrame, **how) -> DataFrame:
    """The rows of ``docs`` whose text is not rejected, all columns as they are."""
    bounded_batches(spark)
    model, limits = fit(spark, docs, **how)
    held = spark.sparkContext.broadcast(model)
    schema = docs.schema
    marked = docs.withColumn(*free_names(docs, "__text"), F.col(how.get("text_col", "text")).cast("binary"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        table = WordScores(held.value.score_words, len(held.value.langs) + 1)
        for batch in batches:
            last = batch.num_columns - 1
            rest = pa.RecordBatch.from_arrays([batch.column(i) for i in range(last)], names=batch.schema.names[:last])
            for a, texts in runs(batch.column(last)):
                yield rest.slice(a, len(texts)).filter(pa.array(~verdicts(held.value, table, texts, limits)["rejected"]))
        del table
        release()

    return marked.mapInArrow(run, schema)
