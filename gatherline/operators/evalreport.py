"""Reports on predictions."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import EPS
from .joins import largest_group, small
from .placement import value_buckets

ERRORS = ("mape", "rmse", "mse", "mae", "max_error")


def regression_report(pred: DataFrame, target: str = "target", y_true: str = "y_true", y_pred: str = "y_pred", tau: DataFrame | None = None) -> DataFrame:
    """Errors of each target, and a row ``tot/avg`` with the sums of the error columns and the mean of ``tau``.

    ``tau``: (target, tau), from kendall_tau.
    """
    e = F.abs(F.col(y_true) - F.col(y_pred))
    out = pred.groupBy(F.col(target).alias("target")).agg(
        F.avg(e / F.greatest(F.abs(y_true), F.lit(EPS))).alias("mape"), F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(e * e).alias("mse"), F.avg(e).alias("mae"), F.max(e).alias("max_error"))
    more = []
    if tau is not None:
        out, more = out.join(tau.select(F.col(target).alias("target"), "tau"), "target", "left"), ["tau"]
    total = out.agg(*[F.sum(c).alias(c) for c in ERRORS], *[F.avg(c).alias(c) for c in more])
    return out.select("target", *ERRORS, *more).unionByName(total.withColumn("target", F.lit("tot/avg")))


def _discordant(x: np.ndarray, y: np.ndarray) -> int:
    """Pairs with x smaller and y larger, by a merge that counts; pairs equal in x or y don't count."""
    order = np.lexsort((y, x))
    seq = y[order]
    total, width, n = 0, 1, len(seq)
    while width < n:
        for a in range(0, n - width, 2 * width):
            left, right = seq[a : a + width], seq[a + width : a + 2 * width]
            total += int((len(left) - np.searchsorted(left, right, "right")).sum())
            seq[a : a + 2 * width] = np.sort(seq[a : a + 2 * width], kind="stable")
        width *= 2
    return total


def _pairs_across(cells: DataFrame) -> DataFrame:
    """``key, d``: pairs of rows in cells (key, a, b, n) with a smaller and b larger, counted by the bits of b.

    Two numbers of b differ first at one bit; there they share all bits above. So for each bit, cells are grouped by the bits
    above it, and those with the bit set count against later ones (by a) without it. A group has at most a row per a.
    """
    top = F.length(F.bin("__most")) - 1
    most = cells.groupBy("key").agg(F.max("b").alias("__most"))
    levels = cells.join(small(most), "key").withColumn("bit", F.explode(F.sequence(F.lit(0), top)))
    # shifts by a column: the prefix above the bit, and the bit itself
    levels = levels.withColumns({"above": F.expr("shiftright(b, bit + 1)"), "on": F.expr("shiftright(b, bit) & 1")})
    split = levels.groupBy("key", "bit", "above", "a").agg(F.sum(F.when(F.col("on") == 1, F.col("n")).otherwise(0)).alias("ones"), F.sum(F.when(F.col("on") == 0, F.col("n")).otherwise(0)).alias("zeros"))
    before = F.sum("ones").over(Window.partitionBy("key", "bit", "above").orderBy("a").rowsBetween(Window.unboundedPreceding, -1))
    return split.select("key", (F.col("zeros").cast("double") * F.coalesce(before, F.lit(0))).alias("d")).groupBy("key").agg(F.sum("d").alias("d"))


def kendall_tau(pred: DataFrame, key: str, x: str, y: str, bucket_rows: int = 200_000) -> DataFrame:
    """Kendall's tau-b with ties for each key: ``tau``.

    Discordant pairs in different x-buckets and different y-buckets come from the counts of the cells they make, by the bits of
    the y-bucket; the rest are counted within each x-bucket and each y-bucket. A bucket holds about ``bucket_rows`` rows,
    however many there are of them; a heavy value has one of its own, where no pair counts. So no group meets as a whole,
    unless it has no more rows than that.
    """
    df = pred.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(F.col(key).alias("key"), F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))
    parts = -(-largest_group(df, ["key"]) // bucket_rows)
    for c, at in (("x", "a"), ("y", "b")):
        df = value_buckets(df, "key", c, bucket_rows, at) if parts > 1 else df.withColumn(at, F.lit(0))
    pairs = lambda n: n * (n - 1) / 2
    ties = lambda cols, name: df.groupBy("key", *cols).count().groupBy("key").agg(F.sum(pairs(F.col("count"))).alias(name))

    def inside(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"key": [pdf["key"].iloc[0]], "d": [float(_discordant(pdf["x"].to_numpy(), pdf["y"].to_numpy()))]})

    def across(pdf: pd.DataFrame) -> pd.DataFrame:
        """Same y-bucket, different x-buckets: all discordant pairs less those within an x-bucket."""
        pdf = pdf.sort_values("a", kind="stable")
        x, y, a = pdf["x"].to_numpy(), pdf["y"].to_numpy(), pdf["a"].to_numpy()
        edge = np.flatnonzero(np.diff(a)) + 1
        d = _discordant(x, y) - sum(map(_discordant, np.split(x, edge), np.split(y, edge)))
        return pd.DataFrame({"key": [pdf["key"].iloc[0]], "d": [float(d)]})

    def varied(at: str, c: str) -> DataFrame:
        """Rows of buckets with more than one value."""
        return df.join(df.groupBy("key", at).agg(F.min(c).alias("lo"), F.max(c).alias("hi")).where("lo < hi").select("key", at), ["key", at], "left_semi")

    kind = pred.schema[key].dataType.simpleString()
    if parts <= 1:
        d = df.groupBy("key").applyInPandas(inside, f"key {kind}, d double")
    else:
        cross = _pairs_across(df.groupBy("key", "a", "b").agg(F.count("*").alias("n")))
        d = cross.unionByName(varied("a", "x").groupBy("key", "a").applyInPandas(inside, f"key {kind}, d double")).unionByName(varied("b", "y").groupBy("key", "b").applyInPandas(across, f"key {kind}, d double"))
    out = ties([], "n0").join(ties(["x"], "n1"), "key").join(ties(["y"], "n2"), "key").join(ties(["x", "y"], "n3"), "key").join(d.groupBy("key").agg(F.sum("d").alias("d")), "key")
    agree = F.col("n0") - F.col("n1") - F.col("n2") + F.col("n3") - F.col("d")
    scale = F.sqrt((F.col("n0") - F.col("n1")) * (F.col("n0") - F.col("n2")))
    return out.select(F.col("key").alias(key), F.when(scale > 0, (agree - F.col("d")) / scale).alias("tau"))


def inference_loss(pred: DataFrame, method: str = "mse", target: str = "target", y_true: str = "y_true", y_pred: str = "y_pred") -> DataFrame:
    """One row: ``loss`` and ``loss_per_target``. ``logmse`` sums the logs of the targets' mean squared errors."""
    per = pred.groupBy(target).agg(F.sum(F.pow(F.col(y_true) - F.col(y_pred), 2)).alias("se"), F.count("*").alias("n"))
    if method == "logmse":
        loss = F.sum(F.log(F.col("se") / F.col("n") + F.lit(EPS)))
    else:
        loss = F.sum("se") / F.sum("n") * F.count("*")
    return per.agg(loss.alias("loss"), (loss / F.count("*")).alias("loss_per_target"))


def confusion_matrix(labels: DataFrame, label: str, predicted: str) -> DataFrame:
    """2 by 2 counts: a row per label, columns ``pred_0, pred_1``."""
    return labels.where(F.col(label).isin(0, 1) & F.col(predicted).isin(0, 1)).groupBy(F.col(label).alias("label")).agg(F.count_if(F.col(predicted) == 0).alias("pred_0"), F.count_if(F.col(predicted) == 1).alias("pred_1"))


def classification_report(labels: DataFrame, label: str, predicted: str) -> DataFrame:
    """``class, precision, recall, f1, support`` for both classes, accuracy, macro and weighted averages."""
    one = labels.where(F.col(label).isin(0, 1) & F.col(predicted).isin(0, 1))
    agg = one.agg(*[F.count_if((F.col(label) == i) & (F.col(predicted) == j)).alias(f"n{i}{j}") for i in (0, 1) for j in (0, 1)])
    ratio = lambda a, b: F.coalesce(a / F.nullif(b, F.lit(0)), F.lit(0.0))

    def scores(c: int) -> list:
        hit, o = F.col(f"n{c}{c}"), 1 - c
        p, r = ratio(hit, hit + F.col(f"n{o}{c}")), ratio(hit, hit + F.col(f"n{c}{o}"))
        return [p, r, ratio(2 * p * r, p + r), hit + F.col(f"n{c}{o}")]

    zero, one_ = scores(0), scores(1)
    total = zero[3] + one_[3]
    accuracy = ratio(F.col("n00") + F.col("n11"), total)
    row = lambda name, p, r, f, s: F.struct(F.lit(name).alias("class"), p.alias("precision"), r.alias("recall"), f.alias("f1"), s.cast("long").alias("support"))
    mean = [(a + b) / 2 for a, b in zip(zero[:3], one_[:3], strict=True)]
    weighted = [ratio(a * zero[3] + b * one_[3], total) for a, b in zip(zero[:3], one_[:3], strict=True)]
    rows = F.array(row("invalid", *zero), row("valid", *one_), row("accuracy", accuracy, accuracy, accuracy, total), row("macro avg", *mean, total), row("weighted avg", *weighted, total))
    return agg.select(F.explode(rows).alias("r")).select("r.*")


def region_means(results: DataFrame, order: DataFrame, regions: DataFrame, pair: str, position: str, values: list[str], digits: int = 2) -> DataFrame:
    """Mean of ``values`` per region, where a pair's position lies in [lo, hi)."""
    placed = results.join(small(order), pair)
    inside = (F.col(position) >= F.col("lo")) & (F.col(position) < F.col("hi"))
    return placed.join(small(regions), inside).groupBy("region").agg(*[F.round(F.avg(v), digits).alias(v) for v in values])


def actual_vs_predicted(pred: DataFrame, targets: list[str], order: list[str], gname: str = "gname", pragma: str = "pragma", target: str = "target", y_true: str = "y_true", y_pred: str = "y_pred") -> DataFrame:
    """A row per ``gname-pragma`` with an actual and a predicted column for each target; the last of a repeated key wins."""
    nth = F.row_number().over(Window.partitionBy(gname, pragma, target).orderBy(*[F.desc(c) for c in order]))
    last = pred.withColumn("__nth", nth).where("__nth = 1")
    cols = [F.max(F.when(F.col(target) == t, F.col(c))).alias(f"{kind}_{t}") for t in targets for kind, c in (("actual", y_true), ("predicted", y_pred))]
    return last.groupBy(F.concat_ws("-", gname, pragma).alias("key")).agg(*cols)


def predict_batches(df: DataFrame, predict: Callable[[np.ndarray], np.ndarray], keys: list[str], features: list[str], targets: list[str], batch: int = 64) -> DataFrame:
    """Score rows with a user's function (features in, one column per target out), a batch at a time.

    Adds ``pred_t`` for each target and ``score``, their sum; ``true_t`` columns pass through if they are among the keys.
    """
    schema = ", ".join([f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keys] + [f"`pred_{t}` double" for t in targets] + ["score double"])

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            x = pdf[features].to_numpy(float)
            got = np.concatenate([predict(x[i : i + batch]) for i in range(0, len(x), batch)]) if len(x) else np.zeros((0, len(targets)))
            yield pdf[keys].assign(**{f"pred_{t}": got[:, i] for i, t in enumerate(targets)}, score=got.sum(axis=1))

    return df.select(*keys, *[c for c in features if c not in keys]).mapInPandas(run, schema)


def sum_columns(columns: list[str]):
    return reduce(lambda a, b: a + b, [F.col(c) for c in columns])
