"""Confusion counts, normalised confusion, binary metrics, classification report.

Input is a score table (group..., label, prediction[, score]) -- the one interface
between models and metrics. Everything is a single grouped aggregate (map-side
partial sums), so a hot group costs nothing extra.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rarebird.functions import required, safe_div


def cell_counts(scored: DataFrame, group=(), label: str = "label", prediction: str = "prediction") -> DataFrame:
    """(group..., tp, fp, tn, fn): the one aggregate behind E1-E4, also over a stream."""
    y, p = required(label, label), required(prediction, prediction)
    return scored.groupBy(*group).agg(
        F.sum(((y == 1) & (p == 1)).cast("long")).alias("tp"),
        F.sum(((y == 0) & (p == 1)).cast("long")).alias("fp"),
        F.sum(((y == 0) & (p == 0)).cast("long")).alias("tn"),
        F.sum(((y == 1) & (p == 0)).cast("long")).alias("fn"),
    )


def confusion_counts(scored: DataFrame, group=(), label: str = "label", prediction: str = "prediction") -> DataFrame:
    """(group..., label, prediction, n) with all four cells, zeros included."""
    c = cell_counts(scored, list(group), label, prediction)
    cells = F.array(*[
        F.struct(F.lit(t).alias("label"), F.lit(q).alias("prediction"), F.col(n).alias("n"))
        for t, q, n in ((0, 0, "tn"), (0, 1, "fp"), (1, 0, "fn"), (1, 1, "tp"))])
    return c.select(*group, F.explode(cells).alias("c")).select(*group, "c.label", "c.prediction", "c.n")


def confusion_wide(scored: DataFrame, group=(), label: str = "label", prediction: str = "prediction") -> DataFrame:
    """E1, matrix form: one row per true label, columns pred_0 and pred_1."""
    long = confusion_counts(scored, group, label, prediction)
    return long.groupBy(*group, "label").pivot("prediction", [0, 1]).agg(F.first("n")) \
        .withColumnRenamed("0", "pred_0").withColumnRenamed("1", "pred_1")


def normalized_confusion(scored: DataFrame, group=(), label: str = "label",
                         prediction: str = "prediction") -> DataFrame:
    """Counts and their share of the true-label row (both, see trap T22)."""
    c = cell_counts(scored, list(group), label, prediction)
    pos, neg = F.col("tp") + F.col("fn"), F.col("tn") + F.col("fp")
    cells = F.array(*[
        F.struct(F.lit(t).alias("label"), F.lit(q).alias("prediction"), F.col(n).alias("n"),
                 safe_div(F.col(n), tot).alias("share"))
        for t, q, n, tot in ((0, 0, "tn", neg), (0, 1, "fp", neg), (1, 0, "fn", pos), (1, 1, "tp", pos))])
    return c.select(*group, F.explode(cells).alias("c")).select(*group, "c.*")


def _metric_cols():
    tp, fp, tn, fn = (F.col(x) for x in ("tp", "fp", "tn", "fn"))
    n = tp + fp + tn + fn
    return {
        "accuracy": safe_div(tp + tn, n),
        "precision": safe_div(tp, tp + fp),
        "recall": safe_div(tp, tp + fn),
        "f1": safe_div(2 * tp, 2 * tp + fp + fn),
        # Area under the ROC of a hard 0/1 prediction: (TPR + TNR) / 2 (trap T1).
        "roc_auc": (safe_div(tp, tp + fn, None) + safe_div(tn, tn + fp, None)) / 2,
    }


METRICS = ("accuracy", "precision", "recall", "f1", "roc_auc")


def binary_metrics(scored: DataFrame, group=(), label: str = "label", prediction: str = "prediction",
                   counts: bool = False) -> DataFrame:
    """Accuracy, precision, recall, F1 (of class 1) and hard-prediction AUC per group.

    Zero denominators give 0 like the reference's library default.
    """
    return wide_of_counts(cell_counts(scored, list(group), label, prediction), group, counts)


def wide_of_counts(c: DataFrame, group=(), counts: bool = False) -> DataFrame:
    """E3 from (group..., tp, fp, tn, fn)."""
    m = _metric_cols()
    extra = ["tp", "fp", "tn", "fn"] if counts else []
    return c.select(*group, *extra, *[m[k].alias(k) for k in METRICS])


def metrics_long(scored: DataFrame, group=(), label: str = "label", prediction: str = "prediction",
                 metrics=METRICS) -> DataFrame:
    """E3 in long form: (group..., metric, value). A metric is a name of ``METRICS`` or a function
    (score table with the true class in ``label``, group) -> (group..., value); its ``__name__`` names it."""
    own = [m for m in metrics if callable(m)]
    bad = {m for m in metrics if not callable(m)} - set(METRICS)
    if bad:
        raise ValueError(f"unknown metrics {sorted(bad)}")
    names = [m for m in metrics if not callable(m)]
    parts = [metrics_of_counts(cell_counts(scored, list(group), label, prediction), group, names)] if names else []
    for m in own:
        table = scored.withColumnRenamed(label, "label").withColumnRenamed(prediction, "prediction")
        parts.append(m(table, list(group)).select(*group, F.lit(m.__name__).alias("metric"), F.col("value").cast("double").alias("value")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def metrics_of_counts(c: DataFrame, group=(), metrics=METRICS) -> DataFrame:
    """E3 in long form from (group..., tp, fp, tn, fn)."""
    m = _metric_cols()
    arr = F.array(*[F.struct(F.lit(k).alias("metric"), m[k].alias("value")) for k in metrics])
    return c.select(*group, F.explode(arr).alias("m")).select(*group, "m.metric", "m.value")


def classification_report(scored: DataFrame, group=(), label: str = "label",
                          prediction: str = "prediction") -> DataFrame:
    """Rows '0', '1', 'accuracy', 'macro avg', 'weighted avg' with precision, recall,
    f1 and support (accuracy row: f1 = accuracy, precision and recall null)."""
    c = cell_counts(scored, list(group), label, prediction)
    tp, fp, tn, fn = (F.col(x) for x in ("tp", "fp", "tn", "fn"))
    pos, neg = tp + fn, tn + fp
    n = pos + neg
    p1, r1, f1 = safe_div(tp, tp + fp), safe_div(tp, pos), safe_div(2 * tp, 2 * tp + fp + fn)
    p0, r0, f0 = safe_div(tn, tn + fn), safe_div(tn, neg), safe_div(2 * tn, 2 * tn + fn + fp)

    def row(name, p, r, f, s):
        return F.struct(F.lit(name).alias("row"), p.cast("double").alias("precision"),
                        r.cast("double").alias("recall"), f.cast("double").alias("f1"), s.alias("support"))

    rows = F.array(
        row("0", p0, r0, f0, neg),
        row("1", p1, r1, f1, pos),
        row("accuracy", F.lit(None), F.lit(None), safe_div(tp + tn, n), n),
        row("macro avg", (p0 + p1) / 2, (r0 + r1) / 2, (f0 + f1) / 2, n),
        row("weighted avg", safe_div(p0 * neg + p1 * pos, n), safe_div(r0 * neg + r1 * pos, n),
            safe_div(f0 * neg + f1 * pos, n), n),
    )
    return c.select(*group, F.explode(rows).alias("r")).select(*group, "r.*")
