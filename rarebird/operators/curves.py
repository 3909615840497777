"""Precision-recall and ROC curves, step average precision, exact AUC.

Thresholds are the distinct scores. The scored table is first reduced to one row
per (group, score) with its positive/negative counts (a partial aggregate), then
running counts in descending score order come from :func:`ranked` -- a range
partitioned prefix sum, so a long curve is never ordered inside one task.
AP and AUC need no previous-point lookup: for threshold i with counts (tp_i, fp_i)
and running counts (TP_i, FP_i),
  AP  = sum_i tp_i / P * TP_i / (TP_i + FP_i)                      (step sum, trap T2)
  AUC = sum_i fp_i / N * (TP_i + TP_i - tp_i) / (2 P)              (trapezoid, trap T5)
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rarebird.functions import required, safe_div
from rarebird.operators.ranking import ranked
from rarebird.session import materialize


def threshold_counts(scored: DataFrame, group=(), score: str = "score", label: str = "label") -> DataFrame:
    """(group..., threshold, tp, fp, point, cum_tp, cum_fp, P, N); point 1 = highest score."""
    group = list(group)
    y = required(label, label)
    d = scored.groupBy(*group, F.col(score).cast("double").alias("threshold")).agg(
        F.sum((y == 1).cast("long")).alias("tp"),
        F.sum((y != 1).cast("long")).alias("fp"),
    )
    r = ranked(d, [F.col("threshold").desc()], group=group, rank_col="point", sums=["tp", "fp"])
    totals = d.groupBy(*group).agg(F.sum("tp").alias("P"), F.sum("fp").alias("N"))
    if group:
        # One row per group (models x folds): broadcast.
        same = F.lit(True)
        for i, g in enumerate(group):  # a null group keeps its curve
            same = same & F.col(g).eqNullSafe(F.col(f"_group{i}"))
        totals = totals.withColumnsRenamed({g: f"_group{i}" for i, g in enumerate(group)})
        return r.join(F.broadcast(totals), same).drop(*[f"_group{i}" for i in range(len(group))])
    t = totals.first()  # a single row: two numbers
    return r.withColumn("P", F.lit(t["P"] or 0)).withColumn("N", F.lit(t["N"] or 0))


def pr_curve(scored: DataFrame, group=(), score: str = "score", label: str = "label",
             truncate_full_recall: bool = True, counts: DataFrame | None = None) -> DataFrame:
    """E5: (group..., point, threshold, tp, fp, precision, recall), plus the end point
    (point 0, recall 0, precision 1). With ``truncate_full_recall`` the curve stops at
    the first threshold that reaches full recall (trap T28)."""
    group = list(group)
    c = counts if counts is not None else threshold_counts(scored, group, score, label)
    if truncate_full_recall:
        c = c.where(F.col("cum_tp") - F.col("tp") < F.col("P"))
    pts = c.select(*group, "point", "threshold", F.col("cum_tp").alias("tp"), F.col("cum_fp").alias("fp"),
                   safe_div("cum_tp", F.col("cum_tp") + F.col("cum_fp")).alias("precision"),
                   safe_div("cum_tp", "P").alias("recall"))
    end = c.select(*group).distinct().select(
        *group, F.lit(0).cast("bigint").alias("point"), F.lit(None).cast("double").alias("threshold"),
        F.lit(0).cast("bigint").alias("tp"), F.lit(0).cast("bigint").alias("fp"),
        F.lit(1.0).alias("precision"), F.lit(0.0).alias("recall"))
    return pts.unionByName(end)


def roc_curve(scored: DataFrame, group=(), score: str = "score", label: str = "label",
              drop_collinear: bool = True, counts: DataFrame | None = None) -> DataFrame:
    """(group..., point, threshold, tp, fp, fpr, tpr) plus the origin (point 0).

    ``drop_collinear`` drops interior points whose count increments equal the next
    point's (they lie on a straight segment), like the reference's default; the
    AUC is the same either way.
    """
    group = list(group)
    c = counts if counts is not None else threshold_counts(scored, group, score, label)
    if drop_collinear:
        nxt = c.select(*group, (F.col("point") - 1).alias("point"),
                       F.col("tp").alias("_ntp"), F.col("fp").alias("_nfp"))
        c = c.join(nxt, [*group, "point"], "left").where(
            (F.col("point") == 1) | F.col("_ntp").isNull()
            | (F.col("_ntp") != F.col("tp")) | (F.col("_nfp") != F.col("fp")))
    pts = c.select(*group, "point", "threshold", F.col("cum_tp").alias("tp"), F.col("cum_fp").alias("fp"),
                   safe_div("cum_fp", "N").alias("fpr"), safe_div("cum_tp", "P").alias("tpr"))
    origin = c.select(*group).distinct().select(
        *group, F.lit(0).cast("bigint").alias("point"), F.lit(None).cast("double").alias("threshold"),
        F.lit(0).cast("bigint").alias("tp"), F.lit(0).cast("bigint").alias("fp"),
        F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr"))
    return pts.unionByName(origin)


def average_precision(scored: DataFrame, group=(), score: str = "score", label: str = "label",
                      counts: DataFrame | None = None) -> DataFrame:
    """Step average precision per group."""
    group = list(group)
    c = counts if counts is not None else threshold_counts(scored, group, score, label)
    term = safe_div("tp", "P") * safe_div("cum_tp", F.col("cum_tp") + F.col("cum_fp"))
    return c.groupBy(*group).agg(F.sum(term).alias("average_precision"))


def auc_score(scored: DataFrame, group=(), score: str = "score", label: str = "label",
              counts: DataFrame | None = None) -> DataFrame:
    """Exact trapezoid ROC AUC per group (ties count one half)."""
    group = list(group)
    c = counts if counts is not None else threshold_counts(scored, group, score, label)
    term = F.col("fp") * (2 * F.col("cum_tp") - F.col("tp"))
    return c.groupBy(*group).agg(
        safe_div(F.sum(term.cast("double")), 2.0 * F.first("P") * F.first("N"), None).alias("auc"))


def threshold_table(scored: DataFrame, group=(), score: str = "score", label: str = "label",
                    counts: DataFrame | None = None) -> DataFrame:
    """Precision and recall against each threshold (the PR curve without its end point)."""
    return pr_curve(scored, group, score, label, True, counts).where(F.col("point") > 0) \
        .select(*group, "threshold", "precision", "recall")


def curve_reference_lines(df: DataFrame, label: str = "label") -> DataFrame:
    """Perfect and chance curves, chance precision = prevalence (computed).

    (curve, line, point, x, y, area): PR x = recall, y = precision; ROC x = fpr, y = tpr.
    """
    prev = df.agg(F.avg((F.col(label) == 1).cast("double")).alias("p"))
    p = F.col("p")
    pts = [
        ("pr", "perfect", 0, 0.0, 1.0, 1.0), ("pr", "perfect", 1, 1.0, 1.0, 1.0), ("pr", "perfect", 2, 1.0, None, 1.0),
        ("pr", "chance", 0, 0.0, 1.0, None), ("pr", "chance", 1, 0.0, None, None), ("pr", "chance", 2, 1.0, None, None),
        ("roc", "perfect", 0, 0.0, 0.0, 1.0), ("roc", "perfect", 1, 0.0, 1.0, 1.0), ("roc", "perfect", 2, 1.0, 1.0, 1.0),
        ("roc", "chance", 0, 0.0, 0.0, 0.5), ("roc", "chance", 1, 1.0, 1.0, 0.5),
    ]
    arr = F.array(*[
        F.struct(F.lit(cv).alias("curve"), F.lit(ln).alias("line"), F.lit(i).alias("point"),
                 F.lit(x).alias("x"), (F.lit(y) if y is not None else p).alias("y"),
                 (F.lit(a) if a is not None else p).alias("area"))
        for cv, ln, i, x, y, a in pts])
    return prev.select(F.explode(arr).alias("r")).select("r.*")


def curve_comparison(scored: DataFrame, group=("model",), score: str = "score", label: str = "label",
                     truncate_full_recall: bool = True, drop_collinear: bool = True) -> DataFrame:
    """PR and ROC curves of many labelled score sets in one long table.

    (group..., curve, point, x, y, area) with area = AP for 'pr' and AUC for 'roc'.
    The threshold counts are computed once and shared by both curves and both areas.
    """
    group = list(group)
    counts = materialize(threshold_counts(scored, group, score, label), "thresholds")  # six uses
    pr = pr_curve(scored, group, score, label, truncate_full_recall, counts)
    roc = roc_curve(scored, group, score, label, drop_collinear, counts)
    ap = average_precision(scored, group, score, label, counts)
    auc = auc_score(scored, group, score, label, counts)
    a = pr.join(F.broadcast(ap), group).select(*group, F.lit("pr").alias("curve"), "point", F.col("recall").alias("x"),
                                   F.col("precision").alias("y"), F.col("average_precision").alias("area"))
    b = roc.join(F.broadcast(auc), group).select(*group, F.lit("roc").alias("curve"), "point", F.col("fpr").alias("x"),
                                     F.col("tpr").alias("y"), F.col("auc").alias("area"))
    return a.unionByName(b)
