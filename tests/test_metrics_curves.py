"""Golden micro tables C1, C4 and independent definitions of AP and AUC."""

import pytest
from pyspark.sql import functions as F

from rarebird.operators import curves, metrics

C1 = list(zip([0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3, 0.2], [1, 0, 1, 1, 0, 0, 1, 0]))


def _scored(spark, rows):
    return spark.createDataFrame([(i, y, float(s)) for i, (s, y) in enumerate(rows)], "id long, label int, score double")


def test_step_average_precision_and_auc(spark):
    df = _scored(spark, C1)
    ap = curves.average_precision(df).first()[0]
    auc = curves.auc_score(df).first()[0]
    assert ap == pytest.approx(0.747024, abs=1e-6)
    assert auc == pytest.approx(0.6875, abs=1e-9)


def test_pr_curve_end_point_and_truncation(spark):
    rows = C1 + [(0.1, 0), (0.05, 0)]
    df = _scored(spark, rows)
    full = curves.pr_curve(df, truncate_full_recall=False).orderBy("point").collect()
    cut = curves.pr_curve(df).orderBy("point").collect()
    assert full[0]["precision"] == 1.0 and full[0]["recall"] == 0.0 and full[0]["threshold"] is None
    assert len(full) == 11 and len(cut) == 8  # stops at the first threshold with recall 1
    assert cut[-1]["recall"] == 1.0


def test_roc_drop_collinear_keeps_auc(spark):
    rows = [(s / 100.0, y) for s, y in zip(range(100, 0, -1), [1] * 30 + [0] * 20 + [1] * 20 + [0] * 30)]
    df = _scored(spark, rows)
    kept = curves.roc_curve(df).count()
    every = curves.roc_curve(df, drop_collinear=False).count()
    assert kept == 6 and every == 101  # origin, first, three corners, last
    assert curves.auc_score(df).first()[0] == pytest.approx(sum(
        1.0 for s1, y1 in rows if y1 == 1 for s0, y0 in rows if y0 == 0 and s1 > s0) / 2500)


def test_auc_matches_mann_whitney_with_ties(spark, ev_small):
    pdf = ev_small.select("label", "score").toPandas()
    pos, neg = pdf[pdf.label == 1].score.values, pdf[pdf.label == 0].score.values
    mw = sum(((p > neg).sum() + 0.5 * (p == neg).sum()) for p in pos) / (len(pos) * len(neg))
    got = curves.auc_score(ev_small).first()[0]
    assert got == pytest.approx(mw, abs=1e-12)


def test_ap_is_mean_precision_over_positives(spark, ev_small):
    pdf = ev_small.select("label", "score").toPandas()
    precs = []
    for s in pdf[pdf.label == 1].score:
        sel = pdf[pdf.score >= s]
        precs.append(sel.label.mean())
    assert curves.average_precision(ev_small).first()[0] == pytest.approx(sum(precs) / len(precs), abs=1e-12)


def test_hard_auc_golden_c4(spark):
    df = spark.createDataFrame([(1, 1), (1, 0), (0, 0), (0, 0), (0, 1)], "label int, prediction int")
    m = metrics.binary_metrics(df).first()
    assert m["roc_auc"] == pytest.approx(7 / 12)
    assert m["precision"] == pytest.approx(0.5) and m["recall"] == pytest.approx(0.5)


def test_constant_predictor_hard_auc_is_half(spark, ev_small):
    df = ev_small.withColumn("prediction", F.lit(1))
    assert metrics.binary_metrics(df).first()["roc_auc"] == pytest.approx(0.5)


def test_zero_division_gives_zero(spark, ev_small):
    m = metrics.binary_metrics(ev_small.withColumn("prediction", F.lit(0))).first()
    assert m["precision"] == 0.0 and m["f1"] == 0.0


def test_confusion_has_all_cells(spark):
    df = spark.createDataFrame([(1, 1), (1, 1)], "label int, prediction int")
    rows = {(r["label"], r["prediction"]): r["n"] for r in metrics.confusion_counts(df).collect()}
    assert rows == {(0, 0): 0, (0, 1): 0, (1, 0): 0, (1, 1): 2}


def test_report_rows(spark, ev_small):
    rep = {r["row"]: r for r in metrics.classification_report(ev_small).collect()}
    assert set(rep) == {"0", "1", "accuracy", "macro avg", "weighted avg"}
    assert rep["accuracy"]["precision"] is None
    assert rep["0"]["support"] + rep["1"]["support"] == ev_small.count()
