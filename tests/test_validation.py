"""Cross-validation invariants (T13, T11), report ranks (golden C5), baselines."""

import pytest
from pyspark.sql import functions as F

from rarebird.plans import models as mo
from rarebird.plans import search as se
from rarebird.plans import validation as va
from rarebird.spec import EV_SPEC

STRAT = mo.ModelConfig("stratified", weights=None)


def test_resampled_rows_never_in_test_folds(spark, ev_small):
    spec = EV_SPEC.only(["value", "hr", "k"])
    folded = va.with_folds(ev_small, spec, 5)
    scored = va.fold_scores(folded, spec, STRAT, 5, sample="smote", scale="standard")
    assert scored.where("event_id < 0").count() == 0
    assert scored.count() == ev_small.count()  # every real row scored exactly once


def test_unknown_sample_raises(spark, ev_small):
    folded = va.with_folds(ev_small, EV_SPEC, 5)
    with pytest.raises(ValueError):
        va.cross_validate_many(folded, EV_SPEC, {"s": STRAT}, sample="SMOTEX")


def test_report_ranks_with_ties_golden_c5(spark):
    res = spark.createDataFrame([(0, 0.8), (1, 0.8), (2, 0.7), (3, 0.6)], "candidate int, value double") \
        .withColumn("params", F.create_map(F.lit("c"), F.col("candidate").cast("string"))) \
        .withColumn("fold", F.lit(0))
    ranks = {r["candidate"]: r["rank"] for r in se.summarize(res).collect()}
    assert ranks == {0: 1, 1: 1, 2: 3, 3: 4}
    top = se.search_report(se.summarize(res), 3).collect()
    assert [r["rank"] for r in top] == [1, 1, 3]


def test_random_candidates_are_distinct_and_seeded():
    a = se.random_candidates({"x": [1, 2, 3], "y": ["a", "b"]}, 4, 7)
    assert len(a) == 4 and len({tuple(sorted(c.items())) for c in a}) == 4
    assert a == se.random_candidates({"x": [1, 2, 3], "y": ["a", "b"]}, 4, 7)


def test_grid_search_returns_refitted_best(spark, ev_small):
    folded = va.with_folds(ev_small, EV_SPEC, 3)
    r = se.grid_search(folded, EV_SPEC, mo.ModelConfig("uniform", weights=None),
                       {"randomfactor": [0.1, 0.9]}, 3, scale=None)
    assert r.best_params == {"randomfactor": 0.9}  # predicting 1 often wins F1 on rare positives
    assert r.results.count() == 2 and 0 < r.best_score <= 1


def test_logistic_learns_the_learnable_target(spark):
    from rarebird.catalog import LEARN_SPEC, holdout
    from rarebird.operators import curves

    train, test = holdout(spark, "/root/testdata/sf0.01", LEARN_SPEC)
    s = mo.score_table(mo.fit(train, LEARN_SPEC, mo.LOGISTIC), test).withColumnRenamed("learn", "label")
    assert curves.average_precision(s).first()[0] > 0.9
    assert curves.auc_score(s).first()[0] > 0.95


def test_folds_by_neighbours_leave_no_tables(spark, ev_small):
    """Each fold's training rows, and what its search wrote, go when its model is fitted."""
    from tests.test_neighbors import _tables

    spec = EV_SPEC.only(["value", "hr", "k"])
    folded = va.with_folds(ev_small, spec, 3)
    folded.count()
    before = _tables(spark)
    for sample in ("smote", "near_miss"):
        out = va.cross_validate_resampled(folded, spec, mo.LOGISTIC, sample, 3)
        assert not _tables(spark) - before
        assert out.count() == 3 * len(va.METRICS)
    assert not _tables(spark) - before


def test_a_users_estimator_gets_the_training_rows_without_another_pass(spark, ev_small, monkeypatch):
    """One aggregate is one pass: the rows of a fold are neither counted nor dealt out before it."""
    from rarebird.plans.centroid import NearestCentroid

    spec = EV_SPEC.only(["value", "hr", "k"])
    seen = []
    monkeypatch.setattr(mo, "ROWS", 10)
    monkeypatch.setattr(mo, "spread", lambda vec, *rest: seen.append(vec) or vec)
    cfg = mo.ModelConfig("estimator", weights=None, estimator=NearestCentroid())
    fitted = mo.fit(ev_small, spec, cfg)
    assert not seen
    mean = ev_small.where("label = 1").agg(F.avg("value"), F.avg("hr"), F.avg("k")).first()
    assert fitted.model.getOrDefault("mean1") == pytest.approx(list(mean))
