"""Trees grown from counts of equal binned rows against those of pyspark.ml."""

import numpy as np
import pytest
from pyspark.ml.classification import RandomForestClassificationModel
from pyspark.sql import functions as F

from rarebird.plans import forest
from rarebird.plans import models as mo
from rarebird.spec import TableSpec

SPEC = TableSpec("id", "y", ("a", "b", "c"))


@pytest.fixture(scope="module")
def rows(spark):
    """Features of 7, 20 and 12 values; a noisy label."""
    rng = np.random.default_rng(1)
    n = 30_000
    x = np.stack([rng.integers(0, 7, n), rng.integers(0, 20, n), rng.integers(0, 12, n)], axis=1).astype(float)
    y = (x[:, 0] * 2 + x[:, 1] + x[:, 2] + rng.integers(0, 14, n) > 32).astype(int)
    return spark.createDataFrame([(i, *map(float, r), int(c)) for i, (r, c) in enumerate(zip(x, y, strict=True))], "id long, a double, b double, c double, y int").repartition(4).cache()


def _both(rows, monkeypatch, params, weights="balanced"):
    """(from counts, by pyspark.ml) for the same configuration."""
    cfg = mo.ModelConfig("random_forest", params, weights=weights)
    seen, fit = [], forest.fit_grouped
    with monkeypatch.context() as m:
        m.setattr(forest, "fit_grouped", lambda *a: seen.append(fit(*a)) or seen[-1])
        ours = mo.fit(rows, SPEC, cfg)
    assert seen[0] is ours.model and isinstance(ours.model, RandomForestClassificationModel)
    with monkeypatch.context() as m:
        m.setattr(forest, "fit_grouped", lambda *a: None)
        theirs = mo.fit(rows, SPEC, cfg)
    return ours, theirs


@pytest.mark.parametrize("criterion,weights,least,depth", [("gini", "balanced", 1, 30), ("entropy", None, 5, 6)])
def test_a_tree_without_draws_is_that_of_pyspark(spark, rows, monkeypatch, criterion, weights, least, depth):
    params = {"n_estimators": 1, "bootstrap": False, "max_features": "all", "criterion": criterion, "min_samples_leaf": least, "max_depth": depth}
    ours, theirs = _both(rows, monkeypatch, params, weights)
    a, b = ours.model.trees[0], theirs.model.trees[0]
    assert a.numNodes == b.numNodes and a.depth == b.depth
    assert a.toDebugString.split("\n")[1:] == b.toDebugString.split("\n")[1:]
    assert np.allclose(ours.model.featureImportances.toArray(), theirs.model.featureImportances.toArray())
    s, t = (mo.score_table(m, rows).withColumnRenamed("score", c) for m, c in ((ours, "s"), (theirs, "t")))
    both = s.join(t.select("id", "t", F.col("prediction").alias("p2")), "id")
    assert both.where("abs(s - t) > 1e-9 OR prediction <> p2").count() == 0


def test_a_drawn_forest_agrees_with_pyspark(spark, rows, monkeypatch):
    """Other draws of the same kind: near equal importances, scores and sizes of trees."""
    ours, theirs = _both(rows, monkeypatch, {"n_estimators": 40})
    assert len(ours.model.trees) == 40
    assert np.allclose(ours.model.featureImportances.toArray(), theirs.model.featureImportances.toArray(), atol=0.04)
    s, t = (mo.score_table(m, rows) for m in (ours, theirs))
    far = s.join(t.select("id", F.col("score").alias("t")), "id").agg(F.avg(F.abs(F.col("score") - F.col("t")))).first()[0]
    assert far < 0.03
    nodes = [np.mean([t.numNodes for t in m.model.trees]) for m in (ours, theirs)]
    assert nodes[0] == pytest.approx(nodes[1], rel=0.1)
    again = mo.fit(rows, SPEC, ours.config)
    assert [t.toDebugString.split("\n")[1:] for t in again.model.trees] == [t.toDebugString.split("\n")[1:] for t in ours.model.trees]


def test_rows_that_share_no_bins_are_left_to_pyspark(spark):
    df = spark.range(400).selectExpr("id", "cast(id * 7919 % 1009 AS double) AS a", "cast(id * 104729 % 997 AS double) AS b", "cast(id % 3 AS double) AS c", "cast(id % 2 AS int) AS y")
    vec = mo.assemble(df, SPEC)
    est = mo._estimator(mo.FOREST, "y", None, 400.0)
    assert forest.fit_grouped(vec, "y", None, 3, 400, est) is None


def test_thresholds_lie_between_values_and_few_values_keep_all(spark):
    df = spark.range(1000).selectExpr("id", "cast(id AS double) AS a", "cast(if(id < 3, id, 7) AS double) AS b", "1.0D AS c", "1 AS y")
    a, b, c = forest.split_points(mo.assemble(df, SPEC), 3, 32)
    assert b.tolist() == [0.5, 1.5, 4.5] and len(c) == 0
    assert len(a) == 31 and (a % 1 == 0.5).all() and np.ptp(np.diff(np.r_[0, a, 999])) <= 2


def test_forest_selection_and_importances_read_the_rows_a_few_times(spark, rows, monkeypatch):
    """L2 and M11 on a table of many rows to a group: their forests grow from counts, pyspark.ml fits none."""
    from pyspark.ml.classification import RandomForestClassifier

    from rarebird.plans import selection as sel

    def never(*a, **b):
        raise AssertionError("pyspark.ml fits")

    theirs = {r["column"]: r.importance for r in sel.select_forest(rows.limit(1500), SPEC, 30).collect()}  # rows that hardly share bins
    monkeypatch.setattr(RandomForestClassifier, "fit", never)
    chosen = sel.select_forest(rows, SPEC, 30).collect()
    assert sum(r.importance for r in chosen) == pytest.approx(1.0)
    assert all(r.kept == (r.importance >= r.threshold) for r in chosen)
    assert max(chosen, key=lambda r: r.importance)["column"] == max(theirs, key=theirs.get)
    found = {r["column"]: r.importance for r in mo.feature_importance(mo.fit(rows, SPEC, mo.FOREST)).collect()}
    assert all(abs(found[r["column"]] - r.importance) < 0.1 for r in chosen)
