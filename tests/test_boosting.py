"""Histogram boosting against a plain numpy boosting over all thresholds."""

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

from rarebird.plans import boosting as bo
from rarebird.plans import models as mo
from rarebird.spec import LEARN_SPEC


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(4)
    x = np.stack([rng.integers(0, 9, 900), rng.integers(-3, 3, 900), rng.normal(size=900).round(1), np.full(900, 2.0)], 1).astype(float)
    y = ((x[:, 0] * 0.3 + np.abs(x[:, 1]) + x[:, 2] + rng.normal(size=900)) > 3).astype(float)
    w = np.where(y == 1, 2.0, rng.integers(1, 3, 900))
    rows = [(*map(float, r), float(a), float(b)) for r, a, b in zip(x, y, w, strict=True)]
    df = spark.createDataFrame(rows, "a double, b double, c double, d double, y double, w double").repartition(3)
    return x, y, w, df.select(array_to_vector(F.array("a", "b", "c", "d")).alias("features"), "y", "w").cache()


def plain(x, y, w, rounds, eta=0.3, depth=3, mcw=1.0, gamma=0.0, lam=1.0, share=1.0, seed=42):
    """Margins of boosting with every value as a threshold."""
    m = np.zeros(len(x))
    score = lambda g, h: g * g / (h + lam) if h + lam > 0 else 0.0
    for t in range(rounds):
        p = 1 / (1 + np.exp(-m))
        g, h = w * (p - y), w * p * (1 - p)
        feats = bo.sampled(x.shape[1], share, t, seed)

        def grow(rows, level):
            leaf = (None, rows)
            if level == depth:
                return leaf
            best = None
            for f in feats:
                for v in np.unique(x[:, f])[:-1]:
                    left = rows & (x[:, f] <= v)
                    right = rows & ~left
                    if h[left].sum() >= mcw and h[right].sum() >= mcw:
                        gain = round(score(g[left].sum(), h[left].sum()) + score(g[right].sum(), h[right].sum()) - score(g[rows].sum(), h[rows].sum()), 9)
                        if gain > 1e-6 and (best is None or gain > best[0] + 1e-9):
                            best = gain, left, right
            if best is None:
                return leaf
            a, b = grow(best[1], level + 1), grow(best[2], level + 1)
            return leaf if a[0] is None and b[0] is None and best[0] < gamma else ((a, b), rows)

        def add(node):
            if node[0] is None:
                m[node[1]] += -eta * g[node[1]].sum() / (h[node[1]].sum() + lam)
            else:
                add(node[0][0])
                add(node[0][1])

        add(grow(np.ones(len(x), bool), 0))
    return m


@pytest.mark.parametrize("args", [{}, {"gamma": 12.0}, {"reg_lambda": 8.0}, {"min_child_weight": 25.0}, {"colsample_bytree": 0.5},
                                  {"max_depth": 1, "rounds": 12}, {"learning_rate": 1.0, "max_depth": 5, "rounds": 2}])
def test_margins_equal_plain_boosting(data, args):
    x, y, w, df = data
    args = {"rounds": 3, "max_depth": 3, "learning_rate": 0.3, **args}
    rounds = args.pop("rounds")
    names = {"learning_rate": "eta", "max_depth": "depth", "min_child_weight": "mcw", "gamma": "gamma", "reg_lambda": "lam", "colsample_bytree": "share"}
    model = bo.fit_boosted_trees(df, "y", "w", 4, rounds, max_bins=2000, **args)
    want = plain(x, y, w, rounds, **{names[k]: v for k, v in args.items()})
    assert np.allclose(model.margins(x), want, atol=1e-9)


def test_parameters_change_the_model(data):
    _, _, _, df = data
    count = lambda **kw: sum(map(len, (t.feature for t in bo.fit_boosted_trees(df, "y", "w", 4, 2, max_depth=4, **kw).trees)))
    base = count()
    assert count(gamma=40.0) < base and count(min_child_weight=60.0) < base and count(reg_lambda=50.0) != base or count(colsample_bytree=0.25) != base
    assert bo.fit_boosted_trees(df, "y", "w", 4, 1, gamma=1e9).trees[0].feature == [-1]


def test_thresholds_and_edges(spark, data):
    x, _, _, df = data
    cuts = bo.quantile_cuts(df, 4, 2000)
    for j in range(4):
        assert cuts[j].tolist() == np.unique(x[:, j]).tolist()
    few = bo.quantile_cuts(df, 4, 4)
    assert all(1 <= len(c) <= 4 and c[-1] == x[:, j].max() for j, c in enumerate(few))
    for c, j in ((few[0], 0), (few[2], 2)):
        share = (x[:, j][:, None] <= c[None]).mean(0)
        assert all(abs(share - k / 4).min() <= (x[:, j] == v).mean() for k, v in zip(range(1, 5), c, strict=False))
    none = bo.fit_boosted_trees(df.where("false"), "y", "w", 4, 2)
    assert none.margins(x[:3]).tolist() == [0.0, 0.0, 0.0]
    one = bo.fit_boosted_trees(df.where("y = 1"), "y", None, 4, 1)
    assert (one.margins(x[:3]) > 0).all()
    with pytest.raises(ValueError, match="max_bins"):
        bo.fit_boosted_trees(df, "y", "w", 4, 1, max_bins=1)
    nan = spark.createDataFrame([(float("nan"), 1.0)], "a double, y double").select(array_to_vector(F.array("a")).alias("features"), "y")
    with pytest.raises(Exception, match="NaN in a feature"):
        bo.fit_boosted_trees(nan, "y", None, 1, 1)


def test_rows_are_packed_and_dealt(spark, data, monkeypatch):
    """Rows of one partition reach all cores in blocks of a bounded size, each row once and in its order within the block."""
    monkeypatch.setattr(bo, "BLOCK", 64)
    x, y, w, df = data
    cuts = bo.quantile_cuts(df, 4, 2000)
    rows = df.coalesce(1).selectExpr("y", "w", "features").withColumn("x", vector_to_array("features")).select("x", "y", "w")
    blocks = bo._dealt(rows.mapInArrow(bo._binned(cuts), "bins binary, y binary, w binary, m binary"))
    assert blocks.rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    assert sum(n > 0 for n in blocks.rdd.glom().map(len).collect()) == spark.sparkContext.defaultParallelism
    got, batches = [], blocks.toArrow().to_batches()
    for bins, by, bw, bm in bo._blocks(batches, 4):
        assert 0 < len(by) <= 64 and (bm == 0).all()
        got += zip(*(cuts[j][bins[j]].tolist() for j in range(4)), by.tolist(), bw.tolist(), strict=True)
    assert sorted(got) == sorted(zip(*x.T.tolist(), y.tolist(), w.tolist(), strict=True))


def test_model_family(spark, ev_small):
    train, test = ev_small.where("event_id % 5 > 0"), ev_small.where("event_id % 5 = 0")
    cfg = mo.ModelConfig("boosted_trees", {"n_estimators": 20, "gamma": 0.5, "reg_lambda": 1.0, "colsample_bytree": 1.0}, weights="positive")
    fitted = mo.fit(train, LEARN_SPEC, cfg)
    scored = mo.score_table(fitted, test)
    right = scored.agg(F.avg((F.col("prediction") == F.col("learn")).cast("double"))).first()[0]
    assert right > 0.85
    assert scored.where("score < 0 or score > 1 or (score > 0.5) != (prediction = 1)").count() == 0
    imp = {r["column"]: r["importance"] for r in mo.feature_importance(fitted).collect()}
    assert abs(sum(imp.values()) - 1) < 1e-9 and min(imp.values()) > 0
    again = fitted.model.copy()
    x = np.random.default_rng(0).normal(size=(50, 3)) * 50
    assert np.array_equal(again.margins(x), fitted.model.margins(x))
