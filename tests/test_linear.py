"""Many linear fits in one scan: optimality of each, agreement with fits of their own, one job a step."""

import numpy as np
import pytest
from pyspark.ml import Estimator, Model
from pyspark.ml.classification import NaiveBayes
from pyspark.sql import functions as F

from rarebird.operators import scaling
from rarebird.operators.folds import fold_split
from rarebird.plans import linear as li
from rarebird.plans import models as mo
from rarebird.plans import search as se
from rarebird.plans import selection as sel
from rarebird.plans import validation as va
from rarebird.spec import TableSpec

SPEC = TableSpec("event_id", "learn", ("value", "hr", "k", "const"), ("night", "big"))


@pytest.fixture(scope="module")
def folded(ev_small):
    return va.with_folds(ev_small, SPEC, 3)


def test_every_candidate_meets_its_conditions(spark, folded):
    cfgs = [mo.LOGISTIC.with_params(penalty=p, C=c) for p in ("l1", "l2") for c in (0.001, 1.0, 1000.0)]
    cfgs += [mo.LINEAR_SVM.with_params(penalty=p, C=c) for p in ("l1", "l2") for c in (0.01, 10.0)]
    fits, solved, counts = se.fit_linear_candidates(folded, SPEC, cfgs, 3, "standard")
    assert len(fits) == 30 and solved.jobs <= 60
    pdf = folded.toPandas()
    cells = {r.fit: r for r in counts.collect()}
    for j, f in enumerate(fits):
        train, test = pdf[pdf.fold != f.hold], pdf[pdf.fold == f.hold]
        centre, spread = train[list(SPEC.numerics)].mean().values, train[list(SPEC.numerics)].std(ddof=0).values

        def table(rows):
            x = (rows[list(SPEC.numerics)].values - centre) / np.where(spread > 1e-12, spread, 1)
            x[:, spread <= 1e-12] = 0
            return np.column_stack([x, rows[list(SPEC.flags)].values.astype(float), np.ones(len(rows))])

        x, s = table(train), 2.0 * train.learn.values - 1
        w = np.where(s > 0, f.class_weights[1], f.class_weights[0])
        assert np.allclose(f.class_weights, [len(train) / (2 * (train.learn == c).sum()) for c in (0, 1)])
        v = np.append(solved.coefficients[j], solved.intercepts[j])
        z = s * (x @ v)
        slope = -s / (1 + np.exp(z)) if f.loss == "logistic" else -2 * s * np.maximum(1 - z, 0)
        grad = f.C * ((w * slope) @ x)
        assert li.violation(f, v, grad) <= 1e-5 * max(1, np.abs(f.C * (w * np.abs(s)) @ np.abs(x)).max())
        guess = table(test) @ v > 0
        r = cells[j]
        assert (r.tp, r.fp, r.tn, r.fn) == tuple(int(((test.learn == a) & (guess == b)).sum()) for a, b in ((1, 1), (0, 1), (0, 0), (1, 0)))


def test_search_agrees_with_single_fits(spark, folded):
    grid = {"penalty": ["l1", "l2"], "C": [0.1, 10.0]}
    vals = {(r.candidate, r.fold): r.value for r in se.evaluate_candidates(folded, SPEC, mo.LOGISTIC, se.grid(grid), 3).collect()}
    assert len(vals) == 12
    for ci, c in enumerate(se.grid(grid)):
        train, test = fold_split(folded, 1)
        stats = scaling.fit_scaler(train, SPEC)
        fitted = mo.fit(scaling.apply_scaler(train, SPEC, stats), SPEC, mo.LOGISTIC.with_params(**c, tol=1e-9))
        s = mo.score_table(fitted, scaling.apply_scaler(test, SPEC, stats))
        tp, fp, fn = s.agg(*[F.sum(((F.col("learn") == a) & (F.col("prediction") == b)).cast("int")) for a, b in ((1, 1), (0, 1), (1, 0))]).first()
        assert abs(vals[ci, 1] - 2 * tp / (2 * tp + fp + fn)) < 0.02
    mixed = se.evaluate_candidates(folded, SPEC, mo.LINEAR_SVM, [{"loss": "hinge", "max_iter": 20}, {"loss": "squared_hinge"}], 3).collect()
    assert len(mixed) == 6 and all(0 < r.value <= 1 for r in mixed)
    with pytest.raises(ValueError, match="no penalty"):
        se.evaluate_candidates(folded, SPEC, mo.LINEAR_SVM, [{"penalty": "l1", "loss": "hinge"}], 3)


def test_strong_l1_zeroes_all_and_limits(spark, folded):
    """Below C = 1 / max|gradient at the intercept-only model| every coefficient is 0, above it one is not."""
    rows = folded.select(F.array(*[F.col(c).cast("double") for c in SPEC.features]).alias("x"), F.col("learn").alias("y"), F.lit(1.0).alias("w"), F.lit(-1).alias("fold")).persist()
    pdf = folded.toPandas()
    x, p = pdf[SPEC.features].values.astype(float), pdf.learn.mean()
    edge = 1 / np.abs((p - pdf.learn.values) @ x).max()
    solved = li.fit_linear(rows, 6, [li.Linear("logistic", "l1", c * edge) for c in (0.99, 1.01)])
    assert (solved.coefficients[0] == 0).all() and (solved.coefficients[1] != 0).sum() == 1
    assert abs(solved.intercepts[0] - np.log(p / (1 - p))) < 1e-6


class Majority(Estimator):
    """A user's estimator without any parameters."""

    def _fit(self, df):
        class Constant(Model):
            def _transform(self, df):
                return df.withColumn("prediction", F.lit(1.0))

        return Constant()


def errors(scored, group):
    return scored.groupBy(*group).agg(F.avg((F.col("label") != F.col("prediction")).cast("double")).alias("value"))


def test_user_estimators_and_metrics(spark, ev_small):
    spec = TableSpec("event_id", "learn", ("hr", "k"), ("night",))
    folded = va.with_folds(ev_small, spec, 3)
    own = mo.ModelConfig("estimator", estimator=Majority(), weights=None)
    bayes = mo.ModelConfig("estimator", {"smoothing": 2.0}, estimator=NaiveBayes())
    one = {(r.metric, r.fold): r.value for r in va.cross_validate(folded, spec, own, 3, ("accuracy", errors), scale="minmax").collect()}
    assert len(one) == 6 and all(abs(one["accuracy", i] + one["errors", i] - 1) < 1e-12 for i in range(3))
    many = va.cross_validate_many(folded, spec, {"own": own, "bayes": bayes}, 3, (errors,), scale="minmax")
    assert sorted((r.model, r.metric) for r in many.collect()) == [("bayes", "errors")] * 3 + [("own", "errors")] * 3
    found = se.grid_search(folded, spec, bayes, {"smoothing": [0.5, 5.0]}, 3, errors, scale="minmax")
    assert found.results.count() == 2
    dropped = sel.drop_one_cv(folded, spec, {"own": own}, 3, errors, scale="minmax")
    assert {r.removed for r in dropped.collect()} == {"none", "hr", "k", "night"}
    with pytest.raises(ValueError, match="unknown metrics"):
        va.cross_validate(folded, spec, own, 3, ("nonsense",))


def test_rows_are_dealt_to_all_cores_and_sums_hold_far_out(spark, monkeypatch):
    """Both losses, their gradients and Hessians at margins up to 800; rows of one partition reach all cores."""
    monkeypatch.setattr(mo, "ROWS", 10)
    cores = spark.sparkContext.defaultParallelism
    x = np.array([0.0, 1.0, -1.0, 30.0, -30.0, 800.0, -800.0] * 20)
    y = np.arange(len(x)) % 2
    df = spark.createDataFrame([([float(a)], int(b), 1.5, i % 3) for i, (a, b) in enumerate(zip(x, y, strict=True))], "x array<double>, y int, w double, fold int").coalesce(1)
    rows = mo.dealt(df, len(x))
    assert rows.rdd.getNumPartitions() == cores * -(-len(x) // (10 * cores))
    assert rows.groupBy(F.spark_partition_id()).count().count() >= cores
    fits = [li.Linear("logistic", hold=1), li.Linear("squared_hinge", hold=2)]
    loss, grad, hess = li.evaluate(rows, fits, np.array([[1.0, 0.25]] * 2), li.Coordinates(1, None))
    s, xa = np.where(y == 1, 1.0, -1.0), np.stack([x, np.ones(len(x))], 1)
    z, fold = s * (x + 0.25), np.arange(len(x)) % 3
    p, slack = 1 / (1 + np.exp(np.minimum(z, 700))), np.maximum(1 - z, 0)
    for i, (out, value, slope, curve) in enumerate(((1, np.logaddexp(0, -z), p, p * (1 - p)), (2, slack ** 2, 2 * slack, 2.0 * (slack > 0)))):
        w = 1.5 * (fold != out)
        assert np.isclose(loss[i], (w * value).sum(), rtol=1e-12)
        assert np.allclose(grad[i], (w * -s * slope) @ xa, rtol=1e-12)
        assert np.allclose(hess[i], xa.T @ (xa * (w * curve)[:, None]), rtol=1e-12)
