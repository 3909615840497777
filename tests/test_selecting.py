"""Radix selection, rebalancing on odd rows, bootstrap intervals, learning ranks."""

import random

import pytest
from pyspark.sql import functions as F

from rarebird.operators import folds as fo
from rarebird.operators import sampling as sa
from rarebird.operators import summaries as su
from rarebird.operators.selecting import among_smallest
from rarebird.plans import models as mo
from rarebird.plans import search as se
from rarebird.spec import TableSpec


@pytest.mark.parametrize("bits, keys", [(64, [-(1 << 63), -5, -1, 0, 3, 1 << 40, (1 << 63) - 1]), (32, [0, 7, 65535, 65536, (1 << 32) - 1])])
def test_smallest_by_key_then_id(spark, bits, keys):
    rng = random.Random(bits)
    rows = [(i - 40, rng.choice(keys)) for i in range(120)]
    df = spark.createDataFrame(rows, "id long, key long").cache()
    want = [i for _, i in sorted((k, i) for i, k in rows)]
    for n in (0, 1, 17, 60, 119, 120):
        got = [r.id for r in df.where(among_smallest(df, n, bits)(F.col("key"), F.col("id"))).collect()]
        assert sorted(got) == sorted(want[:n])
    with pytest.raises(ValueError, match="fewer rows"):
        among_smallest(df, 121, bits)


def test_rebalancing_raises_on_nulls(spark):
    spec = TableSpec("id", "y", ("a", "b"), ())
    rows = [(i, float(i % 7), float(i), int(i % 4 == 0)) for i in range(60)]
    kind = "id long, a double, b double, y int"
    full = spark.createDataFrame(rows, kind)
    counts = {r.y: r["count"] for r in sa.smote(full, spec).groupBy("y").count().collect()}
    assert counts[0] == counts[1] == 45
    odd = full.union(spark.createDataFrame([(100, None, 1.0, 1)], kind))
    for fn in (sa.smote, sa.near_miss):
        with pytest.raises(Exception, match="null in a"):
            fn(odd, spec).count()
    majority = full.union(spark.createDataFrame([(101, None, 1.0, 0)], kind))
    with pytest.raises(Exception, match="null in a"):
        sa.near_miss(majority, spec).count()
    unlabelled = full.union(spark.createDataFrame([(102, 1.0, 1.0, None)], kind))
    for fn in (sa.smote, sa.near_miss, sa.undersample):
        with pytest.raises(Exception, match="null in y"):
            fn(unlabelled, spec).count()


def test_bootstrap_interval_covers_the_normal_one(spark):
    rng = random.Random(1)
    rows = [(i, "a" if i % 2 else None, rng.gauss(10, 2)) for i in range(800)] + [(900, "b", 5.0), (901, "c", None)]
    df = spark.createDataFrame(rows, "id long, g string, y double")
    got = {r.g: r for r in su.bootstrap_mean(df, "g", "y", "id", 400).collect()}
    assert set(got) == {"a", "b", None} and got["b"].n == 1 and got["b"].ci_low == got["b"].ci_high == 5.0
    for g in ("a", None):
        r = got[g]
        assert r.n == 400 and r.ci_low < r.mean < r.ci_high
        assert 0.7 < (r.ci_high - r.ci_low) / (2 * 1.96 * 2 / 20) < 1.3
    assert su.bootstrap_mean(df.where("false"), "g", "y", "id").count() == 0


def test_learning_ranks_and_options(spark, ev_small):
    spec = TableSpec("event_id", "learn", ("value", "hr", "k"), ())
    folded = fo.stratified_kfold(ev_small, spec, 3).persist()
    rows = folded.select("event_id", "fold").orderBy("event_id").collect()
    ranks = {r.event_id: r for r in fo.learning_ranks(folded, spec, 3).collect()}
    for i in range(3):
        train = [r.event_id for r in rows if r.fold != i]
        assert [ranks[e][f"rank_{i}"] for e in train] == list(range(1, len(train) + 1))
        assert all(ranks[r.event_id][f"rank_{i}"] is None for r in rows if r.fold == i)
    chance = mo.ModelConfig("stratified", weights=None)
    plain = se.learning_curve(folded, spec, mo.LOGISTIC, [0.5], 3, scale="standard", undersample=True).collect()
    assert len(plain) == 6 and all(r.value > 0.7 for r in plain)
    assert len(se.learning_curve(folded, spec, chance, [0.2, 1.0], 3).collect()) == 12


def test_calibration_uses_no_row_its_model_saw(spark, ev_small):
    from pyspark.ml import Estimator, Model

    from rarebird.operators.profile import assemble

    seen = []

    class Memory(Estimator):
        def _fit(self, df):
            ids = {r.event_id for r in df.select("event_id").collect()}
            seen.append(ids)

            class Own(Model):
                def _transform(self, df):
                    assert not ids & {r.event_id for r in df.select("event_id").collect()}
                    return df.selectExpr("*", "features AS rawPrediction")

            return Own()

    spec = TableSpec("event_id", "learn", ("value", "hr"), ())
    data = assemble(ev_small, spec)
    out = mo.out_of_fold_margins(data, spec, Memory(), 3, 42, [])
    assert len(seen) == 3 and out.count() == ev_small.count()
