"""Scaling (C2 golden), ranking, quantiles, folds (C3), md5 (C6), sampling invariants."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from rarebird.functions import hash_int
from rarebird.operators import folds as fo
from rarebird.operators import profile as prof
from rarebird.operators import sampling as sa
from rarebird.operators import scaling
from rarebird.operators.ranking import exact_quantiles, ranked
from rarebird.sources.fixtures import ev_features
from rarebird.spec import EV_SPEC, TableSpec
from tests.conftest import SF_MID


def test_scaling_population_std_and_constant_column(spark):
    df = spark.createDataFrame([(1, 1.0, 5.0, 0, 1), (2, 2.0, 5.0, 1, 0), (3, 4.0, 5.0, 0, 1)],
                               "id long, a double, c double, f int, label int")
    spec = TableSpec("id", "label", ("a", "c"), ("f",))
    stats = {r["column"]: r for r in scaling.fit_standard_scaler(df, spec).collect()}
    assert stats["a"]["scale"] == pytest.approx(1.247219, abs=1e-6)
    out, _ = scaling.fit_apply_scaler(df, spec)
    assert out.columns == ["id", "a", "c", "f", "label"]  # numerics, flags, label last
    assert all(r["c"] == 0.0 for r in out.collect())
    mm, _ = scaling.fit_apply_scaler(df, spec, "minmax")
    assert sorted(r["a"] for r in mm.collect()) == pytest.approx([0.0, 1 / 3, 1.0])
    assert all(r["c"] == 0.0 for r in mm.collect())


def test_scaler_projection_has_no_exchange(spark, ev_small):
    stats = scaling.fit_standard_scaler(ev_small, EV_SPEC)
    plan = scaling.apply_scaler(ev_small, EV_SPEC, stats)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan.split("InMemoryRelation")[0]


def test_ranked_equals_row_number(spark, ev_small):
    from pyspark.sql import Window

    df = ev_small.select("event_id", "label", hash_int(7, "event_id").alias("u"))
    got = ranked(df, ["u", "event_id"], group=["label"], sums=["u"], partitions=5)
    w = Window.partitionBy("label").orderBy("u", "event_id")
    ref = df.select("event_id", F.row_number().over(w).alias("r"),
                    F.sum("u").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("c"))
    diff = got.join(ref, "event_id").where((F.col("rank") != F.col("r")) | (F.col("cum_u") != F.col("c")))
    assert diff.count() == 0
    assert got.count() == df.count()


def test_exact_quantiles_match_numpy(spark, ev_small):
    pdf = ev_small.select("value", "k").toPandas()
    got = {(r["column"], r["p"]): r["value"] for r in exact_quantiles(ev_small, ["value", "k"], [0.25, 0.5, 0.9]).collect()}
    for c in ("value", "k"):
        for p in (0.25, 0.5, 0.9):
            assert got[(c, p)] == pytest.approx(np.quantile(pdf[c], p))


def test_md5_golden_c6(spark):
    v = spark.range(1).select(hash_int(42, F.lit(7)).alias("h")).first()["h"]
    assert v == 939335186 == int(hashlib.md5(b"42-7").hexdigest()[:8], 16)


def test_fold_sizes_golden_c3(spark):
    df = ev_features(spark, SF_MID)
    f = fo.stratified_kfold(df, EV_SPEC, 5)
    sizes = {(r["fold"], r["label"]): r["count"] for r in f.groupBy("fold", "label").count().collect()}
    assert [(sizes[(i, 1)], sizes[(i, 0)]) for i in range(5)] == [(403, 1597)] * 4 + [(402, 1598)]
    assert f.select("event_id").distinct().count() == df.count() == f.count()


def test_undersample_sizes_and_determinism(spark, ev_small):
    a = sa.undersample(ev_small, EV_SPEC, 42)
    b = sa.undersample(ev_small, EV_SPEC, 42)
    counts = {r["label"]: r["count"] for r in a.groupBy("label").count().collect()}
    assert counts[0] == counts[1]
    assert sorted(r["event_id"] for r in a.collect()) == sorted(r["event_id"] for r in b.collect())


def test_smote_points_lie_on_minority_segments(spark, ev_small):
    spec = EV_SPEC.only(["value", "hr", "k"])
    out = sa.smote(ev_small, spec, 5, 42)
    counts = {r["label"]: r["count"] for r in out.groupBy("label").count().collect()}
    assert counts[0] == counts[1]
    synth = out.where("event_id < 0").toPandas()
    mino = ev_small.where("label = 1").select("value", "hr", "k").toPandas().values
    # Every synthetic point is a + u (b - a) for two minority rows: check one coordinate's bounds.
    assert synth.value.between(mino[:, 0].min(), mino[:, 0].max()).all()
    assert synth.label.eq(1).all()


def test_near_miss_keeps_minority_size(spark, ev_small):
    spec = EV_SPEC.only(["value", "hr", "k"])
    out = sa.near_miss(ev_small, spec, 3)
    counts = {r["label"]: r["count"] for r in out.groupBy("label").count().collect()}
    assert counts[0] == counts[1]


def test_label_encode_mapping_reusable(spark, ev_small):
    enc, mapping = prof.label_encode(ev_small.select("event_id", "category"), ["category"])
    m = {r["value"]: r["code"] for r in mapping.collect()}
    assert m == {v: i for i, v in enumerate(sorted(m))}
    assert enc.where(F.col("category").isNull()).count() == 0


def test_random_feature_subset_keeps_one():
    kept, dropped = sa.random_feature_subset(["a", "b"], 3)
    assert len(kept) == 1 and len(dropped) == 1


def test_cleanup_scratch_removes_materialized_tables(spark):
    import os

    from rarebird.session import cleanup_scratch, materialize

    t = materialize(spark.range(10), "cleanup-test")
    path = t.inputFiles()[0].split("file:")[-1]
    assert os.path.exists(os.path.dirname(path))
    assert cleanup_scratch(spark) >= 1
    assert not os.path.exists(os.path.dirname(path))


def test_correlation_vector_path_equals_sql(spark, ev_small):
    from rarebird.operators.summaries import correlation_matrix

    cols = ["value", "hr", "k", "usr_events", "usr_value", "night"]
    a = {(r["a"], r["b"]): r["corr"] for r in correlation_matrix(ev_small, cols, "sql").collect()}
    b = {(r["a"], r["b"]): r["corr"] for r in correlation_matrix(ev_small, cols, "vector").collect()}
    assert a.keys() == b.keys()
    for key in a:
        assert a[key] == pytest.approx(b[key], abs=1e-9)


def test_one_hot_vector_and_limit(spark):
    from rarebird.operators import profile as prof

    df = spark.createDataFrame([(1, "b", 1.0), (2, "a", 2.0), (3, None, 3.0), (4, "c", 4.0), (5, "a", 5.0)], "id int, c string, x double")
    out, mapping = prof.one_hot_vector(df, ["c"])
    code = {r.value: r.code for r in mapping.collect()}
    assert code == {"a": 0, "b": 1, "c": 2}
    for r, c in zip(out.orderBy("id").collect(), ["b", "a", None, "c", "a"], strict=True):
        assert r.c.toArray().tolist() == [float(code.get(c) == i) for i in range(3)]
    import pytest

    with pytest.raises(ValueError, match="one_hot_vector"):
        prof.one_hot(df, ["c"], max_levels=2)
    assert prof.one_hot(df, ["c"]).columns == ["id", "x", "c_a", "c_b", "c_c"]


def test_column_list_counts_any_type(spark):
    from rarebird.operators import profile as prof

    df = spark.createDataFrame([(1, None, [1]), (None, "x", None), (3, "y", [])], "a int, `b.c` string, d array<int>")
    assert [tuple(r) for r in prof.column_list(df).collect()] == [(0, "a", "int", 2, 3), (1, "b.c", "string", 2, 3), (2, "d", "array<int>", 2, 3)]
