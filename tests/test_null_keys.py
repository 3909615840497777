"""Rows with a null key raise or keep their group; none vanishes. Constant columns and hot values."""

import pytest
from pyspark.sql import functions as F

from rarebird.operators import curves, folds, metrics, profile
from rarebird.operators.ranking import exact_quantiles, ranked
from rarebird.operators.summaries import correlation_matrix
from rarebird.spec import TableSpec

SPEC = TableSpec("id", "label", ("x",), ())


@pytest.fixture
def table(spark):
    return spark.range(1000).select("id", F.when(F.col("id") % 10 == 0, None).otherwise(F.col("id") % 2).cast("int").alias("label"),
                                    F.lit(1.0).alias("x"), (F.col("id") % 7).cast("double").alias("y"))


def test_null_labels_raise(table):
    scored = table.select("label", F.lit(1).alias("prediction"), F.col("y").alias("score"))
    for make in (lambda: folds.stratified_kfold(table, SPEC), lambda: profile.class_weights(table, SPEC),
                 lambda: metrics.confusion_counts(scored),
                 lambda: curves.threshold_counts(scored.withColumn("model", F.lit("m")), ["model"])):
        with pytest.raises(Exception, match="null in label"):
            make().collect()


def test_null_groups_keep_their_rows(table):
    r = ranked(table, ["id"], group=["label"])
    assert r.count() == 1000
    assert r.where("label is null").agg(F.max("rank")).first()[0] == 100
    scored = table.select(F.col("label").alias("model"), (F.col("id") % 2).alias("label"), F.col("y").alias("score"))
    assert curves.threshold_counts(scored, ["model"]).where("model is null").count() == 7


def test_constant_columns(table):
    for method in ("sql", "vector"):
        got = {(r.a, r.b): r["corr"] for r in correlation_matrix(table, ["x", "y"], method).collect()}
        assert got[("x", "x")] is None and got[("x", "y")] is None and abs(got[("y", "y")] - 1) < 1e-9
    assert {r.value for r in exact_quantiles(table, ["x"], [0.1, 0.5]).collect()} == {1.0}


def test_fit_keeps_its_partitions(table):
    from rarebird.plans import models as mo

    data = table.withColumn("label", (F.col("y") > 3).cast("int")).repartition(3)
    assert mo.fit(data, TableSpec("id", "label", ("y",), ()), mo.LOGISTIC).model is not None
    assert not hasattr(mo, "ROWS_PER_PARTITION")
