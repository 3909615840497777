"""Modelling tables derived from the driver's parquet tables.

``ev_features`` (from ``events``) is the main fixture: unique ``event_id``, 0/1
``label`` = error events (about 20 % positive), numeric and flag features.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F



def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{table}.parquet")


def ev_features(spark: SparkSession, sf_dir: str, events: DataFrame | None = None) -> DataFrame:
    ev = events if events is not None else read(spark, sf_dir, "events")
    # Per-user aggregates: partial (map-side) aggregation, so a hot user costs nothing extra.
    users = ev.groupBy("user_id").agg(
        F.count(F.lit(1)).cast("double").alias("usr_events"),
        F.round(F.avg("value"), 6).alias("usr_value"),
    )
    # AQE broadcasts the per-user table when its run-time size is small; else a shuffle
    # join on user_id, whose hot keys AQE's skew join splits.
    ev = ev.join(users, "user_id")
    hr = F.hour("ts").cast("double")
    k = F.get_json_object("props", "$.k").cast("double")
    score = F.least(F.floor("value").cast("int"), F.lit(200))
    return ev.select(
        "event_id",
        "value",
        hr.alias("hr"),
        k.alias("k"),
        "usr_events",
        "usr_value",
        F.lit(1.0).cast("double").alias("const"),
        (F.hour("ts") < 6).cast("int").alias("night"),
        (F.col("user_id") % 2 == 0).cast("int").alias("even_user"),
        (F.col("value") > 50).cast("int").alias("big"),
        F.col("event_type").alias("category"),
        (F.col("event_type") == "error").cast("int").alias("label"),
        ((F.col("value") + k + 5 * hr + F.col("event_id") % 40) > 200).cast("int").alias("learn"),
        score.alias("score"),
        (score >= 50).cast("int").alias("prediction"),
    )


def emb_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``embeddings`` with label = (label == 0): a 64-dimensional neighbour-search table."""
    emb = read(spark, sf_dir, "embeddings")
    return emb.select("vec_id", "embedding", (F.col("label") == 0).cast("int").alias("label"))


def doc_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``labels`` joined to ``documents``: a second population with other columns."""
    labels = read(spark, sf_dir, "labels")
    docs = read(spark, sf_dir, "documents").select("doc_id", "n_chars", "lang", "source")
    return labels.join(docs, "doc_id").select(
        "doc_id",
        F.col("n_chars").cast("double").alias("n_chars"),
        "lang",
        "source",
        "quality",
        "toxic",
    )
