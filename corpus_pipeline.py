"""A training-data pipeline over ``documents``: four stages, each on what the one before kept.

1. language ID: documents without a recognisable language go;
2. n-gram Jaccard join: of each group of near-duplicates the smallest id stays (null ids last);
3. benchmark decontamination: documents that hold a benchmark passage go;
4. BPE encoding and decoding: one row of digests for each document that is left.

Stages take (spark, docs, sf_dir). All but the last return the columns of ``docs``. Each
stage's result is written as Parquet and read again as the next one's documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rarebird.llm import decontamination, language_id, ngram_join, word_bpe
from rarebird.llm.tables import discard, materialize
from rarebird.llm.vocab import public_path
from rarebird.session import scratch_path


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents whose language can't be told: null texts and texts without a letter.
    Learns from the labelled rows of ``docs``; without any, nothing can be told."""
    model = language_id.fit(docs)
    return language_id.predict(docs, model).where(F.col("lang_pred") != language_id.UNKNOWN).select(*docs.columns)


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one row of each group of near-duplicates: the smallest doc_id (null ids last), then the
    first in the table. Rows get numbers of their own, written with them, so rows that share an
    id, or have none, are documents like any other."""
    rows = materialize(docs.withColumn("_row", F.monotonically_increasing_id()), "numbered")
    parts = ngram_join.jaccard_components(rows.select("_row", "text"), "_row")
    # only groups: a document that is alone has its own row as its group
    groups = parts.groupBy("component_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("component_id")
    members = (parts.select("_row", "component_id").join(groups, "component_id")
               .join(rows.select("_row", "doc_id"), "_row").withColumn("place", F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "_row")))
    kept = members.groupBy("component_id").agg(F.min("place").alias("kept"))
    gone = materialize(members.join(kept, "component_id").where(F.col("_row") != F.col("kept._row")).select("_row"), "gone")
    left = materialize(rows.join(gone, "_row", "left_anti").select(*docs.columns), "left")
    discard(rows)
    return left


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold a window as similar to a benchmark item as the operator's threshold. What
    a document holds is its text's matter alone, so rows are matched by a digest of the text, whatever their ids."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    digest = F.sha2("text", 256)
    found = decontamination.contamination(docs.select(digest.alias("_digest"), "text"), benchmark, "_digest").select("_digest").distinct()
    return docs.withColumn("_digest", digest).join(found, "_digest", "left_anti").select(*docs.columns)


def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return word_bpe.round_trip(docs, public_path("word_bpe_49k.json"))


STAGES = [
    ("language_id", language_stage),
    ("ngram_jaccard_join", dedup_stage),
    ("benchmark_decontamination", decontamination_stage),
    ("bpe_round_trip", bpe_stage),
]

#: SQL can't run the trained classifier and the tokenizer; tests/llm/test_pipeline.py holds run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = scratch_path(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
