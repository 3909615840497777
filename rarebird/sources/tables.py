"""Tables, fitted models and scaler statistics in and out of storage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType


def load_table(spark: SparkSession, path: str, schema: StructType | str | None = None,
               fmt: str | None = None) -> DataFrame:
    """A CSV file with a header row (explicit schema, fail on malformed rows) or parquet."""
    fmt = fmt or ("parquet" if path.rstrip("/").endswith(".parquet") else "csv")
    if fmt == "csv":
        if schema is None:
            raise ValueError("CSV tables need an explicit schema")
        return (spark.read.schema(schema).option("header", True).option("mode", "FAILFAST")
                .option("enforceSchema", False).csv(path))
    reader = spark.read.schema(schema) if schema is not None else spark.read
    return reader.format(fmt).load(path)


def write_table(df: DataFrame, path: str, fmt: str = "csv", mode: str = "overwrite") -> str:
    """Write without an index column, with a header for CSV. Returns the path."""
    writer = df.write.mode(mode)
    if fmt == "csv":
        writer = writer.option("header", True)
    writer.format(fmt).save(path)
    return path


def save_model(model, path: str) -> str:
    """S3: persist a fitted ``pyspark.ml`` model or pipeline model."""
    model.write().overwrite().save(path)
    return path


def load_model(path: str):
    """S3: load what :func:`save_model` wrote (any ``pyspark.ml`` model class)."""
    import importlib

    from pyspark.ml.util import DefaultParamsReader

    meta = DefaultParamsReader.loadMetadata(path, _spark_context())
    module, _, name = meta["class"].replace("org.apache.spark", "pyspark").rpartition(".")
    return getattr(importlib.import_module(module), name).load(path)


def _spark_context():
    from pyspark import SparkContext

    return SparkContext.getOrCreate()


def save_scaler(stats: DataFrame, path: str) -> str:
    """Scaler statistics (one row per column) as parquet."""
    stats.write.mode("overwrite").parquet(path)
    return path


def load_scaler(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)
