"""Streaming confusion counts equal the batch operator on the same rows."""

from pyspark.sql import functions as F

from rarebird.operators import metrics
from rarebird.streaming import confusion_stream
from tests.conftest import SF_SMALL


def test_stream_counts_equal_batch(spark, tmp_path):
    import shutil

    path = f"{SF_SMALL}/events.parquet"
    src = tmp_path / "events"
    src.mkdir()
    shutil.copy(path, src / "part-0.parquet")  # a stream source reads a folder
    schema = spark.read.parquet(path).schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(src))

    def prep(df):
        return df.select((F.col("event_type") == "error").cast("int").alias("label"),
                         (F.col("value") >= 50).cast("int").alias("prediction"))

    q = (confusion_stream(prep(stream)).writeStream.outputMode("complete").format("memory")
         .option("checkpointLocation", str(tmp_path / "ckpt")).queryName("rb_counts").start())
    try:
        q.processAllAvailable()
        got = spark.sql("SELECT * FROM rb_counts").first()
    finally:
        q.stop()
    batch = {(r["label"], r["prediction"]): r["n"] for r in metrics.confusion_counts(prep(spark.read.parquet(path))).collect()}
    assert (got["tp"], got["fp"], got["tn"], got["fn"]) == (batch[(1, 1)], batch[(0, 1)], batch[(0, 0)], batch[(1, 0)])
