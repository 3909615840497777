"""Tables between steps: rows stay, shuffle files of the write go, the session's setting is kept."""

import glob
import time

from pyspark.sql import functions as F

from rarebird.llm import tables


def test_shuffle_files_go_with_the_write(spark):
    base = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()
    files = lambda: sum(len(glob.glob(f"{d}/*/shuffle_*")) for d in base)
    before, setting = files(), spark.conf.get(tables.CLEANUP)
    counts = spark.range(10000).groupBy((F.col("id") % 100).alias("k")).count()
    kept = tables.materialize(counts, "counts")
    for _ in range(50):
        if files() <= before:
            break
        time.sleep(0.1)
    assert files() <= before
    assert spark.conf.get(tables.CLEANUP) == setting
    assert kept.count() == counts.count() == 100
    assert tables.materialize(counts.where("k < 0")).count() == 0
