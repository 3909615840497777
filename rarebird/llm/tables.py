"""Tables between the steps of an operator."""

from __future__ import annotations

from pyspark.sql import DataFrame

from rarebird import session

#: Spark's own setting: when a query ends, the shuffle files that it wrote are removed.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def discard(df: DataFrame) -> None:
    """Delete the files of a table that :func:`materialize` wrote, once all that reads it is written."""
    spark = df.sparkSession
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def materialize(df: DataFrame, name: str = "t") -> DataFrame:
    """``rarebird.session.materialize``, without the shuffle files of the write.

    Once the table stands in the shared folder, later steps read it and never the shuffle
    that made it, also after an executor is lost. So steps take turns on the executors'
    disks in place of adding up until the driver's garbage collection finds them. The
    session's setting is as before afterwards.
    """
    conf = df.sparkSession.conf
    before = conf.get(CLEANUP, "false")
    conf.set(CLEANUP, "true")
    try:
        return session.materialize(df, name)
    finally:
        conf.set(CLEANUP, before)
