"""Session settings and the shared scratch folder."""

from __future__ import annotations

import gc
import os
import tempfile
import threading
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Scratch tables written by this process (see cleanup_scratch).
_WRITTEN: list[str] = []
# Those of the steps that a thread is in, innermost last (see passing).
_STEPS = threading.local()


def get_spark(master: str | None = None, app: str = "rarebird", shuffle_partitions: int | None = None,
              driver_memory: str = "16g") -> SparkSession:
    cpus = os.environ.get("BENCH_CPUS", "8")
    builder = (
        SparkSession.builder.master(master or f"local[{cpus}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions or cpus))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", driver_memory)
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def target_partitions(df: DataFrame, bytes_per_partition: int = 256 << 20) -> int:
    """Partitions for a sort-like shuffle of ``df``: the session's shuffle partitions, or
    more when the plan's inputs (sum of the leaf relations' sizes from plan statistics,
    no job) would put more than ``bytes_per_partition`` in a partition. Leaf sizes are
    used because join estimates without cost-based statistics are products of sides."""
    base = shuffle_partitions(df.sparkSession)
    try:
        leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
        total = 0
        for i in range(leaves.size()):
            size = int(str(leaves.apply(i).stats().sizeInBytes()))
            if size >= 1 << 62:  # unknown size
                return base
            total += size
    except Exception:  # noqa: BLE001 - statistics unavailable
        return base
    return max(base, -(-total // bytes_per_partition))


def scratch_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder the cluster names in ``spark.checkpoint.dir``.

    Only when nothing is configured and Spark runs in local mode (tests, bench)
    a folder is created here; on a cluster an unset folder is an error.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    conf = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not conf:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
        conf = tempfile.mkdtemp(prefix="rarebird-ckpt-")
    sc.setCheckpointDir(conf)
    return sc.getCheckpointDir()


def scratch_path(spark: SparkSession, name: str = "t") -> str:
    return f"{scratch_dir(spark).rstrip('/')}/rarebird-{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str = "t", keep: bool = False) -> DataFrame:
    """Write ``df`` as parquet in the shared folder and read it back.

    Cuts lineage and fixes values computed from physical layout (partition ids,
    positions) so that two later uses see the same rows, even after executor loss.
    With ``keep`` the table outlives the innermost :func:`passing` step, as its result.
    """
    path = scratch_path(df.sparkSession, name)
    steps = getattr(_STEPS, "open", [])
    step = steps[:-1] if keep else steps
    if step:
        step[-1].append(path)
    _WRITTEN.append(path)
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.parquet(path)


@contextmanager
def passing(spark: SparkSession):
    """A step whose scratch tables, written by this thread, are deleted at its end, with the shuffle files that
    nothing refers to any more: its results are kept with ``materialize(..., keep=True)`` or lie outside Spark."""
    if not hasattr(_STEPS, "open"):
        _STEPS.open = []
    made: list[str] = []
    _STEPS.open.append(made)
    try:
        yield
    finally:
        _STEPS.open.pop()
        for path in made:
            delete(spark, path)
            _WRITTEN.remove(path)
        if made:  # shuffle files go once the driver has collected what named them
            gc.collect()
            spark._jvm.System.gc()


def delete(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def cleanup_scratch(spark: SparkSession) -> int:
    """Delete the scratch tables this process wrote (through the Hadoop file system, so
    HDFS / object stores work too). Call it when no DataFrame built on them is used
    any more. Returns how many were deleted."""
    n = 0
    while _WRITTEN:
        n += delete(spark, _WRITTEN.pop())
    return n
