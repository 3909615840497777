"""Exact positions and running sums per group without a single-task window.

``row_number() over (partition by label order by id)`` puts a whole class into one
task: with two classes that is two tasks whatever the cluster size. Instead:

1. range-partition on (group, order...) so every partition holds a contiguous,
   sampled-size slice of the global order (hot values are split by the later keys);
2. sort within partitions and record (partition id, position) as data, then write
   the result to the shared scratch folder, so both later uses see the same layout;
3. per (partition, group): first position, row count and column totals; this table
   has at most partitions + groups rows, so a prefix sum over it is cheap and it is
   broadcast back;
4. rank = position - first position + 1 + rows of the group in earlier partitions.
   Running sums are a window over (partition, group), i.e. over one range slice.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rarebird.session import materialize, target_partitions


def ranked(df: DataFrame, order: list, group: list[str] | tuple = (), rank_col: str = "rank",
           sums: list[str] | tuple = (), sum_prefix: str = "cum_", partitions: int | None = None) -> DataFrame:
    """Add ``rank_col`` = exact 1-based ``row_number()`` over (partition by ``group`` order by ``order``).

    ``order`` must be a total order (end it with a unique column). A null group is a group
    of its own; no row is dropped. For every column in
    ``sums`` add ``cum_<col>`` = running sum in that order, current row included.
    """
    group = list(group)
    order_cols: list[Column] = [F.col(c) if isinstance(c, str) else c for c in order]
    keys = [F.col(g) for g in group] + order_cols
    n = partitions or target_partitions(df)
    laid_out = (
        df.repartitionByRange(n, *keys)
        .sortWithinPartitions(*keys)
        .withColumn("_pid", F.spark_partition_id())
        .withColumn("_pos", F.monotonically_increasing_id())
    )
    laid_out = materialize(laid_out, "ranked")

    aggs = [F.min("_pos").alias("_start"), F.count(F.lit(1)).alias("_n")]
    aggs += [F.sum(c).alias(f"_tot_{c}") for c in sums]
    stats = laid_out.groupBy("_pid", *group).agg(*aggs)
    earlier = Window.partitionBy(*group).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = stats.select(
        "_pid", *group, "_start",
        F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_off"),
        *[F.coalesce(F.sum(f"_tot_{c}").over(earlier), F.lit(0)).alias(f"_off_{c}") for c in sums],
    )
    # At most (partitions + groups) rows: a proven bound, so broadcast.
    # Null is a group like any other.
    same = F.col("_pid") == F.col("_pid2")
    for i, g in enumerate(group):
        same = same & F.col(g).eqNullSafe(F.col(f"_group{i}"))
    offsets = offsets.withColumnsRenamed({"_pid": "_pid2", **{g: f"_group{i}" for i, g in enumerate(group)}})
    out = laid_out.join(F.broadcast(offsets), same).drop("_pid2", *[f"_group{i}" for i in range(len(group))])
    out = out.withColumn(rank_col, F.col("_pos") - F.col("_start") + 1 + F.col("_off"))
    if sums:
        local = Window.partitionBy("_pid", *group).orderBy("_pos").rowsBetween(Window.unboundedPreceding, 0)
        for c in sums:
            out = out.withColumn(f"{sum_prefix}{c}", F.sum(c).over(local) + F.col(f"_off_{c}"))
    drop = ["_pid", "_pos", "_start", "_off", *[f"_off_{c}" for c in sums]]
    return out.drop(*drop)


def exact_quantiles(df: DataFrame, columns: list[str], probs: list[float]) -> DataFrame:
    """Linear-interpolated quantiles (``quantile_cont``) per column, exact and distributed.

    Returns (column, p, value). Nulls are ignored. Equal values are counted first (a partial
    aggregate), so a hot value is one row; :func:`ranked` then runs over the distinct
    values with running sums of their counts.
    """
    long = df.select(
        F.explode(F.array(*[
            F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("v")) for c in columns
        ])).alias("_cv")
    ).select("_cv.column", "_cv.v").where(F.col("v").isNotNull())
    long = long.groupBy("column", "v").agg(F.count(F.lit(1)).alias("_c"))
    # Positions needed per (column, p): h = (n-1)p, rows floor(h)+1 and floor(h)+2 (1-based).
    counts = long.groupBy("column").agg(F.sum("_c").alias("_cnt"))
    want = counts.select("column", "_cnt", F.explode(F.array(*[F.lit(float(p)) for p in probs])).alias("p"))
    want = want.select("column", "p", ((F.col("_cnt") - 1) * F.col("p")).alias("_h"))
    want = want.select("column", "p", "_h", F.floor("_h").cast("bigint").alias("_lo"))
    r = ranked(long, ["v"], group=["column"], rank_col="_d", sums=["_c"])
    # Only two rows per (column, p) are kept from the ranked table.
    picks = want.select("column", "p", "_h", "_lo", F.explode(F.array(F.col("_lo") + 1, F.col("_lo") + 2)).alias("_r"))
    got = r.join(F.broadcast(picks), "column").where((F.col("_r") <= F.col("cum__c")) & (F.col("_r") > F.col("cum__c") - F.col("_c")))
    return got.groupBy("column", "p").agg(
        F.first("_h").alias("_h"), F.first("_lo").alias("_lo"),
        F.min_by("v", "_r").alias("_a"), F.max_by("v", "_r").alias("_b"),
    ).select(
        "column", "p",
        (F.col("_a") + (F.col("_h") - F.col("_lo")) * (F.col("_b") - F.col("_a"))).alias("value"),
    )
