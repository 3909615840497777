"""The numbers behind the reference's charts (drawing is not built)."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rarebird.operators.ranking import exact_quantiles


def correlation_matrix(df: DataFrame, columns: list[str], method: str = "sql") -> DataFrame:
    """G1: Pearson correlation of every pair (a <= b), long form (a, b, corr).

    ``sql``: one aggregate pass over all pairs, nulls skipped pair by pair (the reference's
    semantics). ``vector``: one pass building the covariance matrix of an assembled vector
    (``pyspark.ml.stat.Correlation``), for wide tables without nulls, when the caller asks
    for it. In both a pair with a constant column has no correlation (null), the diagonal
    included.
    """
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i:]]
    if method == "vector":
        from pyspark.ml.feature import VectorAssembler
        from pyspark.ml.stat import Correlation

        vec = VectorAssembler(inputCols=list(columns), outputCol="_v").transform(
            df.select(*[F.col(c).cast("double").alias(c) for c in columns]))
        m = Correlation.corr(vec, "_v", "pearson").first()[0].toArray()  # d x d, on the driver
        spread = df.agg(*[F.stddev_pop(F.col(c).cast("double")).alias(c) for c in columns]).first()
        idx = {c: i for i, c in enumerate(columns)}
        rows = [(a, b, float(m[idx[a], idx[b]]) if spread[a] and spread[b] else None) for a, b in pairs]
        return df.sparkSession.createDataFrame(rows, "a string, b string, corr double")
    if method != "sql":
        raise ValueError(method)

    def corr(a: str, b: str):
        x, y = F.col(a).cast("double"), F.col(b).cast("double")
        spread = F.stddev_pop(F.when(y.isNotNull(), x)) * F.stddev_pop(F.when(x.isNotNull(), y))
        return F.covar_pop(x, y) / F.nullif(spread, F.lit(0.0))

    aggs = [corr(a, b).alias(f"c{i}") for i, (a, b) in enumerate(pairs)]
    one = df.agg(*aggs)
    arr = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"c{i}").alias("corr"))
                    for i, (a, b) in enumerate(pairs)])
    return one.select(F.explode(arr).alias("p")).select("p.*")


def grouped_mean(df: DataFrame, x: str, y: str, z: float = 1.959963984540054) -> DataFrame:
    """Mean of y per x with a normal 95 % interval: (x, n, mean, std, ci_low, ci_high)."""
    g = df.groupBy(x).agg(F.count(y).alias("n"), F.avg(F.col(y).cast("double")).alias("mean"),
                          F.stddev_samp(F.col(y).cast("double")).alias("std"))
    half = F.lit(z) * F.col("std") / F.sqrt(F.col("n"))
    return g.select(x, "n", "mean", "std", (F.col("mean") - half).alias("ci_low"), (F.col("mean") + half).alias("ci_high"))


def bootstrap_mean(df: DataFrame, x: str, y: str, id_col: str, replicates: int = 100, level: float = 0.95, seed: int = 42) -> DataFrame:
    """G2 with a bootstrap interval: (x, n, mean, ci_low, ci_high), quantiles of the replicates' means.

    Poisson bootstrap (Chamandy et al., 2012): in each replicate a row counts as often as a
    Poisson(1) draw says, which md5(seed-block-id) gives, four replicates a block. So no replicate
    needs the table's size or a second pass: all of them are sums of one aggregate. Rows
    without y count nowhere; replicates without rows are left out.
    """
    cdf, p, steps = 0.0, math.exp(-1.0), []
    for k in range(13):  # a draw above 13 has less than 2^-32 chance
        cdf += p
        p /= k + 1
        steps.append(int(cdf * 2**32))
    rows = df.where(F.col(y).isNotNull()).select(F.col(x).alias("x"), F.col(y).cast("double").alias("y"), F.col(id_col).cast("string").alias("id"))
    rows = rows.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit((replicates - 1) // 4))))
    digest = F.md5(F.concat(F.lit(f"{seed}-"), F.col("block").cast("string"), F.lit("-"), F.col("id")))
    draws = rows.select("x", "y", "block", *[F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("bigint").alias(f"u{i}") for i in range(4)])
    # times: how many steps a draw reaches
    times = lambda i: sum((F.when(F.col(f"u{i}") >= s, 1).otherwise(0) for s in steps), F.lit(0))
    draws = draws.select("x", "y", "block", *[times(i).alias(f"w{i}") for i in range(4)])
    sums = draws.groupBy("x", "block").agg(F.count(F.lit(1)).alias("n"), F.avg("y").alias("mean"), *[F.sum(f"w{i}").alias(f"w{i}") for i in range(4)],
                                           *[F.sum(F.col(f"w{i}") * F.col("y")).alias(f"s{i}") for i in range(4)])
    each = sums.select("x", "n", "mean", F.explode(F.array(*[F.struct((F.col("block") * 4 + i).alias("r"), (F.col(f"s{i}") / F.nullif(F.col(f"w{i}"), F.lit(0))).alias("m")) for i in range(4)])).alias("e"))
    each = each.where(F.col("e.r") < replicates)
    tail = (1 - level) / 2
    # at most `replicates` values a group
    return each.groupBy("x").agg(F.max("n").alias("n"), F.max(F.when(F.col("e.r") == 0, F.col("mean"))).alias("mean"), F.percentile("e.m", F.lit(tail)).alias("ci_low"),
                                 F.percentile("e.m", F.lit(1 - tail)).alias("ci_high")).withColumnRenamed("x", x)


def histogram(df: DataFrame, column: str, max_bins: int = 50) -> DataFrame:
    """Equal-width density histogram; bins = min(Freedman-Diaconis, max_bins).

    FD width = 2 IQR / n^(1/3) (exact quantiles); bins = ceil((max - min) / width),
    sqrt(n) when the IQR is 0. Output (bin, lo, hi, count, density) with
    density = count / (n * width); the last bin is closed on the right.
    """
    x = F.col(column).cast("double")
    st = df.agg(F.count(x).alias("n"), F.min(x).alias("mn"), F.max(x).alias("mx")).first()
    n, mn, mx = st["n"], st["mn"], st["mx"]
    q = {r["p"]: r["value"] for r in exact_quantiles(df, [column], [0.25, 0.75]).collect()}
    iqr = q[0.75] - q[0.25]
    if n < 2:
        nb = 1
    else:
        h = 2 * iqr / n ** (1 / 3)
        nb = int(math.sqrt(n)) if h == 0 else int(math.ceil((mx - mn) / h))
    nb = max(1, min(nb, max_bins))
    w = (mx - mn) / nb
    if w == 0:
        b = F.lit(0)
    else:
        b = F.least(F.floor((x - F.lit(mn)) / F.lit(w)), F.lit(nb - 1)).cast("int")
    counts = df.where(x.isNotNull()).groupBy(b.alias("bin")).agg(F.count(F.lit(1)).alias("count"))
    # Every bin, empty ones included: at most max_bins rows.
    every = df.sparkSession.range(nb).select(F.col("id").cast("int").alias("bin"))
    counts = F.broadcast(every).join(counts, "bin", "left").select("bin", F.coalesce("count", F.lit(0)).alias("count"))
    width = w if w else 1.0
    return counts.select(
        "bin", (F.lit(mn) + F.col("bin") * F.lit(w)).alias("lo"), (F.lit(mn) + (F.col("bin") + 1) * F.lit(w)).alias("hi"),
        "count", (F.col("count") / F.lit(n * width)).alias("density"))
