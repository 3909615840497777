"""Profiling, projections, encodings, class counts and class weights."""

from __future__ import annotations

from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rarebird.functions import required
from rarebird.operators.ranking import exact_quantiles, ranked
from rarebird.spec import TableSpec

NUMERIC_TYPES = ("int", "bigint", "smallint", "tinyint", "double", "float")


def numeric_columns(df: DataFrame) -> list[str]:
    return [c for c, t in df.dtypes if t in NUMERIC_TYPES or t.startswith("decimal")]


def shape(df: DataFrame) -> DataFrame:
    """(n_rows, n_cols)."""
    return df.agg(F.count(F.lit(1)).alias("n_rows")).withColumn("n_cols", F.lit(len(df.columns)))


def profile(df: DataFrame, columns: list[str] | None = None, exact: bool = True,
            accuracy: int = 10000) -> DataFrame:
    """describe() per numeric column, long form.

    (column, dtype, count, mean, std, min, q25, q50, q75, max); std is the sample
    standard deviation. Quantiles are exact and linearly interpolated (a distributed
    rank, :func:`exact_quantiles`); ``exact=False`` takes them from the same single
    aggregate with bounded-memory ``percentile_approx`` sketches instead.
    """
    cols = columns or numeric_columns(df)
    dtypes = dict(df.dtypes)
    aggs = []
    for c in cols:
        x = F.col(c).cast("double")
        aggs += [F.count(c).alias(f"{c}__count"), F.avg(x).alias(f"{c}__mean"),
                 F.stddev_samp(x).alias(f"{c}__std"), F.min(x).alias(f"{c}__min"), F.max(x).alias(f"{c}__max")]
        if not exact:
            aggs.append(F.percentile_approx(x, [0.25, 0.5, 0.75], accuracy).alias(f"{c}__q"))
    one = df.agg(*aggs)  # one pass, partial aggregates, one row
    stacked = one.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), F.lit(dtypes[c]).alias("dtype"),
                 F.col(f"{c}__count").alias("count"), F.col(f"{c}__mean").alias("mean"),
                 F.col(f"{c}__std").alias("std"), F.col(f"{c}__min").alias("min"),
                 F.col(f"{c}__max").alias("max"),
                 *([F.col(f"{c}__q")[i].alias(n) for i, n in enumerate(("q25", "q50", "q75"))] if not exact else []))
        for c in cols])).alias("s")).select("s.*")
    if not exact:
        return stacked.select("column", "dtype", "count", "mean", "std", "min", "q25", "q50", "q75", "max")
    q = exact_quantiles(df, cols, [0.25, 0.5, 0.75])
    wide_q = q.groupBy("column").agg(
        F.max(F.when(F.col("p") == 0.25, F.col("value"))).alias("q25"),
        F.max(F.when(F.col("p") == 0.5, F.col("value"))).alias("q50"),
        F.max(F.when(F.col("p") == 0.75, F.col("value"))).alias("q75"),
    )
    # Both sides have one row per column: a proven bound.
    return stacked.join(F.broadcast(wide_q), "column", "left").select(
        "column", "dtype", "count", "mean", "std", "min", "q25", "q50", "q75", "max")


def column_list(df: DataFrame) -> DataFrame:
    """D1, the list of all columns, numeric or not: (position, column, dtype, non_null, rows). One aggregate."""
    one = df.agg(F.count(F.lit(1)).alias("rows"), *[F.count(F.col(f"`{c}`")).alias(f"n{i}") for i, c in enumerate(df.columns)])
    each = [F.struct(F.lit(i).alias("position"), F.lit(c).alias("column"), F.lit(t).alias("dtype"), F.col(f"n{i}").alias("non_null")) for i, (c, t) in enumerate(df.dtypes)]
    return one.select("rows", F.explode(F.array(*each)).alias("c")).select("c.*", "rows")


def head(df: DataFrame, id_col: str, n: int = 5) -> DataFrame:
    """First n rows by id (a top-n sort, no full sort)."""
    return df.orderBy(id_col).limit(n)


def split_features_label(df: DataFrame, spec: TableSpec, features: list[str] | None = None) -> DataFrame:
    """D3, column form: (id, features..., label) with the label last."""
    feats = features or spec.features
    return df.select(spec.id, *feats, spec.label)


def assemble(df: DataFrame, spec: TableSpec, features: list[str] | None = None,
             out: str = "features", keep: list[str] | None = None) -> DataFrame:
    """D3, model form: (id, features vector, label as double, *keep)."""
    feats = features or spec.features
    va = VectorAssembler(inputCols=list(feats), outputCol=out, handleInvalid="error")
    cols = [spec.id, out, F.col(spec.label).cast("double").alias(spec.label), *(keep or [])]
    return va.transform(df).select(*cols)


def label_encode(df: DataFrame, columns: list[str]) -> tuple[DataFrame, DataFrame]:
    """Replace each column by its code 0..n-1 in sorted value order.

    Returns (table, mapping(column, value, code)); the mapping lets a test table be
    encoded the same way (:func:`apply_label_encoding`).
    """
    maps = []
    for c in columns:
        values = df.select(F.col(c).cast("string").alias("value")).where(F.col("value").isNotNull()).distinct()
        codes = ranked(values, ["value"], rank_col="_r").select(
            F.lit(c).alias("column"), "value", (F.col("_r") - 1).cast("int").alias("code"))
        maps.append(codes)
    mapping = maps[0]
    for m in maps[1:]:
        mapping = mapping.unionByName(m)
    return apply_label_encoding(df, mapping, columns), mapping


def apply_label_encoding(df: DataFrame, mapping: DataFrame, columns: list[str]) -> DataFrame:
    out = df
    for c in columns:
        m = mapping.where(F.col("column") == c).select(F.col("value").alias("_v"), F.col("code").alias("_code"))
        out = out.withColumn("_v", F.col(c).cast("string")).join(m, "_v", "left")
        out = out.withColumn(c, F.col("_code")).drop("_v", "_code")
    return out.select(*df.columns)


def impute_median(df: DataFrame, columns: list[str]) -> tuple[DataFrame, DataFrame]:
    """Fill nulls with the column median (exact, distributed). Returns (table, medians)."""
    med = exact_quantiles(df, columns, [0.5]).select("column", F.col("value").alias("median"))
    values = {r["column"]: r["median"] for r in med.collect()}  # one row per column
    out = df.select(*[
        F.coalesce(F.col(c).cast("double"), F.lit(values.get(c))).alias(c) if c in columns else F.col(c)
        for c in df.columns
    ])
    return out, med


def one_hot(df: DataFrame, columns: list[str], max_levels: int = 1000) -> DataFrame:
    """0/1 dummy columns ``<column>_<value>`` in sorted value order, originals dropped.

    The level names become the plan's columns, so a column with more than ``max_levels``
    raises: :func:`one_hot_vector` takes any number."""
    out = df
    for c in columns:
        levels = df.select(F.col(c).cast("string").alias("v")).where(F.col("v").isNotNull()).distinct()
        vals = sorted(r["v"] for r in levels.limit(max_levels + 1).collect())
        if len(vals) > max_levels:
            raise ValueError(f"{c} has more than {max_levels} levels; use one_hot_vector")
        out = out.select(*[x for x in out.columns if x != c],
                         *[(F.col(c).cast("string") == v).cast("int").alias(f"{c}_{v}") for v in vals])
    return out


def one_hot_vector(df: DataFrame, columns: list[str]) -> tuple[DataFrame, DataFrame]:
    """D6 for any number of levels: each column becomes a sparse vector with a 1 at its value's code;
    a null value is the empty vector. Returns (table, mapping(column, value, code)). Codes
    are ranked and joined as tables, so no level passes through the driver."""
    from pyspark.ml.feature import OneHotEncoder

    coded, mapping = label_encode(df, columns)
    sizes = {r["column"]: r["n"] for r in mapping.groupBy("column").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row for each column
    # nulls take the code after the last, which the encoder drops
    coded = coded.select(*[F.coalesce(F.col(c), F.lit(sizes.get(c, 0))).cast("int").alias(c) if c in columns else F.col(c) for c in coded.columns])
    for c in columns:
        top = coded.sparkSession.createDataFrame([(sizes.get(c, 0),)], f"`{c}` int")
        model = OneHotEncoder(inputCols=[c], outputCols=[f"_{c}"], dropLast=True).fit(top)
        coded = model.transform(coded).drop(c).withColumnRenamed(f"_{c}", c)
    return coded.select(*df.columns), mapping


def select_features(df: DataFrame, spec: TableSpec, columns: list[str]) -> DataFrame:
    """Keep the id, the named columns and the label."""
    return df.select(spec.id, *columns, spec.label)


def drop_features(df: DataFrame, spec: TableSpec, columns: list[str]) -> DataFrame:
    """Drop feature columns; the id and label are never dropped."""
    bad = {spec.id, spec.label} & set(columns)
    if bad:
        raise ValueError(f"drop_features takes only features, got {sorted(bad)}")
    return df.drop(*columns)


def filter_class(df: DataFrame, spec: TableSpec, value: int) -> DataFrame:
    """Rows of one class (a filter Spark pushes to the parquet scan when possible)."""
    return df.where(F.col(spec.label) == value)


def class_counts(df: DataFrame, spec: TableSpec) -> DataFrame:
    """(label, n, share)."""
    counts = df.groupBy(spec.label).agg(F.count(F.lit(1)).alias("n"))
    total = Window.partitionBy()  # over the per-class rows only
    return counts.select(spec.label, "n", (F.col("n") / F.sum("n").over(total)).alias("share"))


def class_weights(df: DataFrame, spec: TableSpec, mode: str = "balanced", positive_weight: float = 2.0,
                  weight_col: str = "weight") -> DataFrame:
    """Add a weight column. ``balanced``: n / (classes * n_class); ``positive``: fixed
    weight for label 1 (boosted trees' scale_pos_weight), 1 for label 0."""
    if mode == "positive":
        return df.withColumn(weight_col, F.when(F.col(spec.label) == 1, F.lit(float(positive_weight)))
                             .otherwise(F.lit(1.0)))
    if mode != "balanced":
        raise ValueError(mode)
    df = df.withColumn(spec.label, required(spec.label, spec.label))
    counts = df.groupBy(spec.label).agg(F.count(F.lit(1)).alias("_nc"))
    every = Window.partitionBy()
    weights = counts.select(
        spec.label,
        (F.sum("_nc").over(every) / (F.count(F.lit(1)).over(every) * F.col("_nc"))).alias(weight_col))
    # One row per class: a proven bound.
    return df.join(F.broadcast(weights), spec.label)
