"""Scalers whose statistics are one aggregate and whose transform is one projection.

Statistics table: one row per numeric column (column, center, scale).
standard: center = mean, scale = population std; minmax: center = min, scale = max - min.
Transform: (x - center) / scale, and 0 where scale is 0 (a constant column).
Output column order: id, scaled numerics, untouched flags, label last.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rarebird.spec import TableSpec


def fit_scaler(df: DataFrame, spec: TableSpec, kind: str = "standard") -> DataFrame:
    """C1 (standard) / C2 (minmax): one aggregate over all numeric columns."""
    cols = list(spec.numerics)
    if kind == "standard":
        aggs = [f(F.col(c).cast("double")).alias(f"{c}__{n}") for c in cols
                for n, f in (("center", F.avg), ("scale", F.stddev_pop))]
        one = df.agg(*aggs)
        structs = [F.struct(F.lit(c).alias("column"), F.col(f"{c}__center").alias("center"),
                            F.col(f"{c}__scale").alias("scale")) for c in cols]
    elif kind == "minmax":
        aggs = [f(F.col(c).cast("double")).alias(f"{c}__{n}") for c in cols
                for n, f in (("min", F.min), ("max", F.max))]
        one = df.agg(*aggs)
        structs = [F.struct(F.lit(c).alias("column"), F.col(f"{c}__min").alias("center"),
                            (F.col(f"{c}__max") - F.col(f"{c}__min")).alias("scale")) for c in cols]
    else:
        raise ValueError(kind)
    return one.select(F.explode(F.array(*structs)).alias("s")).select(
        "s.column", F.lit(kind).alias("kind"), "s.center", "s.scale")


def fit_standard_scaler(df: DataFrame, spec: TableSpec) -> DataFrame:
    return fit_scaler(df, spec, "standard")


def fit_minmax_scaler(df: DataFrame, spec: TableSpec) -> DataFrame:
    return fit_scaler(df, spec, "minmax")


def apply_scaler(df: DataFrame, spec: TableSpec, stats: DataFrame, keep: list[str] | tuple = ()) -> DataFrame:
    """One projection with the statistics as literals (one row per column, read once)."""
    rows = {r["column"]: (r["center"], r["scale"]) for r in stats.collect()}
    scaled = []
    for c in spec.numerics:
        center, scale = rows[c]
        x = F.col(c).cast("double")
        if scale is None or scale == 0:
            expr = F.lit(0.0) * x  # keeps nulls null
        else:
            expr = (x - F.lit(center)) / F.lit(scale)
        scaled.append(expr.alias(c))
    return df.select(spec.id, *scaled, *spec.flags, *keep, spec.label)


def fit_apply_scaler(df: DataFrame, spec: TableSpec, kind: str = "standard",
                     keep: list[str] | tuple = ()) -> tuple[DataFrame, DataFrame]:
    """C4: fit on ``df`` and transform it; returns (scaled table, statistics)."""
    stats = fit_scaler(df, spec, kind)
    return apply_scaler(df, spec, stats, keep), stats
