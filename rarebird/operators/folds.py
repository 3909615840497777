"""Stratified folds, per-fold train/test roles, learning-curve subsets.

Folds follow the unshuffled stratified k-fold rule of the reference's library
(trap T6): classes are encoded in order of first appearance (smallest id); the
sorted codes are dealt to folds round-robin, which fixes how many rows of each
class each fold gets; inside a class, rows in id order fill fold 0, then fold 1, ...
For a class starting at position ``st`` of the sorted codes with ``n`` rows,
fold i gets  floor((st+n-1-i+k)/k) - floor((st-1-i+k)/k)  rows.
Only per-class counts are aggregated; the per-row work is an exact rank within the
class (:func:`ranked`, no single-task window) and a broadcast range lookup.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rarebird.functions import required
from rarebird.operators.ranking import ranked
from rarebird.spec import TableSpec


def fold_bounds(df: DataFrame, spec: TableSpec, k: int = 5) -> DataFrame:
    """(label, fold, lo, hi): rows lo..hi (1-based, id order) of the class go to ``fold``."""
    y = spec.label
    cls = df.groupBy(y).agg(F.count(F.lit(1)).alias("_n"), F.min(spec.id).alias("_first"))
    before = Window.orderBy("_first").rowsBetween(Window.unboundedPreceding, -1)
    cls = cls.select(y, "_n", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_st"))  # classes only
    per = cls.select(y, "_n", "_st", F.explode(F.sequence(F.lit(0), F.lit(k - 1))).alias("fold"))
    size = (F.floor((F.col("_st") + F.col("_n") - 1 - F.col("fold") + k) / k)
            - F.floor((F.col("_st") - 1 - F.col("fold") + k) / k))
    per = per.withColumn("_size", size.cast("bigint"))
    upto = Window.partitionBy(y).orderBy("fold").rowsBetween(Window.unboundedPreceding, 0)
    per = per.withColumn("hi", F.sum("_size").over(upto))
    return per.select(y, F.col("fold").cast("int").alias("fold"), (F.col("hi") - F.col("_size") + 1).alias("lo"), "hi")


def stratified_kfold(df: DataFrame, spec: TableSpec, k: int = 5, fold_col: str = "fold") -> DataFrame:
    """Add ``fold`` in 0..k-1 to every row."""
    df = df.withColumn(spec.label, required(spec.label, spec.label))
    bounds = fold_bounds(df, spec, k)  # classes x k rows: broadcast
    r = ranked(df, [spec.id], group=[spec.label], rank_col="_j")
    b = F.broadcast(bounds.withColumnRenamed(spec.label, "_y"))
    out = r.join(b, (F.col(spec.label) == F.col("_y")) & F.col("_j").between(F.col("lo"), F.col("hi")))
    return out.drop("_y", "_j", "lo", "hi").withColumnRenamed("fold", fold_col)


def fold_split(df: DataFrame, fold: int, fold_col: str = "fold") -> tuple[DataFrame, DataFrame]:
    """(train, test) of one fold; resampling, if any, is applied to train only."""
    return df.where(F.col(fold_col) != fold), df.where(F.col(fold_col) == fold)


def fold_roles(df: DataFrame, k: int, fold_col: str = "fold") -> DataFrame:
    """P6, long form: every row once per fold with role 'train' or 'test'."""
    out = df.withColumn("_f", F.explode(F.sequence(F.lit(0), F.lit(k - 1))))
    role = F.when(F.col("_f") == F.col(fold_col), F.lit("test")).otherwise(F.lit("train"))
    return out.withColumn("role", role).drop(fold_col).withColumnRenamed("_f", fold_col)


def learning_sizes(df: DataFrame, fold_col: str, fractions) -> list[int]:
    """Absolute training sizes: fraction x rows of the first split's training set, floored, distinct."""
    n_train = df.where(F.col(fold_col) != 0).count()
    return sorted({int(f * n_train) if isinstance(f, float) else int(f) for f in fractions} - {0})


def learning_ranks(df: DataFrame, spec: TableSpec, k: int, fold_col: str = "fold") -> DataFrame:
    """``df`` with ``rank_0`` .. ``rank_{k-1}``: a row's place (from 1, in id order) among the training rows of
    each fold, null where it is a test row. One ranking for all folds: a place among the rows outside fold i is
    the place among all rows less the rows of fold i so far. Every training prefix of every size is then a filter."""
    flags = [f"_in{i}" for i in range(k)]
    marked = df.select("*", *[(F.col(fold_col) == i).cast("int").alias(c) for i, c in enumerate(flags)])
    r = ranked(marked, [spec.id], rank_col="_j", sums=flags)
    place = [F.when(F.col(fold_col) != i, F.col("_j") - F.col(f"cum_{c}")).alias(f"rank_{i}") for i, c in enumerate(flags)]
    return r.select(*df.columns, *place)


def learning_subset(df: DataFrame, spec: TableSpec, sizes: list[int], k: int, fold_col: str = "fold") -> DataFrame:
    """(fold, size, rows...): for each fold, the first ``size`` training rows in id order."""
    r = learning_ranks(df, spec, k, fold_col)
    # Each training row belongs to every subset whose size is at least its rank.
    sz = F.array(*[F.lit(int(s)).cast("bigint") for s in sizes])
    each = F.flatten(F.array(*[F.transform(F.filter(sz, lambda s: s >= F.col(f"rank_{i}")), lambda s: F.struct(F.lit(i).alias("f"), s.alias("s"))) for i in range(k)]))
    out = r.withColumn("_e", F.explode(each)).withColumn(fold_col, F.col("_e.f")).withColumn("size", F.col("_e.s"))
    return out.drop("_e", *[f"rank_{i}" for i in range(k)])
