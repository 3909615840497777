"""V1-V4: stratified cross-validation (optionally resampled), many models, summaries.

Folds are computed once (exact, distributed) and shared by every model and candidate.
Per fold: optional scaling fitted on the training part (default; ``leaky_scaling``
instead expects an already scaled table, like the reference), optional resampling of
the training part only (trap T13), fit, score the test part. All score tables are
unioned and the metrics are one grouped aggregate over (model, fold).
Fits run concurrently from a bounded driver thread pool: each is its own Spark job. Folds resampled by
neighbours come one after the other, as each search fills the cluster and needs disk for its shuffles.
"""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rarebird.operators import folds as fo
from rarebird.operators import sampling as sa
from rarebird.operators import scaling
from rarebird.operators.metrics import METRICS, metrics_long
from rarebird.plans import models as mo
from rarebird.session import materialize, passing
from rarebird.spec import TableSpec

SAMPLERS = (None, "smote", "near_miss", "undersample")
BY_NEIGHBOURS = ("smote", "near_miss")


def with_folds(df: DataFrame, spec: TableSpec, k: int = 5) -> DataFrame:
    """P1 once, kept for every model and candidate that uses the same folds."""
    return fo.stratified_kfold(df, spec, k).persist()


def resample(train: DataFrame, spec: TableSpec, sample: str | None, seed: int = 42,
             features: list[str] | None = None) -> DataFrame:
    if sample not in SAMPLERS:
        raise ValueError(f"unknown sample {sample!r}; use one of {SAMPLERS}")  # trap T11
    feats = list(features or spec.features)
    if sample is None:
        return train
    if sample == "smote":
        return sa.smote(train, spec, 5, seed, feats)
    if sample == "near_miss":
        return sa.near_miss(train, spec, 3, feats)
    return sa.undersample(train.select(spec.id, *feats, spec.label), spec, seed)


def prepared_fold(folded: DataFrame, spec: TableSpec, i: int, sample: str | None = None, scale: str | None = "standard",
                  features: list[str] | None = None, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """(training rows, test rows) of fold ``i``, scaled and resampled."""
    feats = list(features or spec.features)
    sub = spec.only(feats)
    train, test = fo.fold_split(folded, i)
    if scale:
        stats = scaling.fit_scaler(train, sub, scale)
        train, test = scaling.apply_scaler(train, sub, stats), scaling.apply_scaler(test, sub, stats)
    return resample(train, sub, sample, seed, feats), test


def prepared_folds(folded: DataFrame, spec: TableSpec, k: int, sample: str | None = None, scale: str | None = "standard",
                   features: list[str] | None = None, seed: int = 42, folds: list[int] | None = None, parallelism: int = 4,
                   write: bool = False) -> dict[int, tuple[DataFrame, DataFrame]]:
    """{fold: (training rows, test rows)}, scaled and resampled; ``write`` stores both, for several models."""
    kept = (lambda df: materialize(df, "fold")) if write and (scale or sample) else (lambda df: df)

    def one(i: int):
        train, test = prepared_fold(folded, spec, i, sample, scale, features, seed)
        return kept(train), kept(test)

    ids = folds if folds is not None else list(range(k))
    with ThreadPoolExecutor(max_workers=max(1, min(_at_once(sample, parallelism), len(ids)))) as pool:
        return dict(zip(ids, pool.map(one, ids), strict=True))


def _at_once(sample: str | None, parallelism: int) -> int:
    return 1 if sample in BY_NEIGHBOURS else parallelism


def fold_scores(folded: DataFrame, spec: TableSpec, cfg: mo.ModelConfig, k: int, sample: str | None = None,
                scale: str | None = "standard", features: list[str] | None = None, seed: int = 42,
                folds: list[int] | None = None, parallelism: int = 4, prepared: dict | None = None) -> DataFrame:
    """Score tables of every fold, unioned: (fold, id, label, prediction, score)."""
    feats = list(features or spec.features)
    sub = spec.only(feats)
    ids = folds if folds is not None else list(range(k))
    by_one = not prepared and sample in BY_NEIGHBOURS
    tables = prepared if by_one or prepared else prepared_folds(folded, spec, k, sample, scale, feats, seed, ids, parallelism)

    def score(train: DataFrame, test: DataFrame, i: int) -> DataFrame:
        return mo.score_table(mo.fit(train, sub, cfg, feats), test).withColumn("fold", F.lit(i))

    def one(i: int) -> DataFrame:
        if not by_one:
            return score(*tables[i], i)
        with passing(folded.sparkSession):  # the training rows of a fold go when its model is fitted
            return score(*prepared_fold(folded, spec, i, sample, scale, feats, seed), i)

    with ThreadPoolExecutor(max_workers=max(1, min(_at_once(sample, parallelism), len(ids)))) as pool:
        parts = list(pool.map(one, ids))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def cross_validate(folded: DataFrame, spec: TableSpec, cfg: mo.ModelConfig, k: int = 5,
                   metrics=("f1",), sample: str | None = None, scale: str | None = "standard",
                   features: list[str] | None = None, seed: int = 42, model: str | None = None,
                   parallelism: int = 4, prepared: dict | None = None) -> DataFrame:
    """V1 (and V2 with ``sample``): (model, fold, metric, value). Metrics as :func:`metrics_long` takes them."""
    bad = {m for m in metrics if not callable(m)} - set(METRICS)
    if bad:
        raise ValueError(f"unknown metrics {sorted(bad)}")
    scored = fold_scores(folded, spec, cfg, k, sample, scale, features, seed, parallelism=parallelism, prepared=prepared)
    out = metrics_long(scored, ["fold"], spec.label, "prediction", metrics)
    return out.select(F.lit(model or cfg.name).alias("model"), "fold", "metric", "value")


def cross_validate_resampled(folded: DataFrame, spec: TableSpec, cfg: mo.ModelConfig, sample: str, k: int = 5,
                             **kw) -> DataFrame:
    """V2: SMOTE / NearMiss / undersampling on the training folds, the five metrics."""
    return cross_validate(folded, spec, cfg, k, METRICS, sample, **kw)


def cross_validate_many(folded: DataFrame, spec: TableSpec, cfgs: dict[str, mo.ModelConfig], k: int = 5,
                        metrics=("f1",), sample: str | None = None, scale: str | None = "standard",
                        features: list[str] | None = None, seed: int = 42, parallelism: int = 4) -> DataFrame:
    """V3: every model, same folds, scaled and resampled once for all of them (all arguments honoured)."""
    if sample not in SAMPLERS:
        raise ValueError(f"unknown sample {sample!r}")
    tables = prepared_folds(folded, spec, k, sample, scale, features, seed, None, parallelism, write=True)
    parts = [cross_validate(folded, spec, c, k, metrics, sample, scale, features, seed, name, parallelism, tables) for name, c in cfgs.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def score_summary(scores: DataFrame, group=("model", "metric")) -> DataFrame:
    """V4: per (model, metric): fold values in fold order, mean and population std."""
    return scores.groupBy(*group).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("fold", "value"))), lambda s: s["value"]).alias("scores"),
        F.avg("value").alias("mean"),
        F.stddev_pop("value").alias("std"),
    )
