"""M7-M9: chance baselines as score tables (id, label, prediction, score).

They are fitted on a training table (class shares) and applied to any table;
their randomness is md5(seed-id), so it is reproducible and oracle-checkable.
``uniform`` takes ``randomfactor`` (default 0.5), the probability of predicting 1.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rarebird.functions import hash_uniform
from rarebird.spec import TableSpec


def fit(train: DataFrame, spec: TableSpec, kind: str, params: dict | None = None) -> dict:
    """Training statistics of a baseline: two per-class counts, one aggregate."""
    if kind == "uniform":
        return {}
    rows = train.groupBy(spec.label).count().collect()  # at most two rows
    if kind == "most_frequent":
        top = sorted(rows, key=lambda r: (-r["count"], r[spec.label]))[0][spec.label]
        return {"top": int(top)}
    if kind == "stratified":
        n = sum(r["count"] for r in rows)
        pos = sum(r["count"] for r in rows if r[spec.label] == 1)
        return {"prevalence": pos / n if n else 0.0}
    raise ValueError(kind)


def predict(test: DataFrame, spec: TableSpec, kind: str, stats: dict, params: dict | None = None,
            seed: int = 42) -> DataFrame:
    params = params or {}
    seed = params.get("seed", seed)
    if kind == "most_frequent":
        pred, score = F.lit(stats["top"]), F.lit(float(stats["top"]))
    elif kind == "stratified":
        pred = hash_uniform(seed, spec.id) < F.lit(stats["prevalence"])
        score = pred
    elif kind == "uniform":
        pred = hash_uniform(seed, spec.id) < F.lit(float(params.get("randomfactor", 0.5)))
        score = pred
    else:
        raise ValueError(kind)
    return test.select(spec.id, F.col(spec.label).cast("int").alias(spec.label),
                       pred.cast("int").alias("prediction"), score.cast("double").alias("score"))


def most_frequent(train: DataFrame, test: DataFrame, spec: TableSpec) -> DataFrame:
    """M7: always the majority class of ``train`` (ties: the smaller label)."""
    return predict(test, spec, "most_frequent", fit(train, spec, "most_frequent"))


def stratified(train: DataFrame, test: DataFrame, spec: TableSpec, seed: int = 42) -> DataFrame:
    """M8: label 1 with probability = prevalence of ``train``."""
    return predict(test, spec, "stratified", fit(train, spec, "stratified"), seed=seed)


def uniform(train: DataFrame, test: DataFrame, spec: TableSpec, seed: int = 42,
            randomfactor: float = 0.5) -> DataFrame:
    """M9: label 1 with probability ``randomfactor`` (the reference's own random classifier)."""
    return predict(test, spec, "uniform", {}, {"randomfactor": randomfactor}, seed)
