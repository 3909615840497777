"""V5-V8: grid and random search over shared folds, the top-n report, learning curves.

A candidate is a parameter combination; its score is the unweighted mean over folds
of one metric (default F1 of class 1, trap T9). Linear candidates are fitted together, all
folds of all of them in the same scans; other (candidate, fold) fits are independent Spark
jobs run from a bounded driver thread pool. The folds are computed once. Results: (candidate, params map, mean, std, rank) with rank() ties (trap T8).
"""

from __future__ import annotations

import hashlib
import itertools
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rarebird.operators import folds as fo
from rarebird.operators import scaling
from rarebird.functions import required
from rarebird.operators.metrics import METRICS, metrics_long, metrics_of_counts
from rarebird.plans import linear
from rarebird.plans import models as mo
from rarebird.plans.validation import fold_scores, resample
from rarebird.session import materialize
from rarebird.spec import TableSpec


@dataclass
class SearchResult:
    best: mo.Fitted
    best_params: dict
    best_score: float
    results: DataFrame


def grid(param_grid: dict[str, list]) -> list[dict]:
    keys = sorted(param_grid)
    return [dict(zip(keys, vals)) for vals in itertools.product(*[param_grid[k] for k in keys])]


def _params_text(p: dict) -> dict[str, str]:
    return {k: str(v) for k, v in sorted(p.items())}


def _linear(cfg: mo.ModelConfig) -> dict | None:
    """Loss, penalty and intercept of a model that :mod:`rarebird.plans.linear` fits; None for others."""
    p = cfg.params
    if cfg.kind == "logistic":
        return {"loss": "logistic", "penalty": p.get("penalty", "l2"), "C": float(p.get("C", 1.0))}
    if cfg.kind == "linear_svm" and p.get("loss", "squared_hinge") == "squared_hinge":
        return {"loss": "squared_hinge", "penalty": p.get("penalty", "l2"), "C": float(p.get("C", 1.0)), "penalise_intercept": True}
    return None


def fold_scalers(folded: DataFrame, spec: TableSpec, k: int, kind: str | None) -> dict:
    """{fold: (centres, scales)} of the scaler fitted on the other folds, over ``spec.features``; flags stay as they are. One aggregate."""
    if kind is None:
        return {}
    if kind not in ("standard", "minmax"):
        raise ValueError(kind)
    one = (lambda v: [F.avg(v), F.stddev_pop(v)]) if kind == "standard" else (lambda v: [F.min(v), F.max(v) - F.min(v)])
    aggs = [a for i in range(k) for c in spec.numerics for a in one(F.when(F.col("fold") != i, F.col(c).cast("double")))]
    row = folded.agg(*[a.alias(f"a{n}") for n, a in enumerate(aggs)]).first() if aggs else ()
    each = np.array([0.0 if v is None else v for v in row]).reshape(k, len(spec.numerics), 2)
    flags = len(spec.flags)
    return {i: (np.append(each[i, :, 0], np.zeros(flags)), np.append(each[i, :, 1], np.ones(flags))) for i in range(k)}


def fit_linear_candidates(folded: DataFrame, spec: TableSpec, cfgs: list[mo.ModelConfig], k: int, scale: str | None):
    """(fits, their solution, confusion counts (fit, tp, fp, tn, fn)) of every configuration on every fold, fold
    by fold within a configuration: all of them in the same scans."""
    feats = spec.features
    rows = folded.select(F.array(*[required(F.col(c).cast("double"), c) for c in feats]).alias("x"), F.col(spec.label).cast("int").alias("y"),
                         F.lit(1.0).alias("w"), F.col("fold").cast("int").alias("fold"))
    n = {(r.fold, r.y): r.n for r in rows.groupBy("fold", "y").agg(F.count(F.lit(1)).alias("n")).collect()}  # classes x folds
    rows = mo.dealt(rows, sum(n.values())).persist()
    try:
        scalers = fold_scalers(folded, spec, k, scale)
        fits = []
        for cfg in cfgs:
            for i in range(k):
                size = [sum(v for (f, y), v in n.items() if f != i and y == label) for label in (0, 1)]
                weights = {"balanced": tuple(sum(size) / (2 * s) if s else 0.0 for s in size), "positive": (1.0, cfg.positive_weight), None: (1.0, 1.0)}[cfg.weights]
                fits.append(linear.Linear(**_linear(cfg), hold=i, class_weights=weights))
        solved = linear.fit_linear(rows, len(feats), fits, scalers, max_iter=200)
        counts = materialize(linear.held_out_counts(rows, len(feats), fits, solved, scalers), "search")
        return fits, solved, counts
    finally:
        rows.unpersist()


def evaluate_candidates(folded: DataFrame, spec: TableSpec, base: mo.ModelConfig, candidates: list[dict],
                        k: int = 5, metric="f1", scale: str | None = "standard",
                        features: list[str] | None = None, parallelism: int = 4) -> DataFrame:
    """(candidate, params, fold, value) for every candidate and fold. Linear candidates with a smooth loss
    are fitted together, all folds of all of them in the same scans; others one by one from a thread pool."""
    if not callable(metric) and metric not in METRICS:
        raise ValueError(metric)
    spark = folded.sparkSession
    cfgs = [base.with_params(**c) for c in candidates]
    for cfg in cfgs:
        mo.check(cfg)
    sub = spec.only(list(features or spec.features))
    together = [] if callable(metric) else [ci for ci, cfg in enumerate(cfgs) if _linear(cfg)]
    parts = []
    if together:
        _, _, counts = fit_linear_candidates(folded, sub, [cfgs[ci] for ci in together], k, scale)
        number = F.element_at(F.array(*[F.lit(ci) for ci in together]), (F.floor(F.col("fit") / k) + 1).cast("int"))
        counts = counts.select(number.alias("candidate"), (F.col("fit") % k).cast("int").alias("fold"), "tp", "fp", "tn", "fn")
        parts.append(metrics_of_counts(counts, ["candidate", "fold"], [metric]))
    jobs = [(ci, i) for ci in range(len(candidates)) if ci not in together for i in range(k)]

    def one(job):
        ci, i = job
        s = fold_scores(folded, spec, cfgs[ci], k, None, scale, features, folds=[i], parallelism=1)
        return s.withColumn("candidate", F.lit(ci))

    if jobs:
        with ThreadPoolExecutor(max_workers=max(1, parallelism)) as pool:
            scored = list(pool.map(one, jobs))
        table = scored[0]
        for p in scored[1:]:
            table = table.unionByName(p)
        parts.append(metrics_long(table, ["candidate", "fold"], spec.label, "prediction", [metric]))
    vals = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    params = spark.createDataFrame(
        [(ci, _params_text(c)) for ci, c in enumerate(candidates)], "candidate int, params map<string,string>")
    # One row per candidate: a proven bound.
    return vals.join(F.broadcast(params), "candidate").select("candidate", "params", "fold", "value")


def summarize(values: DataFrame) -> DataFrame:
    """(candidate, params, mean, std, rank): mean over folds, population std, rank() by mean."""
    s = values.groupBy("candidate").agg(F.first("params").alias("params"), F.avg("value").alias("mean"),
                                        F.stddev_pop("value").alias("std"))
    # One row per candidate: ordering the candidates in one task is fine.
    return s.withColumn("rank", F.rank().over(Window.orderBy(F.desc("mean"))).cast("int"))


def search_report(results: DataFrame, n_top: int = 3) -> DataFrame:
    """V7: every candidate with rank 1..n_top, all ties included (can be more or fewer than n)."""
    return results.where(F.col("rank") <= n_top).orderBy("rank", "candidate")


def _refit(folded, spec, base, params, scale, features) -> mo.Fitted:
    feats = list(features or spec.features)
    sub = spec.only(feats)
    data = folded
    if scale:
        stats = scaling.fit_scaler(data, sub, scale)
        data = scaling.apply_scaler(data, sub, stats)
    return mo.fit(data, sub, base.with_params(**params), feats)


def grid_search(folded: DataFrame, spec: TableSpec, base: mo.ModelConfig, param_grid: dict[str, list],
                k: int = 5, metric: str = "f1", scale: str | None = "standard",
                features: list[str] | None = None, parallelism: int = 4) -> SearchResult:
    """V5: all combinations x folds, then the best candidate refitted on all rows."""
    return _search(folded, spec, base, grid(param_grid), k, metric, scale, features, parallelism)


def random_candidates(distributions: dict[str, list], n_iter: int, seed: int = 42) -> list[dict]:
    """n_iter combinations without repetition, the first ones in md5(seed-combination) order."""
    combos = grid(distributions)

    def key(c):
        text = f"{seed}-" + ",".join(f"{k}={c[k]}" for k in sorted(c))
        return hashlib.md5(text.encode()).hexdigest()

    return sorted(combos, key=key)[:n_iter]


def random_search(folded: DataFrame, spec: TableSpec, base: mo.ModelConfig, distributions: dict[str, list],
                  n_iter: int, k: int = 5, metric: str = "f1", seed: int = 42, scale: str | None = "standard",
                  features: list[str] | None = None, parallelism: int = 4) -> SearchResult:
    """V6: like grid search over n_iter sampled combinations (returns the result, trap T10)."""
    cands = random_candidates(distributions, n_iter, seed)
    return _search(folded, spec, base, cands, k, metric, scale, features, parallelism)


def _search(folded, spec, base, cands, k, metric, scale, features, parallelism) -> SearchResult:
    vals = evaluate_candidates(folded, spec, base, cands, k, metric, scale, features, parallelism)
    results = materialize(summarize(vals), "search")  # a row for each candidate, used twice
    top = results.orderBy(F.desc("mean"), "candidate").first()
    params = cands[top["candidate"]]
    best = _refit(folded, spec, base, params, scale, features)
    return SearchResult(best, params, float(top["mean"]), results)


def learning_curve(folded: DataFrame, spec: TableSpec, cfg: mo.ModelConfig, fractions, k: int = 5,
                   metric="f1", features: list[str] | None = None, parallelism: int = 4,
                   undersample: bool = False, scale: str | None = None, seed: int = 42) -> DataFrame:
    """V8: (size, fold, split, value): for each fold and training size, fit on the first
    ``size`` training rows (id order) and score those rows ('train') and the test fold ('test').

    The rows' places in each fold are written once, whatever the number of sizes; a training set is a
    filter on them. ``scale`` fits a scaler on the training rows and applies it to both sides;
    ``undersample`` balances the classes of the rows that the model is fitted on."""
    feats = list(features or spec.features)
    sub = spec.only(feats)
    sizes = fo.learning_sizes(folded, "fold", fractions)
    places = materialize(fo.learning_ranks(folded, spec, k), "learning")

    def one(job):
        size, i = job
        train = places.where(F.col(f"rank_{i}") <= size)
        test = places.where(F.col("fold") == i)
        if scale:
            stats = scaling.fit_scaler(train, sub, scale)
            train, test = scaling.apply_scaler(train, sub, stats), scaling.apply_scaler(test, sub, stats)
        fitted = mo.fit(resample(train, sub, "undersample", seed, feats) if undersample else train, sub, cfg, feats)
        a = mo.score_table(fitted, train).withColumn("split", F.lit("train"))
        b = mo.score_table(fitted, test).withColumn("split", F.lit("test"))
        return a.unionByName(b).withColumn("size", F.lit(size).cast("bigint")).withColumn("fold", F.lit(i))

    jobs = [(s, i) for s in sizes for i in range(k)]
    with ThreadPoolExecutor(max_workers=max(1, parallelism)) as pool:
        parts = list(pool.map(one, jobs))
    scored = parts[0]
    for p in parts[1:]:
        scored = scored.unionByName(p)
    return metrics_long(scored, ["size", "fold", "split"], spec.label, "prediction", [metric]) \
        .select("size", "fold", "split", "value")
