"""Feature selection and feature-set comparisons.

The threshold rule (L4) is an aggregate over an importance table:
keep importance >= mean / median / constant. Model-based selectors feed it
the model's importances (|coefficient| for linear models).
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rarebird.operators.curves import curve_comparison
from rarebird.operators.ranking import exact_quantiles
from rarebird.plans import models as mo
from rarebird.plans.validation import cross_validate
from rarebird.spec import TableSpec


def threshold_select(importances: DataFrame, rule="mean", column: str = "column",
                     value: str = "importance") -> DataFrame:
    """L4: (column, importance, threshold, kept) with kept = importance >= threshold;
    ``rule`` is 'mean', 'median' (linear-interpolated) or a number."""
    if rule == "mean":
        thr = importances.agg(F.avg(value)).first()[0]
    elif rule == "median":
        thr = exact_quantiles(importances, [value], [0.5]).first()["value"]
    else:
        thr = float(rule)
    return importances.select(column, value, F.lit(thr).alias("threshold"),
                              (F.col(value) >= F.lit(thr)).alias("kept"))


def select_l1(train: DataFrame, spec: TableSpec, C: float = 1.0, threshold: float = 1e-5) -> DataFrame:
    """L1: unweighted L1 logistic regression; keep |coef| >= threshold. (column, coef, importance, threshold, kept)."""
    fitted = mo.fit(train, spec, mo.ModelConfig("logistic", {"C": C, "penalty": "l1", "max_iter": 1000}, weights=None))
    coefs = mo.coefficients(fitted).withColumn("importance", F.abs("coef"))
    sel = threshold_select(coefs.select("column", "importance"), threshold)
    return coefs.join(sel.drop("importance"), "column")


def select_forest(train: DataFrame, spec: TableSpec, n_estimators: int = 500, seed: int = 42, **params) -> DataFrame:
    """L2: unweighted random forest, with the family's other ``params``; keep importance >= mean importance."""
    cfg = mo.ModelConfig("random_forest", {"n_estimators": n_estimators, **params}, weights=None, seed=seed)
    return threshold_select(mo.feature_importance(mo.fit(train, spec, cfg)), "mean")


def select_by_model(train: DataFrame, spec: TableSpec, cfg: mo.ModelConfig, rule="median") -> DataFrame:
    """L3: any model with importances; keep importance >= median."""
    return threshold_select(mo.feature_importance(mo.fit(train, spec, cfg)), rule)


def kept_columns(selection: DataFrame) -> list[str]:
    return [r["column"] for r in selection.where("kept").select("column").collect()]


def drop_one_cv(folded: DataFrame, spec: TableSpec, cfgs: dict[str, mo.ModelConfig], k: int = 3,
                metric: str = "f1", drop: int = 1, **kw) -> DataFrame:
    """Per model, CV with all features ('none' removed) and without every single
    feature (``drop=1``) or every pair (``drop=2``): (model, removed, fold, metric, value)."""
    feats = spec.features
    sets = [("none", feats)]
    for n in range(1, drop + 1):
        for gone in combinations(feats, n):
            sets.append(("+".join(gone), [c for c in feats if c not in gone]))
    parts = []
    for name, cfg in cfgs.items():
        for removed, cols in sets:
            cv = cross_validate(folded, spec, cfg, k, (metric,), features=cols, model=name, **kw)
            parts.append(cv.withColumn("removed", F.lit(removed)))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.select("model", "removed", "fold", "metric", "value")


def variant_comparison(train: DataFrame, test: DataFrame, spec: TableSpec, cfgs: dict[str, mo.ModelConfig],
                       variants: dict[str, list[str]]) -> DataFrame:
    """PR and ROC curves with AP / AUC for every (model, feature set)."""
    scored = None
    for vname, cols in variants.items():
        for mname, cfg in cfgs.items():
            s = mo.score_table(mo.fit(train, spec.only(cols), cfg, cols), test)
            s = s.withColumn("model", F.lit(mname)).withColumn("variant", F.lit(vname))
            scored = s if scored is None else scored.unionByName(s)
    return curve_comparison(scored.withColumnRenamed(spec.label, "label"), ["model", "variant"])
