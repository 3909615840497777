"""S3 for every model family: a fitted model with its columns, parameters and parts, in and out of storage.

Layout under the path: ``about`` (one JSON line: configuration, table roles, feature order and the
numbers a family keeps beside its model) and one folder for each ``pyspark.ml`` model, written by
its own writer. Loading needs nothing but the path.
"""

from __future__ import annotations

import json

import numpy as np
from pyspark.ml.util import MLWritable
from pyspark.sql import SparkSession

from rarebird.plans.models import Fitted, ModelConfig
from rarebird.sources.tables import load_model, save_model
from rarebird.spec import TableSpec


def save_fitted(fitted: Fitted, path: str) -> str:
    """Write a fitted model of any family; an estimator of the user's needs a model with an ML writer."""
    spark = SparkSession.getActiveSession()
    models = {k: v for k, v in {"model": fitted.model, **fitted.extra}.items() if hasattr(v, "transform")}
    for name, model in models.items():
        if not isinstance(model, MLWritable):
            raise TypeError(f"{type(model).__name__} has no ML writer")
        save_model(model, f"{path}/{name}")
    cfg, spec = fitted.config, fitted.spec
    extra = {k: {"array": v.tolist()} if isinstance(v, np.ndarray) else v for k, v in fitted.extra.items() if k not in models}
    about = {"kind": cfg.kind, "params": cfg.params, "weights": cfg.weights, "positive_weight": cfg.positive_weight, "seed": cfg.seed,
             "spec": {"id": spec.id, "label": spec.label, "numerics": spec.numerics, "flags": spec.flags},
             "features": fitted.features, "models": sorted(models), "extra": extra}
    spark.createDataFrame([(json.dumps(about),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/about")
    return path


def load_fitted(spark: SparkSession, path: str) -> Fitted:
    """What :func:`save_fitted` wrote, ready to score. A user's estimator itself is not kept, its model is."""
    about = json.loads(spark.read.text(f"{path}/about").first()[0])
    models = {name: load_model(f"{path}/{name}") for name in about["models"]}
    spec = TableSpec(about["spec"]["id"], about["spec"]["label"], tuple(about["spec"]["numerics"]), tuple(about["spec"]["flags"]))
    cfg = ModelConfig(about["kind"], about["params"], about["weights"], about["positive_weight"], about["seed"])
    extra = {k: np.array(v["array"]) if isinstance(v, dict) and set(v) == {"array"} else v for k, v in about["extra"].items()}
    return Fitted(cfg, spec, about["features"], models.pop("model", None), {**extra, **models})
