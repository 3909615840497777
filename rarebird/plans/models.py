"""Class-weighted models on ``pyspark.ml`` and the score table.

Parameter mapping from the reference's library (documented, not faked):
* logistic / linear SVM: liblinear minimises  |w|/2 + C * sum_i w_i loss_i ; Spark
  minimises  (1/sum w) sum_i w_i loss_i + regParam * penalty, so regParam = 1 / (C * sum w).
  Spark's LinearSVC has hinge loss and L2 only; L1 and/or squared hinge use the proximal
  gradient solver in ``sparse_svm`` (one Spark aggregate per step).
* trees: max_leaf_nodes, min_samples_split and the random splitter have no Spark
  counterpart; min_samples_leaf -> minInstancesPerNode; max_depth None -> 30 (Spark's cap).
* boosted trees: second-order histogram boosting of ``boosting``, with the parameters as that
  library defines them; scale_pos_weight -> weight column.
* RBF SVM: random Fourier features (Rahimi & Recht 2007) + LinearSVC + Platt scaling on
  out-of-fold margins.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field, replace

import numpy as np
from pyspark.ml.classification import (
    DecisionTreeClassifier,
    LinearSVC,
    LogisticRegression,
    RandomForestClassifier,
)
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rarebird.functions import hash_int
from rarebird.operators.profile import assemble, class_weights
from rarebird.session import scratch_dir
from rarebird.spec import TableSpec

MAX_DEPTH_NONE = 30
#: Rows in one task's share of a training table.
ROWS = 1 << 18
# Parameters that each family takes; any other raises.
SUPPORTED = {
    "logistic": {"C", "penalty", "max_iter", "tol"},
    "linear_svm": {"C", "penalty", "loss", "max_iter", "tol"},
    "rbf_svm": {"C", "gamma", "n_components", "max_iter", "tol", "calibration_folds"},
    "decision_tree": {"criterion", "max_depth", "min_samples_leaf"},
    "random_forest": {"n_estimators", "criterion", "max_depth", "bootstrap", "max_features", "min_samples_leaf"},
    "boosted_trees": {"n_estimators", "learning_rate", "max_depth", "min_child_weight", "colsample_bytree", "gamma", "reg_lambda", "max_bins"},
}


@dataclass
class ModelConfig:
    """A model family with the reference's parameter names; ``weights`` is
    'balanced', 'positive' (fixed weight ``positive_weight`` for label 1) or None.

    Kind ``estimator`` is any ``pyspark.ml`` Estimator of the user's, in ``estimator``: it is
    given a vector column ``features``, the label and, where it has the parameter and weights are
    asked for, a weight column; ``params`` are its own. Its model must add ``prediction``;
    the score is its probability or raw prediction of class 1 where it has one."""

    kind: str
    params: dict = field(default_factory=dict)
    weights: str | None = "balanced"
    positive_weight: float = 2.0
    seed: int = 42
    estimator: object = None

    def with_params(self, **kw) -> "ModelConfig":
        return replace(self, params={**self.params, **kw})

    @property
    def name(self) -> str:
        inner = ",".join(f"{k}={v}" for k, v in sorted(self.params.items()))
        return f"{self.kind}({inner})"


# The reference's untuned ("dirty") and tuned models, natural-persons script (fixed values).
# Trees: the leaf limit, the least rows to split and the random splitter have no counterpart.
LOGISTIC = ModelConfig("logistic", {"C": 1.0, "penalty": "l2", "max_iter": 1000})
BEST_LOGISTIC = ModelConfig("logistic", {"C": 100.0, "penalty": "l1", "max_iter": 1000})
LINEAR_SVM = ModelConfig("linear_svm", {"C": 1.0, "penalty": "l2", "loss": "squared_hinge", "max_iter": 1000})
BEST_LINEAR_SVM = ModelConfig("linear_svm", {"C": 0.1, "penalty": "l1", "loss": "squared_hinge", "max_iter": 1000})
RBF_SVM = ModelConfig("rbf_svm", {"C": 1.0, "gamma": "scale"})
BEST_RBF_SVM = ModelConfig("rbf_svm", {"C": 1.0, "gamma": 0.1})
TREE = ModelConfig("decision_tree", {"criterion": "gini"})
BEST_TREE = ModelConfig("decision_tree", {"criterion": "gini", "max_depth": 10, "min_samples_leaf": 4})
FOREST = ModelConfig("random_forest", {"n_estimators": 100})
BEST_FOREST = ModelConfig("random_forest", {"n_estimators": 500, "criterion": "entropy", "max_depth": 14,
                                            "bootstrap": True, "max_features": "sqrt"})
BOOSTED = ModelConfig("boosted_trees", {"n_estimators": 100}, weights="positive")
BEST_BOOSTED = ModelConfig("boosted_trees", {"learning_rate": 0.1, "max_depth": 4, "n_estimators": 100,
                                             "min_child_weight": 10, "gamma": 1.0, "colsample_bytree": 0.4},
                           weights="positive")

# The tuned models of the legal-entities script (fixed values); the other two are as above.
ENTITY_LOGISTIC = ModelConfig("logistic", {"C": 100.0, "penalty": "l2", "max_iter": 1000})
ENTITY_LINEAR_SVM = BEST_LINEAR_SVM
ENTITY_RBF_SVM = ModelConfig("rbf_svm", {"C": 1.0, "gamma": "scale"})
ENTITY_TREE = ModelConfig("decision_tree", {"criterion": "gini", "max_depth": 14, "min_samples_leaf": 4})
ENTITY_FOREST = ModelConfig("random_forest", {"n_estimators": 200, "criterion": "entropy", "max_depth": 10,
                                              "bootstrap": False, "max_features": "sqrt"})
ENTITY_BOOSTED = BEST_BOOSTED

# The search grids of both scripts (fixed values) over the parameters that the models here take.
GRIDS = {
    "logistic": {"penalty": ["l1", "l2"], "C": [0.001, 0.01, 0.1, 1, 10, 100, 1000]},
    "linear_svm": {"penalty": ["l1", "l2"], "C": [0.001, 0.01, 0.1, 1, 10, 100, 1000], "loss": ["hinge", "squared_hinge"]},
    "rbf_svm": {"C": [0.001, 0.01, 0.1, 1, 10, 100], "gamma": [0.001, 0.01, 0.1, 1, "scale"]},
    "decision_tree": {"criterion": ["gini", "entropy"], "min_samples_leaf": [1, 2, 4], "max_depth": [2, 10, 14, None]},
    "random_forest": {"n_estimators": [100, 200, 500], "max_features": ["auto", "sqrt", "log2"], "max_depth": [2, 4, 10, 14, None],
                      "criterion": ["gini", "entropy"], "bootstrap": [True, False]},
    "boosted_trees": {"learning_rate": [0.1, 0.2, 0.3], "max_depth": [2, 4, 6, 10, 12, 15], "min_child_weight": [1, 4, 10],
                      "gamma": [0.0, 0.1, 0.3, 0.5, 0.7, 1.0], "colsample_bytree": [0.3, 0.4, 0.7, 1.0]},
}


@dataclass
class Fitted:
    """A fitted model with the column order it was trained on."""

    config: ModelConfig
    spec: TableSpec
    features: list[str]
    model: object
    extra: dict = field(default_factory=dict)

    def transform(self, df: DataFrame) -> DataFrame:
        data = assemble(df, self.spec, self.features)
        if self.config.kind == "rbf_svm":
            return _rbf_transform(self, data)
        return self.model.transform(data)


def _estimator(cfg: ModelConfig, label: str, weight_col: str | None, total_weight: float):
    p = cfg.params
    common = {"featuresCol": "features", "labelCol": label}
    if weight_col:
        common["weightCol"] = weight_col
    if cfg.kind == "logistic":
        pen = p.get("penalty", "l2")
        return LogisticRegression(
            **common, maxIter=int(p.get("max_iter", 100)), regParam=1.0 / (float(p.get("C", 1.0)) * total_weight),
            elasticNetParam=1.0 if pen == "l1" else 0.0, standardization=False, tol=float(p.get("tol", 1e-4)))
    if cfg.kind in ("linear_svm", "rbf_svm"):
        return LinearSVC(**common, maxIter=int(p.get("max_iter", 100)),
                         regParam=1.0 / (float(p.get("C", 1.0)) * total_weight), standardization=False,
                         tol=float(p.get("tol", 1e-4)))
    depth = p.get("max_depth")
    depth = MAX_DEPTH_NONE if depth is None else int(depth)
    # Deep trees: cache node ids (checkpointed every 10 levels into the shared folder) and
    # give each pass a larger node budget, so fewer passes over the data are needed.
    trees = {"cacheNodeIds": True, "checkpointInterval": 10, "maxMemoryInMB": 1024}
    if cfg.kind == "decision_tree":
        return DecisionTreeClassifier(**common, **trees, impurity=p.get("criterion", "gini"), maxDepth=depth,
                                      minInstancesPerNode=int(p.get("min_samples_leaf", 1)), seed=cfg.seed)
    if cfg.kind == "random_forest":
        mf = p.get("max_features", "sqrt")
        return RandomForestClassifier(
            **common, **trees, numTrees=int(p.get("n_estimators", 100)), impurity=p.get("criterion", "gini"),
            maxDepth=depth, featureSubsetStrategy={"auto": "sqrt"}.get(mf, mf),
            bootstrap=bool(p.get("bootstrap", True)), minInstancesPerNode=int(p.get("min_samples_leaf", 1)),
            seed=cfg.seed)
    if cfg.kind == "estimator":
        given = {**cfg.params, **{k: v for k, v in common.items() if cfg.estimator.hasParam(k)}}
        return cfg.estimator.copy({cfg.estimator.getParam(k): v for k, v in given.items()})
    raise ValueError(cfg.kind)


BASELINES = ("most_frequent", "stratified", "uniform")


def check(cfg: ModelConfig) -> None:
    """Raise where a family does not take a parameter, or not that value."""
    unknown = set(cfg.params) - SUPPORTED.get(cfg.kind, set(cfg.params))
    if unknown:
        raise ValueError(f"{cfg.kind} does not take {sorted(unknown)}; it takes {sorted(SUPPORTED[cfg.kind])}")
    penalty, loss = cfg.params.get("penalty", "l2"), cfg.params.get("loss", "squared_hinge")
    if cfg.kind == "linear_svm" and (penalty not in ("l1", "l2") or loss not in ("hinge", "squared_hinge") or (penalty, loss) == ("l1", "hinge")):
        raise ValueError(f"linear_svm: no penalty {penalty} with loss {loss}")
    if cfg.kind == "logistic" and penalty not in ("l1", "l2"):
        raise ValueError(f"logistic: no penalty {penalty}")


def spread(vec: DataFrame, id_col: str, rows: int) -> DataFrame:
    """``vec`` in partitions of some ``ROWS`` rows: each pass of a fit reads a partition in one task, and AQE
    sizes the partitions of a join before it by their compressed bytes. Smaller tables stay as they are."""
    parts = -(-rows // ROWS)
    return vec.repartition(parts, id_col) if parts > 1 else vec


def dealt(df: DataFrame, rows: int) -> DataFrame:
    """``df`` in equal shares of ``ROWS`` rows at most for all cores: a pass costs much time for each of its few bytes."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores * max(1, -(-rows // (ROWS * cores))))


def fit(train: DataFrame, spec: TableSpec, cfg: ModelConfig, features: list[str] | None = None) -> Fitted:
    """Fit one model on ``train`` (features default to the spec's, in scaled-table order)."""
    feats = list(features or spec.features)
    check(cfg)
    scratch_dir(train.sparkSession)  # tree checkpoints and iterative jobs use the shared folder
    if cfg.kind in BASELINES:
        from rarebird.plans import baselines

        return Fitted(cfg, spec, feats, None, baselines.fit(train, spec, cfg.kind, cfg.params))
    weight_col = None
    data = train
    if cfg.weights:
        data = class_weights(train, spec, cfg.weights, cfg.positive_weight, "weight")
        weight_col = "weight"
    keep = [weight_col] if weight_col else []
    vec = assemble(data, spec, feats, keep=keep)
    if cfg.kind == "estimator":  # reads the rows as they lie: counting and dealing them out would make and move them once more each
        return Fitted(cfg, spec, feats, _estimator(cfg, spec.label, weight_col, 0.0).fit(vec))
    sums = vec.agg(F.sum(weight_col) if weight_col else F.count(F.lit(1)), F.count(F.lit(1))).first()
    total = float(sums[0] or 1.0)
    if cfg.kind == "random_forest":
        from rarebird.plans.forest import fit_grouped

        model = fit_grouped(vec, spec.label, weight_col, len(feats), sums[1], _estimator(cfg, spec.label, weight_col, total))
        if model is not None:
            return Fitted(cfg, spec, feats, model)
    vec = spread(vec, spec.id, sums[1])
    penalty, loss = cfg.params.get("penalty", "l2"), cfg.params.get("loss", "squared_hinge")
    if cfg.kind == "linear_svm" and loss == "squared_hinge":
        from rarebird.plans.sparse_svm import fit_sparse_svm

        model = fit_sparse_svm(vec, spec.label, weight_col, len(feats), float(cfg.params.get("C", 1.0)),
                               int(cfg.params.get("max_iter", 1000)), float(cfg.params.get("tol", 1e-4)), penalty)
        return Fitted(cfg, spec, feats, model)
    if cfg.kind == "boosted_trees":
        from rarebird.plans.boosting import fit_boosted_trees

        return Fitted(cfg, spec, feats, fit_boosted_trees(vec, spec.label, weight_col, len(feats), seed=cfg.seed, **cfg.params))
    if cfg.kind == "rbf_svm":
        vec = vec.persist()  # read twice (variance, features)
        try:
            return _rbf_fit(cfg, spec, feats, vec, weight_col, total)
        finally:
            vec.unpersist()
    # pyspark.ml persists its own internal form (instance blocks / tree points) when the
    # input is not persisted; persisting here would make it rebuild that every iteration.
    model = _estimator(cfg, spec.label, weight_col, total).fit(vec)
    return Fitted(cfg, spec, feats, model)


def score_table(fitted: Fitted, test: DataFrame) -> DataFrame:
    """(id, label, prediction, score) with score = P(label 1), or the margin for
    models without probabilities (linear SVM). The one input of every metric."""
    spec = fitted.spec
    if fitted.config.kind in BASELINES:
        from rarebird.plans import baselines

        return baselines.predict(test, spec, fitted.config.kind, fitted.extra, fitted.config.params,
                                 fitted.config.seed)
    out = fitted.transform(test)
    if "probability" in out.columns:
        score = vector_to_array("probability")[1]
    elif "rawPrediction" in out.columns:
        score = vector_to_array("rawPrediction")[1]
    else:
        score = F.col("prediction").cast("double")
    return out.select(spec.id, F.col(spec.label).cast("int").alias(spec.label),
                      F.col("prediction").cast("int").alias("prediction"), score.alias("score"))


def feature_importance(fitted: Fitted) -> DataFrame:
    """(column, importance) by descending importance; |coefficient| for linear models."""
    m = fitted.model
    if hasattr(m, "featureImportances"):
        vals = m.featureImportances.toArray().tolist()
    elif hasattr(m, "coefficients"):
        vals = [abs(x) for x in np.array(m.coefficients).tolist()]
    else:
        raise ValueError(f"{fitted.config.kind} has no importances")
    spark = _spark()
    rows = [(c, float(v)) for c, v in zip(fitted.features, vals)]  # one row per feature
    return spark.createDataFrame(rows, "column string, importance double").orderBy(F.desc("importance"), "column")


def coefficients(fitted: Fitted) -> DataFrame:
    """(column, coef) of a linear model."""
    vals = np.array(fitted.model.coefficients).tolist()
    return _spark().createDataFrame([(c, float(v)) for c, v in zip(fitted.features, vals)],
                                    "column string, coef double")


def _spark():
    from pyspark.sql import SparkSession

    return SparkSession.getActiveSession()


# ---------------------------------------------------------------- RBF SVM (M3)

def _rbf_features(data: DataFrame, W, b, d) -> DataFrame:
    """z(x) = sqrt(2/D) cos(W x + b), computed per Arrow batch with numpy."""
    import pandas as pd
    from pyspark.ml.functions import array_to_vector
    from pyspark.sql.functions import PandasUDFType, pandas_udf

    Wt = np.ascontiguousarray(W.T)
    scale = math.sqrt(2.0 / W.shape[0])

    def rff(x):
        X = np.stack(x.to_numpy()) if len(x) else np.zeros((0, d))
        return pd.Series(list(np.cos(X @ Wt + b) * scale))

    udf = pandas_udf(rff, "array<double>", PandasUDFType.SCALAR)
    return data.withColumn("features", array_to_vector(udf(vector_to_array("features"))))


def _rbf_fit(cfg, spec, feats, vec, weight_col, total) -> Fitted:
    d = len(feats)
    n_comp = int(cfg.params.get("n_components", 100))
    gamma = cfg.params.get("gamma", "scale")
    if gamma == "scale":
        # 1 / (d * Var(X)) over all feature values (population variance).
        arr = vector_to_array("features")
        st = vec.select(F.explode(arr).alias("v")).agg(F.var_pop("v")).first()[0] or 1.0
        gamma = 1.0 / (d * st) if st > 0 else 1.0
    rng = np.random.default_rng(cfg.seed)
    W = rng.normal(0.0, math.sqrt(2.0 * float(gamma)), size=(n_comp, d))
    b = rng.uniform(0.0, 2 * math.pi, size=n_comp)
    z = _rbf_features(vec, W, b, d).persist()
    try:
        est = _estimator(cfg, spec.label, weight_col, total)
        svm = est.fit(z)
        platt = LogisticRegression(featuresCol="features", labelCol=spec.label, regParam=0.0, **({"weightCol": weight_col} if weight_col else {}))
        model = platt.fit(out_of_fold_margins(z, spec, est, int(cfg.params.get("calibration_folds", 3)), cfg.seed, [weight_col] if weight_col else []))
    finally:
        z.unpersist()
    return Fitted(cfg, spec, feats, svm, {"W": W, "b": b, "platt": model, "gamma": float(gamma)})


def out_of_fold_margins(data: DataFrame, spec: TableSpec, est, folds: int, seed: int, keep: list[str]) -> DataFrame:
    """(id, features = [margin], label, *keep): each row's margin from a model that was fitted without it; folds by
    md5(seed-id). Platt scaling on margins of the training rows themselves would be too sure."""
    from pyspark.ml.feature import VectorAssembler

    placed = data.withColumn("_fold", (hash_int(seed, spec.id, "platt") % folds).cast("int"))
    out = None
    for i in range(folds):
        model = est.fit(placed.where(F.col("_fold") != i))
        part = model.transform(placed.where(F.col("_fold") == i)).select(spec.id, vector_to_array("rawPrediction")[1].alias("_m"), spec.label, *keep)
        out = part if out is None else out.unionByName(part)
    return VectorAssembler(inputCols=["_m"], outputCol="features").transform(out)


def _rbf_transform(fitted: Fitted, data: DataFrame) -> DataFrame:
    from pyspark.ml.feature import VectorAssembler

    W, b = fitted.extra["W"], fitted.extra["b"]
    z = _rbf_features(data, W, b, len(fitted.features))
    s = fitted.model.transform(z).withColumnRenamed("prediction", "svm_prediction")
    s = s.withColumn("m", vector_to_array("rawPrediction")[1]).drop("features", "rawPrediction")
    mv = VectorAssembler(inputCols=["m"], outputCol="features").transform(s)
    out = fitted.extra["platt"].transform(mv)
    # The hard prediction stays the SVM's (sign of the margin); probability comes from Platt.
    return out.drop("prediction").withColumnRenamed("svm_prediction", "prediction")
