"""M2 second phase: squared-hinge linear SVM, L1 or L2 penalty.

Objective (the reference library's primal, bias penalised like a feature of value 1):
    min_beta  penalty(beta) + C * sum_i w_i * max(0, 1 - s_i (beta . x_i + b))^2 ,  s_i = +-1
with penalty |beta|_1 or |beta|^2 / 2, solved by :mod:`rarebird.plans.linear`: one Spark job a
Newton step, some ten in all, each with the same plan.
"""

from __future__ import annotations

import numpy as np
from pyspark.ml import Model
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasFeaturesCol
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rarebird.plans.linear import Linear, fit_linear


class SparseSVMModel(HasFeaturesCol, Model, DefaultParamsReadable, DefaultParamsWritable):
    """Coefficients and intercept; ``iterations`` is the number of Spark jobs that the fit took."""

    weights = Param(Params._dummy(), "weights", "coefficients", TypeConverters.toListFloat)
    bias = Param(Params._dummy(), "bias", "intercept", TypeConverters.toFloat)
    steps = Param(Params._dummy(), "steps", "Spark jobs of the fit", TypeConverters.toInt)

    @classmethod
    def of(cls, coefficients: np.ndarray, intercept: float, iterations: int) -> SparseSVMModel:
        return cls()._set(weights=[float(c) for c in coefficients], bias=float(intercept), steps=int(iterations))

    @property
    def coefficients(self) -> np.ndarray:
        return np.array(self.getOrDefault("weights"))

    @property
    def intercept(self) -> float:
        return self.getOrDefault("bias")

    @property
    def iterations(self) -> int:
        return self.getOrDefault("steps")

    def _transform(self, df: DataFrame) -> DataFrame:
        x, m = vector_to_array(self.getFeaturesCol()), F.lit(self.intercept)
        for j, c in enumerate(self.getOrDefault("weights")):
            if c != 0.0:
                m = m + x[j] * F.lit(c)
        return df.withColumn("_m", m).withColumn(
            "rawPrediction", array_to_vector(F.array(-F.col("_m"), F.col("_m")))
        ).withColumn("prediction", (F.col("_m") > 0).cast("double")).drop("_m")


def fit_sparse_svm(vec: DataFrame, label: str, weight_col: str | None, d: int, C: float,
                   max_iter: int = 1000, tol: float = 1e-4, penalty: str = "l1") -> SparseSVMModel:
    w = F.col(weight_col).cast("double") if weight_col else F.lit(1.0)
    rows = vec.select(vector_to_array("features").alias("x"), F.col(label).cast("int").alias("y"), w.alias("w"), F.lit(-1).alias("fold")).persist()
    try:
        fit = Linear("squared_hinge", penalty, C, penalise_intercept=True)
        # steps converge quadratically at the end, so a tighter bound costs a step or two
        solved = fit_linear(rows, d, [fit], max_iter=max_iter, tol=min(tol, 1e-7))
        return SparseSVMModel.of(solved.coefficients[0], solved.intercepts[0], solved.jobs)
    finally:
        rows.unpersist()
