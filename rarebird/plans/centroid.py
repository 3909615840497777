"""A classifier by the nearer class mean: an Estimator from outside the model families, with a closed form."""

from __future__ import annotations

from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasFeaturesCol, HasLabelCol, HasPredictionCol, HasRawPredictionCol
from pyspark.ml.stat import Summarizer
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class _CentroidParams(HasFeaturesCol, HasLabelCol, HasPredictionCol, HasRawPredictionCol):
    threshold = Param(Params._dummy(), "threshold", "class 1 where the margin exceeds it", TypeConverters.toFloat)
    mean0 = Param(Params._dummy(), "mean0", "mean of class 0", TypeConverters.toListFloat)
    mean1 = Param(Params._dummy(), "mean1", "mean of class 1", TypeConverters.toListFloat)


class NearestCentroid(_CentroidParams, Estimator, DefaultParamsReadable, DefaultParamsWritable):
    """Fits the two class means in one aggregate; the margin is (m1 - m0) . (x - (m0 + m1) / 2)."""

    @keyword_only
    def __init__(self, threshold: float = 0.0):
        super().__init__()
        self._setDefault(threshold=0.0)
        self._set(**self._input_kwargs)

    def _fit(self, df: DataFrame) -> Model:
        rows = df.groupBy(self.getLabelCol()).agg(Summarizer.mean(F.col(self.getFeaturesCol())).alias("m")).collect()  # a row for each class
        mean = {int(r[0]): r.m.toArray().tolist() for r in rows}
        if set(mean) != {0, 1}:
            raise ValueError(f"expected the classes 0 and 1, got {sorted(mean)}")
        return self._copyValues(NearestCentroidModel())._set(mean0=mean[0], mean1=mean[1])


class NearestCentroidModel(_CentroidParams, Model, DefaultParamsReadable, DefaultParamsWritable):
    def __init__(self):
        super().__init__()
        self._setDefault(threshold=0.0)

    def _transform(self, df: DataFrame) -> DataFrame:
        x, margin = vector_to_array(self.getFeaturesCol()), F.lit(0.0)
        for j, (a, b) in enumerate(zip(self.getOrDefault("mean0"), self.getOrDefault("mean1"), strict=True)):
            margin = margin + F.lit(b - a) * (x[j] - F.lit((a + b) / 2))
        margin = margin - F.lit(self.getOrDefault("threshold"))
        return (df.withColumn(self.getRawPredictionCol(), array_to_vector(F.array(-margin, margin)))
                .withColumn(self.getPredictionCol(), (margin > 0).cast("double")))
