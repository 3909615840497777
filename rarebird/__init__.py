"""rarebird: imbalanced binary classification analytics on Spark DataFrames.

Every operator takes and returns DataFrames. Data preparation, sampling, folds,
metrics and curves are ordinary Spark jobs; model fitting uses ``pyspark.ml``.
"""

from rarebird.spec import TableSpec  # noqa: F401

__all__ = ["TableSpec"]
