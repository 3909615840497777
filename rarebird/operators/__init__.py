"""DataFrame -> DataFrame operators: profiling, scaling, ranking, folds, sampling,
neighbours, metrics, curves and distribution summaries."""
