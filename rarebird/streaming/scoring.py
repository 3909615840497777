"""Score a stream with a fitted model and keep running confusion counts.

``score_stream`` is M10 on a streaming DataFrame (``pyspark.ml`` transforms are
stateless per row). ``confusion_stream`` is E1 as a stateful streaming aggregation
(one state row per group and cell); ``metrics_from_counts`` turns a snapshot of those
counts into E3's metrics.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from rarebird.operators.metrics import cell_counts, wide_of_counts


def score_stream(fitted, stream: DataFrame) -> DataFrame:
    from rarebird.plans.models import score_table

    return score_table(fitted, stream)


def confusion_stream(scored: DataFrame, group=(), label: str = "label", prediction: str = "prediction") -> DataFrame:
    """Running (group..., tp, fp, tn, fn); use output mode 'update' or 'complete'."""
    return cell_counts(scored, group, label, prediction)


def metrics_from_counts(counts: DataFrame, group=()) -> DataFrame:
    return wide_of_counts(counts, group)
