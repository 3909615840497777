"""Structured Streaming forms of the scoring and confusion-count operators.

The reference has no streams; these are the same operators (M10 score table, E1/E3
counts and metrics) applied to an unbounded input, for users who score arriving rows.
"""

from rarebird.streaming.scoring import confusion_stream, metrics_from_counts, score_stream  # noqa: F401
