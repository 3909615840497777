"""Connected components by alternating large-star and small-star rounds (Kiveris et al., 2014).

Only edges move: every round joins them to one minimum per vertex, so a vertex with many
edges is aggregated in the map tasks and its join is one that adaptive execution may
split. Rounds are written to the shared folder; a lost executor costs one round. A batch of
edges becomes a spanning forest of itself before the first round, and rounds end when the
edges are stars.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rarebird.llm.tables import materialize


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    # every edge has v < u
    low = edges.groupBy("u").agg(F.min("v").alias("m"))
    joined = edges.join(low, "u")
    return (joined.select(F.col("v").alias("u"), F.col("m").alias("v"))
            .union(low.select("u", F.col("m").alias("v"))).where("u != v").distinct())


def forest(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(vertex, the smallest one that the edges (u, v) join it to), for each that isn't that itself."""
    ids, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    u, v = at[:len(u)], at[len(u):]
    low = np.arange(len(ids))
    while True:
        x, y = low[u], low[v]
        if (x == y).all():
            break
        np.minimum.at(low, np.maximum(x, y), np.minimum(x, y))
        while (low[low] != low).any():
            low = low[low]
    joined = np.flatnonzero(low != np.arange(len(ids)))
    return ids[joined], ids[low[joined]]


def _forests(batches):
    """Each batch's edges (u, v) -> each vertex with the smallest one that the batch's edges reach."""
    import pyarrow as pa

    for b in batches:
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in forest(*[np.asarray(b.column(c)) for c in ("u", "v")])], names=["u", "v"])


def _stars(edges: DataFrame) -> bool:
    """Whether each vertex has one edge to a smaller one, or edges to larger ones only."""
    ends = (edges.select(F.col("u").alias("id"), F.lit(1).alias("up"), F.lit(0).alias("down"))
            .union(edges.select("v", F.lit(0), F.lit(1))).groupBy("id").agg(F.sum("up").alias("up"), F.max("down").alias("down")))
    return ends.agg(F.count(F.when((F.col("up") > 1) | ((F.col("up") > 0) & (F.col("down") > 0)), 1))).first()[0] == 0


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(id, component): each vertex of an edge with the smallest id that it reaches.

    Edges with a null end and loops are left out; repeated edges count once; without
    edges the result is empty.
    """
    ends = edges.select(F.greatest(a, b).cast("long").alias("u"), F.least(a, b).cast("long").alias("v"))
    ends = ends.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
    now = materialize(ends.mapInArrow(_forests, "u long, v long").distinct(), "edges")
    while not _stars(now):
        now = materialize(_small_star(_large_star(now)), "edges")
    stars = now.select(F.col("u").alias("id"), F.col("v").alias("component"))
    return stars.union(now.select(F.col("v"), F.col("v")).distinct())
