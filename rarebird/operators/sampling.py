"""P2, P7 (and P4/P5 in neighbors-based sampling): class rebalancing with md5-driven randomness.

Every random choice is a function of (seed, id): reruns, retried tasks and the
SQL oracle all pick the same rows.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rarebird.functions import hash_int, required
from rarebird.operators.ranking import ranked
from rarebird.operators.selecting import among_smallest
from rarebird.session import materialize, passing
from rarebird.spec import TableSpec


def class_sizes(df: DataFrame, spec: TableSpec) -> dict[int, int]:
    """{label: rows}; a two-row aggregate. A null label raises."""
    return {r[0]: r[1] for r in df.groupBy(required(spec.label, spec.label).alias("label")).count().collect()}


def minority_majority(df: DataFrame, spec: TableSpec) -> tuple[int, int, int, int]:
    """(minority label, its rows, majority label, its rows); ties make label 1 the minority."""
    sizes = class_sizes(df, spec)
    if len(sizes) != 2:
        raise ValueError(f"expected two classes, got {sorted(sizes)}")
    (a, na), (b, nb) = sorted(sizes.items(), key=lambda kv: (kv[1], -kv[0]))
    return a, na, b, nb


def undersample(df: DataFrame, spec: TableSpec, seed: int = 42) -> DataFrame:
    """All minority rows plus as many majority rows, chosen without replacement.

    The kept majority rows are those with the smallest (md5(seed-id), id), found by radix
    selection: a few counts over (id, hash), then one filter. Nothing is sorted, and only
    ids are written. Ids must be whole numbers.
    """
    lo, n_lo, hi, _ = minority_majority(df, spec)
    keys = materialize(df.where(F.col(spec.label) == hi).select(F.col(spec.id).cast("bigint").alias("id"), hash_int(seed, spec.id).alias("key")), "undersample")
    first = among_smallest(keys, n_lo, 32)
    return df.where((F.col(spec.label) == lo) | ((F.col(spec.label) == hi) & first(hash_int(seed, spec.id), F.col(spec.id).cast("bigint"))))


def _md5_int(text: str) -> int:
    return int(hashlib.md5(text.encode()).hexdigest()[:8], 16)


def random_feature_subset(features: list[str], seed: int = 42, max_drop: int = 10) -> tuple[list[str], list[str]]:
    """(kept, dropped). Drops m = 1 + md5(seed-m) mod min(max_drop, n-1) features, those
    first in md5(seed-name) order, so at least one feature always remains."""
    n = len(features)
    if n < 2:
        raise ValueError("need at least two features")
    m = 1 + _md5_int(f"{seed}-m") % min(max_drop, n - 1)
    order = sorted(features, key=lambda c: (_md5_int(f"{seed}-{c}"), c))
    dropped = set(order[:m])
    return [c for c in features if c not in dropped], [c for c in order[:m]]


def random_feature_selection(df: DataFrame, spec: TableSpec, seed: int = 42, max_drop: int = 10) -> DataFrame:
    """P7 on a table: id, the kept features, label."""
    kept, _ = random_feature_subset(spec.features, seed, max_drop)
    return df.select(spec.id, *kept, spec.label)


# ---------------------------------------------------------------- neighbour-based rebalancing

def smote(df: DataFrame, spec: TableSpec, k: int = 5, seed: int = 42, features: list[str] | None = None,
          round_flags: bool = False) -> DataFrame:
    """Add synthetic minority rows until both classes have the same size.

    Synthetic row g (0 .. n_major - n_minor - 1) takes minority row r and its neighbour
    m from one md5 draw (uniform over the n_minor * k (row, neighbour) pairs) and a gap
    u = md5 uniform in [0, 1): x = a + u (b - a) for every feature, flags included
    unless ``round_flags`` (trap T15). Synthetic ids are -(g + 1).
    Output: (id, features..., label). A null feature of a minority row or a null label raises.
    """
    from rarebird.operators.neighbors import knn

    spark = df.sparkSession
    feats = list(features or spec.features)
    lo, n_lo, hi, n_hi = minority_majority(df, spec)
    base = df.select(spec.id, *feats, spec.label)
    minority = base.where(F.col(spec.label) == lo)
    n_new = n_hi - n_lo
    kk = min(k, n_lo - 1)
    if n_new == 0 or kk < 1:
        return base
    nb_col = f"nn_{spec.id}"
    g = F.col("id")
    draw = hash_int(seed, g, "p") % F.lit(n_lo * kk)
    gen = spark.range(n_new).select(
        g.alias("_g"), (F.floor(draw / kk) + 1).alias("_r"), (draw % kk + 1).alias("nn"),
        (hash_int(seed, g, "g") / F.lit(4294967296.0)).alias("_u"))
    # whatever reads the rows made here, the neighbours are searched once, and nothing of the search stays
    with passing(spark):
        nn = knn(minority, minority, kk, feats, spec.id, exclude_self=True)  # (id, nn, nn_<id>, d2)
        pos = ranked(minority.select(spec.id), [spec.id], rank_col="_r")
        picked = gen.join(pos, "_r").join(nn.select(spec.id, "nn", nb_col), [spec.id, "nn"])
        picked = materialize(picked.select(spec.id, nb_col, "_g", "_u"), "smote", keep=True)
        del nn, pos
    a = minority.select(spec.id, *[F.col(c).alias(f"_a_{c}") for c in feats])
    b = minority.select(F.col(spec.id).alias(nb_col), *[F.col(c).alias(f"_b_{c}") for c in feats])
    both = picked.join(a, spec.id).join(b, nb_col)
    flag_set = set(spec.flags)
    cols = []
    for c in feats:
        x = F.col(f"_a_{c}") + F.col("_u") * (F.col(f"_b_{c}") - F.col(f"_a_{c}"))
        if round_flags and c in flag_set:
            x = F.round(x)
        cols.append(x.cast("double").alias(c))
    synth = both.select((-(F.col("_g") + 1)).cast("bigint").alias(spec.id), *cols,
                        F.lit(lo).cast("int").alias(spec.label))
    real = base.select(F.col(spec.id).cast("bigint").alias(spec.id),
                       *[F.col(c).cast("double").alias(c) for c in feats], F.col(spec.label).cast("int"))
    return real.unionByName(synth)


def near_miss(df: DataFrame, spec: TableSpec, k: int = 3, features: list[str] | None = None) -> DataFrame:
    """P5 (NearMiss version 1): keep all minority rows and the n_minor majority rows with
    the smallest mean distance to their k nearest minority rows (mean rounded to 6
    digits, ties by id). This undersamples (trap T12). A null feature or label raises."""
    from rarebird.operators.neighbors import knn

    feats = list(features or spec.features)
    lo, n_lo, hi, _ = minority_majority(df, spec)
    base = df.select(spec.id, *feats, spec.label)
    minority = base.where(F.col(spec.label) == lo)
    majority = base.where(F.col(spec.label) == hi)
    with passing(df.sparkSession):
        nn = knn(majority, minority, k, feats, spec.id, spec.id, least=n_lo)
        mean = nn.groupBy(spec.id).agg(F.round(F.avg(F.sqrt("d2")), 6).alias("_md"))
        # the rounded means as whole millionths, in the same order
        mean = materialize(mean.select(F.col(spec.id).cast("bigint").alias("id"), F.round(F.col("_md") * 1e6).cast("bigint").alias("key")), "near-miss", keep=True)
        del nn
    keep = mean.where(among_smallest(mean, n_lo)(F.col("key"), F.col("id"))).select(F.col("id").alias(spec.id))
    return minority.unionByName(majority.join(keep, spec.id, "left_semi"))
