"""M6 second phase: second-order boosted trees over histograms (Chen & Guestrin, 2016).

Loss: log-loss on the margin m (the sum of the trees' leaf values, 0 at the start). With
p = 1 / (1 + exp(-m)) a row of weight w has gradient g = w (p - y) and hessian h = w p (1 - p).
A leaf with sums G, H has the value -learning_rate G / (H + reg_lambda); a split gains

    GL^2 / (HL + reg_lambda) + GR^2 / (HR + reg_lambda) - G^2 / (H + reg_lambda).

* Trees grow level by level to ``max_depth``; both sides of a split need a hessian sum of at
  least ``min_child_weight``. Of equal gains (to 9 digits) the first feature and the lowest
  threshold count.
* ``gamma`` prunes afterwards from the leaves up: a split whose children are leaves goes if
  its gain is below gamma.
* ``colsample_bytree`` is the share of the features that a tree may use, first in
  md5(seed-tree-feature) order.

Spark does the work on rows: thresholds are values at which a feature's distribution passes
a ``1 / max_bins`` quantile (exact, from counts of distinct values, so a feature with few
values keeps all that matter); the binned rows are packed into
blocks of ``BLOCK`` rows, a record each, and dealt evenly to all cores, so a pass reads whole arrays and
no task has a larger share; every level is one pass in which tasks sum (g, h) by (node,
feature, bin) in numpy, and one shuffle by (node, feature) to the tasks that add them up and
find the best split. The driver gets a row for each node and feature. Rows keep their margin; it is written anew every ``KEEP`` trees.
"""

from __future__ import annotations

import hashlib
import json
from dataclasses import dataclass, field

import numpy as np
from pyspark.ml import Model
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasFeaturesCol
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rarebird.operators.ranking import ranked
from rarebird.session import materialize

#: Trees after which the rows' margins are written, and the least gain of a split.
KEEP, LEAST_GAIN = 10, 1e-6
#: Rows in a block, and blocks in a task's share.
BLOCK, SHARE = 1 << 14, 64


@dataclass
class Tree:
    """Nodes as parallel lists, the root first; a leaf has feature -1 and children -1."""

    feature: list[int] = field(default_factory=list)
    threshold: list[float] = field(default_factory=list)
    bin: list[int] = field(default_factory=list)
    left: list[int] = field(default_factory=list)
    right: list[int] = field(default_factory=list)
    gain: list[float] = field(default_factory=list)
    hessian: list[float] = field(default_factory=list)
    value: list[float] = field(default_factory=list)

    def add(self, g: float, h: float, rate: float, reg_lambda: float) -> int:
        """A new leaf; its number."""
        for name, x in (("feature", -1), ("threshold", 0.0), ("bin", -1), ("left", -1), ("right", -1), ("gain", 0.0),
                        ("hessian", h), ("value", -rate * g / (h + reg_lambda) if h + reg_lambda > 0 else 0.0)):
            getattr(self, name).append(x)
        return len(self.feature) - 1

    def depth(self) -> int:
        """Splits on the longest way to a leaf."""
        level = [0] * len(self.feature)
        for n, f in enumerate(self.feature):  # children come after their parents
            if f >= 0:
                level[self.left[n]] = level[self.right[n]] = level[n] + 1
        return max(level)

    def places(self, x: np.ndarray, by: str) -> np.ndarray:
        """The leaf of each column of ``x``, a row of which is a feature: ``by`` is ``bin`` for binned rows, ``threshold`` for values."""
        n, flat = x.shape[1], x.ravel()
        split, own = np.array(self.feature) >= 0, np.arange(len(self.feature))
        # a leaf leads to itself, so all rows take as many steps
        first = np.where(split, self.feature, 0) * n
        left, right, cut = np.where(split, self.left, own), np.where(split, self.right, own), np.array(getattr(self, by))
        node, row = np.zeros(n, np.int64), np.arange(n)
        for _ in range(self.depth()):
            node = np.where(flat[first[node] + row] <= cut[node], left[node], right[node])
        return node

    def prune(self, gamma: float) -> None:
        """Drop splits above leaves whose gain is below ``gamma``, from the leaves up; unused nodes go."""
        for n in range(len(self.feature) - 1, -1, -1):  # children come after their parents
            if self.feature[n] >= 0 and self.gain[n] < gamma and self.feature[self.left[n]] < 0 and self.feature[self.right[n]] < 0:
                self.feature[n] = self.bin[n] = self.left[n] = self.right[n] = -1
                self.gain[n] = self.threshold[n] = 0.0
        used = [0]
        for n in used:
            used += [self.left[n], self.right[n]] if self.feature[n] >= 0 else []
        used.sort()
        new = {n: i for i, n in enumerate(used)} | {-1: -1}
        for name in ("feature", "threshold", "bin", "gain", "hessian", "value"):
            setattr(self, name, [getattr(self, name)[n] for n in used])
        self.left, self.right = [new[self.left[n]] for n in used], [new[self.right[n]] for n in used]


class BoostedTreesModel(HasFeaturesCol, Model, DefaultParamsReadable, DefaultParamsWritable):
    """Trees over a feature vector; ``transform`` adds rawPrediction, probability and prediction."""

    n_features = Param(Params._dummy(), "n_features", "length of the feature vector", TypeConverters.toInt)
    ensemble = Param(Params._dummy(), "ensemble", "the trees as JSON", TypeConverters.toString)

    @classmethod
    def of(cls, n_features: int, trees: list[Tree]) -> BoostedTreesModel:
        return cls()._set(n_features=n_features, ensemble=json.dumps([vars(t) for t in trees]))

    @property
    def trees(self) -> list[Tree]:
        return [Tree(**t) for t in json.loads(self.getOrDefault("ensemble"))]

    def margins(self, x: np.ndarray) -> np.ndarray:
        return _margin(self.trees, x)

    def _transform(self, df: DataFrame) -> DataFrame:
        margin = F.pandas_udf(_margins(self.trees), "double", F.PandasUDFType.SCALAR)(vector_to_array(self.getFeaturesCol()))
        p = 1 / (1 + F.exp(-F.col("_m")))
        return (df.withColumn("_m", margin).withColumn("rawPrediction", array_to_vector(F.array(-F.col("_m"), F.col("_m"))))
                .withColumn("probability", array_to_vector(F.array(1 - p, p))).withColumn("prediction", (F.col("_m") > 0).cast("double")).drop("_m"))

    @property
    def featureImportances(self):
        """Mean gain of a feature's splits, as a share of all features' means."""
        from pyspark.ml.linalg import Vectors

        total, n = np.zeros(self.getOrDefault("n_features")), np.zeros(self.getOrDefault("n_features"))
        for t in self.trees:
            for f, gain in zip(t.feature, t.gain, strict=True):
                if f >= 0:
                    total[f] += gain
                    n[f] += 1
        mean = total / np.maximum(n, 1)
        return Vectors.dense(mean / (mean.sum() or 1.0))

    def nodes(self, features: list[str]) -> list[tuple]:
        """(tree, node, feature, threshold, gain, hessian, value) of every node; a split has a null value, a leaf the rest."""
        return [(i, n, features[t.feature[n]] if s else None, t.threshold[n] if s else None, t.gain[n] if s else None, t.hessian[n], None if s else t.value[n])
                for i, t in enumerate(self.trees) for n in range(len(t.feature)) for s in [t.feature[n] >= 0]]


def _margin(trees: list[Tree], x: np.ndarray) -> np.ndarray:
    columns = np.ascontiguousarray(x.T)
    return sum((np.array(t.value)[t.places(columns, "threshold")] for t in trees), np.zeros(len(x)))


def _margins(trees: list[Tree]):
    import pandas as pd

    def run(x):
        return pd.Series(_margin(trees, np.stack(x.to_numpy())) if len(x) else [], dtype="float64")

    return run


def quantile_cuts(vec: DataFrame, d: int, max_bins: int) -> list[np.ndarray]:
    """Per feature the values at which its distribution passes a multiple of 1 / max_bins: at most max_bins each."""
    long = vec.select(F.posexplode(vector_to_array("features")).alias("j", "v")).groupBy("j", "v").agg(F.count(F.lit(1)).alias("n"))
    at = ranked(long, ["v"], group=["j"], rank_col="_r", sums=["n"])
    total = long.groupBy("j").agg(F.sum("n").alias("total"))  # a row for each feature
    passed = lambda c: F.floor(c * max_bins / F.col("total"))
    cuts = at.join(F.broadcast(total), "j").where(passed(F.col("cum_n")) > passed(F.col("cum_n") - F.col("n"))).select("j", "v").collect()
    return [np.array(sorted(r.v for r in cuts if r.j == j)) for j in range(d)]


def _binned(cuts: list[np.ndarray]):
    """Task function: rows (x, y, w) -> blocks of up to ``BLOCK`` binned rows; a block's bins lie feature by feature."""
    def block(parts):
        x, y, w = (np.concatenate(p) for p in zip(*parts, strict=True))
        bins = np.stack([np.searchsorted(c, x[:, j]) for j, c in enumerate(cuts)]) if cuts else np.zeros((0, len(x)))
        return _record([bins.astype(np.uint16), y, w, np.zeros(len(y))])

    def run(batches):
        parts, held = [], 0
        for b in batches:
            x = b.column("x").flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, len(cuts))
            if np.isnan(x).any():
                raise ValueError("NaN in a feature: impute or filter it first")
            y, w = (b.column(c).to_numpy(zero_copy_only=False) for c in ("y", "w"))
            at = 0
            while at < len(x):
                some = slice(at, at + BLOCK - held)
                parts.append((x[some], y[some], w[some]))
                held, at = held + len(y[some]), some.stop
                if held == BLOCK:
                    yield block(parts)
                    parts, held = [], 0
        if parts:
            yield block(parts)

    return run


def _record(arrays):
    import pyarrow as pa

    return pa.RecordBatch.from_arrays([pa.array([a.tobytes()], pa.binary()) for a in arrays], names=["bins", "y", "w", "m"])


def _blocks(batches, d: int):
    """(bins, y, w, m) of each block, the bins of a feature in a row."""
    for b in batches:
        for i in range(b.num_rows):
            bins, y, w, m = (np.frombuffer(b.column(c)[i].as_buffer(), t) for c, t in (("bins", np.uint16), ("y", float), ("w", float), ("m", float)))
            yield bins.reshape(d, len(m)), y, w, m


def _advanced(trees: list[Tree], d: int):
    """The blocks with the trees' values added to their rows' margins."""
    def run(batches):
        for bins, y, w, m in _blocks(batches, d):
            yield _record([bins, y, w, sum((np.array(t.value)[t.places(bins, "bin")] for t in trees), m)])

    return run


def _histograms(trees: list[Tree], tree: Tree, active: list[int], features: list[int], sizes: list[int]):
    """(node, feature, bin, g, h): sums of a task's rows in the ``active`` leaves of the growing tree."""
    d, width = len(sizes), max(sizes, default=0) + 1

    def run(batches):
        import pyarrow as pa

        place = np.full(len(tree.feature), -1)
        place[active] = np.arange(len(active))
        g_sum, h_sum = (np.zeros((len(active), len(features), width)) for _ in range(2))
        for bins, y, w, m in _blocks(batches, d):
            m = sum((np.array(t.value)[t.places(bins, "bin")] for t in trees), m)
            p = 1 / (1 + np.exp(-m))
            g = w * (p - y)
            h = w * p * (1 - p)
            node = place[tree.places(bins, "bin")]
            if (node < 0).any():
                rows = np.flatnonzero(node >= 0)
                node, g, h, bins = node[rows], g[rows], h[rows], bins[:, rows]
            for i, f in enumerate(features):
                key = node * width + bins[f]
                for out, x in ((g_sum, g), (h_sum, h)):
                    out[:, i] += np.bincount(key, x, len(active) * width).reshape(-1, width)
        node, i, at = np.nonzero((h_sum != 0) | (g_sum != 0))
        if len(node):
            yield pa.RecordBatch.from_arrays(
                [pa.array(x, t) for x, t in ((np.array(active)[node], pa.int32()), (np.array(features)[i], pa.int32()), (at, pa.int32()),
                                             (g_sum[node, i, at], pa.float64()), (h_sum[node, i, at], pa.float64()))],
                names=["node", "feature", "bin", "g", "h"])

    return run


def _best(sizes: list[int], reg_lambda: float, min_child_weight: float):
    """Task function: all (node, feature, bin, g, h) of some (node, feature) pairs -> the best split of each
    pair (its gain null where none is allowed) with the node's sums."""
    def run(batches):
        import pyarrow as pa

        held: dict[tuple, np.ndarray] = {}
        for b in batches:
            node, feature, at, g, h = (np.asarray(b.column(c)) for c in ("node", "feature", "bin", "g", "h"))
            order = np.lexsort((feature, node))
            edge = np.flatnonzero((np.diff(node[order]) != 0) | (np.diff(feature[order]) != 0)) + 1
            for some in np.split(order, edge):
                if len(some):
                    sums = held.setdefault((int(node[some[0]]), int(feature[some[0]])), np.zeros((2, sizes[feature[some[0]]] + 1)))
                    for i, v in enumerate((g, h)):
                        sums[i] += np.bincount(at[some], v[some], sums.shape[1])
        out = []
        score = lambda g, h: np.divide(g * g, h + reg_lambda, out=np.zeros_like(g), where=h + reg_lambda > 0)
        for (node, feature), sums in held.items():
            g, h = sums.sum(1)
            gl, hl = np.cumsum(sums, axis=1)[:, :-1]  # the last bin has nothing on its right
            gain = np.round(score(gl, hl) + score(g - gl, h - hl) - score(np.array([g]), np.array([h])), 9)
            least = max(min_child_weight, 1e-16)
            gain = np.where((hl >= least) & (h - hl >= least), gain, -np.inf)
            at = int(gain.argmax()) if len(gain) else -1
            ok = at >= 0 and np.isfinite(gain[at])
            out.append((node, feature, g, h, *((float(gain[at]), at, gl[at], hl[at]) if ok else (None, None, None, None))))
        if out:
            kinds = [pa.int32(), pa.int32(), pa.float64(), pa.float64(), pa.float64(), pa.int32(), pa.float64(), pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)],
                                             names=["node", "feature", "g", "h", "gain", "bin", "gl", "hl"])

    return run


def best_splits(hist: DataFrame, sizes: list[int], reg_lambda: float, min_child_weight: float) -> list:
    """The best split of each node of (node, feature, bin, g, h), in order of nodes; ``sizes`` are the features'
    thresholds. One shuffle by (node, feature); a row for each pair comes to the driver."""
    pairs = hist.repartition("node", "feature").mapInArrow(
        _best(sizes, reg_lambda, min_child_weight), "node int, feature int, g double, h double, gain double, bin int, gl double, hl double").collect()
    best = {}
    for r in sorted(pairs, key=lambda r: (r.node, float("inf") if r.gain is None else -r.gain, r.feature)):
        best.setdefault(r.node, r)
    return [best[n] for n in sorted(best)]


def sampled(d: int, share: float, tree: int, seed: int) -> list[int]:
    """Features that a tree may use: max(1, floor(share d)) of them, first in md5(seed-tree-feature) order."""
    order = sorted(range(d), key=lambda j: hashlib.md5(f"{seed}-{tree}-{j}".encode()).hexdigest())
    return sorted(order[:max(1, int(share * d + 1e-9))])


def _dealt(blocks: DataFrame) -> DataFrame:
    """The blocks, written in equal shares for all cores; a share holds ``SHARE`` of them at most."""
    spark = blocks.sparkSession
    cores = spark.sparkContext.defaultParallelism
    written = materialize(blocks, "boosting")
    rounds = -(-written.count() // (cores * SHARE))
    return written.repartition(cores * max(rounds, 1))


def fit_boosted_trees(vec: DataFrame, label: str, weight_col: str | None, d: int, n_estimators: int = 100, learning_rate: float = 0.1,
                      max_depth: int = 3, min_child_weight: float = 1.0, gamma: float = 0.0, reg_lambda: float = 1.0,
                      colsample_bytree: float = 1.0, max_bins: int = 256, seed: int = 42) -> BoostedTreesModel:
    """Fit on (features vector, label 0/1, weight). Two passes and their shuffles for the thresholds,
    then one small job for each level of each tree."""
    if not 2 <= max_bins <= 1 << 15:
        raise ValueError("max_bins must lie between 2 and 32768")
    cuts = quantile_cuts(vec, d, max_bins)
    # the last threshold of a feature holds all rows on its left
    sizes = [max(len(c) - 1, 0) for c in cuts]
    w = F.col(weight_col).cast("double") if weight_col else F.lit(1.0)
    rows = vec.select(vector_to_array("features").alias("x"), F.col(label).cast("double").alias("y"), w.alias("w"))
    kind = "bins binary, y binary, w binary, m binary"
    data = _dealt(rows.mapInArrow(_binned(cuts), kind)).persist()
    trees: list[Tree] = []
    written = 0  # trees whose values are in the margins
    try:
        for number in range(n_estimators):
            if number - written == KEEP:
                new = _dealt(data.mapInArrow(_advanced(trees[written:], d), kind)).persist()
                data.unpersist()
                data, written = new, number
            features, tree = sampled(d, colsample_bytree, number, seed), Tree()
            active = [tree.add(0.0, 0.0, learning_rate, reg_lambda)]
            for _ in range(max_depth):
                hist = data.mapInArrow(_histograms(trees[written:], tree, active, features, [len(c) for c in cuts]),
                                       "node int, feature int, bin int, g double, h double")
                active = []
                for r in best_splits(hist, sizes, reg_lambda, min_child_weight):
                    if r.node == 0:
                        tree.hessian[0] = r.h
                        tree.value[0] = -learning_rate * r.g / (r.h + reg_lambda) if r.h + reg_lambda > 0 else 0.0
                    if r.gain is None or r.gain <= LEAST_GAIN:
                        continue
                    tree.feature[r.node], tree.bin[r.node] = r.feature, r.bin
                    tree.threshold[r.node], tree.gain[r.node] = float(cuts[r.feature][r.bin]), r.gain
                    tree.left[r.node] = tree.add(r.gl, r.hl, learning_rate, reg_lambda)
                    tree.right[r.node] = tree.add(r.g - r.gl, r.h - r.hl, learning_rate, reg_lambda)
                    active += [tree.left[r.node], tree.right[r.node]]
                if not active:
                    break
            tree.prune(gamma)
            trees.append(tree)
    finally:
        data.unpersist()
    return BoostedTreesModel.of(d, trees)
