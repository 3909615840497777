"""M5 on binned rows: the forest of ``pyspark.ml``, grown from counts of equal binned rows.

``pyspark.ml`` bins every feature into at most 32 bins and reads the rows again for every level of the
trees. Rows of one label and weight that share all bins are the same row to every split, so they are
counted here in one pass, and each tree grows from the counts, in a task of its own: a row drawn by
a Poisson number of mean 1 for each tree is a group drawn by a Poisson number with its count as the mean.
Impurity, gain, least rows of a child, features drawn for each node and merged leaves of one
prediction are those of ``pyspark.ml``, and so is the model: the trees are written in its storage
format and read by its own reader.

This is done where groups have ``LEAST`` rows on average and at most ``MOST`` groups are held in a task, that is for
a few features; other tables, whose rows hardly share bins, are left to ``pyspark.ml``.
"""

from __future__ import annotations

import json
import math
import time

import numpy as np
from pyspark.ml.classification import DecisionTreeClassifier, RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rarebird.session import delete, materialize, passing, scratch_path

#: Rows to a group, and groups, for trees to grow from counts. Nodes whose histograms are held together.
LEAST, MOST, NODES = 8, 1 << 18, 4096
_NODE = ("treeID int, nodeData struct<id: int, prediction: double, impurity: double, impurityStats: array<double>, rawCount: bigint, gain: double, "
         "leftChild: int, rightChild: int, split: struct<featureIndex: int, leftCategoriesOrThreshold: array<double>, numCategories: int>>")


def per_node(d: int, strategy: str) -> int | None:
    """Features drawn for each node; None for a strategy that only ``pyspark.ml`` knows."""
    known = {"all": d, "sqrt": math.ceil(math.sqrt(d)), "log2": max(1, math.ceil(math.log2(d))), "onethird": math.ceil(d / 3)}
    return known.get(strategy)


def split_points(vec: DataFrame, d: int, max_bins: int) -> list[np.ndarray]:
    """Per feature at most ``max_bins`` - 1 thresholds: between all values where these are so few, else above the quantiles."""
    x = [F.get(vector_to_array("features"), j) for j in range(d)]
    quantiles = vec.agg(*[F.percentile_approx(v, [i / max_bins for i in range(1, max_bins)], 100 * max_bins).alias(f"q{j}") for j, v in enumerate(x)]).first()
    values = materialize(vec.select(F.posexplode(vector_to_array("features")).alias("j", "v")).distinct(), "forest-values")
    many = {r.j: r["count"] for r in values.groupBy("j").count().collect()}
    few = [j for j in range(d) if many.get(j, 0) <= max_bins]
    low = {j: sorted(set(quantiles[j] or [])) for j in range(d)}
    for j in few:
        low[j] = []
    for r in values.where(F.col("j").isin(few)).collect():  # max_bins values a feature
        low[r.j].append(r.v)
    # a threshold lies half way to the next value
    above = [F.min(F.when((F.col("j") == j) & (F.col("v") > v), F.col("v"))) for j in range(d) for v in sorted(low[j])]
    above = iter(values.agg(*above).first() if above else [])
    out = []
    for j in range(d):
        pairs = [(v, next(above)) for v in sorted(low[j])]
        out.append(np.array([m if (m := (a + b) / 2) < b else a for a, b in pairs if b is not None], float))
    return out


def _counted(cuts: list[np.ndarray]):
    """Task function: rows (x, y, w) -> (code, y, w, n); the code holds the bins of all features."""
    def run(batches):
        import pyarrow as pa

        for b in batches:
            x = b.column("x").flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, len(cuts))
            code = np.zeros(len(x), np.int64)
            for j, c in enumerate(cuts):
                code = code * (len(c) + 1) + np.searchsorted(c, x[:, j])
            y, w = (b.column(c).to_numpy(zero_copy_only=False) for c in ("y", "w"))
            order = np.lexsort((w, y, code))
            code, y, w = code[order], y[order], w[order]
            edge = np.flatnonzero(np.r_[True, (np.diff(code) != 0) | (np.diff(y) != 0) | (np.diff(w) != 0)][:len(code)])
            if len(edge):
                yield pa.RecordBatch.from_arrays([pa.array(v) for v in (code[edge], y[edge], w[edge], np.diff(np.r_[edge, len(code)]))], names=["code", "y", "w", "n"])

    return run


def _impurity(kind: str, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    total = a + b
    p, q = (np.divide(v, total, out=np.zeros_like(total), where=total > 0) for v in (a, b))
    if kind == "gini":
        return np.where(total > 0, 1.0 - p * p - q * q, 0.0)
    return -sum(v * np.log2(v, out=np.zeros_like(v), where=v > 0) for v in (p, q))


def grow(bins: np.ndarray, y: np.ndarray, w: np.ndarray, n: np.ndarray, sizes: list[int], draw: int, kind: str, max_depth: int, least: int, rng) -> dict:
    """One tree from groups (``bins``: a row a feature; label; weight; rows drawn): arrays of its nodes, the root first."""
    d = len(sizes)
    keep = n > 0
    bins, y, n = bins[:, keep], y[keep], n[keep]
    w = w[keep] * n
    sums = [np.where(y == c, w, 0.0) for c in (0, 1)]
    # what is known of the nodes of a level when it is reached: class sums and rows
    stats, rows = [np.array([s.sum()]) for s in sums], np.array([n.sum()])
    node = np.zeros(len(y), np.int64)  # of the level
    out: list[dict] = []
    for depth in range(max_depth + 1):
        m = len(rows)
        imp = _impurity(kind, *stats)
        level = {"p": stats[0], "q": stats[1], "rows": rows, "impurity": imp, "gain": np.full(m, -1.0), "feature": np.full(m, -1), "cut": np.full(m, -1), "left": np.full(m, -1)}
        out.append(level)
        open_ = (imp >= 2.0 ** -52) & (depth < max_depth)
        if not open_.any():
            break
        chosen = rng.random((m, d)).argsort(axis=1).argsort(axis=1) < draw  # features of each node
        order = np.argsort(node, kind="stable")
        edges = np.searchsorted(node[order], np.arange(0, m + NODES, NODES))
        best, best_f, best_c = np.full(m, -np.inf), np.full(m, -1), np.full(m, -1)
        side = np.zeros((3, m))
        for part, (lo, hi) in enumerate(zip(edges, edges[1:], strict=False)):
            first, last = part * NODES, min(m, (part + 1) * NODES)
            g = order[lo:hi]
            at, k = node[g] - first, last - first
            total = stats[0][first:last] + stats[1][first:last]
            for f in range(d):
                width = sizes[f] + 1
                if width < 2:
                    continue
                key = at * width + bins[f, g]
                lp, lq, ln = (np.cumsum(np.bincount(key, v[g], k * width).reshape(k, width), axis=1)[:, :-1] for v in (*sums, n))
                rp, rq, rn = stats[0][first:last, None] - lp, stats[1][first:last, None] - lq, rows[first:last, None] - ln
                share = np.divide(lp + lq, total[:, None], out=np.zeros_like(lp), where=total[:, None] > 0)
                gain = imp[first:last, None] - share * _impurity(kind, lp, lq) - (1 - share) * _impurity(kind, np.maximum(rp, 0), np.maximum(rq, 0))
                gain = np.where((ln >= least) & (rn >= least) & chosen[first:last, f, None], gain, -np.inf)
                c = gain.argmax(axis=1)
                i = np.arange(k)
                better = np.flatnonzero(gain[i, c] > best[first:last])
                where = better + first
                best[where], best_f[where], best_c[where] = gain[better, c[better]], f, c[better]
                for s, v in zip(side, (lp, lq, ln), strict=True):
                    s[where] = v[better, c[better]]
        # sums in another order differ in the last digits: such a gain is none
        split = np.flatnonzero(open_ & (best > 1e-12))
        if not len(split):
            break
        level["gain"][split], level["feature"][split], level["cut"][split] = best[split], best_f[split], best_c[split]
        level["left"][split] = 2 * np.arange(len(split))
        new = np.full(m, -1)
        new[split] = 2 * np.arange(len(split))
        inside = new[node] >= 0
        bins, y, n, node = bins[:, inside], y[inside], n[inside], node[inside]
        sums = [s[inside] for s in sums]
        right = bins[best_f[node], np.arange(len(node))] > best_c[node]
        node = new[node] + right
        k = 2 * len(split)
        stats = [np.bincount(node, s, k) for s in sums]
        rows = np.bincount(node, n, k).astype(np.int64)
    start = np.cumsum([0, *[len(v["rows"]) for v in out]])
    tree = {c: np.concatenate([v[c] for v in out]) for c in out[0]}
    below = np.concatenate([np.full(len(v["rows"]), start[i + 1] if i + 1 < len(out) else 0) for i, v in enumerate(out)])
    tree["left"] = np.where(tree["left"] >= 0, tree["left"] + below, -1)
    return _merged(tree)


def _merged(tree: dict) -> dict:
    """Leaves of one parent and prediction become one, from the last level up; ``prediction`` is added."""
    said, left = (tree["q"] > tree["p"]).astype(float), tree["left"]
    for i in range(len(left) - 1, -1, -1):
        a = left[i]
        if a >= 0 and left[a] < 0 and left[a + 1] < 0 and said[a] == said[a + 1]:
            left[i] = -1
    tree["gain"], tree["prediction"] = np.where(left >= 0, tree["gain"], -1.0), said
    return tree


def _rows_of(number: int, tree: dict, cuts: list[np.ndarray]):
    """The tree as its stored rows, numbered from the root, a node before its children and the left ones first."""
    import pyarrow as pa

    left = tree["left"]
    order, todo = [], [0]
    while todo:
        i = todo.pop()
        order.append(i)
        if left[i] >= 0:
            todo += [left[i] + 1, left[i]]
    order = np.array(order)
    new = np.full(len(left), -1)
    new[order] = np.arange(len(order))
    inner = left[order] >= 0
    a = np.where(inner, new[left[order]], -1)
    b = np.where(inner, new[left[order] + 1], -1)
    feature = np.where(inner, tree["feature"][order], -1)
    threshold = [[float(cuts[f][c])] if ok else [] for f, c, ok in zip(feature, tree["cut"][order], inner, strict=True)]
    split = pa.StructArray.from_arrays([pa.array(feature, pa.int32()), pa.array(threshold, pa.list_(pa.float64())), pa.array(np.full(len(order), -1), pa.int32())],
                                       names=["featureIndex", "leftCategoriesOrThreshold", "numCategories"])
    stats = pa.array(np.stack([tree["p"][order], tree["q"][order]], axis=1).tolist(), pa.list_(pa.float64()))
    node = pa.StructArray.from_arrays(
        [pa.array(np.arange(len(order)), pa.int32()), pa.array(tree["prediction"][order]), pa.array(tree["impurity"][order]), stats, pa.array(tree["rows"][order], pa.int64()),
         pa.array(tree["gain"][order]), pa.array(a, pa.int32()), pa.array(b, pa.int32()), split],
        names=["id", "prediction", "impurity", "impurityStats", "rawCount", "gain", "leftChild", "rightChild", "split"])
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(order), number), pa.int32()), node], names=["treeID", "nodeData"])


def _trees(table, cuts: list[np.ndarray], draw: int, kind: str, max_depth: int, least: int, bootstrap: bool, seed: int):
    """Task function: numbers of trees -> their nodes."""
    def run(batches):
        code, y, w, n = table.value
        sizes, bins, rest = [len(c) for c in cuts], [], code
        for size in reversed(sizes):
            bins.append(rest % (size + 1))
            rest = rest // (size + 1)
        bins = np.stack(bins[::-1])
        for b in batches:
            for number in b.column("id").to_pylist():
                rng = np.random.default_rng([seed & 0xFFFFFFFF, number])
                drawn = rng.poisson(n) if bootstrap else n
                yield _rows_of(number, grow(bins, y, w, drawn, sizes, draw, kind, max_depth, least, rng), cuts)

    return run


def fit_grouped(vec: DataFrame, label: str, weight_col: str | None, d: int, rows: int, est: RandomForestClassifier) -> RandomForestClassificationModel | None:
    """The forest that ``est`` describes, or None where rows hardly share bins: ``est`` must fit it then."""
    draw = per_node(d, est.getFeatureSubsetStrategy())
    if draw is None or d == 0 or rows < LEAST:
        return None
    spark = vec.sparkSession
    with passing(spark):
        cuts = split_points(vec, d, est.getMaxBins())
        if math.prod(len(c) + 1 for c in cuts) >= 1 << 62:
            return None
        y = F.col(label).cast("double")
        data = vec.select(vector_to_array("features").alias("x"), y.alias("y"), (F.col(weight_col).cast("double") if weight_col else F.lit(1.0)).alias("w"))
        groups = data.mapInArrow(_counted(cuts), "code long, y double, w double, n long").groupBy("code", "y", "w").agg(F.sum("n").alias("n"))
        groups = materialize(groups, "forest-groups")
        if (held := groups.count()) > min(MOST, rows // LEAST) or not groups.where("y IS NULL OR y NOT IN (0, 1) OR w IS NULL").isEmpty():
            return None
        table = groups.orderBy("code", "y", "w").toArrow()
        assert table.num_rows == held
        shared = spark.sparkContext.broadcast([table.column(c).to_numpy() for c in ("code", "y", "w", "n")])
        trees = est.getNumTrees()
        numbers = spark.range(trees).repartition(min(trees, 4 * spark.sparkContext.defaultParallelism), "id")
        run = _trees(shared, cuts, draw, est.getImpurity(), est.getMaxDepth(), est.getMinInstancesPerNode(), est.getBootstrap(), est.getSeed())
        path = scratch_path(spark, "forest")
        numbers.mapInArrow(run, _NODE).write.parquet(f"{path}/data")
        _describe(spark, path, est, d, trees)
        model = RandomForestClassificationModel.load(path)
        delete(spark, path)
        shared.destroy()
    return model


def _describe(spark, path: str, est: RandomForestClassifier, d: int, trees: int) -> None:
    """What ``pyspark.ml`` stores beside the nodes: parameters of the forest and of each tree."""
    def about(name: str, uid: str, given: dict, defaults: dict, **more) -> str:
        return json.dumps({"class": f"org.apache.spark.ml.classification.{name}", "timestamp": int(time.time() * 1000), "sparkVersion": spark.version, "uid": uid,
                           "paramMap": given, "defaultParamMap": defaults, **more})

    given, defaults = ({p.name: v for p, v in m.items()} for m in (est._paramMap, est._defaultParamMap))
    one = DecisionTreeClassifier()
    tree_defaults = {p.name: v for p, v in one._defaultParamMap.items()}
    tree_given = {c: v for c, v in given.items() if one.hasParam(c)}
    trees_about = [(i, about("DecisionTreeClassificationModel", f"{one.uid}_{i}", tree_given, tree_defaults), 1.0) for i in range(trees)]
    spark.createDataFrame(trees_about, "_1 int, _2 string, _3 double").coalesce(1).write.parquet(f"{path}/treesMetadata")
    forest = about("RandomForestClassificationModel", est.uid, given, defaults, numFeatures=d, numClasses=2, numTrees=trees)
    spark.createDataFrame([(forest,)], "value string").coalesce(1).write.text(f"{path}/metadata")
