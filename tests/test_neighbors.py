"""P3 against brute force: low and high dimension, self exclusion, ties by id."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from rarebird.operators.neighbors import _Tree, _met, _points, _reach, cells, knn, knn_approximate
from rarebird.sources.fixtures import emb_binary


def _brute(A, B, k, exclude_self):
    out = {}
    for i, a in zip(A[0], A[1]):
        d2 = ((B[1] - a) ** 2).sum(axis=1)
        order = sorted((float(d), int(j)) for d, j in zip(d2, B[0]) if not (exclude_self and j == i))
        out[int(i)] = [j for _, j in order[:k]]
    return out


def _check(got_df, brute, idc, nbc):
    got = {}
    for r in got_df.orderBy(idc, "nn").collect():
        got.setdefault(r[idc], []).append(r[nbc])
    assert got == brute


def test_knn_low_dim_self(spark, ev_small):
    cols = ["value", "hr", "k"]
    m = ev_small.where("label = 1").select("event_id", *cols)
    pdf = m.toPandas()
    arr = (pdf.event_id.values, pdf[cols].values.astype(float))
    got = knn(m, m, 5, cols, "event_id", exclude_self=True, leaf=40, hop=1)
    _check(got, _brute(arr, arr, 5, True), "event_id", "nn_event_id")


def test_knn_high_dim_two_tables(spark):
    emb = emb_binary(spark, "/root/testdata/sf0.001")
    cols = [f"e{j}" for j in range(64)]
    wide = emb.select("vec_id", "label", *[F.col("embedding")[j].cast("double").alias(f"e{j}") for j in range(64)])
    A = wide.where("label = 0").select(F.col("vec_id").alias("a_id"), *cols)
    B = wide.where("label = 1").select(F.col("vec_id").alias("b_id"), *cols)
    pa, pb = A.toPandas(), B.toPandas()
    brute = _brute((pa.a_id.values, pa[cols].values), (pb.b_id.values, pb[cols].values), 3, False)
    got = knn(A, B, 3, cols, "a_id", "b_id", leaf=16, hop=2)
    _check(got, brute, "a_id", "b_id")


def test_knn_duplicates_tie_by_id(spark):
    rows = [(i, 1.0, 1.0) for i in range(10)] + [(100 + i, float(i), 0.0) for i in range(5)]
    df = spark.createDataFrame(rows, "id long, x double, y double")
    got = knn(df, df, 3, ["x", "y"], "id", exclude_self=True, leaf=2)
    first = [r["nn_id"] for r in got.where("id = 0").orderBy("nn").collect()]
    assert first == [1, 2, 3]
    assert np.all(np.array(got.groupBy("id").count().select("count").collect()) == 3)


def test_knn_hot_duplicate_location(spark):
    """A third of the reference rows at one location: still exact, ties by id."""
    hot = [(i, 5.0, 5.0) for i in range(300)]
    rest = [(1000 + i, float(i % 30), float(i // 30)) for i in range(600)]
    df = spark.createDataFrame(hot + rest, "id long, x double, y double")
    pdf = df.toPandas()
    arr = (pdf.id.values, pdf[["x", "y"]].values)
    got = knn(df, df, 4, ["x", "y"], "id", exclude_self=True, leaf=16, hop=2)
    _check(got, _brute(arr, arr, 4, True), "id", "nn_id")


def test_one_informative_column_and_crowded_cells(spark):
    """Eight coordinates of which one tells rows apart, most rows at few values of it; ties by id."""
    rng = np.random.default_rng(2)
    rows = [(i, float(rng.choice([0.0, 0.0, 0.0, 1.0, 7.5, rng.integers(0, 40)])), *[3.0] * 6, float(i % 2)) for i in range(700)]
    cols = ["x", *[f"c{j}" for j in range(6)], "flag"]
    df = spark.createDataFrame(rows, ["id", *cols]).repartition(5)
    arr = (np.array([r[0] for r in rows]), np.array([r[1:] for r in rows]))
    for leaf, hop in ((8, 1), (8, 3), (10_000, 4)):
        _check(knn(df, df, 6, cols, "id", exclude_self=True, leaf=leaf, hop=hop), _brute(arr, arr, 6, True), "id", "nn_id")
    sizes = [r.n for r in cells(_points(df, "id", cols), len(cols), 50).groupBy("cell", "x").count().withColumnRenamed("count", "n").collect()]
    by_cell = [r["count"] for r in cells(_points(df, "id", cols), len(cols), 50).groupBy("cell").count().collect()]
    assert sum(sizes) == sum(by_cell) == 700 and len(by_cell) > 5


def test_knn_many_rows_of_a_in_one_cell_are_salted(spark, monkeypatch):
    from rarebird.operators import neighbors

    monkeypatch.setattr(neighbors, "MEET", 50)
    a = spark.createDataFrame([(i, 5.0 + i * 1e-6, 5.0) for i in range(400)] + [(1000 + i, float(i), 0.0) for i in range(30)], "id long, x double, y double")
    b = spark.createDataFrame([(i, float(i % 20), float(i // 20)) for i in range(300)], "b long, x double, y double")
    pa, pb = a.toPandas(), b.toPandas()
    brute = _brute((pa.id.values, pa[["x", "y"]].values), (pb.b.values, pb[["x", "y"]].values), 3, False)
    _check(knn(a, b, 3, ["x", "y"], "id", "b", leaf=16, hop=1), brute, "id", "b")


def test_knn_small_empty_and_null(spark):
    df = spark.createDataFrame([(1, 0.0), (2, 1.0)], "id long, x double")
    assert [(r.id, r.nn_id) for r in knn(df, df, 5, ["x"], "id", exclude_self=True).orderBy("id").collect()] == [(1, 2), (2, 1)]
    assert knn(df, df.where("false"), 2, ["x"], "id").count() == 0
    assert knn(df.where("false"), df, 2, ["x"], "id").count() == 0
    for odd in (None, float("nan")):
        with pytest.raises(Exception, match="null in x"):
            knn(df, df.union(spark.createDataFrame([(3, odd)], "id long, x double")), 1, ["x"], "id").count()


def test_approximate_search_measures_its_recall(spark):
    """64 dimensions, neighbours in clusters: at least 0.9 of the true neighbours; a poor choice says so."""
    rng = np.random.default_rng(7)
    centre = rng.normal(size=(60, 64)) * 4
    x = np.repeat(centre, 12, axis=0) + rng.normal(size=(720, 64)) * 0.3
    cols = [f"e{j}" for j in range(64)]
    df = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)], ["id", *cols]).repartition(4).cache()
    rows, recall = knn_approximate(df, df, 5, cols, "id", exclude_self=True, width=12.0, tables=12, projections=6, audit=100)
    true = knn(df, df, 5, cols, "id", exclude_self=True)
    share = rows.join(true.select("id", "nn_id"), ["id", "nn_id"], "left_semi").count() / true.count()
    assert recall >= 0.9 and share >= 0.9 and abs(recall - share) < 0.1
    exact = {(r.id, r.nn_id): r.d2 for r in true.collect()}
    assert all(abs(exact[r.id, r.nn_id] - r.d2) < 1e-9 for r in rows.collect() if (r.id, r.nn_id) in exact)
    _, poor = knn_approximate(df, df, 5, cols, "id", exclude_self=True, width=0.5, tables=1, projections=8, audit=50)
    assert poor < 0.5


def test_rows_meet_only_the_children_of_boxes_they_reach():
    """512 boxes in three levels: the reached ones are right, and a row is compared with few of all boxes."""
    names = [f"{a}{b}{c}" for a in range(8) for b in range(8) for c in range(8)]
    names += [n[:2] for n in names[::8]] + [str(a) for a in range(8)]
    lo = np.array([int(n.ljust(3, "0"), 8) for n in names], float)
    size = np.array([8.0 ** (3 - len(n)) for n in names])
    tree = _Tree(np.array(names, object), np.array([len(n) == 3 for n in names]), size.astype(np.int64), lo[:, None], (lo + size - 0.5)[:, None])
    assert tree.children.shape == (len(names) + 1, 8)
    x, r = np.array([[3.2], [100.0], [511.9], [600.0]]), np.array([0.0, 4.0, 9.0, np.inf])
    got = {i: set() for i in range(len(x))}
    for row, box, _ in _reach(tree, 1, x, np.ones(len(x), bool), r, True):
        for i, n in zip(row, tree.names[box], strict=True):
            got[i].add(n)
    for i in range(len(x)):
        gap = np.maximum(np.maximum(lo - x[i], x[i] - (lo + size - 0.5)), 0) ** 2
        assert got[i] == {n for n, g in zip(names, gap, strict=True) if g <= r[i] and len(n) == 3}
    near = [(i, n) for row, box, _ in _reach(tree, 2, x, np.ones(len(x), bool), r, False) for i, n in zip(row.tolist(), tree.names[box], strict=True)]
    assert {i for i, _ in near} == {0, 1, 2, 3} and all(len([1 for j, _ in near if j == i]) <= 8 for i in range(4))


def test_search_is_dealt_to_all_partitions(spark):
    """A stream of few bytes is much work: its partitions are not joined into one."""
    large = spark.range(64).selectExpr("cast(id % 16 AS string) AS key", "id", "true AS flag", "array(1.0D) AS x", "cast(null AS double) AS r")
    small = spark.range(16).selectExpr("cast(id AS string) AS key", "id", "cast(null AS string) AS box", "cast(null AS long) AS n", "cast(null AS boolean) AS flag", "array(1.0D) AS x", "cast(null AS array<double>) AS y")
    assert _met(small, large).rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_training_rows_are_spread(spark, monkeypatch):
    from rarebird.plans import models as mo

    vec = spark.range(100).coalesce(1)
    assert mo.spread(vec, "id", 100).rdd.getNumPartitions() == 1
    monkeypatch.setattr(mo, "ROWS", 30)
    assert mo.spread(vec, "id", 100).rdd.getNumPartitions() == 4


def test_approximate_search_in_few_dimensions_by_cells(spark, monkeypatch):
    """Buckets larger than cells: the k nearest rows that share a bucket, as by brute force; no bucket is compared whole
    unless a row has fewer than k candidates nearby, or an id has two places."""
    from rarebird.operators import neighbors

    rng = np.random.default_rng(3)
    x = np.concatenate([rng.normal(size=(1500, 3)), rng.normal(size=(40, 3)) * 0.01 + 4.0, [[90.0, 90.0, 90.0]]])
    x[200:230] = x[200]
    cols, ids = ["x", "y", "z"], np.arange(len(x))
    df = spark.createDataFrame([(int(i), *map(float, r)) for i, r in zip(ids, x)], "id long, x double, y double, z double").repartition(4).cache()

    def brute(x, ids, width, k):
        key = neighbors._hashes(3, 4, 3, width, 42)(x)
        out = {}
        for i in range(len(ids)):
            d2 = ((x - x[i]) ** 2).sum(1)
            near = {}
            for j in np.flatnonzero((key == key[i]).any(1)):
                if ids[j] != ids[i]:
                    near[int(ids[j])] = min(near.get(int(ids[j]), np.inf), float(d2[j]))
            for b, v in near.items():
                held = out.setdefault(int(ids[i]), {})
                held[b] = min(held.get(b, np.inf), v)
        return {i: sorted(near, key=lambda b: (near[b], b))[:k] for i, near in out.items()}

    def find(df, width):
        return knn_approximate(df, df, 4, cols, "id", exclude_self=True, width=width, tables=4, projections=3, audit=20)

    whole, calls = neighbors._whole_buckets, []
    monkeypatch.setattr(neighbors, "_whole_buckets", lambda a, *rest: calls.append(a.count()) or whole(a, *rest))
    _check(find(df.where("id < 1540"), 6.0)[0], brute(x[:1540], ids[:1540], 6.0, 4), "id", "nn_id")
    assert sum(calls) < 100
    del calls[:]
    _check(find(df, 0.4)[0], brute(x, ids, 0.4, 4), "id", "nn_id")
    assert 0 < sum(calls) < 1541
    del calls[:]
    twice = df.where("id < 300").union(df.where("id < 30").withColumn("x", F.col("x") + 0.1))
    find(twice, 2.0)
    assert sum(calls) == 330


def _two_classes(spark, n=900):
    """Minority on one side of a plane, so that most majority rows are far from it; ties and rows at one place."""
    rng = np.random.default_rng(11)
    x = np.round(rng.normal(size=(n, 3)) * 3, 2)
    x[40:60] = x[40]
    y = (x[:, 0] + rng.normal(size=n) * 0.5 > 2.5).astype(int)
    rows = [(i, *map(float, r), int(c)) for i, (r, c) in enumerate(zip(x, y, strict=True))]
    return x, y, spark.createDataFrame(rows, "id long, a double, b double, c double, y int").repartition(4)


def _tables(spark):
    """Scratch tables in the shared folder."""
    import os

    from rarebird.session import scratch_dir

    return {f for f in os.listdir(scratch_dir(spark).removeprefix("file:")) if f.startswith("rarebird-")}


def test_near_miss_keeps_only_its_result(spark, monkeypatch):
    """The chosen rows are those of brute force, far rows go down no box in the second search, and what the search wrote is gone."""
    from rarebird.operators import neighbors
    from rarebird.operators import sampling as sa
    from rarebird.spec import TableSpec

    monkeypatch.setattr(neighbors, "LEAF", 16)
    x, y, df = _two_classes(spark)
    small, large = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    d = np.sqrt(np.sort(((x[large][:, None] - x[small][None]) ** 2).sum(2), axis=1)[:, :3])
    mean = np.round(d.mean(1), 6)
    chosen = {int(large[i]) for i in np.lexsort((large, mean))[:len(small)]}
    seen, search = [], neighbors._search
    monkeypatch.setattr(neighbors, "_search", lambda pairs, *rest: seen.append(pairs.select("id").distinct().count()) or search(pairs, *rest))
    before = _tables(spark)
    got = sa.near_miss(df, TableSpec("id", "y", ("a", "b", "c")), 3)
    assert {r.id for r in got.collect()} == chosen | set(small.tolist())
    assert len(_tables(spark) - before) == 1
    assert seen[0] == len(large) and seen[1] < 0.6 * len(large)


def test_rows_of_repeated_ids_are_all_searched(spark):
    """An id at two places, near and far: its neighbours are the best of both rows, as without a bound."""
    b = spark.createDataFrame([(i, float(i), 0.0) for i in range(200)], "id long, x double, y double")
    a = spark.createDataFrame([(1000 + i // 2, float(i * 7 % 200), float(i % 2 * (i % 9))) for i in range(160)], "id long, x double, y double")
    every = {(r.id, r.nn): (r.nn_id, r.d2) for r in knn(a, b, 3, ["x", "y"], "id", leaf=16).collect()}
    some = {(r.id, r.nn): (r.nn_id, r.d2) for r in knn(a, b, 3, ["x", "y"], "id", leaf=16, least=10).collect()}
    assert some == every


def test_cell_gives_the_nearest_rows_of_all_its_boxes():
    """Rows of A against one cell of many boxes: bounds from the nearest box, level coordinates, fewer rows than k."""
    import pyarrow as pa

    from rarebird.operators.neighbors import _nearest

    rng = np.random.default_rng(5)
    for n, k in ((1, 3), (3, 3), (70, 3), (1000, 5), (1000, 80)):
        y = np.stack([np.round(rng.normal(size=n), 1), np.full(n, 2.0), rng.integers(0, 2, n).astype(float)], axis=1)
        x = np.concatenate([y[: min(n, 50)], rng.normal(size=(60, 3)) * 2])
        ids = np.arange(len(x))
        r = np.where(ids % 3 == 0, 0.5, np.nan)

        def batch(kind, ids, x, r):
            m = len(ids)
            return pa.RecordBatch.from_pydict({"key": pa.array(["c"] * m), "salt": pa.array([0] * m, pa.int32()), "kind": pa.array([kind] * m, pa.int32()), "id": pa.array(ids),
                                               "x": pa.array(x.tolist(), pa.list_(pa.float64())), "r": pa.array(r, pa.float64(), from_pandas=True)})

        got: dict[int, list] = {}
        for out in _nearest(3, k, True)([batch(0, np.arange(n), y, np.full(n, np.nan)), batch(1, ids, x, r)]):
            for i, d2, b in zip(*(out.column(c).to_pylist() for c in ("id", "d2", "b")), strict=True):
                got.setdefault(i, []).append((d2, b))
        for i in ids:
            d2 = sum((x[i, j] - y[:, j]) ** 2 for j in range(3))
            want = sorted((float(v), b) for b, v in enumerate(d2) if b != i and (np.isnan(r[i]) or v <= r[i]))[:k]
            assert got.get(int(i), []) == want
