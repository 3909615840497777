"""K nearest neighbours (Euclidean, ties by id), exact by a distributed kd-partition or approximate by hashing.

Exact:

1. B (the searched rows) is cut into cells by repeated distributed quantile splits: every cell
   of more than ``leaf`` rows is cut into at most ``FAN`` along its widest coordinate, by one
   grouped sketch and one join on the cell a round. Of rows at one place only the k
   smallest ids can be chosen (k + 1 with ``exclude_self``), so only these are kept, by a
   window whose group limit works before its shuffle; then every cell gets small enough.
2. The cells' boxes form a tree table. A row of A goes down it ``HOP`` levels at a time, from a box to
   those of its children that it reaches, so it never meets the other boxes of a level: the boxes
   below the root (some FAN ** HOP, a fixed bound) are broadcast, those below any other
   node meet the rows that reached it in one stream.
3. First each row searches the nearest cells that hold k rows; its k-th distance then says
   which other boxes can hold a nearer row, and only those are searched. The distance to
   a box is summed in the order of the distance to a row, so rounding can't drop one.
4. A cell and its rows of A meet in one stream: its rows of B, a bounded number, are held in boxes of
   ``PART`` rows, the rows of A pass in batches and are compared with the rows of those boxes that they
   reach. So cells can be large, and a row is sent to few of them. Cells that many rows of A reach are
   salted, their rows of B repeated for each salt. The second search gives only rows within the
   distance known from the first. The k best of all candidates are a window with a group limit,
   so no list of candidates is ever gathered. The work of a task lies in its rows, not in
   their bytes, so these shuffles have a number of partitions that AQE does not lower.
5. Where only the ``least`` smallest mean distances are asked for, the means of the first search bound
   the last of them. A row whose nearest box lies beyond that bound isn't searched a second time, and
   no row further than its own neighbours can be.

Approximate (:func:`knn_approximate`, the caller's choice and never made by size): p-stable hashing
(Datar et al., 2004) puts rows into the buckets of several tables; the candidates of a row are the
rows of its buckets. Buckets of a given width grow with the table, so in few dimensions the cells of the
exact search find the nearest candidates: a row of a cell counts if it shares a bucket, and the k-th
distance to such rows says which other cells to search. Rows that meet fewer than k candidates in the
nearest cells, and all rows in many dimensions, are held against their whole buckets, in chunks. The
rows are the same either way. The recall is measured on some rows and returned.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rarebird.functions import hash_int, required
from rarebird.operators.selecting import nth_smallest
from rarebird.session import materialize, passing, target_partitions

#: Children of a cell, and levels of cells a row goes down at once.
FAN, HOP = 8, 4
#: Rows of A that meet one cell in one task, and rows of A that go down the boxes together.
MEET, SLICE = 1 << 14, 1024
#: Distances held at once.
HELD = 1 << 16
#: Rows of B in a cell, and in a box inside a cell, in few dimensions.
LEAF, PART = 4096, 64


# ------------------------------------------------------------------ cells of B

def _points(df: DataFrame, id_col: str, cols: list[str]) -> DataFrame:
    """(id, x): null and NaN coordinates raise, as no distance to them is defined."""
    value = [required(F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double")), c) for c in cols]
    return df.select(F.col(id_col).cast("bigint").alias("id"), F.array(*value).alias("x"))


def _nearest_of_each_place(b: DataFrame, keep: int) -> DataFrame:
    order = Window.partitionBy("x").orderBy("id")
    return b.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= keep).drop("_n")


def cells(b: DataFrame, d: int, leaf: int) -> DataFrame:
    """(id, x, cell): a cell of more than ``leaf`` rows holds rows of one place only. A cell's name has
    a digit for each level, so its ancestors are its prefixes; the root's is empty. A cell is cut into FAN, or
    into 4 or 2 where these are enough."""
    pending = materialize(b.select("id", "x", F.lit("").alias("cell")), "knn-cells")
    done = []
    at = [F.get("x", j) for j in range(d)]
    while True:
        sizes = (pending.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.array(*[F.var_pop(v) for v in at]).alias("var"), F.array(*[F.max(v) for v in at]).alias("top"),
                                             F.array(*[F.avg(v) for v in at]).alias("mean")))
        widest = F.array_position("var", F.array_max("var")).cast("int") - 1
        sizes = sizes.select("cell", "n", widest.alias("j"), (F.array_max("var") > 0).alias("wide"), F.get("top", widest).alias("top"), F.get("mean", widest).alias("mean"))
        sizes = materialize(sizes.withColumn("big", (F.col("n") > leaf) & F.col("wide")), "knn-sizes")
        if sizes.where("big").isEmpty():
            return _union([*done, pending])
        rows = pending.join(sizes.select("cell", "big", "j", "top", "mean", "n"), "cell")
        done.append(rows.where(~F.col("big")).select("id", "x", "cell"))
        big = rows.where("big").withColumn("v", F.get("x", F.col("j")))
        quantiles = F.percentile_approx("v", [i / FAN for i in range(1, FAN)], 100 * FAN)
        # thresholds below the largest value; where there are none, the mean lies below it
        cuts = big.groupBy("cell").agg(quantiles.alias("q"), F.first("top").alias("top"), F.first("mean").alias("mean"), F.first("n").alias("n"))
        each = F.when(F.col("n") <= 2 * leaf, FAN // 2).when(F.col("n") <= 4 * leaf, FAN // 4).otherwise(1)
        cuts = cuts.withColumn("q", F.filter("q", lambda c, i: (i + 1) % each == 0))
        below = F.array_distinct(F.filter("q", lambda c: c < F.col("top")))
        cuts = cuts.select("cell", F.when(F.size(below) > 0, below).otherwise(F.array("mean")).alias("cuts"))
        child = F.size(F.filter("cuts", lambda c: c < F.col("v")))
        pending = materialize(big.drop("top", "mean", "n").join(cuts, "cell").select("id", "x", F.concat("cell", child.cast("string")).alias("cell")), "knn-cells")


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _boxes(b_cells: DataFrame, d: int, hop: int) -> tuple[list[DataFrame], list]:
    """(tables of (key = a box ``hop`` levels up or less, box, n, flag = is a cell, x = lowest, y = highest), one
    for each hop below the first; the boxes of the first hop, collected)."""
    at = [F.get("x", j) for j in range(d)]
    leaves = materialize(b_cells.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.array(*[F.min(v) for v in at]).alias("lo"), F.array(*[F.max(v) for v in at]).alias("hi")), "knn-boxes")
    deepest = leaves.agg(F.max(F.length("cell"))).first()[0] or 0
    tables = []
    for h in range(max(1, -(-deepest // hop))):
        # a cell is one of its own boxes, and below all boxes between the key and itself
        first = F.lit(h * hop + 1) if h else F.least(F.lit(1), F.length("cell"))
        depth = F.explode(F.sequence(first, F.least(F.length("cell"), F.lit((h + 1) * hop))))
        below = leaves.where((F.length("cell") > h * hop) | F.lit(h == 0)).select("cell", "n", "lo", "hi", depth.alias("depth")).select(
            F.substring("cell", 1, h * hop).alias("key"), F.expr("substring(cell, 1, depth)").alias("box"), (F.length("cell") == F.col("depth")).alias("flag"), "n", "lo", "hi")
        lo, hi = [F.min(F.get("lo", j)) for j in range(d)], [F.max(F.get("hi", j)) for j in range(d)]
        tables.append(below.groupBy("key", "box").agg(F.sum("n").alias("n"), F.max("flag").alias("flag"), F.array(*lo).alias("x"), F.array(*hi).alias("y")))
    return tables[1:], tables[0].orderBy("box").collect()  # some FAN ** HOP rows at most


class _Tree:
    """The boxes below one key: ``children`` of box i are at row i + 1 (-1: none), those of the key at row 0."""

    def __init__(self, names, flag, n, lo, hi):
        order = np.argsort(names)  # the same order each time: equally near boxes go by it
        self.names, self.cell, self.n, self.lo, self.hi = names[order], flag[order], n[order], lo[order], hi[order]
        at = {name: i for i, name in enumerate(self.names)}
        below: list[list[int]] = [[] for _ in range(len(at) + 1)]
        for name, i in at.items():
            below[at.get(name[:-1], -1) + 1 if name else 0].append(i)
        self.children = np.full((len(below), max(map(len, below), default=0)), -1)
        for row, some in enumerate(below):
            self.children[row, :len(some)] = some
        # boxes that rows are named for: cells, and those that have no boxes here
        self.last = np.array([not some for some in below[1:]], bool)


# ------------------------------------------------------------------ streams of a few rows and many

def _matrix(column, d: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


def _streams(batches, small, large):
    """Rows sorted by (key, salt, kind): the rows of kind 0 of a key are held as ``small(rows)``, the others
    pass in batches as ``large(held, rows)``."""
    import pyarrow as pa

    now, parts, held = None, [], None
    for b in batches:
        key, salt, kind = (b.column(c).to_numpy(zero_copy_only=False) for c in ("key", "salt", "kind"))
        edge = np.flatnonzero((key[1:] != key[:-1]) | (salt[1:] != salt[:-1]) | (kind[1:] != kind[:-1])) + 1
        ends = [0, *edge.tolist(), b.num_rows]
        for x, y in zip(ends, ends[1:], strict=False):
            if x == y:
                continue
            if (key[x], salt[x]) != now:
                now, parts, held = (key[x], salt[x]), [], None
            part = b.slice(x, y - x)
            if kind[x] == 0:
                parts.append(part)
            elif parts:
                if held is None:
                    held = small(pa.Table.from_batches(parts).combine_chunks().to_batches()[0])
                yield from large(held, part)


def _met(small: DataFrame, large: DataFrame) -> DataFrame:
    """Rows of ``small`` (key, id, box, n, flag, x, y) and ``large`` (key, id, flag, x, r), the small ones of a key before
    its large ones; keys with many large rows are salted, their small rows repeated."""
    # the salts of keys with more than MEET rows: others have one
    busy = large.groupBy("key").agg(F.count(F.lit(1)).alias("m")).where(F.col("m") > MEET).select("key", F.ceil(F.col("m") / MEET).cast("int").alias("salts"))
    salts = F.coalesce("salts", F.lit(1))
    busy = F.broadcast(busy)  # one row for each MEET rows at most
    a = large.join(busy, "key", "left").select("key", F.pmod(F.xxhash64("id"), salts).cast("int").alias("salt"), F.lit(1).alias("kind"), "id", F.lit(None).cast("string").alias("box"),
                                               F.lit(None).cast("long").alias("n"), "flag", "x", F.lit(None).cast("array<double>").alias("y"), "r")
    b = small.join(busy, "key", "left").withColumn("salt", F.explode(F.sequence(F.lit(0), salts - 1))).select(
        "key", "salt", F.lit(0).alias("kind"), "id", "box", "n", "flag", "x", "y", F.lit(None).cast("double").alias("r"))
    both = a.union(b)
    return both.repartition(target_partitions(both), "key", "salt").sortWithinPartitions("key", "salt", "kind")


def _reach(tree: _Tree, k: int, x, flag, r, ball: bool):
    """(row, box, near) of rows ``x`` going down ``tree``: to the nearest children that hold k rows or, with
    ``ball``, to those within the squared distance ``r``. ``near`` says that the row has searched
    that box's nearest cells before. All boxes of a row come together."""
    for at in range(0, len(x), SLICE):
        row = np.arange(at, min(at + SLICE, len(x)))
        node, near = np.full(len(row), -1), flag[row]
        found = []
        while len(row):
            some = HELD // tree.children.shape[1] if tree.children.shape[1] else len(row)
            parts = [_children(tree, k, x, row[i:i + some], node[i:i + some], near[i:i + some], r, ball) for i in range(0, len(row), some)]
            row, node, near = (np.concatenate(p) for p in zip(*parts, strict=True))
            last = tree.last[node]
            if last.any():
                found.append((row[last], node[last], near[last]))
            row, node, near = row[~last], node[~last], near[~last]
        if found:
            yield tuple(np.concatenate(p) for p in zip(*found, strict=True))


def _children(tree: _Tree, k: int, x, row, node, flag, r, ball: bool):
    child = tree.children[node + 1]
    gap = _gaps(tree, x, row, child)
    there = child >= 0
    gap = np.where(there, gap, np.inf)
    n = np.where(there, tree.n[child], 0)
    order = np.argsort(gap, axis=1, kind="stable")
    held = np.take_along_axis(n, order, axis=1)
    near = np.zeros(gap.shape, bool)
    np.put_along_axis(near, order, np.cumsum(held, axis=1) - held < k, axis=1)
    near &= flag[:, None] & there
    at, i = np.nonzero((gap <= r[row][:, None]) & there if ball else near)
    return row[at], child[at, i], near[at, i]


def _gaps(tree: _Tree, x, row, child):
    """Squared distances of each row to its ``child`` boxes, a row of them."""
    gap = None
    for j in range(x.shape[1]):
        v = x[row, j][:, None]
        g = np.maximum(np.maximum(tree.lo[child, j] - v, v - tree.hi[child, j]), 0.0)
        gap = g * g if gap is None else gap + g * g
    return np.zeros(child.shape) if gap is None else gap


def _down(d: int, k: int, ball: bool, top=None, most: float | None = None, mean_of: int = 1):
    """Task function: rows of A to the boxes they reach -> (key = box, id, flag, cell, x, r). With ``most``, only as far
    as a row's ``mean_of`` nearest can lie if their mean distance is ``most`` at most."""
    def pairs(tree, part):
        import pyarrow as pa

        ids, x = np.asarray(part.column("id")), _matrix(part.column("x"), d)
        flag, r = np.asarray(part.column("flag")), np.asarray(part.column("r"))
        for row, box, near in _reach(tree, k, x, flag, r, ball):
            if most is not None:  # the others are as far as the nearest box at least, and leave so much for the last
                gap = _gaps(tree, x, row, box[:, None])[:, 0]
                least = np.full(len(x), np.inf)
                np.minimum.at(least, row, gap)
                left = (mean_of * most - (mean_of - 1) * np.sqrt(least)) * (1 + 1e-9)
                r = np.where(np.isfinite(least), np.minimum(r, np.where(least <= most * most, left * left, -1.0)), r)
                ok = gap <= r[row]
                row, box, near = row[ok], box[ok], near[ok]
            if ball:  # cells whose rows were searched the first time
                fresh = ~(near & tree.cell[box])
                row, box, near = row[fresh], box[fresh], near[fresh]
            if len(row):
                yield pa.RecordBatch.from_arrays([pa.array(tree.names[box], pa.string()), pa.array(ids[row]), pa.array(near), pa.array(tree.cell[box]),
                                                  part.column("x").take(pa.array(row)), pa.array(r[row])], names=["key", "id", "flag", "cell", "x", "r"])

    def small(part):
        return _Tree(part.column("box").to_numpy(zero_copy_only=False), np.asarray(part.column("flag")), np.asarray(part.column("n")), _matrix(part.column("x"), d), _matrix(part.column("y"), d))

    def run(batches):
        if top is None:
            yield from _streams(batches, small, pairs)
        else:
            for b in batches:
                if b.num_rows:
                    yield from pairs(top, b)

    return run


def _descend(a: DataFrame, top: list, tables: list[DataFrame], d: int, k: int, ball: bool, most: float | None = None, mean_of: int = 1) -> DataFrame:
    """(key = cell, id, flag, x, r) for each cell that a row of ``a`` (id, x, r) must search."""
    held = _Tree(np.array([t.box for t in top], object), np.array([t.flag for t in top], bool), np.array([t.n for t in top], np.int64),
                 np.array([t.x for t in top]).reshape(-1, d), np.array([t.y for t in top]).reshape(-1, d))
    kind = "key string, id long, flag boolean, cell boolean, x array<double>, r double"
    rows = a.select("id", F.lit(True).alias("flag"), "x", "r")
    pairs = rows.repartition(target_partitions(rows), "id").mapInArrow(_down(d, k, ball, held, most, mean_of), kind)
    found = []
    for boxes in tables:
        pairs = materialize(pairs, "knn-pairs")
        found.append(pairs.where("cell"))
        pairs = _met(boxes.withColumn("id", F.lit(None).cast("long")), pairs.where("NOT cell")).mapInArrow(_down(d, k, ball), kind)
    return _union([*found, pairs]).drop("cell")


def _parts(y: np.ndarray) -> list[np.ndarray]:
    """Rows ``y`` in boxes of ``PART`` rows at most, by halves of the widest coordinate: the rows of each."""
    todo, done = [np.arange(len(y))], []
    while todo:
        some = todo.pop()
        if len(some) <= PART:
            done.append(some)
            continue
        at = y[some]
        half = len(some) // 2
        order = np.argpartition(at[:, int(np.argmax(at.max(axis=0) - at.min(axis=0)))], half)
        todo += [some[order[:half]], some[order[half:]]]
    return done


class _Cell:
    """The rows of B in one cell: the boxes of a cell and their rows, side by side."""

    def __init__(self, ids, y) -> None:
        parts = _parts(y)
        width = max(map(len, parts))
        self.ids, self.n = ids, np.array([len(p) for p in parts])
        self.rows = np.zeros((len(parts), width), np.int64)
        for i, p in enumerate(parts):
            self.rows[i, :len(p)] = p
        there = np.arange(width) < self.n[:, None]
        # no distance to what is missing is below another
        self.y = [np.where(there, y[self.rows, j], np.nan) for j in range(y.shape[1])]
        self.lo, self.hi = ([f(v, axis=1) for v in self.y] for f in (np.nanmin, np.nanmax))
        # a coordinate that is level in all boxes
        self.level = [bool((lo == hi).all()) for lo, hi in zip(self.lo, self.hi, strict=True)]

    def gaps(self, x: np.ndarray) -> np.ndarray:
        gap = np.zeros((len(x), len(self.n)))
        for j, (lo, hi) in enumerate(zip(self.lo, self.hi, strict=True)):
            v = x[:, j][:, None]
            g = np.maximum(np.maximum(lo - v, v - hi), 0.0)
            gap += np.multiply(g, g, out=g)
        return gap

    def distances(self, x: np.ndarray, box: np.ndarray) -> np.ndarray:
        """Squared distances of each row to the rows of its box, summed coordinate by coordinate, as the SQL does."""
        d2 = np.zeros((len(x), self.rows.shape[1]))
        for j, y in enumerate(self.y):
            diff = x[:, j][:, None] - (self.lo[j][box][:, None] if self.level[j] else y[box])
            d2 += np.multiply(diff, diff, out=diff)
        if self.y and all(self.level):  # missing rows are as near as the others then
            d2[np.arange(d2.shape[1]) >= self.n[box][:, None]] = np.nan
        return d2


def _nearest(d: int, k: int, exclude_self: bool, hashes=None):
    """Task function: the k nearest rows of its cell for each row of A -> (id, d2, b); with ``hashes``, the
    k nearest that share one with it."""
    need = k + 1 if exclude_self else k

    def small(part):
        ids, y = np.asarray(part.column("id")), _matrix(part.column("x"), d)
        if hashes is None:
            return _Cell(ids, y)
        # many coordinates are level in a cell
        return ids, np.ascontiguousarray(y.T), (y == y[:1]).all(axis=0), hashes(y)

    def within(cell, ids, x, row, box, edge):
        """(row, row of B, d2) of the pairs of ``row`` and ``box``, up to the squared distance ``edge``."""
        step = max(1, HELD // cell.rows.shape[1])
        for at in range(0, len(row), step):
            some, place = row[at:at + step], box[at:at + step]
            d2 = cell.distances(x[some], place)
            i, col = np.nonzero(d2 <= edge[some][:, None])
            b, value = cell.rows[place[i], col], d2[i, col]
            if exclude_self:
                other = ids[some[i]] != cell.ids[b]
                i, b, value = i[other], b[other], value[other]
            yield some[i], b, value

    def bounds(cell, ids, x, gap, edge):
        """``edge`` made finite by the boxes nearest to a row that hold k others."""
        loose, edge = np.flatnonzero(~np.isfinite(edge)), edge.copy()
        box = np.argmin(gap[loose], axis=1)
        few = cell.n[box] < need
        row, first = loose[~few], box[~few]
        step = max(1, HELD // cell.rows.shape[1])
        for at in range(0, len(row), step):
            some, place = row[at:at + step], first[at:at + step]
            d2 = cell.distances(x[some], place)
            if exclude_self:
                d2[cell.ids[cell.rows[place]] == ids[some][:, None]] = np.nan
            last = np.partition(d2, k - 1, axis=1)[:, k - 1]  # what is missing comes last
            edge[some] = np.where(np.isnan(last), np.inf, last)
        if few.any():
            row = loose[few]
            order = np.argsort(gap[row], axis=1, kind="stable")
            held = cell.n[order]
            i, at = np.nonzero(np.cumsum(held, axis=1) - held < need)
            got = [*within(cell, ids, x, row[i], order[i, at], edge)]
            row, _, value = (np.concatenate(p) for p in zip(*got, strict=True))
            order = np.lexsort((value, row))
            row, value = row[order], value[order]
            last = np.arange(len(row)) - np.searchsorted(row, row) == k - 1
            edge[row[last]] = value[last]
        return edge

    def by_boxes(cell, part):
        ids, x, r = _rows(part)
        step = max(1, 2 * HELD // len(cell.n))
        for at in range(0, len(ids), step):
            some = slice(at, at + step)
            own, rows, edge = ids[some], x[some], r[some]
            gap = cell.gaps(rows)
            if not np.isfinite(edge).all():
                edge = bounds(cell, own, rows, gap, edge)
            got = [*within(cell, own, rows, *np.nonzero(gap <= edge[:, None]), edge)]
            if got:
                row, b, value = (np.concatenate(p) for p in zip(*got, strict=True))
                yield from _best(own, row, value, cell.ids[b])

    def _rows(part):
        return np.asarray(part.column("id")), _matrix(part.column("x"), d), part.column("r").fill_null(np.inf).to_numpy(zero_copy_only=False)

    def _best(ids, row, value, b):
        import pyarrow as pa

        order = np.lexsort((b, value, row))
        row, b, value = row[order], b[order], value[order]
        keep = np.arange(len(row)) - np.searchsorted(row, row) < k
        row, b, value = row[keep], b[keep], value[keep]
        if len(row):
            yield pa.RecordBatch.from_arrays([pa.array(ids[row]), pa.array(value), pa.array(b)], names=["id", "d2", "b"])

    def best(d2, edge):
        if d2.shape[1] > k and not np.isfinite(edge).all():
            # the k smallest, and all that tie with the last of them, in order of id
            edge = np.minimum(edge, np.partition(d2, k - 1, axis=1)[:, k - 1:k])
        return np.nonzero((d2 <= edge) & (d2 < np.inf))

    def by_hashes(held, part):
        b_ids, y, level, b_hashes = held
        ids, x, r = _rows(part)
        step = max(1, HELD // len(b_ids))
        for at in range(0, len(ids), step):
            some = slice(at, at + step)
            # summed coordinate by coordinate, as the SQL does
            d2 = np.zeros((len(ids[some]), len(b_ids)))
            for j in range(d):
                diff = x[some, j][:, None] - (y[j, :1] if level[j] else y[j])
                d2 += np.multiply(diff, diff, out=diff)
            if exclude_self:
                d2 = np.where(ids[some][:, None] == b_ids[None], np.inf, d2)
            row, col = best(d2, r[some][:, None])
            a_hashes = hashes(x[some])
            apart = ~(a_hashes[row] == b_hashes[col]).any(axis=1)
            if apart.any():  # most rows share a bucket with all their nearest
                odd = np.unique(row[apart])
                shares = np.zeros((len(odd), len(b_ids)), bool)
                for t in range(b_hashes.shape[1]):
                    shares |= a_hashes[odd, t][:, None] == b_hashes[:, t]
                d2[odd] = np.where(shares, d2[odd], np.inf)
                row, col = best(d2, r[some][:, None])
            yield from _best(ids[some], row, d2[row, col], b_ids[col])

    def run(batches):
        yield from _streams(batches, small, by_boxes if hashes is None else by_hashes)

    return run


def _search(pairs: DataFrame, b_cells: DataFrame, d: int, k: int, exclude_self: bool, hashes=None) -> DataFrame:
    small = b_cells.select(F.col("cell").alias("key"), "id", F.lit(None).cast("string").alias("box"), F.lit(None).cast("long").alias("n"), F.lit(None).cast("boolean").alias("flag"), "x",
                           F.lit(None).cast("array<double>").alias("y"))
    return _met(small, pairs).mapInArrow(_nearest(d, k, exclude_self, hashes), "id long, d2 double, b long")


def _first(found: DataFrame, k: int) -> DataFrame:
    best = Window.partitionBy("id").orderBy("d2", "b")
    return found.withColumn("nn", F.row_number().over(best).cast("int")).where(F.col("nn") <= k)


def _named(found: DataFrame, a_id: str, b_id: str) -> DataFrame:
    return found.select(F.col("id").alias(a_id), "nn", F.col("b").alias(f"nn_{b_id}" if b_id == a_id else b_id), "d2")


def knn(A: DataFrame, B: DataFrame, k: int, cols: list[str], a_id: str, b_id: str | None = None, exclude_self: bool = False,
        leaf: int | None = None, hop: int = HOP, least: int | None = None) -> DataFrame:
    """(a_id, nn, b_id, d2): for every row of A its k nearest rows of B, nn = 1..k, ordered by
    (squared distance, B id); fewer where B has fewer. ``exclude_self`` skips B rows with A's id.
    A null or NaN coordinate raises. In many dimensions a row reaches most cells and goes to each of
    them, so there cells are larger: ``leaf`` rows, 4096 up to 45 dimensions and 8192 in 64.
    With ``least``, neighbours are exact for the ``least`` rows with the smallest mean distances rounded to 6
    digits and all that tie with them; rows with larger means may have farther rows of B in their place."""
    b_id, d = b_id or a_id, len(cols)
    held = _Held(_points(B, b_id, cols), d, k, exclude_self, leaf or max(LEAF, _leaf(d)), hop)
    return _named(held.exact(materialize(_points(A, a_id, cols), "knn-a"), least), a_id, b_id)


def _leaf(d: int) -> int:
    return 512 * max(1, d * d // 256)


class _Held:
    """The cells and boxes of B (id, x), for searches of the k nearest."""

    def __init__(self, b: DataFrame, d: int, k: int, exclude_self: bool, leaf: int, hop: int = HOP) -> None:
        self.d, self.k, self.exclude_self, self.keep = d, k, exclude_self, k + 1 if exclude_self else k
        with passing(b.sparkSession):
            self.cells = materialize(cells(_nearest_of_each_place(b, self.keep), d, max(leaf, self.keep)), "knn-b", keep=True)
        self.tables, self.top = _boxes(self.cells, d, hop)

    def search(self, a: DataFrame, ball: bool, hashes=None, most: float | None = None) -> DataFrame:
        pairs = _descend(a, self.top, self.tables, self.d, self.keep, ball, most, self.k)
        return _search(pairs, self.cells, self.d, self.k, self.exclude_self, hashes)

    def nearest_cells(self, a: DataFrame, hashes=None) -> DataFrame:
        """(id, d2, b) of the nearest cells' rows, the k best of an id."""
        with passing(a.sparkSession):
            found = self.search(a.withColumn("r", F.lit(float("inf"))), False, hashes)
            return materialize(_first(found if hashes is None else _once(found), self.k), "knn-first", keep=True)

    def exact(self, a: DataFrame, least: int | None = None) -> DataFrame:
        """(id, nn, b, d2) for ``a`` (id, x)."""
        first = self.nearest_cells(a)
        most = None if least is None else self._most(a, first, least)
        near = materialize(a.join(_reached(first, self.k), "id", "left").withColumn("r", F.coalesce("r", F.lit(float("inf")))), "knn-reach")
        return _first(first.select("id", "d2", "b").union(self.search(near, True, most=most)), self.k)

    def _most(self, a: DataFrame, first: DataFrame, least: int) -> float | None:
        """A bound of the ``least`` smallest mean distances, from those of the first search; none where it has fewer, or
        where the neighbours of an id are those of several rows. Means equal when rounded to 6 digits lie within it."""
        if not a.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("n > 1 OR id IS NULL").isEmpty():
            return None
        means = first.groupBy("id").agg(F.avg(F.sqrt("d2")).alias("u"), F.count(F.lit(1)).alias("m")).where(F.col("m") == self.k)
        keys = materialize(means.select(F.ceil(F.col("u") * 1e6).cast("bigint").alias("key")), "knn-means")
        if least < 1 or keys.count() < least:
            return None
        return (nth_smallest(keys, least, 64)[0] + 2) / 1e6 * (1 + 1e-9)


def _once(found: DataFrame) -> DataFrame:
    return found.groupBy("id", "b").agg(F.min("d2").alias("d2"))


def _reached(first: DataFrame, k: int) -> DataFrame:
    return first.groupBy("id").agg(F.max("d2").alias("r"), F.count(F.lit(1)).alias("m")).select("id", F.when(F.col("m") == k, F.col("r")).otherwise(float("inf")).alias("r"))


# ------------------------------------------------------------------ approximate search

#: Dimensions up to which boxes prune well enough to find the nearest rows of large buckets.
FEW = 22


def _hashes(d: int, tables: int, projections: int, width: float, seed: int):
    """Rows -> the names of their buckets, one of each table."""
    rng = np.random.default_rng(seed)
    w, shift = rng.normal(size=(tables, projections, d)), rng.uniform(0, width, size=(tables, projections))
    mix = rng.integers(1, 1 << 62, size=projections) * 2 + 1

    def of(x: np.ndarray) -> np.ndarray:
        # coordinate by coordinate: a row has the same buckets in any batch
        at = np.broadcast_to(shift, (len(x), tables, projections)).copy()
        for j in range(d):
            at += x[:, j, None, None] * w[:, :, j]
        # equal hashes of different buckets only add candidates
        return (np.floor(at / width).astype(np.int64) * mix).sum(2) * tables + np.arange(tables)

    return of


def _buckets(d: int, hashes):
    def run(batches):
        import pyarrow as pa

        for b in batches:
            key = hashes(_matrix(b.column("x"), d))
            for t in range(key.shape[1]):
                yield pa.RecordBatch.from_arrays([b.column("id"), b.column("x"), pa.array(np.ascontiguousarray(key[:, t]))], names=["id", "x", "bucket"])

    return run


def _whole_buckets(a: DataFrame, b: DataFrame, d: int, k: int, exclude_self: bool, hashes, chunk: int) -> DataFrame:
    """(id, nn, b, d2): every row of ``a`` against all rows of ``b`` in its buckets."""
    hashed = lambda df: df.mapInArrow(_buckets(d, hashes), "id long, x array<double>, bucket long")
    a, b = hashed(a), hashed(b)
    b = b.join(a.select("bucket").distinct(), "bucket", "left_semi")
    # buckets go in chunks of some ``chunk`` rows, each a cell of its own
    sizes = b.groupBy("bucket").agg(F.ceil(F.count(F.lit(1)) / chunk).cast("int").alias("chunks"))
    cell = lambda part: F.concat_ws("-", F.col("bucket").cast("string"), part.cast("string"))
    b_cells = materialize(b.join(sizes, "bucket").select("id", "x", cell(F.pmod(F.xxhash64("id"), F.col("chunks")).cast("int")).alias("cell")), "knn-b")
    a = a.join(sizes, "bucket").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    pairs = a.select(cell(F.col("part")).alias("key"), "id", F.lit(True).alias("flag"), "x", F.lit(None).cast("double").alias("r"))
    return _first(_once(_search(pairs, b_cells, d, k, exclude_self)), k)


def _boxed_buckets(a: DataFrame, b: DataFrame, held: _Held, hashes, chunk: int) -> DataFrame:
    """As :func:`_whole_buckets`, by the cells of ``b``; its ids must differ."""
    k = held.k
    first = held.nearest_cells(a, hashes)
    reach = materialize(a.join(_reached(first, k), "id", "left").withColumn("r", F.coalesce("r", F.lit(float("inf")))), "knn-reach")
    near = reach.where(F.col("r") < float("inf"))
    found = _first(_once(first.select("id", "d2", "b").join(near.select("id").distinct(), "id", "left_semi").union(held.search(near, True, hashes))), k)
    # fewer than k candidates in the nearest cells: no distance bounds the search
    rest = reach.where(F.col("r") == float("inf")).select("id", "x")
    return found if rest.isEmpty() else found.unionByName(_whole_buckets(rest, b, held.d, k, held.exclude_self, hashes, chunk))


def knn_approximate(A: DataFrame, B: DataFrame, k: int, cols: list[str], a_id: str, b_id: str | None = None, exclude_self: bool = False, width: float = 1.0,
                    tables: int = 16, projections: int = 8, seed: int = 42, chunk: int = 512, audit: int = 256) -> tuple[DataFrame, float]:
    """(rows as :func:`knn` returns them, measured recall): rows of B that share a bucket with a row of A in
    one of the ``tables`` tables of ``projections`` hashes of cell ``width`` are its candidates. Recall is the
    share of the true neighbours found for ``audit`` rows of A, first in md5(seed-id) order, which the search of
    :func:`knn` finds too. A row without candidates has no rows; more tables or a larger width find more."""
    b_id, d = b_id or a_id, len(cols)
    hashes = _hashes(d, tables, projections, width, seed)
    a, b = materialize(_points(A, a_id, cols), "knn-a"), materialize(_points(B, b_id, cols), "knn-b-points")
    held = _Held(b, d, k, exclude_self, _leaf(d))
    # a null id, or one at several places, would take the places of others among a cell's k best
    odd = b.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("n > 1 OR id IS NULL")
    if d <= FEW and odd.isEmpty():
        found = _boxed_buckets(a, b, held, hashes, chunk)
    else:
        found = _whole_buckets(a, b, d, k, exclude_self, hashes, chunk)
    rows = materialize(_named(found, a_id, b_id), "knn-approximate")
    some = A.orderBy(hash_int(seed, a_id), a_id).limit(audit)
    name = f"nn_{b_id}" if b_id == a_id else b_id
    true = materialize(_named(held.exact(materialize(_points(some, a_id, cols), "knn-some")), a_id, b_id).select(a_id, name), "knn-true")
    total, hit = true.count(), true.join(rows.select(a_id, name), [a_id, name], "left_semi").count()
    return rows, hit / total if total else 1.0
