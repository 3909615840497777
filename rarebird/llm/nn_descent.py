"""Embedding near-duplicates by NN-descent.

1. Equal vectors are one vertex (smallest id, number of copies).
2. First lists: vectors are sorted by random-hyperplane codes, ``TABLES`` times, and compared
   within blocks of neighbours in that order; a bucket of any size is only a longer run of
   blocks, cut by range over many tasks.
3. Rounds: vectors that stand in the same list, forward or reverse, are compared with each
   other; what beats the last entry of either's list is emitted, and every vertex keeps its
   ``K`` best. Where all of them are links the list is saturated and grows to ``GROWN``,
   also by weaker links. A vertex in very many lists is dealt into groups of about ``GROUP``.
   Rounds end when one changes no list.
4. The lists steer the search only. Every pair that a block or a round finds to be a link
   joins its vertices, whether a list takes it or not: a task sends a spanning forest of the
   links that it met.
5. Joined vertices are components. One that stands near another (angle between the centres at
   most both radii and the threshold's angle; looked for as in 2, a component being one
   row) is held against it by block products, until no two of them join. Inside a component of
   any size all pairs are compared by block products, which return counts and no pairs: so
   no list is too short for the number of links.
6. Recall is audited: ``AUDIT`` vectors are held against all others by brute force. The figure
   is the share of those with links whose number of links is right, each component
   counting once. Below ``RECALL`` the search goes on with new first lists, added to what is
   known, and after ``TRIES`` of them all vectors are held against all others.

Vectors that are null, zero, empty or hold null or non-finite components are no vertices.
Shorter vectors count as filled up with zeros.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from rarebird.llm.components import components, forest
from rarebird.llm.tables import materialize

THRESHOLD = 0.95
TABLES, BLOCK, K, GROWN, GROUP = 6, 256, 12, 48, 48
TRIES = 3
#: Documented bound of the audit's queries, and the recall that ends the search.
AUDIT, RECALL = 2048, 0.98
#: Rows of a component that are multiplied at once.
PRODUCT = 1024
#: Links that a task holds before it sends their forest.
HELD = 1 << 18
PAIRS = "v long, u long, sim double, joined boolean"


def unit(raw: list[bytes], dims: int) -> np.ndarray:
    """Rows of doubles of length 1. Scaling by the largest component first keeps squares finite."""
    x = np.frombuffer(b"".join(raw), np.float64).reshape(-1, dims)
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def groups(batches, *keys: str):
    """Consecutive rows with equal keys, of sorted batches, as one record batch each."""
    import pyarrow as pa

    held: list[pa.RecordBatch] = []
    last = None
    for b in batches:
        if not b.num_rows:
            continue
        cols = [np.asarray(b.column(k)) for k in keys]
        edge = np.any([c[1:] != c[:-1] for c in cols], axis=0)
        starts = [0, *(np.flatnonzero(edge) + 1).tolist(), b.num_rows]
        for a, e in zip(starts[:-1], starts[1:], strict=True):
            key = tuple(c[a] for c in cols)
            if held and key != last:
                yield pa.concat_batches(held)
                held = []
            held.append(b.slice(a, e - a))
            last = key
    if held:
        yield pa.concat_batches(held)


def _pack(dims: int):
    def run(batches):
        import pyarrow as pa

        for b in batches:
            out = []
            for v in b.column("v").to_pylist():
                x = np.zeros(dims)
                x[:len(v)] = v
                out.append(x.tobytes())
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("copies"), pa.array(out, pa.binary())], names=["id", "copies", "vec"])

    return run


def _codes(planes, dims: int, *also: str):
    """For each table: a vector's side of the hyperplanes, and its place along one more direction; columns ``also`` as they are."""
    def run(batches):
        import pyarrow as pa

        for b in batches:
            if not b.num_rows:
                continue
            x = unit(b.column("vec").to_pylist(), dims)
            for t, p in enumerate(planes.value):
                side = x @ p
                code = ((side[:, 1:] > 0) << np.arange(side.shape[1] - 1)).sum(1) if side.shape[1] > 1 else np.zeros(len(x), np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(x), t, np.int32)), pa.array(code.astype(np.int64)), pa.array(side[:, 0]), b.column("id"), b.column("vec"),
                     *map(b.column, also)], names=["t", "code", "along", "id", "vec", *also])

    return run


def _best(ids: np.ndarray, sim: np.ndarray, k: int, threshold: float):
    """(v, u, sim): the k most similar others of each row, and all that are links up to GROWN."""
    most = min(max(k, GROWN), len(ids) - 1)
    if most < 1:
        return None
    top = np.argpartition(-sim, most - 1, axis=1)[:, :most]
    got = np.take_along_axis(sim, top, 1)
    order = np.argsort(-got, axis=1, kind="stable")
    top, got = np.take_along_axis(top, order, 1), np.take_along_axis(got, order, 1)
    rows, at = np.nonzero((np.arange(most) < k) | (got >= threshold))
    return ids[rows], ids[top[rows, at]], got[rows, at]


def _pairs_out(v, u, s):
    import pyarrow as pa

    return pa.RecordBatch.from_arrays([pa.array(v), pa.array(u), pa.array(s), pa.array(np.zeros(len(v), bool))], names=["v", "u", "sim", "joined"])


class _Links:
    """The links that a task meets, as spanning forests of at most HELD of them."""

    def __init__(self) -> None:
        self.u, self.v, self.n = [], [], 0

    def add(self, ids: np.ndarray, near: np.ndarray):
        a, b = np.nonzero(np.triu(near, 1))
        self.u.append(ids[a])
        self.v.append(ids[b])
        self.n += len(a)
        if self.n >= HELD:
            yield from self.out()

    def out(self):
        import pyarrow as pa

        if self.n:
            v, u = forest(np.concatenate(self.u), np.concatenate(self.v))
            yield pa.RecordBatch.from_arrays([pa.array(v), pa.array(u), pa.nulls(len(v), pa.float64()), pa.array(np.ones(len(v), bool))],
                                             names=["v", "u", "sim", "joined"])
        self.u, self.v, self.n = [], [], 0


def _blocks(batches, block: int):
    """Rows of one table in its order, in blocks that overlap by half, formed inside each batch."""
    for b in batches:
        if not b.num_rows:
            continue
        for g in groups(iter([b]), "t"):
            for at in range(0, g.num_rows, block // 2):
                yield g.slice(at, block)
                if at + block >= g.num_rows:
                    break


def _first_lists(dims: int, block: int, k: int, threshold: float):
    def run(batches):
        links = _Links()
        for g in _blocks(batches, block):
            ids = np.asarray(g.column("id"))
            x = unit(g.column("vec").to_pylist(), dims)
            sim = x @ x.T
            np.fill_diagonal(sim, -2)
            yield from links.add(ids, sim >= threshold)
            out = _best(ids, sim, k, threshold)
            if out:
                yield _pairs_out(*out)
        yield from links.out()

    return run


def _local_join(dims: int, threshold: float):
    def run(batches):
        links = _Links()
        for g in groups(batches, "w", "salt"):
            ids = np.asarray(g.column("u"))
            if len(ids) < 2:
                continue
            last = np.asarray(g.column("last"))
            x = unit(g.column("vec").to_pylist(), dims)
            sim = x @ x.T
            sim[ids[:, None] == ids[None, :]] = -2
            yield from links.add(ids, sim >= threshold)
            a, b = np.nonzero((sim > last[:, None]) & (sim > -2))
            if len(a):
                yield _pairs_out(ids[a], ids[b], sim[a, b])
        yield from links.out()

    return run


def _lists(pairs: DataFrame, k: int = K, grown: int = GROWN, threshold: float = THRESHOLD) -> DataFrame:
    """The lists' entries (sim), and the vertices that links join (joined, without a sim where no list has the entry)."""
    best = pairs.groupBy("v", "u").agg(F.max("sim").alias("sim"), F.max("joined").alias("joined"))
    rank = F.row_number().over(Window.partitionBy("v").orderBy(F.col("sim").desc_nulls_last(), "u"))
    listed = F.col("sim").isNotNull() & (F.col("r") <= grown) & ((F.col("r") <= k) | (F.col("sim") >= threshold))
    return best.withColumn("r", rank).where(listed | F.col("joined")).select("v", "u", F.when(listed, F.col("sim")).alias("sim"), "joined")


def _round(lists: DataFrame, vectors: DataFrame, dims: int, threshold: float) -> DataFrame:
    """The pairs that the vertices of common lists bring."""
    lists = lists.where("sim is not null")
    last = lists.groupBy("v").agg(F.min("sim").alias("last"), F.count(F.lit(1)).alias("n"))
    # a list that isn't full takes anything; a saturated one what is a link, while it may grow
    link = float(np.nextafter(threshold, -1))
    last = last.select(F.col("v").alias("u"), F.when(F.col("n") < K, -2.0).when(F.col("n") < GROWN, F.least("last", F.lit(link)))
                       .otherwise(F.col("last")).alias("last"))
    known = vectors.select(F.col("id").alias("u"), "vec").join(last, "u", "left").fillna(-2.0, ["last"])
    reverse = lists.select(F.col("u").alias("w"), F.col("v").alias("u"))
    many = reverse.groupBy("w").agg(F.ceil(F.count(F.lit(1)) / GROUP).alias("parts"))
    dealt = reverse.join(many, "w").select("w", (F.pmod(F.xxhash64("u"), F.col("parts")) + 1).alias("salt"), "u")
    own = lists.select(F.col("v").alias("w"), F.lit(1).cast("long").alias("salt"), "u")
    members = own.union(dealt).distinct()
    return (members.join(known, "u").repartition("w", "salt").sortWithinPartitions("w", "salt", "u")
            .mapInArrow(_local_join(dims, threshold), PAIRS))


def _products(dims: int, threshold: float):
    def run(batches):
        import pyarrow as pa

        for g in groups(batches, "component", "i", "j"):
            ids, copies, chunk = (np.asarray(g.column(c)) for c in ("id", "copies", "chunk"))
            x = unit(g.column("vec").to_pylist(), dims)
            i, j = int(np.asarray(g.column("i"))[0]), int(np.asarray(g.column("j"))[0])
            a, b = chunk == i, chunk == j
            near = x[a] @ x[b].T >= threshold
            if i == j:
                np.fill_diagonal(near, False)
                yield pa.RecordBatch.from_arrays([pa.array(ids[a]), pa.array(near @ copies[b])], names=["id", "links"])
            else:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([ids[a], ids[b]])),
                                                  pa.array(np.concatenate([near @ copies[b], copies[a] @ near]))], names=["id", "links"])

    return run


def _count_links(vectors: DataFrame, found: DataFrame, dims: int, threshold: float) -> DataFrame:
    """(id, component, links): links to other vertices of the component, copies counted."""
    sizes = found.groupBy("component").agg(F.ceil(F.count(F.lit(1)) / PRODUCT).alias("chunks"))
    rows = (found.join(sizes, "component").withColumn("chunk", F.pmod(F.xxhash64("id"), F.col("chunks")))
            .withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)))
            .select("id", "component", "chunk", F.least("chunk", "other").alias("i"), F.greatest("chunk", "other").alias("j")))
    parts = (rows.join(vectors, "id").repartition("component", "i", "j").sortWithinPartitions("component", "i", "j", "id")
             .mapInArrow(_products(dims, threshold), "id long, links long"))
    links = parts.groupBy("id").agg(F.sum("links").alias("links"))
    return found.join(links, "id", "left").fillna(0, ["links"])


def _sums(dims: int):
    def run(batches):
        import pyarrow as pa

        for b in batches:
            if b.num_rows:
                ids, at = np.unique(np.asarray(b.column("component")), return_inverse=True)
                total = np.zeros((len(ids), dims))
                np.add.at(total, at, unit(b.column("vec").to_pylist(), dims))
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array([x.tobytes() for x in total], pa.binary())], names=["component", "vec"])

    return run


def _centres(dims: int):
    def run(batches):
        import pyarrow as pa

        for g in groups(batches, "component"):
            x = np.frombuffer(b"".join(g.column("vec").to_pylist()), np.float64).reshape(-1, dims).sum(0)
            if not np.abs(x).max() > 0:
                x = np.eye(1, dims)[0]  # any direction will do; the radius is measured from it
            yield pa.RecordBatch.from_arrays([g.column("component").slice(0, 1), pa.array([x.tobytes()], pa.binary())], names=["component", "centre"])

    return run


def _angles(x: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(x, -1, 1))


def _radii(dims: int):
    def run(batches):
        import pyarrow as pa

        for b in batches:
            if b.num_rows:
                x, y = (unit(b.column(c).to_pylist(), dims) for c in ("vec", "centre"))
                yield pa.RecordBatch.from_arrays([b.column("component"), pa.array(_angles((x * y).sum(1)))], names=["component", "radius"])

    return run


def _near(dims: int, block: int, threshold: float):
    """(a, b): components of a block that may hold a link between them."""
    def run(batches):
        import pyarrow as pa

        for g in _blocks(batches, block):
            ids, radius = np.asarray(g.column("id")), np.asarray(g.column("radius"))
            x = unit(g.column("vec").to_pylist(), dims)
            reach = radius[:, None] + radius[None, :] + np.arccos(threshold) + 1e-6
            a, b = np.nonzero(np.triu(_angles(x @ x.T) <= reach, 1))
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(ids[a]), pa.array(ids[b])], names=["a", "b"])

    return run


def _cross(dims: int, threshold: float):
    def run(batches):
        import pyarrow as pa

        for g in groups(batches, "block", "i", "j"):
            guest, c = np.asarray(g.column("guest").cast(pa.int8())) > 0, np.asarray(g.column("c"))
            x = unit(g.column("vec").to_pylist(), dims)
            a, b = np.nonzero((x[~guest] @ x[guest].T >= threshold) & (c[~guest][:, None] != c[guest][None, :]))
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(z) for z in forest(c[~guest][a], c[guest][b])], names=["a", "b"])

    return run


def _held(placed: DataFrame, vectors: DataFrame, dims: int, threshold: float) -> DataFrame:
    """(a, b): components c that links join, of each block's own rows held against its guests.

    ``placed``: (block, guest boolean, id, c)."""
    chunks = lambda side: F.ceil(F.count(F.when(side, 1)) / PRODUCT)
    sizes = placed.groupBy("block").agg(chunks(~F.col("guest")).alias("hosts"), chunks(F.col("guest")).alias("guests"))
    either = lambda a, b: F.when(F.col("guest"), F.col(a)).otherwise(F.col(b))
    rows = (placed.join(sizes, "block").withColumn("mine", F.pmod(F.xxhash64("id"), either("guests", "hosts")))
            .withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), either("hosts", "guests") - 1)))
            .select("block", "guest", "id", "c", either("other", "mine").alias("i"), either("mine", "other").alias("j")))
    return (rows.join(vectors.select("id", "vec"), "id").repartition("block", "i", "j").sortWithinPartitions("block", "i", "j", "guest", "id")
            .mapInArrow(_cross(dims, threshold), "a long, b long").distinct())


def _labelled(vectors: DataFrame, found: DataFrame) -> DataFrame:
    return vectors.join(found, "id", "left").select("id", F.coalesce("component", "id").alias("c"))


def _met(vectors: DataFrame, found: DataFrame, dims: int, threshold: float, place) -> DataFrame:
    """(a, b): components that links join, of those that stand near each other.

    ``place`` puts rows (id, vec, radius) in the order of blocks."""
    inside = vectors.join(found, "id").select("component", "vec")
    centres = (inside.mapInArrow(_sums(dims), "component long, vec binary").repartition("component").sortWithinPartitions("component")
               .mapInArrow(_centres(dims), "component long, centre binary"))
    centres = materialize(centres, "centres")
    radii = (inside.join(centres, "component").mapInArrow(_radii(dims), "component long, radius double")
             .groupBy("component").agg(F.max("radius").alias("radius")))
    alone = vectors.join(found, "id", "left_anti").select("id", "vec", F.lit(0.0).alias("radius"))
    objects = materialize(centres.join(radii, "component").select(F.col("component").alias("id"), F.col("centre").alias("vec"), "radius").union(alone), "objects")
    near = materialize(place(objects).mapInArrow(_near(dims, BLOCK, threshold), "a long, b long")
                       .select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "near")
    # the larger of two components is the host: its rows stand once against all its guests
    labelled = materialize(_labelled(vectors, found), "labelled")
    sizes = labelled.groupBy("c").agg(F.count(F.lit(1)).alias("n"))
    sized = (near.join(sizes.select(F.col("c").alias("a"), F.col("n").alias("n_a")), "a")
             .join(sizes.select(F.col("c").alias("b"), F.col("n").alias("n_b")), "b"))
    larger = F.col("n_a") >= F.col("n_b")
    meets = sized.select(F.when(larger, F.col("a")).otherwise(F.col("b")).alias("block"), F.when(larger, F.col("b")).otherwise(F.col("a")).alias("c"))
    sides = meets.select("block", F.lit(True).alias("guest"), "c").union(meets.select("block", F.lit(False), F.col("block")).distinct())
    return _held(materialize(sides.join(labelled, "c").select("block", "guest", "id", "c"), "sides"), vectors, dims, threshold)


def _all_met(vectors: DataFrame, found: DataFrame, dims: int, threshold: float) -> DataFrame:
    """(a, b): components that links join, of all."""
    placed = _labelled(vectors, found).select(F.lit(0).cast("long").alias("block"), F.explode(F.array(F.lit(False), F.lit(True))).alias("guest"), "id", "c")
    return _held(materialize(placed, "sides"), vectors, dims, threshold)


def _true_links(queries, dims: int, threshold: float):
    def run(batches):
        import pyarrow as pa

        ids, x = queries.value
        total = np.zeros(len(ids), np.int64)
        for b in batches:
            for at in range(0, b.num_rows, PRODUCT):
                part = b.slice(at, PRODUCT)
                near = x @ unit(part.column("vec").to_pylist(), dims).T >= threshold
                near &= ids[:, None] != np.asarray(part.column("id"))[None, :]
                total += near @ np.asarray(part.column("copies"))
        yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(total)], names=["id", "links"])

    return run


def audit(vectors: DataFrame, counted: DataFrame, dims: int, threshold: float, queries: int = AUDIT) -> float:
    """Share of at most ``queries`` vertices (smallest hashes) whose number of links is right, of those that have any.

    Vertices of one component count as one together, so a large group can't hide what is lost elsewhere."""
    spark = vectors.sparkSession
    drawn = vectors.orderBy(F.xxhash64("id"), "id").limit(queries).select("id", "vec").collect()
    if not drawn:
        return 1.0
    ids = np.array([r.id for r in drawn], np.int64)
    sent = spark.sparkContext.broadcast((ids, unit([bytes(r.vec) for r in drawn], dims)))
    true = vectors.mapInArrow(_true_links(sent, dims, threshold), "id long, links long").groupBy("id").agg(F.sum("links").alias("true"))
    right = F.when(F.col("true") == F.coalesce("links", F.lit(0)), 1.0).otherwise(0.0)
    shares = (true.where(F.col("true") > 0).join(counted.select("id", "component", "links"), "id", "left")
              .groupBy(F.coalesce("component", "id").alias("group")).agg(F.avg(right).alias("share")))
    got = shares.agg(F.avg("share")).first()[0]
    return 1.0 if got is None else got


def _state(lists: DataFrame) -> tuple:
    """What changes with the lists' entries."""
    return tuple(lists.where("sim is not null").agg(F.count(F.lit(1)), F.expr("bit_xor(xxhash64(v, u))")).first())


def near_duplicates(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", threshold: float = THRESHOLD,
                    seed: int = 7) -> DataFrame:
    """(id, n_links, component_id, kept, audit_recall), one row for each row of ``df``.

    ``n_links`` counts the other vectors with cosine >= threshold, copies among them;
    ``component_id`` is the smallest id that links reach, itself included; ``kept`` says
    whether that is the row's own. Vectors that can't link have none and are kept. Ids are
    integers; a null id has a null component and links with nothing; rows that share an id
    and a vector are copies. ``audit_recall`` is the audit's figure for the whole result.
    """
    spark = df.sparkSession
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.transform(vec_col, lambda x: x.cast("double")).alias("v"))
    fine = (F.col("id").isNotNull() & F.col("v").isNotNull()
            & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0))
    rows = rows.withColumn("v", F.when(fine, F.col("v")))
    classes = rows.where("v is not null").groupBy("v").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("copies"))
    classes = materialize(classes, "classes")
    n, dims = classes.agg(F.count(F.lit(1)), F.coalesce(F.max(F.size("v")), F.lit(0))).first()
    # an id may stand for several vectors; vertices are numbered by the rep and, after the first, by fresh negative ids
    order = F.row_number().over(Window.partitionBy("rep").orderBy("v"))
    classes = classes.withColumn("id", F.when(order == 1, F.col("rep")).otherwise(-F.xxhash64("v", "rep").bitwiseAND(F.lit(2**62 - 1)) - 1))
    vertices = materialize(classes.select("id", "copies", "v", "rep"), "vertices")
    vectors = materialize(vertices.mapInArrow(_pack(dims), "id long, copies long, vec binary"), "vectors")
    # vertices that share an id are one component from the start
    same_id = vertices.where("id != rep").select(F.col("id").alias("a"), F.col("rep").alias("b"))

    rng = np.random.default_rng(seed)
    lists, recall, counted = None, 0.0, None
    bits = max(0, int(np.ceil(np.log2(max(n, 1) / BLOCK))))
    width = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n * TABLES // 100_000))

    def place(df: DataFrame, *also: str) -> DataFrame:
        planes = spark.sparkContext.broadcast([rng.standard_normal((dims, bits + 1)) for _ in range(TABLES)])
        schema = "t int, code long, along double, id long, vec binary" + "".join(f", {c} double" for c in also)
        return (df.mapInArrow(_codes(planes, dims, *also), schema)
                .repartitionByRange(width, "t", "code", "along", "id").sortWithinPartitions("t", "code", "along", "id"))

    def settle(edges: DataFrame) -> tuple[DataFrame, DataFrame, float]:
        found = components(edges, "a", "b")
        counted = materialize(_count_links(vectors, found, dims, threshold), "counted")
        return found, counted, audit(vectors, counted, dims, threshold)

    for _ in range(TRIES if n else 0):
        first = place(vectors.select("id", "vec")).mapInArrow(_first_lists(dims, BLOCK, K, threshold), PAIRS)
        lists = materialize(_lists(first if lists is None else first.union(lists), threshold=threshold), "lists")
        before = None
        while (now := _state(lists)) != before:
            before = now
            lists = materialize(_lists(_round(lists, vectors, dims, threshold).union(lists), threshold=threshold), "lists")
        edges = lists.where(F.col("joined") | (F.col("sim") >= threshold)).select(F.col("v").alias("a"), F.col("u").alias("b")).union(same_id)
        found = components(edges, "a", "b")
        while not (met := materialize(_met(vectors, found, dims, threshold, lambda x: place(x, "radius")), "met")).isEmpty():
            edges = edges.union(met)
            found = components(edges, "a", "b")
        found, counted, recall = settle(edges)
        if recall >= RECALL:
            break
    else:
        if n:
            found, counted, recall = settle(edges.union(materialize(_all_met(vectors, found, dims, threshold), "met")))
    keys = vertices.select("v", "id", "rep", "copies")
    if counted is not None and not same_id.isEmpty():  # numbers given to an id's other vectors are no ids
        named = counted.join(vertices.select("id", "rep"), "id")
        smallest = named.groupBy("component").agg(F.min("rep").alias("named"))
        counted = named.join(smallest, "component").select("id", F.col("named").alias("component"), "links")
    if counted is not None:
        keys = keys.join(counted.select("id", "component", "links"), "id", "left")
    else:
        keys = keys.withColumn("component", F.lit(None).cast("long")).withColumn("links", F.lit(None).cast("long"))
    out = rows.join(keys.select("v", "component", "links", "rep", "copies"), "v", "left")
    component = F.coalesce("component", "rep", "id")
    return out.select(F.col("id").alias(id_col), (F.coalesce("links", F.lit(0)) + F.coalesce("copies", F.lit(1)) - 1).alias("n_links"),
                      component.alias("component_id"), (F.col("id") == component).alias("kept"), F.lit(float(recall)).alias("audit_recall"))
