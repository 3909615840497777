"""N-gram Jaccard join: rare-first prefix filtering with length, positional and suffix filters.

A document is its set of distinct word 5-grams (64-bit hashes). Two link when
100 * |intersection| >= 75 * |union|.

1. ``sets``: one row for each document (size, digest of the set, a histogram of the set by
   hash range), and a table of n-gram frequencies over all documents, folded to ``BUCKETS``
   counters. The counters give the global order, rare n-grams first; folding makes the
   order coarser, never the result.
2. Every document emits its prefix. N-grams that several documents of one chunk share are
   combined there: the smallest document stands for the others (``hub``) and goes on
   alone, so a key that a third of all rows hold sends one row for each chunk. Keys are
   then sorted in their partitions and linked to the first document of the key, in one
   streaming pass: the rows grow with the prefixes, not with the pairs of a key.
3. (hub, document) pairs that pass the length, positional and suffix filters are verified
   once on the whole sets; links are joined to components. Texts travel, compressed, and sets are made
   where pairs meet: a set has 8 bytes for each word. Hubs stay where the first shuffle by id put them.
4. What step 3 skipped: documents that share a prefix n-gram but lie in different components.
   Pairs inside one component can't change the components, so the work is between
   components. On each key, the components whose documents pass the filters join the block
   of the component that has most documents there; in a block, the joined documents are
   held against an index of all its sets, cut into parts of bounded size. So any two
   components that share a key meet, and rows grow with the documents, not with pairs.

Equal sets are linked by their digests, so copies meet no join.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rarebird.llm.components import components
from rarebird.llm.tables import discard, materialize

WORDS = 5
#: Similarity of at least NUM / DEN.
NUM, DEN = 75, 100
#: Counters of the n-gram frequencies (a 16 MB table, whatever the input), and those in a row.
BUCKETS, PER_ROW = 1 << 22, 1024
#: Ranges of the suffix filter's histogram.
RANGES = 64
#: Bits of the filter that keeps documents without candidate pairs out of verification (4 MB).
FILTER_BITS = 1 << 25
#: N-grams in one part of a block of step 4.
BLOCK_GRAMS = 500_000
#: Bytes of text whose words are hashed at once: each takes some 36 bytes of buffers.
HASH_BYTES = 1 << 18

MASK = np.uint64(0xFFFFFFFFFFFFFFFF)
BASE = 0x9E3779B97F4A7C15 | 1
BASE_INVERSE = pow(BASE, -1, 1 << 64)
PLACE = [np.uint64(x) for x in (0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F,
                                0xE7037ED1A0B428DB)]
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
BLANK = np.zeros(256, bool)
BLANK[[32, 9, 10, 11, 12, 13]] = True


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def _powers(n: int) -> list[np.ndarray]:
    """1, base, base^2, ... of the base and of its inverse. Made anew for each chunk: a worker that
    kept them would hold them through all later stages."""
    out = []
    for base in (BASE, BASE_INVERSE):
        p = np.full(n, base, np.uint64)
        p[:1] = 1
        out.append(np.multiply.accumulate(p))
    return out


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every word, number of words of each text) of UTF-8 texts, A-Z lower-cased."""
    lens = np.fromiter(map(len, texts), np.int64, len(texts))
    cuts = np.flatnonzero(np.diff((np.cumsum(lens) - lens) // HASH_BYTES)) + 1
    ends = [0, *cuts.tolist(), len(texts)]
    words, counts = zip(*[_word_hashes(texts[a:b]) for a, b in zip(ends, ends[1:], strict=False)], strict=True)
    return np.concatenate(words), np.concatenate(counts)


def _word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    joined = b"\n".join(texts).translate(LOWER)
    raw = np.frombuffer(joined, np.uint8)
    lens = np.fromiter(map(len, texts), np.int64, len(texts))
    starts = np.cumsum(lens + 1) - lens - 1
    solid = np.concatenate([[False], ~BLANK[raw], [False]])
    edge = np.flatnonzero(solid[1:] != solid[:-1])
    at, to = edge[::2], edge[1::2]
    power, inverse = _powers(len(raw) + 1)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * power[:len(raw)], dtype=np.uint64)])
    words = _mix((sums[to] - sums[at]) * inverse[at])
    return words, np.diff(np.append(np.searchsorted(at, starts), len(at)))


def shingle_sets(texts: list[bytes], size: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """(sorted distinct n-gram hashes of each text, one text after another; their numbers)."""
    words, counts = word_hashes(texts)
    first = np.cumsum(counts) - counts
    grams = np.maximum(counts - size + 1, (counts > 0).astype(np.int64))
    to = np.cumsum(grams)
    out = np.zeros(int(to[-1]) if len(to) else 0, np.uint64)
    if len(words) >= size:
        span = len(words) - size + 1
        total = np.zeros(span, np.uint64)
        for k in range(size):
            total += words[k:k + span] * PLACE[k]
        full = np.flatnonzero(counts >= size)
        n = grams[full]
        source = np.arange(int(n.sum())) + np.repeat(first[full] - (np.cumsum(n) - n), n)
        out[np.arange(int(n.sum())) + np.repeat(to[full] - n - (np.cumsum(n) - n), n)] = _mix(total[source])
    for i in np.flatnonzero((counts > 0) & (counts < size)).tolist():  # the whole sequence as one
        w = words[first[i]:first[i] + counts[i]]
        out[to[i] - 1] = _mix(np.array([(w * PLACE[:len(w)]).sum(dtype=np.uint64) + np.uint64(counts[i])]))[0]
    if not len(out):
        return out, grams
    for a, b in zip((to - grams).tolist(), to.tolist(), strict=True):
        out[a:b].sort()
    keep = np.ones(len(out), bool)
    keep[1:] = out[1:] != out[:-1]
    keep[(to - grams)[grams > 0]] = True
    doc = np.repeat(np.arange(len(texts)), grams)
    return out[keep], np.bincount(doc[keep], minlength=len(texts))


def _bytes_of(batch, column: str = "text") -> list[bytes]:
    import pyarrow as pa

    return [t or b"" for t in batch.column(column).cast(pa.binary()).to_pylist()]


def digest_of(hashes: np.ndarray) -> bytes:
    return hashlib.blake2b(hashes.tobytes(), digest_size=16).digest()


def _describe(batches):
    import pyarrow as pa

    from rarebird.llm.arrowbatch import text_chunks

    names = ["id", "n", "digest", "ranges", "bucket", "counts"]
    total, kind = np.zeros(BUCKETS, np.uint32), None
    for chunk in text_chunks(batches):
        kind = chunk.column("id").type
        hashes, n = shingle_sets(_bytes_of(chunk))
        at = np.concatenate([[0], np.cumsum(n)])
        np.add.at(total, (hashes & np.uint64(BUCKETS - 1)).view(np.int64), np.uint32(1))
        doc = np.repeat(np.arange(len(n)), n)
        ranges = np.bincount(doc * RANGES + (hashes >> np.uint64(58)).astype(np.int64), minlength=len(n) * RANGES)
        ranges = np.minimum(ranges, 65535).astype(np.uint16).reshape(len(n), RANGES)
        yield pa.RecordBatch.from_arrays(
            [chunk.column("id"), pa.array(n), pa.array([digest_of(hashes[a:b]) for a, b in zip(at[:-1], at[1:], strict=True)], pa.binary()),
             pa.array([r.tobytes() for r in ranges], pa.binary()), pa.nulls(len(n), pa.int32()), pa.nulls(len(n), pa.binary())],
            names=names)
    if kind is not None:
        rows = np.minimum(total, 65535).astype(np.uint16).reshape(-1, PER_ROW)
        used = np.flatnonzero(rows.any(1))
        k = len(used)
        yield pa.RecordBatch.from_arrays(
            [pa.nulls(k, kind), pa.nulls(k, pa.int64()), pa.nulls(k, pa.binary()), pa.nulls(k, pa.binary()),
             pa.array(used, pa.int32()), pa.array([rows[i].tobytes() for i in used], pa.binary())], names=names)


def _sum_counters(batches):
    import pyarrow as pa

    at, total = None, None
    for b in batches:
        out = []
        for bucket, counts in zip(b.column("bucket").to_pylist(), b.column("counts").to_pylist(), strict=True):
            if bucket != at:
                if at is not None:
                    out.append((at, total.tobytes()))
                at, total = bucket, np.zeros(PER_ROW, np.uint32)
            total += np.frombuffer(counts, np.uint16)
        if out:
            yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.int32()), pa.array([o[1] for o in out], pa.binary())],
                                             names=["bucket", "counts"])
    if at is not None:
        yield pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), pa.array([total.tobytes()], pa.binary())], names=["bucket", "counts"])


def _prefixes(frequency):
    def run(batches):
        import pyarrow as pa

        from rarebird.llm.arrowbatch import text_chunks

        counters = frequency.value
        names = ["key", "id", "n", "pos", "hub", "hub_n", "hub_pos"]
        for chunk in text_chunks(batches):
            ids = np.asarray(chunk.column("id"))
            hashes, n = shingle_sets(_bytes_of(chunk))
            at = np.concatenate([[0], np.cumsum(n)])
            # of equal sets in a chunk, the smallest id stands for all
            once: dict[bytes, int] = {}
            for i in np.argsort(ids, kind="stable").tolist():
                if n[i]:
                    once.setdefault(digest_of(hashes[at[i]:at[i + 1]]), i)
            docs = np.array(sorted(once.values()), np.int64)
            if not len(docs):
                continue
            order = counters[hashes & np.uint64(BUCKETS - 1)].astype(np.int64) << 32
            keys, pos, doc = [], [], []
            for i in docs.tolist():
                a, b = at[i], at[i + 1]
                mine = order[a:b] | np.arange(b - a)  # rare first, then by hash
                take = b - a - -(-(b - a) * NUM // DEN) + 1
                if take < b - a:
                    mine = np.partition(mine, take - 1)[:take]
                mine.sort()
                keys.append(hashes[a + (mine & 0xFFFFFFFF)])
                pos.append(np.arange(take))
                doc.append(np.full(take, i))
            key, pos, doc = np.concatenate(keys), np.concatenate(pos), np.concatenate(doc)
            by = np.lexsort((ids[doc], n[doc], key))
            key, pos, doc = key[by].view(np.int64), pos[by], doc[by]
            fresh = np.append(True, key[1:] != key[:-1])
            hub = np.maximum.accumulate(np.where(fresh, np.arange(len(key)), 0))
            mine, size = ids[doc], n[doc]
            none = lambda x: pa.array(x, pa.int64(), mask=fresh)
            yield pa.RecordBatch.from_arrays(
                [pa.array(key), pa.array(mine), pa.array(size), pa.array(pos), none(mine[hub]), none(size[hub]),
                 none(pos[hub])], names=names)

    return run


def _link(batches):
    """Rows sorted by (key, n, id): pairs pass; a key's other rows are paired with its first."""
    import pyarrow as pa

    names = ["key", "id", "n", "pos", "hub", "hub_n", "hub_pos"]
    last = None  # (key, id, n, pos) of the hub of the key that may go on
    for b in batches:
        paired = np.asarray(b.column("hub").is_valid())
        if paired.any():
            yield b.filter(pa.array(paired)).select(names)
        if paired.all():
            continue
        free = b.filter(pa.array(~paired))
        cols = np.stack([np.asarray(free.column(c)) for c in ("key", "id", "n", "pos")])
        if last is not None:
            cols = np.concatenate([last[:, None], cols], axis=1)
        key = cols[0]
        fresh = np.append(True, key[1:] != key[:-1])
        hub = np.maximum.accumulate(np.where(fresh, np.arange(len(key)), 0))
        last = cols[:, hub[-1]].copy()
        rest = np.flatnonzero(~fresh)
        if len(rest):
            h = hub[rest]
            yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(x)) for x in (*cols[:, rest], *cols[1:, h])], names=names)


def _fits(n, pos, hub_n, hub_pos):
    """Length and positional filter, from one shared n-gram.

    The first n-gram that two sets share has no match before it, so similar sets pass on
    that one; a pair that passes nowhere isn't similar."""
    n, pos, hub_n, hub_pos = map(F.col, (n, pos, hub_n, hub_pos))
    most = F.least(n - pos, hub_n - hub_pos)
    return (F.least(n, hub_n) * DEN >= F.greatest(n, hub_n) * NUM) & (most * (DEN + NUM) >= (n + hub_n) * NUM)


def _suffix_filter(batches):
    import pyarrow as pa

    for b in batches:
        if not b.num_rows:
            continue
        a, c = (np.frombuffer(b"".join(b.column(x).to_pylist()), np.uint16).reshape(-1, RANGES).astype(np.int64) for x in ("ranges_a", "ranges_b"))
        full = ((a == 65535) | (c == 65535)).any(1)  # a counter that ran over proves nothing
        size = np.asarray(b.column("n_a")) + np.asarray(b.column("n_b"))
        fits = full | (np.minimum(a, c).sum(1) * (DEN + NUM) >= size * NUM)
        yield b.select(["a", "b"]).filter(pa.array(fits))


def _kept_texts(bits):
    def run(batches):
        import pyarrow as pa

        flags = bits.value
        for b in batches:
            slot = np.asarray(b.column("slot"))
            b = b.filter(pa.array((flags[slot >> 3] >> (slot & 7).astype(np.uint8) & 1).astype(bool)))
            packed = [zlib.compress(t.as_buffer() if t.is_valid else b"") for t in b.column("text").cast(pa.binary())]
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(packed, pa.binary())], names=["id", "packed"])

    return run


def _sets(packed):
    """The set of each compressed text of a column, ``CHUNK_BYTES`` of text at a time."""
    from rarebird.llm.arrowbatch import CHUNK_BYTES

    held, size = [], 0
    for at, raw in enumerate(packed, 1):
        held.append(zlib.decompress(raw.as_buffer()))
        size += len(held[-1])
        if size >= CHUNK_BYTES or at == len(packed):
            hashes, n = shingle_sets(held)
            yield from np.split(hashes, np.cumsum(n)[:-1])
            held, size = [], 0


def _verify(batches):
    """Rows (a, b, of_a, of_b) -> the similar pairs; rows of one a stand together, so its set is made once a batch."""
    import pyarrow as pa

    for rows in batches:
        a = np.asarray(rows.column("a"))
        fresh = np.append(True, a[1:] != a[:-1])[:len(a)]
        hubs = _sets(rows.column("of_a").filter(pa.array(fresh)))
        near = np.zeros(len(a), bool)
        for i, grams in enumerate(_sets(rows.column("of_b"))):
            hub = next(hubs) if fresh[i] else hub
            both = len(np.intersect1d(hub, grams, assume_unique=True))
            near[i] = both > 0 and DEN * both >= NUM * (len(hub) + len(grams) - both)
        yield rows.select(["a", "b"]).filter(pa.array(near))


class _Block:
    """The sets of one block part, as one sorted array of (n-gram, document)."""

    def __init__(self, labels: list[int], sets: list[np.ndarray]) -> None:
        self.labels = np.array(labels, np.int64)
        self.n = np.array([len(x) for x in sets], np.int64)
        doc = np.repeat(np.arange(len(sets), dtype=np.int32), self.n)
        grams = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
        order = np.argsort(grams, kind="stable")
        self.grams, self.doc = grams[order], doc[order]

    def links(self, label: int, grams: np.ndarray) -> np.ndarray:
        """The other components that hold a similar document."""
        if len(self.labels) == 1:
            both = np.array([len(np.intersect1d(grams, self.grams, assume_unique=True))])
        else:
            lo, hi = np.searchsorted(self.grams, grams, "left"), np.searchsorted(self.grams, grams, "right")
            n = hi - lo
            at = np.arange(int(n.sum())) + np.repeat(lo - (np.cumsum(n) - n), n)
            both = np.bincount(self.doc[at], minlength=len(self.labels))
        near = np.flatnonzero((DEN * both >= NUM * (len(grams) + self.n - both)) & (self.labels != label))
        return np.unique(self.labels[near])


def _compare(batches):
    """Rows sorted by (block, part, probe): the sets of a block part, then those held against it."""
    import pyarrow as pa

    at, held, block = None, [], None
    for b in batches:
        found = set()
        rows = zip(*[b.column(x).to_pylist() for x in ("block", "part", "probe", "c")], _sets(b.column("packed")), strict=True)
        for block_id, part, probe, c, grams in rows:
            if (block_id, part) != at:
                at, held, block = (block_id, part), [], None
            if not len(grams):
                continue
            if not probe:
                held.append((c, grams.copy()))
                continue
            if block is None:
                block, held = _Block(*map(list, zip(*held, strict=True))) if held else _Block([], []), []
            found.update((c, x) for x in block.links(c, grams).tolist())
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*found, strict=True)], names=["a", "b"])


def _slot(c):
    return F.pmod(F.xxhash64(c), F.lit(FILTER_BITS))


def _kept(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """(id, packed): the compressed texts of the documents in ``ids``, and of a few more: others are kept out of the
    shuffle by a filter of fixed size."""
    # bitmap positions count from 1
    ends = ids.select((_slot("id") + 1).alias("s"))
    maps = ends.groupBy(F.bitmap_bucket_number("s").alias("k")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("s")).alias("m")).collect()
    bits = np.zeros(FILTER_BITS // 8, np.uint8)  # a full filter keeps more rows, not fewer
    for r in maps:
        part = np.frombuffer(bytes(r.m), np.uint8)
        bits[(r.k - 1) * 4096:(r.k - 1) * 4096 + len(part)] |= part
    sent = rows.sparkSession.sparkContext.broadcast(bits)
    return (rows.select("id", "text", _slot("id").cast("int").alias("slot")).where(F.col("id").isNotNull())
            .mapInArrow(_kept_texts(sent), "id long, packed binary"))


def _similar_pairs(rows: DataFrame, pairs: DataFrame) -> DataFrame:
    """The pairs (a, b) of ids with one row each whose sets are similar. Only the texts of b move to their a."""
    kept = _kept(rows, pairs.select(F.explode(F.array("a", "b")).alias("id")))
    sent = pairs.join(kept.select(F.col("id").alias("b"), F.col("packed").alias("of_b")), "b")
    return (sent.join(kept.select(F.col("id").alias("a"), F.col("packed").alias("of_a")), "a")
            .select("a", "b", "of_a", "of_b").mapInArrow(_verify, "a long, b long"))


def _similar(rows: DataFrame, meetings: DataFrame) -> DataFrame:
    """Links (a, b) between components found by holding the probes of each (block, part) against its sets.

    ``meetings``: (block, part, probe boolean, id, c the id's component)."""
    return (meetings.join(_kept(rows, meetings), "id").repartition("block", "part").sortWithinPartitions("block", "part", "probe", "id")
            .select("block", "part", "probe", "c", "packed").mapInArrow(_compare, "a long, b long").distinct())


def _tried_links(rows: DataFrame, sets: DataFrame, tried: DataFrame) -> DataFrame:
    """The similar ones of the pairs (a, b) of ``tried``. Ids with several rows meet in blocks, so
    that their texts are not paired one by one."""
    several = materialize(sets.where("id is not null").groupBy("id").agg(F.count(F.lit(1)).alias("rows")).where("rows > 1").select("id"), "several")
    if several.isEmpty():
        return _similar_pairs(rows, tried)
    apart = tried.join(several.select(F.col("id").alias("a")), "a", "left_semi").select("a", "b").union(
        tried.join(several.select(F.col("id").alias("b")), "b", "left_semi").select("a", "b")).distinct()
    hubs = apart.select(F.col("a").alias("block"), F.lit(0).alias("part"), F.lit(False).alias("probe"), F.col("a").alias("id"), F.col("a").alias("c")).distinct()
    return (_similar_pairs(rows, tried.join(apart, ["a", "b"], "left_anti"))
            .union(_similar(rows, hubs.union(apart.select("a", F.lit(0), F.lit(True), "b", "b"))).select(*_ordered("a", "b"))))


def _hosts(batches):
    """Rows (key, id, n, pos, c) sorted by key -> (block, c): the components that a key's filters
    let meet another, and the component with most documents on the key (then the smallest)."""
    import pyarrow as pa

    from rarebird.llm.nn_descent import groups

    held: set[tuple[int, int]] = set()

    def flush():
        out = pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*held, strict=True)], names=["block", "c"])
        held.clear()
        return out

    for g in groups(batches, "key"):
        n, pos, c = (np.asarray(g.column(x)) for x in ("n", "pos", "c"))
        meets = np.zeros(len(n), bool)
        for at in range(0, len(n), 512):  # rows of the key against all of them
            r = slice(at, at + 512)
            x, p = n[r, None], pos[r, None]
            most = np.minimum(x - p, n - pos)  # as in _fits
            meets[r] = ((c[r, None] != c) & (np.minimum(x, n) * DEN >= np.maximum(x, n) * NUM) & (most * (DEN + NUM) >= (x + n) * NUM)).any(1)
        if meets.any():
            labels, count = np.unique(c, return_counts=True)
            host = int(labels[count.argmax()])
            held.update((host, x) for x in np.unique(c[meets]).tolist())
            held.add((host, host))
        if len(held) > 200_000:
            yield flush()
    if held:
        yield flush()


def _ordered(a, b):
    return [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]


def _between(rows: DataFrame, sets: DataFrame, members: DataFrame, hosts: DataFrame) -> DataFrame:
    """Links between the components that ``hosts`` (block, c) brings together."""
    # one document for each set of a component stands for its copies
    docs = (members.select("id", "c").distinct().join(sets.where("n > 0").select("id", "n", "digest"), "id")
            .groupBy("c", "digest").agg(F.min("id").alias("id"), F.max("n").alias("n")))
    placed = materialize(hosts.join(docs, "c").select("block", "c", "id", "n"), "placed")
    parts = placed.groupBy("block").agg(F.ceil(F.sum("n") / BLOCK_GRAMS).cast("int").alias("parts"))
    placed = placed.join(parts, "block")
    index = placed.select("block", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int").alias("part"), F.lit(False).alias("probe"), "id", "c")
    probes = placed.where("c != block").select("block", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(True).alias("probe"), "id", "c")
    return _similar(rows, index.union(probes))


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_shingles, component_id), one row for each row of ``docs``.

    ``component_id`` is the smallest id that links reach, itself included. Null, empty and
    blank texts have 0 shingles and link with nothing; a text of fewer than 5 words has
    one. Rows with a null id have a null component and link with nothing; rows that share
    an id are one vertex with the links of all its texts. Ids are integers. Other columns
    are not read.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    described = materialize(rows.mapInArrow(_describe, "id long, n long, digest binary, ranges binary, bucket int, counts binary"), "described")
    counted = (described.where("bucket is not null").select("bucket", "counts").repartition("bucket").sortWithinPartitions("bucket")
               .mapInArrow(_sum_counters, "bucket int, counts binary").collect())  # BUCKETS counters
    counters = np.zeros((BUCKETS // PER_ROW, PER_ROW), np.uint32)
    for r in counted:
        counters[r.bucket] = np.frombuffer(bytes(r.counts), np.uint32)
    frequency = spark.sparkContext.broadcast(np.minimum(counters.ravel(), 2**31 - 1))
    sets = described.where("bucket is null").select("id", "n", "digest", "ranges")
    linked = (rows.where(F.col("id").isNotNull())
              .mapInArrow(_prefixes(frequency), "key long, id long, n long, pos long, hub long, hub_n long, hub_pos long")
              # a linked row needs no meeting with its key any more: it goes anywhere
              .repartition(F.when(F.col("hub").isNull(), F.col("key")).otherwise(F.xxhash64("id", "key")))
              .sortWithinPartitions("key", "n", "id")
              .mapInArrow(_link, "key long, id long, n long, pos long, hub long, hub_n long, hub_pos long"))
    shared = materialize(linked.where("id != hub"), "shared")

    size = sets.select("id", "n", "ranges").where("n > 0 and id is not null")
    tried = shared.where(_fits("n", "pos", "hub_n", "hub_pos")).select(*_ordered("hub", "id")).distinct()
    tried = materialize(tried.select("a", "b")
                        .join(size.select(F.col("id").alias("b"), F.col("n").alias("n_b"), F.col("ranges").alias("ranges_b")), "b")
                        .join(size.select(F.col("id").alias("a"), F.col("n").alias("n_a"), F.col("ranges").alias("ranges_a")), "a")
                        .mapInArrow(_suffix_filter, "a long, b long").distinct(), "tried")
    links = materialize(_tried_links(rows, sets, tried), "links")
    copies = (sets.where("n > 0 and id is not null")
              .join(sets.where("n > 0").groupBy("digest").agg(F.min("id").alias("a"), F.count(F.lit(1)).alias("c")).where("c > 1"), "digest")
              .select("a", F.col("id").alias("b")).where("a != b"))
    copies = materialize(copies, "copies")
    found = components(links.union(copies), "a", "b")

    def labelled(df: DataFrame, col: str, label: str) -> DataFrame:
        return df.join(found.select(F.col("id").alias(col), F.col("component").alias(label)), col, "left").withColumn(
            label, F.coalesce(label, col))

    # the two documents of a key with one row have been compared
    again = materialize(shared.groupBy("key").agg(F.count(F.lit(1)).alias("rows")).where("rows > 1").select("key"), "again")
    both = F.explode(F.array(F.struct("id", "n", "pos"), F.struct(F.col("hub").alias("id"), F.col("hub_n").alias("n"), F.col("hub_pos").alias("pos"))))
    members = materialize(shared.join(again, "key", "left_semi").select("key", both.alias("m")).select("key", "m.*").distinct(), "unlabelled")
    unlabelled, members = members, materialize(labelled(members, "id", "c").select("key", "id", "n", "pos", "c"), "members")
    for done in (shared, tried, links, copies, again, unlabelled):  # nothing reads them any more
        discard(done)
    mixed = members.groupBy("key").agg(F.min("c").alias("low"), F.max("c").alias("high")).where("low < high").select("key")
    mixed = members.join(mixed, "key", "left_semi")
    hosts = (mixed.repartition("key").sortWithinPartitions("key", "id").mapInArrow(_hosts, "block long, c long").distinct())
    hosts = materialize(hosts, "hosts")
    if not hosts.isEmpty():  # the labels of components that links join
        joined = components(_between(rows, sets, members, hosts), "a", "b").select(F.col("id").alias("component"), F.col("component").alias("to"))
        found = (found.join(joined, "component", "left").select("id", F.coalesce("to", "component").alias("component"))
                 .union(joined.join(found.select("id"), joined["component"] == found["id"], "left_anti").select("component", "to")))
    found = materialize(found, "components")
    discard(members)
    discard(hosts)
    out = sets.select("id", F.col("n").alias("n_shingles")).join(found, "id", "left")
    return out.select(F.col("id").alias(id_col), "n_shingles", F.coalesce("component", "id").alias("component_id"))
