"""Benchmark decontamination: SimHash fingerprints of item-sized windows.

The benchmark is the query set; it goes to the tasks in blocks of bounded size, and every
block meets every document. In a document, a window has as many words as the item it is
held against; a shorter document is one window. The similarity is over weighted word 5-grams
(weight: occurrences): sum of the smaller weights by sum of the larger, at least 75 / 100.

* Two n-gram lists of m and k entries that are so similar share at least 75 (m + k) / 175
  of them, so windows with fewer benchmark n-grams can't match and get no fingerprint. This
  loses nothing; most documents have no such window.
* The remaining windows get a 64-bit SimHash. Items are indexed by each of RADIUS + 1 bit
  blocks of their fingerprints; fingerprints at most RADIUS bits apart agree in one block
  at least, so lookups find all of them. At similarity 0.75 two fingerprints differ in 11
  bits on average (standard deviation 3); RADIUS is four deviations above; some few
  pairs in 100,000 that lie right at the bound are further apart and are lost.
  The k-th occurrence of an n-gram in a window is a feature of its own, so the similarity is
  that of two sets and one n-gram that repeats can't outweigh the others.
* Candidates are verified on the weighted n-grams themselves.
"""

from __future__ import annotations

import functools

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rarebird.llm.ngram_join import DEN, NUM, PLACE, WORDS, _bytes_of, _mix, word_hashes

BITS, RADIUS = 64, 23
#: Benchmark text in a block (one broadcast, one pass over the documents).
BLOCK_BYTES = 32 << 20


def grams_of(words: np.ndarray, size: int = WORDS) -> np.ndarray:
    """Hash of each n-gram of one word sequence, in order."""
    if len(words) < size:
        return np.zeros(0, np.uint64)
    total = np.zeros(len(words) - size + 1, np.uint64)
    for k in range(size):
        total += words[k:k + len(total)] * PLACE[k % len(PLACE)]
    return _mix(total)


def simhash(signs: np.ndarray) -> np.ndarray:
    """Fingerprints from rows of summed signs, one column for each bit."""
    return np.packbits(signs > 0, axis=-1, bitorder="little").view(np.uint64)[..., 0]


def signs_of(grams: np.ndarray) -> np.ndarray:
    bits = np.unpackbits(grams[:, None].view(np.uint8), axis=1, bitorder="little")
    return bits.astype(np.int32) * 2 - 1


def occurrences(windows: np.ndarray) -> np.ndarray:
    """Features of the windows (rows) of n-grams: an n-gram's first occurrence is itself, each further one another hash."""
    grams = np.sort(windows, axis=1)
    at = np.broadcast_to(np.arange(grams.shape[1]), grams.shape)
    first = np.ones(grams.shape, bool)
    first[:, 1:] = grams[:, 1:] != grams[:, :-1]
    nth = (at - np.maximum.accumulate(np.where(first, at, 0), axis=1)).astype(np.uint64)
    return np.where(first, grams, _mix(grams + nth * PLACE[0]))


def last_repeats(grams: np.ndarray) -> np.ndarray:
    """For each place, the latest one whose n-gram stands again up to here (-1: none). Below a window's start, it holds no n-gram twice."""
    order = np.argsort(grams, kind="stable")
    before = np.full(len(grams), -1)
    same = grams[order[1:]] == grams[order[:-1]]
    before[order[1:][same]] = order[:-1][same]
    return np.maximum.accumulate(before)


def fewest(a: int, b: int) -> int:
    """The fewest shared entries of two similar n-gram lists."""
    return -(-NUM * (a + b) // (DEN + NUM))


def block_edges(radius: int) -> np.ndarray:
    return np.linspace(0, BITS, radius + 2).round().astype(np.int64)


class Index:
    """The items of one length, by their fingerprints' bit blocks."""

    def __init__(self, words: int, ids: list[int], grams: list[np.ndarray], radius: int) -> None:
        self.words, self.size = words, min(words, WORDS)
        self.grams_in = words - self.size + 1
        #: The fewest benchmark n-grams of a window that can match.
        self.needed = fewest(self.grams_in, self.grams_in)
        self.ids, self.radius = np.array(ids, np.int64), radius
        self.weights = [np.unique(g, return_counts=True) for g in grams]
        self.prints = np.array([simhash(signs_of(occurrences(g[None])[0]).sum(0)[None])[0] for g in grams], np.uint64)
        self.blocks = []
        edges = block_edges(radius)
        for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            value = self.prints >> np.uint64(a) & np.uint64((1 << (b - a)) - 1)
            order = np.argsort(value, kind="stable")
            self.blocks.append((np.uint64(a), np.uint64((1 << (b - a)) - 1), value[order], order))

    def near(self, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(window, item) of all fingerprints at most ``radius`` bits apart."""
        found = []
        for shift, mask, values, order in self.blocks:
            of = prints >> shift & mask
            lo, hi = np.searchsorted(values, of, "left"), np.searchsorted(values, of, "right")
            n = hi - lo
            window = np.repeat(np.arange(len(prints)), n)
            item = order[np.arange(int(n.sum())) + np.repeat(lo - (np.cumsum(n) - n), n)]
            close = np.bitwise_count(prints[window] ^ self.prints[item]) <= self.radius
            found.append(window[close] * len(self.ids) + item[close])
        return np.divmod(np.unique(np.concatenate(found)), len(self.ids))

    def similarity(self, window: np.ndarray, item: int) -> tuple[int, int]:
        """(shared weight, total weight) of a window's n-grams and an item's."""
        grams, counts = np.unique(window, return_counts=True)
        own, weights = self.weights[item]
        _, i, j = np.intersect1d(grams, own, assume_unique=True, return_indices=True)
        shared = int(np.minimum(counts[i], weights[j]).sum())
        return shared, int(counts.sum() + weights.sum()) - shared


def build(items: list[tuple[int, str]], radius: int) -> tuple[list[Index], dict[int, np.ndarray]]:
    """(an index for each item length, the sorted n-grams of all items by n-gram size)."""
    by_length: dict[int, tuple[list, list]] = {}
    seen: dict[int, list] = {}
    for i, text in items:
        words, _ = word_hashes([(text or "").encode()])
        if not len(words):
            continue
        size = min(len(words), WORDS)
        grams = grams_of(words, size)
        ids, all_grams = by_length.setdefault(len(words), ([], []))
        ids.append(i)
        all_grams.append(grams)
        seen.setdefault(size, []).append(grams)
    return ([Index(n, *x, radius) for n, x in sorted(by_length.items())],
            {k: np.unique(np.concatenate(v)) for k, v in seen.items()})


@functools.lru_cache(maxsize=2)
def _built(items: tuple, radius: int):
    return build(list(items), radius)


def window_signs(grams: np.ndarray, repeats: np.ndarray, start: np.ndarray, size: int) -> np.ndarray:
    """Summed signs of the windows of ``size`` n-grams at the ascending places ``start``."""
    signs = np.empty((len(start), BITS), np.int32)
    plain = repeats[start + size - 1] < start
    part = start[plain]
    if len(part):
        lo, hi = int(part[0]), int(part[-1]) + size
        if hi - lo > 8 * len(part) * size:  # far apart: window by window
            signs[plain] = np.stack([signs_of(grams[s:s + size]).sum(0) for s in part.tolist()])
        else:
            run = np.concatenate([np.zeros((1, BITS), np.int32), np.cumsum(signs_of(grams[lo:hi]), axis=0, dtype=np.int32)])
            signs[plain] = run[part - lo + size] - run[part - lo]
    each = max(1, (1 << 15) // size)
    rest = np.flatnonzero(~plain)
    for at in range(0, len(rest), each):  # n-grams that repeat inside the window
        some = rest[at:at + each]
        features = occurrences(grams[start[some][:, None] + np.arange(size)])
        signs[some] = signs_of(features.ravel()).reshape(len(some), size, BITS).sum(1)
    return signs


def matches_of(words: np.ndarray, indexes: list[Index], known: dict[int, np.ndarray]):
    """Yield (item id, first word, words, shared, total) of the windows of one document that match."""
    hits = {}
    for size, benchmark in known.items():
        grams = grams_of(words, size)
        at = np.minimum(np.searchsorted(benchmark, grams), len(benchmark) - 1)
        hit = benchmark[at] == grams
        if hit.any():
            hits[size] = grams, np.concatenate([[0], np.cumsum(hit)]), last_repeats(grams)
    for index in indexes:
        if index.size not in hits:
            continue
        grams, before, repeats = hits[index.size]
        size = min(index.grams_in, len(grams))  # a shorter document is one window
        needed = fewest(size, index.grams_in)
        if before[-1] < needed or size < needed:
            continue
        start = np.flatnonzero(before[size:] - before[:-size] >= needed)
        for part in np.array_split(start, max(1, len(start) // 2048)):
            if not len(part):
                continue
            for w, item in zip(*index.near(simhash(window_signs(grams, repeats, part, size))), strict=True):
                s = int(part[w])
                shared, total = index.similarity(grams[s:s + size], int(item))
                if DEN * shared >= NUM * total:
                    yield int(index.ids[item]), s, min(index.words, len(words)), shared, total


def _matches(sent, radius: int):
    def run(batches):
        import pyarrow as pa

        from rarebird.llm.arrowbatch import text_chunks

        indexes, known = _built(sent.value, radius)
        for chunk in text_chunks(batches):
            words, n = word_hashes(_bytes_of(chunk))
            to = np.cumsum(n)
            rows, out = [], []
            for r, (a, b) in enumerate(zip((to - n).tolist(), to.tolist(), strict=True)):
                best: dict[int, tuple] = {}
                for item, s, size, shared, total in matches_of(words[a:b], indexes, known):
                    if item not in best or shared * best[item][3] > best[item][2] * total:
                        best[item] = (s, size, shared, total)
                for item, (s, size, shared, total) in best.items():
                    rows.append(r)
                    out.append((item, s, size, shared / total))
            if rows:
                cols = list(zip(*out, strict=True))
                yield pa.RecordBatch.from_arrays(
                    [chunk.column("id").take(pa.array(rows)), *[pa.array(c, pa.int64()) for c in cols[:3]], pa.array(cols[3], pa.float64())],
                    names=["id", "item_id", "first_word", "n_words", "similarity"])

    return run


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  item_col: str = "item_id", item_text: str = "text", radius: int = RADIUS) -> DataFrame:
    """(id, item_id, first_word, n_words, similarity): each item that a document holds, with its best window.

    Of windows as similar, the first counts; a document shorter than the item is one window. Null, empty and blank texts and items match
    nothing; an item of fewer than 5 words must occur word for word; equal items are
    reported each; null or repeated document ids keep their rows' matches. Empty tables
    give an empty result. Other columns are not read.
    """
    spark = docs.sparkSession
    items = benchmark.select(F.col(item_col).cast("long").alias("item"), F.col(item_text).alias("text")).where(
        F.col("item").isNotNull() & F.col("text").isNotNull()).distinct()
    size = items.agg(F.sum(F.octet_length("text") + 16)).first()[0] or 0
    blocks = -(-size // BLOCK_BYTES)
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"id {kind}, item_id long, first_word long, n_words long, similarity double"
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where(F.col("text").isNotNull())
    out = spark.createDataFrame([], schema)
    for block in range(blocks):
        part = items.where(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == block).orderBy("item", "text").collect()  # BLOCK_BYTES of text
        sent = spark.sparkContext.broadcast(tuple((r.item, r.text) for r in part))
        found = rows.mapInArrow(_matches(sent, radius), schema)
        out = found if blocks == 1 else out.union(found)
    return out.withColumnRenamed("id", id_col)
