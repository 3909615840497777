"""Phrase collocations by SETM: sorted occurrence relations, merge joins, group counts, semi-joins.

The occurrence relation of length k holds (piece, position, phrase) for each place where a
frequent phrase of k words stands. It is persisted in blocks: a block has the occurrences of
some documents of one language (``BLOCK_BYTES`` of text), sorted by piece and position, as
arrays (a bit for each position, the phrase's number in the block, the phrases' ids).
Positions count on through a block and pass one place at the end of a piece, so "same
piece, next position" is "position + 1". From length k to k + 1:

1. merge-join: an occurrence at position p and one at p + 1 make one of length k + 1. It
   overlaps them in k - 1 words, so the two frequent parts name the new phrase exactly: a
   phrase is a pair of ids of shorter ones, never a hash;
2. group-count: the distinct phrases of each block with their counts, summed over all blocks
   of the language by one window; what is under ``min_count`` goes;
3. semi-join: the frequent phrases go back to their blocks, which persist the occurrences of
   these alone.

Only distinct phrases of blocks are shuffled for counting, so a word that makes up a third
of a corpus is one row a block. A block bounds what a task holds; phrase tables are joined,
never broadcast or collected. Relations that the next one replaces are deleted.
"""

from __future__ import annotations

import numpy as np
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rarebird.llm.tables import discard, materialize

#: Text of one block; a longer text is one block of its own.
BLOCK_BYTES = 12 << 20
#: The contract's separators of pieces; blanks separate words.
SEPARATORS, BLANKS = b".,;:!?\n\x0b\x0c\r", b" \t"
MARK = b"\xff"  # no byte of UTF-8
UNKNOWN = "und"


def _folding() -> bytes:
    """Byte by byte: A-Z in lower case, separators as MARK, blanks as a space."""
    table = bytearray(range(256))
    table[ord("A"):ord("Z") + 1] = range(ord("a"), ord("z") + 1)
    for c in SEPARATORS:
        table[c] = MARK[0]
    for c in BLANKS:
        table[c] = ord(" ")
    return bytes(table)


class Block:
    """Occurrences of words: their numbers in order, 0 where a piece ends."""

    def __init__(self) -> None:
        self.index: dict[bytes, int] = {MARK: 0}
        self.parts: list[np.ndarray] = []
        self.size = 0

    def add(self, texts: list[bytes], folding: bytes) -> None:
        data = MARK.join([*texts, b""]).translate(folding).replace(MARK, b" " + MARK + b" ")
        words = data.split()
        index = self.index
        for w in set(words).difference(index):
            index[w] = len(index)
        self.parts.append(np.fromiter(map(index.__getitem__, words), np.int32, len(words)))
        self.size += len(data)


def _words(block_bytes: int):
    """(lang, text) -> a row for each block: its distinct words, most frequent first, their counts, and its occurrences."""
    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        from rarebird.llm.arrowbatch import text_chunks

        folding, blocks = _folding(), {}
        number = TaskContext.get().partitionId() << 33

        def flush(lang):
            nonlocal number
            block = blocks.pop(lang)
            occ = np.concatenate(block.parts)
            counts = np.bincount(occ, minlength=len(block.index))
            counts[0] = len(occ) + 1  # the mark stays first
            order = np.argsort(-counts, kind="stable")
            place = np.empty(len(order), np.int32)
            place[order] = np.arange(len(order), dtype=np.int32)
            if len(order) > 1:
                words = pa.array(list(block.index), pa.binary()).take(pa.array(order[1:])).cast(pa.string())
                lists = [pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), x) for x in (words, pa.array(counts[order[1:]]))]
                yield pa.RecordBatch.from_arrays([pa.array([number]), pa.array([lang]), *lists, pa.array([_planes(place[occ])], pa.binary())],
                                                 names=["block", "lang", "words", "n", "occ"])
                number += 1

        for chunk in text_chunks(batches):
            langs = chunk.column("lang").to_pylist()
            texts = chunk.column("text").cast(pa.binary()).to_pylist()
            by: dict[str, list[bytes]] = {}
            for lang, text in zip(langs, texts, strict=True):
                if text:
                    by.setdefault(lang, []).append(text)
            for lang, some in by.items():
                block = blocks.setdefault(lang, Block())
                block.add(some, folding)
                if block.size >= block_bytes:
                    yield from flush(lang)
        for lang in list(blocks):
            yield from flush(lang)

    return run


def _word_counts(batches):
    """Blocks of words -> (block, lang, local, word, n)."""
    import pyarrow as pa

    for b in batches:
        size = np.diff(np.asarray(b.column("words").offsets))
        at = pa.array(np.repeat(np.arange(b.num_rows), size))
        local = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        yield pa.RecordBatch.from_arrays([b.column("block").take(at), b.column("lang").take(at), pa.array(local.astype(np.int32)), b.column("words").flatten(), b.column("n").flatten()],
                                         names=["block", "lang", "local", "word", "n"])


def _planes(numbers: np.ndarray) -> bytes:
    """32-bit numbers by byte, all lowest bytes first, compressed: the high bytes of small numbers come to nothing."""
    return zstandard.compress(np.ascontiguousarray(numbers, "<u4").view(np.uint8).reshape(-1, 4).T.tobytes())


def _numbers(row, name: str) -> np.ndarray:
    return np.frombuffer(zstandard.decompress(row.column(name)[0].as_buffer()), np.uint8).reshape(4, -1).T.copy().view("<i4").ravel()


def _array(row, name: str, kind) -> np.ndarray:
    return np.frombuffer(row.column(name)[0].as_buffer(), kind)


def _joined(row) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Merge-join of a block's occurrences with those one position on: (position of each longer
    occurrence, its two parts as one number, the ids that the parts are places of)."""
    pos = np.flatnonzero(np.unpackbits(_array(row, "bits", np.uint8)))
    pid, ids = _numbers(row, "pid"), _array(row, "ids", np.int64)
    next_to = np.flatnonzero(pos[1:] == pos[:-1] + 1)
    return pos[next_to].astype(np.int32), pid[next_to].astype(np.int64) * len(ids) + pid[next_to + 1], ids


def _pair_counts(batches):
    """Blocks of occurrences -> (block, local, a, b, n): the distinct phrases one word longer, not shortened yet."""
    import pyarrow as pa

    for batch in batches:
        for i in range(batch.num_rows):
            row = batch.slice(i, 1)
            _, pair, ids = _joined(row)
            made, n = np.unique(pair, return_counts=True)
            del pair
            for at in range(0, len(made), 1 << 16):
                a, b = np.divmod(made[at:at + (1 << 16)], len(ids))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(a), row.column("block")[0].as_py())), pa.array(np.arange(at, at + len(a), dtype=np.int32)),
                     pa.array(ids[a]), pa.array(ids[b]), pa.array(n[at:at + len(a)].astype(np.int64))], names=["block", "local", "a", "b", "n"])


def _semi_join(words: bool):
    """Rows sorted by block, its occurrences first and then its frequent phrases (local, id) -> blocks
    with the occurrences of these phrases."""
    def run(batches):
        import pyarrow as pa

        def kept(row, local, ids):
            if not local:
                return
            local, ids = np.concatenate(local), np.concatenate(ids)
            if words:
                occ = _numbers(row, "pid")
                pos = np.flatnonzero(occ)
                of = occ[pos] - 1
            else:
                pos, of, _ = _joined(row)
                of = np.unique(of, return_inverse=True)[1]
            known = np.full(int(of.max()) + 1, -1, np.int32)
            known[local] = np.arange(len(local), dtype=np.int32)
            pid = known[of]
            pos, pid = pos[pid >= 0], pid[pid >= 0]
            order = np.argsort(-np.bincount(pid, minlength=len(ids)), kind="stable")  # small numbers for frequent ones
            place = np.empty(len(order), np.int32)
            place[order] = np.arange(len(order), dtype=np.int32)
            bits = np.zeros(int(pos[-1]) + 1, bool)
            bits[pos] = True
            yield pa.RecordBatch.from_arrays([row.column("block"), row.column("lang"), *[pa.array([x], pa.binary()) for x in (np.packbits(bits).tobytes(), _planes(place[pid]), ids[order].tobytes())]],
                                             names=["block", "lang", "bits", "pid", "ids"])

        now = None
        for b in batches:
            heads = np.flatnonzero(np.asarray(b.column("pid").is_valid()))
            cuts = sorted({0, *heads.tolist(), b.num_rows})
            for x, y in zip(cuts, cuts[1:], strict=False):
                part = b.slice(x, y - x)
                if part.column("pid")[0].is_valid:
                    if now is not None:
                        yield from kept(*now)
                    now = (part.slice(0, 1), [], [])
                    part = part.slice(1)
                if part.num_rows:
                    now[1].append(np.asarray(part.column("local")))
                    now[2].append(np.asarray(part.column("id")))
        if now is not None:
            yield from kept(*now)

    return run


def _frequent(rows: DataFrame, names: list[str], min_count: int, length: int) -> DataFrame:
    """Distinct phrases of blocks whose counts over all blocks of the language reach ``min_count``: with
    an ``id`` each. The first row of a phrase has its parts and ``f``, the sum, the others only what their
    block needs. One shuffle."""
    same = Window.partitionBy(*names)
    counted = rows.withColumn("f", F.sum("n").over(same)).where(F.col("f") >= min_count).drop("n")
    counted = counted.withColumn("uid", F.monotonically_increasing_id()).withColumn("id", F.min("uid").over(same))
    first = F.col("uid") == F.col("id")
    return materialize(counted.select("block", "local", "id", *[F.when(first, F.col(c)).alias(c) for c in (*names, "f")]), f"frequent{length}")


def _kept(relation: DataFrame, frequent: DataFrame, length: int) -> DataFrame:
    """The relation of this length: occurrences of frequent phrases."""
    none = lambda kind, name: F.lit(None).cast(kind).alias(name)
    bits, ids = (none("binary", "bits"), none("binary", "ids")) if length == 1 else ("bits", "ids")
    heads = relation.select("block", "lang", none("int", "local"), none("long", "id"), bits, F.col("occ" if length == 1 else "pid").alias("pid"), ids)
    known = frequent.select("block", none("string", "lang"), "local", "id", none("binary", "bits"), none("binary", "pid"), none("binary", "ids"))
    rows = heads.union(known).repartition("block").sortWithinPartitions("block", F.col("local").asc_nulls_first())
    return materialize(rows.mapInArrow(_semi_join(length == 1), "block long, lang string, bits binary, pid binary, ids binary"), f"occurrences{length}")


def _occurrences(docs: DataFrame, lang_col: str, text_col: str, block_bytes: int) -> DataFrame:
    """All words in blocks."""
    rows = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit(UNKNOWN)).alias("lang"), F.col(text_col).alias("text"))
    return materialize(rows.mapInArrow(_words(block_bytes), "block long, lang string, words array<string>, n array<long>, occ binary"), "words")


def _exact(c) -> F.Column:
    return F.col(c).cast("decimal(20,0)") if isinstance(c, str) else c.cast("decimal(20,0)")


def phrases(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", min_count: int = 30, max_words: int = 4, cover: int = 80,
            block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """All kept phrases: (lang, phrase, words, a, l, r, score).

    Texts have A-Z in lower case and are split into pieces at ``SEPARATORS`` and those into
    words at blanks. A candidate has 2 to ``max_words`` words and ``a`` >= ``min_count``
    occurrences in its language; of its cuts into two parts with l and r occurrences the one
    with the lowest score floor(2000000 a / (l + r)) counts, the shortest first part in a tie.
    Candidates inside a longer one that has at least ``cover`` percent of their occurrences
    go (a longer one by one word decides, as it has no fewer occurrences than those beyond
    it). Null languages count as ``und``, null texts as empty; ids are not read, so null or
    repeated ids and other columns change nothing; an empty table gives an empty result. A
    text must fit in a task's memory.
    """
    return _mined(_occurrences(docs, lang_col, text_col, block_bytes), min_count, max_words, cover)


def _mined(blocks: DataFrame, min_count: int, max_words: int, cover: int) -> DataFrame:
    first = F.col("f").isNotNull()
    relation, table, out = blocks, None, None
    for length in range(1, max_words + 1):
        if length == 1:
            rows = blocks.select("block", "lang", "words", "n").mapInArrow(_word_counts, "block long, lang string, local int, word string, n long")
            frequent = _frequent(rows, ["lang", "word"], min_count, length)
            # heads: occurrences of the first 1, 2, ... words; tails: of the words from the first, second, ... on
            longer = frequent.where(first).select("lang", "id", F.lit(None).cast("long").alias("a"), F.lit(None).cast("long").alias("b"), F.col("word").alias("phrase"),
                                                  F.col("word").alias("last"), "f", F.array("f").alias("heads"), F.array("f").alias("tails"))
        else:
            rows = relation.select("block", "bits", "pid", "ids").mapInArrow(_pair_counts, "block long, local int, a long, b long, n long")
            frequent = _frequent(rows, ["a", "b"], min_count, length)
            left = table.select("lang", F.col("id").alias("a"), F.col("phrase").alias("front"), F.col("heads").alias("front_heads"))
            right = table.select(F.col("id").alias("b"), "last", F.col("tails").alias("back_tails"))
            longer = (frequent.where(first).select("id", "a", "b", "f").join(left, "a").join(right, "b")
                      .select("lang", "id", "a", "b", F.concat_ws(" ", "front", "last").alias("phrase"), "last", "f",
                              F.concat("front_heads", F.array("f")).alias("heads"), F.concat(F.array("f"), "back_tails").alias("tails")))
        longer = materialize(longer, f"phrases{length}")
        if length < max_words:
            before, relation = relation, _kept(relation, frequent, length)
            discard(before)
        discard(frequent)
        if length > 2:
            out = _uncovered(table, longer, cover, out, length - 1)
        table = longer
    if max_words > 1:
        discard(relation)
    return _uncovered(table, None, cover, out, max_words)


def _uncovered(table: DataFrame, longer: DataFrame | None, cover: int, before: DataFrame | None, length: int) -> DataFrame:
    """Candidates of ``table`` that no phrase of ``longer`` covers, with their lowest cut; after those of ``before``."""
    if longer is not None:
        most = (longer.select(F.explode(F.array("a", "b")).alias("id"), F.col("f").alias("most")).groupBy("id").agg(F.max("most").alias("most")))
        covered = F.coalesce(_exact("most") * 100 >= _exact("f") * cover, F.lit(False))
        table = table.join(most, "id", "left").where(~covered)

    def cut(k):
        l, r = F.get("heads", k - 1), F.get("tails", k)
        return F.struct(F.call_function("div", _exact("f") * 2_000_000, _exact(l) + _exact(r)).cast("long").alias("score"), k.alias("k"), l.alias("l"), r.alias("r"))

    cuts = F.transform(F.sequence(F.lit(1), F.size("heads") - 1), cut)
    rows = (table.select("lang", "phrase", F.lit(length).alias("words"), F.col("f").alias("a"), F.array_min(cuts).alias("cut"))
            .select("lang", "phrase", "words", "a", "cut.l", "cut.r", "cut.score"))
    return rows if before is None else before.union(rows)


def top_phrases(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", top: int = 2000, min_count: int = 30, max_words: int = 4,
                cover: int = 80, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the first ``top`` phrases of each language by score
    descending, occurrences descending, phrase ascending; ``n`` is the number of its words.
    See :func:`phrases`."""
    blocks = _occurrences(docs, lang_col, text_col, block_bytes)
    size = F.aggregate("n", F.lit(0).cast("long"), lambda x, y: x + y)
    totals = materialize(blocks.groupBy("lang").agg(F.sum(size).alias("n")), "totals")
    best = Window.partitionBy("lang").orderBy(F.col("score").desc(), F.col("a").desc(), "phrase")
    ranked = _mined(blocks, min_count, max_words, cover).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
