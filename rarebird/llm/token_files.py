"""Token files: canonical length-limited Huffman coding of token ids.

Writing: encode with the tokenizers library, count ids over all documents, build one
length-limited code (package-merge), code every document in independent blocks, and
write the blocks in ascending id order. A file row holds one document: its range part,
the ids before it in that part, its number of ids, the bit offset of each block (the
checkpoints) and the payload. The code itself is a second small table (id, length), from
which the canonical codes follow. Parquet is the container, so Spark commits whole
tasks and a lost executor leaves no half file.

Reading: a table with one entry for each ``limit``-bit window gives the next id and its
length. All blocks of a batch are decoded in step, one id of each block at a time.
"""

from __future__ import annotations

from itertools import chain
from typing import NamedTuple

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rarebird.llm import vocab
from rarebird.session import scratch_path

#: Ids between two checkpoints, and the longest code in bits.
BLOCK, LIMIT = 512, 16


# ------------------------------------------------------------------ the code

def code_lengths(counts: np.ndarray, limit: int = LIMIT) -> np.ndarray:
    """Optimal code lengths of at most ``limit`` bits by package-merge; 0 for a count of 0."""
    counts = np.asarray(counts, np.int64)
    used = np.flatnonzero(counts)
    lengths = np.zeros(len(counts), np.int64)
    if len(used) < 2:
        lengths[used] = 1
        return lengths
    if len(used) > 1 << limit:
        raise ValueError(f"{len(used)} ids need codes longer than {limit} bits")
    used = used[np.argsort(counts[used], kind="stable")]
    leaf = counts[used]
    levels, weight, is_leaf = [], leaf, np.ones(len(leaf), bool)
    for _ in range(limit - 1):
        levels.append(is_leaf)
        even = len(weight) // 2 * 2
        both = np.concatenate([leaf, weight[:even:2] + weight[1:even:2]])
        order = np.argsort(both, kind="stable")
        weight, is_leaf = both[order], order < len(leaf)
    levels.append(is_leaf)
    need = 2 * len(leaf) - 2
    for is_leaf in reversed(levels):  # the first `need` items; their packages ask for pairs one level down
        leaves = int(is_leaf[:need].sum())
        lengths[used[:leaves]] += 1
        need = 2 * (need - leaves)
    return lengths


class Code(NamedTuple):
    """Arrays by id (code, length) and by window of ``limit`` bits (next_id, next_length)."""

    code: np.ndarray
    length: np.ndarray
    next_id: np.ndarray
    next_length: np.ndarray
    limit: int


def canonical(lengths: np.ndarray, limit: int = LIMIT) -> Code:
    """Codes in order of (length, id), each the one before plus 1, shifted to its length."""
    lengths = np.asarray(lengths, np.int64)
    order = np.lexsort((np.arange(len(lengths)), lengths))
    order = order[lengths[order] > 0]
    spans = 1 << (limit - lengths[order])
    firsts = np.cumsum(spans) - spans
    code = np.zeros(len(lengths), np.uint64)
    code[order] = firsts >> (limit - lengths[order])
    size = 1 << limit
    next_id, next_length = np.zeros(size, np.uint32), np.ones(size, np.uint8)
    filled = int(spans.sum())
    next_id[:filled] = np.repeat(order, spans)
    next_length[:filled] = np.repeat(lengths[order], spans)
    return Code(code, lengths, next_id, next_length, limit)


def pack(ids: np.ndarray, counts: np.ndarray, code: Code, block: int = BLOCK):
    """Code documents of ``counts`` ids each. -> (payload bytes, byte offset of each document,
    bit offset of each block inside its document, blocks of each document)."""
    length = code.length[ids]
    doc_at = np.cumsum(counts) - counts
    ends = np.concatenate([[0], np.cumsum(length)])
    bits = ends[doc_at + counts] - ends[doc_at]
    size = (bits + 7) // 8
    byte_at = np.concatenate([[0], np.cumsum(size)])
    # a document starts at a whole byte
    start = ends[:-1] + np.repeat(8 * byte_at[:-1] - ends[doc_at], counts)
    blocks = -(-counts // block)
    within = np.arange(int(blocks.sum())) - np.repeat(np.cumsum(blocks) - blocks, blocks)
    checks = start[np.repeat(doc_at, blocks) + within * block] - np.repeat(8 * byte_at[:-1], blocks)
    words = np.zeros(int(byte_at[-1]) // 4 + 2, np.uint64)  # 32 bits each; codes don't overlap, so sums are ORs
    if len(ids):
        shifted = code.code[ids] << (64 - (start & 31) - length).astype(np.uint64)
        at = start >> 5
        first = np.flatnonzero(np.append(True, at[1:] != at[:-1]))
        words[at[first]] += np.add.reduceat(shifted >> np.uint64(32), first)
        words[at[first] + 1] += np.add.reduceat(shifted & np.uint64(0xFFFFFFFF), first)
    return words.astype(">u4").tobytes(), byte_at, checks, blocks


def unpack(payload: np.ndarray, block_bit: np.ndarray, block_ids: np.ndarray, code: Code) -> tuple[np.ndarray, np.ndarray]:
    """Decode blocks that begin at bits ``block_bit`` of ``payload`` and hold ``block_ids`` ids.
    -> (ids of all blocks in order, the bit after each block)."""
    padded = np.concatenate([payload, np.zeros(8, np.uint8)]).astype(np.uint32)
    window = padded[:-3] << 24 | padded[1:-2] << 16 | padded[2:-1] << 8 | padded[3:]
    order = np.argsort(-block_ids, kind="stable")
    bit, left = block_bit[order].astype(np.int64), block_ids[order]
    out_at = (np.cumsum(block_ids) - block_ids)[order]
    out = np.zeros(int(block_ids.sum()), np.uint32)
    mask, shift = np.uint32((1 << code.limit) - 1), 32 - code.limit
    live = np.searchsorted(-left, -np.arange(int(left.max(initial=0))), "left")  # blocks with more than t ids
    for t, n in enumerate(live.tolist()):
        at = bit[:n]
        seen = (window[at >> 3] >> (shift - (at & 7)).astype(np.uint32)) & mask
        out[out_at[:n] + t] = code.next_id[seen]
        at += code.next_length[seen]
    ends = np.zeros(len(bit), np.int64)
    ends[order] = bit
    return out, ends


# ------------------------------------------------------------------ Spark jobs

class WordIds:
    """Ids of the pre-tokens met so far, in one flat array; emptied before it outgrows ``words``
    of them or ``size`` bytes. It belongs to one task's iterator and ends with it."""

    #: Words that the library gets as one text.
    JOINED = 32

    def __init__(self, path: str, end_id: int, words: int = 500_000, size: int = 32 << 20) -> None:
        self.tokenizer, self.end_id = vocab.library(path), end_id
        self.specials = frozenset(x.encode() for x in vocab.specials(path))
        self.words, self.most = words, size
        self.newline = self._lists(["\n"])[0]
        self.clear()

    def clear(self) -> None:
        self.index: dict[bytes, int] = {}
        # number 0 is the end of a document
        self.flat, self.first, self.size, self.bytes = np.array([self.end_id], np.uint32), np.zeros(1, np.int64), np.ones(1, np.int64), 0

    def _lists(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _flat(self, lists: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
        size = np.fromiter(map(len, lists), np.int64, len(lists))
        return np.fromiter(chain.from_iterable(lists), np.uint32, int(size.sum())), size

    def _encode(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words in order, their number for each word) of words without white space but a space in front.

        The library gets JOINED words at a time, a line feed after each. Between such words a
        line feed is a pre-token of its own, and no word has its id, so that id shows where a
        word ends. Should it not, the words go one by one."""
        if len(self.newline) == 1:
            lists = self._lists([b"\n".join(words[i:i + self.JOINED]).decode() for i in range(0, len(words), self.JOINED)])
            for ids in lists:
                ids += self.newline
            flat, _ = self._flat(lists)
            ends = np.flatnonzero(flat == self.newline[0])
            if len(ends) == len(words):
                return np.delete(flat, ends), np.diff(ends, prepend=-1) - 1
        return self._alone(words)

    def _alone(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        return self._flat(self._lists([w.decode() for w in words]))

    def numbers(self, words: list[bytes]) -> np.ndarray:
        """The words' numbers, which are places in ``size``; they hold until the next call."""
        missing = set(words).difference(self.index)
        if len(self.index) + len(missing) > self.words or self.bytes > self.most:
            self.clear()
            missing = set(words)
        if missing:
            # a pre-token of the pattern is white space alone or has none but a space in front
            plain = [w for w in missing.difference(self.specials) if 32 < w[-1] < 127 or w[-1] > 127 and not w.decode()[-1].isspace()]
            rest = list(missing.difference(plain))
            for new, encode in ((plain, self._encode), (rest, self._alone)):
                flat, size = encode(new)
                self.index.update(zip(new, range(len(self.size), len(self.size) + len(new)), strict=True))
                self.first = np.concatenate([self.first, len(self.flat) + np.cumsum(size) - size])
                self.flat, self.size = np.concatenate([self.flat, flat]), np.concatenate([self.size, size])
            self.bytes += sum(map(len, missing))
        return np.fromiter(map(self.index.__getitem__, words), np.int64, len(words))


def encoded(path: str, end_id: int):
    """Task function: batches of (id, text, ...) -> batches of (id, n, ids as little-endian
    unsigned 32-bit integers, ``end_id`` last). The words met are kept while the task runs."""
    def run(batches):
        import pyarrow as pa

        from rarebird.llm import pretokens
        from rarebird.llm.arrowbatch import binary_slices, ragged, text_chunks, texts_of

        kept, specials = WordIds(path, end_id), vocab.specials(path)
        for chunk in text_chunks(batches):
            words, numbers, counts = pretokens.dictionary(texts_of(chunk), specials)
            places = np.append(kept.numbers(words), 0)  # the end comes after each document
            numbers = places[np.insert(numbers, np.cumsum(counts), len(places) - 1)]
            each = kept.size[numbers]
            ids = kept.flat[ragged(kept.first[numbers], each)]
            to = np.cumsum(each)[np.cumsum(counts + 1) - 1]
            yield pa.RecordBatch.from_arrays(
                [chunk.column("id"), pa.array(np.diff(to, prepend=0)), binary_slices(ids, np.append(0, to))],
                names=["id", "n", "ids"])

    return run


def token_ids(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 0) -> DataFrame:
    """(id, n long, ids binary of little-endian unsigned 32-bit integers) for each row: the
    library's ids of the text, then ``end_id``. Distinct pre-tokens are encoded once while a task keeps them."""
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(encoded(path, end_id), f"id {kind}, n long, ids binary")


def _id_counts(batches):
    import pyarrow as pa

    total = np.zeros(0, np.int64)
    for b in batches:
        more = np.bincount(np.frombuffer(b"".join(b.column("ids").to_pylist()), np.uint32))
        if len(more) > len(total):
            total, more = more, total
        total[:len(more)] += more
    used = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], names=["token", "count"])


def _coded(lengths: dict[int, int], limit: int, block: int):
    def run(batches):
        import pyarrow as pa

        from rarebird.llm.arrowbatch import binary_slices, text_chunks

        code = code_of(lengths, limit)
        for b in text_chunks(batches, "ids"):
            counts = np.asarray(b.column("n"), np.int64)
            ids = np.frombuffer(b"".join(b.column("ids").to_pylist()), np.uint32)
            payload, at, checks, blocks = pack(ids, counts, code, block)
            yield pa.RecordBatch.from_arrays(
                [b.column("part"), b.column("id"), b.column("n"),
                 binary_slices(checks.astype(np.uint32), np.append(0, np.cumsum(blocks))),
                 binary_slices(np.frombuffer(payload, np.uint8), at)],
                names=["part", "id", "n_tokens", "checkpoints", "payload"])

    return run


def code_of(lengths: dict[int, int], limit: int) -> Code:
    by_id = np.zeros(max(lengths, default=-1) + 1, np.int64)
    by_id[list(lengths)] = list(lengths.values())
    return canonical(by_id, limit)


def _local_starts(batches):
    """Ids before each row in its part; a task gets whole parts, sorted."""
    import pyarrow as pa

    part, total = None, 0
    for b in batches:
        parts, n = np.asarray(b.column("part")), np.asarray(b.column("n_tokens"), np.int64)
        before = np.cumsum(n) - n
        fresh = np.flatnonzero(np.append(True, parts[1:] != parts[:-1])) if len(n) else np.zeros(0, int)
        base = np.repeat(before[fresh], np.diff(np.append(fresh, len(n))))
        start = before - base
        if len(n):
            if parts[0] == part:
                start[parts == part] += total
            part, total = parts[-1], int(start[-1] + n[-1])
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array(start)], names=[*b.schema.names, "local_start"])


class TokenFile(NamedTuple):
    path: str
    limit: int
    block: int


def write_token_file(docs: DataFrame, tokenizer: str, path: str, id_col: str = "doc_id", text_col: str = "text",
                     end_id: int = 0, block: int = BLOCK, limit: int = LIMIT) -> TokenFile:
    """Encode and write ``docs`` under ``path`` (``files`` and ``code``) in ascending id order.

    Null texts are written as the end id alone; null ids come first; rows with equal ids
    are kept, one after another; an empty table writes empty tables.
    """
    spark = docs.sparkSession
    ids_path = scratch_path(spark, "ids")
    token_ids(docs, tokenizer, id_col, text_col, end_id).write.option("compression", "zstd").parquet(ids_path)
    ids = spark.read.parquet(ids_path)
    counted = ids.select("ids").mapInArrow(_id_counts, "token long, count long").groupBy("token").agg(F.sum("count").alias("count"))
    counts = {r.token: r["count"] for r in counted.collect()}  # at most one row for each id of the vocabulary
    by_id = np.zeros(max(counts, default=-1) + 1, np.int64)
    by_id[list(counts)] = list(counts.values())
    lengths = {int(i): int(n) for i, n in enumerate(code_lengths(by_id, limit)) if n}
    spark.createDataFrame(list(lengths.items()), "token long, length int").coalesce(1).write.parquet(f"{path}/code")
    n_parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    cuts = ids.select(F.percentile_approx("id", [i / n_parts for i in range(1, n_parts)], 10_000)).first()[0] or []
    part = F.lit(0)
    if cuts:
        bounds = F.array(*[F.lit(c) for c in sorted(set(cuts))])
        part = F.when(F.col("id").isNull(), 0).otherwise(F.size(F.filter(bounds, lambda c: c < F.col("id"))))
    kind = ids.schema["id"].dataType.simpleString()
    coded = ids.withColumn("part", part.cast("int")).mapInArrow(
        _coded(lengths, limit, block), f"part int, id {kind}, n_tokens long, checkpoints binary, payload binary")
    (coded.repartitionById(n_parts, F.col("part")).sortWithinPartitions("part", "id", "n_tokens", "payload")
     .mapInArrow(_local_starts, coded._jdf.schema().toDDL() + ", local_start long")
     .write.option("compression", "none").parquet(f"{path}/files"))
    return TokenFile(path, limit, block)


def _read(lengths: dict[int, int], limit: int, block: int, base: dict[int, int], digest: bool):
    def run(batches):
        import zlib

        import pyarrow as pa

        from rarebird.llm.arrowbatch import binary_slices, text_chunks

        code = code_of(lengths, limit)
        for b in text_chunks(batches, "payload", 1 << 20):
            counts = np.asarray(b.column("n_tokens"), np.int64)
            payloads = b.column("payload").to_pylist()
            size = np.fromiter(map(len, payloads), np.int64, len(payloads))
            at = 8 * (np.cumsum(size) - size)
            checks = np.frombuffer(b"".join(b.column("checkpoints").to_pylist()), np.uint32).astype(np.int64)
            blocks = -(-counts // block)
            first = np.cumsum(blocks) - blocks
            bit = checks + np.repeat(at, blocks)
            each = np.full(len(bit), block)
            each[first + blocks - 1] = counts - (blocks - 1) * block
            ids, ends = unpack(np.frombuffer(b"".join(payloads), np.uint8), bit, each, code)
            inner = np.ones(len(bit), bool)
            inner[first + blocks - 1] = False
            spare = at + 8 * size - ends[first + blocks - 1]
            if (ends[:-1][inner[:-1]] != bit[1:][inner[:-1]]).any() or ((spare < 0) | (spare > 7)).any():
                raise ValueError("a token file is damaged: a block does not end at the next checkpoint")
            to = np.append(0, np.cumsum(counts))
            parts = b.column("part").to_pylist()
            start = np.array([base[p] for p in parts], np.int64) + np.asarray(b.column("local_start"), np.int64)
            if digest:
                raw = memoryview(ids.astype("<u4").tobytes())
                last = pa.array([zlib.crc32(raw[4 * x:4 * y]) for x, y in zip(to[:-1].tolist(), to[1:].tolist(), strict=True)], pa.int64())
            else:
                last = binary_slices(ids, to)
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(start), pa.array(counts), last],
                                             names=["id", "start", "n_tokens", "out"])

    return run


def read_token_file(spark: SparkSession, file: TokenFile, id_col: str = "doc_id", digest: bool = False) -> DataFrame:
    """(id, start, n_tokens, ids binary), or ids_crc32 long in place of ids with ``digest``.

    ``start`` is the number of ids of all documents before this one. Every block must end
    where the next checkpoint says, else reading raises.
    """
    files = spark.read.parquet(f"{file.path}/files")
    lengths = {r.token: r.length for r in spark.read.parquet(f"{file.path}/code").collect()}
    parts = files.groupBy("part").agg(F.sum("n_tokens").alias("n")).orderBy("part").collect()  # a row for each range part
    base, before = {}, 0
    for r in parts:
        base[r.part] = before
        before += r.n
    kind = files.schema["id"].dataType.simpleString()
    out = files.mapInArrow(_read(lengths, file.limit, file.block, base, digest),
                           f"id {kind}, start long, n_tokens long, out {'long' if digest else 'binary'}")
    return out.withColumnsRenamed({"id": id_col, "out": "ids_crc32" if digest else "ids"})
