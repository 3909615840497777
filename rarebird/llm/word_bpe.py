"""BPE encoding and decoding by batched numpy merge rounds.

The symbols of many words lie in one flat array. A round looks up the rank of every
adjacent pair by binary search over the sorted pair keys, finds the lowest rank in each
word, and merges all places of that pair in all words at once; words without a known
pair leave. The vocabulary says which merges come first, so this gives the same ids as
merging one pair at a time (checked when the table is loaded: the parts of a merge are
made by earlier merges).

Words are the pre-tokens of :mod:`rarebird.llm.pretokens`; a task keeps the ids of words
it has met in a bounded cache. Decoding maps ids back to the vocabulary's strings and
joins them by a space, which is what the library does for a vocabulary without a decoder.
"""

from __future__ import annotations

import functools
import json

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rarebird.llm import vocab

NO_RANK = np.iinfo(np.int64).max


def byte_letters() -> list[str]:
    """The printable letter of each byte: itself where printable in Latin-1, else 256, 257, ... in order."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(spare)) for b in range(256)]


class MergeTable:
    """Symbols and merges of a byte-level BPE file, as sorted arrays."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        ids = model["vocab"]
        end = model["end_of_word_suffix"] or ""
        self.special_ids = {a["content"]: a["id"] for a in spec["added_tokens"]}
        self.tokens = [""] * (max([*ids.values(), *self.special_ids.values()]) + 1)
        for token, i in [*ids.items(), *self.special_ids.items()]:
            self.tokens[i] = token
        letters = byte_letters()
        self.inner = np.array([ids[c] for c in letters], np.int64)
        self.final = np.array([ids[c + end] for c in letters], np.int64)
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        left = np.array([ids[a] for a, _ in pairs], np.int64)
        right = np.array([ids[b] for _, b in pairs], np.int64)
        made = np.array([ids[a + b] for a, b in pairs], np.int64)
        rank = np.arange(len(pairs), dtype=np.int64)
        first_made = np.full(len(self.tokens), -1, np.int64)
        first_made[made[::-1]] = rank[::-1]
        #: Whether all places of a pair may be merged at once; if not, one place a round.
        self.at_once = bool((first_made[left] < rank).all() and (first_made[right] < rank).all())
        key = left << 32 | right
        order = np.argsort(key, kind="stable")
        self.keys, self.ranks, self.made = key[order], rank[order], made[order]
        self.made_by_rank = made

    def rank_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left << 32 | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], NO_RANK)

    def encode(self, words: list[str]) -> list[bytes]:
        """Each word's ids as little-endian unsigned 32-bit integers."""
        out: list[bytes] = [b""] * len(words)
        plain = []
        for i, w in enumerate(words):
            if w in self.special_ids:
                out[i] = np.uint32(self.special_ids[w]).tobytes()
            elif w:
                plain.append(i)
        if not plain:
            return out
        data = [words[i].encode("utf-8", "surrogatepass") for i in plain]
        size = np.fromiter(map(len, data), np.int64, len(data))
        raw = np.frombuffer(b"".join(data), np.uint8)
        sym = self.inner[raw]
        ends = np.cumsum(size)
        sym[ends - 1] = self.final[raw[ends - 1]]
        word = np.repeat(np.arange(len(data)), size)
        rank = np.full(len(sym), NO_RANK, np.int64)  # of the pair that begins here
        same = np.flatnonzero(word[1:] == word[:-1])
        rank[same] = self.rank_of(sym[same], sym[same + 1])
        done_sym, done_word = [], []
        while len(sym):
            starts = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
            runs = np.diff(np.append(starts, len(sym)))
            low = np.minimum.reduceat(rank, starts)
            live = np.repeat(low < NO_RANK, runs)
            if not live.all():
                done_sym.append(sym[~live])
                done_word.append(word[~live])
                low, runs = low[low < NO_RANK], runs[low < NO_RANK]
                sym, word, rank = sym[live], word[live], rank[live]
                if not len(sym):
                    break
            at = np.flatnonzero(rank == np.repeat(low, runs))
            if self.at_once:  # of overlapping places (a a a) take the first, third, ...
                fresh = np.append(True, np.diff(at) != 1)
                since = np.arange(len(at)) - np.maximum.accumulate(np.where(fresh, np.arange(len(at)), 0))
                at = at[since % 2 == 0]
            else:
                at = at[np.append(True, word[at[1:]] != word[at[:-1]])]
            sym[at] = self.made_by_rank[rank[at]]
            keep = np.ones(len(sym), bool)
            keep[at + 1] = False
            new = np.cumsum(keep) - 1
            at = new[at]
            sym, word, rank = sym[keep], word[keep], rank[keep]
            touched = np.unique(np.concatenate([at, at[at > 0] - 1]))
            rank[touched] = NO_RANK
            touched = touched[touched + 1 < len(sym)]
            touched = touched[word[touched] == word[touched + 1]]
            rank[touched] = self.rank_of(sym[touched], sym[touched + 1])
        sym, word = np.concatenate(done_sym), np.concatenate(done_word)
        order = np.argsort(word, kind="stable")
        flat = sym[order].astype("<u4").tobytes()
        to = 4 * np.cumsum(np.bincount(word, minlength=len(data)))
        for i, a, b in zip(plain, [0, *to[:-1].tolist()], to.tolist(), strict=True):
            out[i] = flat[a:b]
        return out

    def decode(self, ids: bytes) -> str:
        return " ".join([self.tokens[i] for i in memoryview(ids).cast("I")])


@functools.cache
def merge_table(path: str) -> MergeTable:
    return MergeTable(path)


def _chunks(batches, path: str):
    """(chunk, values of the words met, word numbers, words of each document) of each chunk of texts."""
    from rarebird.llm import pretokens
    from rarebird.llm.arrowbatch import text_chunks, texts_of

    table, kept = merge_table(path), vocab.Cache(80_000)  # three strings a word

    def fresh(words):
        return [(b, " ".join(map(str, memoryview(b).cast("I"))), table.decode(b)) for b in table.encode(words)]

    for chunk in text_chunks(batches):
        words, counts = pretokens.cut(texts_of(chunk), "word", vocab.specials(path))
        numbers = kept.numbers(words, fresh)
        yield chunk, kept.values, numbers.tolist(), counts.tolist()


def _encode(path: str):
    def run(batches):
        import pyarrow as pa

        for chunk, values, numbers, counts in _chunks(batches, path):
            at, ids = 0, []
            for n in counts:
                ids.append(np.frombuffer(b"".join([values[i][0] for i in numbers[at:at + n]]), "<u4").astype(np.int32))
                at += n
            yield pa.RecordBatch.from_arrays([chunk.column("id"), pa.array(ids, pa.list_(pa.int32()))], names=["id", "ids"])

    return run


def _decode(path: str):
    def run(batches):
        import pyarrow as pa

        tokens = merge_table(path).tokens
        for b in batches:
            texts = [None if ids is None else " ".join([tokens[i] for i in ids]) for ids in b.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(texts, pa.string())], names=["id", "decoded"])

    return run


def _digests(path: str):
    def run(batches):
        import hashlib

        import pyarrow as pa

        for chunk, values, numbers, counts in _chunks(batches, path):
            at, n_tokens, ids_sha, decoded_sha = 0, [], [], []
            for n in counts:
                of = numbers[at:at + n]
                at += n
                ids, decimals, decoded = zip(*[values[i] for i in of], strict=True) if n else ((), (), ())
                n_tokens.append(sum(map(len, ids)) // 4)
                ids_sha.append(hashlib.sha256(" ".join(decimals).encode()).hexdigest())
                decoded_sha.append(hashlib.sha256(" ".join(decoded).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [chunk.column("id"), pa.array(n_tokens, pa.int64()), pa.array(ids_sha), pa.array(decoded_sha)],
                names=["id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return run


def _input(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, str]:
    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), kind


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids array<int>) for each row. Null and empty texts have no ids; null or repeated
    ids keep a row each; other columns are not read."""
    rows, kind = _input(docs, id_col, text_col)
    return rows.mapInArrow(_encode(path), f"id {kind}, ids array<int>").withColumnRenamed("id", id_col)


def decode(ids: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id, decoded): the vocabulary's strings joined by a space, special tokens kept. A
    null list gives null, an empty list an empty string."""
    kind = ids.schema[id_col].dataType.simpleString()
    return (ids.select(F.col(id_col).alias("id"), F.col(ids_col).alias("ids"))
            .mapInArrow(_decode(path), f"id {kind}, decoded string").withColumnRenamed("id", id_col))


def round_trip(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode each text, decode its ids, and return (id, n_tokens, ids_sha256, decoded_sha256).

    One pass without a shuffle: the ids of a document stay in its task. The digests are
    of the decimal ids joined by one space and of the decoded text in UTF-8. Null and
    empty texts have no ids and the digest of an empty string.
    """
    rows, kind = _input(docs, id_col, text_col)
    return (rows.mapInArrow(_digests(path), f"id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
            .withColumnRenamed("id", id_col))
