"""Language ID by string kernels: Nystroem landmarks and one-versus-rest kernel ridge regression.

The kernel of two texts is the number of n-grams (orders 1 to 3, the blended spectrum)
that both contain, over the root of the product of their numbers of n-grams. N-grams are
taken from lower-cased letters, every other character being a blank, and are hashed to
``1 << BITS`` features; presence, not frequency, counts.

Fitting uses a bounded sample of labelled rows (``TRAIN_ROWS``, equal shares for all
languages, drawn by a hash of the id); the tasks turn its texts into bit sets, so the
driver gets TRAIN_ROWS * 4 kB at most, whatever the lengths. The landmarks' map and the
ridge weights are folded into one (features x languages) matrix, with which tasks score
batches of whole texts as matrix products.
"""

from __future__ import annotations

import functools
import sys
import unicodedata
from typing import NamedTuple

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ORDERS, BITS = (1, 2, 3), 15
#: Documented bounds of the fit: labelled rows, landmarks among them.
TRAIN_ROWS, LANDMARKS = 4096, 384
RIDGE = 1e-3
#: Texts in a matrix product.
ROWS = 64
UNKNOWN = "und"
MIX = np.uint64(0x9E3779B97F4A7C15)  # odd multiplier of a multiply-shift hash


class Model(NamedTuple):
    langs: list[str]
    weights: np.ndarray  # (1 << BITS, languages)
    bias: np.ndarray


@functools.cache
def _letters() -> np.ndarray:
    """Each code point's lower-case letter, or a blank."""
    table = np.full(sys.maxunicode + 1, 32, np.uint32)
    for c in range(sys.maxunicode + 1):
        if unicodedata.category(chr(c))[0] == "L":
            low = chr(c).lower()
            table[c] = ord(low) if len(low) == 1 else c
    return table


def presence(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(texts x features booleans, whether each text has a letter)."""
    flags = np.zeros((len(texts), 1 << BITS), bool)
    lens = np.fromiter(map(len, texts), np.int64, len(texts))
    ends = np.cumsum(lens)
    cp = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    cp = _letters()[cp].astype(np.uint64)
    gram = cp
    for order in ORDERS:
        if order > 1:
            gram = gram[:-1] << np.uint64(21) | cp[order - 1:]
        # the order is part of the feature
        hashed = ((gram * MIX + np.uint64(order)) * MIX >> np.uint64(64 - BITS)).astype(np.int64)
        for row, a, b in zip(flags, (ends - lens).tolist(), (ends - order + 1).tolist(), strict=True):
            if b > a:
                row[hashed[a:b]] = True
    letters = np.concatenate([[0], np.cumsum(cp != 32)])
    return flags, letters[ends] > letters[ends - lens]


def _unit_rows(bits: np.ndarray) -> np.ndarray:
    x = np.unpackbits(bits, axis=1).astype(np.float32)
    return x / np.sqrt(np.maximum(x.sum(1, keepdims=True), 1))


def solve(bits: np.ndarray, labels: np.ndarray, langs: list[str], landmarks: int, ridge: float) -> Model:
    """Nystroem kernel ridge regression on packed presence rows, unpacked a block at a time."""
    marks = _unit_rows(bits[:landmarks])
    value, vector = np.linalg.eigh((marks @ marks.T).astype(np.float64))
    fine = value > 1e-6 * value[-1]
    root = vector[:, fine] / np.sqrt(value[fine])  # K_LL^(-1/2) up to a rotation
    phi = np.concatenate([(_unit_rows(bits[at:at + 256]) @ marks.T).astype(np.float64) @ root for at in range(0, len(bits), 256)])
    target = np.where(labels[:, None] == np.arange(len(langs)), 1.0, -1.0)
    bias, centre = target.mean(0), phi.mean(0)
    gram = (phi - centre).T @ (phi - centre)
    w = np.linalg.solve(gram + ridge * len(bits) * np.eye(gram.shape[0]), (phi - centre).T @ (target - bias))
    return Model(langs, (marks.T @ (root @ w).astype(np.float32)), (bias - centre @ w).astype(np.float32))


def _bit_sets(batches):
    import pyarrow as pa

    from rarebird.llm.arrowbatch import text_chunks, texts_of

    for chunk in text_chunks(batches):
        for at in range(0, chunk.num_rows, ROWS):
            b = chunk.slice(at, ROWS)
            flags, ok = presence(texts_of(b))
            bits = pa.array([r.tobytes() for r in np.packbits(flags, axis=1)], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column("lang"), b.column("place"), bits, pa.array(ok)],
                                             names=["lang", "place", "bits", "ok"])


def held_out(id_col: str) -> Column:
    """Whether crc32 of the id as text has remainder 1 by 3; a null id counts as empty text."""
    return F.crc32(F.encode(F.coalesce(F.col(id_col).cast("string"), F.lit("")), "UTF-8")) % 3 == 1


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
        train_rows: int = TRAIN_ROWS, landmarks: int = LANDMARKS, ridge: float = RIDGE) -> Model:
    """Learn from rows that are not held out and have a label and a letter. Without such rows
    the model knows no language, and every prediction is ``und``."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).where(
        ~held_out("id") & F.col("lang").isNotNull() & F.col("text").isNotNull())
    sizes = {r.lang: r.n for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row per language
    if not sizes:
        return Model([], np.zeros((1 << BITS, 0), np.float32), np.zeros(0, np.float32))
    share = train_rows / len(sizes)
    draw = (F.xxhash64("id", F.octet_length("text")) / F.lit(2.0**64) + 0.5)
    # place: the row's expected rank in its language, so that the first rows of all mix evenly
    size = F.create_map(*[F.lit(v) for kv in sizes.items() for v in kv])
    placed = rows.withColumn("place", draw * size[F.col("lang")]).where(F.col("place") < share)
    drawn = (placed.select("lang", "place", "text").mapInArrow(_bit_sets, "lang string, place double, bits binary, ok boolean")
             .where("ok").orderBy("place", "lang", "bits").limit(train_rows).collect())
    langs = sorted({r.lang for r in drawn})
    if not langs:
        return Model([], np.zeros((1 << BITS, 0), np.float32), np.zeros(0, np.float32))
    bits = np.frombuffer(b"".join(bytes(r.bits) for r in drawn), np.uint8).reshape(len(drawn), -1)
    labels = np.array([langs.index(r.lang) for r in drawn])
    return solve(bits, labels, langs, landmarks, ridge)


def scores(texts: list[str], model: Model) -> tuple[list[str], np.ndarray]:
    """(language, score from 0 to 1) of each text, by one matrix product."""
    flags, ok = presence(texts)
    ok &= len(model.langs) > 0
    if not ok.any():
        return [UNKNOWN] * len(texts), np.zeros(len(texts))
    x = flags.astype(np.float32)
    out = x @ model.weights / np.sqrt(np.maximum(x.sum(1, keepdims=True), 1)) + model.bias
    best = out.argmax(1)
    score = np.clip((out.max(1).astype(np.float64) + 1) / 2, 0, 1)
    return [model.langs[b] if o else UNKNOWN for b, o in zip(best.tolist(), ok.tolist(), strict=True)], np.where(ok, score, 0.0)


def _predict(model, text_col: str):
    def run(batches):
        import pyarrow as pa

        from rarebird.llm.arrowbatch import text_chunks, texts_of

        for chunk in text_chunks(batches, text_col):
            for at in range(0, chunk.num_rows, ROWS):
                b = chunk.slice(at, ROWS)
                lang, score = scores(texts_of(b, text_col), model.value)
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(lang, pa.string()), pa.array(score, pa.float64())],
                                                 names=[*b.schema.names, "lang_pred", "score"])

    return run


def predict(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score`` (columns of those names are replaced).

    Only the text is looked at. Null texts and texts without a letter are ``und`` with
    score 0; so is every text when the model knows no language. One pass, no shuffle.
    """
    rows = docs.drop("lang_pred", "score")
    sent = docs.sparkSession.sparkContext.broadcast(model)  # features x languages floats
    return rows.mapInArrow(_predict(sent, text_col), rows._jdf.schema().toDDL() + ", lang_pred string, score double")
