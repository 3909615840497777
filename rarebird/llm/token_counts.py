"""Token counts: count pieces once per distinct pre-token, join to per-document frequencies.

1. Pre-tokens of all texts -> (word, occurrences), combined in each task, then by word.
   The tokenizers library counts the pieces of each distinct word once.
2. The words that occur most (``hot``, a bounded number of short words) go to the tasks
   as a broadcast; a document's sum over them needs no shuffle. That takes the hot join
   keys out. All other words become (document, word, frequency) rows and are joined to
   the table of step 1 on the word itself, so no hash collision can change a count.
3. One partial sum per document. No ids are materialised.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rarebird.llm import vocab
from rarebird.llm.tables import materialize

#: Words kept in the broadcast, and the most UTF-8 bytes each may have (at most 3.2 MB in all).
HOT_WORDS, HOT_BYTES = 50_000, 64
#: Distinct words a task holds before it passes their counts on.
HELD_WORDS = 200_000


def _word_counts(path: str, pattern: str):
    def run(batches):
        import numpy as np
        import pyarrow as pa

        from rarebird.llm import pretokens
        from rarebird.llm.arrowbatch import text_chunks, texts_of

        held: dict[str, int] = {}

        def flush():
            yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())],
                                             names=["word", "n"])
            held.clear()

        for chunk in text_chunks(batches):
            words, _ = pretokens.cut(texts_of(chunk), pattern, vocab.specials(path))
            distinct, ids = pretokens.numbered(words)
            for w, c in zip(distinct, np.bincount(ids, minlength=len(distinct)).tolist(), strict=True):
                held[w] = held.get(w, 0) + c
            if len(held) > HELD_WORDS:
                yield from flush()
        if held:
            yield from flush()

    return run


def _pieces(path: str):
    def run(batches):
        import pyarrow as pa

        tok = vocab.library(path)
        for b in batches:
            words = b.column("word").to_pylist()
            pieces = [len(e.ids) for e in tok.encode_batch_fast(words, add_special_tokens=False)]
            yield pa.RecordBatch.from_arrays([b.column("word"), b.column("n"), pa.array(pieces, pa.int32())],
                                             names=["word", "n", "pieces"])

    return run


def piece_table(docs: DataFrame, path: str, text_col: str = "text", pattern: str = "byte") -> DataFrame:
    """(word, n, pieces): every distinct pre-token, its occurrences and its number of tokens.
    Null texts count as empty; an empty table gives an empty table."""
    words = docs.select(F.col(text_col).alias("text")).mapInArrow(_word_counts(path, pattern), "word string, n long")
    return words.groupBy("word").agg(F.sum("n").alias("n")).mapInArrow(_pieces(path), "word string, n long, pieces int")


def _frequencies(path: str, pattern: str, hot):
    def run(batches):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        from rarebird.llm import pretokens
        from rarebird.llm.arrowbatch import text_chunks, texts_of

        known = hot.value
        names = ["row", "id", "n_bytes", "word", "n"]
        for chunk in text_chunks(batches):
            texts = texts_of(chunk)
            words, counts = pretokens.cut(texts, pattern, vocab.specials(path))
            distinct, ids = pretokens.numbered(words)
            doc = np.repeat(np.arange(len(texts)), counts)
            pieces = np.fromiter((known.get(w, 0) for w in distinct), np.int64, len(distinct))
            each = pieces[ids] if len(ids) else np.zeros(0, np.int64)
            row = np.asarray(chunk.column("row"), np.int64)
            size = pc.fill_null(pc.binary_length(chunk.column("text")), 0).cast(pa.int64())
            # one head row for each document; its key is no pre-token (these hold no digit after another class)
            yield pa.RecordBatch.from_arrays(
                [pa.array(row), chunk.column("id"), size, pa.array([f"\0{r}" for r in row.tolist()], pa.string()),
                 pa.array(np.bincount(doc, each, len(texts)).astype(np.int64))], names=names)
            cold = each == 0
            if cold.any():
                pairs, n = np.unique(doc[cold] * len(distinct) + ids[cold], return_counts=True)
                d, w = np.divmod(pairs, len(distinct))
                used, w = np.unique(w, return_inverse=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(row[d]), pa.nulls(len(d), chunk.column("id").type), pa.nulls(len(d), pa.int64()),
                     pa.DictionaryArray.from_arrays(pa.array(w.astype(np.int32)),
                                                    pa.array([distinct[i] for i in used.tolist()], pa.string())).dictionary_decode(),
                     pa.array(n.astype(np.int64))], names=names)

    return run


def _hot(table: DataFrame, most: int) -> list:
    """The most frequent words, at most ``most``: a histogram of counts (a row for each sixteenth of a doubling)
    says from which count on there are that many, so only these come to the driver."""
    level = F.floor(F.log2("n") * 16)
    from_level, left = None, most
    for r in sorted(table.groupBy(level.alias("level")).agg(F.count(F.lit(1)).alias("n")).collect(), key=lambda r: -r.level):
        if r.n > left:
            break
        from_level, left = r.level, left - r.n
    return [] if from_level is None else table.where(level >= from_level).select("word", "pieces").collect()


def token_counts(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 1024,
                 pattern: str = "byte", hot_words: int = HOT_WORDS) -> DataFrame:
    """Per row of ``docs``: its id, ``n_bytes`` (UTF-8), ``n_tokens``, ``over_limit`` (n_tokens > limit).

    Counts equal the library's encode(text, add_special_tokens=False). Null and empty
    texts have 0 bytes and 0 tokens. Null or repeated ids keep a row each: rows are told
    apart by position, not by id. Other columns, whatever their names, are not read.
    """
    spark = docs.sparkSession
    table = materialize(piece_table(docs, path, text_col, pattern), "pieces")
    top = _hot(table.where(F.octet_length("word") <= HOT_BYTES), hot_words)
    hot = spark.sparkContext.broadcast({r.word: r.pieces for r in top})
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"),
                       F.col(text_col).alias("text"))
    freq = rows.mapInArrow(_frequencies(path, pattern, hot), f"row long, id {kind}, n_bytes long, word string, n long")
    cost = F.col("n") * F.coalesce("pieces", F.lit(1))
    return (freq.join(table.select("word", "pieces"), "word", "left")
            .groupBy("row").agg(F.max("id").alias(id_col), F.max("n_bytes").alias("n_bytes"), F.sum(cost).alias("n_tokens"))
            .select(id_col, "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit")))
