"""Sharding by jump consistent hashing, in DataFrame expressions only.

A stable key decides the shard; there is no ring table, and appending a shard moves only
the rows that the new shard takes (Lamping and Veach, 2014). The 64-bit generator
``state * 2862933555777941757 + 1`` must wrap, which Spark's checked integers do not do,
so the state is kept as two 32-bit halves in longs and multiplied by 16-bit parts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rarebird.operators.ranking import ranked

MULTIPLIER = 2862933555777941757  # fixed value of the published generator
LOW32, LOW16 = (1 << 32) - 1, (1 << 16) - 1
#: Steps of the first loop; more than this many jumps are rare, and a second loop ends those.
FIRST_STEPS = 64


def _parts(l: Column, c: int) -> tuple[Column, Column]:
    """l * c (both below 2^32): its low 32 bits and the rest."""
    upper = F.shiftrightunsigned(l, 16) * F.lit(c)
    lower = l.bitwiseAND(F.lit(LOW16)) * F.lit(c) + F.shiftleft(upper.bitwiseAND(F.lit(LOW16)), 16)
    return lower.bitwiseAND(F.lit(LOW32)), F.shiftrightunsigned(upper, 16) + F.shiftrightunsigned(lower, 32)


def _next_state(h: Column, l: Column) -> tuple[Column, Column]:
    c_high, c_low = MULTIPLIER >> 32, MULTIPLIER & LOW32
    low, carry = _parts(l, c_low)
    low = low + F.lit(1)
    high = carry + _parts(h, c_low)[0] + (l * F.lit(c_high)).bitwiseAND(F.lit(LOW32)) + F.shiftrightunsigned(low, 32)
    return high.bitwiseAND(F.lit(LOW32)), low.bitwiseAND(F.lit(LOW32))


def jump_hash(high: Column, low: Column, shards: int) -> Column:
    """The shard (0 to shards - 1) of a 64-bit key given as two unsigned 32-bit halves."""
    if shards < 1:
        raise ValueError("shards must be at least 1")
    def step(s: Column, _i: Column) -> Column:
        h, l = _next_state(s["h"], s["l"])
        # (b + 1) * (2^31 / ((key >> 33) + 1)) in doubles, as published
        jump = ((s["j"] + F.lit(1)).cast("double")
                * (F.lit(float(1 << 31)) / (F.shiftrightunsigned(h, 1) + F.lit(1)).cast("double"))).cast("long")
        moved = F.struct(h.alias("h"), l.alias("l"), s["j"].alias("b"), jump.alias("j"))
        return F.when(s["j"] < shards, moved).otherwise(s)

    start = F.struct(high.alias("h"), low.alias("l"), F.lit(-1).cast("long").alias("b"), F.lit(0).cast("long").alias("j"))
    state = F.aggregate(F.sequence(F.lit(1), F.lit(min(shards, FIRST_STEPS))), start, step)
    if shards <= FIRST_STEPS:
        return state["b"].cast("int")
    # j grows by at least one a step, so `shards` steps end every key; few rows need them
    rest = F.aggregate(F.sequence(F.lit(1), F.lit(shards)), state, step)
    return F.when(state["j"] >= shards, state["b"]).otherwise(rest["b"]).cast("int")


def key_halves(key: Column) -> tuple[Column, Column]:
    """A stable 64-bit hash of any key, as two halves: the first 16 hex digits of its md5.
    A null key is hashed as the text ``null`` after a zero byte, so it has a shard too."""
    digest = F.md5(F.coalesce(key.cast("string"), F.lit("\0null")))
    return tuple(F.conv(F.substring(digest, at, 8), 16, 10).cast("long") for at in (1, 9))


def assign_shards(df: DataFrame, key: str, shards: int, shard_col: str = "shard") -> DataFrame:
    """``df`` with ``shard_col``; a column of that name is replaced. No shuffle. Equal keys
    share a shard; null keys have one too; an empty table stays empty."""
    high, low = key_halves(F.col(key))
    return df.withColumn(shard_col, jump_hash(high, low, shards))


def shard_plan(df: DataFrame, shards: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, size, text_crc32, law, shard, slot, grown_shard), one row for each row of ``df``.

    ``size`` is the text's UTF-8 bytes plus 1 (null: 1), ``text_crc32`` null for a null
    text, ``slot`` the row's place in its shard in order of (id, size, crc), gapless from
    0, ``grown_shard`` the shard when one is appended. Law ``key``: id and shard count
    decide. Only these narrow columns are shuffled: places come from a range partition
    and running offsets, so no shard is sorted in one task. Repeated rows have a slot
    each; null ids come first; other columns are not read.
    """
    raw = F.encode(F.col(text_col), "UTF-8")
    rows = df.select(F.col(id_col).alias("id"), (F.coalesce(F.octet_length(text_col), F.lit(0)) + 1).cast("long").alias("size"),
                     F.crc32(raw).alias("text_crc32"))
    rows = assign_shards(assign_shards(rows, "id", shards, "shard"), "id", shards + 1, "grown_shard")
    placed = ranked(rows, ["id", "size", "text_crc32"], group=["shard"], rank_col="slot",
                    partitions=int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return placed.select(F.col("id").alias(id_col), "size", "text_crc32", F.lit("key").alias("law"), "shard",
                         (F.col("slot") - 1).cast("long").alias("slot"), "grown_shard")


def write_shards(df: DataFrame, path: str, key: str, shards: int) -> None:
    """Write every row (all columns) under ``path/shard=<n>``. Rows stay in their tasks, so
    a hot shard is written by many tasks; there is no shuffle."""
    assign_shards(df, key, shards).write.partitionBy("shard").parquet(path)
