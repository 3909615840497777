"""The n smallest rows by a 64-bit key without sorting them: radix selection by counted digits.

A pass counts the rows of each 16-bit digit (65,536 counts at most, a fixed bound) among those that
share the digits found so far, so the n-th smallest key is known after at most four passes of
partial aggregation; the same on the ids breaks its ties. What is kept is then one filter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DIGIT = 16
SIGN = -(1 << 63)


def nth_smallest(keys: DataFrame, n: int, bits: int) -> tuple[int, int]:
    """(the n-th smallest value of ``key``, how many rows of that value are among the n smallest).
    ``bits``: 64 for any bigint, fewer where keys are known to lie in [0, 2^bits)."""
    ordered = F.col("key").bitwiseXOR(F.lit(SIGN)) if bits == 64 else F.col("key")
    found = 0
    for shift in range(-(-bits // DIGIT) * DIGIT - DIGIT, -1, -DIGIT):
        top = F.lit(True) if shift + DIGIT >= bits else F.call_function("shiftrightunsigned", ordered, F.lit(shift + DIGIT)) == found
        digit = F.call_function("shiftrightunsigned", ordered, F.lit(shift)).bitwiseAND((1 << DIGIT) - 1).cast("int")
        counts = keys.where(top).groupBy(digit.alias("digit")).agg(F.count(F.lit(1)).alias("n")).collect()
        for r in sorted(counts, key=lambda r: r.digit):
            if r.n >= n:
                found = found << DIGIT | r.digit
                break
            n -= r.n
        else:
            raise ValueError("fewer rows than asked for")
    if bits == 64:  # back to a signed number
        found ^= 1 << 63
        found -= (found >> 63) << 64
    return found, n


def among_smallest(keys: DataFrame, n: int, bits: int = 64):
    """For a table (id bigint, key bigint) the condition (key, id) -> Column that holds for exactly the ``n``
    rows that come first by (key, id). It is read up to eight times: materialise it where it is dear."""
    if n <= 0:
        return lambda key, id_: F.lit(False)
    value, left = nth_smallest(keys, n, bits)
    tied = keys.where(F.col("key") == value).select(F.col("id").alias("key"))
    last, _ = nth_smallest(tied, left, 64)

    def condition(key: Column, id_: Column) -> Column:
        return (key < value) | ((key == value) & (id_ <= last))

    return condition
