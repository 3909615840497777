"""Deterministic randomness and null-safe arithmetic as Spark Column expressions.

Randomness is driven by md5 of ``seed-key`` so that a rerun, a retried task and
the DuckDB oracle all draw the same numbers:
``u = int(first 8 hex digits of md5('<seed>-<key>')) / 2**32``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def hash_int(seed, key, salt: str = "") -> Column:
    """First 32 bits of md5('<seed>-<salt><key>') as a bigint in [0, 2**32)."""
    text = F.concat(F.lit(f"{seed}-{salt}"), _col(key).cast("string"))
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint")


def hash_uniform(seed, key, salt: str = "") -> Column:
    """Uniform double in [0, 1) from :func:`hash_int`."""
    return hash_int(seed, key, salt) / F.lit(4294967296.0)


def required(c, what: str) -> Column:
    """``c``, raising at run time where it is null: rows with a null key never vanish."""
    return F.coalesce(_col(c), F.raise_error(F.lit(f"null in {what}: impute or filter it first")))


def safe_div(num, den, zero=0.0) -> Column:
    """``num / den`` with ``zero`` where the denominator is 0 (ANSI-safe)."""
    n, d = _col(num), _col(den)
    return F.when(d == 0, F.lit(zero)).otherwise(n.cast("double") / d)


def r6(c) -> Column:
    """Round to 6 digits: the precision at which results are compared."""
    return F.round(_col(c).cast("double"), 6)
