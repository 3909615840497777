"""Column expressions shared by the operators (all JVM-side built-ins)."""

from rarebird.functions.exprs import (  # noqa: F401
    hash_int,
    hash_uniform,
    r6,
    required,
    safe_div,
)
