"""Small helpers shared by the query modules."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DIGITS = 6
NUDGE = 1.3e-8  # moves exact halves off the rounding edge, where engines differ in the last bit


def r(expr: str, digits: int = DIGITS) -> str:
    """SQL: a double rounded for comparison."""
    return f"round(CAST({expr} AS DOUBLE) + {NUDGE}, {digits})"


def rd(c: Column | str, digits: int = DIGITS) -> Column:
    """Spark twin of ``r``."""
    return F.round((F.col(c) if isinstance(c, str) else c).cast("double") + NUDGE, digits)


def round_doubles(df, *columns: str):
    return df.withColumns({c: rd(c).alias(c) for c in columns})
