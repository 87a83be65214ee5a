"""Column expressions: missing data, dates, angles, guarded arithmetic."""

from __future__ import annotations

from math import pi

from pyspark.sql import Column
from pyspark.sql import functions as F

KELVIN_OFFSET = 273.15


def null_nan(c: Column) -> Column:
    """Missing is NULL everywhere; a real NaN would compare greater than any number."""
    return F.when(F.isnan(c), None).otherwise(c)


def hot(value: Column, threshold: Column | float, strict: bool = False) -> Column:
    """``value >= threshold`` (or ``>``) where a missing operand is not hot."""
    test = value > threshold if strict else value >= threshold
    return F.coalesce(test, F.lit(False))


def below(value: Column, threshold: float) -> Column:
    """0/1 flag, missing is 0."""
    return F.coalesce(value < threshold, F.lit(False)).cast("int")


def is_month(ts: Column, months: list[int]) -> Column:
    return F.month(ts).isin(months)


def within(ts: Column, start: str, end: str) -> Column:
    """Inclusive calendar dates, written as a half-open range so it reaches the scan."""
    return (ts >= F.lit(start).cast("timestamp_ntz")) & (
        ts < F.date_add(F.lit(end).cast("date"), 1).cast("timestamp_ntz")
    )


def decade(ts: Column) -> Column:
    return (F.floor(F.year(ts) / 10) * 10).cast("int")


def month_start(ts: Column) -> Column:
    return F.trunc(ts.cast("date"), "month")


def stamp(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd HH:mm:ss")


def cyclic(position: Column, period: float) -> tuple[Column, Column]:
    """(sin, cos) of one turn per ``period``."""
    angle = position * (2 * pi) / period
    return F.sin(angle), F.cos(angle)


def direction(degrees: Column) -> tuple[Column, Column]:
    """(sin, cos) of a compass direction."""
    return F.sin(F.radians(degrees)), F.cos(F.radians(degrees))


def celsius(kelvin: Column) -> Column:
    return kelvin - KELVIN_OFFSET


def ratio(num: Column, den: Column) -> Column:
    """Division that gives NULL instead of raising on zero."""
    return F.try_divide(num.cast("double"), den.cast("double"))


def ratio_or_zero(num: Column, den: Column) -> Column:
    return F.coalesce(ratio(num, den), F.lit(0.0))


def one_hot(c: Column, values: list[str], prefix: str) -> list[Column]:
    return [(c == v).cast("int").alias(f"{prefix}_{v}") for v in values]


def entity_from_name(name: Column) -> Column:
    """Lower-cased part of a file name before the first underscore."""
    return F.lower(F.split_part(name, F.lit("_"), F.lit(1)))


def hash_bucket(key: Column, buckets: int = 100) -> Column:
    """Repeatable bucket of a row key, the same in any engine with md5."""
    head = F.conv(F.substring(F.md5(key.cast("string")), 1, 8), 16, 10).cast("long")
    return head % buckets
