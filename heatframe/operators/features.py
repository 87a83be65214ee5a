"""Climatology and anomaly scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def climatology(
    df: DataFrame, keys: list[str], columns: list[str], periods: dict[str, Column], reference: Column
) -> DataFrame:
    """(keys, periods, {c}_mean, {c}_std) over the reference rows only."""
    parts = [p.alias(name) for name, p in periods.items()]
    aggs = []
    for c in columns:
        aggs += [F.avg(c).alias(f"{c}_mean"), F.stddev_samp(c).alias(f"{c}_std")]
    return df.where(reference).groupBy(*keys, *parts).agg(*aggs)


def apply_climatology(
    df: DataFrame, keys: list[str], columns: list[str], periods: dict[str, Column], normal: DataFrame, eps: float = 1e-8
) -> DataFrame:
    """Adds ``{c}_zscore``; rows of a period without reference data get NULL.

    The join is on the period itself, not on a position, and its build side is chosen
    by size at run time.
    """
    joined = df.withColumns(periods).join(normal, [*keys, *periods], "left")
    scores = {f"{c}_zscore": (F.col(c) - F.col(f"{c}_mean")) / (F.col(f"{c}_std") + eps) for c in columns}
    return joined.withColumns(scores).select(*df.columns, *scores)


def zscore_within(df: DataFrame, keys: list[str], columns: list[str], periods: dict[str, Column]) -> DataFrame:
    """Replaces columns by their anomaly within (keys, periods) over the whole span; a
    spread of 0 counts as 1."""
    normal = climatology(df, keys, columns, periods, F.lit(True))
    joined = df.withColumns(periods).join(normal, [*keys, *periods], "left")

    def score(c: str) -> Column:
        std = F.when(F.col(f"{c}_std") == 0, 1.0).otherwise(F.col(f"{c}_std"))
        return ((F.col(c) - F.col(f"{c}_mean")) / std).alias(c)

    return joined.select(*[score(c) if c in columns else F.col(c) for c in df.columns])
