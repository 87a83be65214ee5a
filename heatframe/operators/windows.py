"""Named window features built on ``over_rows``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from heatframe.functions.statistics import safe_corr
from heatframe.operators.series import Series, over_rows


def rolling_year_mean(annual: DataFrame, keys: list[str], year: str, value: str, window: int = 5) -> DataFrame:
    """Mean of the last ``window`` yearly rows, shorter at the start.

    The input has one row per entity and year, so an entity is a few hundred rows.
    """
    w = Window.partitionBy(*keys).orderBy(year).rowsBetween(1 - window, 0)
    return annual.withColumn(f"{value}_{window}y", F.avg(value).over(w))


def complete_pairs(a: Column, b: Column) -> Column:
    return F.when(a.isNotNull() & b.isNotNull(), F.lit(1))


def rolling_corr(
    df: DataFrame, series: Series, base: str, others: list[str], window: int = 24, min_periods: int = 12
) -> DataFrame:
    """Adds ``corr_{other}``: trailing correlation with ``base``, NULL below
    ``min_periods`` complete pairs or where a side is constant."""

    def build(w):
        frame = w.rowsBetween(1 - window, 0)
        return {
            f"corr_{o}": F.when(
                F.count(complete_pairs(F.col(base), F.col(o))).over(frame) >= min_periods,
                safe_corr(F.col(base), F.col(o), frame),
            )
            for o in others
        }

    return over_rows(df, series, window - 1, 0, build)
