"""Time series that are cut into calendar chunks instead of one task per entity.

A series has at most one row per (keys, ts). The chunk is a calendar month or year,
so the number of chunks of an entity is bounded by its time span and the rows of a
chunk by the resolution; no task ever holds a whole entity.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from heatframe.operators.ordered import running_totals

GAP = "a dense series has a missing or repeated step: densify it, or say dense=False"


@dataclass(frozen=True)
class Series:
    """Column roles: entity keys, time column, row distance and chunk length.

    ``dense`` promises a row for every step (see ``densify``); then positions are
    plain calendar arithmetic and need no counting. A window that meets a missing or a
    repeated step of a dense series raises.
    """

    keys: tuple[str, ...]
    ts: str
    step: str = "day"
    dense: bool = False

    def __post_init__(self):
        if self.step not in ("hour", "day"):
            raise ValueError("a step is an hour or a day")

    @property
    def key_list(self) -> list[str]:
        return list(self.keys)

    def chunk(self) -> Column:
        """Calendar year of daily rows, month of hourly rows; never NULL (see order_bits)."""
        ts = F.col(self.ts)
        number = F.year(ts) if self.step == "day" else F.year(ts) * 12 + F.month(ts)
        return F.coalesce(number, F.lit(0))

    def tick(self, ts: Column | None = None) -> Column:
        """Whole steps since 1970 in calendar time, independent of the session zone."""
        ts = F.col(self.ts) if ts is None else ts
        days = F.unix_date(ts.cast("date")).cast("long")
        return days if self.step == "day" else days * 24 + F.hour(ts)


def with_position(df: DataFrame, series: Series, name: str = "pos") -> DataFrame:
    """Adds the row number of each row within its entity (dense: its calendar step)."""
    if series.dense:
        return df.withColumn(name, series.tick())
    marked = df.withColumn("_chunk", series.chunk()).withColumn("_one", F.lit(1).cast("long"))
    placed = running_totals(marked, series.key_list, [series.ts], ["_one"], ["_chunk"])
    return placed.withColumn(name, F.col("_one_before") + 1).drop("_chunk", "_one", "_one_before", "_one_total")


def over_rows(
    df: DataFrame,
    series: Series,
    back: int,
    ahead: int,
    build: Callable[[WindowSpec], dict[str, Column]],
    *then: Callable[[WindowSpec], dict[str, Column]],
    block: int | None = None,
) -> DataFrame:
    """Adds windowed columns whose frames reach at most ``back``/``ahead`` rows.

    Rows are grouped into blocks by position; every block also receives copies of
    the neighbouring rows its frames reach, which are dropped afterwards. ``build``
    gets the ordered window; each further callable may use the columns before it.
    """
    block = block or max(1024, 8 * (back + ahead))
    placed = df if "_pos" in df.columns else with_position(df, series, "_pos")
    pos = F.col("_pos")
    home = F.floor(pos / block)
    needed_in = F.sequence(F.floor((pos - ahead) / block), F.floor((pos + back) / block))
    copies = placed.select("*", home.alias("_home"), F.explode(needed_in).alias("_block"))
    window = Window.partitionBy(*series.keys, "_block").orderBy("_pos")
    if series.dense:
        # neighbours of a block are there as well, so every gap inside the reach of a frame is seen
        gap = F.lag("_pos").over(window) != F.col("_pos") - 1
        copies = copies.withColumn("_pos", F.when(gap, F.raise_error(F.lit(GAP)).cast("long")).otherwise(F.col("_pos")))
    for step in (build, *then):
        copies = copies.withColumns(step(window))
    return copies.where(F.col("_home") == F.col("_block")).drop("_home", "_block", "_pos")


def gated(aggregate: Callable[[Column], Column], c: Column, frame: WindowSpec, min_periods: int) -> Column:
    """Windowed aggregate that is NULL until ``min_periods`` values are present."""
    return F.when(F.count(c).over(frame) >= min_periods, aggregate(c).over(frame))


def rolling(
    df: DataFrame,
    series: Series,
    value: str,
    window: int,
    min_periods: int | None = None,
    how: str = "avg",
    name: str | None = None,
) -> DataFrame:
    """Trailing aggregate (avg, min, max, sum) over ``window`` rows."""
    aggregate = {"avg": F.avg, "min": F.min, "max": F.max, "sum": F.sum}[how]
    need = window if min_periods is None else min_periods
    out = name or f"{value}_{how}_{window}"
    return over_rows(
        df, series, window - 1, 0,
        lambda w: {out: gated(aggregate, F.col(value), w.rowsBetween(1 - window, 0), need)},
    )


def lags(df: DataFrame, series: Series, wanted: dict[str, tuple[str, int]]) -> DataFrame:
    """``{new: (column, k)}``: value ``k`` rows earlier (negative ``k``: later)."""
    reach = [k for _, k in wanted.values()]
    return over_rows(
        df, series, max(0, *reach), max(0, *[-k for k in reach]),
        lambda w: {new: F.lag(c, k).over(w) if k >= 0 else F.lead(c, -k).over(w) for new, (c, k) in wanted.items()},
    )


def changes(df: DataFrame, series: Series, wanted: dict[str, tuple[str, int]]) -> DataFrame:
    """``{new: (column, k)}``: x[t] - x[t-k]; for negative ``k`` x[t+|k|] - x[t]."""
    reach = [k for _, k in wanted.values()]

    def build(w: WindowSpec) -> dict[str, Column]:
        return {
            new: F.col(c) - F.lag(c, k).over(w) if k >= 0 else F.lead(c, -k).over(w) - F.col(c)
            for new, (c, k) in wanted.items()
        }

    return over_rows(df, series, max(0, *reach), max(0, *[-k for k in reach]), build)


def calendar(df: DataFrame, series: Series, start: str | None = None, end: str | None = None) -> DataFrame:
    """(keys, ts) for every step between the first and last row of each entity.

    With ``start``/``end`` all entities share that inclusive span.
    """
    ts_type = "date" if series.step == "day" else "timestamp_ntz"
    first = F.lit(start) if start else F.min(series.ts)
    last = F.lit(end) if end else F.max(series.ts)
    spans = df.groupBy(*series.keys).agg(first.cast(ts_type).alias("_first"), last.cast(ts_type).alias("_last"))
    # Two explodes keep every array short: the months of an entity, then the steps of a month.
    first_month, last_month = F.trunc(F.col("_first").cast("date"), "month"), F.col("_last").cast("date")
    months = spans.withColumn("_month", F.explode(F.sequence(first_month, last_month, F.expr("INTERVAL 1 MONTH"))))
    month_end = F.last_day("_month").cast(ts_type)
    if series.step == "hour":
        month_end = month_end + F.expr("INTERVAL 23 HOURS")
    low = F.greatest(F.col("_first"), F.col("_month").cast(ts_type))
    high = F.least(F.col("_last"), month_end)
    every = F.expr(f"INTERVAL 1 {series.step.upper()}")
    return months.select(*series.keys, F.explode(F.sequence(low, high, every)).alias(series.ts))


def densify(df: DataFrame, series: Series, start: str | None = None, end: str | None = None) -> DataFrame:
    """A row for every step; absent steps carry NULL values."""
    return calendar(df, series, start, end).join(df, [*series.keys, series.ts], "left")


def resample_daily_max(df: DataFrame, series: Series, value: str, out: str = "daily_max") -> DataFrame:
    """(keys, obs_date, daily maximum) on a complete calendar; empty days are NULL."""
    day = F.col(series.ts).cast("date").alias("obs_date")
    daily = df.groupBy(*series.keys, day).agg(F.max(value).alias(out))
    return densify(daily, Series(series.keys, "obs_date", "day"))


def daily_to_hourly(df: DataFrame, series: Series, value: str, out: str = "daily_max") -> DataFrame:
    """Puts each day's maximum on all rows of that day (a group is one entity-day)."""
    day = Window.partitionBy(*series.keys, F.col(series.ts).cast("date"))
    return df.withColumn(out, F.max(value).over(day))
