"""Precursor analysis: what the hours before an event look like."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from heatframe.functions.statistics import safe_corr
from heatframe.operators.climate import poly_trend
from heatframe.operators.events import detect_events, event_windows
from heatframe.operators.ordered import quantiles
from heatframe.operators.series import Series, resample_daily_max
from heatframe.operators.windows import complete_pairs


def hourly_events(hourly: DataFrame, series: Series, value: str, pct: float = 0.95, min_days: int = 3) -> DataFrame:
    """(keys, start_date, end_date, days, threshold): runs of consecutive days whose
    maximum is strictly above the entity's quantile of all daily maxima."""
    daily = resample_daily_max(hourly, series, value)
    limits = quantiles(daily, series.key_list, "daily_max", {"threshold": pct})
    by_day = Series(series.keys, "obs_date", "day")
    found = detect_events(
        daily.join(limits, series.key_list), by_day, "daily_max", "threshold", min_days, "calendar", strict=True
    )
    return found.join(limits, series.key_list)


def pre_event_profile(
    events: DataFrame,
    hourly: DataFrame,
    series: Series,
    base: str,
    others: list[str],
    hours: int = 72,
    window: int = 24,
    min_periods: int = 12,
    season: Column | None = None,
) -> DataFrame:
    """(keys, variable, offset, n_events, median_corr): rolling correlation of ``base``
    with each variable before events, restarted at every event, median over events.

    Every offset of every variable is there for each entity with an event; without a
    value it has no median and 0 events. A window of one event holds at most ``hours``
    rows. Events with fewer than ``min_periods`` rows are left out.
    """
    rows = hourly if season is None else hourly.where(season)
    windows = event_windows(events, rows.select(*series.keys, series.ts, base, *others), series, hours)
    event = Window.partitionBy(*series.keys, "start_date")
    frame = event.orderBy(series.ts).rowsBetween(1 - window, 0)
    rolled = windows.withColumn("_rows", F.count("*").over(event)).select(
        *series.keys, "start_date", "offset", "_rows",
        *[
            F.when(
                F.count(complete_pairs(F.col(base), F.col(o))).over(frame) >= min_periods,
                safe_corr(F.col(base), F.col(o), frame),
            ).alias(o)
            for o in others
        ],
    )
    kept = rolled.where(F.col("_rows") >= min_periods)
    tall = kept.unpivot([*series.keys, "offset"], others, "variable", "corr").where("corr IS NOT NULL")
    by = [*series.keys, "variable", "offset"]
    counts = tall.groupBy(*by).agg(F.count("*").alias("n_events"))
    found = counts.join(quantiles(tall, by, "corr", {"median_corr": 0.5}), by)
    every = events.select(*series.keys).distinct().select(
        *series.keys, F.explode(F.array(*[F.lit(o) for o in others])).alias("variable")
    ).withColumn("offset", F.explode(F.sequence(F.lit(-hours), F.lit(-1))))
    return every.join(found, by, "left").withColumn("n_events", F.coalesce("n_events", F.lit(0).cast("long")))


def smooth_profile(profile: DataFrame, keys: list[str], degree: int = 3) -> DataFrame:
    """Adds the polynomial fit of the profile over hours before onset."""
    hours = profile.withColumn("hours_before", F.abs("offset"))
    return poly_trend(hours, [*keys, "variable"], "hours_before", "median_corr", degree)
