"""Filters and counts over an event table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def filter_events(events: DataFrame, start: str, end: str, stations: DataFrame | None = None, key: str = "station") -> DataFrame:
    """Events that lie inside [start, end], optionally of the given stations."""
    inside = events.where(
        (F.col("start_date") >= F.lit(start).cast("date")) & (F.col("end_date") <= F.lit(end).cast("date"))
    )
    return inside if stations is None else inside.join(stations.select(key), key, "left_semi")


def event_kpis(events: DataFrame, key: str) -> DataFrame:
    return events.agg(
        F.count("*").alias("n_events"), F.countDistinct(key).alias("n_stations"), F.avg("days").alias("avg_days")
    )


def events_per_station(events: DataFrame, keys: list[str]) -> DataFrame:
    counts = events.groupBy(*keys).agg(F.count("*").alias("n_events"))
    return counts.withColumn("marker_size", F.col("n_events") * 100)


def events_per_month(events: DataFrame) -> DataFrame:
    return events.groupBy(F.trunc("start_date", "month").alias("month")).agg(F.count("*").alias("n_events"))


def events_per_entity(events: DataFrame, key: str, total: str = "total") -> DataFrame:
    """Counts per entity and one row for all of them."""
    counted = events.rollup(key).agg(F.count("*").alias("n_events"), F.grouping(key).alias("_all"))
    return counted.select(F.when(F.col("_all") == 1, total).otherwise(F.col(key)).alias(key), "n_events")
