"""Station and variable screening: coverage, missing shares, rankings, statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from heatframe.functions.scalar import is_month


def present_share(c: str) -> Column:
    return F.avg(F.col(c).isNotNull().cast("int"))


def station_summary(df: DataFrame, keys: list[str], ts: str, value: str) -> DataFrame:
    """Rows with a value, first and last time per station."""
    return df.groupBy(*keys).agg(
        F.count(value).alias("n_values"), F.min(ts).alias("start_date"), F.max(ts).alias("end_date")
    )


def top_stations(
    df: DataFrame, group: str, station: str, ts: str, value: str, min_values: int, min_end_year: int, n: int = 5
) -> DataFrame:
    """The ``n`` best covered stations of each group that are long and recent enough.

    Only the n best rows of each partition reach the ranking shuffle.
    """
    summary = station_summary(df, [group, station], ts, value)
    kept = summary.where((F.col("n_values") >= min_values) & (F.year("end_date") >= min_end_year))
    best = Window.partitionBy(group).orderBy(F.col("n_values").desc(), station)
    return kept.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= n)


def keep_stations(df: DataFrame, selected: DataFrame, station: str) -> DataFrame:
    return df.join(selected.select(station), station, "left_semi")


def station_quality(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys, missing_share)."""
    return df.groupBy(*keys).agg((1 - present_share(value)).alias("missing_share"))


def best_station(df: DataFrame, group: str, station: str, value: str) -> DataFrame:
    """Station with the smallest missing share of each group (ties: smallest id)."""
    quality = station_quality(df, [group, station], value)
    best = F.min(F.struct("missing_share", station)).alias("best")
    return quality.groupBy(group).agg(best).select(group, f"best.{station}", "best.missing_share")


def variable_coverage(df: DataFrame, keys: list[str], variables: list[str]) -> DataFrame:
    """(keys, variable, n_non_null, coverage_pct): one wide aggregate, turned at the end."""
    wide = df.groupBy(*keys).agg(F.count("*").alias("_rows"), *[F.count(v).alias(v) for v in variables])
    tall = wide.unpivot([*keys, "_rows"], variables, "variable", "n_non_null")
    return tall.select(
        *keys, "variable", "n_non_null", F.round(F.col("n_non_null") * 100.0 / F.col("_rows"), 1).alias("coverage_pct")
    )


def coverage_ready(coverage: DataFrame, minimum: float = 80.0) -> DataFrame:
    return coverage.where(F.col("coverage_pct") >= minimum)


def coverage_wide(coverage: DataFrame, key: str, values: list[str]) -> DataFrame:
    return coverage.groupBy("variable").pivot(key, values).agg(F.max("coverage_pct"))


def coverage_min_rank(coverage: DataFrame) -> DataFrame:
    """(variable, min_coverage_pct, rank): the worst entity decides, best variable first.

    One row per variable is ranked.
    """
    worst = coverage.groupBy("variable").agg(F.min("coverage_pct").alias("min_coverage_pct"))
    order = Window.orderBy(F.col("min_coverage_pct").desc(), "variable")
    return worst.withColumn("rank", F.row_number().over(order))


def availability(df: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Percentage of present values of every column per key, 2 digits."""
    return df.groupBy(*keys).agg(*[F.round(present_share(c) * 100, 2).alias(c) for c in columns])


def availability_by_year(df: DataFrame, keys: list[str], ts: str, value: str) -> DataFrame:
    """(keys, year, availability_pct); years without rows between the first and the last
    year of an entity appear with NULL."""
    yearly = df.groupBy(*keys, F.year(ts).alias("year")).agg((present_share(value) * 100).alias("availability_pct"))
    span = yearly.groupBy(*keys).agg(F.explode(F.sequence(F.min("year"), F.max("year"))).alias("year"))
    return span.join(yearly, [*keys, "year"], "left")


def missing_years(
    df: DataFrame, keys: list[str], ts: str, value: str, months: list[int], threshold: float = 10.0
) -> DataFrame:
    """Seasonal availability per year and the years that miss more than ``threshold`` %."""
    season = df.where(is_month(F.col(ts), months))
    out = season.groupBy(*keys, F.year(ts).alias("year")).agg(
        F.count(value).alias("n_available"),
        F.count("*").alias("n_days"),
        ((1 - present_share(value)) * 100).alias("missing_pct"),
    )
    return out.withColumn("affected", F.col("missing_pct") > threshold)


def entity_stats(df: DataFrame, keys: list[str], variables: list[str]) -> DataFrame:
    """Mean, standard deviation and maximum of each variable, one row per entity."""
    aggs = []
    for v in variables:
        aggs += [F.avg(v).alias(f"{v}_mean"), F.stddev_samp(v).alias(f"{v}_std"), F.max(v).alias(f"{v}_max")]
    return df.groupBy(*keys).agg(*aggs)


def complete_cases(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    return df.dropna("any", subset=columns)


def dropped_count(df: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """(keys, n_rows, n_complete, n_dropped)."""
    full = F.lit(True)
    for c in columns:
        full = full & F.col(c).isNotNull()
    out = df.groupBy(*keys).agg(F.count("*").alias("n_rows"), F.sum(full.cast("long")).alias("n_complete"))
    return out.withColumn("n_dropped", F.col("n_rows") - F.col("n_complete"))


def dedup_keys(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row per key, the first by ``order``.

    A min over a struct combines map-side, so a key with many copies is reduced before
    the shuffle. Columns of ``order`` come first in the comparison, the rest follow, so
    the choice does not depend on row order.
    """
    rest = [c for c in df.columns if c not in keys]
    ranked = F.struct(*[o.alias(f"_o{i}") for i, o in enumerate(order)], *rest)
    picked = df.groupBy(*keys).agg(F.min(ranked).alias("_row"))
    return picked.select(*keys, *[f"_row.{c}" for c in rest])
