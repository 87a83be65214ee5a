"""Gridded chunks in long form: nearest cells, levels to columns, missing partitions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def nearest_cells(grid: DataFrame, sites: list[tuple[str, float, float]], lat: str = "lat", lon: str = "lon") -> DataFrame:
    """(name, lat, lon) of the grid cell nearest to each site.

    Latitude and longitude are chosen independently, ties to the smaller coordinate.
    The sites are a short argument list, so all of them are found in one aggregate over
    the grid and nothing is joined.
    """
    def nearest(axis: str, at: float):
        return F.min(F.struct(F.abs(F.col(axis) - at).alias("away"), F.col(axis).alias("at")))["at"]

    found = grid.agg(
        *[
            F.struct(F.lit(name).alias("name"), nearest(lat, la).alias(lat), nearest(lon, lo).alias(lon)).alias(f"s{n}")
            for n, (name, la, lo) in enumerate(sites)
        ]
    )
    return found.select(F.inline(F.array(*[f"s{n}" for n in range(len(sites))])))


def grid_to_points(grid: DataFrame, sites: list[tuple[str, float, float]], lat: str = "lat", lon: str = "lon") -> DataFrame:
    """Rows of the nearest cell of every site, tagged with its name.

    One row per listed site is joined, so that side is as small as the argument.
    """
    cells = nearest_cells(grid, sites, lat, lon)
    return grid.join(F.broadcast(cells), [lat, lon]).drop(lat, lon)


def levels_to_columns(df: DataFrame, by: list[str], level: str, values: list[str], levels: list[int]) -> DataFrame:
    """(by, {var}_{level}hPa ...): one conditional aggregate per variable and level."""
    return df.groupBy(*by).agg(
        *[
            F.max(F.when(F.col(level) == lv, F.col(v))).alias(f"{v}_{lv}hPa")
            for v in values
            for lv in levels
        ]
    )


def missing_partitions(wanted: DataFrame, present: DataFrame, keys: list[str]) -> DataFrame:
    """Wanted (entity, month) pairs that have no data yet."""
    return wanted.select(*keys).join(present.select(*keys), keys, "left_anti")


def bounding_box(df: DataFrame, lat: str = "lat", lon: str = "lon") -> DataFrame:
    return df.agg(
        F.max(lat).alias("north"), F.min(lon).alias("west"), F.min(lat).alias("south"), F.max(lon).alias("east")
    )
