"""Projections: renames, alignment, encodings and derived predictors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from heatframe.functions.scalar import below, celsius, cyclic, direction


def select_rename(df: DataFrame, keep: list[str], names: dict[str, str]) -> DataFrame:
    """Keys plus the renamed columns that exist."""
    return df.select(*keep, *[F.col(a).alias(b) for a, b in names.items() if a in df.columns])


def align_columns(df: DataFrame, wanted: list[str]) -> DataFrame:
    """Exactly ``wanted`` in that order; absent columns are 0.0."""
    return df.select(*[F.col(c) if c in df.columns else F.lit(0.0).alias(c) for c in wanted])


def downcast_floats(df: DataFrame) -> DataFrame:
    return df.select(*[F.col(c).cast("float").alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def encode_direction(df: DataFrame, column: str, out: tuple[str, str] = ("wind_dir_sin", "wind_dir_cos")) -> DataFrame:
    """Replaces degrees by sin/cos; a frame that is already encoded is unchanged."""
    if column not in df.columns:
        return df
    sin, cos = direction(F.col(column))
    return df.withColumns({out[0]: sin, out[1]: cos}).drop(column)


def time_encoding(ts: str) -> dict[str, Column]:
    """Hour of day and day of year as points on a circle (365 in leap years too)."""
    hour, doy = cyclic(F.hour(ts), 24), cyclic(F.dayofyear(ts), 365)
    return {"hour_sin": hour[0], "hour_cos": hour[1], "doy_sin": doy[0], "doy_cos": doy[1]}


def aridity_index(temperature_k: str, humidity: str) -> Column:
    """Warm and dry air in one number: degrees Celsius minus percent."""
    return celsius(F.col(temperature_k)) - F.col(humidity)


def soil_heat(temperature_k: str, soil: str, eps: float = 0.001) -> Column:
    return F.try_divide(F.col(temperature_k).cast("double"), F.col(soil) + eps)


def veto_flags(smooth_wind: Column, pressure_change: Column, drop: float = -5.0) -> dict[str, Column]:
    """Northerly inflow and falling pressure, missing is 0."""
    return {"veto_north_wind": below(smooth_wind, 0.0), "veto_pressure_drop": below(pressure_change, drop)}
