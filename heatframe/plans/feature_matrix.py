"""The model table: features, look-ahead label, season, complete rows, one-hot, split."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from heatframe.functions import features as X
from heatframe.functions.scalar import is_month, one_hot
from heatframe.operators.events import event_threshold, hot_hours, label_steps
from heatframe.operators.features import apply_climatology, climatology
from heatframe.operators.series import Series, gated, over_rows

DOY_HOUR = {"_doy": lambda ts: F.dayofyear(ts), "_hour": lambda ts: F.hour(ts)}


@dataclass(frozen=True)
class Recipe:
    """Columns and spans of a feature matrix; column roles that are absent are skipped."""

    value: str = "temperature_2m"
    upper_temp: str = "t_850hPa"
    high_temp: str = "t_500hPa"
    pressure: str = "pressure_msl"
    humidity: str = "relative_humidity_2m"
    inflow: str = "v_850hPa"
    soil: str = "soil_moisture_0_to_7cm"
    zscores: tuple[str, ...] = ("temperature_2m", "t_850hPa", "t_500hPa", "pressure_msl", "relative_humidity_2m")
    periods: dict[str, Callable[[str], Column]] = field(default_factory=lambda: dict(DOY_HOUR))
    reference: tuple[str, str] = ("1990-01-01", "2015-12-31")
    label_reference: tuple[str, str] | None = None
    pct: float = 0.95
    window: int = 72
    horizon: int = 72
    months: tuple[int, ...] = (5, 6, 7, 8, 9)
    train_before: str = "2016-01-01"
    older: bool = False  # also the earlier variant's 48-hour mean, soil index and vetoes, whose gaps cost rows

    def period_columns(self, ts: str) -> dict[str, Column]:
        return {name: make(ts) for name, make in self.periods.items()}

    def reference_rows(self, ts: str) -> Column:
        day = F.col(ts).cast("date")
        return day.between(*[F.lit(d).cast("date") for d in self.reference])


def row_features(df: DataFrame, recipe: Recipe, ts: str) -> DataFrame:
    """Features of single rows: time encoding and interactions."""
    new = dict(X.time_encoding(ts))
    if {recipe.upper_temp, recipe.humidity} <= set(df.columns):
        new["heat_aridity_index"] = X.aridity_index(recipe.upper_temp, recipe.humidity)
    if recipe.older and {recipe.upper_temp, recipe.soil} <= set(df.columns):
        new["soil_heat_interaction"] = X.soil_heat(recipe.upper_temp, recipe.soil)
    return df.withColumns(new)


def window_columns(have: set[str], recipe: Recipe) -> Callable:
    """Lags, tendencies and smoothing over one ordered window; the names are fixed values."""

    def build(w) -> dict[str, Column]:
        out: dict[str, Column] = {}
        for name, column, k in (
            ("lag_t850_72h", recipe.upper_temp, 72),
            ("lag_press_48h", recipe.pressure, 48),
            ("lag_v850_72h", recipe.inflow, 72),
            ("lag_t500_72h", recipe.high_temp, 72),
            ("lag_t500_48h", recipe.high_temp, 48),
        ):
            if column in have:
                out[name] = F.lag(column, k).over(w)
        for name, column in (("delta_press_24h", recipe.pressure), ("delta_hum_24h", recipe.humidity)):
            if column in have:
                out[name] = F.col(column) - F.lag(column, 24).over(w)
        if recipe.inflow in have:
            out["v850_smooth_6h"] = gated(F.avg, F.col(recipe.inflow), w.rowsBetween(-5, 0), 6)
        if recipe.older and recipe.upper_temp in have:
            out["t850_48h_mean"] = gated(F.avg, F.col(recipe.upper_temp), w.rowsBetween(-47, 0), 48)
        return out

    return build


def with_vetoes(df: DataFrame, recipe: Recipe) -> DataFrame:
    return df.withColumns(X.veto_flags(F.col("v850_smooth_6h"), F.col("delta_press_24h"))) if recipe.older else df


def fit_climatology(df: DataFrame, series: Series, recipe: Recipe) -> DataFrame:
    """Means and deviations of the reference span, one row for each entity and period."""
    scored = [c for c in recipe.zscores if c in df.columns]
    return climatology(df, series.key_list, scored, recipe.period_columns(series.ts), recipe.reference_rows(series.ts))


def fit_limits(df: DataFrame, series: Series, recipe: Recipe) -> DataFrame:
    """The event threshold of each entity, from the label's reference span."""
    return event_threshold(
        df, series, recipe.value, recipe.pct, "daily_max_ref", recipe.label_reference or recipe.reference,
        test_from=recipe.train_before,
    )


def scored_rows(df: DataFrame, series: Series, recipe: Recipe, normal: DataFrame | None = None) -> DataFrame:
    """Anomaly scores from the reference span only (or a given climatology), and the features of single rows."""
    scored = [c for c in recipe.zscores if c in df.columns]
    normal = fit_climatology(df, series, recipe) if normal is None else normal
    return row_features(apply_climatology(df, series.key_list, scored, recipe.period_columns(series.ts), normal), recipe, series.ts)


def engineer_features(df: DataFrame, series: Series, recipe: Recipe) -> DataFrame:
    """All features, the windowed ones over one window so the rows move once."""
    rows = scored_rows(df, series, recipe)
    return with_vetoes(over_rows(rows, series, 72, 0, window_columns(set(df.columns), recipe)), recipe)


def feature_matrix(df: DataFrame, series: Series, recipe: Recipe, entities: list[str], normal: DataFrame | None = None,
                   limits: DataFrame | None = None) -> DataFrame:
    """Complete, labelled rows of the season with one-hot entities and ``is_train``.

    Label and features are computed on the whole series, over one window, and the season
    is cut last, so no window reaches across a season boundary. ``normal`` and ``limits`` are the statistics of an
    earlier fit (see ``plans.saved_matrix``); without them they come from df.
    """
    limits = fit_limits(df, series, recipe) if limits is None else limits
    hot = hot_hours(scored_rows(df, series, recipe, normal), series, recipe.value, limits)
    reach = max(72, recipe.window, recipe.horizon)
    steps = label_steps(recipe.window, recipe.horizon)
    windowed = over_rows(hot, series, reach, recipe.horizon, window_columns(set(df.columns), recipe), *steps)
    labelled = with_vetoes(windowed, recipe).drop("daily_max", "threshold", "is_hot", "sustained", "_seen")
    season = labelled.where(is_month(F.col(series.ts), list(recipe.months))).dropna("any")
    is_train = F.col(series.ts) < F.lit(recipe.train_before).cast("timestamp_ntz")
    return season.select("*", *one_hot(F.col(series.keys[0]), entities, series.keys[0]), is_train.alias("is_train"))
