"""Climate statistics: period means, exceedance counts, shares, distributions, trends."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heatframe.functions.scalar import decade, hot, is_month, ratio
from heatframe.functions.statistics import polynomial, solve
from heatframe.operators.ordered import quantiles


def period_mean(
    df: DataFrame, keys: list[str], ts: str, value: str, months: list[int] | None = None
) -> DataFrame:
    """(keys, year, {value}_mean) over rows with a value, optionally one season."""
    rows = df.where(F.col(value).isNotNull())
    if months:
        rows = rows.where(is_month(F.col(ts), months))
    return rows.groupBy(*keys, F.year(ts).alias("year")).agg(F.avg(value).alias(f"{value}_mean"))


def exceedance_days(
    df: DataFrame, key: str, ts: str, value: str, threshold: float | str, strict: bool = False
) -> DataFrame:
    """(key, year, n_days): days at or above a constant or a threshold column."""
    limit = F.col(threshold) if isinstance(threshold, str) else F.lit(threshold)
    hits = df.where(hot(F.col(value), limit, strict))
    return hits.groupBy(key, F.year(ts).alias("year")).agg(F.count("*").alias("n_days"))


def exceedance_pivot(counts: DataFrame, key: str, columns: list, prefix: str = "") -> DataFrame:
    """One column per entity in the given order, years down, absent combinations 0."""
    wide = counts.groupBy("year").pivot(key, columns).agg(F.sum("n_days"))
    return wide.select("year", *[F.coalesce(F.col(f"`{c}`"), F.lit(0)).alias(f"{prefix}{c}") for c in columns])


def baseline_thresholds(
    df: DataFrame, keys: list[str], ts: str, value: str, pct: float, years: tuple[int, int], months: list[int]
) -> DataFrame:
    """(keys, threshold): quantile of the season inside the baseline years."""
    base = df.where(F.year(ts).between(*years) & is_month(F.col(ts), months))
    return quantiles(base, keys, value, {"threshold": pct})


def percentile_exceedance(
    df: DataFrame, key: str, ts: str, value: str, pct: float, years: tuple[int, int], months: list[int]
) -> DataFrame:
    """(key, year, n_days) of season days at or above the entity's baseline quantile, for
    every year in which the entity has a row; years without such a day, and entities
    without a baseline, have 0.

    Season values are counted first, so what meets the thresholds is a row for each
    (key, year, value).
    """
    thresholds = baseline_thresholds(df, [key], ts, value, pct, years, months)
    counted = df.groupBy(key, F.year(ts).alias("year"), F.when(is_month(F.col(ts), months), F.col(value)).alias("_v")).agg(
        F.count("*").alias("_n"))
    reached = F.when(F.col("_v") >= F.col("threshold"), F.col("_n")).otherwise(0)
    return counted.join(thresholds, key, "left").groupBy(key, "year").agg(F.sum(reached).alias("n_days"))


def decadal_share(df: DataFrame, keys: list[str], ts: str, value: str, threshold: float) -> DataFrame:
    """Rows, rows with a value, extreme rows (strictly above) and their share per decade.

    ``n_days`` counts rows with and without a value, so the share is diluted by gaps.
    """
    flag = hot(F.col(value), F.lit(threshold), strict=True).cast("long")
    out = df.groupBy(*keys, decade(F.col(ts)).alias("decade")).agg(
        F.count("*").alias("n_days"),
        F.count(value).alias("n_valid"),
        F.sum(flag).alias("n_extreme"),
    )
    return out.withColumn("share_extreme", ratio(F.col("n_extreme"), F.col("n_days")))


def quantile_flag(df: DataFrame, keys: list[str], value: str, pct: float, name: str = "is_hot") -> DataFrame:
    """Adds the entity's quantile as ``threshold`` and the ``>=`` flag; entities without a
    value drop out.

    A threshold meets the distinct values of its entity, and rows meet it by (keys,
    value), so no row is shuffled by its entity alone.
    """
    limits = quantiles(df, keys, value, {"threshold": pct})
    values = df.groupBy(*keys, F.col(value).alias("_v")).agg(F.count("*")).select(*keys, "_v").join(limits, keys)
    met = values.withColumn("_key", F.coalesce(F.xxhash64("_v"), F.lit(0))).withColumnsRenamed({k: f"_of_{k}" for k in keys})
    rows = df.withColumn("_key", F.coalesce(F.xxhash64(value), F.lit(0)))
    same = (rows["_key"] == met["_key"]) & rows[value].eqNullSafe(met["_v"])
    for k in keys:
        same = same & (rows[k] == met[f"_of_{k}"])
    joined = rows.join(met, same).select(*[rows[c] for c in df.columns], "threshold")
    return joined.withColumn(name, hot(F.col(value), F.col("threshold")))


def boxplot_stats(df: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """(keys, variable, q1, median, q3, whisker_low, whisker_high, n_outliers).

    Whiskers are the extreme values inside 1.5 interquartile ranges.
    """
    by = [*keys, "variable"]
    # equal values are one row with their number
    tall = long_form(df, keys, columns)
    quartiles = quantiles(tall, by, "value", {"q1": 0.25, "median": 0.5, "q3": 0.75})
    tall = tall.groupBy(*by, "value").agg(F.count("*").alias("_n"))
    reach = (F.col("q3") - F.col("q1")) * 1.5
    inside = F.col("value").between(F.col("q1") - reach, F.col("q3") + reach)
    return tall.join(quartiles, by).groupBy(*by, "q1", "median", "q3").agg(
        F.min(F.when(inside, F.col("value"))).alias("whisker_low"),
        F.max(F.when(inside, F.col("value"))).alias("whisker_high"),
        F.sum(F.when(inside, 0).otherwise(F.col("_n"))).alias("n_outliers"),
    )


def long_form(df: DataFrame, ids: list[str], columns: list[str]) -> DataFrame:
    """(ids, variable, value) without missing values."""
    typed = df.select(*ids, *[F.col(c).cast("double").alias(c) for c in columns])
    return typed.unpivot(ids, columns, "variable", "value").where("value IS NOT NULL")


def histogram(df: DataFrame, keys: list[str], value: str, bins: int = 30) -> DataFrame:
    """(keys, bin, low, high, n): all equal bins between minimum and maximum of each key,
    the last one closed on the right, empty ones with 0. Without keys over all rows."""
    present = df.where(F.col(value).isNotNull()).groupBy(*keys, F.col(value).cast("double").alias("_v")).agg(
        F.count("*").alias("_n"))
    marked = present if keys else present.withColumn("_all", F.lit(1))
    by = keys or ["_all"]
    ends = marked.groupBy(*by).agg(F.min("_v").alias("_min"), F.max("_v").alias("_max"))
    width = (F.col("_max") - F.col("_min")) / bins
    index = F.coalesce(F.floor(F.try_divide(F.col("_v") - F.col("_min"), width)), F.lit(0))
    placed = marked.join(ends, by).withColumn("bin", F.least(index, F.lit(bins - 1)).cast("int"))
    counts = placed.groupBy(*by, "bin").agg(F.sum("_n").alias("n"))
    every = ends.withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    return every.join(counts, [*by, "bin"], "left").select(
        *keys, "bin", (F.col("_min") + F.col("bin") * width).alias("low"),
        (F.col("_min") + (F.col("bin") + 1) * width).alias("high"), F.coalesce("n", F.lit(0)).alias("n"),
    )


def centre_stats(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys, mean, median) shown next to a histogram."""
    means = df.groupBy(*keys).agg(F.avg(value).alias("mean"))
    return means.join(quantiles(df, keys, value, {"median": 0.5}), keys)


def describe(df: DataFrame, keys: list[str], columns: list[str], digits: int = 3) -> DataFrame:
    """count, mean, std, min, quartiles and max of each column, rounded."""
    tall = long_form(df, keys, columns)
    by = [*keys, "variable"]
    basic = tall.groupBy(*by).agg(
        F.count("value").alias("count"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"),
        F.min("value").alias("min"), F.max("value").alias("max"),
    )
    out = basic.join(quantiles(tall, by, "value", {"p25": 0.25, "p50": 0.5, "p75": 0.75}), by)
    return out.select(
        *by, "count", *[F.round(c, digits).alias(c) for c in ("mean", "std", "min", "p25", "p50", "p75", "max")]
    )


def poly_trend(df: DataFrame, keys: list[str], x: str, y: str, degree: int = 2) -> DataFrame:
    """Adds ``fitted``: least-squares polynomial of ``y`` on ``x`` within each key.

    x is centred and scaled per key before the power sums are built, which keeps the
    normal equations well conditioned. Keys with too few points get NULL.
    """
    points = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    spread = points.groupBy(*keys).agg(
        F.avg(x).alias("_mid"), F.greatest(F.max(x) - F.min(x), F.lit(1e-9)).cast("double").alias("_width")
    )
    z = (F.col(x) - F.col("_mid")) / F.col("_width")
    scaled = points.join(spread, keys).withColumn("_z", z)
    powers = [F.lit(1.0)]
    for _ in range(2 * degree):
        powers.append(powers[-1] * F.col("_z"))
    sums = scaled.groupBy(*keys, "_mid", "_width").agg(
        *[F.sum(p).alias(f"_s{i}") for i, p in enumerate(powers)],
        *[F.sum(powers[i] * F.col(y)).alias(f"_t{i}") for i in range(degree + 1)],
        F.countDistinct(x).alias("_points"),
    )
    size = range(degree + 1)
    matrix = [[F.col(f"_s{i + j}") for j in size] for i in size]
    coefficients = solve(matrix, [F.col(f"_t{i}") for i in size])
    fits = sums.where(F.col("_points") > degree).select(
        *keys, "_mid", "_width", *[c.alias(f"_c{i}") for i, c in enumerate(coefficients)]
    )
    joined = df.join(fits, keys, "left")
    value = polynomial(z, [F.col(f"_c{i}") for i in size])
    return joined.select(*df.columns, value.alias("fitted"))
