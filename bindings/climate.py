"""Climate-statistics queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from bindings.inputs import HOURLY_VARS, Inputs
from bindings.registry import query
from bindings.text import r, rd, round_doubles
from heatframe.functions import scalar as X
from heatframe.operators import climate as C
from heatframe.operators.ordered import quantiles
from heatframe.operators.series import resample_daily_max
from bindings.inputs import HOURLY

REFERENCE = [1, 2, 3, 4, 5]


@query("season_filter", "SELECT station_id, obs_date, tx FROM daily_obs WHERE month(obs_date) IN (6, 7, 8)")
def _(i: Inputs):
    return i.daily_obs().where(X.is_month(F.col("obs_date"), [6, 7, 8])).select("station_id", "obs_date", "tx")


@query("threshold_flag", """
    SELECT station_id, obs_date, coalesce(wind_gust >= 40, false) AS ge, coalesce(wind_gust > 40, false) AS gt
    FROM daily_obs""")
def _(i: Inputs):
    gust = F.col("wind_gust")
    return i.daily_obs().select(
        "station_id", "obs_date", X.hot(gust, F.lit(40.0)).alias("ge"), X.hot(gust, F.lit(40.0), strict=True).alias("gt")
    )


@query("quantile_flag", f"""
    SELECT d.station_id, obs_date, {r('threshold')} AS threshold, tx >= threshold AS is_hot
    FROM daily_obs d JOIN (SELECT station_id, quantile_cont(tx, 0.9) AS threshold FROM daily_obs GROUP BY 1) q
         ON q.station_id = d.station_id""")
def _(i: Inputs):
    daily = i.daily_obs().select("station_id", "obs_date", "tx")
    return round_doubles(C.quantile_flag(daily, ["station_id"], "tx", 0.9), "threshold").drop("tx")


@query("date_range", """
    SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderdate >= DATE '1996-01-01' AND o_orderdate < DATE '1998-07-01'""")
def _(i: Inputs):
    return i.table("orders").where(X.within(F.col("o_orderdate"), "1996-01-01", "1998-06-30")).select(
        "o_orderkey", "o_orderdate"
    )


@query("annual_mean", f"""
    SELECT station_id, CAST(year(obs_date) AS INT) AS year, {r('AVG(wind_gust)')} AS wind_gust_mean
    FROM daily_obs WHERE wind_gust IS NOT NULL GROUP BY 1, 2""")
def _(i: Inputs):
    return round_doubles(C.period_mean(i.daily_obs(), ["station_id"], "obs_date", "wind_gust"), "wind_gust_mean")


@query("summer_mean", f"""
    SELECT station_id, CAST(year(obs_date) AS INT) AS year, {r('AVG(tx)')} AS tx_mean
    FROM daily_obs WHERE month(obs_date) IN (6, 7, 8) GROUP BY 1, 2""")
def _(i: Inputs):
    return round_doubles(C.period_mean(i.daily_obs(), ["station_id"], "obs_date", "tx", [6, 7, 8]), "tx_mean")


PIVOT = ", ".join(f"COUNT(*) FILTER (station_id = {s}) AS station_{s}" for s in REFERENCE)


@query("extreme_days_pivot", f"""
    SELECT CAST(year(obs_date) AS INT) AS year, {PIVOT} FROM daily_obs
    WHERE tx >= 35 AND station_id IN ({', '.join(map(str, REFERENCE))}) GROUP BY 1""")
def _(i: Inputs):
    daily = i.daily_obs().where(F.col("station_id").isin(REFERENCE))
    counts = C.exceedance_days(daily, "station_id", "obs_date", "tx", 35.0)
    return C.exceedance_pivot(counts, "station_id", REFERENCE, "station_")


@query("percentile_exceedance", """
    SELECT d.station_id, CAST(year(obs_date) AS INT) AS year,
           CAST(coalesce(SUM(CASE WHEN month(obs_date) IN (6, 7, 8) AND tx >= p90 THEN 1 ELSE 0 END), 0) AS BIGINT) AS n_days
    FROM daily_obs d LEFT JOIN (SELECT station_id, quantile_cont(tx, 0.9) AS p90 FROM daily_obs
                           WHERE year(obs_date) BETWEEN 1995 AND 1998 AND month(obs_date) IN (6, 7, 8) GROUP BY 1) p
         ON p.station_id = d.station_id
    GROUP BY 1, 2""")
def _(i: Inputs):
    return C.percentile_exceedance(i.daily_obs(), "station_id", "obs_date", "tx", 0.9, (1995, 1998), [6, 7, 8])


@query("decadal_share", f"""
    SELECT city, CAST(floor(year(obs_date) / 10) * 10 AS INT) AS decade, COUNT(*) AS n_days, COUNT(wind_gust) AS n_valid,
           CAST(SUM(CASE WHEN wind_gust > 45 THEN 1 ELSE 0 END) AS BIGINT) AS n_extreme,
           {r('SUM(CASE WHEN wind_gust > 45 THEN 1 ELSE 0 END) * 1.0 / COUNT(*)')} AS share_extreme
    FROM station_daily GROUP BY 1, 2""")
def _(i: Inputs):
    out = C.decadal_share(i.station_daily(), ["city"], "obs_date", "wind_gust", 45.0)
    return round_doubles(out, "share_extreme")


@query("resample_daily_max", """
    WITH d AS (SELECT city, CAST(ts AS DATE) AS obs_date,
                      MAX(CASE WHEN day(ts) NOT IN (7, 19) THEN temperature_2m END) AS daily_max FROM hourly_sparse
               GROUP BY 1, 2),
    c AS (SELECT city, CAST(unnest(generate_series(MIN(obs_date), MAX(obs_date), INTERVAL 1 DAY)) AS DATE) AS obs_date
          FROM d GROUP BY city)
    SELECT c.city, c.obs_date, d.daily_max FROM c LEFT JOIN d ON d.city = c.city AND d.obs_date = c.obs_date""")
def _(i: Inputs):
    gaps = F.when(~F.dayofmonth("ts").isin(7, 19), F.col("temperature_2m"))
    sparse = i.hourly_sparse().withColumn("temperature_2m", gaps)
    return resample_daily_max(sparse, HOURLY, "temperature_2m")


@query("quantile_by_key", f"""
    SELECT station_id, {r('quantile_cont(tx, 0.9)')} AS p90, {r('quantile_cont(tx, 0.95)')} AS p95,
           {r('quantile_cont(tx, 0.5)')} AS median
    FROM daily_obs GROUP BY 1""")
def _(i: Inputs):
    out = quantiles(i.daily_obs(), ["station_id"], "tx", {"p90": 0.9, "p95": 0.95, "median": 0.5})
    return round_doubles(out, "p90", "p95", "median")


BOX = ["tx", "wind_mean", "wind_gust"]


@query("boxplot_stats", f"""
    WITH tall AS (SELECT city, variable, value FROM
                  (SELECT city, tx, wind_mean, wind_gust FROM station_daily)
                  UNPIVOT (value FOR variable IN (tx, wind_mean, wind_gust))),
    q AS (SELECT city, variable, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.5) AS median,
                 quantile_cont(value, 0.75) AS q3 FROM tall GROUP BY 1, 2)
    SELECT city, variable, {r('q1')} AS q1, {r('median')} AS median, {r('q3')} AS q3,
           {r('MIN(value) FILTER (value BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1))')} AS whisker_low,
           {r('MAX(value) FILTER (value BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1))')} AS whisker_high,
           COUNT(*) FILTER (NOT value BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)) AS n_outliers
    FROM tall JOIN q USING (city, variable) GROUP BY city, variable, q1, median, q3""")
def _(i: Inputs):
    out = C.boxplot_stats(i.station_daily(), ["city"], BOX)
    return round_doubles(out, "q1", "median", "q3", "whisker_low", "whisker_high")


@query("histogram", f"""
    WITH e AS (SELECT city, MIN(tx) AS lo, MAX(tx) AS hi FROM station_daily GROUP BY city),
    b AS (SELECT d.city, lo, hi, CAST(least(floor((tx - lo) / ((hi - lo) / 30)), 29) AS INT) AS bin
          FROM station_daily d JOIN e ON e.city = d.city)
    SELECT e.city, g.bin, {r('lo + g.bin * ((hi - lo) / 30)')} AS low, {r('lo + (g.bin + 1) * ((hi - lo) / 30)')} AS high,
           COUNT(b.bin) AS n FROM (SELECT *, CAST(unnest(range(30)) AS INT) AS bin FROM e) g JOIN e USING (city, lo, hi)
    LEFT JOIN (SELECT city, bin FROM b) b ON b.city = e.city AND b.bin = g.bin GROUP BY e.city, g.bin, lo, hi""")
def _(i: Inputs):
    return round_doubles(C.histogram(i.station_daily(), ["city"], "tx"), "low", "high")


@query("histogram_all", f"""
    WITH e AS (SELECT MIN(tx) AS lo, MAX(tx) AS hi FROM daily_obs),
    b AS (SELECT CAST(least(floor((tx - lo) / ((hi - lo) / 30)), 29) AS INT) AS bin FROM daily_obs, e)
    SELECT g.bin, {r('lo + g.bin * ((hi - lo) / 30)')} AS low, {r('lo + (g.bin + 1) * ((hi - lo) / 30)')} AS high,
           COUNT(b.bin) AS n FROM (SELECT *, CAST(unnest(range(30)) AS INT) AS bin FROM e) g LEFT JOIN b ON b.bin = g.bin
    GROUP BY g.bin, lo, hi""")
def _(i: Inputs):
    return round_doubles(C.histogram(i.daily_obs(), [], "tx"), "low", "high")


@query("histogram_centre", f"""
    SELECT city, {r('AVG(tx)')} AS mean, {r('quantile_cont(tx, 0.5)')} AS median FROM station_daily GROUP BY city""")
def _(i: Inputs):
    return round_doubles(C.centre_stats(i.station_daily(), ["city"], "tx"), "mean", "median")


STATS = ["count", "mean", "std", "min", "p25", "p50", "p75", "max"]
TALL = ", ".join(f'"{v}"' for v in HOURLY_VARS)
TYPED = ", ".join(f'CAST("{v}" AS DOUBLE) AS "{v}"' for v in HOURLY_VARS)


@query("describe_features", f"""
    WITH tall AS (SELECT city, variable, value FROM (SELECT city, {TYPED} FROM hourly_obs)
                  UNPIVOT (value FOR variable IN ({TALL})))
    SELECT city, variable, COUNT(*) AS count, {r('AVG(value)', 3)} AS mean, {r('stddev_samp(value)', 3)} AS std,
           {r('MIN(value)', 3)} AS min, {r('quantile_cont(value, 0.25)', 3)} AS p25, {r('quantile_cont(value, 0.5)', 3)} AS p50,
           {r('quantile_cont(value, 0.75)', 3)} AS p75, {r('MAX(value)', 3)} AS max
    FROM tall GROUP BY city, variable""")
def _(i: Inputs):
    out = C.describe(i.hourly_obs(), ["city"], HOURLY_VARS, digits=9)
    return out.select("city", "variable", "count", *[rd(c, 3).alias(c) for c in STATS[1:]])


# Power sums of the centred and scaled year, then Cramer's rule, spelled out for degree 2.
@query("poly_trend", f"""
    WITH y AS (SELECT station_id, CAST(year(obs_date) AS INT) AS year, AVG(tx) AS v FROM daily_obs
               WHERE month(obs_date) IN (6, 7, 8) GROUP BY 1, 2),
    z AS (SELECT *, (year - AVG(year) OVER w) / greatest(MAX(year) OVER w - MIN(year) OVER w, 1e-9) AS z,
                 COUNT(*) OVER w AS n FROM y WINDOW w AS (PARTITION BY station_id)),
    s AS (SELECT station_id, n, SUM(z) AS s1, SUM(z*z) AS s2, SUM(z*z*z) AS s3, SUM(z*z*z*z) AS s4,
                 SUM(v) AS t0, SUM(z*v) AS t1, SUM(z*z*v) AS t2 FROM z GROUP BY 1, 2),
    d AS (SELECT *, n*(s2*s4-s3*s3) - s1*(s1*s4-s3*s2) + s2*(s1*s3-s2*s2) AS det FROM s),
    c AS (SELECT station_id,
             (t0*(s2*s4-s3*s3) - s1*(t1*s4-s3*t2) + s2*(t1*s3-s2*t2)) / det AS c0,
             (n*(t1*s4-s3*t2) - t0*(s1*s4-s3*s2) + s2*(s1*t2-t1*s2)) / det AS c1,
             (n*(s2*t2-t1*s3) - s1*(s1*t2-t1*s2) + t0*(s1*s3-s2*s2)) / det AS c2
          FROM d WHERE n > 2)
    SELECT z.station_id, year, {r('v')} AS tx_mean, {r('c0 + c1*z.z + c2*z.z*z.z')} AS fitted
    FROM z LEFT JOIN c ON c.station_id = z.station_id""")
def _(i: Inputs):
    annual = C.period_mean(i.daily_obs(), ["station_id"], "obs_date", "tx", [6, 7, 8])
    return round_doubles(C.poly_trend(annual, ["station_id"], "year", "tx_mean", 2), "tx_mean", "fitted")
