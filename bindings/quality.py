"""Screening, projection and join queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from bindings.inputs import Inputs
from bindings.registry import query
from bindings.text import r, rd, round_doubles
from heatframe.functions import scalar as X
from heatframe.functions.features import align_columns, downcast_floats, select_rename
from heatframe.operators import joins as J
from heatframe.operators import quality as Q
from heatframe.operators.climate import period_mean

VARS = ["tx", "wind_mean", "wind_gust"]


@query("select_rename", """
    SELECT station_id, obs_date, tx AS temp_max_c, wind_gust AS wind_max_inst_ms FROM daily_obs""")
def _(i: Inputs):
    return select_rename(
        i.daily_obs(), ["station_id", "obs_date"], {"tx": "temp_max_c", "wind_gust": "wind_max_inst_ms"}
    )


@query("station_summary", """
    SELECT station_id, station_name, COUNT(wind_gust) AS n_values, MIN(obs_date) AS start_date, MAX(obs_date) AS end_date
    FROM station_daily GROUP BY 1, 2""")
def _(i: Inputs):
    return Q.station_summary(i.station_daily(), ["station_id", "station_name"], "obs_date", "wind_gust")


TOP_SQL = """
    WITH s AS (SELECT city, station_id, COUNT(wind_gust) AS n_values, MIN(obs_date) AS start_date, MAX(obs_date) AS end_date
               FROM station_daily GROUP BY 1, 2),
    top AS (SELECT *, CAST(ROW_NUMBER() OVER (PARTITION BY city ORDER BY n_values DESC, station_id) AS INT) AS rank
            FROM s WHERE n_values >= 400 AND year(end_date) >= 2001)
    """


def _top(i: Inputs):
    return Q.top_stations(i.station_daily(), "city", "station_id", "obs_date", "wind_gust", 400, 2001)


@query("top_stations", TOP_SQL + "SELECT * FROM top WHERE rank <= 5")
def _(i: Inputs):
    return _top(i)


@query("filter_selected_stations", TOP_SQL + """
    SELECT station_id, obs_date, tx FROM daily_obs WHERE station_id IN (SELECT station_id FROM top WHERE rank <= 5)""")
def _(i: Inputs):
    return Q.keep_stations(i.daily_obs(), _top(i), "station_id").select("station_id", "obs_date", "tx")


BEST_SQL = """
    WITH q AS (SELECT city, station_id, AVG(CASE WHEN wind_gust IS NULL THEN 1.0 ELSE 0.0 END) AS missing_share
               FROM station_daily GROUP BY 1, 2),
    b AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY city ORDER BY round(missing_share, 12), station_id) AS n FROM q)
    """


@query("reference_entities", BEST_SQL + """
    SELECT city, station_id, obs_date, tx FROM station_daily SEMI JOIN (SELECT * FROM b WHERE n = 1) b USING (city, station_id)""")
def _(i: Inputs):
    daily = i.station_daily()
    best = Q.best_station(daily, "city", "station_id", "wind_gust")
    return daily.join(best, ["city", "station_id"], "left_semi").select("city", "station_id", "obs_date", "tx")


@query("best_station", BEST_SQL + f"SELECT city, station_id, {r('missing_share')} AS missing_share FROM b WHERE n = 1")
def _(i: Inputs):
    return round_doubles(Q.best_station(i.station_daily(), "city", "station_id", "wind_gust"), "missing_share")


@query("station_quality", f"""
    SELECT station_name, {r('AVG(CASE WHEN wind_gust IS NULL THEN 1.0 ELSE 0.0 END)')} AS missing_share
    FROM station_daily GROUP BY 1""")
def _(i: Inputs):
    return round_doubles(Q.station_quality(i.station_daily(), ["station_name"], "wind_gust"), "missing_share")


@query("complete_cases", "SELECT * FROM daily_obs WHERE wind_gust IS NOT NULL AND tx IS NOT NULL AND wind_mean IS NOT NULL")
def _(i: Inputs):
    return Q.complete_cases(i.daily_obs())


@query("dropped_rows", """
    SELECT station_id, COUNT(*) AS n_rows, COUNT(wind_gust) AS n_complete, COUNT(*) - COUNT(wind_gust) AS n_dropped
    FROM daily_obs GROUP BY 1""")
def _(i: Inputs):
    return Q.dropped_count(i.daily_obs(), ["station_id"], VARS)


@query("align_columns", """
    SELECT wind_mean, CAST(0.0 AS DOUBLE) AS wind_dir, tx FROM daily_obs""")
def _(i: Inputs):
    return align_columns(i.daily_obs(), ["wind_mean", "wind_dir", "tx"])


@query("downcast_floats", """
    SELECT station_id, CAST(SUM(CAST(CAST(wind_mean AS FLOAT) AS DOUBLE)) AS DOUBLE) AS wind_sum,
           CAST(MAX(CAST(tx AS FLOAT)) AS FLOAT) AS tx_max
    FROM daily_obs GROUP BY 1""")
def _(i: Inputs):
    small = downcast_floats(i.daily_obs())
    return small.groupBy("station_id").agg(F.sum("wind_mean").alias("wind_sum"), F.max("tx").alias("tx_max"))


@query("dedup_keys", """
    SELECT station_id, obs_date, price, l_orderkey, l_linenumber FROM (
        SELECT l_suppkey AS station_id, CAST(l_shipdate AS DATE) AS obs_date, l_extendedprice AS price, l_orderkey,
               l_linenumber, ROW_NUMBER() OVER (PARTITION BY l_suppkey, CAST(l_shipdate AS DATE)
                                                ORDER BY l_orderkey, l_linenumber, l_extendedprice) AS n
        FROM lineitem) WHERE n = 1""")
def _(i: Inputs):
    rows = i.table("lineitem").select(
        F.col("l_suppkey").alias("station_id"), F.col("l_shipdate").cast("date").alias("obs_date"),
        F.col("l_extendedprice").alias("price"), "l_orderkey", "l_linenumber",
    )
    return Q.dedup_keys(rows, ["station_id", "obs_date"], [F.col("l_orderkey"), F.col("l_linenumber")])


@query("join_temp_wind", """
    WITH wind AS (SELECT l_suppkey AS station_id, CAST(l_shipdate AS DATE) AS obs_date, MIN(l_tax) AS tax
                  FROM lineitem WHERE l_returnflag = 'N' GROUP BY 1, 2)
    SELECT station_id, obs_date, d.tx AS tx_tx, w.tax AS tx_wind FROM daily_obs d JOIN wind w USING (station_id, obs_date)""")
def _(i: Inputs):
    wind = i.table("lineitem").where("l_returnflag = 'N'").select(
        F.col("l_suppkey").alias("station_id"), F.col("l_shipdate").cast("date").alias("obs_date"), F.col("l_tax").alias("tx")
    )
    daily = i.daily_obs().select("station_id", "obs_date", "tx")
    return J.join_observations(daily, wind, ["station_id", "obs_date"])


MATCH_SQL = """
    WITH pairs AS (SELECT g.city, d.station_id, round(d.tx) AS a, round(g.tx) AS b
                   FROM daily_obs d JOIN region_daily g ON g.obs_date = d.obs_date),
    m AS (SELECT city, station_id, COUNT(*) FILTER (a = b) AS matching_days FROM pairs GROUP BY 1, 2),
    ranked AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY city ORDER BY matching_days DESC, station_id) AS n FROM m),
    t AS (SELECT city, COUNT(*) AS total_days_compared FROM pairs GROUP BY 1),
    best AS (SELECT t.city, station_id, matching_days, total_days_compared
             FROM t JOIN (SELECT * FROM ranked WHERE n = 1) r ON r.city = t.city)
    """


def _matched(i: Inputs):
    daily = i.daily_obs().select("station_id", "obs_date", F.round("tx").alias("tx"))
    region = i.region_daily().select("city", "obs_date", F.round("tx").alias("temp_max_c"))
    return daily, region, J.match_station(daily, region, "station_id", "city", "obs_date", "tx", "temp_max_c")


@query("match_station", MATCH_SQL + """
    SELECT city, station_id, CAST(matching_days AS BIGINT) AS matching_days, total_days_compared FROM best""")
def _(i: Inputs):
    return _matched(i)[2]


@query("match_station_rejoin", MATCH_SQL + """
    SELECT best.city, best.station_id, d.obs_date, round(d.tx) AS tx, round(g.tx) AS temp_max_c
    FROM best JOIN daily_obs d ON d.station_id = best.station_id
    JOIN region_daily g ON g.city = best.city AND g.obs_date = d.obs_date""")
def _(i: Inputs):
    daily, region, best = _matched(i)
    return J.rejoin_best(daily, region, best, "station_id", "city", "obs_date")


COVERAGE_SQL = """
    WITH c AS (SELECT city, 'tx' AS variable, COUNT(tx) AS n_non_null, COUNT(*) AS n FROM station_daily GROUP BY 1
               UNION ALL SELECT city, 'wind_mean', COUNT(wind_mean), COUNT(*) FROM station_daily GROUP BY 1
               UNION ALL SELECT city, 'wind_gust', COUNT(wind_gust), COUNT(*) FROM station_daily GROUP BY 1),
    cov AS (SELECT city, variable, n_non_null, round(n_non_null * 100.0 / n, 1) AS coverage_pct FROM c)
    """


def _coverage(i: Inputs):
    return Q.variable_coverage(i.station_daily(), ["city"], VARS)


@query("coverage_long", COVERAGE_SQL + "SELECT city, variable, n_non_null, CAST(coverage_pct AS DOUBLE) AS coverage_pct FROM cov")
def _(i: Inputs):
    return _coverage(i).withColumn("coverage_pct", F.col("coverage_pct").cast("double"))


@query("coverage_ready", COVERAGE_SQL + """
    SELECT city, variable, n_non_null, CAST(coverage_pct AS DOUBLE) AS coverage_pct FROM cov WHERE coverage_pct >= 87""")
def _(i: Inputs):
    return Q.coverage_ready(_coverage(i), 87.0).withColumn("coverage_pct", F.col("coverage_pct").cast("double"))


CITIES = ["AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST"]
WIDE = ", ".join(f"CAST(MAX(coverage_pct) FILTER (city = '{c}') AS DOUBLE) AS \"{c}\"" for c in CITIES)


@query("coverage_wide", COVERAGE_SQL + f"SELECT variable, {WIDE} FROM cov GROUP BY variable")
def _(i: Inputs):
    out = Q.coverage_wide(_coverage(i), "city", CITIES)
    return out.select("variable", *[F.col(c).cast("double").alias(c) for c in CITIES])


@query("coverage_min_rank", COVERAGE_SQL + """
    SELECT variable, CAST(m AS DOUBLE) AS min_coverage_pct, CAST(ROW_NUMBER() OVER (ORDER BY m DESC, variable) AS INT) AS rank
    FROM (SELECT variable, MIN(coverage_pct) AS m FROM cov GROUP BY variable)""")
def _(i: Inputs):
    out = Q.coverage_min_rank(_coverage(i))
    return out.withColumn("min_coverage_pct", F.col("min_coverage_pct").cast("double"))


@query("availability_by_entity", f"""
    SELECT city, {', '.join(r(f'COUNT({v}) * 100.0 / COUNT(*)', 2) + f' AS {v}' for v in VARS)}
    FROM station_daily GROUP BY city""")
def _(i: Inputs):
    return Q.availability(i.station_daily(), ["city"], VARS)


@query("availability_by_year", f"""
    WITH y AS (SELECT station_id, CAST(year(obs_date) AS INT) AS year,
                      COUNT(CASE WHEN year(obs_date) NOT IN (1997, 1999) THEN wind_gust END) * 100.0 / COUNT(*) AS pct
               FROM daily_obs GROUP BY 1, 2),
    s AS (SELECT station_id, CAST(unnest(generate_series(MIN(year), MAX(year))) AS INT) AS year FROM y GROUP BY 1)
    SELECT s.station_id, s.year, {r('pct')} AS availability_pct
    FROM s LEFT JOIN y ON y.station_id = s.station_id AND y.year = s.year""")
def _(i: Inputs):
    daily = i.daily_obs().withColumn("wind_gust", F.when(~F.year("obs_date").isin(1997, 1999), F.col("wind_gust")))
    return round_doubles(Q.availability_by_year(daily, ["station_id"], "obs_date", "wind_gust"), "availability_pct")


@query("missing_years", f"""
    SELECT city, CAST(year(obs_date) AS INT) AS year, COUNT(wind_gust) AS n_available, COUNT(*) AS n_days,
           {r('100 - COUNT(wind_gust) * 100.0 / COUNT(*)')} AS missing_pct,
           100 - COUNT(wind_gust) * 100.0 / COUNT(*) > 10 AS affected
    FROM station_daily WHERE month(obs_date) IN (6, 7, 8) GROUP BY 1, 2""")
def _(i: Inputs):
    out = Q.missing_years(i.station_daily(), ["city"], "obs_date", "wind_gust", [6, 7, 8])
    return round_doubles(out, "missing_pct")


STAT_SQL = ", ".join(
    f"{r(f'AVG({v})')} AS {v}_mean, {r(f'stddev_samp({v})')} AS {v}_std, {r(f'MAX({v})')} AS {v}_max" for v in VARS
)


@query("entity_stats", f"SELECT city, {STAT_SQL} FROM station_daily GROUP BY city")
def _(i: Inputs):
    out = Q.entity_stats(i.station_daily(), ["city"], VARS)
    return round_doubles(out, *[f"{v}_{s}" for v in VARS for s in ("mean", "std", "max")])


@query("scalar_date_features", f"""
    SELECT event_id, CAST(year(ts) AS INT) AS year, CAST(month(ts) AS INT) AS month, CAST(dayofyear(ts) AS INT) AS doy,
           CAST(hour(ts) AS INT) AS hour, CAST(floor(year(ts) / 10) * 10 AS INT) AS decade,
           CAST(date_trunc('month', ts) AS DATE) AS month_start, strftime(ts, '%Y-%m-%d %H:%M:%S') AS stamp,
           {r('sin(2 * pi() * hour(ts) / 24)')} AS hour_sin, {r('cos(2 * pi() * hour(ts) / 24)')} AS hour_cos,
           {r('sin(2 * pi() * dayofyear(ts) / 365)')} AS doy_sin, {r('cos(2 * pi() * dayofyear(ts) / 365)')} AS doy_cos
    FROM events""")
def _(i: Inputs):
    ts = F.col("ts")
    hour_sin, hour_cos = X.cyclic(F.hour(ts), 24)
    doy_sin, doy_cos = X.cyclic(F.dayofyear(ts), 365)
    return i.table("events").select(
        "event_id", F.year(ts).alias("year"), F.month(ts).alias("month"), F.dayofyear(ts).alias("doy"),
        F.hour(ts).alias("hour"), X.decade(ts).alias("decade"), X.month_start(ts).alias("month_start"),
        X.stamp(ts).alias("stamp"), rd(hour_sin).alias("hour_sin"), rd(hour_cos).alias("hour_cos"),
        rd(doy_sin).alias("doy_sin"), rd(doy_cos).alias("doy_cos"),
    )


@query("scalar_angles", f"""
    SELECT city, ts, {r('sin(radians(relative_humidity_2m * 3.6))')} AS wind_dir_sin,
           {r('cos(radians(relative_humidity_2m * 3.6))')} AS wind_dir_cos FROM hourly_obs""")
def _(i: Inputs):
    from heatframe.functions.features import encode_direction

    hourly = i.hourly_obs().select("city", "ts", (F.col("relative_humidity_2m") * 3.6).alias("wind_direction_10m"))
    return round_doubles(encode_direction(hourly, "wind_direction_10m"), "wind_dir_sin", "wind_dir_cos")


@query("one_hot", """
    SELECT c_custkey, CAST(c_mktsegment = 'BUILDING' AS INT) AS "seg_BUILDING",
           CAST(c_mktsegment = 'MACHINERY' AS INT) AS "seg_MACHINERY" FROM customer""")
def _(i: Inputs):
    flags = X.one_hot(F.col("c_mktsegment"), ["BUILDING", "MACHINERY"], "seg")
    return i.table("customer").select("c_custkey", *flags)
