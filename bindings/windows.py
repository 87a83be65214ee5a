"""Rolling, lag, lead and rank queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from bindings.inputs import DAILY, HOURLY, Inputs
from bindings.registry import query
from bindings.text import r, rd, round_doubles
from heatframe.operators import asof as A
from heatframe.operators import series as S
from heatframe.operators.climate import period_mean
from heatframe.operators.ordered import average_ranks
from heatframe.operators.runs import label_runs
from heatframe.operators.windows import rolling_corr, rolling_year_mean
from heatframe.functions.scalar import hot

W = "OVER (PARTITION BY city ORDER BY ts"


@query("rolling_year_mean", f"""
    WITH annual AS (SELECT station_id, CAST(year(obs_date) AS INT) AS year, AVG(tx) AS tx_mean
                    FROM daily_obs GROUP BY 1, 2)
    SELECT station_id, year, {r('tx_mean')} AS tx_mean,
           {r('AVG(tx_mean) OVER (PARTITION BY station_id ORDER BY year ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)')}
               AS tx_mean_5y
    FROM annual""")
def _(i: Inputs):
    annual = period_mean(i.daily_obs(), ["station_id"], "obs_date", "tx")
    out = rolling_year_mean(annual, ["station_id"], "year", "tx_mean", 5)
    return round_doubles(out, "tx_mean", "tx_mean_5y")


@query("rolling_mean_30", f"""
    SELECT station_id, obs_date, {r('''CASE WHEN COUNT(wind_gust) OVER w >= 15 THEN AVG(wind_gust) OVER w END''')}
               AS wind_gust_30
    FROM daily_obs
    WINDOW w AS (PARTITION BY station_id ORDER BY obs_date ROWS BETWEEN 29 PRECEDING AND CURRENT ROW)""")
def _(i: Inputs):
    daily = i.daily_obs().select("station_id", "obs_date", "wind_gust")
    out = S.rolling(daily, DAILY, "wind_gust", 30, min_periods=15, name="wind_gust_30")
    return round_doubles(out, "wind_gust_30").drop("wind_gust")


def _gated_mean(i: Inputs, column: str, window: int):
    hourly = i.hourly_obs().select("city", "ts", column)
    out = S.rolling(hourly, HOURLY, column, window, name=f"mean_{window}")
    return round_doubles(out, f"mean_{window}").drop(column)


def _gated_sql(column: str, window: int) -> str:
    mean = r(f"CASE WHEN COUNT({column}) OVER w >= {window} THEN AVG({column}) OVER w END")
    return f"""SELECT city, ts, {mean} AS mean_{window} FROM hourly_obs
        WINDOW w AS (PARTITION BY city ORDER BY ts ROWS BETWEEN {window - 1} PRECEDING AND CURRENT ROW)"""


@query("rolling_mean_6", _gated_sql('"v_850hPa"', 6))
def _(i: Inputs):
    return _gated_mean(i, "v_850hPa", 6)


@query("rolling_mean_48", _gated_sql('"t_850hPa"', 48))
def _(i: Inputs):
    return _gated_mean(i, "t_850hPa", 48)


@query("lag_features", f"""
    SELECT city, ts, LAG("t_850hPa", 72) {W}) AS lag_t850_72h, LAG(pressure_msl, 48) {W}) AS lag_press_48h,
           LAG("v_850hPa", 72) {W}) AS lag_v850_72h, LAG("t_500hPa", 72) {W}) AS lag_t500_72h,
           LAG("t_500hPa", 48) {W}) AS lag_t500_48h
    FROM hourly_obs""")
def _(i: Inputs):
    wanted = {
        "lag_t850_72h": ("t_850hPa", 72),
        "lag_press_48h": ("pressure_msl", 48),
        "lag_v850_72h": ("v_850hPa", 72),
        "lag_t500_72h": ("t_500hPa", 72),
        "lag_t500_48h": ("t_500hPa", 48),
    }
    return S.lags(i.hourly_obs(), HOURLY, wanted).select("city", "ts", *wanted)


@query("lag_rows", """
    SELECT station_id, obs_date, LAG(tx, 3) OVER w AS tx_lag_3, LEAD(tx, 2) OVER w AS tx_lead_2
    FROM daily_obs WINDOW w AS (PARTITION BY station_id ORDER BY obs_date)""")
def _(i: Inputs):
    out = S.lags(i.daily_obs(), DAILY, {"tx_lag_3": ("tx", 3), "tx_lead_2": ("tx", -2)})
    return out.select("station_id", "obs_date", "tx_lag_3", "tx_lead_2")


@query("future_jump", f"""
    SELECT city, ts, {r(f'LEAD(temperature_2m, 72) {W}) - temperature_2m')} AS jump_3d_future,
           {r(f'LEAD(temperature_2m, 48) {W}) - temperature_2m')} AS jump_2d_future,
           {r(f'LEAD(temperature_2m, 24) {W}) - temperature_2m')} AS jump_1d_future
    FROM hourly_obs""")
def _(i: Inputs):
    wanted = {f"jump_{d}d_future": ("temperature_2m", -24 * d) for d in (3, 2, 1)}
    out = S.changes(i.hourly_obs(), HOURLY, wanted).select("city", "ts", *wanted)
    return round_doubles(out, *wanted)


@query("delta_features", f"""
    SELECT city, ts, {r(f'pressure_msl - LAG(pressure_msl, 24) {W})')} AS delta_press_24h,
           {r(f'relative_humidity_2m - LAG(relative_humidity_2m, 24) {W})')} AS delta_hum_24h
    FROM hourly_obs""")
def _(i: Inputs):
    wanted = {"delta_press_24h": ("pressure_msl", 24), "delta_hum_24h": ("relative_humidity_2m", 24)}
    out = S.changes(i.hourly_obs(), HOURLY, wanted).select("city", "ts", *wanted)
    return round_doubles(out, *wanted)


RUN_SQL = """
    WITH flagged AS (SELECT station_id, obs_date, tx >= 30 AS is_hot,
               lag(tx >= 30) OVER (PARTITION BY station_id ORDER BY obs_date) AS prev FROM daily_obs),
    runs AS (SELECT *, SUM(CASE WHEN prev IS NULL OR prev <> is_hot THEN 1 ELSE 0 END)
               OVER (PARTITION BY station_id ORDER BY obs_date) AS run_id FROM flagged)
    """


def _runs(i: Inputs):
    daily = i.daily_obs().select("station_id", "obs_date", hot(F.col("tx"), 30.0).alias("is_hot"))
    return label_runs(daily, DAILY, "is_hot")


@query("run_ids", RUN_SQL + "SELECT station_id, obs_date, is_hot, CAST(run_id AS BIGINT) AS run_id FROM runs")
def _(i: Inputs):
    return _runs(i).drop("run_pos", "run_len")


@query("streak_counter", RUN_SQL + """
    SELECT station_id, obs_date, CASE WHEN is_hot THEN ROW_NUMBER() OVER
           (PARTITION BY station_id, run_id ORDER BY obs_date) ELSE 0 END AS streak FROM runs""")
def _(i: Inputs):
    streak = F.when(F.col("is_hot"), F.col("run_pos")).otherwise(F.lit(0).cast("long"))
    return _runs(i).select("station_id", "obs_date", streak.alias("streak"))


@query("run_length_total", RUN_SQL + """
    SELECT station_id, obs_date, CASE WHEN is_hot THEN COUNT(*) OVER (PARTITION BY station_id, run_id)
           ELSE 0 END AS heat_duration FROM runs""")
def _(i: Inputs):
    duration = F.when(F.col("is_hot"), F.col("run_len")).otherwise(F.lit(0).cast("long"))
    return _runs(i).select("station_id", "obs_date", duration.alias("heat_duration"))


CORR_OTHERS = ["pressure_msl", "relative_humidity_2m", "v_850hPa"]


def _corr_sql(other: str) -> str:
    pair = f'CASE WHEN temperature_2m IS NOT NULL AND "{other}" IS NOT NULL THEN 1 END'
    value = f'corr(temperature_2m, "{other}") OVER w'
    return r(f"CASE WHEN COUNT({pair}) OVER w >= 12 AND NOT isnan({value}) THEN {value} END") + f' AS "corr_{other}"'


@query("rolling_corr", f"""
    SELECT city, ts, {', '.join(_corr_sql(o) for o in CORR_OTHERS)} FROM hourly_obs
    WINDOW w AS (PARTITION BY city ORDER BY ts ROWS BETWEEN 23 PRECEDING AND CURRENT ROW)""")
def _(i: Inputs):
    out = rolling_corr(i.hourly_obs(), HOURLY, "temperature_2m", CORR_OTHERS)
    return out.select("city", "ts", *[rd(f"corr_{o}").alias(f"corr_{o}") for o in CORR_OTHERS])


@query("average_rank", """
    SELECT DISTINCT station_id, tx, COUNT(*) OVER (PARTITION BY station_id, tx) AS n,
           CAST(RANK() OVER (PARTITION BY station_id ORDER BY tx) + (COUNT(*) OVER (PARTITION BY station_id, tx) - 1)
                / 2.0 AS DOUBLE) AS rank
    FROM daily_obs""")
def _(i: Inputs):
    ranks = average_ranks(i.daily_obs(), ["station_id"], "tx")
    return ranks.select("station_id", "tx", "n", F.col("rank").cast("double").alias("rank"))


SPARSE_DAYS = """
    WITH days AS (SELECT city, CAST(CAST(ts AS DATE) AS TIMESTAMP) AS day, MAX(temperature_2m) AS daily_max
                  FROM hourly_sparse WHERE day(ts) % 5 <> 2 GROUP BY 1, 2)
    """


def sparse_days(i: Inputs):
    """Daily maxima, of which whole days are missing."""
    hourly = i.hourly_sparse().where(F.dayofmonth("ts") % 5 != 2)
    return hourly.groupBy("city", F.col("ts").cast("date").cast("timestamp_ntz").alias("day")).agg(
        F.max("temperature_2m").alias("daily_max"))


@query("daily_to_hourly_asof", SPARSE_DAYS + """
    SELECT h.city, h.ts, d.day AS as_of, d.daily_max FROM hourly_sparse h ASOF LEFT JOIN days d ON h.city = d.city AND h.ts >= d.day""")
def _(i: Inputs):
    return A.asof_join(i.hourly_sparse().select("city", "ts"), sparse_days(i), HOURLY, "day", ["daily_max"])


@query("daily_to_hourly_asof_near", SPARSE_DAYS + """
    SELECT h.city, h.ts, CASE WHEN epoch(h.ts) - epoch(d.day) <= 30 * 3600 THEN d.day END AS as_of,
           CASE WHEN epoch(h.ts) - epoch(d.day) <= 30 * 3600 THEN d.daily_max END AS daily_max
    FROM hourly_sparse h ASOF LEFT JOIN days d ON h.city = d.city AND h.ts > d.day""")
def _(i: Inputs):
    return A.asof_join(i.hourly_sparse().select("city", "ts"), sparse_days(i), HOURLY, "day", ["daily_max"], strict=True, tolerance=30)


@query("carry_forward", """
    SELECT city, ts, last_value(soil_moisture IGNORE NULLS) OVER w AS soil_moisture,
           last_value("t_500hPa" IGNORE NULLS) OVER w AS "t_500hPa"
    FROM hourly_gaps WINDOW w AS (PARTITION BY city ORDER BY ts)""")
def _(i: Inputs):
    rows = i.hourly_gaps().select("city", "ts", "soil_moisture", "t_500hPa")
    return A.carry_forward(rows, HOURLY, ["soil_moisture", "t_500hPa"])
