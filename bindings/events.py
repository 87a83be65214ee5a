"""Event, label and alarm queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from bindings.inputs import CITY_DAILY, DAILY, HOURLY, Inputs
from bindings.registry import query
from bindings.text import r, rd, round_doubles
from heatframe.functions.scalar import is_month
from heatframe.operators import event_reports as R
from heatframe.operators import events as E
from heatframe.operators.ordered import quantiles
from heatframe.operators.series import densify

ROWS_SQL = """
    WITH runs AS (SELECT station_id, obs_date, tx >= 30 AS is_hot,
               ROW_NUMBER() OVER (PARTITION BY station_id ORDER BY obs_date)
             - ROW_NUMBER() OVER (PARTITION BY station_id, tx >= 30 ORDER BY obs_date) AS island
           FROM daily_obs),
    ev AS (SELECT e.station_id, e.start_date, e.end_date, e.days, s.lat, s.lon, s.city
           FROM (SELECT station_id, MIN(obs_date) AS start_date, MAX(obs_date) AS end_date, COUNT(*) AS days
                 FROM runs WHERE is_hot GROUP BY station_id, island HAVING COUNT(*) >= 3) e
           JOIN stations s USING (station_id))
    """


def _events(i: Inputs):
    found = E.detect_events(i.daily_obs(), DAILY, "tx", 30.0, 3, gap="rows")
    return found.join(i.stations().select("station_id", "lat", "lon", "city"), "station_id")


@query("heat_events_rows", ROWS_SQL + "SELECT * EXCLUDE (city) FROM ev")
def _(i: Inputs):
    return _events(i).drop("city")


@query("heat_events_calendar", f"""
    WITH hot AS (SELECT d.city, obs_date, p, obs_date - CAST(ROW_NUMBER() OVER (PARTITION BY d.city ORDER BY obs_date) AS INT) AS island
           FROM region_daily d JOIN (SELECT city, quantile_cont(tx, 0.7) AS p FROM region_daily GROUP BY city) q
                ON q.city = d.city WHERE tx > p)
    SELECT city, MIN(obs_date) AS start_date, MAX(obs_date) AS end_date, COUNT(*) AS days, {r('MAX(p)')} AS threshold
    FROM hot GROUP BY city, island HAVING COUNT(*) >= 3""")
def _(i: Inputs):
    daily = i.region_daily()
    limits = quantiles(daily, ["city"], "tx", {"threshold": 0.7})
    found = E.detect_events(daily.join(limits, "city"), CITY_DAILY, "tx", "threshold", 3, gap="calendar", strict=True)
    return round_doubles(found.join(limits, "city"), "threshold")


@query("heat_events_calendar_stations", """
    WITH hot AS (SELECT station_id, obs_date,
               obs_date - CAST(ROW_NUMBER() OVER (PARTITION BY station_id ORDER BY obs_date) AS INT) AS island
           FROM daily_obs WHERE tx >= 30)
    SELECT station_id, MIN(obs_date) AS start_date, MAX(obs_date) AS end_date, COUNT(*) AS days
    FROM hot GROUP BY station_id, island HAVING COUNT(*) >= 3""")
def _(i: Inputs):
    return E.detect_events(i.daily_obs(), DAILY, "tx", 30.0, 3, gap="calendar")


TAG_SQL = """
    WITH f AS (SELECT station_id, obs_date, wind_mean, wind_gust, coalesce(wind_gust >= 30, false) AS is_hot FROM daily_obs),
    g AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY station_id ORDER BY obs_date)
                  - ROW_NUMBER() OVER (PARTITION BY station_id, is_hot ORDER BY obs_date) AS island FROM f),
    t AS (SELECT *, CASE WHEN is_hot THEN ROW_NUMBER() OVER (PARTITION BY station_id, is_hot, island ORDER BY obs_date)
                    ELSE 0 END AS hot_spell_len FROM g)
    """


def _tags(i: Inputs):
    daily = i.daily_obs().select("station_id", "obs_date", "wind_mean", "wind_gust")
    return E.heatwave_tags(daily, DAILY, "wind_gust", 30.0, 3)


@query("heatwave_tags", TAG_SQL + """
    SELECT station_id, obs_date, is_hot, hot_spell_len, hot_spell_len >= 3 AS heatwave_ge_3days,
           hot_spell_len > 3 AS heatwave_gt_3days FROM t""")
def _(i: Inputs):
    return _tags(i).drop("wind_mean", "wind_gust")


@query("wind_vs_temp", TAG_SQL + """
    SELECT station_id, obs_date, wind_mean, wind_gust, hot_spell_len >= 3 AS heatwave_ge_3days
    FROM t WHERE month(obs_date) IN (6, 7, 8)""")
def _(i: Inputs):
    season = _tags(i).where(is_month(F.col("obs_date"), [6, 7, 8]))
    return season.select("station_id", "obs_date", "wind_mean", "wind_gust", "heatwave_ge_3days")


@query("events_filtered", ROWS_SQL + """
    SELECT station_id, start_date, end_date, days FROM ev
    WHERE start_date >= DATE '1996-06-01' AND end_date <= DATE '1999-06-30' AND city IN ('ASIA', 'EUROPE')""")
def _(i: Inputs):
    chosen = i.stations().where(F.col("city").isin("ASIA", "EUROPE"))
    kept = R.filter_events(_events(i), "1996-06-01", "1999-06-30", chosen, "station_id")
    return kept.select("station_id", "start_date", "end_date", "days")


@query("event_kpis", ROWS_SQL + f"""
    SELECT COUNT(*) AS n_events, COUNT(DISTINCT station_id) AS n_stations, {r('AVG(days)')} AS avg_days FROM ev""")
def _(i: Inputs):
    return round_doubles(R.event_kpis(_events(i), "station_id"), "avg_days")


@query("events_per_station", ROWS_SQL + """
    SELECT station_id, lat, lon, COUNT(*) AS n_events, COUNT(*) * 100 AS marker_size FROM ev GROUP BY 1, 2, 3""")
def _(i: Inputs):
    return R.events_per_station(_events(i), ["station_id", "lat", "lon"])


@query("events_per_month", ROWS_SQL + """
    SELECT CAST(date_trunc('month', start_date) AS DATE) AS month, COUNT(*) AS n_events FROM ev GROUP BY 1""")
def _(i: Inputs):
    return R.events_per_month(_events(i))


@query("events_per_city", ROWS_SQL + """
    SELECT coalesce(city, 'total') AS city, COUNT(*) AS n_events FROM ev GROUP BY ROLLUP (city)""")
def _(i: Inputs):
    return R.events_per_entity(_events(i), "city")


HOT_SQL = """
    WITH daily AS (SELECT city, CAST(ts AS DATE) AS obs_date, MAX(temperature_2m) AS daily_max FROM hourly_obs GROUP BY 1, 2),
    thr AS (SELECT city, quantile_cont(daily_max, 0.5) AS threshold FROM daily
            WHERE obs_date BETWEEN DATE '2024-01-01' AND DATE '2024-01-20' GROUP BY 1),
    hot AS (SELECT h.city, h.ts, h.temperature_2m, d.daily_max, t.threshold, coalesce(d.daily_max >= t.threshold, false) AS is_hot
            FROM hourly_obs h JOIN daily d ON d.city = h.city AND d.obs_date = CAST(h.ts AS DATE) JOIN thr t ON t.city = h.city)
    """
REF = ("2024-01-01", "2024-01-20")


def _thresholds(i: Inputs, basis="daily_max_ref"):
    return E.event_threshold(i.hourly_obs(), HOURLY, "temperature_2m", 0.5, basis, REF)


def _hot(i: Inputs):
    hourly = i.hourly_obs().select("city", "ts", "temperature_2m")
    return E.hot_hours(hourly, HOURLY, "temperature_2m", _thresholds(i))


@query("daily_to_hourly", HOT_SQL + "SELECT city, ts, daily_max FROM hot")
def _(i: Inputs):
    from heatframe.operators.series import daily_to_hourly

    return daily_to_hourly(i.hourly_obs(), HOURLY, "temperature_2m").select("city", "ts", "daily_max")


@query("hot_hours", HOT_SQL + f"SELECT city, ts, daily_max, {r('threshold')} AS threshold, is_hot FROM hot")
def _(i: Inputs):
    return round_doubles(_hot(i).drop("temperature_2m"), "threshold")


def _label_sql(window: int, horizon: int) -> str:
    return f""",
    k AS (SELECT *, ROW_NUMBER() OVER w AS rn, CASE WHEN ROW_NUMBER() OVER w >= {window} THEN MIN(CAST(is_hot AS INT))
                 OVER (PARTITION BY city ORDER BY ts ROWS BETWEEN {window - 1} PRECEDING AND CURRENT ROW) END AS sustained
          FROM hot WINDOW w AS (PARTITION BY city ORDER BY ts)),
    labelled AS (SELECT *, MAX(CASE WHEN rn > {horizon} THEN sustained END)
                 OVER (PARTITION BY city ORDER BY ts ROWS BETWEEN 1 FOLLOWING AND {horizon} FOLLOWING) AS y FROM k)
    """


@query("sustained_flag", HOT_SQL + _label_sql(24, 24) + "SELECT city, ts, is_hot, sustained FROM labelled")
def _(i: Inputs):
    return E.sustained_label(_hot(i), HOURLY, 24, 24).select("city", "ts", "is_hot", "sustained")


@query("lookahead_label", HOT_SQL + _label_sql(72, 72) + "SELECT city, ts, sustained, y FROM labelled")
def _(i: Inputs):
    hourly = i.hourly_obs().select("city", "ts", "temperature_2m")
    out = E.lookahead_label(hourly, HOURLY, "temperature_2m", 0.5, 72, 72, "daily_max_ref", REF)
    return out.select("city", "ts", "sustained", "y")


@query("lookahead_label_hourly_basis", HOT_SQL.replace(
    "SELECT city, quantile_cont(daily_max, 0.5) AS threshold FROM daily\n            WHERE obs_date BETWEEN DATE '2024-01-01' AND DATE '2024-01-20' GROUP BY 1",
    "SELECT city, quantile_cont(temperature_2m, 0.8) AS threshold FROM hourly_obs GROUP BY 1",
) + _label_sql(24, 24) + "SELECT city, ts, sustained, y FROM labelled")
def _(i: Inputs):
    hourly = i.hourly_obs().select("city", "ts", "temperature_2m")
    out = E.lookahead_label(hourly, HOURLY, "temperature_2m", 0.8, 24, 24, "hourly_all")
    return out.select("city", "ts", "sustained", "y")


@query("daily_lookahead_label", """
    WITH cal AS (SELECT city, CAST(unnest(generate_series(MIN(obs_date), MAX(obs_date), INTERVAL 1 DAY)) AS DATE) AS obs_date
                 FROM region_daily GROUP BY city),
    f AS (SELECT c.city, c.obs_date, coalesce(d.tx >= 30, false) AS is_hot
          FROM cal c LEFT JOIN region_daily d ON d.city = c.city AND d.obs_date = c.obs_date),
    g AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY city ORDER BY obs_date)
                  - ROW_NUMBER() OVER (PARTITION BY city, is_hot ORDER BY obs_date) AS island FROM f),
    e AS (SELECT *, CAST(is_hot AND COUNT(*) OVER (PARTITION BY city, is_hot, island) >= 3 AS INT) AS in_event FROM g)
    SELECT city, obs_date, is_hot, in_event,
           MAX(in_event) OVER (PARTITION BY city ORDER BY obs_date ROWS BETWEEN 1 FOLLOWING AND 3 FOLLOWING) AS y FROM e""")
def _(i: Inputs):
    daily = densify(i.region_daily(), CITY_DAILY)
    return E.daily_lookahead_label(daily, CITY_DAILY, "tx", 30.0).drop("tx")


ALARM_SQL = HOT_SQL + """,
    test AS (SELECT h.city, ts, MAX(temperature_2m) OVER (PARTITION BY h.city, CAST(ts AS DATE)) AS m, threshold
             FROM hourly_obs h JOIN thr ON thr.city = h.city WHERE ts >= TIMESTAMP '2024-01-21 00:00:00'),
    alarms AS (SELECT city, ts, CAST(coalesce(m >= threshold, false) AS INT) AS alarm FROM test)
    """


@query("baseline_alarm", ALARM_SQL + "SELECT * FROM alarms")
def _(i: Inputs):
    return E.baseline_alarm(i.hourly_obs(), HOURLY, "temperature_2m", _thresholds(i), "2024-01-21")


@query("baseline_alarm_any", ALARM_SQL + "SELECT city, ts, MAX(alarm) OVER (PARTITION BY ts) AS alarm FROM alarms")
def _(i: Inputs):
    return E.baseline_alarm(i.hourly_obs(), HOURLY, "temperature_2m", _thresholds(i), "2024-01-21", any_entity=True)


CUTS = [0, 24, 36, 48, 60, 72]


@query("near_miss", f"""
    WITH thr AS (SELECT city, quantile_cont(temperature_2m, 0.2) AS threshold FROM hourly_obs GROUP BY 1),
    f AS (SELECT h.city, ts, coalesce(temperature_2m >= threshold, false) AS is_hot,
                 coalesce(temperature_2m >= 1.3 * threshold, false) AS pred, coalesce(pressure_msl >= 50, false) AS truth
          FROM hourly_obs h JOIN thr ON thr.city = h.city),
    g AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY city ORDER BY ts)
                  - ROW_NUMBER() OVER (PARTITION BY city, is_hot ORDER BY ts) AS island FROM f),
    s AS (SELECT *, CASE WHEN is_hot THEN COUNT(*) OVER (PARTITION BY city, is_hot, island) ELSE 0 END AS spell FROM g)
    SELECT c.min_hours, COUNT(*) FILTER (spell >= c.min_hours) AS n_fp,
           {r('COUNT(*) FILTER (spell >= c.min_hours) * 100.0 / COUNT(*)')} AS share_pct
    FROM s, (VALUES {', '.join(f'({c})' for c in CUTS)}) c(min_hours) WHERE pred AND NOT truth GROUP BY 1""")
def _(i: Inputs):
    hourly = i.hourly_obs().select("city", "ts", "temperature_2m", "pressure_msl")
    limits = quantiles(hourly, ["city"], "temperature_2m", {"threshold": 0.2})
    scored = hourly.join(limits, "city").select(
        "city", "ts", "temperature_2m",
        F.coalesce(F.col("pressure_msl") >= 50, F.lit(False)).cast("int").alias("true"),
        F.coalesce(F.col("temperature_2m") >= 1.3 * F.col("threshold"), F.lit(False)).cast("int").alias("pred"),
    )
    return round_doubles(E.near_miss(scored, HOURLY, "temperature_2m", limits, CUTS), "share_pct")


EVENT_WINDOW_SQL = """
    WITH daily AS (SELECT city, CAST(ts AS DATE) AS obs_date, MAX(temperature_2m) AS m FROM hourly_obs GROUP BY 1, 2),
    thr AS (SELECT city, quantile_cont(m, 0.5) AS threshold FROM daily GROUP BY 1),
    hot AS (SELECT d.city, obs_date, obs_date - CAST(ROW_NUMBER() OVER (PARTITION BY d.city ORDER BY obs_date) AS INT) AS island
            FROM daily d JOIN thr ON thr.city = d.city WHERE m > threshold),
    ev AS (SELECT city, MIN(obs_date) AS start_date, COUNT(*) AS days FROM hot GROUP BY city, island HAVING COUNT(*) >= 2),
    win AS (SELECT h.*, e.start_date, -ROW_NUMBER() OVER (PARTITION BY e.city, e.start_date ORDER BY h.ts DESC) AS offset_h
            FROM ev e JOIN hourly_obs h ON h.city = e.city AND h.ts >= CAST(e.start_date AS TIMESTAMP) - INTERVAL 72 HOUR
                 AND h.ts < CAST(e.start_date AS TIMESTAMP))
    """


def event_windows(i: Inputs):
    from heatframe.plans.precursor import hourly_events

    hourly = i.hourly_obs()
    return E.event_windows(hourly_events(hourly, HOURLY, "temperature_2m", 0.5, 2), hourly, HOURLY)


@query("event_windows", EVENT_WINDOW_SQL + """
    SELECT city, start_date, ts, CAST(offset_h AS INT) AS "offset", temperature_2m FROM win""")
def _(i: Inputs):
    return event_windows(i).select("city", "start_date", "ts", "offset", "temperature_2m")
