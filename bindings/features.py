"""Feature-engineering queries."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.sql import functions as F

from bindings.events import HOT_SQL, REF, _label_sql
from bindings.inputs import HOURLY, Inputs
from bindings.registry import query
from bindings.text import r, rd, round_doubles
from heatframe.functions import features as X
from heatframe.operators import features as K
from heatframe.operators.series import gated, over_rows
from heatframe.plans.feature_matrix import Recipe, feature_matrix
from heatframe.plans.saved_matrix import FeatureMatrix
from heatframe.session import new_path

HOUR = {"_hour": F.hour}
ZS = ["temperature_2m", "pressure_msl", "t_850hPa"]
CITIES = ["click", "error", "purchase", "signup", "view"]


def reference_rows():
    return F.col("ts").cast("date").between(*[F.lit(d).cast("date") for d in REF])


CLIM_SQL = """
    WITH clim AS (SELECT city, CAST(hour(ts) AS INT) AS hour, {cols} FROM hourly_obs
                  WHERE CAST(ts AS DATE) BETWEEN DATE '2024-01-01' AND DATE '2024-01-20' GROUP BY 1, 2)
    """.format(cols=", ".join(f'AVG("{z}") AS "{z}_mean", stddev_samp("{z}") AS "{z}_std"' for z in ZS))


def _normal(i: Inputs):
    return K.climatology(i.hourly_obs(), ["city"], ZS, {"hour": F.hour("ts")}, reference_rows())


@query("climatology", CLIM_SQL + "SELECT city, hour, " + ", ".join(
    f'{r(f"""{chr(34)}{z}_{s}{chr(34)}""")} AS "{z}_{s}"' for z in ZS for s in ("mean", "std")
) + " FROM clim")
def _(i: Inputs):
    return round_doubles(_normal(i), *[f"{z}_{s}" for z in ZS for s in ("mean", "std")])


@query("climatology_doy", f"""
    SELECT station_id, CAST(dayofyear(obs_date) AS INT) AS doy, {r('AVG(tx)')} AS tx_mean, {r('stddev_samp(tx)')} AS tx_std
    FROM daily_obs WHERE obs_date BETWEEN DATE '1995-01-01' AND DATE '1998-12-31' GROUP BY 1, 2""")
def _(i: Inputs):
    reference = F.col("obs_date").between(F.lit("1995-01-01").cast("date"), F.lit("1998-12-31").cast("date"))
    out = K.climatology(i.daily_obs(), ["station_id"], ["tx"], {"doy": F.dayofyear("obs_date")}, reference)
    return round_doubles(out, "tx_mean", "tx_std")


@query("zscore_climatology", CLIM_SQL + "SELECT h.city, h.ts, " + ", ".join(
    f'{r(f"""(h.{chr(34)}{z}{chr(34)} - c.{chr(34)}{z}_mean{chr(34)}) / (c.{chr(34)}{z}_std{chr(34)} + 1e-8)""")} AS "{z}_zscore"'
    for z in ZS
) + " FROM hourly_obs h LEFT JOIN clim c ON c.city = h.city AND c.hour = hour(h.ts)")
def _(i: Inputs):
    hourly = i.hourly_obs().select("city", "ts", *ZS)
    out = K.apply_climatology(hourly, ["city"], ZS, {"hour": F.hour("ts")}, _normal(i))
    return round_doubles(out.drop(*ZS), *[f"{z}_zscore" for z in ZS])


@query("zscore_month_hour", "SELECT city, ts, " + ", ".join(
    r(f'("{z}" - AVG("{z}") OVER w) / CASE WHEN stddev_samp("{z}") OVER w = 0 THEN 1 ELSE stddev_samp("{z}") OVER w END')
    + f' AS "{z}"' for z in ZS
) + " FROM hourly_obs WINDOW w AS (PARTITION BY city, month(ts), hour(ts))")
def _(i: Inputs):
    hourly = i.hourly_obs().select("city", "ts", *ZS)
    out = K.zscore_within(hourly, ["city"], ZS, {"_month": F.month("ts"), "_hour": F.hour("ts")})
    return round_doubles(out, *ZS)


@query("interaction_features", f"""
    SELECT city, ts, {r('"t_850hPa" - 273.15 - relative_humidity_2m')} AS heat_aridity_index,
           {r('"t_850hPa" / (soil_moisture + 0.001)')} AS soil_heat_interaction FROM hourly_obs""")
def _(i: Inputs):
    return i.hourly_obs().select(
        "city", "ts", rd(X.aridity_index("t_850hPa", "relative_humidity_2m")).alias("heat_aridity_index"),
        rd(X.soil_heat("t_850hPa", "soil_moisture")).alias("soil_heat_interaction"),
    )


VETO_SQL = """
    WITH s AS (SELECT *, CASE WHEN COUNT("v_850hPa") OVER w >= 6 THEN AVG("v_850hPa") OVER w END AS smooth,
                      pressure_msl - LAG(pressure_msl, 24) OVER (PARTITION BY city ORDER BY ts) AS delta
               FROM hourly_obs WINDOW w AS (PARTITION BY city ORDER BY ts ROWS BETWEEN 5 PRECEDING AND CURRENT ROW))
    """


@query("veto_flags", VETO_SQL + """
    SELECT city, ts, CAST(coalesce(round(smooth, 9) < 0, false) AS INT) AS veto_north_wind,
           CAST(coalesce(round(delta, 9) < -5, false) AS INT) AS veto_pressure_drop FROM s""")
def _(i: Inputs):
    moved = over_rows(
        i.hourly_obs(), HOURLY, 24, 0,
        lambda w: {
            "smooth": gated(F.avg, F.col("v_850hPa"), w.rowsBetween(-5, 0), 6),
            "delta": F.col("pressure_msl") - F.lag("pressure_msl", 24).over(w),
        },
    )
    flags = X.veto_flags(F.round("smooth", 9), F.round("delta", 9))
    return moved.select("city", "ts", *[f.alias(n) for n, f in flags.items()])


def recipe() -> Recipe:
    return Recipe(
        zscores=tuple(ZS), periods={"_hour": F.hour}, reference=REF, soil="soil_moisture", pct=0.5, window=24, horizon=24,
        months=(1,), train_before="2024-01-21",
    )


def matrix(i: Inputs):
    return feature_matrix(i.hourly_obs(), HOURLY, recipe(), CITIES)


MATRIX_COLUMNS = [
    "temperature_2m", "pressure_msl", "wind_speed_10m", "t_850hPa", "v_850hPa", "t_500hPa", "soil_moisture",
    "temperature_2m_zscore", "pressure_msl_zscore", "t_850hPa_zscore", "hour_sin", "hour_cos", "doy_sin", "doy_cos",
    "heat_aridity_index", "lag_t850_72h", "lag_press_48h", "lag_v850_72h", "lag_t500_72h",
    "lag_t500_48h", "delta_press_24h", "delta_hum_24h", "v850_smooth_6h",
]
FLOATS = ", ".join(r(f'"{c}"') + f' AS "{c}"' for c in MATRIX_COLUMNS)
ONE_HOT = ", ".join(f"CAST(city = '{c}' AS INT) AS city_{c}" for c in CITIES)
HAVE = " AND ".join(f'"{c}" IS NOT NULL' for c in [*MATRIX_COLUMNS, "relative_humidity_2m", "y"])


MATRIX_SQL = HOT_SQL + _label_sql(24, 24) + "," + CLIM_SQL.strip()[len("WITH"):] + f""",
    w AS (SELECT h.*, {', '.join(f'(h."{z}" - c."{z}_mean") / (c."{z}_std" + 1e-8) AS "{z}_zscore"' for z in ZS)},
        sin(2 * pi() * hour(h.ts) / 24) AS hour_sin, cos(2 * pi() * hour(h.ts) / 24) AS hour_cos,
        sin(2 * pi() * dayofyear(h.ts) / 365) AS doy_sin, cos(2 * pi() * dayofyear(h.ts) / 365) AS doy_cos,
        "t_850hPa" - 273.15 - relative_humidity_2m AS heat_aridity_index,
        LAG("t_850hPa", 72) OVER p AS lag_t850_72h, LAG(pressure_msl, 48) OVER p AS lag_press_48h,
        LAG("v_850hPa", 72) OVER p AS lag_v850_72h, LAG("t_500hPa", 72) OVER p AS lag_t500_72h,
        LAG("t_500hPa", 48) OVER p AS lag_t500_48h, pressure_msl - LAG(pressure_msl, 24) OVER p AS delta_press_24h,
        relative_humidity_2m - LAG(relative_humidity_2m, 24) OVER p AS delta_hum_24h,
        CASE WHEN COUNT("v_850hPa") OVER p6 >= 6 THEN AVG("v_850hPa") OVER p6 END AS v850_smooth_6h
      FROM hourly_obs h LEFT JOIN clim c ON c.city = h.city AND c.hour = hour(h.ts)
      WINDOW p AS (PARTITION BY h.city ORDER BY h.ts),
             p6 AS (PARTITION BY h.city ORDER BY h.ts ROWS BETWEEN 5 PRECEDING AND CURRENT ROW)),
    m AS (SELECT w.*, l.y FROM w JOIN labelled l ON l.city = w.city AND l.ts = w.ts)
    SELECT city, ts, relative_humidity_2m, y, {FLOATS}, {ONE_HOT},
           ts < TIMESTAMP '2024-01-21 00:00:00' AS is_train
    FROM m WHERE {HAVE}"""


@query("feature_matrix", MATRIX_SQL)
def _(i: Inputs):
    return round_doubles(matrix(i), *MATRIX_COLUMNS)


@query("feature_matrix_reloaded", MATRIX_SQL)
def _(i: Inputs):
    """The same matrix, rebuilt by a pipeline that was fitted, saved and loaded."""
    path = new_path(i.spark, "matrix")
    Pipeline(stages=[FeatureMatrix(HOURLY, recipe(), CITIES)]).fit(i.hourly_obs()).write().save(path)
    return round_doubles(PipelineModel.load(path).transform(i.hourly_obs()), *MATRIX_COLUMNS)
