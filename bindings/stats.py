"""Correlation, precursor and probability-plot queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from bindings.events import EVENT_WINDOW_SQL
from bindings.inputs import HOURLY, HOURLY_VARS, Inputs
from bindings.registry import query
from bindings.text import r, rd, round_doubles
from heatframe.functions import statistics as A
from heatframe.operators import evaluate as V
from heatframe.operators import stats as T
from heatframe.operators.climate import decadal_share
from heatframe.plans import precursor as P

VALUES = ", ".join(f'CAST("{v}" AS DOUBLE) AS "{v}"' for v in HOURLY_VARS)


def rank_sql(column: str, by: str) -> str:
    """Average rank inside ``by``."""
    part = f"PARTITION BY {by}" if by else ""
    also = f"PARTITION BY {by}, {column}" if by else f"PARTITION BY {column}"
    return f"(RANK() OVER ({part} ORDER BY {column}) + (COUNT(*) OVER ({also}) - 1) / 2.0)"


def nan_null(expr: str) -> str:
    return f"CASE WHEN isnan({expr}) THEN NULL ELSE {expr} END"


@query("spearman_trend", f"""
    WITH s AS (SELECT station_id, CAST(year(obs_date) AS INT) AS year, SUM(CASE WHEN tx > 35 THEN 1 ELSE 0 END) * 1.0 / COUNT(*) AS share
               FROM daily_obs GROUP BY 1, 2),
    k AS (SELECT station_id, {rank_sql('year', 'station_id')} AS a, {rank_sql('round(share, 9)', 'station_id')} AS b FROM s),
    c AS (SELECT station_id, COUNT(*) AS n, {nan_null('corr(a, b)')} AS rho FROM k GROUP BY 1),
    d AS (SELECT *, rho * sqrt((n - 2) / nullif(1 - rho * rho, 0)) AS t, atan(abs(rho) / nullif(sqrt(1 - rho * rho), 0)) AS th FROM c)
    SELECT station_id, n, {r('rho')} AS rho, {r('t', 5)} AS t,
           {r("""CASE WHEN abs(rho) >= 1 THEN 0 WHEN n = 3 THEN 1 - 2 * th / pi()
                 WHEN n = 4 THEN 1 - sin(th) WHEN n = 5 THEN 1 - 2 / pi() * (th + sin(th) * cos(th))
                 WHEN n = 6 THEN 1 - sin(th) * (1 + pow(cos(th), 2) / 2)
                 WHEN n = 7 THEN 1 - 2 / pi() * (th + sin(th) * (cos(th) + 2.0 / 3 * pow(cos(th), 3))) END""")} AS p_value FROM d""")
def _(i: Inputs):
    share = i.daily_obs().groupBy("station_id", F.year("obs_date").alias("year")).agg(
        F.round(F.avg((F.col("tx") > 35).cast("double")), 9).alias("share")
    )
    out = T.trend_test(share, ["station_id"], "year", "share")
    return out.select("station_id", "n", rd("rho").alias("rho"), rd("t", 5).alias("t"), rd("p_value").alias("p_value"))


@query("spearman_decades", f"""
    WITH s AS (SELECT city, CAST(floor(year(obs_date) / 10) * 10 AS INT) AS decade, COUNT(*) AS n_days,
                      SUM(CASE WHEN tx > 35 THEN 1 ELSE 0 END) * 1.0 / COUNT(*) AS share FROM station_daily GROUP BY 1, 2)
    SELECT city, COUNT(*) AS n, {r("corr(decade, CASE WHEN share IS NULL THEN 0 ELSE rk END)")} AS rho
    FROM (SELECT *, {rank_sql('share', 'city')} AS rk FROM s) GROUP BY city""")
def _(i: Inputs):
    share = decadal_share(i.station_daily(), ["city"], "obs_date", "tx", 35.0)
    return round_doubles(T.spearman_by(share, ["city"], "decade", "share_extreme"), "rho")


def pair_sql(a: str, b: str, by: str, source: str) -> str:
    """Spearman correlation of one pair over its own complete rows; ``by`` may be empty."""
    key = f"{by}, " if by else ""
    return f"""SELECT {key}{nan_null('corr(a, b)')} AS rho FROM (
        SELECT {key}{rank_sql('a', by)} AS a, {rank_sql('b', by)} AS b
        FROM (SELECT {key}CAST("{a}" AS DOUBLE) AS a, CAST("{b}" AS DOUBLE) AS b FROM {source}
              WHERE "{a}" IS NOT NULL AND "{b}" IS NOT NULL)) {f'GROUP BY {by}' if by else ''}"""


def matrix_sql(by: str) -> str:
    key = f"{by}, " if by else ""
    pairs = [(a, b) for n, a in enumerate(HOURLY_VARS) for b in HOURLY_VARS[n:]]
    cells = " UNION ALL ".join(
        f"SELECT {key}'{a}' AS var_a, '{b}' AS var_b, rho FROM ({pair_sql(a, b, by, 'hourly_gaps')})" for a, b in pairs
    )
    return f"""
    WITH upper_cells AS ({cells}),
    cells AS (SELECT * FROM upper_cells UNION ALL
              SELECT {key}var_b AS var_a, var_a AS var_b, rho FROM upper_cells WHERE var_a <> var_b)
    """


def _matrix(i: Inputs):
    return T.spearman_matrix(i.hourly_gaps(), ["city"], ["ts"], HOURLY_VARS)


@query("spearman_matrix", matrix_sql("city") + f"SELECT city, var_a, var_b, {r('rho')} AS rho FROM upper_cells")
def _(i: Inputs):
    return round_doubles(_matrix(i), "rho")


@query("spearman_pooled", matrix_sql("") + f"SELECT var_a, var_b, {r('rho')} AS rho FROM upper_cells")
def _(i: Inputs):
    return round_doubles(T.spearman_pooled(i.hourly_gaps(), ["city", "ts"], HOURLY_VARS), "rho")


@query("corr_strength_rank", matrix_sql("city") + f"""
    SELECT city, variable, {r('m')} AS mean_abs_rho,
           CAST(ROW_NUMBER() OVER (PARTITION BY city ORDER BY round(m, 9) DESC, variable) AS INT) AS rank
    FROM (SELECT city, var_a AS variable, AVG(abs(rho)) AS m FROM cells GROUP BY 1, 2)""")
def _(i: Inputs):
    return round_doubles(T.strength_rank(_matrix(i), ["city"]), "mean_abs_rho")


@query("collinear_groups", "WITH RECURSIVE" + matrix_sql("city").strip()[len("WITH"):] + """,
    links AS (SELECT city, var_a, var_b FROM cells WHERE abs(rho) >= 0.3 OR var_a = var_b),
    reach AS (SELECT city, var_a, var_b FROM links UNION
              SELECT r.city, r.var_a, l.var_b FROM reach r JOIN links l ON l.city = r.city AND l.var_a = r.var_b)
    SELECT city, var_a AS variable, MIN(var_b) AS "group" FROM reach GROUP BY 1, 2""")
def _(i: Inputs):
    return T.collinear_groups(_matrix(i), ["city"], HOURLY_VARS, 0.3)


LAGS = [72, 48, 24]


def countdown_sql() -> str:
    leads = ", ".join(
        f"LEAD(temperature_2m, {k}) OVER (PARTITION BY city ORDER BY ts) - temperature_2m AS jump_{k}" for k in LAGS
    )
    cells = " UNION ALL ".join(
        f"SELECT city, '{v}' AS feature, {k} AS lag, {r('rho')} AS rho FROM ({pair_sql(v, f'jump_{k}', 'city', 'j')})"
        for v in HOURLY_VARS for k in LAGS
    )
    return f"WITH j AS (SELECT *, {leads} FROM hourly_gaps) {cells}"


@query("countdown_corr", countdown_sql())
def _(i: Inputs):
    return round_doubles(T.countdown_corr(i.hourly_gaps(), HOURLY, "temperature_2m", HOURLY_VARS, LAGS), "rho")


PROFILE_SQL = f"""
    WITH lags AS (SELECT CAST(unnest(range(1, 73)) AS INT) AS lag),
    p AS (SELECT h.city, lag, f.temperature_2m - h.temperature_2m AS jump, h.* EXCLUDE (city, ts)
          FROM hourly_gaps h, lags JOIN hourly_gaps f ON f.city = h.city AND f.ts = h.ts + to_hours(CAST(lag AS BIGINT))),
    tall AS (UNPIVOT (SELECT city, lag, jump, {VALUES} FROM p WHERE jump IS NOT NULL)
             ON {', '.join(f'"{v}"' for v in HOURLY_VARS)} INTO NAME feature VALUE x),
    k AS (SELECT city, feature, lag, {rank_sql('x', 'city, feature, lag')} AS a, {rank_sql('jump', 'city, feature, lag')} AS b
          FROM tall),
    profile AS (SELECT city, feature, lag, COUNT(*) AS n, {nan_null('corr(a, b)')} AS rho FROM k GROUP BY 1, 2, 3)
    """


def _profile(i: Inputs):
    return T.lag_profile(i.hourly_gaps(), HOURLY, "temperature_2m", HOURLY_VARS, 72)


@query("lag_profile", PROFILE_SQL + f"SELECT city, feature, lag, {r('rho')} AS rho FROM profile")
def _(i: Inputs):
    return round_doubles(_profile(i), "rho")


POINTS = [72, 48, 24, 12, 1]


@query("lag_checkpoints", PROFILE_SQL + f""",
    w AS (SELECT city, feature, {', '.join(f'MAX(rho) FILTER (lag = {p}) AS lag_{p}' for p in POINTS)} FROM profile GROUP BY 1, 2)
    SELECT city, feature, {', '.join(r(f'lag_{p}') + f' AS lag_{p}' for p in POINTS)},
           CAST(ROW_NUMBER() OVER (PARTITION BY city ORDER BY round(abs(lag_72), 9) DESC NULLS LAST, feature) AS INT) AS rank
    FROM w""")
def _(i: Inputs):
    return round_doubles(T.lag_checkpoints(_profile(i), ["city"], POINTS), *[f"lag_{p}" for p in POINTS])


OTHERS = [v for v in HOURLY_VARS if v != "temperature_2m"]


def pre_event_sql() -> str:
    pair = "CASE WHEN temperature_2m IS NOT NULL AND \"{0}\" IS NOT NULL THEN 1 END"
    frame = "OVER (PARTITION BY city, start_date ORDER BY ts ROWS BETWEEN 23 PRECEDING AND CURRENT ROW)"
    columns = ", ".join(
        f"""CASE WHEN COUNT({pair.format(o)}) {frame} >= 12 AND NOT isnan(corr(temperature_2m, CAST("{o}" AS DOUBLE)) {frame})
            THEN corr(temperature_2m, CAST("{o}" AS DOUBLE)) {frame} END AS "{o}" """
        for o in OTHERS
    )
    return EVENT_WINDOW_SQL + f""",
    rolled AS (SELECT city, offset_h, COUNT(*) OVER (PARTITION BY city, start_date) AS n_rows, {columns} FROM win),
    tall AS (UNPIVOT (SELECT * EXCLUDE (n_rows) FROM rolled WHERE n_rows >= 12)
             ON {', '.join(f'"{o}"' for o in OTHERS)} INTO NAME variable VALUE c),
    every AS (SELECT city, variable, CAST(unnest(range(-72, 0)) AS INT) AS offset_h FROM (
              SELECT DISTINCT city, unnest([{', '.join(f"'{o}'" for o in OTHERS)}]) AS variable FROM ev)),
    profile AS (SELECT e.city, e.variable, e.offset_h AS "offset", COUNT(c) AS n_events, quantile_cont(c, 0.5) AS m
                FROM every e LEFT JOIN tall t ON t.city = e.city AND t.variable = e.variable AND t.offset_h = e.offset_h
                GROUP BY 1, 2, 3)
    SELECT city, variable, "offset", n_events, {r('m')} AS median_corr FROM profile"""


def _pre_event(i: Inputs):
    hourly = i.hourly_obs()
    events = P.hourly_events(hourly, HOURLY, "temperature_2m", 0.5, 2)
    return P.pre_event_profile(events, hourly, HOURLY, "temperature_2m", OTHERS)


@query("pre_event_profile", pre_event_sql())
def _(i: Inputs):
    return round_doubles(_pre_event(i), "median_corr")


def minor_sum(rows: list[list[str]]) -> str:
    """SQL determinant, written out."""
    if len(rows) == 1:
        return rows[0][0]
    parts = [f"{'-' if j % 2 else '+'} {cell} * ({minor_sum([x[:j] + x[j + 1:] for x in rows[1:]])})" for j, cell in enumerate(rows[0])]
    return " ".join(parts).removeprefix("+ ")


def cubic_sql() -> str:
    """Least squares on hours scaled to one unit, by power sums."""
    matrix = [[f"s{a + b}" for b in range(4)] for a in range(4)]
    det = minor_sum(matrix)
    coefficients = [
        f"({minor_sum([row[:j] + [f't{n}'] + row[j + 1:] for n, row in enumerate(matrix)])}) / ({det}) AS c{j}" for j in range(4)
    ]
    powers = ", ".join(f"SUM(pow(z, {n})) AS s{n}" for n in range(7))
    moments = ", ".join(f"SUM(pow(z, {n}) * m) AS t{n}" for n in range(4))
    return pre_event_sql().rsplit("SELECT city, variable, \"offset\", n_events", 1)[0] + f""",
    known AS (SELECT *, CASE WHEN m IS NOT NULL THEN abs("offset") END AS h FROM profile),
    scaled AS (SELECT *, CAST(abs("offset") AS INT) AS hours_before, (abs("offset") - AVG(h) OVER w)
                         / greatest(MAX(h) OVER w - MIN(h) OVER w, 1e-9) AS z
               FROM known WINDOW w AS (PARTITION BY city, variable)),
    sums AS (SELECT city, variable, {powers}, {moments} FROM scaled WHERE m IS NOT NULL GROUP BY 1, 2 HAVING COUNT(*) > 3),
    fit AS (SELECT city, variable, {', '.join(coefficients)} FROM sums)
    SELECT s.city, s.variable, "offset", n_events, {r('m')} AS median_corr, hours_before,
           {r('c0 + z * (c1 + z * (c2 + z * c3))')} AS fitted
    FROM scaled s LEFT JOIN fit f ON f.city = s.city AND f.variable = s.variable"""


@query("pre_event_smooth", cubic_sql())
def _(i: Inputs):
    return round_doubles(P.smooth_profile(_pre_event(i), ["city"]), "median_corr", "fitted")


QQ_SQL = f"""
    WITH tall AS (UNPIVOT (SELECT city, {VALUES} FROM hourly_obs) ON {', '.join(f'"{v}"' for v in HOURLY_VARS)}
                  INTO NAME variable VALUE value),
    o AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY city, variable ORDER BY value) AS ordinal,
                 COUNT(*) OVER (PARTITION BY city, variable) AS n FROM tall)
    """


@query("qq_positions", QQ_SQL + f"""
    SELECT city, variable, value, ordinal, n, {r('''CASE WHEN ordinal = n THEN pow(0.5, 1.0 / n)
        WHEN ordinal = 1 THEN 1 - pow(0.5, 1.0 / n) ELSE (ordinal - 0.3175) / (n + 0.365) END''')} AS probability FROM o""")
def _(i: Inputs):
    placed = T.ordinal_positions(i.hourly_obs(), HOURLY, HOURLY_VARS)
    return placed.withColumn("probability", rd(T.plotting_position(F.col("ordinal"), F.col("n"))))


def horner(x: str, coefficients: list[float]) -> str:
    text = repr(coefficients[-1])
    for c in reversed(coefficients[:-1]):
        text = f"({text}) * {x} + {c!r}"
    return f"({text})"


def fraction(x: str, num: list[float], den: list[float]) -> str:
    return f"{horner(x, [float(c) for c in num])} / {horner(x, [float(c) for c in den])}"


QQ_POINTS_SQL = QQ_SQL + f""",
    p AS (SELECT *, CASE WHEN ordinal = n THEN pow(0.5, 1.0 / n) WHEN ordinal = 1 THEN 1 - pow(0.5, 1.0 / n)
                    ELSE (ordinal - 0.3175) / (n + 0.365) END AS p FROM o),
    q AS (SELECT *, p - 0.5 AS q, 0.180625e0 - (p - 0.5) * (p - 0.5) AS c, sqrt(-ln(least(p, 1 - p))) AS t FROM p),
    z AS (SELECT city, variable, value, ordinal, n, CASE
              WHEN abs(q) <= 0.425 THEN q * {fraction('c', A.AS241_CENTRE_NUM, A.AS241_CENTRE_DEN)}
              WHEN t <= 5 THEN sign(q) * {fraction('(t - 1.6e0)', A.AS241_MIDDLE_NUM, A.AS241_MIDDLE_DEN)}
              ELSE sign(q) * {fraction('(t - 5e0)', A.AS241_TAIL_NUM, A.AS241_TAIL_DEN)} END AS theoretical FROM q)
    """


@query("qq_normal", QQ_POINTS_SQL + f"SELECT city, variable, value, ordinal, n, {r('theoretical')} AS theoretical FROM z")
def _(i: Inputs):
    return round_doubles(T.qq_normal(i.hourly_obs(), HOURLY, HOURLY_VARS), "theoretical")


@query("qq_fit", QQ_POINTS_SQL + f"""
    SELECT city, variable, COUNT(*) AS n, {r('regr_slope(value, theoretical)')} AS slope,
           {r('regr_intercept(value, theoretical)')} AS intercept, {r('corr(theoretical, value)')} AS r FROM z GROUP BY 1, 2""")
def _(i: Inputs):
    points = T.qq_normal(i.hourly_obs(), HOURLY, HOURLY_VARS)
    return round_doubles(T.qq_fit(points, ["city", "variable"]), "slope", "intercept", "r")


@query("stability_by_error_class", f"""
    WITH h AS (SELECT *, pressure_msl - LAG(pressure_msl, 24) OVER (PARTITION BY city ORDER BY ts) AS delta FROM hourly_obs),
    c AS (SELECT *, CASE WHEN pressure_msl >= 50 THEN 1 WHEN pressure_msl < 50 THEN 0 END AS truth,
                 relative_humidity_2m / 100.0 AS prob FROM h)
    SELECT error_class, COUNT(*) AS n, {r('stddev_samp("v_850hPa")')} AS spread_std, {r('AVG(abs(delta))')} AS mean_abs_change
    FROM (SELECT *, CASE WHEN truth = 0 AND prob > 0.8 THEN 'confident_FP' WHEN truth = 1 AND prob >= 0.5 THEN 'TP'
                         WHEN truth = 1 AND prob < 0.5 THEN 'FN' WHEN truth = 0 AND prob >= 0.5 THEN 'FP'
                         WHEN truth = 0 AND prob < 0.5 THEN 'TN' END AS error_class FROM c)
    GROUP BY 1""")
def _(i: Inputs):
    from heatframe.operators.series import changes

    moved = changes(i.hourly_obs(), HOURLY, {"delta": ("pressure_msl", 24)})
    prob = F.col("relative_humidity_2m") / 100.0
    truth = (F.col("pressure_msl") >= 50).cast("int")
    classes = V.error_class(truth, (prob >= 0.5).cast("int"), prob, 0.8)
    return round_doubles(V.stability(moved, classes, "v_850hPa", "delta"), "spread_std", "mean_abs_change")
