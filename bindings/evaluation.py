"""Evaluation queries on a deterministic score."""

from __future__ import annotations

from pyspark.sql import functions as F

from bindings.inputs import HOURLY_VARS, Inputs
from bindings.registry import query
from bindings.text import r, rd, round_doubles
from heatframe.operators import evaluate as V
from heatframe.operators.model import hash_split, time_split

CELLS = """
    WITH c AS (SELECT {key}COUNT(*) FILTER (y = 1 AND pred = 1) AS tp, COUNT(*) FILTER (y = 0 AND pred = 1) AS fp,
               COUNT(*) FILTER (y = 0 AND pred = 0) AS tn, COUNT(*) FILTER (y = 1 AND pred = 0) AS fn
               FROM scored {group})
    """


def div(a: str, b: str) -> str:
    return f"CASE WHEN ({b}) = 0 THEN 0 ELSE ({a}) * 1.0 / ({b}) END"


@query("error_class", """
    SELECT doc_id, CASE WHEN y = 0 AND prob > 0.55 THEN 'confident_FP' WHEN y = 1 AND pred = 1 THEN 'TP'
           WHEN y = 1 THEN 'FN' WHEN pred = 1 THEN 'FP' ELSE 'TN' END AS error_class FROM scored""")
def _(i: Inputs):
    classes = V.error_class(F.col("y"), F.col("pred"), F.col("prob"), 0.55)
    return i.scored().select("doc_id", classes.alias("error_class"))


@query("class_balance", f"""
    SELECT city, COUNT(*) AS n, CAST(SUM(y) AS BIGINT) AS positives, {r('AVG(y)')} AS share,
           {r('SUM(1 - y) * 1.0 / nullif(SUM(y), 0)')} AS neg_pos_ratio FROM scored GROUP BY city""")
def _(i: Inputs):
    return round_doubles(V.class_balance(i.scored(), ["city"], "y"), "share", "neg_pos_ratio")


@query("confusion_matrix", CELLS.format(key="city, ", group="GROUP BY city") + f"""
    SELECT city, truth, pred, n, {r(div('n', 'total'))} AS row_share FROM (
        SELECT city, 0 AS truth, 0 AS pred, tn AS n, tn + fp AS total FROM c
        UNION ALL SELECT city, 0, 1, fp, tn + fp FROM c UNION ALL SELECT city, 1, 0, fn, tp + fn FROM c
        UNION ALL SELECT city, 1, 1, tp, tp + fn FROM c)""")
def _(i: Inputs):
    return round_doubles(V.confusion_matrix(i.scored(), ["city"], "y", "pred"), "row_share")


def report_sql(key: str, digits: int = 6, only: tuple = ()) -> str:
    lead = f"{key}, " if key else ""
    p0, r0, p1, r1 = div("tn", "tn + fn"), div("tn", "tn + fp"), div("tp", "tp + fp"), div("tp", "tp + fn")
    f0, f1, acc = div("2 * tn", "2 * tn + fn + fp"), div("2 * tp", "2 * tp + fp + fn"), div("tp + tn", "tp + tn + fp + fn")
    n0, n1, n = "(tn + fp)", "(tp + fn)", "(tp + tn + fp + fn)"
    lines = [("0", p0, r0, f0, n0), ("1", p1, r1, f1, n1), ("accuracy", acc, acc, acc, n)]
    lines.append(("macro avg", *[f"(({a}) + ({b})) / 2" for a, b in ((p0, p1), (r0, r1), (f0, f1))], n))
    lines.append(("weighted avg", *[div(f"({a}) * {n0} + ({b}) * {n1}", n) for a, b in ((p0, p1), (r0, r1), (f0, f1))], n))
    return CELLS.format(key=lead, group=f"GROUP BY {key}" if key else "") + " UNION ALL ".join(
        f"SELECT {lead}'{name}' AS label, {r(p, digits)} AS precision, {r(rec, digits)} AS recall, {r(f, digits)} AS f1, {size} AS support FROM c"
        for name, p, rec, f, size in lines if not only or name in only
    )


@query("classification_report", report_sql(""))
def _(i: Inputs):
    return round_doubles(V.classification_report(i.scored(), [], "y", "pred"), "precision", "recall", "f1")


@query("report_by_entity", report_sql("city", 2, ("1",)))
def _(i: Inputs):
    out = V.report_by_entity(i.scored(), "city", "y", "pred", digits=9)
    return out.select("city", F.lit("1").alias("label"), *[rd(m, 2).alias(m) for m in ("precision", "recall", "f1")], "support")


RANKED = """
    WITH k AS (SELECT *, RANK() OVER (PARTITION BY city ORDER BY prob) + (COUNT(*) OVER (PARTITION BY city, prob) - 1) / 2.0 AS rk
               FROM scored)
    """


@query("roc_auc", RANKED + f"""
    SELECT city, {r('''(SUM(rk) FILTER (y = 1) - SUM(y) * (SUM(y) + 1) / 2.0) / nullif(SUM(y) * SUM(1 - y), 0)''')} AS roc_auc
    FROM k GROUP BY city""")
def _(i: Inputs):
    return round_doubles(V.roc_auc(i.scored(), ["city"], "y", "prob"), "roc_auc")


def ap_sql(score: str) -> str:
    return f"""SELECT city, SUM(pos * 1.0 / total * cum_pos / cum_n) AS ap FROM (
        SELECT city, pos, SUM(pos) OVER (PARTITION BY city) AS total, SUM(pos) OVER w AS cum_pos, SUM(n) OVER w AS cum_n
        FROM (SELECT city, {score} AS s, SUM(y) AS pos, COUNT(*) AS n FROM scored GROUP BY 1, 2)
        WINDOW w AS (PARTITION BY city ORDER BY s DESC)) GROUP BY city"""


@query("average_precision", f"SELECT city, {r('ap')} AS average_precision FROM ({ap_sql('prob')})")
def _(i: Inputs):
    return round_doubles(V.average_precision(i.scored(), ["city"], "y", "prob"), "average_precision")


@query("skill_ratio", f"""
    SELECT m.city, {r('m.ap')} AS model_ap, {r('b.ap')} AS baseline_ap, {r('m.ap / b.ap')} AS skill
    FROM ({ap_sql('prob')}) m JOIN ({ap_sql('toxic')}) b ON b.city = m.city""")
def _(i: Inputs):
    out = V.skill_ratio(i.scored(), ["city"], "y", "prob", "toxic")
    return round_doubles(out, "model_ap", "baseline_ap", "skill")


@query("regression_metrics", f"""
    WITH p AS (SELECT l_suppkey AS station_id, l_extendedprice AS truth, l_quantity * 2100.0 AS pred FROM lineitem)
    SELECT station_id, COUNT(*) AS n, {r('AVG(abs(truth - pred))', 4)} AS mae,
           {r('1 - SUM((truth - pred) * (truth - pred)) / (var_pop(truth) * COUNT(*))')} AS r2 FROM p GROUP BY 1""")
def _(i: Inputs):
    rows = i.table("lineitem").select(
        F.col("l_suppkey").alias("station_id"), F.col("l_extendedprice").alias("truth"),
        (F.col("l_quantity") * 2100.0).alias("pred"),
    )
    out = V.regression_metrics(rows, ["station_id"], "truth", "pred")
    return out.select("station_id", "n", rd("mae", 4).alias("mae"), rd("r2").alias("r2"))


@query("confident_fp", f"""
    WITH w AS (SELECT city, n_chars FROM scored WHERE y = 0 AND prob > 0.4)
    SELECT coalesce(city, 'total') AS city, COUNT(*) AS n, {r('COUNT(*) * 100.0 / (SELECT COUNT(*) FROM w)')} AS share_pct,
           {r('AVG(n_chars)')} AS mean_value FROM w GROUP BY ROLLUP (city)""")
def _(i: Inputs):
    return round_doubles(V.confident_false_alarms(i.scored(), "city", "y", "prob", "n_chars", 0.4), "share_pct", "mean_value")


@query("fp_tn_diff", f"""
    WITH m AS (SELECT 'n_chars' AS feature, AVG(n_chars) FILTER (y = 0 AND pred = 1) AS a, AVG(n_chars) FILTER (y = 0 AND pred = 0) AS b FROM scored
         UNION ALL SELECT 'toxic', AVG(toxic) FILTER (y = 0 AND pred = 1), AVG(toxic) FILTER (y = 0 AND pred = 0) FROM scored
         UNION ALL SELECT 'prob', AVG(prob) FILTER (y = 0 AND pred = 1), AVG(prob) FILTER (y = 0 AND pred = 0) FROM scored)
    SELECT feature, {r('a')} AS mean_a, {r('b')} AS mean_b, {r('a - b')} AS difference,
           CAST(ROW_NUMBER() OVER (ORDER BY round(abs(a - b), 9) DESC NULLS LAST, feature) AS INT) AS rank FROM m""")
def _(i: Inputs):
    classes = V.error_class(F.col("y"), F.col("pred"))
    out = V.class_means(i.scored(), ["n_chars", "toxic", "prob"], classes, "FP", "TN")
    return round_doubles(out, "mean_a", "mean_b", "difference")


@query("hash_split", """
    SELECT o_orderkey, CAST('0x' || substr(md5(CAST(o_orderkey AS VARCHAR)), 1, 8) AS BIGINT) % 100 < 80 AS is_train FROM orders""")
def _(i: Inputs):
    return hash_split(i.table("orders").select("o_orderkey"), "o_orderkey")


@query("time_split", """
    SELECT o_orderkey, o_orderdate < TIMESTAMP '1999-01-01 00:00:00' AS is_train FROM orders""")
def _(i: Inputs):
    return time_split(i.table("orders").select("o_orderkey", "o_orderdate"), "o_orderdate", "1999-01-01").drop("o_orderdate")


TALL_SQL = f"""
    WITH tall AS (SELECT feature, value, round(value - 7 * floor(value / 7) - 3, 6) AS score
         FROM (UNPIVOT (SELECT city, ts, {', '.join(f'CAST("{v}" AS DOUBLE) AS "{v}"' for v in HOURLY_VARS)} FROM hourly_obs)
               ON {', '.join(f'"{v}"' for v in HOURLY_VARS)} INTO NAME feature VALUE value)),
    imp AS (SELECT feature, AVG(abs(score)) AS importance, AVG(score) AS direction, AVG(value) AS m, stddev_samp(value) AS s
            FROM tall GROUP BY feature),
    nxt AS (SELECT *, LEAD(sign(score)) OVER (PARTITION BY feature ORDER BY value, sign(score)) AS following FROM tall),
    thr AS (SELECT feature, MIN(value) FILTER (sign(score) <> following) AS threshold FROM nxt GROUP BY feature),
    ranked AS (SELECT *, CAST(ROW_NUMBER() OVER (ORDER BY round(importance, 9) DESC, feature) AS INT) AS rank FROM imp)
    """


def _tall(i: Inputs):
    rows = V.attribution_rows(i.hourly_obs(), ["city", "ts"], HOURLY_VARS)
    value = F.col("value")
    return rows.withColumn("score", F.round(value - 7 * F.floor(value / 7) - 3, 6))


@query("sign_change_threshold", TALL_SQL + f"SELECT feature, {r('threshold')} AS threshold FROM thr")
def _(i: Inputs):
    return round_doubles(V.sign_change(_tall(i), ["feature"], "value", "score"), "threshold")


@query("contribution_pct", TALL_SQL + f"""
    SELECT feature, {r('importance')} AS importance, {r('importance * 100 / SUM(importance) OVER ()')} AS contribution_pct FROM imp""")
def _(i: Inputs):
    out = V.contribution_pct(V.attribution_importance(_tall(i)).drop("direction"))
    return round_doubles(out, "importance", "contribution_pct")


@query("top_features", TALL_SQL + f"SELECT feature, {r('importance')} AS importance, rank FROM ranked WHERE rank <= 5")
def _(i: Inputs):
    return round_doubles(V.top_features(V.attribution_importance(_tall(i)).drop("direction"), 5), "importance")


@query("attribution_table", TALL_SQL + f"""
    SELECT feature, {r('importance', 4)} AS importance, {r('direction', 4)} AS direction, rank, {r('threshold', 3)} AS threshold,
           {r('m', 3)} AS feature_mean, {r('s', 3)} AS feature_std,
           CASE WHEN direction > 0 THEN '{V.RAISES}' ELSE '{V.LOWERS}' END AS effect
    FROM ranked JOIN thr USING (feature) WHERE rank <= 20""")
def _(i: Inputs):
    out = V.attribution_table(_tall(i), 20)
    digits = {"importance": 4, "direction": 4, "threshold": 3, "feature_mean": 3, "feature_std": 3}
    return out.withColumns({c: rd(c, d) for c, d in digits.items()})
