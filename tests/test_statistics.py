"""Order statistics, correlation, trends and metrics against brute force."""

import math
import re
from statistics import NormalDist

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from heatframe.functions.statistics import normal_quantile, student_t_two_sided
from heatframe.operators import climate as C
from heatframe.operators import evaluate as V
from heatframe.operators import ordered as O
from heatframe.operators import stats as T
from heatframe.operators.series import Series


def frame(spark, pdf, schema):
    return spark.createDataFrame(pdf, schema)


def skewed(seed, n=3000):
    """One key holds most rows and one value a third of them; scales from 1e-6 to 1e6."""
    rng = np.random.default_rng(seed)
    keys = np.where(rng.random(n) < 0.7, "hot", rng.choice(list("abc"), n))
    values = rng.choice([-1.0, 1.0], n) * 10.0 ** rng.uniform(-6, 6, n)
    values[rng.random(n) < 0.33] = 0.0
    return pd.DataFrame({"k": keys, "v": np.round(values, 7)})


def test_bins_do_not_decrease(spark):
    v = np.sort(skewed(5)["v"].to_numpy())
    edge = np.array([2.0**e * f for e in range(-20, 20) for f in (1 - 2**-52, 1.0, 1 + 2**-52)])
    both = np.sort(np.concatenate([v, edge, -edge]))
    df = O.with_bins(frame(spark, pd.DataFrame({"v": both}), "v double"), "v")
    for name in O.BINS:
        bins = df.toPandas().sort_values("v", kind="stable")[name].to_numpy()
        assert (np.diff(bins) >= 0).all() and len(set(bins)) > 1000
    odd = spark.createDataFrame([(None,), (float("inf"),), (-float("inf"),), (0.0,), (-0.0,)], "v double")
    assert len(O.with_bins(odd, "v").select(*O.BINS).distinct().collect()) == 3


def test_fine_bins_stay_small(spark):
    """Times of a month, probabilities near 1 and pressures share most of their leading bits."""
    ids = spark.range(200_000)
    for value in (1.7e9 + F.rand(1) * 30 * 86400, 0.99 + F.rand(2) * 0.01, 980 + F.rand(3) * 60):
        counts = O.with_bins(ids.select(value.alias("v")), "v").groupBy(*O.BINS).count()
        assert counts.agg(F.max("count")).first()[0] < 2000


def test_constant_columns_have_no_correlation(spark):
    df = spark.range(1_100_000).select(
        F.lit("a").alias("k"), "id", F.lit(0.1).alias("c"), (F.col("id") % 1000).cast("double").alias("v"),
        F.when(F.col("id") % 3 != 0, F.rand(5)).alias("gaps"),
    )
    got = {(r["var_a"], r["var_b"]): r["rho"] for r in T.spearman_matrix(df, ["k"], ["id"], ["c", "v", "gaps"]).collect()}
    assert [got["c", x] for x in ("c", "v", "gaps")] == [None] * 3
    assert got["v", "v"] == pytest.approx(1.0) and got["gaps", "gaps"] == pytest.approx(1.0) and abs(got["v", "gaps"]) < 0.01
    by = T.spearman_by(df, ["k"], "c", "v").first()
    assert (by["n"], by["rho"]) == (1_100_000, None)


def test_pairs_are_complete_pair_by_pair(spark):
    rng = np.random.default_rng(9)
    pdf = pd.DataFrame(rng.integers(0, 12, (300, 3)).astype(float), columns=list("abc"))
    for n, c in enumerate("abc"):
        pdf.loc[rng.random(300) < 0.2 * (n + 1), c] = np.nan
    rows = [("k", i, *(None if np.isnan(v) else v for v in r)) for i, r in enumerate(pdf.itertuples(index=False))]
    df = spark.createDataFrame(rows, "k string, i int, a double, b double, c double")
    want = pdf.corr("spearman")
    got = T.spearman_matrix(df, ["k"], ["i"], ["a", "b", "c"]).collect()
    assert len(got) == 6
    assert all(r["rho"] == pytest.approx(want.loc[r["var_a"], r["var_b"]], abs=1e-12) for r in got)


def test_missing_sides_are_left_out(spark):
    rows = [(1, 0.9), (1, 0.6), (0, 0.7), (0, 0.2), (None, 0.1), (1, None), (0, None)]
    df = spark.createDataFrame([("a", t, s, int(s > 0.5) if s is not None else None) for t, s in rows], "k string, t int, s double, p int")
    assert V.roc_auc(df, ["k"], "t", "s").first()["roc_auc"] == 0.75
    cells = V.cell_counts(df, ["k"], "t", "p").first()
    assert (cells["tp"], cells["fp"], cells["tn"], cells["fn"]) == (2, 1, 1, 0)
    found = [r[0] for r in df.select(V.error_class(F.col("t"), F.col("p"))).collect()]
    assert found == ["TP", "TP", "FP", "TN", None, None, None]
    r = V.regression_metrics(df.withColumn("y", F.col("t") * 2.0), ["k"], "y", "s").first()
    assert r["n"] == 4 and r["mae"] == pytest.approx((1.1 + 1.4 + 0.7 + 0.2) / 4)


def test_station_without_agreement(spark):
    from heatframe.operators.joins import match_station

    left = spark.createDataFrame([("d1", "s2", 1.0), ("d1", "s1", 1.0), ("d2", "s1", 5.0)], "d string, s string, v double")
    right = spark.createDataFrame([("d1", "g", 1.0), ("d1", "h", 2.0)], "d string, g string, w double")
    got = sorted(tuple(r) for r in match_station(left, right, "s", "g", "d", "v", "w").collect())
    assert got == [("g", "s1", 1, 2), ("h", None, 0, 2)]


def test_small_tails_are_direct(spark):
    df = spark.createDataFrame([(40.0, 100), (2.0, 1), (0.5, 1_000_000), (3.0, 2_000_000_000), (0.0, 4)], "t double, n long")
    got = [r[0] for r in df.select(student_t_two_sided(F.col("t"), F.col("n"))).collect()]
    want = [1.1164e-63, 1 - 2 / math.pi * math.atan(2.0), 0.6170751, 0.0026998, 1.0]
    assert got[0] == pytest.approx(want[0], rel=1e-2)
    assert got[1:] == pytest.approx(want[1:], rel=1e-4)


@pytest.mark.parametrize("seed", range(3))
def test_quantiles_equal_pandas(spark, seed):
    pdf = skewed(seed)
    probs = {"q0": 0.0, "q1": 0.1, "q5": 0.5, "q9": 0.9, "q95": 0.95, "q100": 1.0}
    got = O.quantiles(frame(spark, pdf, "k string, v double"), ["k"], "v", probs).toPandas().set_index("k")
    for name, p in probs.items():
        want = pdf.groupby("k")["v"].quantile(p)
        np.testing.assert_allclose(got[name].reindex(want.index), want, rtol=1e-12, atol=1e-12)


def test_quantile_of_one_value_and_of_none(spark):
    df = spark.createDataFrame([("a", 3.0), ("a", None), ("b", None)], "k string, v double")
    assert [tuple(r) for r in O.quantiles(df, ["k"], "v", {"m": 0.5}).collect()] == [("a", 3.0)]


def test_approximate_quantile_is_close(spark):
    pdf = skewed(1)
    got = O.quantiles(frame(spark, pdf, "k string, v double"), ["k"], "v", {"m": 0.9}, approx=True).toPandas()
    exact = pdf.groupby("k")["v"].quantile(0.9)
    assert got.set_index("k")["m"].sub(exact).abs().max() < 0.2 * exact.abs().max()


def test_average_ranks(spark):
    pdf = skewed(2)
    ranks = O.average_ranks(frame(spark, pdf, "k string, v double"), ["k"], "v").toPandas()
    merged = pdf.assign(want=pdf.groupby("k")["v"].rank()).merge(ranks, on=["k", "v"])
    assert len(merged) == len(pdf)
    np.testing.assert_allclose(merged["rank"].astype(float), merged["want"])


def test_tied_ranks(spark):
    df = spark.createDataFrame([("a", v) for v in (1.0, 2.0, 2.0, 4.0)], "k string, v double")
    got = {r["v"]: float(r["rank"]) for r in O.average_ranks(df, ["k"], "v").collect()}
    assert got == {1.0: 1.0, 2.0: 2.5, 4.0: 4.0}


def spearman(pdf, x, y):
    both = pdf[[x, y]].dropna()
    return both[x].rank().corr(both[y].rank())


def test_spearman_by_equals_ranked_pearson(spark):
    rng = np.random.default_rng(0)
    pdf = pd.DataFrame({"k": rng.choice(["a", "b"], 400), "x": rng.integers(0, 20, 400) * 1.0})
    pdf["y"] = pdf["x"] + rng.integers(0, 30, 400)
    pdf.loc[rng.integers(0, 400, 60), "y"] = np.nan
    df = frame(spark, pdf.astype(object).where(pdf.notna(), None), "k string, x double, y double")
    got = {r["k"]: r["rho"] for r in T.spearman_by(df, ["k"], "x", "y").collect()}
    for k, part in pdf.groupby("k"):
        assert got[k] == pytest.approx(spearman(part, "x", "y"), abs=1e-12)


def test_constant_side_gives_no_correlation(spark):
    df = spark.createDataFrame([("a", float(n), 1.0) for n in range(5)], "k string, x double, y double")
    assert T.spearman_by(df, ["k"], "x", "y").first()["rho"] is None


def test_published_trend(spark):
    # eight decades with rank correlation 0.9047619 have p = 0.0020083
    pairs = list(zip(range(1, 9), [1, 2, 4, 3, 5, 8, 6, 7]))
    order = sum((a - b) ** 2 for a, b in pairs)
    assert 1 - 6 * order / (8 * 63) == pytest.approx(0.9047619, abs=1e-6)
    df = spark.createDataFrame([("m", float(a), float(b)) for a, b in pairs], "k string, x double, y double")
    row = T.trend_test(df, ["k"], "x", "y").first()
    assert row["rho"] == pytest.approx(0.9047619, abs=1e-6)
    assert row["p_value"] == pytest.approx(0.0020083, abs=1e-6)


@pytest.mark.parametrize("df,t,want", [(1, 1.0, 0.5), (2, 4.302652729, 0.05), (5, 2.570581836, 0.05), (30, 2.042272456, 0.05), (101, 1.983731003, 0.05)])
def test_student_tail(spark, df, t, want):
    got = spark.range(1).select(student_t_two_sided(F.lit(t), F.lit(df))).first()[0]
    assert got == pytest.approx(want, abs=1e-7)


def test_normal_quantile(spark):
    p = [1e-12, 1e-5, 0.01, 0.075, 0.3, 0.5, 0.77, 0.95, 0.999, 1 - 1e-9]
    df = spark.createDataFrame([(x,) for x in p], "p double").select("p", normal_quantile(F.col("p")).alias("q"))
    for r in df.collect():
        assert r["q"] == pytest.approx(NormalDist().inv_cdf(r["p"]), rel=1e-9, abs=1e-12)


@pytest.mark.parametrize("degree", [2, 3])
def test_polynomial_trend(spark, degree):
    rng = np.random.default_rng(0)
    pdf = pd.DataFrame({"k": "a", "x": np.arange(1950, 2020), "y": rng.random(70)})
    got = C.poly_trend(frame(spark, pdf, "k string, x int, y double"), ["k"], "x", "y", degree).toPandas().sort_values("x")
    z = pdf["x"] - pdf["x"].mean()
    np.testing.assert_allclose(got["fitted"], np.polyval(np.polyfit(z, pdf["y"], degree), z), atol=1e-8)


def test_trend_of_two_points_is_missing(spark):
    df = spark.createDataFrame([("a", 1, 1.0), ("a", 2, 2.0)], "k string, x int, y double")
    assert [r["fitted"] for r in C.poly_trend(df, ["k"], "x", "y", 2).collect()] == [None, None]


def test_single_row_std_is_missing(spark):
    df = spark.createDataFrame([("a", 1.0)], "k string, v double")
    assert C.describe(df, ["k"], ["v"]).first()["std"] is None


def test_histogram_closes_the_last_bin(spark):
    df = spark.createDataFrame([("a", float(v)) for v in range(11)], "k string, v double")
    got = {r["bin"]: r["n"] for r in C.histogram(df, ["k"], "v", 10).collect()}
    assert got == {**{b: 1 for b in range(9)}, 9: 2}


def test_histogram_of_a_constant(spark):
    df = spark.createDataFrame([("a", 2.0)] * 3, "k string, v double")
    assert sorted((r["bin"], r["n"]) for r in C.histogram(df, ["k"], "v").collect()) == [(0, 3)] + [(b, 0) for b in range(1, 30)]
    assert C.histogram(df.drop("k"), [], "v").agg(F.count("*"), F.sum("n")).first() == (30, 3)


def scores(seed=0, n=500):
    rng = np.random.default_rng(seed)
    y = rng.integers(0, 2, n)
    return pd.DataFrame({"k": "a", "y": y, "s": np.round(y * 0.2 + rng.random(n), 1)})


def test_auc_and_average_precision(spark):
    pdf = scores()
    df = frame(spark, pdf, "k string, y int, s double")
    pos, neg = pdf[pdf.y == 1].s.to_numpy(), pdf[pdf.y == 0].s.to_numpy()
    pairs = (pos[:, None] > neg).mean() + (pos[:, None] == neg).mean() / 2
    assert V.roc_auc(df, ["k"], "y", "s").first()["roc_auc"] == pytest.approx(pairs)
    ap, last = 0.0, 0.0
    for cut in sorted(pdf.s.unique(), reverse=True):
        hit = pdf[pdf.s >= cut]
        recall = hit.y.sum() / pdf.y.sum()
        ap += (recall - last) * hit.y.mean()
        last = recall
    assert V.average_precision(df, ["k"], "y", "s").first()["average_precision"] == pytest.approx(ap)


def test_zero_denominators(spark):
    df = spark.createDataFrame([("a", 1, 0), ("a", 1, 0)], "k string, y int, p int")
    report = {r["label"]: r for r in V.classification_report(df, ["k"], "y", "p").collect()}
    assert report["1"]["precision"] == 0.0 and report["1"]["support"] == 2 and report["accuracy"]["f1"] == 0.0
    cells = {(r["truth"], r["pred"]): r["n"] for r in V.confusion_matrix(df, ["k"], "y", "p").collect()}
    assert cells == {(0, 0): 0, (0, 1): 0, (1, 0): 2, (1, 1): 0}
    assert V.roc_auc(df, ["k"], "y", "p").first()["roc_auc"] is None


def test_sign_change(spark):
    rows = [("f", float(v), s) for v, s in ((1, -1.0), (2, -2.0), (2000, 1.0), (2001, -1.0))] + [("g", 1.0, 1.0), ("g", 9.0, 2.0)]
    df = spark.createDataFrame(rows, "feature string, value double, score double")
    got = {r["feature"]: r["threshold"] for r in V.sign_change(df, ["feature"], "value", "score").collect()}
    assert got == {"f": 2.0, "g": None}


def test_collinear_groups_follow_chains(spark):
    cells = [("x", "a", "b", 0.9), ("x", "b", "c", -0.8), ("x", "a", "c", 0.1), ("x", "d", "a", None), ("x", "d", "d", None)]
    cells += [("x", v, v, 1.0) for v in "abc"]
    df = spark.createDataFrame(cells, "k string, var_a string, var_b string, rho double")
    got = {r["variable"]: r["group"] for r in T.collinear_groups(df, ["k"], ["d", "c", "b", "a"], 0.7).collect()}
    assert got == {"a": "a", "b": "a", "c": "a", "d": "d"}


def test_lag_profile_uses_complete_pairs(spark):
    rng = np.random.default_rng(4)
    times = pd.date_range("2021-01-01", periods=60, freq="h")
    pdf = pd.DataFrame({"k": "a", "t": times, "v": rng.random(60).round(2), "w": rng.random(60).round(2)})
    series = Series(("k",), "t", "hour", dense=True)
    schema = "k string, t timestamp_ntz, v double, w double"

    def profile(p):
        rows = [
            (k, t.to_pydatetime(), v, None if np.isnan(w) else w) for k, t, v, w in p.itertuples(index=False)
        ]
        out = T.lag_profile(spark.createDataFrame(rows, schema), series, "v", ["v", "w"], 5)
        return {(r["feature"], r["lag"]): r["rho"] for r in out.collect()}

    def brute(p):
        return {
            (f, lag): spearman(p.assign(j=p["v"].shift(-lag) - p["v"]), f, "j") for f in "vw" for lag in range(1, 6)
        }

    for p in (pdf, pdf.assign(w=pdf["w"].where(pdf.index % 5 != 0))):
        got, want = profile(p), brute(p)
        assert got.keys() == want.keys()
        assert all(got[c] == pytest.approx(r, abs=1e-9) for c, r in want.items())


def test_lag_profile_moves_each_row_once_for_a_group_of_lags(spark):
    """Shuffles that carry a row for each lag and feature filled the disk (F1, F2); nulls, ties, a season and several
    entities give the same correlations."""
    rng = np.random.default_rng(8)
    times = pd.date_range("2021-01-01", periods=90, freq="h")
    frames = [pd.DataFrame({"k": k, "t": times, "v": rng.integers(0, 6, 90) / 2, "w": rng.integers(0, 4, 90) * 1.0,
                            "c": 1.0, "n": np.nan}) for k in "ab"]
    for p in frames:
        p.loc[rng.random(90) < 0.2, "v"], p.loc[rng.random(90) < 0.2, "w"] = np.nan, np.nan
    rows = [tuple(None if x != x else x for x in (k, t.to_pydatetime(), *x)) for p in frames for k, t, *x in p.itertuples(index=False)]
    df = spark.createDataFrame([*rows, (None, times[0].to_pydatetime(), 1.0, 1.0, 1.0, None)],
                               "k string, t timestamp_ntz, v double, w double, c double, n double")
    series, features = Series(("k",), "t", "hour", dense=True), ["v", "w", "c", "n"]
    out = T.lag_profile(df, series, "v", features, 15, F.hour("t") < 18)
    assert out._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1
    got = {(r["k"], r["feature"], r["lag"]): r["rho"] for r in out.collect()}
    want = {
        (p["k"][0], f, lag): None if f == "c" else spearman(p.assign(j=p["v"].shift(-lag) - p["v"])[p["t"].dt.hour < 18], f, "j")
        for p in frames for f in "vwc" for lag in range(1, 16)
    }
    assert got.keys() == want.keys()
    assert all(got[c] is None if r is None else got[c] == pytest.approx(r, abs=1e-9) for c, r in want.items())
    with pytest.raises(Exception, match="missing or repeated step"):
        T.lag_profile(df.where(F.hour("t") != 5), series, "v", features, 15).collect()


def test_matching_stations_are_neither_counted_first_nor_shuffled_to_their_best(spark):
    """Candidates were held in two more hash maps and sorted for the join with the best stations (F7)."""
    from heatframe.operators.joins import match_station, rejoin_best

    left = spark.createDataFrame(
        [(1, "p", 1.0), (1, "p", 1.0), (2, "p", None), (1, "q", 1.0), (2, "q", 3.0), (3, "r", -0.0), (None, "p", 1.0)],
        "d int, s string, v double")
    right = spark.createDataFrame([(1, "x", 1.0), (1, "x", 1.0), (2, "x", 3.0), (3, "y", 0.0), (2, "z", None)], "d int, g string, w double")
    best = match_station(left, right, "s", "g", "d", "v", "w")
    assert sorted(tuple(r) for r in best.collect()) == [("x", "p", 4, 8), ("y", "r", 1, 1), ("z", None, 0, 2)]
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = rejoin_best(left, right, best, "s", "g", "d")
        plan = out._jdf.queryExecution().executedPlan().toString()
        rows = sorted(tuple(r) for r in out.select("g", "s", "d").collect())
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert rows == [("x", "p", 1)] * 4 + [("x", "p", 2), ("y", "r", 3)]
    assert plan.count("BroadcastHashJoin") == 1
    assert not re.search(r"keys=\[d#\d+, s#\d+", plan)


def test_normal_plot_positions_with_a_frequent_value(spark):
    times = pd.date_range("2020-01-01", periods=2000, freq="h")
    values = np.where(np.arange(2000) % 3 == 0, 0.0, np.random.default_rng(0).normal(0, 2, 2000))
    df = frame(spark, pd.DataFrame({"k": "a", "t": times, "v": values}), "k string, t timestamp_ntz, v double")
    points = T.qq_normal(df, Series(("k",), "t", "hour"), ["v"])
    got = points.toPandas().sort_values("ordinal")
    assert got["ordinal"].tolist() == list(range(1, 2001))
    np.testing.assert_allclose(got["value"], np.sort(values))
    n = 2000
    m = [0.5 ** (1 / n) if i == n else 1 - 0.5 ** (1 / n) if i == 1 else (i - 0.3175) / (n + 0.365) for i in range(1, n + 1)]
    osm = np.array([NormalDist().inv_cdf(p) for p in m])
    slope, intercept = np.polyfit(osm, np.sort(values), 1)
    fit = T.qq_fit(points, ["k", "variable"]).first()
    assert fit["slope"] == pytest.approx(slope, abs=1e-9) and fit["intercept"] == pytest.approx(intercept, abs=1e-9)
    assert fit["r"] == pytest.approx(np.corrcoef(osm, np.sort(values))[0, 1], abs=1e-9)
    assert math.isfinite(fit["r"])
