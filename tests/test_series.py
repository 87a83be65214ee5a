"""Windows, runs and calendars against pandas and hand-made edge cases."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from heatframe.functions.scalar import hot, null_nan
from heatframe.functions.statistics import safe_corr
from heatframe.operators import series as S
from heatframe.operators.events import (
    daily_lookahead_label, detect_events, heatwave_tags, sustained_label, tag_spells,
)
from heatframe.operators.runs import label_runs
from heatframe.operators.windows import rolling_corr

DAY = S.Series(("k",), "d", "day")
HOUR = S.Series(("k",), "t", "hour", dense=True)


def daily(spark, values, start="2020-12-28", key="a", skip=()):
    first = dt.date.fromisoformat(start)
    rows = [(key, first + dt.timedelta(days=n), v) for n, v in enumerate(values) if n not in skip]
    return spark.createDataFrame(rows, "k string, d date, v double")


def hourly(spark, values, start="2021-01-30 00:00:00", key="a"):
    first = dt.datetime.fromisoformat(start)
    rows = [(key, first + dt.timedelta(hours=n), v) for n, v in enumerate(values)]
    return spark.createDataFrame(rows, "k string, t timestamp_ntz, v double")


def column(df, name, by):
    return [r[name] for r in df.orderBy(by).collect()]


def test_gap_rules(spark):
    # 5, NULL, 6 are all hot values; day 4 is absent
    df = daily(spark, [5.0, None, 6.0, 7.0, 0.0, 8.0], skip=(4,))
    lengths = {
        gap: sorted(r["days"] for r in detect_events(df, DAY, "v", 5.0, 1, gap).collect())
        for gap in ("rows", "null_breaks", "calendar")
    }
    assert lengths == {"rows": [4], "null_breaks": [1, 3], "calendar": [1, 1, 2]}


def test_unknown_gap_rule(spark):
    with pytest.raises(ValueError):
        tag_spells(daily(spark, [1.0]), DAY, "v", 1.0, "other")


def test_at_or_above_and_strictly_above(spark):
    df = daily(spark, [35.0, 35.0, 35.1])
    assert [r["days"] for r in detect_events(df, DAY, "v", 35.0, 1).collect()] == [3]
    assert [r["days"] for r in detect_events(df, DAY, "v", 35.0, 1, strict=True).collect()] == [1]


def test_missing_and_nan_are_not_hot(spark):
    df = spark.createDataFrame([(float("nan"),), (None,), (36.0,)], "v double")
    flags = [r[0] for r in df.select(hot(null_nan(F.col("v")), F.lit(35.0))).collect()]
    assert flags == [False, False, True]


@pytest.mark.parametrize("seed", range(4))
def test_runs_equal_pandas_across_chunks(spark, seed):
    rng = np.random.default_rng(seed)
    days = pd.date_range("2018-01-01", periods=1500)
    frames = []
    for key in "abc":
        # long stretches, so that runs cover several whole years
        flags = np.repeat(rng.random(60) < 0.5, rng.integers(1, 600, 60))[:1500]
        frames.append(pd.DataFrame({"k": key, "d": days[: len(flags)].date, "f": flags}).sample(frac=0.9, random_state=seed))
    pdf = pd.concat(frames)
    got = label_runs(spark.createDataFrame(pdf, "k string, d date, f boolean"), DAY, "f").toPandas()
    got = got.sort_values(["k", "d"]).reset_index(drop=True)
    want = pdf.sort_values(["k", "d"]).reset_index(drop=True)
    want["run_id"] = want.groupby("k")["f"].transform(lambda f: (f != f.shift()).cumsum())
    want["run_pos"] = want.groupby(["k", "run_id"]).cumcount() + 1
    want["run_len"] = want.groupby(["k", "run_id"])["f"].transform("size")
    for c in ("run_id", "run_pos", "run_len"):
        assert got[c].tolist() == want[c].tolist(), c


def test_run_over_many_whole_chunks(spark):
    got = label_runs(daily(spark, [1.0] * 1500).withColumn("f", F.lit(True)), DAY, "f")
    assert column(got, "run_pos", "d") == list(range(1, 1501))
    assert set(column(got, "run_len", "d")) == {1500}


def test_adding_a_constant_changes_no_event(spark):
    rng = np.random.default_rng(3)
    values = [float(v) for v in rng.integers(0, 40, 400)]
    base = detect_events(daily(spark, values), DAY, "v", 25.0, 2)
    moved = detect_events(daily(spark, [v + 100 for v in values]), DAY, "v", 125.0, 2)
    assert base.count() > 0
    assert base.exceptAll(moved).count() == 0 and moved.exceptAll(base).count() == 0


def test_spell_tags(spark):
    got = heatwave_tags(daily(spark, [9.0, 9.0, 9.0, 9.0, None, 9.0]), DAY, "v", 5.0, 3)
    assert column(got, "hot_spell_len", "d") == [1, 2, 3, 4, 0, 1]
    assert column(got, "heatwave_ge_3days", "d") == [False, False, True, True, False, False]
    assert column(got, "heatwave_gt_3days", "d") == [False, False, False, True, False, False]


@pytest.mark.parametrize("block", [1, 3, 7, 1000])
def test_blocks_equal_plain_window(spark, block):
    rng = np.random.default_rng(1)
    values = [None if rng.random() < 0.2 else float(v) for v in rng.integers(0, 9, 200)]
    df = daily(spark, values, skip=set(rng.integers(0, 200, 40).tolist()))
    got = S.over_rows(
        df, DAY, 4, 3,
        lambda w: {
            "m": S.gated(F.avg, F.col("v"), w.rowsBetween(-4, 0), 3), "g": F.lag("v", 4).over(w), "l": F.lead("v", 3).over(w),
            "x": F.max("v").over(w.rowsBetween(1, 3)),
        },
        block=block,
    ).toPandas().sort_values("d")
    v = pd.Series([r["v"] for r in df.orderBy("d").collect()], dtype=float)
    later = pd.concat([v.shift(-n) for n in (1, 2, 3)], axis=1).max(axis=1)
    for name, want in (("m", v.rolling(5, min_periods=3).mean()), ("g", v.shift(4)), ("l", v.shift(-3)), ("x", later)):
        np.testing.assert_allclose(got[name].to_numpy(dtype=float), want.to_numpy(), equal_nan=True, err_msg=name)


def test_min_periods_gate(spark):
    got = S.rolling(hourly(spark, [1.0, None, 3.0, 4.0]), HOUR, "v", 3, min_periods=2, name="m")
    assert column(got, "m", "t") == [None, None, 2.0, 3.5]


def label_by_pandas(flags, window, horizon):
    f = pd.Series(flags, dtype=float)
    k = f.rolling(window, min_periods=window).min()
    return k, k.shift(-horizon).rolling(horizon, min_periods=1).max()


def test_first_flags_are_invisible_to_the_label(spark):
    df = hourly(spark, [1.0] * 3 + [0.0] * 7).withColumn("is_hot", F.col("v") == 1)
    got = sustained_label(df, HOUR, 3, 3)
    assert column(got, "y", "t") == [0] * 9 + [None]


@pytest.mark.parametrize("seed", range(3))
def test_label_equals_pandas(spark, seed):
    rng = np.random.default_rng(seed)
    flags = np.repeat(rng.random(60) < 0.5, rng.integers(1, 40, 60))
    got = sustained_label(hourly(spark, [float(f) for f in flags]).withColumn("is_hot", F.col("v") == 1), HOUR, 24, 24)
    got = got.toPandas().sort_values("t")
    k, y = label_by_pandas(flags, 24, 24)
    assert y.sum() > 0
    np.testing.assert_allclose(got["sustained"].to_numpy(dtype=float), k.to_numpy(), equal_nan=True)
    np.testing.assert_allclose(got["y"].to_numpy(dtype=float), y.to_numpy(), equal_nan=True)


def test_strict_label_is_missing_where_the_horizon_is_cut(spark):
    df = hourly(spark, [1.0] * 10).withColumn("is_hot", F.lit(True))
    assert column(sustained_label(df, HOUR, 3, 3, censor="strict"), "y", "t") == [1] * 7 + [None] * 3


def test_daily_label(spark):
    got = daily_lookahead_label(daily(spark, [0.0, 0.0, 9.0, 9.0, 9.0, 0.0, 9.0]), DAY, "v", 5.0)
    assert column(got, "in_event", "d") == [0, 0, 1, 1, 1, 0, 0]
    assert column(got, "y", "d") == [1, 1, 1, 1, 0, 0, None]


def test_constant_window_has_no_correlation(spark):
    df = hourly(spark, [1.0, 2.0, 3.0, 4.0]).withColumn("w", F.lit(5.0))
    assert column(rolling_corr(df, HOUR, "v", ["w"], 3, 2), "corr_w", "t") == [None] * 4
    assert df.select(safe_corr(F.col("v"), F.col("w"))).first()[0] is None


def test_rolling_corr_equals_pandas(spark):
    rng = np.random.default_rng(0)
    pdf = pd.DataFrame({"v": rng.random(100), "w": rng.random(100)})
    pdf.loc[rng.integers(0, 100, 20), "w"] = np.nan
    df = hourly(spark, pdf["v"].tolist()).join(
        hourly(spark, [None if np.isnan(x) else x for x in pdf["w"]]).withColumnRenamed("v", "w"), ["k", "t"]
    )
    got = rolling_corr(df, HOUR, "v", ["w"], 24, 12).toPandas().sort_values("t")["corr_w"]
    both = pdf.where(pdf.notna().all(axis=1))
    want = both["v"].rolling(24, min_periods=12).corr(both["w"])
    np.testing.assert_allclose(got.to_numpy(dtype=float), want.to_numpy(), atol=1e-9, equal_nan=True)


def test_calendar_is_complete_and_has_the_leap_day(spark):
    df = daily(spark, [1.0] * 80, "2020-01-31", skip=set(range(1, 79)))
    days = column(S.densify(df, DAY), "d", "d")
    assert len(days) == 80 and dt.date(2020, 2, 29) in days
    assert spark.sql("SELECT dayofyear(date'2020-12-31')").first()[0] == 366


def test_hourly_calendar_crosses_months(spark):
    df = hourly(spark, [1.0, 2.0], "2021-01-31 22:00:00").union(hourly(spark, [3.0], "2021-02-02 01:00:00"))
    dense = S.densify(df, S.Series(("k",), "t", "hour"))
    assert dense.count() == 28 and dense.where("v IS NULL").count() == 25


def test_positions_count_rows_not_days(spark):
    df = daily(spark, [1.0] * 800, skip=set(range(100, 500)))
    assert column(S.with_position(df, DAY), "pos", "d") == list(range(1, 401))


def test_a_dense_series_with_a_gap_raises(spark):
    hours = [h for h in range(3000) if h not in (700, 1400, 2100)]
    df = spark.createDataFrame([("a", h) for h in hours], "k string, h int").select(
        "k", F.expr("timestamp_ntz'2020-01-01 00:00:00' + make_interval(0, 0, 0, 0, h)").alias("t"), F.col("h").cast("double").alias("v"))
    with pytest.raises(Exception, match="missing or repeated step"):
        S.lags(df, HOUR, {"x": ("v", 72)}).collect()
    whole = S.lags(S.densify(df, HOUR), HOUR, {"x": ("v", 72)}).where("v IS NOT NULL")
    got = {r["v"]: r["x"] for r in whole.collect()}
    assert got[772.0] is None and got[773.0] == 701.0 and len(got) == 2997


def test_threshold_basis_is_checked(spark):
    from heatframe.operators.events import event_threshold

    df = spark.createDataFrame([("a", "2020-01-01", 3.0)], "k string, t string, v double").withColumn(
        "t", F.col("t").cast("timestamp_ntz"))
    for wrong in ({"basis": "other"}, {}, {"basis": "seasonal_ref", "ref": ("2020-01-01", "2020-01-02")}):
        with pytest.raises(ValueError):
            event_threshold(df, HOUR, "v", 0.5, **wrong)
    with pytest.warns(UserWarning, match="reference period"):
        event_threshold(df, HOUR, "v", 0.5, ref=("2019-01-01", "2020-01-02"), test_from="2020-01-01")
    assert event_threshold(df, HOUR, "v", 31.5, "absolute").first()["threshold"] == 31.5
    with pytest.raises(ValueError):
        S.Series(("k",), "t", "minute")


def test_daily_label_on_a_series_with_gaps(spark):
    from heatframe.operators.events import daily_lookahead_label

    days = S.Series(("k",), "d", "day")
    hot = {1, 2, 3, 20, 21, 22}
    df = spark.createDataFrame([("a", n, 40.0 if n in hot else 1.0) for n in (*range(1, 10), *range(18, 25))], "k string, n int, v double")
    df = df.select("k", "n", F.expr("date_add(date'2020-01-01', n)").alias("d"), "v")
    got = {r["n"]: r["y"] for r in daily_lookahead_label(df, days, "v", 30.0).collect()}
    assert len(got) == 16 and got[9] == 0 and got[18] == 1 and got[24] is None
