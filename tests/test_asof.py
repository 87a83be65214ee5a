"""Carried values and as-of joins against plain loops, under chunks of any length."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from heatframe.operators.asof import asof_join, carry_forward
from heatframe.operators.series import Series

HOURS = Series(("city",), "ts", "hour")
START = dt.datetime(2023, 12, 28)
CHUNKS = {
    "calendar": None, "one": "0", "day": "unix_date(cast(ts as date))", "hour": "unix_date(cast(ts as date)) * 24 + hour(ts)",
}


def at(h):
    return None if h is None else START + dt.timedelta(hours=h)


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.mark.parametrize("tolerance", [None, 0, 5, 40])
def test_carried_values(spark, tolerance):
    rng = random.Random(tolerance)
    rows = [(c, at(h), rng.choice([None, None, h]), rng.choice([None, float(h)])) for c in ("a", "b", None) for h in sorted(rng.sample(range(400), 90))]
    want = []
    for c in ("a", "b", None):
        last = [None, None]
        for r in (r for r in rows if r[0] == c):
            out = []
            for k in (0, 1):
                if r[2 + k] is not None:
                    last[k] = (r[1], r[2 + k])
                near = last[k] and (tolerance is None or (r[1] - last[k][0]) <= dt.timedelta(hours=tolerance))
                out.append(last[k][1] if near else None)
            want.append((c, r[1], *out))
    df = spark.createDataFrame(rows, "city string, ts timestamp_ntz, x int, y double").repartition(3)
    for chunk in CHUNKS.values():
        got = carry_forward(df, HOURS, ["x", "y"], tolerance, None if chunk is None else F.expr(f"coalesce({chunk}, -1)"))
        assert got.columns == df.columns and rows_of(got) == sorted(want, key=repr)


@pytest.mark.parametrize("strict", [False, True])
@pytest.mark.parametrize("tolerance", [None, 3])
def test_asof_join(spark, strict, tolerance):
    rng = random.Random(strict + 2 * (tolerance or 0))
    left = [(rng.choice(["a", "b", "z"]), at(rng.choice([None, *range(300)])), k, "clash") for k in range(200)]
    left += [left[0], left[0]]
    right = [(c, at(h), h, rng.choice([None, 1])) for c in ("a", "b", "only") for h in rng.sample(range(300), 40)]
    right += [("a", right[0][1], right[0][2] + 1000, None), ("a", None, 5, 5)]
    want = []
    for c, ts, k, x in left:
        met = [r for r in right if r[0] == c and ts and r[1] and (r[1] < ts if strict else r[1] <= ts)
               and (tolerance is None or ts - r[1] <= dt.timedelta(hours=tolerance))]
        best = max(met, key=lambda r: (r[1], r[2]), default=(None, None, None, None))
        want.append((c, ts, k, x, best[1], best[2], best[3]))
    l_df = spark.createDataFrame(left, "city string, ts timestamp_ntz, k int, day string").repartition(4)
    r_df = spark.createDataFrame(right, "city string, day timestamp_ntz, v int, w int").repartition(2)
    for chunk in CHUNKS.values():
        got = asof_join(l_df, r_df, HOURS, "day", ["v", "w"], strict=strict, tolerance=tolerance,
                        chunk=None if chunk is None else F.expr(f"coalesce({chunk}, -1)"))
        assert got.columns == ["city", "ts", "k", "day", "as_of", "v", "w"] and rows_of(got) == sorted(want, key=repr)
    assert rows_of(asof_join(l_df, r_df.limit(0), HOURS, "day", ["v"]).select("v").distinct()) == [(None,)]
    assert asof_join(l_df.limit(0), r_df, HOURS, "day", ["v"]).count() == 0
