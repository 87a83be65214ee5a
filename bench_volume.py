"""Times the hourly work on five series of 315,576 hours with 14 variables (1990-2025).

The given tables hold 30 days of hours, so the series are derived with spark.range and
written below the shared folder first. Steps may be named on the command line.
"""

from __future__ import annotations

import json
import os
import sys
import time

from pyspark.sql import functions as F

from heatframe.operators import stats as T
from heatframe.operators.series import Series
from heatframe.plans import precursor as P
from heatframe.plans.feature_matrix import Recipe, feature_matrix
from heatframe.session import local_session, new_path
from heatframe.sources.schema import HOURLY_VARIABLES, ZSCORE_VARIABLES

CITIES = ["bordeaux", "lyon", "marignane", "marseille", "paris"]
HOURS = 315_576
SERIES = Series(("city",), "ts", "hour", dense=True)
VALUE = "temperature_2m"


def write_series(spark) -> str:
    """A yearly and a daily cycle, warm and cool spells of five days, and noise, to 0.1."""
    rows = spark.range(len(CITIES) * HOURS).select(
        F.array(*[F.lit(c) for c in CITIES])[(F.col("id") % len(CITIES)).cast("int")].alias("city"),
        F.floor(F.col("id") / len(CITIES)).alias("h"),
    )
    rows = rows.withColumn("ts", F.expr("TIMESTAMP_NTZ'1990-01-01 00:00:00' + make_interval(0, 0, 0, 0, int(h), 0, 0)"))

    def noise(seed: int, width: int):
        return F.pmod(F.hash("city", "h", F.lit(seed)), F.lit(width)) / 10.0

    spell = F.pmod(F.hash("city", F.floor(F.col("h") / 120)), F.lit(2000)) / 100.0
    cycle = -10 * F.cos((F.dayofyear("ts") - 20) * 0.0172) + 5 * F.sin((F.hour("ts") - 9) * 0.2618)
    rows = rows.withColumn(VALUE, F.round(2 + spell + cycle + noise(0, 10), 1))
    others = [v for v in HOURLY_VARIABLES if v != VALUE]
    rows = rows.withColumns({v: F.round(F.col(VALUE) * 0.1 * n + noise(n, 300), 1) for n, v in enumerate(others, 1)})
    path = new_path(spark, "series")
    rows.drop("h").repartition(8).write.parquet(path)
    return path


def main() -> None:
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), memory="16g")
    df = spark.read.parquet(write_series(spark))
    season = F.month("ts").between(5, 9)
    recipe = Recipe(zscores=tuple(ZSCORE_VARIABLES), label_reference=("1990-01-01", "2018-12-31"))
    others = [v for v in HOURLY_VARIABLES if v != VALUE]

    def profile():
        events = P.hourly_events(df, SERIES, VALUE, 0.95, 3)
        return P.pre_event_profile(events, df, SERIES, VALUE, others, season=season)

    steps = {
        "feature_matrix": lambda: feature_matrix(df, SERIES, recipe, CITIES),
        "pre_event_profile": profile,
        "spearman_matrix": lambda: T.spearman_matrix(df.where(season), ["city"], ["ts"], HOURLY_VARIABLES),
        "lag_profile": lambda: T.lag_profile(df, SERIES, VALUE, HOURLY_VARIABLES, 72, season),
    }
    seconds = {}
    for name in sys.argv[1:] or steps:
        start = time.perf_counter()
        steps[name]().write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 1)
    print(json.dumps({"metric": "hourly work on 1,577,880 rows", "unit": "sec", "steps": seconds}))


if __name__ == "__main__":
    main()
