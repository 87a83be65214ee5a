"""Heat events, spell tags, look-ahead labels and alarms."""

from __future__ import annotations

import warnings
from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from heatframe.functions.scalar import hot
from heatframe.operators.ordered import quantiles
from heatframe.operators.runs import label_runs
from heatframe.operators.series import Series, densify, over_rows, resample_daily_max

GAPS = ("rows", "null_breaks", "calendar")
BASES = ("daily_max_all", "daily_max_ref", "seasonal_ref", "hourly_all", "absolute")


def tag_spells(
    df: DataFrame, series: Series, value: str, threshold: float | str, gap: str = "calendar", strict: bool = False
) -> DataFrame:
    """Adds ``is_hot``, ``run_id``, ``run_pos`` and ``run_len``; three gap rules:

    rows         missing values are removed first, so a spell bridges gaps;
    null_breaks  a missing value ends a spell, an absent day does not;
    calendar     a spell needs every calendar step.
    """
    if gap not in GAPS:
        raise ValueError(f"gap must be one of {GAPS}")
    limit = F.col(threshold) if isinstance(threshold, str) else F.lit(threshold)
    if gap == "rows":
        df = df.where(F.col(value).isNotNull())
    flagged = df.withColumn("is_hot", hot(F.col(value), limit, strict))
    if gap == "calendar":
        flagged = flagged.where("is_hot")
    return label_runs(flagged, series, "is_hot", adjacent=gap == "calendar")


def detect_events(
    df: DataFrame,
    series: Series,
    value: str,
    threshold: float | str,
    min_len: int = 3,
    gap: str = "calendar",
    strict: bool = False,
) -> DataFrame:
    """(keys, start_date, end_date, days) of spells of at least ``min_len`` rows."""
    needed = [*series.keys, series.ts, value] + ([threshold] if isinstance(threshold, str) else [])
    tagged = tag_spells(df.select(*needed), series, value, threshold, gap, strict)
    return (
        tagged.where(F.col("is_hot") & (F.col("run_len") >= min_len))
        .groupBy(*series.keys, "run_id")
        .agg(F.min(series.ts).alias("start_date"), F.max(series.ts).alias("end_date"), F.count("*").alias("days"))
        .drop("run_id")
    )


def heatwave_tags(
    df: DataFrame, series: Series, value: str, threshold: float, n: int = 3, gap: str = "null_breaks"
) -> DataFrame:
    """Adds the running spell length (0 when not hot) and the >= n / > n tags."""
    tagged = tag_spells(df, series, value, threshold, gap)
    spell = F.when(F.col("is_hot"), F.col("run_pos")).otherwise(F.lit(0).cast("long"))
    return (
        tagged.withColumn("hot_spell_len", spell)
        .withColumn(f"heatwave_ge_{n}days", F.col("hot_spell_len") >= n)
        .withColumn(f"heatwave_gt_{n}days", F.col("hot_spell_len") > n)
        .drop("run_id", "run_pos", "run_len")
    )


def event_threshold(
    df: DataFrame,
    series: Series,
    value: str,
    pct: float,
    basis: str = "daily_max_ref",
    ref: tuple[str, str] | None = None,
    months: list[int] | None = None,
    test_from: str | None = None,
) -> DataFrame:
    """(keys, threshold): quantile of daily maxima or of the raw values.

    basis: ``daily_max_all``, ``daily_max_ref`` (inside ``ref``), ``hourly_all``,
    ``seasonal_ref`` (daily maxima inside ``ref`` and ``months``) or ``absolute``
    (``pct`` is the threshold itself). The two with a reference period need ``ref``;
    with ``test_from`` a warning tells if that period reaches into the test span.
    """
    if basis not in BASES:
        raise ValueError(f"basis must be one of {BASES}")
    if basis in ("daily_max_ref", "seasonal_ref") and ref is None:
        raise ValueError(f"{basis} needs ref, or the threshold would see the rows it is tested on")
    if basis == "seasonal_ref" and not months:
        raise ValueError("seasonal_ref needs months")
    if ref and test_from and ref[1] >= test_from:
        warnings.warn(f"the reference period ends on {ref[1]}, after the test span begins on {test_from}", stacklevel=2)
    if basis == "absolute":
        return df.select(*series.keys).distinct().withColumn("threshold", F.lit(float(pct)))
    if basis == "hourly_all":
        return quantiles(df, series.key_list, value, {"threshold": pct})
    daily = resample_daily_max(df, series, value)
    if basis in ("daily_max_ref", "seasonal_ref"):
        daily = daily.where(F.col("obs_date").between(*[F.lit(d).cast("date") for d in ref]))
    if basis == "seasonal_ref":
        daily = daily.where(F.month("obs_date").isin(months))
    return quantiles(daily, series.key_list, "daily_max", {"threshold": pct})


def hot_hours(df: DataFrame, series: Series, value: str, thresholds: DataFrame) -> DataFrame:
    """Adds ``daily_max``, ``threshold`` and ``is_hot``: every hour of a hot day is hot.

    Thresholds meet the daily maxima, not the hours, and those return to the hours by
    (keys, day): no hour is shuffled by its entity alone.
    """
    day = F.col(series.ts).cast("date").alias("_day")
    daily = df.groupBy(*series.keys, day).agg(F.max(value).alias("daily_max")).join(thresholds, series.key_list)
    flagged = daily.withColumn("is_hot", hot(F.col("daily_max"), F.col("threshold")))
    return df.withColumn("_day", F.col(series.ts).cast("date")).join(flagged, [*series.keys, "_day"]).drop("_day")


def sustained_label(
    df: DataFrame, series: Series, window: int = 72, horizon: int = 72, censor: str = "reference"
) -> DataFrame:
    """Adds ``sustained`` (the last ``window`` rows are all hot; NULL before) and ``y``
    (a sustained row among the next ``horizon`` rows).

    censor: ``reference`` never looks at the flags of the first ``horizon`` rows and
    shortens the horizon at the end; ``strict`` gives NULL when the horizon is cut.
    """
    reach = max(window, horizon)
    return over_rows(df, series, reach, horizon, *label_steps(window, horizon, censor)).drop("_seen")


def label_steps(window: int, horizon: int, censor: str = "reference") -> list[Callable]:
    """The windowed columns ``sustained``, ``_seen`` and ``y`` for ``over_rows``, in order."""
    if censor not in ("reference", "strict"):
        raise ValueError("censor is reference or strict")
    flag = F.col("is_hot").cast("int")

    def sustained(w):
        frame = w.rowsBetween(1 - window, 0)
        return {"sustained": F.when(F.count("*").over(frame) >= window, F.min(flag).over(frame))}

    def seen(w):
        earlier = F.count("*").over(w.rowsBetween(-horizon, -1))
        return {"_seen": F.when(earlier >= horizon, F.col("sustained"))}

    def label(w):
        ahead = w.rowsBetween(1, horizon)
        if censor == "strict":
            return {"y": F.when(F.count("*").over(ahead) >= horizon, F.max("sustained").over(ahead))}
        return {"y": F.max("_seen").over(ahead)}

    return [sustained, seen, label]


def lookahead_label(
    df: DataFrame,
    series: Series,
    value: str,
    pct: float = 0.95,
    window: int = 72,
    horizon: int = 72,
    basis: str = "daily_max_ref",
    ref: tuple[str, str] | None = None,
    censor: str = "reference",
) -> DataFrame:
    """Hot-day rule, sustained flag and look-ahead label in one step."""
    thresholds = event_threshold(df, series, value, pct, basis, ref)
    return sustained_label(hot_hours(df, series, value, thresholds), series, window, horizon, censor)


def daily_lookahead_label(
    df: DataFrame, series: Series, value: str, threshold: float | str, min_len: int = 3, horizon: int = 3,
    strict: bool = False,
) -> DataFrame:
    """Day-level label: does a day of a spell of ``min_len`` or more days follow within
    ``horizon`` days? Absent days are put in for the windows and left out again."""
    limit = F.col(threshold) if isinstance(threshold, str) else F.lit(threshold)
    flagged = df.withColumn("is_hot", hot(F.col(value), limit, strict))
    runs = label_runs(flagged, series, "is_hot")
    runs = runs.withColumn("in_event", (F.col("is_hot") & (F.col("run_len") >= min_len)).cast("int"))
    dense = Series(series.keys, series.ts, series.step, dense=True)
    whole = densify(runs.withColumn("_given", F.lit(True)), dense).withColumn("in_event", F.coalesce("in_event", F.lit(0)))
    return over_rows(
        whole, dense, 0, horizon, lambda w: {"y": F.max("in_event").over(w.rowsBetween(1, horizon))}
    ).where("_given").drop("run_id", "run_pos", "run_len", "_given")


def baseline_alarm(
    df: DataFrame, series: Series, value: str, thresholds: DataFrame, test_from: str, any_entity: bool = False
) -> DataFrame:
    """(keys, ts, alarm) from ``test_from`` on: 1 on every hour of a day whose maximum,
    taken over the test rows, reaches the threshold. ``any_entity`` raises the alarm of
    a timestamp for all entities as soon as one of them has it."""
    test = df.where(F.col(series.ts) >= F.lit(test_from).cast("timestamp_ntz"))
    marked = hot_hours(test, series, value, thresholds).select(
        *series.keys, series.ts, F.col("is_hot").cast("int").alias("alarm")
    )
    if not any_entity:
        return marked
    # one row per timestamp after map-side combine, then back to the entities
    combined = marked.groupBy(series.ts).agg(F.max("alarm").alias("alarm"))
    return marked.drop("alarm").join(combined, series.ts)


def near_miss(df: DataFrame, series: Series, value: str, threshold_table: DataFrame, cuts: list[int]) -> DataFrame:
    """(min_hours, n_fp, share_pct): how long the hot spell around each false positive
    was. ``df`` carries 0/1 ``true`` and ``pred``."""
    flagged = df.join(threshold_table, series.key_list).withColumn("is_hot", hot(F.col(value), F.col("threshold")))
    runs = label_runs(flagged, series, "is_hot")
    spell = F.when(F.col("is_hot"), F.col("run_len")).otherwise(0)
    false_alarms = runs.where((F.col("true") == 0) & (F.col("pred") == 1)).select(spell.alias("spell"))
    counts = false_alarms.agg(
        F.count("*").alias("n"),
        *[F.sum((F.col("spell") >= c).cast("long")).alias(f"n_{c}") for c in cuts],
    )
    rows = F.array(*[F.struct(F.lit(c).alias("min_hours"), F.coalesce(f"n_{c}", F.lit(0)).alias("n_fp")) for c in cuts])
    share = F.try_divide(F.col("n_fp") * 100.0, F.col("n").cast("double"))
    return counts.select("n", F.inline(rows)).select("min_hours", "n_fp", share.alias("share_pct"))


def event_windows(events: DataFrame, hourly: DataFrame, series: Series, hours: int = 72) -> DataFrame:
    """Rows of ``[start - hours, start)`` before each event, with ``offset`` -1 for the
    last row of the window. ``events`` has (keys, start_date).

    An event names its hours itself, so the range join becomes an equi-join and no
    event meets hours outside its window.
    """
    start = F.col("start_date").cast("timestamp_ntz")
    span = F.sequence(
        start - F.expr(f"INTERVAL {hours} HOURS"), start - F.expr("INTERVAL 1 HOUR"), F.expr("INTERVAL 1 HOUR")
    )
    wanted = events.select(*series.keys, "start_date", F.explode(span).alias(series.ts))
    latest_first = Window.partitionBy(*series.keys, "start_date").orderBy(F.col(series.ts).desc())
    return wanted.join(hourly, [*series.keys, series.ts]).withColumn("offset", -F.row_number().over(latest_first))
