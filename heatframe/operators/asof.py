"""Last known values carried forward in time, by a scan over chunks instead of one over an entity.

A chunk's last values are one row; a running last over these rows gives what each chunk starts with, and inside a chunk
the rows are filled from that and from one another. Only the rows of a chunk and the chunks of an entity, a number
bounded by the time span, come together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from heatframe.operators.series import Series


def _last(value: Column, w) -> Column:
    return F.last(value, ignorenulls=True).over(w)


def _carried(df: DataFrame, series: Series, known: dict[str, Column], order: list[Column], chunk: Column) -> DataFrame:
    """df with the columns of ``known``: the last one that is not NULL up to each row, the row's own included."""
    keys = series.key_list
    rows = df.withColumns({"_chunk": chunk, **known})
    ends = rows.groupBy(*keys, "_chunk").agg(*[F.max(c).alias(c) for c in known])
    before = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    starts = ends.select(*keys, "_chunk", *[_last(F.col(c), before).alias(f"_start{c}") for c in known])
    inside = Window.partitionBy(*keys, "_chunk").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    same = [rows[k].eqNullSafe(starts[k]) for k in (*keys, "_chunk")]
    joined = rows.join(starts, same, "left").select(rows["*"], *[starts[f"_start{c}"] for c in known])
    filled = {c: F.coalesce(_last(F.col(c), inside), F.col(f"_start{c}")) for c in known}
    return joined.withColumns(filled).drop("_chunk", *[f"_start{c}" for c in known])


def _near(at: Column, ts: Column, series: Series, tolerance: int | None) -> Column:
    return F.lit(True) if tolerance is None else series.tick(ts) - series.tick(at) <= tolerance


def carry_forward(df: DataFrame, series: Series, columns: list[str], tolerance: int | None = None, chunk: Column | None = None) -> DataFrame:
    """Fills missing values with the last one before them, at most ``tolerance`` steps old.

    Each column is carried on its own; leading gaps stay NULL. Entities have one row a time; rows without a time come
    first and have no value to carry on. ``chunk`` (a column that does not fall as time goes on) replaces the calendar chunks.
    """
    ts = F.col(series.ts)
    known = {f"_known_{c}": F.when(ts.isNotNull() & F.col(c).isNotNull(), F.struct(ts.alias("at"), F.col(c).alias("value"))) for c in columns}
    rows = _carried(df, series, known, [ts.asc()], series.chunk() if chunk is None else chunk)
    out = {c: F.coalesce(F.col(c), F.when(_near(F.col(f"_known_{c}.at"), ts, series, tolerance), F.col(f"_known_{c}.value"))) for c in columns}
    return rows.withColumns(out).drop(*known)


def asof_join(left: DataFrame, right: DataFrame, series: Series, right_ts: str, columns: list[str], as_of: str = "as_of",
              strict: bool = False, tolerance: int | None = None, chunk: Column | None = None) -> DataFrame:
    """left with ``columns`` of the last right row of the same entity that is not later, and its time as ``as_of``.

    right      keys, ``right_ts`` and columns; of rows of one entity and time the largest one counts
    strict     the right row must be earlier
    tolerance  steps of the series that the right row may be older; beyond that the columns are NULL

    Left rows keep their number, repeated ones included; those without a time have no match. Both sides are scanned as
    one series of events, so neither is broadcast and nothing is multiplied. ``chunk``: see ``carry_forward``.
    """
    keys, ts = series.key_list, series.ts
    found = right.where(F.col(right_ts).isNotNull()).groupBy(
        *keys, F.col(right_ts).cast(left.schema[ts].dataType).alias(ts)).agg(F.max(F.struct(*columns)).alias("_right"))
    events = left.withColumn("_left", F.lit(1)).unionByName(found.withColumn("_left", F.lit(0)), allowMissingColumns=True)
    known = {"_known": F.when(F.col("_left") == 0, F.struct(F.col(ts).alias("at"), F.col("_right").alias("value")))}
    first = F.col("_left").desc() if strict else F.col("_left").asc()
    rows = _carried(events, series, known, [F.col(ts).asc(), first], series.chunk() if chunk is None else chunk).where("_left = 1")
    met = _near(F.col("_known.at"), F.col(ts), series, tolerance) & F.col(ts).isNotNull()
    return rows.withColumns({as_of: F.when(met, F.col("_known.at")), **{c: F.when(met, F.col(f"_known.value.{c}")) for c in columns}}).drop(
        "_left", "_right", "_known")
