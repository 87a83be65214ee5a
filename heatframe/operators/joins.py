"""Joins between observation tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heatframe.operators.quality import dedup_keys


def join_observations(
    left: DataFrame, right: DataFrame, keys: list[str], suffixes: tuple[str, str] = ("_tx", "_wind")
) -> DataFrame:
    """Inner join on the observation key with one right row per key; columns both
    sides share get the suffixes."""
    shared = [c for c in left.columns if c in right.columns and c not in keys]
    left = left.withColumnsRenamed({c: c + suffixes[0] for c in shared})
    right = dedup_keys(right, keys, []).withColumnsRenamed({c: c + suffixes[1] for c in shared})
    return left.join(right, keys)


def match_station(
    candidates: DataFrame, reference: DataFrame, station: str, group: str, on: str, left_value: str, right_value: str
) -> DataFrame:
    """Per reference group: the candidate station whose values agree on most days.

    Returns (group, station, matching_days, total_days_compared); a group that agrees with none has no station and
    0 matching days. Of equal stations the smallest is taken. Here the total counts
    candidate x reference rows of the same day. Agreement is an equi-join on (day, value)
    of counted rows, so no day pairs all its stations with all its groups.
    """
    left = candidates.select(on, station, F.col(left_value).alias("_v"))
    right = reference.select(on, group, F.col(right_value).alias("_v")).groupBy(on, group, "_v").agg(
        F.count("*").alias("_n")
    )
    # candidate rows are not counted first: they seldom repeat, and a task would hold them twice more
    matches = left.join(right, [on, "_v"]).groupBy(group, station).agg(F.sum("_n").alias("matching_days"))
    # the most matches first, then the smallest station of any type
    best = matches.groupBy(group).agg(F.min(F.struct((-F.col("matching_days")).alias("_less"), station)).alias("_best"))
    totals = (
        left.groupBy(on).agg(F.count("*").alias("_days"))
        .join(right.groupBy(on, group).agg(F.sum("_n").alias("_refs")), on)
        .groupBy(group)
        .agg(F.sum(F.col("_days") * F.col("_refs")).alias("total_days_compared"))
    )
    return totals.join(best, group, "left").select(
        group, F.col(f"_best.{station}").alias(station),
        F.coalesce(-F.col("_best._less"), F.lit(0)).alias("matching_days"),
        "total_days_compared",
    )


def rejoin_best(candidates: DataFrame, reference: DataFrame, matched: DataFrame, station: str, group: str, on: str) -> DataFrame:
    """Rows of the best station next to the reference rows of its group."""
    kept = candidates.join(F.broadcast(matched.select(group, station)), station)  # one row for each group
    return kept.join(reference, [group, on])
