"""Consecutive runs (gaps and islands) found per calendar chunk and stitched.

Each chunk labels its own runs. Only the first and last run of a chunk can reach
into a neighbour, so the key-wide pass sees at most two rows per chunk.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from heatframe.operators.series import Series


def label_runs(df: DataFrame, series: Series, flag: str, adjacent: bool = False) -> DataFrame:
    """Adds ``run_id`` (1, 2, ... per entity), ``run_pos`` (1-based place in the run)
    and ``run_len`` (rows of the whole run) of equal ``flag`` values in time order.

    ``adjacent`` also breaks a run where the next row is not the next calendar step.
    """
    keys = series.key_list

    def continues(prev_state: Column, prev_ts: Column, state: Column, ts: Column) -> Column:
        same = prev_state == state
        if adjacent:
            same = same & (series.tick(ts) == series.tick(prev_ts) + 1)
        return F.coalesce(same, F.lit(False))

    in_chunk = Window.partitionBy(*keys, "_chunk").orderBy(series.ts)
    in_run = Window.partitionBy(*keys, "_chunk", "_run")
    state, ts = F.col(flag), F.col(series.ts)
    rows = (
        df.withColumn("_chunk", series.chunk())
        .withColumn("_same", continues(F.lag(state).over(in_chunk), F.lag(ts).over(in_chunk), state, ts))
        .withColumn("_run", F.sum((~F.col("_same")).cast("long")).over(in_chunk))
        .withColumn("_place", F.row_number().over(in_run.orderBy(series.ts)).cast("long"))
        .withColumn("_size", F.count("*").over(in_run))
    )
    edge = F.struct(state.alias("state"), ts.alias("ts"), "_size")
    chunks = rows.groupBy(*keys, "_chunk").agg(
        F.max("_run").alias("_runs"), F.min_by(edge, ts).alias("_first"), F.max_by(edge, ts).alias("_last")
    )
    carried = join_edges(chunks, keys, continues)
    before = F.when(F.col("_run") == 1, F.col("_before")).otherwise(0)
    after = F.when(F.col("_run") == F.col("_runs"), F.col("_after")).otherwise(0)
    return rows.join(carried, [*keys, "_chunk"]).select(
        *df.columns,
        (F.col("_offset") + F.col("_run")).alias("run_id"),
        (F.col("_place") + before).alias("run_pos"),
        (F.col("_size") + before + after).alias("run_len"),
    )


def join_edges(chunks: DataFrame, keys: list[str], continues) -> DataFrame:
    """Per chunk: rows of its first run in earlier chunks, of its last run in later
    chunks, and the number of runs that were opened before the chunk."""
    by_chunk = Window.partitionBy(*keys).orderBy("_chunk")
    last = F.lag("_last").over(by_chunk)
    joins = continues(last["state"], last["ts"], F.col("_first.state"), F.col("_first.ts")).cast("long")
    up_to = by_chunk.rowsBetween(Window.unboundedPreceding, 0)
    linked = chunks.withColumn("_joins", joins).withColumn(
        "_offset", F.sum(F.col("_runs") - F.col("_joins")).over(up_to) - F.col("_runs")
    )
    single = F.col("_runs") == 1
    head = F.struct(F.lit(0).alias("side"), F.col("_joins").alias("joins"), F.col("_first._size").alias("size"))
    tail = F.struct(F.lit(1).alias("side"), F.lit(0).cast("long").alias("joins"), F.col("_last._size").alias("size"))
    edges = linked.select(
        *keys, "_chunk", "_runs", "_offset",
        F.inline(F.when(single, F.array(head)).otherwise(F.array(head, tail))),
    )
    along = Window.partitionBy(*keys).orderBy("_chunk", "side").rowsBetween(Window.unboundedPreceding, 0)
    edges = edges.withColumn("_stitched", F.sum(1 - F.col("joins")).over(along))
    same_run = Window.partitionBy(*keys, "_stitched")
    upto = same_run.orderBy("_chunk").rowsBetween(Window.unboundedPreceding, 0)
    edges = edges.withColumn("_seen", F.sum("size").over(upto)).withColumn("_all", F.sum("size").over(same_run))
    is_tail = (F.col("side") == 1) | single
    return edges.groupBy(*keys, "_chunk").agg(
        F.max("_runs").alias("_runs"),
        F.max("_offset").alias("_offset"),
        F.max(F.when(F.col("side") == 0, F.col("_seen") - F.col("size"))).alias("_before"),
        F.max(F.when(is_tail, F.col("_all") - F.col("_seen"))).alias("_after"),
    )
