"""Global places of rows in a given order, found by range partitions and prefix sums."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BROADCAST_ROWS = 200_000


def placed(rows: DataFrame, scope: str, order: Sequence[str], folder: str) -> DataFrame:
    """rows with ``place`` (long, from 0 within the scope, by ``order`` with nulls first) and ``in_scope``, its rows.

    ``scope`` is a column without nulls. Rows are dealt into ranges of (scope, order), so a scope spreads over as many
    tasks as it needs, and equal rows are told apart by where they were read. Written once below ``folder``: places
    must not change when a lost task runs again. The only total is over (range, scope), one row each.
    """
    spark = rows.sparkSession
    keys = [scope, *order, "_tie"]
    dealt = rows.withColumn("_tie", F.monotonically_increasing_id()).repartitionByRange(*keys).sortWithinPartitions(*keys)
    dealt.drop("_tie").withColumns({"_range": F.spark_partition_id(), "_row": F.monotonically_increasing_id()}).write.parquet(folder)
    dealt = spark.read.parquet(folder)
    found = dealt.groupBy("_range", scope).agg(F.count("*").alias("_n"), F.min("_row").alias("_first"))
    by_scope = Window.partitionBy(scope)
    before = F.sum("_n").over(by_scope.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))
    starts = found.select("_range", scope, (F.coalesce(before, F.lit(0)) - F.col("_first")).alias("_shift"),
                          F.sum("_n").over(by_scope).alias("in_scope"))
    if found.count() <= BROADCAST_ROWS:
        starts = F.broadcast(starts)
    return dealt.join(starts, ["_range", scope]).withColumn("place", F.col("_row") + F.col("_shift")).drop(
        "_range", "_row", "_shift")
