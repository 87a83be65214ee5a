"""Incremental writes: only partitions that some output lacks are computed, and a ledger says what is complete."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

LEDGER = "_ledger"
LEDGER_FIELDS = "output string, rows long, run long"


def _exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def _same(a: DataFrame, b: DataFrame, names: list[str]) -> Column:
    return reduce(lambda x, y: x & y, [a[n].eqNullSafe(b[n]) for n in names])


class IncrementalWriter:
    """Outputs made from a source, each partitioned by ``keys`` in a folder of its own below ``path``.

    The ledger has the rows of every (key, output) of every run; it is appended after all outputs of a run stand. A key
    is complete if each output still has as many rows as its last entry says, so lost or cut partitions and runs that
    died half-way are written again, and only they: dynamic overwrite replaces the partitions it writes. A key for
    which an output has no rows is complete too. Keys may be NULL. One writer at a time.
    """

    def __init__(self, spark: SparkSession, path: str, keys: list[str], outputs: dict[str, Callable[[DataFrame], DataFrame]]):
        self.spark, self.path, self.keys, self.outputs = spark, path.rstrip("/"), keys, outputs

    def _read(self, name: str, schema: StructType) -> DataFrame:
        # a schema, as values of folder names would be guessed at
        if not _exists(self.spark, f"{self.path}/{name}"):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(f"{self.path}/{name}")

    def _counts(self, source: DataFrame) -> DataFrame:
        """keys, output, found: rows that stand now; only partition values and footers are read."""
        return reduce(DataFrame.unionAll, [
            self._read(name, make(source).schema).groupBy(*self.keys).agg(F.count("*").alias("found")).withColumn("output", F.lit(name))
            for name, make in self.outputs.items()])

    def _ledger(self, source: DataFrame) -> DataFrame:
        fields = StructType([source.schema[k] for k in self.keys] + StructType.fromDDL(LEDGER_FIELDS).fields)
        return self._read(LEDGER, fields)

    def complete(self, source: DataFrame) -> DataFrame:
        """Keys of which every output stands as written."""
        entries = self._ledger(source).where(F.col("output").isin(*self.outputs)).groupBy(*self.keys, "output").agg(
            F.max_by("rows", "run").alias("rows"))
        found = self._counts(source)
        both = entries.join(found, _same(entries, found, [*self.keys, "output"]), "left")
        stands = both.where(F.coalesce(found["found"], F.lit(0)) == entries["rows"]).select(*[entries[k] for k in self.keys], entries["output"])
        return stands.groupBy(*self.keys).agg(F.count("*").alias("_n")).where(F.col("_n") == len(self.outputs)).drop("_n")

    def write(self, source: DataFrame) -> DataFrame:
        """Writes all outputs of the keys of source that are not complete; returns those keys."""
        run = (self._ledger(source).agg(F.max("run")).first()[0] or 0) + 1
        wanted, complete = source.select(*self.keys).distinct(), self.complete(source)
        # written: what is missing changes while the outputs are written
        plan = f"{self.path}/_todo/{run}"
        wanted.join(complete, _same(wanted, complete, self.keys), "left_anti").write.mode("overwrite").parquet(plan)
        todo = self.spark.read.schema(wanted.schema).parquet(plan)
        if todo.isEmpty():
            return todo
        part = source.join(todo, _same(source, todo, self.keys), "left_semi")
        for name, make in self.outputs.items():
            out = make(part)
            # a task writes few folders, and a key of many rows is cut over many tasks
            spread = out.repartitionByRange(*self.keys, F.xxhash64(*out.columns))
            spread.write.partitionBy(*self.keys).mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(f"{self.path}/{name}")
        each = todo.withColumn("output", F.explode(F.array(*[F.lit(n) for n in self.outputs])))
        found = self._counts(source)
        each.join(found, _same(each, found, [*self.keys, "output"]), "left").select(
            *[each[k] for k in self.keys], each["output"], F.coalesce(found["found"], F.lit(0)).alias("rows"),
            F.lit(run).cast("long").alias("run")).write.mode("append").parquet(f"{self.path}/{LEDGER}")
        return todo
