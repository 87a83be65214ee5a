"""Series files of different columns: a catalogue of their headers, one scan for each layout, a report of the rest."""

from __future__ import annotations

import csv
from collections.abc import Iterable, Iterator
from functools import reduce

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heatframe.functions.scalar import entity_from_name, null_nan
from heatframe.sources.files import standardise_time, time_column

HEADER_BYTES = 1 << 20
NO_TIME, NO_COLUMNS = "no time column", "no columns"


def _columns(path: str, fmt: str, sep: str) -> list[str]:
    """Column names of a file, by its footer or the first line; the rest of the file is not read."""
    # Spark names local files file:/..., which Arrow does not read
    local = path.startswith("file:/") and not path.startswith("file://")
    system, name = fs.FileSystem.from_uri(f"file://{path[len('file:'):]}" if local else path)
    with system.open_input_file(name) as file:
        if fmt == "parquet":
            return pq.read_schema(file).names
        first = file.read(HEADER_BYTES).split(b"\n", 1)[0].decode("utf-8-sig")
    return next(csv.reader([first.rstrip("\r")], delimiter=sep), [])


def catalogue(spark: SparkSession, paths: str | list[str], fmt: str, sep: str = ",") -> DataFrame:
    """path, columns, problem of every file: headers and footers are read in tasks, by the file systems that Arrow knows.

    ``problem`` is NULL for a series, else why the file is none (no columns, no time column, or the reader's message).
    Files of no bytes are not listed, as Spark's scans leave them out.
    """
    def headers(incoming: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in incoming:
            rows = []
            for path in batch.column(0).to_pylist():
                try:
                    columns, problem = _columns(path, fmt, sep), None
                    if not any(columns):
                        problem = NO_COLUMNS
                    elif time_column(columns) is None:
                        problem = NO_TIME
                except (OSError, ValueError) as error:  # what is no file of the format; pa.ArrowInvalid is a ValueError
                    columns, problem = [], str(error)[:200]
                rows.append((path, columns, problem))
            path, columns, problem = zip(*rows) if rows else ((), (), ())
            yield pa.record_batch([pa.array(path, pa.string()), pa.array(columns, pa.list_(pa.string())), pa.array(problem, pa.string())],
                                  ["path", "columns", "problem"])

    files = spark.read.format("binaryFile").load(paths).select("path")
    return files.mapInArrow(headers, "path string, columns array<string>, problem string")


def read_mixed_series(
    spark: SparkSession, paths: str | list[str], fmt: str, numeric: list[str], sep: str = ","
) -> tuple[DataFrame | None, DataFrame]:
    """(series of all files that have a time column, catalogue of all files).

    Files of equal columns are one scan, in which Spark prunes and splits as ever; absent columns are NULL. The time
    column of each layout becomes ``timestamp``, the entity comes from the file name, ``numeric`` columns are doubles
    and the others text. The driver holds the paths, as it does for every scan.
    """
    listed = catalogue(spark, paths, fmt, sep)
    frames = []
    for columns, members in _layouts(listed.where("problem IS NULL")):
        reader = spark.read.format(fmt)
        if fmt == "csv":
            reader = reader.options(header=True, sep=sep, inferSchema=False, mode="PERMISSIVE")
        raw = reader.load(members)
        timed = standardise_time(raw.withColumn("_city", entity_from_name(F.col("_metadata.file_name"))))
        values = [null_nan(F.col(c).try_cast("double")).alias(c) if c in numeric else F.col(c).cast("string").alias(c)
                  for c in timed.columns if c not in ("timestamp", "_city", "city")]
        frames.append(timed.select(F.col("_city").alias("city"), "timestamp", *values))
    return (reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames) if frames else None), listed


def _layouts(listed: DataFrame) -> list[tuple[list[str], list[str]]]:
    groups: dict[tuple[str, ...], list[str]] = {}
    for row in listed.select("path", "columns").toLocalIterator():
        groups.setdefault(tuple(row["columns"]), []).append(row["path"])
    return [(list(columns), sorted(members)) for columns, members in sorted(groups.items())]
