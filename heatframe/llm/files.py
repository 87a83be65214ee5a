"""Files that tasks write to and read from the shared folder, by any path that Arrow's file systems know."""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame

BATCH_BYTES = 4 << 20
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
ARROW_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def step_table(df: DataFrame, path: str, batch_bytes: int | None = None) -> DataFrame:
    """df written as Parquet and read again; the shuffles it took go with the write, as nothing after it needs them.

    ``batch_bytes`` bounds the Arrow batches that its Python steps get.
    """
    spark = df.sparkSession
    settings = {CLEANUP: "true"} | ({ARROW_BYTES: str(batch_bytes)} if batch_bytes else {})
    before = {name: spark.conf.get(name) for name in settings}
    try:
        for name, value in settings.items():
            spark.conf.set(name, value)
        df.write.parquet(path)
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)
    return spark.read.parquet(path)


def drop_table(path: str) -> None:
    """Removes a written table that no later step reads."""
    system, name = fs.FileSystem.from_uri(path)
    system.delete_dir(name)


def new_file(folder: str, stem: str, suffix: str) -> tuple[str, pa.NativeFile]:
    """A file of this attempt alone; a second attempt of the task writes another one.

    Only files named in a table that Spark committed count, so files of lost attempts do no harm.
    """
    system, path = fs.FileSystem.from_uri(folder)
    system.create_dir(path, recursive=True)
    name = f"{stem}-{uuid.uuid4().hex}{suffix}"
    return f"{folder}/{name}", system.open_output_stream(f"{path}/{name}")


def open_file(path: str) -> pa.NativeFile:
    system, name = fs.FileSystem.from_uri(path)
    return system.open_input_file(name)


def batches(rows: Iterable[tuple], schema: pa.Schema, size_of=None) -> Iterator[pa.RecordBatch]:
    """Rows as Arrow batches of bounded size."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += 64 + (size_of(row) if size_of else 0)
        if size >= BATCH_BYTES:
            yield batch(held, schema)
            held, size = [], 0
    if held:
        yield batch(held, schema)


def batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows) if rows else ([] for _ in schema)
    return pa.record_batch([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


def rows_of(incoming: Iterable[pa.RecordBatch]) -> Iterator[tuple]:
    """The rows of Arrow batches, converted in slices so that few long texts are held twice."""
    for b in incoming:
        for at in range(0, b.num_rows, 256):
            part = b.slice(at, 256)
            yield from zip(*(c.to_pylist() for c in part.columns))
