"""Token counts of flat token files without an index (operator 8).

A file is nothing but ids of fixed width, with an end id after each document. It is cut into blocks
of a fixed number of ids that tasks scan on their own; documents that reach over block borders are put
together by prefix scans over one row per block.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from heatframe.llm import files
from heatframe.llm.tokens import encoder

BLOCK_IDS = 1 << 20
WIDTHS = {"u2": 2, "u4": 4}


def write_flat(docs: DataFrame, folder: str, tokenizer: str, end_id: int, width: str = "u4",
               id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One flat file per task, documents in the order they are read; returns path, doc_no, doc_id of every document.

    Special strings within texts are ordinary text, so the end id stands nowhere but after a document.
    Null and empty texts are an end id alone. Ids that don't fit into ``width`` raise.
    """
    schema = pa.schema([("path", pa.string()), ("doc_no", pa.int64()), ("doc_id", pa.int64())])
    end = np.array([end_id], f"<{width}").tobytes()

    def write(incoming: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            out, path, at = None, "", 0
            for doc_id, text in files.rows_of(incoming):
                if out is None:
                    path, out = files.new_file(folder, "flat", ".ids")
                ids = np.frombuffer(next(encoder(tokenizer, ordinary=True).encode([text])), "<u4")
                if (ids == end_id).any() or len(ids) and int(ids.max()) >= 1 << (8 * WIDTHS[width]):
                    raise ValueError(f"document {doc_id}: an id is the end id or too large for {width}")
                out.write(ids.astype(f"<{width}").tobytes() + end)
                yield path, at, doc_id
                at += 1
            if out is not None:
                out.close()

        yield from files.batches(rows(), schema)

    chosen = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text"))
    chosen.mapInArrow(write, "path string, doc_no long, doc_id long").write.parquet(f"{folder}/documents")
    return docs.sparkSession.read.parquet(f"{folder}/documents")


def scan_separators(flat: DataFrame, end_id: int, width: str = "u4", block_ids: int = BLOCK_IDS) -> DataFrame:
    """Documents of flat files.

    flat    one row per file: path, length (bytes)
    Returns path, doc_no (from 0 within the file), start (ids before it in the file), n_tokens (without the
    end id), ended. Ids after a file's last end id are a document with ended = false; an empty file has none.
    A length that is no whole number of ids raises.
    """
    step = WIDTHS[width] * block_ids
    whole = F.when(F.col("length") % WIDTHS[width] != 0, F.raise_error(F.lit("a file ends within an id")).cast("long"))
    blocks = flat.select("path", F.coalesce(whole, F.col("length")).alias("length")).where("length > 0").select(
        "path", F.explode(F.expr(f"sequence(0L, length - 1, {step}L)")).alias("offset"), "length")
    blocks = blocks.select("path", "offset", F.least(F.lit(step), F.col("length") - F.col("offset")).alias("size"))
    schema = pa.schema([("path", pa.string()), ("first", pa.int64()), ("n_ids", pa.int64()),
                        ("ends", pa.list_(pa.int64()))])

    def scan(incoming: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for path, offset, size in files.rows_of(incoming):
                with files.open_file(path) as source:
                    source.seek(offset)
                    ids = np.frombuffer(source.read(size), f"<{width}")
                first = offset // WIDTHS[width]
                yield path, first, len(ids), (first + np.flatnonzero(ids == end_id)).tolist()

        yield from files.batches(rows(), schema, lambda r: 8 * len(r[-1]))

    # a row is a block of some MB, so blocks are dealt evenly, not by file
    found = blocks.repartition("path", "offset").mapInArrow(scan, "path string, first long, n_ids long, ends array<long>")
    return stitch(found)


def _before(value: Column) -> Column:
    return value.over(Window.partitionBy("path").orderBy("first").rowsBetween(Window.unboundedPreceding, -1))


def stitch(found: DataFrame) -> DataFrame:
    """Documents from blocks: path, first (its first id's place), n_ids, ends (places of end ids, ascending)."""
    last = Window.partitionBy("path").orderBy(F.col("first").desc())
    carried = found.select(
        "path", "first", "n_ids", "ends",
        F.coalesce(_before(F.sum(F.size("ends"))), F.lit(0)).alias("docs_before"),
        F.coalesce(_before(F.max(F.array_max("ends"))), F.lit(-1)).alias("end_before"),
        (F.row_number().over(last) == 1).alias("is_last"),
    )
    stop = F.col("first") + F.col("n_ids")
    open_from = F.coalesce(F.array_max("ends"), F.col("end_before"))
    # a tail without an end id closes at the file's end
    ends = F.when(F.col("is_last") & (open_from < stop - 1), F.concat("ends", F.array(stop))).otherwise(F.col("ends"))
    starts = F.concat(F.array(F.col("end_before")), F.col("bounds"))
    return (
        carried.withColumn("bounds", ends).withColumn("stop", stop)
        .select("path", "docs_before", "stop", F.posexplode(F.arrays_zip(
            F.slice(starts, F.lit(1), F.size("bounds")).alias("prior"), F.col("bounds").alias("end"))))
        .select("path", (F.col("docs_before") + F.col("pos")).alias("doc_no"),
                (F.col("col.prior") + 1).alias("start"), (F.col("col.end") - F.col("col.prior") - 1).alias("n_tokens"),
                (F.col("col.end") < F.col("stop")).alias("ended"))
    )


def flat_files(spark: SparkSession, paths: list[str] | str) -> DataFrame:
    """path and length of flat files, read from the listing alone."""
    return spark.read.format("binaryFile").load(paths).select("path", "length")
