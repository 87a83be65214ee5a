"""Token ids as compressed bit or byte planes (operator 1).

A shard file holds the ids of consecutive documents as one stream, cut into blocks of a fixed number
of ids. A block is transposed, so that byte (or bit) k of all its ids lies together, and every plane is
a zstandard frame of its own. The footer is the chunk index (first id, ids, place and plane sizes of
every block) and the list of documents with their lengths, so a block or a document is read alone:

    MAGIC | frames of block 0, plane 0.. | frames of block 1 .. | footer frame | footer length (u64) | MAGIC

Shards follow one another in ascending document id. The table written beside them lists the shards of
successful attempts only.
"""

from __future__ import annotations

import struct
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from heatframe.llm import files
from heatframe.llm.tokens import encoder

MAGIC = b"PLN1"
BLOCK_IDS = 1 << 18
LEVEL = 3
SHARDS = "path string, doc_ids_from long, n_docs long, n_ids long, n_bytes long"
DOCUMENTS = "doc_id long, start long, n_tokens long, ids binary"
DOCUMENT_BATCH = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary())])


def to_planes(ids: np.ndarray, plane: str) -> list[bytes]:
    """The planes of a block, lowest first."""
    by_byte = np.ascontiguousarray(ids, "<u4").view("u1").reshape(-1, 4)
    if plane == "byte":
        return [np.ascontiguousarray(by_byte[:, k]).tobytes() for k in range(4)]
    bits = np.unpackbits(by_byte, axis=1, bitorder="little")
    return [np.packbits(bits[:, k]).tobytes() for k in range(32)]


def from_planes(planes: list[bytes], n_ids: int) -> np.ndarray:
    if len(planes) == 4:
        by_byte = np.stack([np.frombuffer(p, "u1") for p in planes], axis=1)
    else:
        bits = np.stack([np.unpackbits(np.frombuffer(p, "u1"), count=n_ids) for p in planes], axis=1)
        by_byte = np.packbits(bits, axis=1, bitorder="little")
    return np.ascontiguousarray(by_byte).reshape(-1).view("<u4")


class ShardWriter:
    """Streams ids into one shard; holds one block at most."""

    def __init__(self, out, plane: str, block_ids: int):
        self.out, self.plane, self.block_ids = out, plane, block_ids
        self.packer = zstandard.ZstdCompressor(level=LEVEL)
        self.held, self.n_held, self.at, self.n_ids = [], 0, len(MAGIC), 0
        self.chunks, self.doc_ids, self.lengths = [], [], []
        out.write(MAGIC)

    def add(self, doc_id: int | None, ids: bytes) -> None:
        new = np.frombuffer(ids, "<u4")
        self.doc_ids.append(doc_id)
        self.lengths.append(len(new))
        while len(new):
            part = new[: self.block_ids - self.n_held]
            self.held.append(part)
            self.n_held += len(part)
            new = new[len(part):]
            if self.n_held == self.block_ids:
                self.flush()

    def flush(self) -> None:
        if not self.n_held:
            return
        frames = [self.packer.compress(p) for p in to_planes(np.concatenate(self.held), self.plane)]
        self.chunks.append([self.n_ids, self.n_held, self.at, *map(len, frames)])
        for f in frames:
            self.out.write(f)
            self.at += len(f)
        self.n_ids += self.n_held
        self.held, self.n_held = [], 0

    def close(self) -> None:
        self.flush()
        index = np.array(self.chunks, "<i8")
        known = np.array([i is not None for i in self.doc_ids], "u1")
        doc_ids = np.array([i or 0 for i in self.doc_ids], "<i8")
        lengths = np.array(self.lengths, "<i8")
        head = struct.pack("<3q", len(self.chunks), 4 if self.plane == "byte" else 32, len(lengths))
        footer = self.packer.compress(b"".join([head, index.tobytes(), known.tobytes(), doc_ids.tobytes(),
                                                lengths.tobytes()]))
        self.out.write(footer + struct.pack("<Q", len(footer)) + MAGIC)
        self.at += len(footer) + 12
        self.out.close()


class ShardReader:
    """A shard by its footer; ``ids`` reads only the blocks that a range touches."""

    def __init__(self, source):
        self.source = source
        size = source.size()
        source.seek(size - 12)
        length, magic = struct.unpack("<Q4s", source.read(12))
        if magic != MAGIC:
            raise ValueError("not a whole shard")
        source.seek(size - 12 - length)
        self.unpacker = zstandard.ZstdDecompressor()
        footer = self.unpacker.decompress(source.read(length))
        n_chunks, n_planes, n_docs = struct.unpack_from("<3q", footer)
        at = 24
        self.index = np.frombuffer(footer, "<i8", n_chunks * (3 + n_planes), at).reshape(n_chunks, 3 + n_planes)
        at += self.index.nbytes
        known = np.frombuffer(footer, "u1", n_docs, at)
        doc_ids = np.frombuffer(footer, "<i8", n_docs, at + n_docs)
        self.doc_ids = [int(i) if k else None for i, k in zip(doc_ids, known)]
        self.lengths = np.frombuffer(footer, "<i8", n_docs, at + 9 * n_docs)
        self.cached: tuple[int, np.ndarray] = (-1, np.empty(0, "<u4"))

    def block(self, k: int) -> np.ndarray:
        if self.cached[0] != k:
            _, n_ids, at, *sizes = map(int, self.index[k])
            self.source.seek(at)
            raw, planes = self.source.read(sum(sizes)), []
            for s in sizes:
                planes.append(self.unpacker.decompress(raw[:s]))
                raw = raw[s:]
            self.cached = (k, from_planes(planes, n_ids))
        return self.cached[1]

    def ids(self, start: int, length: int) -> bytes:
        """Ids ``start .. start + length`` of the stream."""
        parts, k = [], int(np.searchsorted(self.index[:, 0], start, "right")) - 1
        while length:
            part = self.block(k)[start - int(self.index[k, 0]):][:length]
            parts.append(part.tobytes())
            start, length, k = start + len(part), length - len(part), k + 1
        return b"".join(parts)


def write_planes(docs: DataFrame, folder: str, tokenizer: str, end_id: int = 0, plane: str = "byte",
                 block_ids: int = BLOCK_IDS, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Writes the ids of whole texts, ``end_id`` after each, in ascending document id; returns the shards.

    A null or empty text is one end id. A null id comes first; rows of one id follow each other by text.
    No document gives no shard. Other columns are left alone. A shard is what one task of the range
    partitioning holds, so its size follows ``spark.sql.shuffle.partitions`` and the adaptive settings.
    """
    if plane not in ("byte", "bit"):
        raise ValueError("plane is byte or bit")

    def write(incoming: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer, path, end = None, "", struct.pack("<I", end_id)
        for doc_id, text in files.rows_of(incoming):
            if writer is None:
                path, out = files.new_file(folder, "shard", ".planes")
                writer = ShardWriter(out, plane, block_ids)
            writer.add(doc_id, next(encoder(tokenizer).encode([text])) + end)
        if writer:
            writer.close()
            ids = [i for i in writer.doc_ids if i is not None]
            row = (path, min(ids) if len(ids) == len(writer.doc_ids) else None, len(writer.doc_ids), writer.n_ids,
                   writer.at)
            yield files.batch([row], pa.schema([("path", pa.string()), *(
                (c, pa.int64()) for c in ("doc_ids_from", "n_docs", "n_ids", "n_bytes"))]))

    by_id = F.col("doc_id").asc_nulls_first()
    shards = (
        docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text"))
        .repartitionByRange(by_id)
        .sortWithinPartitions(by_id, "text")
        .mapInArrow(write, SHARDS)
    )
    shards.write.parquet(f"{folder}/shards")
    return docs.sparkSession.read.parquet(f"{folder}/shards")


def read_planes(spark: SparkSession, folder: str) -> DataFrame:
    """Every document of the shards: doc_id, start (ids before it), n_tokens, ids (little-endian u32)."""

    def read(incoming: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for path, base in files.rows_of(incoming):
                with files.open_file(path) as source:
                    shard, start = ShardReader(source), 0
                    for doc_id, length in zip(shard.doc_ids, map(int, shard.lengths)):
                        yield doc_id, base + start, length, shard.ids(start, length)
                        start += length

        yield from files.batches(rows(), DOCUMENT_BATCH, lambda r: len(r[-1]))

    shards = spark.read.parquet(f"{folder}/shards")
    # one row per shard
    before = F.coalesce(F.sum("n_ids").over(
        Window.orderBy(F.col("doc_ids_from").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # more partitions than shards, or hashing would put several shards into one task
    tasks = shards.select("path", before.alias("base")).repartition(2 * max(1, shards.count()), "path")
    return tasks.mapInArrow(read, DOCUMENTS)
