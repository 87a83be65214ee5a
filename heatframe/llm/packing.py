"""Best-fit packing of documents into sequences by a tree of rounds (operator 6).

Every task packs its own pieces best-fit decreasing and emits the nearly full bins. What is underfull goes
on as items of the next round, where fewer tasks, each with a bounded number of bins, pack them again, until
one task has seen all that is left. A bin holds at most ``capacity`` pieces, which travel with it.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heatframe.llm import files
from heatframe.llm.tokens import encoder

PIECE = pa.struct([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()),
                   ("ids_crc32", pa.int64())])
BINS = pa.schema([("bin_id", pa.int64()), ("filled", pa.int64()), ("open", pa.bool_()), ("pieces", pa.list_(PIECE))])
BINS_SQL = ("bin_id long, filled long, open boolean, pieces array<struct<doc_id: long, piece: int, start: long,"
            " length: long, ids_crc32: long>>")
GROUP = 50_000
NEARLY_FULL = 0.99
LEAST_GAIN = 0.05
ROUND_BITS, TASK_BITS = 57, 30


def best_fit(lengths: list[int], capacity: int) -> list[list[int]]:
    """Best-fit decreasing: positions of the items in every bin. Each length is 0 < length <= capacity."""
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms = 0  # bit r: a bin with r places left exists
    bins: list[list[int]] = []
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        fits = rooms >> lengths[i]
        if fits:
            room = lengths[i] + (fits & -fits).bit_length() - 1
            b = by_room[room].pop()
            if not by_room[room]:
                rooms &= ~(1 << room)
        else:
            room, b = capacity, len(bins)
            bins.append([])
        bins[b].append(i)
        room -= lengths[i]
        if room:
            by_room[room].append(b)
            rooms |= 1 << room
    return bins


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n tokens: only the first may be shorter than the capacity."""
    first = n % capacity or min(n, capacity)
    return [(0, first), *((s, capacity) for s in range(first, n, capacity))] if n else []


def _pack(items: Iterator[tuple[int, list]], capacity: int, turn: int) -> Iterator[tuple]:
    """Packs (filled, pieces) items in lots of at most GROUP; rows of BINS."""
    task, made = TaskContext.get().partitionId(), 0

    def lot(held):
        nonlocal made
        for members in best_fit([h[0] for h in held], capacity):
            filled = sum(held[m][0] for m in members)
            pieces = [p for m in members for p in held[m][1]]
            yield (turn << ROUND_BITS) + (task << TASK_BITS) + made, filled, filled < NEARLY_FULL * capacity, pieces
            made += 1

    held = []
    for filled, pieces in items:
        if filled == capacity:
            yield (turn << ROUND_BITS) + (task << TASK_BITS) + made, filled, False, pieces
            made += 1
            continue
        held.append((filled, pieces))
        if len(held) == GROUP:
            yield from lot(held)
            held = []
    yield from lot(held)


def _size(row: tuple) -> int:
    return 80 * len(row[-1])


def pack_documents(docs: DataFrame, folder: str, tokenizer: str, capacity: int = 1024, end_id: int = 2,
                   id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Places the tokens of whole texts, ``end_id`` after each, into sequences of at most ``capacity`` tokens.

    Only documents longer than a sequence are cut; their first piece may be shorter. Returns a row per piece:
    doc_id, piece, start, length, ids_crc32, sequence_id, offset. Null and empty texts are an end id alone; rows
    with one id (or none) are documents of their own; no document gives no sequence.
    """

    def first_round(incoming: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        end = struct.pack("<I", end_id)

        def items():
            for doc_id, text in files.rows_of(incoming):
                ids = next(encoder(tokenizer).encode([text])) + end
                for k, (start, length) in enumerate(cut(len(ids) // 4, capacity)):
                    crc = zlib.crc32(memoryview(ids)[4 * start: 4 * (start + length)])
                    yield length, [(doc_id, k, start, length, crc)]

        yield from files.batches(_pack(items(), capacity, 0), BINS, _size)

    chosen = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text"))
    chosen.mapInArrow(first_round, BINS_SQL).write.parquet(f"{folder}/round-0")
    return sequences(docs.sparkSession, merge_rounds(docs.sparkSession, folder, capacity))


def merge_rounds(spark: SparkSession, folder: str, capacity: int) -> list[str]:
    """Packs the underfull bins of round 0 again and again; returns the folders with the bins that stay."""
    turn, kept = 0, []
    while True:
        before = spark.read.parquet(f"{folder}/round-{turn}")
        kept.append((f"{folder}/round-{turn}", False))
        underfull = before.where("open")
        n = underfull.count()
        groups = -(-n // GROUP)
        if n == 0 or turn and groups_before == 1 or turn and n > (1 - LEAST_GAIN) * n_before:
            kept[-1] = (kept[-1][0], True)
            return kept
        turn += 1
        if turn >= 1 << (62 - ROUND_BITS):
            raise ValueError("too many rounds")
        groups_before, n_before = groups, n

        def again(incoming: Iterable[pa.RecordBatch], turn=turn) -> Iterator[pa.RecordBatch]:
            def items():
                for filled, pieces in files.rows_of(incoming):
                    yield filled, [tuple(p.values()) for p in pieces]

            yield from files.batches(_pack(items(), capacity, turn), BINS, _size)

        dealt = underfull.select("filled", "pieces").repartition(groups)
        dealt.mapInArrow(again, BINS_SQL).write.parquet(f"{folder}/round-{turn}")


def sequences(spark: SparkSession, kept: list[tuple[str, bool]]) -> DataFrame:
    """The pieces of all bins that stay: the closed ones of every round, and the open ones of the last."""
    bins = None
    for path, with_open in kept:
        own = spark.read.parquet(path)
        own = own if with_open else own.where("NOT open")
        bins = own if bins is None else bins.unionByName(own)
    running = F.expr("transform(pieces, (p, i) -> aggregate(slice(pieces, 1, i), 0L, (s, q) -> s + q.length))")
    placed = bins.select("bin_id", F.explode(F.arrays_zip(F.col("pieces").alias("p"), running.alias("offset"))).alias("x"))
    return placed.select("x.p.doc_id", "x.p.piece", "x.p.start", "x.p.length", "x.p.ids_crc32",
                         F.col("bin_id").alias("sequence_id"), "x.offset")
