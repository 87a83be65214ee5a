"""Benchmark decontamination (operator 4).

The windows of n consecutive words of all benchmark items are hashed and broadcast once their number is known
to be small; beyond that they are dealt out in as many passes as needed. Tasks scan the word windows of whole
documents against the sorted hashes, verify every hit on the words themselves, and mark the words inside.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heatframe.llm import files
from heatframe.llm.words import LOWERED, NOT_ALNUM, lots, window_hashes

WINDOW = 10
PASS_BYTES = 64 << 20  # benchmark text that one pass broadcasts at most
FOUND = pa.schema([("doc_id", pa.int64()), ("text_hash", pa.int64()), ("n_words", pa.int64()),
                   ("spans", pa.list_(pa.list_(pa.int64()))), ("items", pa.list_(pa.string()))])


class Windows:
    """All windows of the items: for every window length, sorted hashes, the words, and whose they are."""

    def __init__(self, items: list[tuple[str, str | None]], n: int):
        by_length: dict[int, dict[int, tuple[bytes, set[str]]]] = {}
        column = pa.array([t or "" for _, t in items], pa.string())
        for lot in lots(column, NOT_ALNUM, LOWERED):
            for k in range(lot.rows.stop - lot.rows.start):
                item, a, b = items[lot.rows.start + k][0], lot.bounds[k], lot.bounds[k + 1]
                size = min(n, b - a)
                if not size:
                    continue
                for i, h in enumerate(window_hashes(lot.of(k), size).tolist()):
                    words = _words(lot, a + i, size)
                    by_length.setdefault(int(size), {}).setdefault(h, (words, set()))[1].add(item)
        self.by_length = [(size, np.array(sorted(found), "u8"), found) for size, found in sorted(by_length.items())]


def _words(lot, first: int, n: int) -> bytes:
    return b" ".join(lot.data[lot.starts[i]:lot.ends[i]].tobytes() for i in range(first, first + n))


def find_overlaps(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, pass_bytes: int = PASS_BYTES,
                  id_column: str = "doc_id", text_column: str = "text", item_column: str = "item_id",
                  item_text: str = "text") -> DataFrame:
    """doc_id, n_words, spans and items of every document.

    spans   [first word, word after the last] of the merged runs of words inside windows that an item has too
    items   ids (as strings, sorted) of the items with such a window; null item ids don't count as items
    Words are [^\\x00-/:-`{-\\x7F]+ of the text with A-Z lower-cased. An item of fewer words than ``window`` is one
    window, one without words none. Null and empty texts have no words; repeated rows are judged one by one.
    """
    chosen = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text"))
    parts = _parts(benchmark, pass_bytes, item_column, item_text)
    if len(parts) == 1:
        return _scan(chosen, parts[0], window).drop("text_hash")
    # beyond one broadcast: a scan for each part of the benchmark, its results merged by document
    found = None
    for part in parts:
        one = _scan(chosen, part, window)
        found = one if found is None else found.unionByName(one)
    merged = found.groupBy("doc_id", "text_hash", "n_words").agg(
        F.array_sort(F.flatten(F.collect_set("spans"))).alias("spans"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"),
        F.count("*").alias("n"))
    # equal rows were merged and come back as often as they were there
    return merged.select("doc_id", "n_words", _merge_spans("spans").alias("spans"), "items", F.explode(
        F.expr(f"sequence(1L, n div {len(parts)})"))).drop("col")


def _parts(benchmark: DataFrame, pass_bytes: int, item_column: str, item_text: str) -> list[DataFrame]:
    """The items in parts of about ``pass_bytes`` of text."""
    known = benchmark.where(F.col(item_column).isNotNull()).select(
        F.col(item_column).cast("string").alias("item"), F.col(item_text).alias("text"))
    size = known.agg(F.sum(F.octet_length("text") + 64)).first()[0] or 0
    n = -(-size // pass_bytes) or 1
    return [known.where(F.pmod(F.xxhash64("item", "text"), F.lit(n)) == p) for p in range(n)] if n > 1 else [known]


def _merge_spans(column: str):
    """Sorted spans with overlapping and touching ones joined."""
    return F.expr(f"""aggregate({column}, cast(array() as array<array<bigint>>), (done, s) ->
        if(size(done) > 0 and s[0] <= element_at(done, -1)[1],
           concat(slice(done, 1, size(done) - 1),
                  array(array(element_at(done, -1)[0], greatest(s[1], element_at(done, -1)[1])))),
           concat(done, array(s))))""")


def _scan(docs: DataFrame, items: DataFrame, window: int) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(Windows([tuple(r) for r in items.collect()], window))

    def scan(incoming: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for b in incoming:
                ids, numbers = b.column(0).to_pylist(), b.column(2).to_pylist()
                for lot in lots(b.column(1), NOT_ALNUM, LOWERED):
                    hits, items = _hits(lot, shared.value)
                    for k in range(lot.rows.stop - lot.rows.start):
                        a, z = int(lot.bounds[k]), int(lot.bounds[k + 1])
                        spans = [] if k not in items else _spans(hits[a:z])
                        yield (ids[lot.rows.start + k], numbers[lot.rows.start + k], z - a, spans,
                               sorted(items.get(k, ())))

        yield from files.batches(rows(), FOUND, lambda r: 40 * len(r[3]) + 16 * len(r[4]))

    return docs.select("doc_id", "text", F.xxhash64("text")).mapInArrow(
        scan, "doc_id long, text_hash long, n_words long, spans array<array<long>>, items array<string>")


def _hits(lot, windows: Windows) -> tuple[np.ndarray, dict[int, set[str]]]:
    """Words inside windows of items, and the items by text."""
    hit = np.zeros(len(lot.hashes), bool)
    items: dict[int, set[str]] = {}
    for size, hashes, found in windows.by_length:
        own = window_hashes(lot.hashes, size)
        if not len(own):
            continue
        place = np.minimum(np.searchsorted(hashes, own), len(hashes) - 1)
        for i in np.flatnonzero(hashes[place] == own).tolist():
            k = int(np.searchsorted(lot.bounds, i, "right")) - 1
            if i + size > lot.bounds[k + 1]:
                continue  # reaches into the next text
            words, whose = found[int(own[i])]
            if words == _words(lot, i, size):
                hit[i:i + size] = True
                items.setdefault(k, set()).update(whose)
    return hit, items


def _spans(hit: np.ndarray) -> list[list[int]]:
    edges = np.flatnonzero(np.diff(np.concatenate([[False], hit, [False]]).astype("i1")))
    return edges.reshape(-1, 2).tolist()


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, pass_bytes: int = PASS_BYTES,
                      text_column: str = "text", item_column: str = "item_id", item_text: str = "text") -> DataFrame:
    """The documents without any benchmark window, all their columns kept, in one pass for each part of the benchmark."""
    names = docs.columns
    if names.count(text_column) != 1:
        raise ValueError(f"{text_column} is not one column")
    at = names.index(text_column)
    for part in _parts(benchmark, pass_bytes, item_column, item_text):
        shared = docs.sparkSession.sparkContext.broadcast(Windows([tuple(r) for r in part.collect()], window))

        def keep(incoming: Iterable[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for b in incoming:
                clean = np.ones(b.num_rows, bool)
                for lot in lots(b.column(at), NOT_ALNUM, LOWERED):
                    for k in _hits(lot, shared.value)[1]:
                        clean[lot.rows.start + k] = False
                yield b.filter(pa.array(clean))

        docs = docs.mapInArrow(keep, docs.schema)
    return docs


def remove_spans(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, id_column: str = "doc_id",
                 text_column: str = "text") -> DataFrame:
    """doc_id and kept: every text, lower-cased A-Z, without the runs of words inside benchmark windows."""
    part = _parts(benchmark, 1 << 62, "item_id", "text")[0]
    if (benchmark.agg(F.sum(F.octet_length("text") + 64)).first()[0] or 0) > PASS_BYTES:
        raise ValueError("the benchmark is larger than one broadcast: use find_overlaps and its spans")
    shared = docs.sparkSession.sparkContext.broadcast(Windows([tuple(r) for r in part.collect()], window))
    schema = pa.schema([("doc_id", pa.int64()), ("kept", pa.string())])

    def cut(incoming: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for b in incoming:
                ids = b.column(0).to_pylist()
                for lot in lots(b.column(1), NOT_ALNUM, LOWERED):
                    hits, items = _hits(lot, shared.value)
                    for k in range(lot.rows.stop - lot.rows.start):
                        a, z = int(lot.bounds[k]), int(lot.bounds[k + 1])
                        text = lot.data[lot.texts[k]:lot.texts[k + 1]].tobytes()
                        for s, e in reversed(_spans(hits[a:z]) if k in items else []):
                            first, last = (int(lot.starts[a + s] - lot.texts[k]), int(lot.ends[a + e - 1] - lot.texts[k]))
                            text = text[:first] + text[last:]
                        yield ids[lot.rows.start + k], text.decode()

        yield from files.batches(rows(), schema, lambda r: len(r[1]))

    chosen = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text"))
    return chosen.mapInArrow(cut, "doc_id long, kept string")
