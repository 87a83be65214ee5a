"""Removal of repeated word passages by winnowed anchors (operator 10).

Every window of ``width`` words names an anchor, the smallest hash among its runs of ``seed`` words, so equal windows
name equal anchors. Documents meet at anchors. An occurrence is extended both ways as far as the windows reach that
name it: where the whole extension is the same, the smallest document keeps it and the others lose it. Occurrences of
a shared anchor with different extensions are compared window by window.

Before anything is shuffled a lot of documents resolves what it holds itself and sends one row for each extension.
An anchor with many extensions in a lot sends its windows at once, and a mark that all of it is to be compared so.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from heatframe.llm import files
from heatframe.llm.words import BASE, WHITE, Lot, lots, mix, window_hashes

WIDTH, SEED = 13, 6
LOT_BYTES = 2 << 20  # some 25 bytes of arrays for each in a Python worker
MANY_EXTENSIONS = 64
BATCH_ROWS = 1 << 16
BROADCAST_BYTES = 48 << 20
ANCHOR, MARK, WINDOW, REMOVED, OPEN = range(5)
ROWS = "kind int, key long, extension long, doc long, place long"
NAMES = ["kind", "key", "extension", "doc", "place"]
# A place is a tag of the text, the first window of a run and its further windows.
RUN_BITS, START_BITS = 4, 31
RUN_MASK, START_MASK = (1 << RUN_BITS) - 1, (1 << START_BITS) - 1


class Runs:
    """Windows of all texts of a lot and their runs by anchor."""

    def __init__(self, lot: Lot, width: int, seed: int):
        self.lot, self.width = lot, width
        self.windows = window_hashes(lot.hashes, width)
        counts = np.diff(lot.bounds)
        self.text = np.repeat(np.arange(len(counts)), counts)
        n = len(self.windows)
        whole = self.text[:n] == self.text[len(self.text) - n:] if n else np.zeros(0, bool)
        self.tags = np.zeros(len(counts), "i8")
        busy = counts > 0
        if busy.any():
            sums = np.add.reduceat(mix(lot.hashes + np.arange(len(lot.hashes), dtype="u8")
                                       - lot.bounds[self.text].astype("u8")), lot.bounds[:-1][busy])
            self.tags[busy] = (sums >> np.uint64(64 - 28)).astype("i8")
        if not whole.any():
            self.first = self.last = self.anchor = np.zeros(0, "i8")
            return
        seeds = window_hashes(lot.hashes, seed)
        view = np.lib.stride_tricks.sliding_window_view(seeds, width - seed + 1)
        anchor = np.arange(n) + view.argmin(axis=1)
        at = np.flatnonzero(whole)
        new = np.ones(len(at), bool)
        new[1:] = (anchor[at[1:]] != anchor[at[:-1]]) | (at[1:] != at[:-1] + 1)
        self.first, self.last = at[new], at[np.append(np.flatnonzero(new)[1:] - 1, len(at) - 1)]
        self.anchor = seeds[anchor[self.first]].view("i8")

    def extension(self) -> np.ndarray:
        """A hash of all words of a run's windows: the first and the last window overlap and cover them."""
        length = (self.last - self.first).astype("u8")
        return mix(self.windows[self.first] * BASE + self.windows[self.last] + length).view("i8")

    def place(self, first: np.ndarray, further: np.ndarray) -> np.ndarray:
        text = self.text[first]
        start = first - self.lot.bounds[text]
        return (self.tags[text] << (RUN_BITS + START_BITS)) | (start << RUN_BITS) | further


def _resolved(key: np.ndarray, extension: np.ndarray, doc: np.ndarray, place: np.ndarray):
    """Within a lot: which rows stay (the smallest document of each key and extension) and which are removed."""
    order = np.lexsort((doc, extension, key))
    key, extension, doc, place = key[order], extension[order], doc[order], place[order]
    first = np.ones(len(key), bool)
    first[1:] = (key[1:] != key[:-1]) | (extension[1:] != extension[:-1])
    smallest = doc[np.maximum.accumulate(np.where(first, np.arange(len(key)), 0))] if len(key) else doc
    # the smallest document may hold it more than once, and each of its places stays
    return first, doc > smallest, (key, extension, doc, place)


def _batch(kind: int, key, extension, doc, place) -> pa.RecordBatch:
    return pa.record_batch([pa.array(np.full(len(key), kind, "i4")), *(pa.array(np.asarray(x, "i8")) for x in (
        key, extension, doc, place))], NAMES)


def _removed(doc: np.ndarray, place: np.ndarray) -> pa.RecordBatch:
    # spread over partitions by their document and place
    key = mix(doc.astype("u8") * BASE + place.astype("u8")).view("i8")
    return _batch(REMOVED, key, np.zeros(len(doc), "i8"), doc, place)


class SubstringDedup:
    def __init__(self, docs: DataFrame, folder: str, width: int = WIDTH, seed: int = SEED,
                 id_column: str = "doc_id", text_column: str = "text"):
        if not 0 < seed <= width or width - seed > RUN_MASK:
            raise ValueError("a seed is shorter than the window by 15 words at most")
        self.spark, self.folder, self.width, self.seed = docs.sparkSession, folder, width, seed
        self.docs = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text"))

    def written(self, df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{self.folder}/{name}")
        return self.spark.read.parquet(f"{self.folder}/{name}")

    def run(self) -> DataFrame:
        """doc_id, n_words, n_removed, kept (the words that stay, joined by a space)."""
        met = self.written(self._met(), "met")
        windows = self._open_windows(met.where(F.col("kind") == OPEN)).union(
            met.where(F.col("kind") == WINDOW).select("kind", "key", "doc", "place"))
        smallest = F.min(F.when(F.col("kind") == WINDOW, F.col("doc"))).over(Window.partitionBy("key"))
        lost = windows.withColumn("smallest", smallest).where(
            (F.col("kind") == REMOVED) | (F.col("doc") > F.col("smallest"))).select("doc", "place")
        lost = met.where(F.col("kind") == REMOVED).select("doc", "place").union(lost)
        spans = self.written(self._spans(lost), "spans")
        return self._kept(spans)

    def _met(self) -> DataFrame:
        """Rows of kinds REMOVED (doc, place), OPEN (doc, place) and WINDOW (key, doc, place)."""
        width, seed = self.width, self.seed

        def scan(incoming: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for ids, lot in _known(incoming):
                runs = Runs(lot, width, seed)
                if not len(runs.first):
                    continue
                doc = ids[runs.text[runs.first]]
                further = runs.last - runs.first
                rows = (runs.anchor, runs.extension(), doc, runs.place(runs.first, further))
                order = np.lexsort((doc, rows[1], rows[0]))
                first, later, (key, extension, doc, place) = _resolved(*rows)
                yield _removed(doc[later], place[later])
                # anchors with many extensions
                own = np.ones(len(key), bool)
                own[1:] = key[1:] != key[:-1]
                group = np.cumsum(own) - 1
                many = (np.bincount(group, first) > MANY_EXTENSIONS)[group]
                stay = ~later & ~many
                yield _batch(ANCHOR, key[stay], extension[stay], doc[stay], place[stay])
                if many.any():
                    marks = key[many & own]
                    yield _batch(MARK, marks, np.zeros(len(marks)), np.zeros(len(marks)), np.zeros(len(marks)))
                    kept = order[many & ~later]
                    yield from _windows(runs, ids, _each(runs.first[kept], runs.last[kept]))

        rows = self.docs.mapInArrow(scan, ROWS)
        by_key = Window.partitionBy("key", "is_window")
        anchor = F.col("kind") == ANCHOR
        met = rows.withColumn("is_window", F.col("kind") == WINDOW)
        met = met.withColumns({
            "low": F.min(F.when(anchor, F.col("extension"))).over(by_key),
            "high": F.max(F.when(anchor, F.col("extension"))).over(by_key),
            "marked": F.max(F.col("kind") == MARK).over(by_key)})
        met = met.withColumn("smallest", F.min("doc").over(Window.partitionBy("key", "is_window", "kind", "extension")))
        lost = anchor & (F.col("doc") > F.col("smallest"))
        several = anchor & ((F.col("low") != F.col("high")) | F.col("marked"))
        kind = (F.when(lost, REMOVED).when(several, OPEN).when(F.col("kind").isin(REMOVED, WINDOW), F.col("kind")))
        return met.select(kind.alias("kind"), "key", "doc", "place").where("kind IS NOT NULL")

    def _open_windows(self, open_rows: DataFrame) -> DataFrame:
        """kind (WINDOW or REMOVED), key, doc, place of every window of the open runs."""
        width, seed = self.width, self.seed

        def scan(incoming: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for ids, lot, (places,) in _known(incoming, 2):
                runs = Runs(lot, width, seed)
                if not len(runs.first):
                    continue
                own = runs.place(runs.first, runs.last - runs.first)
                wanted = np.zeros(len(own), bool)
                # runs are in the order of their texts
                cuts = np.searchsorted(runs.text[runs.first], np.arange(len(lot.bounds)))
                for k, at in enumerate(places):
                    part = slice(cuts[k], cuts[k + 1])
                    wanted[part] = np.isin(own[part], np.array(at, "i8"))
                yield from (b.select(["kind", "key", "doc", "place"]) for b in _windows(
                    runs, ids, _each(runs.first[wanted], runs.last[wanted])))

        by_doc = open_rows.groupBy("doc").agg(F.collect_list("place").alias("places"))
        return self._with_text(self.written(by_doc, "open"), "places").mapInArrow(
            scan, "kind int, key long, doc long, place long")

    def _with_text(self, by_doc: DataFrame, lists: str, how: str = "inner") -> DataFrame:
        """doc_id, text and the lists of by_doc; broadcast if its size allows, beyond that shuffled by document."""
        size = by_doc.agg(F.sum(F.size(lists) * 8 + 64)).first()[0] or 0
        if size <= BROADCAST_BYTES:
            by_doc = F.broadcast(by_doc)
        return self.docs.join(by_doc, self.docs["doc_id"] == by_doc["doc"], how).select("doc_id", "text", lists)

    def _spans(self, lost: DataFrame) -> DataFrame:
        """doc and spans: its lost words as a flat list of (tag, first, stop), overlapping and touching ones merged.
        A document has no more lost places than words."""
        width = self.width
        schema = pa.schema([("doc", pa.int64()), ("spans", pa.list_(pa.int64()))])

        def merge(incoming: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            def rows():
                for doc, places in files.rows_of(incoming):
                    at = np.sort(np.array(places, "i8"))
                    tag, first = at >> (RUN_BITS + START_BITS), (at >> RUN_BITS) & START_MASK
                    stop = first + (at & RUN_MASK) + width
                    # within a tag, places are in order and so are their reaches, but for runs within longer ones
                    reach = np.maximum.accumulate(stop + (tag << START_BITS)) - (tag << START_BITS)
                    new = np.ones(len(at), bool)
                    new[1:] = (tag[1:] != tag[:-1]) | (first[1:] > reach[:-1])
                    ends = np.append(np.flatnonzero(new)[1:] - 1, len(at) - 1)
                    yield doc, np.stack([tag[new], first[new], reach[ends]], axis=1).reshape(-1).tolist()

            yield from files.batches(rows(), schema, lambda r: 8 * len(r[1]))

        places = lost.groupBy("doc").agg(F.collect_set("place").alias("places"))
        return places.mapInArrow(merge, "doc long, spans array<long>")

    def _kept(self, spans: DataFrame) -> DataFrame:
        width = self.width
        schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()),
                            ("kept", pa.string())])

        def cut(incoming: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            def rows():
                for b in incoming:
                    ids = b.column(0).to_pylist()
                    for lot in lots(b.column(1), WHITE):
                        spans = b.column(2).slice(lot.rows.start, lot.rows.stop - lot.rows.start).to_pylist()
                        tags = Runs(lot, width, width).tags if any(spans) else None
                        for k, own in enumerate(spans):
                            a, z = int(lot.bounds[k]), int(lot.bounds[k + 1])
                            stay = np.ones(z - a, bool)
                            for tag, first, stop in np.array(own or [], "i8").reshape(-1, 3).tolist():
                                if tag == tags[k]:
                                    stay[first:stop] = False
                            words = [lot.data[lot.starts[i]:lot.ends[i]].tobytes() for i in a + np.flatnonzero(stay)]
                            yield ids[lot.rows.start + k], z - a, z - a - len(words), b" ".join(words).decode()

            yield from files.batches(rows(), schema, lambda r: len(r[-1]))

        return self._with_text(spans, "spans", "left").mapInArrow(
            cut, "doc_id long, n_words long, n_removed long, kept string")


def _known(incoming: Iterable[pa.RecordBatch], *columns: int) -> Iterator[tuple]:
    """ids and words of the documents that have an id; further columns as lists."""
    for b in incoming:
        b = b.filter(b.column(0).is_valid())
        ids = b.column(0).to_numpy(zero_copy_only=False)
        for lot in lots(b.column(1), WHITE, lot_bytes=LOT_BYTES):
            more = [b.column(c).slice(lot.rows.start, lot.rows.stop - lot.rows.start).to_pylist() for c in columns]
            yield (ids[lot.rows], lot, more) if columns else (ids[lot.rows], lot)


def _each(first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """All numbers of the ranges first..last."""
    length = last - first + 1
    return np.repeat(first - np.concatenate([[0], np.cumsum(length)[:-1]]), length) + np.arange(length.sum())


def _windows(runs: Runs, ids: np.ndarray, at: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Rows of single windows, resolved within the lot."""
    doc = ids[runs.text[at]]
    nothing = np.zeros(len(at), "i8")
    first, later, (key, extension, doc, place) = _resolved(
        runs.windows[at].view("i8"), nothing, doc, runs.place(at, nothing))
    for k in range(0, len(key), BATCH_ROWS):
        part = slice(k, k + BATCH_ROWS)
        stay, gone = ~later[part], later[part]
        yield _batch(WINDOW, key[part][stay], extension[part][stay], doc[part][stay], place[part][stay])
        yield _removed(doc[part][gone], place[part][gone])


def remove_repeats(docs: DataFrame, folder: str, width: int = WIDTH, seed: int = SEED, id_column: str = "doc_id",
                   text_column: str = "text") -> DataFrame:
    """doc_id, n_words, n_removed and kept of every row of docs.

    A word is removed if it lies in a window of ``width`` words whose sequence also starts in a document with a smaller
    id; windows are judged on the input. Words are runs of anything but space and \\x09-\\x0D, taken as they are. Null and
    empty texts and those without words keep the empty text. Rows without an id lose nothing and take nothing from
    others; rows of one id take nothing from each other. Other columns play no part.
    """
    return SubstringDedup(docs, folder, width, seed, id_column, text_column).run()
