"""Exact Jaccard components of word-shingle sets behind any signatures that linked sets share.

Work stays below all pairs. Sets that are equal are one class, known by the hash of the set, and signed once. A task sends
every signature once per lot. Members of a signature are compared with one pivot of it; only where that leaves several
components, the rest is compared, and only pairs that can still link: the rarest shingle that two sets share bounds
their overlap. What signatures let meet is verified on whole sets.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from functools import reduce
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, LongType, StructField, StructType

from heatframe.llm import files
from heatframe.llm.components import components
from heatframe.llm.words import AS_IS, BASE, LOWERED, WHITE, Lot, lots, mix, window_hashes

COUNTERS = 128
CELL_SHINGLES = 8
LOT_SIGNATURES = 1 << 21
PLACE_BITS = 16  # of a text in its lot; they fill the word that a signature leaves
BUCKET_SIGNATURES = 1 << 19
GROUP_BITS = 6  # of a bucket's ranges, as many as tasks can meet at a time
HELD_PAIRS = 1 << 20  # 18 bytes each
SIGNED_BESIDES = 100  # signatures that a set may have beside one for each shingle
SIGNATURE_BITS = 48  # short for the shuffle; a chance meeting is only one more candidate
PAIR_ROWS = 1 << 16
CLOSE_ROWS = 1 << 10
DEALS = 4  # of the shingles' values; one deal is shuffled at a time
BROADCAST_ROWS = 2_000_000  # at 48 bytes a row: below 100 MB

Signer = Callable[["Sets", np.ndarray], tuple[np.ndarray, np.ndarray]]


def shortened(signatures: np.ndarray) -> np.ndarray:
    """64-bit hashes as signatures of SIGNATURE_BITS."""
    return (signatures >> np.uint64(64 - SIGNATURE_BITS)).view("i8")


class Sets:
    """Distinct shingles of the texts of a lot: values, the text of each, sizes, and a hash of every set."""

    def __init__(self, lot: Lot, width: int):
        n = len(lot.bounds) - 1
        counts = np.diff(lot.bounds)
        values = window_hashes(lot.hashes, width)
        text = np.repeat(np.arange(n), counts)
        # a window belongs to the text of its first word if its last word does
        inside = text[:len(values)] == text[len(text) - len(values):]
        values, text = values[inside], text[:len(inside)][inside]
        few = np.flatnonzero((counts > 0) & (counts < width))
        if len(few):
            whole = [window_hashes(lot.of(k), int(counts[k]))[0] for k in few]
            values, text = np.append(values, np.array(whole, "u8")), np.append(text, few)
        order = np.lexsort((values, text))
        values, text = values[order], text[order]
        new = np.ones(len(values), bool)
        new[1:] = (values[1:] != values[:-1]) | (text[1:] != text[:-1])
        self.values, self.text, self.n = values[new], text[new], n
        self.sizes = np.bincount(self.text, minlength=n)
        total = sums(mix(self.values * BASE), self.text, n)
        self.hashes = mix(total + self.sizes.astype("u8") * BASE).view("i8")
        self.bounds = np.searchsorted(self.text, np.arange(n + 1))

    def counts(self) -> list[bytes]:
        """Shingles of every set by cells of the domain, at most 255 each: a power of two of cells, COUNTERS or more
        and one for CELL_SHINGLES shingles or fewer. The cells' differences between two sets sum up to no more than their
        symmetric difference, and chance pairs of long sets differ by more than that may be."""
        bits = np.ceil(np.log2(np.maximum(self.sizes / CELL_SHINGLES, COUNTERS))).astype("i8")
        ends = np.cumsum(1 << bits)
        cell = (mix(self.values + np.uint64(7)) >> (64 - bits[self.text]).astype("u8")).astype("i8")
        found = np.minimum(np.bincount((ends - (1 << bits))[self.text] + cell, minlength=int(ends[-1]) if self.n else 0), 255).astype("u1")
        return [found[e - n:e].tobytes() for e, n in zip(ends.tolist(), (1 << bits).tolist())]

    def of(self, k: int) -> np.ndarray:
        return self.values[self.bounds[k]:self.bounds[k + 1]].view("i8")


def sums(values: np.ndarray, place: np.ndarray, n: int) -> np.ndarray:
    """Sums modulo 2**64 by place; exact as the halves' sums stay below 2**53."""
    low = np.bincount(place, (values & np.uint64(0xFFFFFFFF)).astype("f8"), n)
    high = np.bincount(place, (values >> np.uint64(32)).astype("f8"), n)
    return low.astype("u8") + (high.astype("u8") << np.uint64(32))


class SetJoin:
    """The join's settings and steps; the tables of every step lie below ``folder``. Sets are known by their hashes."""

    def __init__(self, docs: DataFrame, folder: str, num: int, den: int, width: int,
                 separators: np.ndarray = WHITE, lower: bool = True, id_column: str = "doc_id",
                 text_column: str = "text"):
        if not 0 < num < den:
            raise ValueError("the similarity is a fraction between 0 and 1")
        self.spark, self.folder, self.num, self.den, self.width = docs.sparkSession, folder, num, den, width
        self.separators, self.letters = separators, LOWERED if lower else AS_IS
        self.docs = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text"))

    def signer(self) -> Callable[[], Signer]:
        """Makes, in a task, what gives the signatures of the chosen sets and the set of each."""
        raise NotImplementedError

    def written(self, df: DataFrame, name: str) -> DataFrame:
        return files.step_table(df, f"{self.folder}/{name}", files.BATCH_BYTES)

    def dropped(self, *names: str) -> None:
        for name in names:
            files.drop_table(f"{self.folder}/{name}")

    def run(self) -> DataFrame:
        """doc_id, n_shingles, component_id for every row; set_hash, and the component's own number."""
        self.sizes = self.written(self.docs.mapInArrow(self._sizes(), "doc_id long, n_shingles long, set_hash long, counts binary"), "sizes")
        self.classes = self.written(
            self.sizes.where("n_shingles > 0 AND doc_id IS NOT NULL").groupBy("set_hash").agg(
                F.min("doc_id").alias("id"), F.first("n_shingles").alias("m"), F.first("counts").alias("counts")), "classes")
        labels = self._links()
        named = self.classes.select(F.col("set_hash").alias("node"), "id").join(labels, "node")
        least = named.groupBy("component").agg(F.min("id").alias("component_id"))
        found = self.written(named.join(least, "component").select(F.col("node").alias("set_hash"), "component_id", "component"), "named")
        # only sets that link with others have a row here; of the others the copies meet their class
        alone = self.classes.join(found, "set_hash", "left_anti").select(
            "set_hash", F.col("id").alias("component_id"), F.col("set_hash").alias("component"))
        out = self.sizes.select("doc_id", "n_shingles", "set_hash").join(found.union(alone), "set_hash", "left")
        return out.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0), F.col(
            "component_id")).otherwise(F.col("doc_id")).alias("component_id"), "set_hash", "component")

    def _sizes(self):
        def sizes(incoming: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in incoming:
                for lot in lots(b.column(1), separators, letters):
                    sets = Sets(lot, width)
                    yield pa.record_batch([b.column(0).slice(lot.rows.start, sets.n), pa.array(sets.sizes, pa.int64()),
                                           pa.array(sets.hashes), pa.array(sets.counts(), pa.binary())],
                                          ["doc_id", "n_shingles", "set_hash", "counts"])

        separators, letters, width = self.separators, self.letters, self.width
        return sizes

    def with_sets(self, rows: DataFrame, text_column: str, set_name: str, words_name: str) -> DataFrame:
        """rows with the hash of their set and whether it has any shingle."""
        def add(incoming: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in incoming:
                for lot in lots(b.column(at), separators, letters):
                    sets = Sets(lot, width)
                    part = b.slice(lot.rows.start, sets.n)
                    yield pa.record_batch([*part.columns, pa.array(sets.hashes), pa.array(sets.sizes > 0)], [*b.schema.names, set_name, words_name])

        separators, letters, width, at = self.separators, self.letters, self.width, rows.columns.index(text_column)
        return rows.mapInArrow(add, StructType([*rows.schema.fields, StructField(set_name, LongType()), StructField(words_name, BooleanType())]))

    def _signed(self, known: DataFrame) -> DataFrame:
        """The rows to sign: all but those of ids that are no class's, as the class's own document signs its set."""
        copies = self.written(known.select("doc_id").distinct().join(
            self.classes.select(F.col("id").alias("doc_id")), "doc_id", "left_anti"), "copies")
        return self.docs.join(F.broadcast(copies) if copies.count() <= BROADCAST_ROWS else copies, "doc_id", "left_anti").select("doc_id", "text")

    def _candidates(self, known: DataFrame) -> DataFrame:
        """Document a and pivot p of all signatures that several documents share; many: a stands for others of its lot;
        level: 0 where nothing else has the signature, 1 where that is so within a lot, 2 where others have it.

        A lot's signatures travel sorted and packed, by ranges of their values (buckets) whose number grows with the
        input, so that a task holds one bucket at a time. A signature is one entry for each lot that has it. Buckets meet
        by 2**GROUP_BITS ranges, each in one task that gives a pair once, so that a pair's rows don't grow with the input.
        """
        separators, letters, width, signer = self.separators, self.letters, self.width, self.signer()
        total = self.sizes.where("n_shingles > 0").agg(F.sum(F.col("n_shingles") + SIGNED_BESIDES)).first()[0] or 0
        bits = max(GROUP_BITS, (total // BUCKET_SIGNATURES).bit_length())
        lot_signatures = LOT_SIGNATURES

        def sign(incoming: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            signatures, keys, members, size, texts = signer(), [], [], 0, 0
            for b in incoming:
                known = b.column(0).is_valid().to_numpy(zero_copy_only=False)
                ids = b.column(0).fill_null(0).to_numpy(zero_copy_only=False)
                for lot in lots(b.column(1), separators, letters):
                    sets = Sets(lot, width)
                    sig, text = signatures(sets, known[lot.rows])
                    for at in range(0, sets.n, 1 << PLACE_BITS):
                        own = ids[lot.rows][at:at + (1 << PLACE_BITS)]
                        if size >= lot_signatures or texts + len(own) > 1 << PLACE_BITS:
                            yield from _packed(keys, members, bits)
                            size = texts = 0
                        here = (text >= at) & (text < at + len(own))
                        keys.append(sig[here].view("u8") << np.uint64(PLACE_BITS) | (text[here] - at + texts).astype("u8"))
                        members.append(own)
                        size, texts = size + len(keys[-1]), texts + len(own)
            yield from _packed(keys, members, bits)

        def meet(incoming: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            def met():
                bucket, blobs = None, []
                for b in incoming:
                    for own, blob in zip(b.column(1).to_pylist(), b.column(2)):
                        if own != bucket and blobs:
                            yield _met(blobs)
                            blobs = []
                        bucket = own
                        blobs.append(blob.as_py())
                if blobs:
                    yield _met(blobs)

            yield from _once(met())

        rows = self._signed(known).mapInArrow(sign, "range int, bucket int, blob binary")
        return rows.repartition("range").sortWithinPartitions("bucket").mapInArrow(
            meet, "a long, p long, many boolean, level int").groupBy("a", "p").agg(
            F.max("many").alias("many"), F.max("level").alias("level"))

    def _shingles(self, wanted: DataFrame) -> DataFrame:
        """Of the sets in wanted (node): node, shingles (array<long>), once each; read from a class's first document."""
        separators, letters, width = self.separators, self.letters, self.width
        schema = pa.schema([("node", pa.int64()), ("shingles", pa.list_(pa.int64()))])

        def read(incoming: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            def rows():
                for b in incoming:
                    hashes = b.column(1).to_numpy(zero_copy_only=False)
                    for lot in lots(b.column(0), separators, letters):
                        sets = Sets(lot, width)
                        # rows of one id may hold several texts
                        for k in np.flatnonzero(sets.hashes == hashes[lot.rows]).tolist():
                            yield sets.hashes[k].item(), sets.of(k)

            yield from files.batches(rows(), schema, lambda r: 8 * len(r[1]))

        first = self.classes.select(F.col("set_hash").alias("node"), "id").join(wanted, "node")
        if wanted.count() <= BROADCAST_ROWS:
            first = F.broadcast(first)
        own = self.docs.join(first, self.docs["doc_id"] == first["id"]).select("text", "node")
        return own.mapInArrow(read, "node long, shingles array<long>").dropDuplicates(["node"])

    def _verified(self, pairs: DataFrame, name: str) -> DataFrame:
        """Those of pairs (a, p) that link; every pair is compared on its whole sets."""
        sets = self.written(self._shingles(self.written(
            pairs.select(F.col("a").alias("node")).union(pairs.select("p")).distinct(), f"{name}-nodes")), f"{name}-sets")
        both = pairs.select("a", "p").join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("of_a")), "a").join(
            sets.select(F.col("node").alias("p"), F.col("shingles").alias("of_p")), "p").select(
            "a", "p", F.size(F.array_intersect("of_a", "of_p")).alias("i"), (F.size("of_a") + F.size("of_p")).alias("both"))
        links = self.written(both.where(F.col("i") * self.den >= (F.col("both") - F.col("i")) * self.num)
                             .select("a", F.col("p").alias("b")), name)
        self.dropped(f"{name}-nodes", f"{name}-sets")
        return links

    def _close(self, pairs: DataFrame) -> DataFrame:
        """Those of the pairs whose counts allow a link: most chance meetings end here, on an eighth of a byte a shingle."""
        num, den = self.num, self.den

        def near(incoming: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in (whole.slice(k, CLOSE_ROWS) for whole in incoming for k in range(0, whole.num_rows, CLOSE_ROWS)):
                both = b.column(2).to_numpy() + b.column(3).to_numpy()
                sides = [[memoryview(x.as_buffer()) for x in b.column(c)] for c in (4, 5)]
                cells = np.array([[len(x) for x in side] for side in sides], "i8").reshape(2, -1)
                differ = np.zeros(b.num_rows, "i8")
                for n_a, n_p in np.unique(cells, axis=1).T.tolist():
                    at = np.flatnonzero((cells[0] == n_a) & (cells[1] == n_p))
                    least = min(n_a, n_p)
                    of_a, of_p = (np.minimum(np.frombuffer(b"".join(side[k] for k in at), "u1").reshape(len(at), least, -1).sum(
                        axis=2, dtype="i4"), 255) for side in sides)
                    differ[at] = np.abs(of_a - of_p).sum(axis=1, dtype="i8")
                yield b.select(range(2)).filter(pa.array(differ * (den + num) <= both * (den - num)))

        def of(side: str, count: str) -> DataFrame:
            return self.classes.select(F.col("set_hash").alias(side), F.col("counts").alias(count))

        met = pairs.join(of("a", "of_a"), "a").join(of("p", "of_p"), "p").select("a", "p", "ma", "mp", "of_a", "of_p")
        return met.mapInArrow(near, "a long, p long")

    def _tried(self) -> DataFrame:
        """a, p, ma, mp (sets and their sizes), many, level of all pairs of documents that meet, by their sets."""
        known = self.written(self.sizes.where("n_shingles > 0 AND doc_id IS NOT NULL").select("doc_id", "set_hash", "n_shingles").distinct(), "known")
        as_a = known.select(F.col("doc_id").alias("da"), F.col("set_hash").alias("a"), F.col("n_shingles").alias("ma"))
        as_p = known.select(F.col("doc_id").alias("dp"), F.col("set_hash").alias("p"), F.col("n_shingles").alias("mp"))
        met = self._candidates(known).withColumnsRenamed({"a": "da", "p": "dp"}).join(as_a, "da").join(as_p, "dp")
        # an id may have several sets
        first = known.groupBy("doc_id").agg(F.min(F.struct("set_hash", "n_shingles")).alias("first"), F.count("*").alias("n")).where("n > 1")
        same = known.join(first, "doc_id").select(
            F.col("set_hash").alias("a"), F.col("first.set_hash").alias("p"), F.col("n_shingles").alias("ma"),
            F.col("first.n_shingles").alias("mp"), F.lit(True).alias("many"), F.lit(2).alias("level"))
        met = met.select("a", "p", "ma", "mp", "many", "level").union(same)
        return self.written(met.where("a != p").groupBy("a", "p", "ma", "mp").agg(
            F.max("many").alias("many"), F.max("level").alias("level")), "pairs-0")

    def _links(self) -> DataFrame:
        """node, component over the sets that link with others."""
        tried = self._tried()
        fits = F.least("ma", "mp") * self.den >= F.greatest("ma", "mp") * self.num
        links = self._verified(self.written(self._close(tried.where(fits)), "close"), "links-0")
        labels = components(links, f"{self.folder}/components-0")
        # A signature is settled if all its members are in one component, or if it has two, who were compared. Its pairs
        # are two levels high: members of a lot below the lot's pivot, and those of several lots (many) below the
        # smallest of them. So a failed pair opens its pivot and the pivot above, and these the lots' pivots below with
        # their members. A lot's only pair is settled unless its pivot meets others as one of several.
        label_a = labels.select(F.col("node").alias("a"), F.col("component").alias("ca"))
        label_p = labels.select(F.col("node").alias("p"), F.col("component").alias("cp"))
        several = tried.where("level = 2").select("a").union(tried.where("level = 2").select("p")).distinct()
        live = tried.where("level = 2").union(tried.where("level = 1").join(several.withColumnRenamed("a", "p"), "p", "left_semi").select(*tried.columns))
        live = self.written(live, "live")
        failed = live.join(label_a, "a", "left").join(label_p, "p", "left").where(
            F.coalesce("ca", "a") != F.coalesce("cp", "p")).select("p").distinct()
        stand_in = live.where("many").select("a", "p")
        above = stand_in.join(failed.select(F.col("p").alias("a")), "a", "left_semi").select("p")
        roots = self.written(failed.union(above).distinct(), "roots")
        below = stand_in.join(roots, "p", "left_semi").select(F.col("a").alias("p"))
        reopened = self.written(roots.union(below).distinct(), "reopened")
        opened = live.join(reopened, "p", "left_semi")
        members = self.written(opened.select(F.col("a").alias("node"), F.col("ma").alias("m")).union(
            opened.select("p", "mp")).distinct(), "open")
        if members.isEmpty():
            return labels
        return self._settle(members, links, labels, tried)

    def _settle(self, members: DataFrame, links: DataFrame, labels: DataFrame, tried: DataFrame) -> DataFrame:
        """Compares members of unsettled signatures until every pair that can link is in one component or was tried.

        With shingles ordered by how many members have them, two linked sets share one of their rarest
        ``(1 - num/den) * m + 1``. So members meet at those shingles alone, first each with the pivot of a shingle,
        then, where components are left, with one another.
        """
        sets = self.written(self._shingles(members.select("node")), "open-sets")
        shared = []
        for deal in range(DEALS):
            own_deal = F.expr(f"filter(shingles, s -> pmod(s, {DEALS}) = {deal})")
            each = sets.select("node", F.explode(own_deal).alias("s"))
            spread = self.written(each.groupBy("s").agg(F.count("*").alias("n")).where("n > 1"), f"open-shingles-{deal}")
            shared.append(self.written(each.join(spread, "s").select("node", "s", "n"), f"open-shared-{deal}"))
        self.dropped("open-sets", *(f"open-shingles-{deal}" for deal in range(DEALS)))
        # as many rows as a set has shingles; those that no other member has count against every link of it
        of_node = Window.partitionBy("node")
        ranked = reduce(DataFrame.unionAll, shared).select(
            "node", "s", F.row_number().over(of_node.orderBy("n", "s")).alias("rank"),
            F.count("*").over(of_node).alias("shared")).join(members, "node")
        spare, own = F.floor(F.col("m") * (self.den - self.num) / F.lit(self.den)), F.col("m") - F.col("shared")
        signed = self.written(ranked.where(F.col("rank") <= spare + 1 - own).select(
            F.col("s").alias("sig"), "node", "m", (own + F.col("rank") - 1).alias("before")), "open-prefixes")
        self.dropped(*(f"open-shared-{deal}" for deal in range(DEALS)))
        done = tried.select("a", "p")
        for turn in range(1, 4):
            at = signed.join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
            if turn < 3:
                first = at.groupBy("sig").agg(F.min(F.struct("before", "node", "m", "component")).alias("p"))
                pairs = at.join(self.written(first, f"pivots-{turn}"), "sig").select(
                    F.col("node").alias("a"), F.col("p.node").alias("b"), "before", F.col("p.before").alias("before_p"), "m",
                    F.col("p.m").alias("mp"), "component", F.col("p.component").alias("cp")).withColumnRenamed("b", "p")
            else:
                other = at.select("sig", F.col("node").alias("p"), F.col("before").alias("before_p"), F.col("m").alias("mp"),
                                  F.col("component").alias("cp"))
                pairs = at.select("sig", F.col("node").alias("a"), "before", "m", "component").join(
                    other, (at["sig"] == other["sig"]) & (F.col("a") > F.col("p")) & self._open_pair())
            pairs = pairs.where(self._open_pair()).select("a", "p", F.col("m").alias("ma"), "mp").distinct()
            fresh = pairs.join(done, ["a", "p"], "left_anti").join(
                done.select(F.col("a").alias("p"), F.col("p").alias("a")), ["a", "p"], "left_anti")
            fresh = self.written(fresh, f"pairs-{turn}")
            if fresh.isEmpty():
                continue
            links = links.union(self._verified(self.written(self._close(fresh), f"close-{turn}"), f"links-{turn}"))
            done = done.union(fresh.select("a", "p"))
            labels = components(links, f"{self.folder}/components-{turn}")
        return labels

    def _open_pair(self):
        """Not yet in one component, and able to link if this is the rarest shingle they share: the ``before`` rarer
        ones of either are then in the other one not."""
        most = F.least(F.col("m") - F.col("before"), F.col("mp") - F.col("before_p"))
        return (F.col("component") != F.col("cp")) & (most * self.den >= (F.col("m") + F.col("mp") - most) * self.num)


def _ascending(values: np.ndarray) -> bytes:
    """Sorted whole numbers: how many, the first, the bytes of a difference, and the differences in so many bytes."""
    if not len(values):
        return np.array([0, 0, 0], "i8").tobytes()
    steps = np.diff(values.astype("i8").view("u8"))
    wide = max(1, (int(steps.max(initial=0)).bit_length() + 7) // 8)
    return np.array([len(values), values[0], wide], "i8").tobytes() + steps.astype("<u8").view("u1").reshape(-1, 8)[:, :wide].tobytes()


def _ascended(data: memoryview) -> tuple[np.ndarray, memoryview]:
    n, first, wide = np.frombuffer(data, "i8", 3).tolist()
    data = data[24:]
    if not n:
        return np.empty(0, "i8"), data
    steps = np.zeros((n, 8), "u1")
    steps[1:, :wide] = np.frombuffer(data, "u1", (n - 1) * wide).reshape(-1, wide)
    steps = steps.view("u8").ravel()
    steps[0] = np.int64(first).view("u8")
    return np.cumsum(steps, dtype="u8").view("i8"), data[(n - 1) * wide:]


def _packed(keys: list[np.ndarray], members: list[np.ndarray], bits: int) -> Iterator[pa.RecordBatch]:
    """range, bucket, blob of a lot: each signature once, with its smallest member and whether it has others, by buckets
    of the signatures' highest bits; the others as pairs with that one, dealt by their members.

    A key is a signature and the place of its text in the lot, members are the ids by place. Both lists are emptied.
    """
    if not sum(map(len, keys)):
        keys.clear(), members.clear()
        return
    place, shift = np.uint64((1 << PLACE_BITS) - 1), np.uint64(PLACE_BITS)
    ids, rank = np.unique(np.concatenate(members), return_inverse=True)
    key = np.concatenate(keys)
    keys.clear(), members.clear()
    rank = rank.astype("u8")[(key & place).astype("u2")]
    key &= ~place
    key |= rank
    del rank
    key.sort()
    key = key[np.append(True, key[1:] != key[:-1])]
    new = np.append(True, (key[1:] ^ key[:-1]) > place)
    starts, rest = np.flatnonzero(new).astype("u4"), np.flatnonzero(~new)
    del new
    size = np.diff(np.append(starts, np.uint32(len(key))))
    # pairs as pivot, member, whether the signature has more; of equal ones the last says most
    own = np.searchsorted(starts, rest.astype("u4"), "right") - 1
    pair = (key[starts[own]] & place) << shift
    pair |= key[rest] & place
    pair <<= np.uint64(1)
    pair |= (size[own] > 2).astype("u8")
    shared, key = size > 1, key[starts]
    del starts, size, rest, own
    pair.sort()
    pair = pair[np.append(pair[1:] >> np.uint64(1) != pair[:-1] >> np.uint64(1), np.ones(min(len(pair), 1), bool))]
    level = (pair & np.uint64(1)).astype("i8") + 1
    a, p = ids[(pair >> np.uint64(1)) & place], ids[pair >> np.uint64(1 + PLACE_BITS)]
    pivot = (key & place).astype("u2")
    key >>= shift
    sig = key.view("i8")
    of_pair = a & ((1 << bits) - 1)
    by_pair = np.argsort(of_pair, kind="stable")
    a, p, level, of_pair = a[by_pair], p[by_pair], level[by_pair], of_pair[by_pair]
    edges = np.arange((1 << bits) + 1)
    of_sig, of_pair = np.searchsorted(sig, edges << (SIGNATURE_BITS - bits)), np.searchsorted(of_pair, edges)
    buckets, blobs = [], []
    for bucket in np.flatnonzero((np.diff(of_sig) > 0) | (np.diff(of_pair) > 0)).tolist():
        x, y = of_sig[bucket:bucket + 2].tolist()
        pivots, at = np.unique(pivot[x:y], return_inverse=True)
        at = at.astype("u2" if len(pivots) <= 1 << 16 else "u4")
        k, n = of_pair[bucket:bucket + 2].tolist()
        buckets.append(bucket)
        blobs.append(b"".join([_ascending(sig[x:y]), _ascending(ids[pivots]), at.tobytes(), np.packbits(shared[x:y]).tobytes(),
                               a[k:n].tobytes(), p[k:n].tobytes(), level[k:n].astype("u1").tobytes()]))
    yield pa.record_batch([pa.array([b >> (bits - GROUP_BITS) for b in buckets], pa.int32()), pa.array(buckets, pa.int32()),
                           pa.array(blobs, pa.binary())], ["range", "bucket", "blob"])


def _met(blobs: list[bytes]) -> tuple[np.ndarray, ...]:
    """a, p, many, level of a bucket's signatures and pairs."""
    parts, pairs = [], []
    for blob in blobs:
        sig, data = _ascended(memoryview(blob))
        ids, data = _ascended(data)
        wide = 2 if len(ids) <= 1 << 16 else 4
        n = len(sig)
        place, data = np.frombuffer(data, f"u{wide}", n), data[wide * n:]
        many, data = np.unpackbits(np.frombuffer(data, "u1", (n + 7) // 8), count=n).astype(bool), data[(n + 7) // 8:]
        parts.append((sig, ids[place] if n else ids, many))
        k = len(data) // 17
        pairs.append((np.frombuffer(data, "i8", k), np.frombuffer(data[8 * k:], "i8", k), np.frombuffer(data[16 * k:], "u1", k)))
    sig, member, many = (np.concatenate(x) for x in zip(*parts))
    order = np.lexsort((member, sig))
    sig, member, many = sig[order], member[order], many[order]
    first = np.ones(len(sig), bool)
    first[1:] = sig[1:] != sig[:-1]
    group = np.cumsum(first) - 1
    n = int(first.sum())
    others = np.bincount(group, minlength=n) + (np.bincount(group, many, n) > 0)
    pivot = member[first][group]
    met = member != pivot
    lot_a, lot_p, lot_level = (np.concatenate(x) for x in zip(*pairs))
    return _distinct(
        np.concatenate([member[met], lot_a]), np.concatenate([pivot[met], lot_p]),
        np.concatenate([many[met], np.zeros(len(lot_a), bool)]),
        np.concatenate([np.where(others[group][met] > 2, 2, 0), lot_level]))


def _once(met: Iterable[tuple[np.ndarray, ...]]) -> Iterator[pa.RecordBatch]:
    """a, p, many, level of the pairs of some buckets, each once as long as no more than HELD_PAIRS others come between."""
    held, n = [], 0
    for pairs in chain(met, [None]):
        if pairs is not None:
            held.append(pairs)
            n += len(pairs[0])
            if n <= HELD_PAIRS:
                continue
        if len(held) > 1:
            held = [_distinct(*(np.concatenate(x) for x in zip(*held)))]
            n = len(held[0][0])
        if held and (pairs is None or 2 * n > HELD_PAIRS):
            a, p, many, level = held[0]
            for k in range(0, n, PAIR_ROWS):
                part = slice(k, k + PAIR_ROWS)
                yield pa.record_batch([pa.array(a[part]), pa.array(p[part]), pa.array(many[part]), pa.array(level[part].astype("i4"))],
                                      ["a", "p", "many", "level"])
            held, n = [], 0


def _distinct(a: np.ndarray, p: np.ndarray, many: np.ndarray, level: np.ndarray) -> tuple[np.ndarray, ...]:
    """Each pair once, with the largest of its flags."""
    order = np.lexsort((a, p))
    a, p, many, level = a[order], p[order], many[order], level[order]
    new = np.ones(len(a), bool)
    new[1:] = (a[1:] != a[:-1]) | (p[1:] != p[:-1])
    at = np.flatnonzero(new)
    if not len(at):
        return a, p, many, level
    return a[at], p[at], np.maximum.reduceat(many, at), np.maximum.reduceat(level, at)
