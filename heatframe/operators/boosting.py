"""Boosted regression trees grown from sums of cells, with the thresholds and the samples that MLlib takes.

Rows whose features lie in the same bins (a cell) take the same way through every tree. Of its sample a tree needs no more than
the number, the sum and the sum of squares of each cell's labels: residuals follow from them, as a cell has one prediction.
Which rows a tree samples does not depend on the trees before it, so the sums of many trees come from one pass over the
rows, and the trees are then grown from the cells alone. There are at most as many cells as products of bins; beyond
``MOST_CELLS`` the caller has to pass over the rows for each level of each tree, as MLlib does.
"""

from __future__ import annotations

import json
import math
import time
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel, TaskContext
from pyspark.ml.regression import GBTRegressionModel, GBTRegressor
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heatframe.session import new_path

MOST_CELLS = 1 << 20
BLOCK = 1 << 22  # sums of one pass: cells times trees
CHUNK_ROWS = 1 << 15
LANE = 64  # draws of a lane; a stream is drawn in lanes side by side
EPSILON = 2.0**-52
WORD = (1 << 64) - 1


# The random numbers of Spark's XORShiftRandom


def _murmur(data: bytes, seed: int) -> int:
    h = seed
    for at in range(0, len(data), 4):
        k = int.from_bytes(data[at:at + 4], "little") * 0xCC9E2D51 & 0xFFFFFFFF
        k = (k << 15 | k >> 17) & 0xFFFFFFFF
        h ^= k * 0x1B873593 & 0xFFFFFFFF
        h = (h << 13 | h >> 19) & 0xFFFFFFFF
        h = (h * 5 + 0xE6546B64) & 0xFFFFFFFF
    h ^= len(data)
    h = (h ^ h >> 16) * 0x85EBCA6B & 0xFFFFFFFF
    h = (h ^ h >> 13) * 0xC2B2AE35 & 0xFFFFFFFF
    return h ^ h >> 16


def first_state(seed: int) -> int:
    """State of an XORShiftRandom with this seed."""
    data = (seed & WORD).to_bytes(8, "big")
    low = _murmur(data, 0x3C074A61)
    return _murmur(data, low) << 32 | low


def _next(x: int) -> int:
    x ^= x << 21 & WORD
    x ^= x >> 35
    return x ^ (x << 4 & WORD)


def doubles(seed: int) -> Iterator[float]:
    """nextDouble() again and again."""
    x = first_state(seed)
    while True:
        a = _next(x)
        x = _next(a)
        yield ((a & (1 << 26) - 1) << 27 | x & (1 << 27) - 1) * 2.0**-53


def _tables(columns: np.ndarray) -> np.ndarray:
    """A linear map of 64 bits, given by what it makes of each, as 8 tables of a byte."""
    out = np.zeros((8, 256), np.uint64)
    for b in range(8):
        for i in range(8):
            out[b, 1 << i: 2 << i] = out[b, : 1 << i] ^ columns[8 * b + i]
    return out


def _mapped(tables: np.ndarray, x: np.ndarray) -> np.ndarray:
    out = tables[0][x & np.uint64(255)]
    for b in range(1, 8):
        out ^= tables[b][x >> np.uint64(8 * b) & np.uint64(255)]
    return out


def _jumps(most: int) -> list[np.ndarray]:
    """Tables that move a state on by 1, 2, 4 ... lanes."""
    columns = np.array([_next(1 << i) for i in range(64)], np.uint64)
    out = []
    for k in range((2 * LANE).bit_length() - 1 + most):
        if 1 << k >= 2 * LANE:
            out.append(_tables(columns))
        columns = _mapped(_tables(columns), columns)
    return out


JUMPS = _jumps(24)


class Streams:
    """Draws of 53 bits from one generator for each seed; all are at the same place."""

    def __init__(self, seeds: Iterable[int]):
        self.state = np.array([first_state(s) for s in seeds], np.uint64)

    def draw(self, n: int, limit: int | None = None) -> np.ndarray:
        """(seed, n) draws, or with ``limit`` whether they are below it."""
        lanes = n // LANE + 1
        x = self.state[:, None]
        for jump in JUMPS:
            if x.shape[1] >= lanes:
                break
            x = np.concatenate([x, _mapped(jump, x)], axis=1)
        x = np.ascontiguousarray(x[:, :lanes])
        out = np.empty((LANE, *x.shape), np.uint64 if limit is None else bool)
        a, b = np.empty_like(x), np.empty_like(x)
        for t in range(LANE):
            if t == n % LANE:
                self.state = x[:, -1].copy()
            for kept in (a, x):
                np.left_shift(x, 21, out=b)
                np.bitwise_xor(x, b, out=kept)
                np.right_shift(kept, 35, out=b)
                np.bitwise_xor(kept, b, out=kept)
                np.left_shift(kept, 4, out=b)
                np.bitwise_xor(kept, b, out=kept)
                if kept is a:
                    x[:] = a
            np.bitwise_and(a, (1 << 26) - 1, out=a)
            np.left_shift(a, 27, out=a)
            np.bitwise_and(x, (1 << 27) - 1, out=b)
            if limit is None:
                np.bitwise_or(a, b, out=out[t])
            else:
                np.bitwise_or(a, b, out=a)
                np.less(a, np.uint64(limit), out=out[t])
        return out.transpose(1, 2, 0).reshape(len(self.state), lanes * LANE)[:, :n]


def limit_of(rate: float) -> int:
    """Draws below it are sampled at this rate."""
    return math.ceil(rate * 2.0**53)


def tree_seeds(seed: int, first: int, last: int, partition: int) -> range:
    """Seeds of the samples that trees first to last - 1 take of a partition."""
    return range(seed + first + partition + 1, seed + last + partition + 1)


# Thresholds


def sampled_share(total: int, max_bins: int) -> float:
    """Share of the rows that MLlib reads for the thresholds."""
    needed = max(max_bins * max_bins, 10_000)
    return needed / total if needed < total else 1.0


def partition_seed(seed: int, partition: int) -> int:
    """Seed of the sample that RDD.sample takes of a partition when MLlib asks for it."""
    first = _next(first_state(seed)) & 0xFFFFFFFF
    x = ((first - (1 << 32) if first >> 31 else first) ^ 0x5DEECE66D) & (1 << 48) - 1
    words = []
    for _ in range(2 * partition + 2):
        x = (x * 0x5DEECE66D + 0xB) & (1 << 48) - 1
        words.append((x >> 16) - (1 << 32) if x >> 47 else x >> 16)
    return (words[-2] << 32) + words[-1]


def sampled_places(share: float, seed: int) -> Iterator[int]:
    """Places of the sampled rows in their partition, without an end."""
    drawn, at = doubles(seed), 0
    if share > 0.4:
        for u in drawn:
            if u <= share:
                yield at
            at += 1
    by = math.log1p(-share)
    for u in drawn:
        at += int(math.log(max(u, 5e-11)) / by)
        yield at
        at += 1


def sampled_rows(share: float, seed: int, partition: int, sizes: Iterable[int]) -> Iterator[np.ndarray]:
    """For each batch of a partition the places in it of its sampled rows."""
    places = sampled_places(share, partition_seed(seed, partition)) if share < 1.0 else None
    begin, ahead = 0, next(places) if places else 0
    for size in sizes:
        if places is None:
            yield np.arange(size)
            continue
        found = []
        while ahead < begin + size:
            found.append(ahead - begin)
            ahead = next(places)
        begin += size
        yield np.array(found, np.int64)


def thresholds(values: np.ndarray, expected: float, most: int) -> np.ndarray:
    """At most ``most`` thresholds of a feature from its sampled values. MLlib leaves zeros out and takes the rows that lack of the
    ``expected`` ones for zeros, so as it does."""
    values = values[values != 0.0]
    if not values.size:
        return np.empty(0)
    levels, counts = np.unique(values, return_counts=True)
    counts = counts.astype(float)
    zeros = expected - counts.sum()
    if zeros > EPSILON * values.size * 100:
        at = np.searchsorted(levels, 0.0)
        levels, counts = np.insert(levels, at, 0.0), np.insert(counts, at, zeros)
    between = (levels[:-1] + levels[1:]) / 2.0
    if between.size <= most:
        return between
    stride, found = expected / (most + 1), []
    current, target = counts[0], stride
    for k in range(1, levels.size):
        before, current = current, current + counts[k]
        if abs(before - target) < abs(current - target):
            found.append(between[k - 1])
            target += stride
    return np.array(found)


# Trees


class Tree:
    """Nodes in the order they were found, the root first, children side by side; a leaf's ``left`` is -1."""

    def __init__(self, most: int):
        self.feature, self.split, self.left = (np.full(most, -1, np.intp) for _ in range(3))
        self.gain, self.impurity = np.full(most, -1.0), np.zeros(most)
        self.sums, self.size = np.zeros((most, 3)), 0  # n, s, q

    def add(self, sums: np.ndarray) -> np.ndarray:
        """Ids of new nodes with these sums."""
        new = np.arange(self.size, self.size + len(sums))
        n, s, q = sums.T
        self.sums[new], self.size = sums, self.size + len(sums)
        self.impurity[new] = np.divide(q - np.divide(s * s, n, where=n > 0, out=np.zeros(n.size)), n, where=n > 0, out=np.zeros(n.size))
        return new

    def values(self) -> np.ndarray:
        n, s, _ = self.sums[: self.size].T
        return np.divide(s, n, where=n > 0, out=np.zeros(n.size))


@dataclass(frozen=True)
class Rules:
    trees: int
    step: float
    depth: int
    least: int  # rows of a node
    rate: float


def grow(bins: np.ndarray, width: int, n: np.ndarray, s: np.ndarray, q: np.ndarray, depth: int, least: int) -> tuple[Tree, np.ndarray]:
    """(tree, node of each cell), level by level; ``bins`` are (feature, cell) below ``width``, ``n``, ``s`` and ``q`` the sums of the cells."""
    (features, size), tree = bins.shape, Tree(2 ** (depth + 1) - 1)
    cells, slots = np.arange(size), bins + np.arange(features)[:, None] * width
    every = [np.tile(x, features) for x in (n, s)]
    front = tree.add(np.array([[n.sum(), s.sum(), q.sum()]]))  # nodes of the level, and those that ended above it
    place, opened = np.zeros(size, np.intp), np.ones(1, bool)
    for _ in range(depth):
        k = front.size
        if not opened.any() or width < 2:
            break
        key = (slots + place * (features * width)).ravel()
        below, under = (np.bincount(key, w, k * features * width).reshape(k, features, width)[:, :, :-1].cumsum(2) for w in every)
        total, sums = tree.sums[front, 0][:, None, None], tree.sums[front, 1][:, None, None]
        above = total - below
        with np.errstate(divide="ignore", invalid="ignore"):
            gain = (under * under / below + (sums - under) ** 2 / above - sums * sums / total) / total
        gain[(below < least) | (above < least)] = -np.inf
        found, nodes = gain.argmax(2), np.arange(k)
        of_feature = np.take_along_axis(gain, found[:, :, None], 2)[:, :, 0]
        best, where = of_feature[:, 0], np.zeros(k, np.intp)
        for f in range(1, features):  # splits that part the rows alike differ by rounding only
            more = of_feature[:, f] > best + 1e-12 * np.abs(np.where(best > -np.inf, best, 0.0))
            best, where = np.where(more, of_feature[:, f], best), np.where(more, f, where)
        at = found[nodes, where]
        tree.impurity[front[opened & (best < 0)]] = -1.0
        parted = opened & (best > 0)
        parts = np.flatnonzero(parted)
        # an ended node goes on as the first child of its place
        turn = bins.ravel()[(where * size)[place] + cells] > np.where(parted, at, width)[place]
        child = 2 * place + turn
        parents, ways = front[parts], (2 * parts[:, None] + np.arange(2)).ravel()
        lefts = np.stack([below[parts, where[parts], at[parts]], under[parts, where[parts], at[parts]]], 1)
        both = np.stack([lefts, tree.sums[parents, :2] - lefts], 1).reshape(-1, 2)
        new = tree.add(np.column_stack([both, np.bincount(child, q, 2 * k)[ways]]))
        tree.feature[parents], tree.split[parents], tree.gain[parents], tree.left[parents] = where[parts], at[parts], best[parts], new[::2]
        node, going = np.repeat(front, 2), np.zeros(2 * k, bool)
        node[ways], going[ways] = new, np.abs(tree.impurity[new]) >= EPSILON
        kept = np.ones((k, 2), bool)
        kept[:, 1] = parted
        kept = kept.ravel()
        place, front, opened = (kept.cumsum() - 1)[child], node[kept], going[kept]
    if width < 2 and depth:
        tree.impurity[0] = -1.0
    return tree, front[place]


class Booster:
    """Trees one after the other, each from the sums of its sample by cell; labels are given less ``centre``."""

    def __init__(self, bins: np.ndarray, widths: list[int], centre: float, rules: Rules, keep: bool = True):
        self.bins, self.width, self.centre, self.rules, self.keep = bins, max(widths), centre, rules, keep
        self.trees: list[Tree] = []  # without ``keep`` only the predictions stay
        self.grown = 0
        self.pred = np.zeros(bins.shape[1])  # less the centre

    def add(self, n: np.ndarray, s: np.ndarray, q: np.ndarray) -> None:
        """The first tree learns the labels, the others twice the rest that is left, as the gradient of the squared error."""
        first, p, c = not self.grown, self.pred, self.centre
        if first:
            s, q = s + n * c, q + 2.0 * c * s + n * (c * c)
        else:
            s, q = 2.0 * (s - n * p), 4.0 * (q - 2.0 * p * s + n * p * p)
        tree, node = grow(self.bins, self.width, n, s, q, self.rules.depth, self.rules.least)
        values = tree.values()[node]
        self.pred = values - c if first else p + self.rules.step * values
        self.grown += 1
        if self.keep:
            self.trees.append(tree)


def node_rows(number: int, tree: Tree, edges: list[np.ndarray]) -> list[tuple]:
    """The nodes as MLlib saves them, in preorder; two leaves of one value become one."""
    rows: list[list] = []
    features, splits, lefts, gains, impurities, values, sums = (
        x.tolist() for x in (tree.feature, tree.split, tree.left, tree.gain, tree.impurity, tree.values(), tree.sums))

    def add(x: int) -> tuple[int, float | None]:
        """(id, value if it is a leaf)"""
        mine, value = len(rows), values[x]
        rows.append([mine, value, impurities[x], sums[x], int(sums[x][0]), -1.0, -1, -1, (-1, [], -1)])
        if lefts[x] < 0:
            return mine, value
        (a, one), (b, other) = add(lefts[x]), add(lefts[x] + 1)
        if one is not None and one == other:
            del rows[mine + 1:]
            rows[mine][1] = one
            return mine, one
        edge = float(edges[features[x]][splits[x]])
        rows[mine][5:] = [gains[x], a, b, (features[x], [edge], -1)]
        return mine, None

    add(0)
    return [(number, tuple(r)) for r in rows]


NODES = (
    "treeID int, nodeData struct<id: int, prediction: double, impurity: double, impurityStats: array<double>, rawCount: bigint,"
    " gain: double, leftChild: int, rightChild: int,"
    " split: struct<featureIndex: int, leftCategoriesOrThreshold: array<double>, numCategories: int>>"
)


def as_model(spark: SparkSession, gbt: GBTRegressor, trees: list[Tree], edges: list[np.ndarray]) -> GBTRegressionModel:
    """The trees as a model of MLlib, by way of the table of nodes that it loads from a folder."""
    path = new_path(spark, "trees")
    given = {p.name: v for p, v in gbt._paramMap.items()}
    defaults = {p.name: v for p, v in gbt._defaultParamMap.items()}
    of_tree = [p.name for p in GBTRegressor().params if p.name not in (
        "featureSubsetStrategy", "lossType", "maxIter", "stepSize", "subsamplingRate", "validationIndicatorCol", "validationTol")]

    def saved(kind: str, uid: str, names: Iterable[str] | None = None, **more) -> str:
        kept = lambda d: d if names is None else {k: v for k, v in d.items() if k in names}
        return json.dumps({
            "class": f"org.apache.spark.ml.regression.{kind}", "timestamp": int(time.time() * 1000), "sparkVersion": spark.version,
            "uid": uid, "paramMap": kept(given), "defaultParamMap": kept(defaults), **more})

    text = saved("GBTRegressionModel", gbt.uid, numFeatures=len(edges), numTrees=len(trees))
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.text(f"{path}/metadata")
    rows = [r for k, t in enumerate(trees) for r in node_rows(k, t, edges)]
    spark.createDataFrame(rows, NODES, verifySchema=False).coalesce(1).write.parquet(f"{path}/data")
    about = [
        (k, saved("DecisionTreeRegressionModel", f"dtr_{gbt.uid}_{k}", of_tree), gbt.getStepSize() if k else 1.0) for k in range(len(trees))
    ]
    spark.createDataFrame(about, "_1 int, _2 string, _3 double").coalesce(1).write.parquet(f"{path}/treesMetadata")
    return GBTRegressionModel.load(path)


# Fits


def rules_of(gbt: GBTRegressor) -> Rules | None:
    """What the trees are grown by; None where a parameter asks for what only MLlib does."""
    get = gbt.getOrDefault
    plain = (
        get("lossType") == "squared" and get("featureSubsetStrategy") == "all" and get("minInfoGain") == 0.0
        and get("minWeightFractionPerNode") == 0.0 and not get("leafCol")
        and not any(gbt.isDefined(p) and get(p) for p in ("weightCol", "validationIndicatorCol"))
    )
    if not plain:
        return None
    return Rules(get("maxIter"), get("stepSize"), get("maxDepth"), get("minInstancesPerNode"), get("subsamplingRate"))


def codes(columns: list[np.ndarray], edges: list[np.ndarray]) -> np.ndarray:
    """The cell of each row, its bins as one number. A value that equals a threshold lies below it."""
    out = np.zeros(len(columns[0]), np.int64)
    for values, edge in zip(columns, edges):
        out = out * (edge.size + 1) + np.searchsorted(edge, values, side="left")
    return out


def bins_of(cells: np.ndarray, widths: list[int]) -> np.ndarray:
    """(feature, cell) bins of cells."""
    out = np.empty((len(widths), cells.size), np.intp)
    for f in range(len(widths) - 1, -1, -1):
        cells, out[f] = np.divmod(cells, widths[f])
    return out


def numbers(table: pa.RecordBatch | pa.Table) -> list[np.ndarray]:
    return [table.column(k).to_numpy(zero_copy_only=False) if isinstance(table, pa.RecordBatch) else table.column(k).to_numpy()
            for k in range(table.num_columns)]


def _columns(rows: DataFrame, features: list[str], label: str) -> DataFrame:
    """The features, then the label, all as doubles."""
    return rows.select(*[F.col(c).cast("double").alias(f"_{k}") for k, c in enumerate([*features, label])])


def _sample(df: DataFrame, share: float, seed: int) -> list[np.ndarray]:
    """The columns of the rows that MLlib reads for the thresholds."""

    def take(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        partition = TaskContext.get().partitionId()
        held: list[pa.RecordBatch] = []

        def sizes():
            for b in batches:
                held.append(b)
                yield b.num_rows

        for places in sampled_rows(share, seed, partition, sizes()):
            yield held.pop().take(pa.array(places))

    return numbers(df.mapInArrow(take, df.schema).toArrow())


def _binned(df: DataFrame, edges: list[np.ndarray], centre: float) -> DataFrame:
    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            *columns, y = numbers(b)
            yield pa.RecordBatch.from_arrays([pa.array(codes(columns, edges)), pa.array(y - centre)], ["cell", "y"])

    return df.mapInArrow(cut, "cell long, y double")


def _sums(binned: DataFrame, hot: np.ndarray, salts: int, seed: int, first: int, last: int, rate: float) -> DataFrame:
    """(cell, n, s, q): for trees first to last - 1 number, sum and sum of squares of the cell's sampled labels, side by side.

    A row goes to its cell's task with a bit for each tree; the rows of a ``hot`` cell go to ``salts`` tasks, and have a row
    of sums from each.
    """
    trees, limit = last - first, limit_of(rate)

    def draw(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        streams = Streams(tree_seeds(seed, first, last, TaskContext.get().partitionId()))
        for b in batches:
            cell, y = numbers(b)
            bits = np.packbits(streams.draw(b.num_rows, limit).T, axis=1)
            salt = np.where(np.isin(cell, hot), np.arange(cell.size) % salts, 0)
            fixed = pa.FixedSizeBinaryArray.from_buffers(pa.binary(bits.shape[1]), len(bits), [None, pa.py_buffer(np.ascontiguousarray(bits))])
            yield pa.RecordBatch.from_arrays(
                [pa.array(cell), pa.array(salt.astype(np.int32)), pa.array(y), fixed.cast(pa.binary())], ["cell", "salt", "y", "bits"])

    def chunks(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.Table]:
        held, size = [], 0
        for b in batches:
            held.append(b)
            size += b.num_rows
            if size >= CHUNK_ROWS:
                yield pa.Table.from_batches(held)
                held, size = [], 0
        if size:
            yield pa.Table.from_batches(held)

    def add(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place: dict[int, int] = {}
        kept = [np.zeros((0, trees), t) for t in (np.int64, float, float)]
        for table in chunks(batches):
            cell, y = table["cell"].to_numpy(), table["y"].to_numpy()
            wide = (trees + 7) // 8
            flat = table["bits"].combine_chunks()
            bits = np.frombuffer(flat.buffers()[2], np.uint8, len(cell) * wide, flat.offset * wide).reshape(-1, wide)
            order = np.argsort(cell, kind="stable")
            cell, y = cell[order], y[order]
            taken = np.unpackbits(bits[order], axis=1, count=trees)
            begin = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]]))
            at = np.array([place.setdefault(c, len(place)) for c in cell[begin].tolist()])
            if len(place) > len(kept[0]):
                more = max(len(place), 2 * len(kept[0])) - len(kept[0])
                kept = [np.concatenate([x, np.zeros((more, trees), x.dtype)]) for x in kept]
            kept[0][at] += np.add.reduceat(taken, begin, axis=0, dtype=np.int64)
            values = taken * y[:, None]
            kept[1][at] += np.add.reduceat(values, begin, axis=0)
            values *= y[:, None]
            kept[2][at] += np.add.reduceat(values, begin, axis=0)
        cells = np.array(list(place), np.int64)
        for i in range(0, cells.size, 512):
            parts = [np.ascontiguousarray(x[i: min(i + 512, cells.size)]) for x in kept]
            yield pa.RecordBatch.from_arrays(
                [pa.array(cells[i: i + 512]), *[pa.array([r.tobytes() for r in x], pa.binary()) for x in parts]], ["cell", "n", "s", "q"])

    dealt = binned.mapInArrow(draw, "cell long, salt int, y double, bits binary").repartition("cell", "salt")
    return dealt.mapInArrow(add, "cell long, n binary, s binary, q binary")


def readable(rows: DataFrame, features: list[str], label: str) -> tuple[DataFrame, int, float] | None:
    """(columns as doubles, number of rows, mean label); None if MLlib might refuse a value or sees a vector."""
    kinds = {f.name: f.dataType.typeName() for f in rows.schema.fields}
    if not all(kinds.get(c) in ("double", "float", "long", "integer", "short", "byte", "boolean") for c in [*features, label]):
        return None
    df = _columns(rows, features, label)
    bad = [~F.coalesce(F.abs(F.col(c)) < F.lit(float("inf")), F.lit(False)) for c in df.columns]  # NULL, NaN, infinite
    total, refused, centre = df.agg(
        F.count("*"), F.sum(F.when(F.array_contains(F.array(*bad), True), 1).otherwise(0)), F.avg(df.columns[-1])).first()
    return None if not total or refused else (df, total, centre)


def fit_cells(rows: DataFrame, features: list[str], label: str, gbt: GBTRegressor, least_rows: int) -> GBTRegressionModel | None:
    """The model that MLlib's fit of ``gbt`` gives, but for rounding; None where the fit is left to MLlib: fewer than ``least_rows``
    rows, values it refuses, parameters that it alone knows, or too many cells.

    ``rows`` are read several times and in the order of their partitions, so they should be kept.
    """
    rules, spark = rules_of(gbt), rows.sparkSession
    read = readable(rows, features, label) if rules else None
    if read is None or read[1] < least_rows:
        return None
    df, total, centre = read
    seed, most = gbt.getSeed(), min(gbt.getMaxBins(), total) - 1
    share = sampled_share(total, most + 1)
    edges = [thresholds(v, share * total, most) for v in _sample(df, share, seed)[:-1]]
    widths = [e.size + 1 for e in edges]
    if math.prod(widths) > 1 << 62:
        return None
    binned = _binned(df, edges, centre).persist(StorageLevel.DISK_ONLY)
    try:
        found = binned.groupBy("cell").count().limit(MOST_CELLS + 1).toArrow()
        if found.num_rows > MOST_CELLS:
            return None
        cells, sizes = numbers(found)
        order = np.argsort(cells)
        cells, sizes = cells[order], sizes[order]
        salts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
        hot = cells[sizes > max(total // (4 * salts), CHUNK_ROWS)]
        booster = Booster(bins_of(cells, widths), widths, centre, rules)
        block = max(8, min(128, BLOCK // cells.size))
        for first in range(0, rules.trees, block):
            last = min(first + block, rules.trees)
            sums = [np.zeros((cells.size, last - first)) for _ in range(3)]
            table = _sums(binned, hot, salts, seed, first, last, rules.rate).toArrow()
            for b in table.to_batches():
                at = np.searchsorted(cells, b.column(0).to_numpy())
                for k, kind in enumerate((np.int64, float, float)):
                    got = np.array([np.frombuffer(x.as_buffer(), kind) for x in b.column(k + 1)])
                    np.add.at(sums[k], at, got)
            for n, s, q in zip(*(np.ascontiguousarray(x.T) for x in sums)):
                booster.add(n, s, q)
    finally:
        binned.unpersist()
    return as_model(spark, gbt, booster.trees, edges)


# The search


@dataclass(frozen=True)
class Held:
    """All rows of a search in their partitions' order: features, label, fold and the first row of each partition."""

    columns: list[np.ndarray]
    y: np.ndarray
    fold: np.ndarray
    begins: np.ndarray


def fit_held(held: Held, fold: int, rules: list[Rules], seed: int, max_bins: int, keep: bool = False) -> tuple[list[Booster], list[np.ndarray], np.ndarray]:
    """(fits without the rows of ``fold``, thresholds, cell of each row). Fits of one fold share thresholds, cells and draws."""
    train = np.flatnonzero(held.fold != fold)
    sizes = np.diff(np.searchsorted(train, held.begins))
    share = sampled_share(train.size, min(max_bins, train.size))
    begins = np.concatenate([[0], sizes.cumsum()])
    picked = train[np.concatenate([
        begins[p] + next(sampled_rows(share, seed, p, [int(size)])) for p, size in enumerate(sizes)]).astype(np.intp)]
    edges = [thresholds(c[picked], share * train.size, min(max_bins, train.size) - 1) for c in held.columns]
    widths = [e.size + 1 for e in edges]
    cells, cell = np.unique(codes(held.columns, edges), return_inverse=True)
    order = np.argsort(cell[train], kind="stable")
    own = cell[train][order]
    starts = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
    filled, centre = own[starts], float(held.y[train].mean())
    y, bins = held.y[train][order] - centre, bins_of(cells, widths)
    boosters = [Booster(bins, widths, centre, r, keep) for r in rules]
    limits, most = [limit_of(r.rate) for r in rules], max(r.trees for r in rules)
    sums = [np.zeros(cells.size) for _ in range(3)]
    for first in range(0, most, 8):
        last = min(first + 8, most)
        drawn = np.concatenate([Streams(tree_seeds(seed, first, last, p)).draw(int(size)) for p, size in enumerate(sizes)], axis=1)
        for m, draws in enumerate(drawn, first):
            draws = draws[order]
            for booster, limit in zip(boosters, limits):
                if m < booster.rules.trees:
                    values = (draws < np.uint64(limit)).astype(float)
                    for k in range(3):
                        sums[k][filled] = np.add.reduceat(values, starts)
                        values *= y
                    booster.add(*sums)
    return boosters, edges, cell


def search_cells(
    rows: DataFrame, features: list[str], label: str, trials: list[GBTRegressor], folds: int, most_rows: int,
) -> tuple[list[float], GBTRegressionModel] | None:
    """(mean absolute error of each trial over the folds, model of the best trial), as a CrossValidator gives them but for rounding.

    Up to ``most_rows`` rows travel to every task, which makes all trees of some trials without one fold. None where that is too
    many, or where a fit has to be left to MLlib.
    """
    spark, rules = rows.sparkSession, [rules_of(g) for g in trials]
    seed, max_bins = trials[0].getSeed(), trials[0].getMaxBins()
    if None in rules or max_bins ** len(features) > 1 << 62:
        return None
    read = readable(rows, features, label)
    if read is None or read[1] > most_rows:
        return None
    place = read[0].select("*", F.rand(seed).alias("_rand"), F.spark_partition_id().alias("_part"))
    *columns, y, drawn, part = numbers(place.toArrow())
    fold, step = np.full(y.size, -1), 1.0 / folds  # the bounds of CrossValidator
    for f in range(folds):
        fold[(drawn >= f * step) & (drawn < (f + 1) * step)] = f
    begins = np.searchsorted(part, np.arange(part.max() + 2))
    held = Held(columns, y, fold, begins)
    if any((fold == f).all() for f in range(folds)):
        return None
    # trials of one task share the draws; the longest and the shortest go together
    groups = max(1, -(-len(trials) // 5))
    by_length = sorted(range(len(trials)), key=lambda t: -rules[t].trees * rules[t].depth)
    dealt = [[] for _ in range(groups)]
    for k, t in enumerate(by_length):
        dealt[k % groups if k // groups % 2 == 0 else groups - 1 - k % groups].append(t)
    tasks = [(f, some) for some in dealt for f in range(folds)]
    sent = spark.sparkContext.broadcast(held)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for task in b.column(0).to_pylist():
                (f, some), rows = tasks[task], sent.value
                boosters, _, cell = fit_held(rows, f, [rules[t] for t in some], seed, max_bins)
                out = np.flatnonzero(rows.fold == f)
                errors = [float(np.abs(rows.y[out] - x.centre - x.pred[cell[out]]).mean()) if out.size else math.nan for x in boosters]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(some, pa.int32()), pa.array([f] * len(some), pa.int32()), pa.array(errors, pa.float64())], ["trial", "fold", "mae"])

    try:
        found = spark.range(0, len(tasks), 1, len(tasks)).mapInArrow(run, "trial int, fold int, mae double").collect()
    finally:
        sent.unpersist()
    errors = np.full((len(trials), folds), math.nan)
    for r in found:
        errors[r["trial"], r["fold"]] = r["mae"]
    mean = errors.mean(axis=1)
    best = int(mean.argmin())
    (booster,), edges, _ = fit_held(held, -2, [rules[best]], seed, max_bins, keep=True)
    return mean.tolist(), as_model(spark, trials[best], booster.trees, edges)
