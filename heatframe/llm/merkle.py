"""Merkle manifest of a table as a persistent tree with copied paths (operator 11).

The leaves of a scope stand in a given order and are cut into aligned blocks of ``2 ** levels``. A block is one row
that holds all its nodes; the tops of a scope's blocks are the leaves of the next tier of blocks, and the tops of the
scopes are the leaves of one more tree. No row is larger than a block, however many leaves a scope has.

A changed leaf makes a version of the tree: only the nodes above the leaf are new, first in its block, then on along
the way that the upper tiers give the block. All other nodes are those of the stored blocks. Versions of different
leaves do not see each other.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from heatframe.llm import files
from heatframe.llm.ordering import placed

LEVELS = 10
HEX = 64
ALONE, LEFT, RIGHT = b"0", b"1", b"2"  # where a node's sibling stands
STEP = 1 + HEX
BROADCAST_ROWS = 20_000  # ways of about 2 KB


def encoded(*columns: Column) -> Column:
    """Values one after the other, each ``-`` if null, else its number of UTF-8 bytes, a colon and itself."""
    text = [c.cast("string") for c in columns]
    return F.concat(*[F.coalesce(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c), F.lit("-")) for c in text])


def digest(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def scope_of(column: Column) -> Column:
    """A scope that is never null and sorts null first, then by bytes."""
    return F.coalesce(F.concat(F.lit("="), column.cast("string")), F.lit("-"))


def _parents(nodes: list[bytes]) -> list[bytes]:
    return [sha256(b"".join(nodes[k:k + 2])).hexdigest().encode() for k in range(0, len(nodes), 2)]


def grown(leaves: list[bytes], whole: bool, levels: int) -> list[list[bytes]]:
    """Levels of a block, leaves first. A block that is its ``whole`` scope ends at one node, others after ``levels``."""
    out = [leaves]
    while len(out[-1]) > 1 if whole else len(out) <= levels:
        out.append(_parents(out[-1]))
    return out


def stored(nodes: bytes, n: int) -> list[list[bytes]]:
    """The levels of a stored block of n leaves."""
    out, at = [], 0
    while at < len(nodes):
        out.append([nodes[k:k + HEX] for k in range(at, at + n * HEX, HEX)])
        at += n * HEX
        n = (n + 1) // 2
    return out


def way(levels: list[list[bytes]], at: int) -> bytes:
    """The siblings met from a leaf up to the block's top, STEP bytes for each level."""
    out = []
    for nodes in levels[:-1]:
        other = at ^ 1
        out.append((LEFT if other < at else RIGHT) + nodes[other] if other < len(nodes) else ALONE + b"-" * HEX)
        at >>= 1
    return b"".join(out)


def copied(leaf: bytes, steps: bytes) -> list[bytes]:
    """The nodes above a leaf along ``steps``; the last one is the root."""
    out, node = [], leaf
    for k in range(0, len(steps), STEP):
        side, other = steps[k:k + 1], steps[k + 1:k + STEP]
        node = sha256(node if side == ALONE else other + node if side == LEFT else node + other).hexdigest().encode()
        out.append(node)
    return out


def siblings(steps: bytes) -> bytes:
    return b"".join(steps[k + 1:k + STEP] for k in range(0, len(steps), STEP) if steps[k:k + 1] != ALONE)


class MerkleTree:
    """The stored tree over leaves: scope (no nulls), leaf (lowercase hex digest), the columns of ``order`` and others.

    Leaves of a scope ascend by ``order`` with nulls first, then by their digests; scopes ascend by their bytes. Other
    columns stay with their leaf (they must have an order, so no maps). ``blocks`` holds the lowest tier's nodes, one
    row a block; ``ways`` has for each block its siblings up to the root, its scope's root and the root. Without
    leaves both are empty.
    """

    def __init__(self, leaves: DataFrame, folder: str, order: tuple[str, ...] = ("doc_id",), levels: int = LEVELS):
        self.spark, self.folder, self.levels = leaves.sparkSession, folder, levels
        given = [c for c in leaves.columns if c not in ("scope", "leaf")]
        rows = placed(leaves, "scope", [*order, "leaf"], f"{folder}/leaves")
        self.blocks = self._tier(rows.withColumn("given", F.struct(*given)), "blocks")
        inner = self._climb(_tops(self.blocks), "scopes")
        roots = inner.where("place = 0").select(F.lit("").alias("scope"), F.col("scope").alias("name"), F.col("root").alias("leaf"))
        named = placed(roots, "scope", ["name"], f"{folder}/names")
        outer = named.select("place", "name").join(
            self._climb(named, "roots").select("place", F.col("way").alias("outer"), F.col("root").alias("whole")), "place").drop("place")
        self.ways = self._written(inner.join(outer, inner["scope"] == outer["name"]).select(
            "scope", F.col("place").alias("block"), F.concat("way", "outer").alias("way"),
            F.col("root").alias("subroot"), F.col("whole").alias("root")), "ways")

    def _written(self, df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{self.folder}/{name}")
        return self.spark.read.parquet(f"{self.folder}/{name}")

    def _tier(self, rows: DataFrame, name: str) -> DataFrame:
        """Blocks over rows (scope, place, in_scope, leaf, given if any): scope, block, blocks (of the scope),
        n (leaves), nodes (digests level by level), given."""
        more = [c for c in rows.columns if c == "given"]
        held = rows.groupBy("scope", F.expr(f"shiftright(place, {self.levels})").alias("block")).agg(
            F.expr(f"shiftright(max(in_scope) - 1, {self.levels}) + 1").alias("blocks"), F.count("*").alias("n"),
            F.sort_array(F.collect_list(F.struct("place", "leaf", *more))).alias("items"))
        held = held.select("scope", "block", "blocks", "n", F.array_join("items.leaf", "").cast("binary").alias("nodes"),
                           *[F.col(f"items.{c}").alias(c) for c in more])

        depth = self.levels

        def grow(incoming: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in incoming:
                nodes = []
                for leaves, n, blocks in zip(*(b.column(c).to_pylist() for c in ("nodes", "n", "blocks"))):
                    levels = grown(stored(leaves, n)[0], blocks == 1, depth)
                    nodes.append(b"".join(node for level in levels for node in level))
                at = b.schema.get_field_index("nodes")
                yield b.set_column(at, b.schema.field(at), pa.array(nodes, b.schema.field(at).type))

        return self._written(held.mapInArrow(grow, held.schema), name)

    def _climb(self, rows: DataFrame, name: str) -> DataFrame:
        """rows (scope, place, in_scope, leaf) with the way to their scope's root: scope, place, way, root."""
        tiers = []
        while True:
            blocks = self._tier(rows.select("scope", "place", "in_scope", "leaf"), f"{name}-{len(tiers)}")
            tiers.append(_ways(blocks, self.levels))
            rows = _tops(blocks)
            if blocks.where("blocks > 1").isEmpty():
                break
        up = rows.select("scope", "place", F.lit(b"").alias("way"), F.col("leaf").alias("root"))
        for tier in reversed(tiers):
            up = up.select("scope", F.col("place").alias("block"), F.col("way").alias("up"), "root")
            up = tier.join(up, ["scope", "block"]).select("scope", "place", F.concat("way", "up").alias("way"), "root")
        return up

    def versions(self, changed: str | None = None) -> DataFrame:
        """Every leaf with its proof, and with the version of the tree that its change makes.

        scope, place, leaf, given (the leaf's other columns), siblings (their digests up to the root, joined), subroot,
        root, copies (the version's own nodes, from above the leaf to its root; null where ``given.<changed>`` is null
        or no column is named), folded_root (the root recomputed from the changed leaf, else from the leaf itself).
        """
        ways = self.ways
        if ways.count() <= BROADCAST_ROWS:
            ways = F.broadcast(ways)
        held = self.blocks.join(ways, ["scope", "block"]).select("scope", "block", "n", "nodes", "given", "way", "subroot", "root")
        given = held.schema["given"].dataType.elementType.simpleString()
        schema = (f"scope string, place long, leaf string, given {given}, siblings string, subroot string, root string, "
                  "copies array<string>, folded_root string")

        depth = self.levels

        def read(incoming: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in incoming:
                for k in range(b.num_rows):
                    scope, block, n, nodes, _, upper, subroot, root = (c[k].as_py() if c is not b.column(4) else None for c in b.columns)
                    given = b.column(4)[k].values
                    new = [x[changed] for x in given.to_pylist()] if changed else [None] * n
                    levels = stored(nodes, n)
                    out = ([], [], [], [])
                    for at, leaf in enumerate(levels[0]):
                        steps = way(levels, at) + upper
                        above = copied(new[at].encode() if new[at] else leaf, steps)
                        out[0].append(leaf)
                        out[1].append(siblings(steps))
                        out[2].append(above if new[at] else None)
                        out[3].append(above[-1] if above else new[at] or leaf)
                    names = ["scope", "place", "leaf", "given", "siblings", "subroot", "root", "copies", "folded_root"]
                    yield pa.record_batch([
                        pa.array([scope] * n), pa.array(range(block << depth, (block << depth) + n), pa.int64()),
                        pa.array(out[0], pa.binary()).cast(pa.string()), given, pa.array(out[1], pa.binary()).cast(pa.string()),
                        pa.array([subroot] * n), pa.array([root] * n), pa.array(out[2], pa.list_(pa.binary())).cast(pa.list_(pa.string())),
                        pa.array(out[3]).cast(pa.binary()).cast(pa.string())], names)

        return held.mapInArrow(read, schema)


def _tops(blocks: DataFrame) -> DataFrame:
    """The tops of blocks as rows of the next tier."""
    top = F.expr(f"substring(nodes, -{HEX}, {HEX})").cast("string")
    return blocks.select("scope", F.col("block").alias("place"), F.col("blocks").alias("in_scope"), top.alias("leaf"))


def _ways(blocks: DataFrame, levels: int) -> DataFrame:
    """scope, block, place, way (up to the block's top) of the leaves of blocks."""
    schema = pa.schema([("scope", pa.string()), ("block", pa.int64()), ("place", pa.int64()), ("way", pa.binary())])

    def walk(incoming: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for scope, block, n, nodes in files.rows_of(incoming):
                digests = stored(nodes, n)
                for at in range(n):
                    yield scope, block, (block << levels) + at, way(digests, at)

        yield from files.batches(rows(), schema, lambda r: len(r[3]))

    return blocks.select("scope", "block", "n", "nodes").mapInArrow(walk, "scope string, block long, place long, way binary")


def manifest(docs: DataFrame, folder: str, scope: str = "lang", order: str = "doc_id",
             fields: tuple[str, ...] = ("doc_id", "source", "lang", "n_chars", "text"), raised: str = "n_chars",
             every: int = 7, levels: int = LEVELS) -> DataFrame:
    """The manifest of docs checked against tampered rows: doc_id, leaf, subroot, root, siblings, copies, folded_root, verified.

    A leaf is the digest of the encoded ``fields``, scopes are the values of ``scope``. Where ``every`` divides the
    unsigned crc32 of the decimal id, tampering adds 1 to ``raised``; a null stays, and so do rows without an id.
    Repeated rows are leaves of their own, one after the other; rows without an id come first in their scope; null
    texts and scopes count as nulls, empty ones as empty values; other columns play no part. No rows, no result.
    """
    plain = encoded(*[F.col(c) for c in fields])
    other = encoded(*[F.col(c) + 1 if c == raised else F.col(c) for c in fields])
    tampered = (F.crc32(F.col(order).cast("string").cast("binary")) % every == 0) & F.col(raised).isNotNull()
    leaves = docs.select(scope_of(F.col(scope)).alias("scope"), F.col(order).cast("long").alias("doc_id"),
                         digest(plain).alias("leaf"), F.when(tampered, digest(other)).alias("changed"))
    tree = MerkleTree(leaves, folder, ("doc_id",), levels)
    return tree.versions("changed").select(
        "given.doc_id", "leaf", "subroot", "root", "siblings", "copies", "folded_root",
        (F.col("folded_root") == F.col("root")).alias("verified"))
