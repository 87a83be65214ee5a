"""Trie of conversation prefixes from the neighbours of a sorted list (operator 12).

Different conversations are sorted by their turns. The depth to which two neighbours agree is an edge between them, and
union-find over these edges, deepest first, makes a node of the trie at every merge. Each range of the list is merged
on its own in lots of bounded size; what may still grow beyond a border, the nodes above its first and its last
conversation, is kept as a contracted forest. Forests of neighbouring ranges are joined where their borders agree,
in rounds of ``fan`` ranges, until one is left.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from heatframe.llm import files

TURN = 16  # bytes of a turn's digest
LOT_TURNS = 1 << 16
FAN = 32
IDS_BYTES = 1 << 20
BROADCAST_ROWS = 500_000
NO_ID = (1 << 63) - 1

NODE = ("kind string, place long, conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, "
        "saved_tokens long, ends binary, key binary, parent_key binary, forest binary")
NODE_SCHEMA = pa.schema([
    ("kind", pa.string()), ("place", pa.int64()), ("conv_id", pa.int64()), ("depth", pa.int64()), ("parent_conv_id", pa.int64()),
    ("n_convs", pa.int64()), ("n_children", pa.int64()), ("n_leaves", pa.int64()), ("saved_tokens", pa.int64()),
    ("ends", pa.binary()), ("key", pa.binary()), ("parent_key", pa.binary()), ("forest", pa.binary())])


@dataclass(slots=True)
class Part:
    """What a node holds beside the children that may still grow: members, their smallest id, closed children with
    their leaves and savings, and the key of the conversations that end here."""

    n: int = 0
    least: int = NO_ID
    kids: int = 0
    leaves: int = 0
    saved: int = 0
    ends: bytes | None = None

    def take(self, other: Part) -> None:
        """The same node's part of another range."""
        self.n += other.n
        self.least = min(self.least, other.least)
        self.kids += other.kids
        self.leaves += other.leaves
        self.saved += other.saved
        self.ends = self.ends or other.ends

    def adopt(self, n: int, least: int, leaves: int, saved: int) -> None:
        """A child that is closed."""
        self.take(Part(n, least, 1, leaves, saved))


@dataclass(slots=True)
class Forest:
    """The open nodes of a range: those above its first and its last conversation, which agree up to depth ``shared``.

    left[d] is the node at depth d above the first one, right[d - shared - 1] that above the last one, beyond ``shared``.
    """

    first: bytes
    first_chars: list[int]
    last: bytes
    last_chars: list[int]
    shared: int
    left: list[Part] = field(default_factory=list)
    right: list[Part] = field(default_factory=list)

    def packed(self) -> bytes:
        ints = [self.shared, len(self.first_chars), len(self.last_chars), *self.first_chars, *self.last_chars]
        parts = [*self.left, *self.right]
        for p in parts:
            ints += [p.n, p.least, p.kids, p.leaves, p.saved, p.ends is not None]
        ends = b"".join(p.ends for p in parts if p.ends is not None)
        return np.array([len(ints), *ints], "i8").tobytes() + self.first + self.last + ends

    @staticmethod
    def unpacked(data: bytes) -> Forest:
        count = int(np.frombuffer(data, "i8", 1)[0])
        ints = np.frombuffer(data, "i8", count + 1)[1:].tolist()
        at = 8 * (count + 1)
        shared, n_first, n_last = ints[:3]
        first_chars, last_chars = ints[3:3 + n_first], ints[3 + n_first:3 + n_first + n_last]
        first, at = data[at:at + n_first * TURN], at + n_first * TURN
        last, at = data[at:at + n_last * TURN], at + n_last * TURN
        parts = []
        for k in range(3 + n_first + n_last, count, 6):
            n, least, kids, leaves, saved, has = ints[k:k + 6]
            parts.append(Part(n, least, kids, leaves, saved, data[at:at + TURN] if has else None))
            at += TURN * has
        return Forest(first, first_chars, last, last_chars, shared, parts[:n_first + 1], parts[n_first + 1:])


def agree(a: bytes, b: bytes) -> int:
    """How many turns two conversations have in common at their start."""
    k = min(len(a), len(b))
    differ = np.flatnonzero(np.frombuffer(a, "u1", k) != np.frombuffer(b, "u1", k))
    return (int(differ[0]) if len(differ) else k) // TURN


def keys(seq: bytes) -> list[bytes]:
    """Keys of the nodes above a conversation, by depth."""
    out = [b"root"]
    for k in range(0, len(seq), TURN):
        out.append(sha256(out[-1] + seq[k:k + TURN]).digest()[:TURN])
    return out


def _row(conv, depth, parent, n, kids, leaves, saved, ends, key=None, parent_key=None):
    return ("pending" if parent_key else "node", None, conv, depth, parent, n, kids, leaves, saved, ends, key, parent_key, None)


def close(parts: list[Part], depth: int, seq: bytes, chars: list[int], rows: list) -> tuple[int, int, int, int]:
    """Rows of the nodes that begin at ``depth`` on the way to seq, the deepest first; what the topmost one adds to its parent."""
    names = keys(seq[:TURN * (depth + len(parts) - 1)])
    n, least, leaves, saved, found = 0, NO_ID, 0, 0, []
    for d in range(depth + len(parts) - 1, depth - 1, -1):
        part = parts[d - depth]
        n, least = n + part.n, min(least, part.least)
        kids = part.kids + bool(found)
        leaves = leaves + part.leaves if kids else 1
        saved += part.saved + ((n - 1) * chars[d - 1] if d else 0)
        found.append((least, d, n, kids, leaves, saved, part.ends))
    for k, (conv, d, *rest) in enumerate(found):
        above = found[k + 1][0] if k + 1 < len(found) else None
        rows.append(_row(conv, d, above, *rest, key=names[d], parent_key=names[d - 1] if above is None and d else None))
    return n, least, leaves, saved


def lot_forest(seqs: list[bytes], chars: list[list[int]], sizes: list[int], convs: list[int], ends: list[bytes], rows: list) -> Forest:
    """Union-find over the neighbours of sorted, different conversations; rows of the nodes that are closed."""
    m = len(seqs)
    edges = [0] + [agree(seqs[i - 1], seqs[i]) for i in range(1, m)]
    sums = [np.concatenate([[0], np.cumsum(c)]).tolist() for c in chars]
    depth, rep = [len(s) // TURN for s in seqs], list(range(m))
    own = [Part(n, c, ends=e) for n, c, e in zip(sizes, convs, ends)]
    whole = [Part(n, c) for n, c in zip(sizes, convs)]
    up = [-1] * m
    parent, top = list(range(m)), list(range(m))

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    def totals(c: int, above: int) -> tuple[int, int, int, int]:
        """What node c with the chain up to below depth ``above`` adds to the node there."""
        w, s = whole[c], sums[rep[c]]
        return w.n, w.least, w.leaves if w.kids else 1, w.saved + (w.n - 1) * (s[depth[c]] - s[above])

    def attach(c: int, p: int) -> None:
        up[c] = p
        whole[p].adopt(*totals(c, depth[p]))

    for i in sorted(range(1, m), key=lambda i: -edges[i]):
        a, b = find(i - 1), find(i)
        p = top[a]
        if depth[p] != edges[i]:
            p = len(depth)
            depth.append(edges[i])
            rep.append(rep[top[a]])
            own.append(Part())
            whole.append(Part())
            up.append(-1)
            attach(top[a], p)
        attach(top[b], p)
        parent[b], top[a] = a, p

    opened, ways = set(), []
    for leaf in (0, m - 1):
        way = [leaf]
        while up[way[-1]] >= 0:
            way.append(up[way[-1]])
        ways.append(way)
        opened.update(way)
    shared = min(edges[1:], default=depth[0])
    names = {c: keys(seqs[end])[depth[c]] for end, way in zip((0, m - 1), ways) for c in way}
    for c in range(len(depth)):
        if c in opened:
            continue
        p, w, s = up[c], whole[c], sums[rep[c]]
        n, least, leaves, saved = totals(c, depth[p])
        is_open = p in opened
        if is_open:
            own[p].adopt(n, least, leaves, saved)
        for d in range(depth[c], depth[p], -1):
            first = d == depth[p] + 1
            rows.append(_row(least, d, None if first and is_open else whole[p].least if first else least, n,
                             w.kids if d == depth[c] else 1, leaves, w.saved + (n - 1) * (s[depth[c]] - s[d - 1]),
                             own[c].ends if d == depth[c] else None, parent_key=names[p] if first and is_open else None))
    left = [Part() for _ in range(depth[0] + 1)]
    right = [Part() for _ in range(depth[m - 1] - shared)]
    for c in ways[0]:
        left[depth[c]] = own[c]
    for c in ways[1]:
        if depth[c] > shared:
            right[depth[c] - shared - 1] = own[c]
    return Forest(seqs[0], chars[0], seqs[-1], chars[-1], shared, left, right)


def joined(a: Forest, b: Forest, rows: list) -> Forest:
    """The forest of two ranges, a before b; rows of the nodes that no longer reach a border."""
    met = agree(a.last, b.first)

    def at_end(d: int) -> Part:
        return a.left[d] if d <= a.shared else a.right[d - a.shared - 1]

    for way, low, seq, chars, part in ((a.right, a.shared, a.last, a.last_chars, at_end), (b.left, b.shared, b.first, b.first_chars, b.left.__getitem__)):
        # nodes of one side alone, below the deepest one that stays or is common
        stays = max(met, low)
        tail = way[stays - low:] if way is a.right else way[stays + 1:]
        if tail:
            part(stays).adopt(*close(tail, stays + 1, seq, chars, rows))
    common = [at_end(d) for d in range(met + 1)]
    for d, part in enumerate(common):
        part.take(b.left[d])
    stays = max(a.shared, b.shared)
    if met > stays:
        common[stays].adopt(*close(common[stays + 1:], stays + 1, a.last, a.last_chars, rows))
    shared = min(a.shared, met, b.shared)
    right = [common[d] if d <= min(met, b.shared) else b.left[d] if d <= b.shared else b.right[d - b.shared - 1]
             for d in range(shared + 1, len(b.last) // TURN + 1)]
    return Forest(a.first, a.first_chars, b.last, b.last_chars, shared, a.left, right)


def finished(f: Forest, rows: list) -> None:
    """Rows of all nodes that are left, up to the root."""
    for way, seq, chars in ((f.right, f.last, f.last_chars), (f.left[f.shared + 1:], f.first, f.first_chars)):
        if way:
            f.left[f.shared].adopt(*close(way, f.shared + 1, seq, chars, rows))
    close(f.left[:f.shared + 1], 0, f.first, f.first_chars, rows)


def _forest_row(place: int, f: Forest):
    return ("forest", place, *[None] * 10, f.packed())


def _size(row: tuple) -> int:
    return 100 + len(row[-1] or b"")


def _range_forests(incoming: Iterable[pa.RecordBatch], lot_turns: int) -> Iterator[pa.RecordBatch]:
    """Nodes of a sorted range, in lots; the forest that is left."""
    def rows():
        out, held, turns, forest = [], [], 0, None

        def grown(forest):
            more = lot_forest(*map(list, zip(*held)), out)
            return joined(forest, more, out) if forest else more

        for row in files.rows_of(incoming):
            held.append(row)
            turns += 1 + len(row[1])
            if turns >= lot_turns:
                forest, held, turns = grown(forest), [], 0
                yield from out
                out.clear()
        if held:
            forest = grown(forest)
        yield from out
        if forest:
            yield _forest_row(TaskContext.get().partitionId(), forest)

    yield from files.batches(rows(), NODE_SCHEMA, _size)


def _merge_forests(last: bool):
    def merge(incoming: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for b in incoming:
                for place, forests in zip(b.column(0).to_pylist(), b.column(1)):
                    forest, out = None, []
                    for packed in forests.as_py():
                        more = Forest.unpacked(packed)
                        forest = joined(forest, more, out) if forest else more
                        yield from out
                        out.clear()
                    if last:
                        finished(forest, out)
                        yield from out
                    else:
                        yield _forest_row(place, forest)

        yield from files.batches(rows(), NODE_SCHEMA, _size)

    return merge


def member_hashes(members: DataFrame, folder: str) -> DataFrame:
    """group, ends_sha256 (of the ids of members (group binary, conv_id), ascending, decimal, joined by commas).

    Ids are joined in ranges first; the hash of a large group then reads pieces of up to IDS_BYTES one by one.
    """
    def pieces(incoming: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("group", pa.binary()), ("first", pa.int64()), ("ids", pa.binary())])

        def rows():
            group, first, held, size = None, 0, [], 0
            for g, c in files.rows_of(incoming):
                if held and (g != group or size > IDS_BYTES):
                    yield group, first, ",".join(held).encode()
                    held, size = [], 0
                if not held:
                    group, first = g, c
                held.append(str(c))
                size += len(held[-1]) + 1
            if held:
                yield group, first, ",".join(held).encode()

        yield from files.batches(rows(), schema, lambda r: len(r[2]))

    def hashed(incoming: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            group, state = None, None
            for g, _, ids in files.rows_of(incoming):
                if state is None or g != group:
                    if state is not None:
                        yield group, state.hexdigest()
                    group, state = g, sha256(ids)
                else:
                    state.update(b"," + ids)
            if state is not None:
                yield group, state.hexdigest()

        yield from files.batches(rows(), pa.schema([("group", pa.binary()), ("ends_sha256", pa.string())]))

    spark = members.sparkSession
    members.select("group", "conv_id").repartitionByRange("group", "conv_id").sortWithinPartitions("group", "conv_id").mapInArrow(
        pieces, "group binary, first long, ids binary").write.parquet(folder)
    return spark.read.parquet(folder).repartition("group").sortWithinPartitions("group", "first").mapInArrow(
        hashed, "group binary, ends_sha256 string")


def prefix_trie(sequences: DataFrame, folder: str, lot_turns: int = LOT_TURNS, fan: int = FAN) -> DataFrame:
    """The nodes of the trie over sequences (conv_id long, turns array<struct<digest: 32 hex digits, chars: long>>).

    One row for each different prefix, the empty one included: conv_id (smallest member), depth, parent_conv_id (null at
    the root), n_convs, n_children, n_leaves, saved_tokens, ends_sha256. A conversation without turns ends at the root.
    Rows without an id are left out; ids must differ. Without sequences there is no node. A sequence's digests must
    fit into one row: 16 bytes a turn.
    """
    spark = sequences.sparkSession

    def written(df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{folder}/{name}")
        return spark.read.parquet(f"{folder}/{name}")

    seq = F.unhex(F.array_join("turns.digest", ""))
    known = written(sequences.where("conv_id IS NOT NULL").select("conv_id", seq.alias("seq"), F.col("turns.chars").alias("chars"))
                    .withColumn("group", F.unhex(F.substring(F.sha2("seq", 256), 1, 2 * TURN))), "sequences")
    classes = written(known.groupBy("group").agg(
        F.first("seq").alias("seq"), F.first("chars").alias("chars"), F.count("*").alias("n"), F.min("conv_id").alias("conv_id")), "classes")
    dealt = classes.select("seq", "chars", "n", "conv_id", "group").repartitionByRange("seq").sortWithinPartitions("seq")
    tables = [written(dealt.mapInArrow(lambda rows: _range_forests(rows, lot_turns), NODE), "nodes-0")]
    while (left := (forests := tables[-1].where("kind = 'forest'")).count()) > 0:
        groups = forests.groupBy(F.floor(F.col("place") / fan).alias("place")).agg(
            F.sort_array(F.collect_list(F.struct("place", "forest"))).alias("f")).select("place", F.col("f.forest").alias("forests"))
        if left <= fan:  # all in one row
            groups = forests.agg(F.sort_array(F.collect_list(F.struct("place", "forest"))).alias("f")).select(
                F.lit(0).cast("long").alias("place"), F.col("f.forest").alias("forests"))
        tables.append(written(groups.mapInArrow(_merge_forests(left <= fan), NODE), f"nodes-{len(tables)}"))
    found = tables[0]
    for more in tables[1:]:
        found = found.unionByName(more)
    names = found.where("key IS NOT NULL").select(F.col("key").alias("parent_key"), F.col("conv_id").alias("of_parent"))
    if names.count() <= BROADCAST_ROWS:
        names = F.broadcast(names)
    nodes = found.where("kind = 'node'").unionByName(
        found.where("kind = 'pending'").join(names, "parent_key").withColumn("parent_conv_id", F.col("of_parent")).select(*found.columns))
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens"]
    ends = member_hashes(known, f"{folder}/members")
    ended = nodes.where("ends IS NOT NULL").join(ends.withColumnRenamed("group", "ends"), "ends").select(*columns, "ends_sha256")
    return ended.unionByName(nodes.where("ends IS NULL").select(*columns, F.sha2(F.lit(b""), 256).alias("ends_sha256")))


def turn_sequences(conversations: DataFrame) -> DataFrame:
    """conv_id, turns (digest of role and text, code points of the text) of every conversation, in order of turn.

    A null turn comes first; rows of one turn stand by their digests; null roles and texts are empty. Rows without
    a conv_id are left out.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    name = F.substring(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256), 1, 2 * TURN)
    rows = conversations.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long"), F.col("turn").cast("long"), name.alias("digest"), F.char_length(text).cast("long").alias("chars"))
    return rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "digest", "chars"))).alias("t")).select(
        "conv_id", F.transform("t", lambda x: F.struct(x["digest"].alias("digest"), x["chars"].alias("chars"))).alias("turns"))


def with_shared_starts(sequences: DataFrame, group: int = 100, most: int = 6) -> DataFrame:
    """sequences whose first h = crc32(conv_id) % most turns are those of conversation conv_id - conv_id % group,
    all if it has fewer, none if it is not there; their own turns after the first h follow."""
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % most).cast("int")
    base = F.col("conv_id") - F.col("conv_id") % group
    heads = sequences.where(F.col("conv_id") == base).select(
        F.col("conv_id").alias("base"), F.slice("turns", 1, most).alias("head"))
    rows = sequences.withColumns({"h": h, "base": base}).join(heads, "base", "left")
    own = F.slice("turns", F.col("h") + 1, F.greatest(F.size("turns") - F.col("h"), F.lit(0)))
    head: Column = F.coalesce(F.slice("head", F.lit(1), F.col("h")), F.slice("turns", 1, 0))
    return rows.select("conv_id", F.concat(head, own).alias("turns"))
