"""Merkle manifest and prefix trie against plain loops."""

import random
from collections import defaultdict
from hashlib import sha256
from zlib import crc32

import pytest
from fixtures import documents, rows_of, texts
from pyspark.sql import functions as F

from heatframe.llm.merkle import MerkleTree, manifest
from heatframe.llm.ordering import placed
from heatframe.llm.prefix_trie import prefix_trie, turn_sequences, with_shared_starts

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def h(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def leaf(row, more=0):
    values = [row[0], row[3], row[2], None if row[4] is None else row[4] + more, row[1]]
    return h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in values])


def levels(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([h(*out[-1][k:k + 2]) for k in range(0, len(out[-1]), 2)])
    return out


def plain_manifest(rows):
    """The root of every tampered row comes from a tree that is built anew."""
    scopes = defaultdict(list)
    for r in rows:
        scopes["-" if r[2] is None else "=" + r[2]].append(r)
    for rs in scopes.values():
        rs.sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
    names = sorted(scopes, key=str.encode)

    def trees(changed=None):
        own = {s: levels([leaf(r, (s, k) == changed) for k, r in enumerate(scopes[s])]) for s in names}
        return own, levels([own[s][-1][0] for s in names])

    own, top = trees()
    out = []
    for s in names:
        for k, r in enumerate(scopes[s]):
            proof, at = [], k
            for nodes, start in ((own[s], k), (top, names.index(s))):
                at = start
                for level in nodes[:-1]:
                    if at ^ 1 < len(level):
                        proof.append(level[at ^ 1])
                    at //= 2
            bad = r[0] is not None and crc32(str(r[0]).encode()) % 7 == 0
            root = trees((s, k))[1][-1][0] if bad else top[-1][0]
            out.append((r[0], own[s][0][k], own[s][-1][0], top[-1][0], h(*proof), root, root == top[-1][0]))
    return sorted(out, key=repr)


def manifest_rows(docs, folder, **settings):
    found = manifest(docs, folder, **settings)
    return rows_of(found.select("doc_id", "leaf", "subroot", "root", F.sha2(F.col("siblings").cast("binary"), 256), "folded_root", "verified"))


@pytest.mark.parametrize("block_levels", [1, 2, 3, 10])
def test_manifest_equals_trees_built_anew(spark, folder, block_levels):
    rng = random.Random(block_levels)
    langs = [None, "", "en", "en", "en", "é", "Z", "a"]
    rows = [(k, t, rng.choice(langs), rng.choice([None, "s"]), rng.choice([None, 5])) for k, t in enumerate(texts() * 2)]
    rows += [(None, "x", "en", None, 1), (None, "y", "en", None, 1), rows[7], rows[7], (7, "other", "en", "s", 0), (10**15, "l", "lone", None, 3)]
    rng.shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(5)
    docs = docs.withColumns({c: F.lit(1) for c in ("scope", "leaf", "place", "given", "changed", "in_scope")})
    want = plain_manifest(rows)
    assert manifest_rows(docs, folder, levels=block_levels) == want
    assert any(not r[-1] for r in want) and any(r[-1] for r in want)


def test_versions_copy_only_the_nodes_above_a_leaf(spark, folder):
    names = [h(str(k)) for k in range(21)]
    rows = [("=a" if k < 16 else "=b", k, names[k], h("new", str(k)) if k in (0, 7, 20) else None) for k in range(21)]
    tree = MerkleTree(spark.createDataFrame(rows, "scope string, doc_id long, leaf string, changed string"), folder, levels=2)
    found = {r.given.doc_id: r for r in tree.versions("changed").collect()}
    plain = [r[2] for r in rows]
    for k, r in found.items():
        if k not in (0, 7, 20):
            assert r.copies is None and r.folded_root == r.root
            continue
        new = [*plain]
        new[k] = h("new", str(k))
        a, b = levels(new[:16]), levels(new[16:])
        own, at = (a, k) if k < 16 else (b, k - 16)
        want = [level[at >> n] for n, level in enumerate(own)][1:] + [h(a[-1][0], b[-1][0])]
        assert r.copies == want
    assert {r.root for r in tree.ways.collect()} == {found[1].root}


def test_manifest_of_one_row_and_of_none(spark, folder):
    docs = documents(spark, rows=[(3, "text")])
    (row,) = manifest(docs, folder).collect()
    assert row.leaf == row.subroot == row.root and row.siblings == ""
    assert manifest(docs.limit(0), folder + "-e").count() == 0


def test_places_are_dense_and_ordered(spark, folder):
    rng = random.Random(2)
    rows = [(rng.choice("aab"), rng.choice([None, 1, 2, 3]), k) for k in range(300)]
    df = spark.createDataFrame(rows, "scope string, o long, k long").repartition(7)
    got = sorted(placed(df, "scope", ["o"], folder).collect(), key=lambda r: (r.scope, r.place))
    for s in "ab":
        own = [r for r in got if r.scope == s]
        assert [r.place for r in own] == list(range(len(own))) and {r.in_scope for r in own} == {len(own)}
        assert [r.o or 0 for r in own] == sorted(r.o or 0 for r in own)


def plain_trie(seqs):
    """seqs: conv_id -> list of (role, text)."""
    nodes = defaultdict(list)
    for c, s in seqs.items():
        for d in range(len(s) + 1):
            nodes[tuple(s[:d])].append(c)
    kids = defaultdict(int)
    leaves, saved = defaultdict(int), defaultdict(int)
    for p in nodes:
        if p:
            kids[p[:-1]] += 1
    for p, cs in nodes.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += kids[p] == 0
            saved[p[:d]] += (len(cs) - 1) * len(p[-1][1]) if p else 0
    return sorted(((min(cs), len(p), min(nodes[p[:-1]]) if p else None, len(cs), kids[p], leaves[p], saved[p],
                    h(",".join(str(c) for c in sorted(cs) if len(seqs[c]) == len(p)))) for p, cs in nodes.items()), key=repr)


def plain_sequences(rows, shared=True):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            own[c].append((turn is not None, turn or 0, h(f"{len(role.encode())}:{role}{text}"), role, text))
    own = {c: [x[3:] for x in sorted(v)] for c, v in own.items()}
    if not shared:
        return own
    heads = {c: crc32(str(c).encode()) % 6 for c in own}
    return {c: own.get(c - c % 100 if c >= 0 else -(-c - -c % 100), [])[:heads[c]] + s[heads[c]:] for c, s in own.items()}


def conversations(seed, n=160):
    rng = random.Random(seed)
    rows = []
    for c in rng.sample(range(-120, 700), n):
        for turn in range(rng.choice([0, 1, 2, 2, 5, 9])):
            rows.append((c, rng.choice([turn, turn, turn, None]), rng.choice(["user", "assistant", None]), rng.choice(["", "a", "b", "ä😀", None])))
    rows += [(5000 + k, t, "user", "x" * t) for k in range(40) for t in range(6)] + [(None, 0, "user", "x")]
    rows += [(9001, t, "user", "long") for t in range(300)] + [rows[0], rows[0]]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("lot_turns,fan,parts", [(1, 2, 9), (7, 2, 3), (40, 3, 5), (1 << 16, 32, 4)])
def test_trie_equals_a_plain_one(spark, folder, lot_turns, fan, parts):
    rows = conversations(lot_turns)
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3)
    df = df.withColumns({c: F.lit("clash") for c in ("digest", "depth", "n", "seq", "group")})
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        for shared in (True, False):
            seqs = turn_sequences(df)
            seqs = with_shared_starts(seqs) if shared else seqs
            got = prefix_trie(seqs, f"{folder}-{shared}", lot_turns, fan)
            assert rows_of(got) == plain_trie(plain_sequences(rows, shared))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 4)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_trie_of_nothing_and_of_one(spark, folder):
    schema = "conv_id long, turn long, role string, text string"
    assert prefix_trie(turn_sequences(spark.createDataFrame([], schema)), folder).count() == 0
    got = prefix_trie(turn_sequences(spark.createDataFrame([(4, 0, "user", "hello")], schema)), folder + "-1")
    assert rows_of(got) == plain_trie({4: [("user", "hello")]})
