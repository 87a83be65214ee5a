"""Jaccard components, repeated passages and components against plain loops."""

import random

import pytest
from fixtures import WHITE, documents, lower, prose, rows_of, texts

from heatframe.llm.components import components
from heatframe.llm.partenum import jaccard_components, keep_one_per_component
from heatframe.llm.substrings import remove_repeats


def groups(docs, num, den, width):
    sets = {}
    for d, t in docs:
        w = WHITE.findall(lower(t))
        sets[d] = {tuple(w[k:k + width]) for k in range(max(1, len(w) - width + 1))} if w else set()
    up = {d: d for d in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in sets:
        for b in sets:
            i = len(sets[a] & sets[b])
            if a < b and i and den * i >= num * (len(sets[a]) + len(sets[b]) - i):
                x, y = sorted((root(a), root(b)))
                up[y] = x
    return sorted((d, len(s), root(d)) for d, s in sets.items())


def near_copies(seed):
    """A family of which many don't link with each other, another of short texts, and chains."""
    rng = random.Random(seed)
    base, out = prose(rng, 120).split(" "), []
    for k in range(60):
        w = list(base)
        for _ in range(k // 4):
            w[rng.randrange(len(w))] = f"e{rng.random()}"
        out.append(" ".join(w))
    short = prose(rng, 14).split(" ")
    out += [" ".join(short[:n]) for n in range(1, 15)]
    chain = prose(rng, 80).split(" ")
    out += [" ".join(chain[k:k + 40]) for k in range(0, 40, 2)]
    rng.shuffle(out)
    return out


@pytest.mark.parametrize("num,width,parts", [(85, 4, 3), (80, 5, 2), (60, 2, 3), (30, 1, 4)])
def test_components_equal_all_pairs(spark, folder, num, width, parts):
    docs = list(enumerate(texts() + near_copies(num)))
    got = jaccard_components(documents(spark, rows=docs), folder, num=num, den=100, width=width, parts=parts)
    assert rows_of(got) == sorted(groups(docs, num, 100, width), key=repr)


def four_texts(first, second):
    """Texts 1, 5, 3, 7 in this order, of which 5 and 7 link and share no signature that 1 and 3 have not, too.

    first, second: how many of the extra words 1 and 3 have; 5 and 7 have three each of other ones.
    """
    import numpy as np
    import pyarrow as pa

    from heatframe.llm.partenum import Bands, signatures
    from heatframe.llm.setjoin import Sets
    from heatframe.llm.words import WHITE, lots

    for seed in range(2000):
        rng = random.Random(seed)
        base, x = [f"b{rng.random()}" for _ in range(40)], [f"x{rng.random()}" for _ in range(400)]
        (lot,) = lots(pa.array([" ".join(base)] + [" ".join([*base, w]) for w in x]), WHITE)
        sig, text = signatures(Sets(lot, 1), np.ones(401, bool), Bands(85, 100))
        held = [set() for _ in range(401)]
        for s, k in zip(sig.tolist(), text.tolist()):
            held[k].add(s)
        # extra words of one part lose the same signatures
        alike = {}
        for w, h in zip(x, held[1:]):
            alike.setdefault(frozenset(held[0] - h), []).append(w)
        many = [ws for ws in alike.values() if len(ws) >= 7][:2]
        if len(many) < 2:
            continue
        extra = {"x": many[0], "y": many[1]}
        texts_ = [" ".join(base + extra[side][:n]) for side, n in (first, ("x", 3), second, ("y", 3))]
        (lot,) = lots(pa.array(texts_), WHITE)
        sig, text = signatures(Sets(lot, 1), np.ones(4, bool), Bands(85, 100))
        own = [set(sig[text == k].tolist()) for k in range(4)]
        if own[1] & own[3] and own[1] & own[3] <= own[0] & own[2]:
            return list(zip((1, 5, 3, 7), texts_))
    raise AssertionError("no such texts")


@pytest.mark.parametrize("per_lot", [1, 2])
@pytest.mark.parametrize("first,second", [(("x", 7), ("y", 7)), (("x", 5), ("x", 7))])
def test_links_do_not_depend_on_lots(spark, folder, monkeypatch, first, second, per_lot):
    from heatframe.llm import setjoin

    docs = four_texts(first, second)
    want = sorted(groups(docs, 85, 100, 1), key=repr)
    assert {c for *_, c in want} == {1}
    monkeypatch.setattr(setjoin, "LOT_SIGNATURES", 1)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", per_lot)
    try:
        given = spark.createDataFrame(docs, "doc_id long, text string").coalesce(1)
        assert rows_of(jaccard_components(given, folder, num=85, den=100, width=1)) == want
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_rows_without_id_and_repeated_rows(spark, folder):
    text = prose(random.Random(1), 30)
    docs = documents(spark, rows=[(None, text), (7, text), (7, text), (9, text), (3, None), (4, "")])
    assert rows_of(jaccard_components(docs, folder)) == sorted(
        [(None, 27, None), (7, 27, 7), (7, 27, 7), (9, 27, 7), (3, 0, 3), (4, 0, 4)], key=repr)
    kept = keep_one_per_component(docs, folder + "-k")
    assert kept.columns == docs.columns
    assert sorted(r.doc_id or 0 for r in kept.collect()) == [3, 4, 7]
    assert jaccard_components(docs.limit(0), folder + "-e").count() == 0


def test_copies_of_a_text_are_signed_once(spark, folder):
    from heatframe.llm.partenum import JaccardJoin

    a, b, near = prose(random.Random(1), 60), prose(random.Random(2), 60), prose(random.Random(1), 60) + " x"
    # 30 has a copy and a text of its own
    rows = [*((k, a) for k in range(1, 31)), (30, b), (31, b), (40, near), (41, near), (None, a)]
    join = JaccardJoin(documents(spark, rows=rows), folder)
    got = {(r.doc_id, r.component_id) for r in join.run().collect()}
    assert got == {*((k, 1) for k in range(1, 31)), (30, 30), (31, 30), (40, 1), (41, 1), (None, None)}
    join.folder += "-again"
    met = join._candidates(spark.read.parquet(f"{folder}/known")).select("a", "p").collect()
    assert {tuple(r) for r in met} == {(30, 1), (40, 1)}


def test_several_texts_under_one_id(spark, folder):
    a, b, c = (prose(random.Random(k), 60) for k in (1, 2, 3))
    rows = [(1, a), (1, b), (2, a + " x"), (3, b + " x"), (3, c), (None, c), (None, "only " + c[::-1]), (None, "only " + c[::-1])]
    docs = documents(spark, rows=rows)
    got = {(r.doc_id, r.component_id) for r in jaccard_components(docs, folder).collect()}
    assert got == {(1, 1), (2, 1), (3, 1), (3, 3), (None, None)}
    kept = sorted(((r.doc_id, r.text) for r in keep_one_per_component(docs, folder + "-k").collect()), key=repr)
    assert kept == sorted([(1, a), (1, b), (3, c), (None, "only " + c[::-1])], key=repr)


@pytest.mark.parametrize("num,small,large", [(50, 19, 38), (30, 5, 14), (30, 40, 130)])
def test_partners_two_bands_away(spark, folder, num, small, large):
    words = [f"w{k}" for k in range(large)]
    docs = [(1, " ".join(words)), (2, " ".join(words[:small])), (3, " ".join(f"x{k}" for k in range(small)))]
    got = jaccard_components(documents(spark, rows=docs), folder, num=num, den=100, width=1)
    assert {r.doc_id: r.component_id for r in got.collect()} == {1: 1, 2: 1, 3: 3}


def kept_words(docs, n):
    first = {}
    for d, t in sorted((x for x in docs if x[0] is not None), key=lambda x: x[0]):
        w = WHITE.findall(t or "")
        for k in range(len(w) - n + 1):
            first.setdefault(tuple(w[k:k + n]), d)
    out = []
    for d, t in docs:
        w = WHITE.findall(t or "")
        gone = {j for k in range(len(w) - n + 1) if d is not None and first[tuple(w[k:k + n])] < d for j in range(k, k + n)}
        out.append((d, len(w), len(gone), " ".join(x for j, x in enumerate(w) if j not in gone)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("width,seed", [(13, 6), (5, 3), (4, 4)])
def test_removed_passages_equal_a_plain_scan(spark, folder, width, seed):
    rng = random.Random(width)
    common = "this very common line stands in most of all the documents here".split(" ")
    many = [" ".join([*prose(rng, 8).split(" "), *common[rng.randrange(3):], *prose(rng, 8).split(" ")]) for _ in range(150)]
    known = [*texts(), *near_copies(3), *many]
    rng.shuffle(known)
    docs = [*enumerate(known), (None, texts()[6]), (2, many[0]), (2, many[0])]
    got = remove_repeats(documents(spark, rows=docs), folder, width, seed)
    assert rows_of(got) == kept_words(docs, width)


def test_no_documents(spark, folder):
    assert remove_repeats(documents(spark, rows=[]), folder).count() == 0


def test_components_of_a_path_and_stars(spark, folder):
    edges = [(k, k + 1) for k in range(40)] + [(100, k) for k in range(101, 110)] + [(105, 50), (7, 7)]
    got = components(spark.createDataFrame(edges, "a long, b long"), folder)
    want = {**{k: 0 for k in range(41)}, **{k: 50 for k in [50, *range(100, 110)]}}
    assert dict(map(tuple, got.collect())) == want
    assert components(spark.createDataFrame([], "a long, b long"), folder + "-e").count() == 0


@pytest.mark.parametrize("num,parts", [(85, 3), (80, 2), (70, 4)])
def test_linked_sets_share_a_signature(num, parts):
    import numpy as np
    import pyarrow as pa

    from heatframe.llm.partenum import Bands, signatures
    from heatframe.llm.setjoin import Sets
    from heatframe.llm.words import AS_IS, WHITE, lots

    rng = random.Random(num)
    pairs = []
    for _ in range(400):
        words = [f"w{rng.random()}" for _ in range(rng.choice([7, 8, 12, 20, 45, 130, 400]))]
        other = [w for w in words if rng.random() > (100 - num) / 140]
        other += [f"x{rng.random()}" for _ in range(rng.randint(0, max(1, len(words) * (100 - num) // 220)))]
        i = len(set(words) & set(other))
        if 100 * i >= num * (len(words) + len(other) - i) and set(words) != set(other):
            pairs += [" ".join(words), " ".join(other)]
    assert len(pairs) > 200
    (lot,) = lots(pa.array(pairs), WHITE, AS_IS, 1 << 30)
    sets = Sets(lot, 1)
    sig, text = signatures(sets, np.ones(sets.n, bool), Bands(num, 100, parts))
    held = [set() for _ in pairs]
    for s, t in zip(sig.tolist(), text.tolist()):
        held[t].add(s)
    assert all(held[k] & held[k + 1] for k in range(0, len(pairs), 2))


def test_counts_never_rule_out_a_link():
    import numpy as np
    import pyarrow as pa

    from heatframe.llm.setjoin import COUNTERS, Sets
    from heatframe.llm.words import WHITE, lots

    rng = random.Random(5)
    base = [f"w{k}" for k in range(9000)]
    kept = [base, base[:8000], [w for w in base if rng.random() < 0.9], base[:2000], ["y"] * 3, [f"z{k}" for k in range(9000)]]
    (lot,) = lots(pa.array([" ".join(w) for w in kept] + [""]), WHITE, lot_bytes=1 << 30)
    counts = [np.frombuffer(c, "u1").astype("i8") for c in Sets(lot, 1).counts()]
    assert [len(c) for c in counts] == [2048, 1024, 1024 if len(kept[2]) <= 8192 else 2048, 256, COUNTERS, 2048, COUNTERS]
    for i, a in enumerate(kept):
        for j, b in enumerate(kept):
            n = min(len(counts[i]), len(counts[j]))
            x, y = (np.minimum(c.reshape(n, -1).sum(axis=1), 255) for c in (counts[i], counts[j]))
            assert np.abs(x - y).sum() <= len(set(a) ^ set(b))
    # unlike sets of this size differ by more than linked ones may
    assert np.abs(counts[0] - counts[5]).sum() * 180 > 18000 * 20
