"""Multi-index Hamming join of minhash signatures against all pairs."""

import random
from math import comb

import numpy as np
import pyarrow as pa
import pytest
from fixtures import documents, prose, rows_of, texts
from test_similarity import groups, near_copies

from heatframe.llm.hamming import BITS, CHUNKS, COMPONENTS, ERRORS, entries, near_duplicates, signatures
from heatframe.llm.setjoin import Sets
from heatframe.llm.words import WHITE, lots


def with_kept(rows):
    return sorted([(d, n, c, None if d is None else c == d) for d, n, c in rows], key=repr)


@pytest.mark.parametrize("num,width", [(80, 2), (90, 1), (70, 3)])
def test_components_equal_all_pairs(spark, folder, num, width):
    docs = list(enumerate(texts() + near_copies(num)))
    got = near_duplicates(documents(spark, rows=docs), folder, num=num, den=100, width=width, chunks=CHUNKS if num >= 80 else 40)
    assert rows_of(got) == with_kept(groups(docs, num, 100, width))


def test_many_families_over_many_lots(spark, folder, monkeypatch):
    from heatframe.llm import setjoin

    monkeypatch.setattr(setjoin, "LOT_SIGNATURES", 2000)
    rng = random.Random(8)
    docs = []
    for _ in range(30):
        base = prose(rng, rng.choice([6, 20, 60, 200])).split(" ")
        for _ in range(rng.choice([1, 2, 5, 20])):
            w = list(base)
            for _ in range(rng.randint(0, max(1, len(base) // 10))):
                w[rng.randrange(len(w))] = f"e{rng.random()}"
            docs.append(" ".join(w))
    rng.shuffle(docs)
    docs = list(enumerate(docs))
    got = near_duplicates(spark.createDataFrame(docs, "doc_id long, text string").repartition(6), folder)
    assert rows_of(got) == with_kept(groups(docs, 80, 100, 2))


def test_rows_without_id_and_several_texts_under_one_id(spark, folder):
    a, b = prose(random.Random(1), 60), prose(random.Random(2), 60)
    docs = documents(spark, rows=[(None, a), (1, a), (1, b), (2, a + " x"), (3, b + " x"), (3, b + " x"), (9, None), (8, "")])
    got = near_duplicates(docs, folder)
    want = [(None, None), (1, 1), (1, 1), (2, 1), (3, 1), (3, 1), (9, 9), (8, 8)]
    assert sorted(((r.doc_id, r.component_id) for r in got.collect()), key=repr) == sorted(want, key=repr)
    assert near_duplicates(docs.limit(0), folder + "-e").count() == 0


def test_signatures_below_the_distance_share_an_entry():
    rng = random.Random(3)
    most = CHUNKS * (ERRORS + 1) - 1
    pairs = []
    for _ in range(300):
        words = [f"w{rng.random()}" for _ in range(rng.choice([10, 30, 64, 200]))]
        other = [w if rng.random() > 0.15 else f"x{rng.random()}" for w in words]
        pairs += [" ".join(words), " ".join(other)]
    (lot,) = lots(pa.array(pairs), WHITE, lot_bytes=1 << 30)
    sets = Sets(lot, 1)
    rows = signatures(sets, CHUNKS * COMPONENTS, BITS)
    key, place = entries(sets, np.ones(sets.n, bool), 80, 100, CHUNKS, COMPONENTS, ERRORS, BITS)
    held = [set() for _ in pairs]
    for k, p in zip(key.tolist(), place.tolist()):
        held[p].add(k)
    near = [k for k in range(0, len(pairs), 2) if (rows[k] != rows[k + 1]).sum() <= most]
    assert len(near) > 100 and all(held[k] & held[k + 1] for k in near)
    # components agree as often as sets do
    same = [(rows[k] == rows[k + 1]).mean() for k in range(0, len(pairs), 2)]
    real = [len(a & b) / len(a | b) for a, b in ((set(pairs[k].split()), set(pairs[k + 1].split())) for k in range(0, len(pairs), 2))]
    assert abs(np.mean(same) - np.mean(real)) < 0.01
    assert len(key) >= len(pairs) * CHUNKS * comb(COMPONENTS, ERRORS)


def test_a_pair_comes_once_for_a_range_of_buckets(monkeypatch):
    from collections import defaultdict

    import numpy as np

    from heatframe.llm import setjoin

    rng = np.random.default_rng(0)
    common, bits = rng.choice(1 << setjoin.SIGNATURE_BITS, 3000, replace=False), setjoin.GROUP_BITS + 4
    ranges = defaultdict(lambda: defaultdict(list))
    for own in ([1], [2], [3]):  # lots of one document
        own_sig = np.append(common, rng.integers(0, 1 << setjoin.SIGNATURE_BITS, 50)).astype("u8")
        for b in setjoin._packed([own_sig << np.uint64(setjoin.PLACE_BITS)], [np.array(own)], bits):
            for r, bucket, blob in zip(*(c.to_pylist() for c in b.columns)):
                ranges[r][bucket].append(blob)
    assert len(ranges) == 1 << setjoin.GROUP_BITS and sum(map(len, ranges.values())) > 900

    def pairs():
        return [x for r in ranges.values() for b in setjoin._once(map(setjoin._met, r.values())) for x in zip(*(c.to_pylist() for c in b.columns))]

    got = pairs()
    assert set(got) == {(2, 1, False, 2), (3, 1, False, 2)} and len(got) == 2 << setjoin.GROUP_BITS
    monkeypatch.setattr(setjoin, "HELD_PAIRS", 3)
    assert set(pairs()) == set(got) and len(pairs()) > len(got)


def test_a_lot_is_packed_in_a_few_times_its_size():
    import tracemalloc

    import numpy as np

    from heatframe.llm.setjoin import _packed

    rng = np.random.default_rng(0)
    keys = [rng.integers(0, 1 << 62, 1 << 19).astype("u8")]
    members = [np.arange(1 << 16)]
    size = keys[0].nbytes
    tracemalloc.start()
    try:
        assert sum(len(b) for b in _packed(keys, members, 8).__next__().column(2).to_pylist()) > size // 4
        assert tracemalloc.get_traced_memory()[1] < 6 * size
    finally:
        tracemalloc.stop()
