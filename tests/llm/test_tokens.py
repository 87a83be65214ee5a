"""Plane files, flat files and packing against ids of whole texts."""

import zlib
from collections import defaultdict

import numpy as np
import pytest
from fixtures import documents, rows_of, texts
from tokenizers import Tokenizer

from heatframe.llm.packing import best_fit, cut, pack_documents
from heatframe.llm.planes import from_planes, read_planes, to_planes, write_planes
from heatframe.llm.registry import TOKENIZER
from heatframe.llm.separators import flat_files, scan_separators, write_flat
from heatframe.llm.tokens import encoder

END = 50256


@pytest.fixture(scope="module")
def ids():
    tokenizer = Tokenizer.from_file(TOKENIZER)
    return lambda t: tokenizer.encode(t or "", add_special_tokens=False).ids


def test_units_give_the_ids_of_whole_texts(ids):
    marks = [chr(c) for c in [*range(0x21), 0x7F, 0x85, 0xA0, 0xAD, 0x200B, 0x2028, 0x3000, 0x1F600, ord("'"), ord("ě"), ord("²")]]
    made = [f"a{m} b!{m}  {m}c {m}\n!ab{m}{m}x 1{m}\r\n2'll {m}" for m in marks] + ["<|endoftext|>a <|endoftext|>"]
    for text in made + texts():
        assert np.frombuffer(next(encoder(TOKENIZER).encode([text])), "<u4").tolist() == ids(text)


@pytest.mark.parametrize("plane", ["byte", "bit"])
def test_planes_round_trip(plane):
    for n in (0, 1, 7, 1000):
        block = np.random.default_rng(n).integers(0, 2**32, n, "u4")
        assert (from_planes(to_planes(block, plane), n) == block).all()


@pytest.mark.parametrize("plane", ["byte", "bit"])
def test_plane_files_hold_all_ids_in_order(spark, folder, ids, plane):
    extra = [(None, "no id"), (4, "a second row"), (4, "a second row")]
    docs = documents(spark, extra=extra)
    write_planes(docs, folder, TOKENIZER, end_id=0, plane=plane, block_ids=64)
    got = sorted(read_planes(spark, folder).collect(), key=lambda r: r.start)
    rows = sorted([(k, t) for k, t in enumerate(texts())] + extra,
                  key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, (r[1] or "").encode()))
    at = 0
    for r, (d, t) in zip(got, rows, strict=True):
        want = np.array([*ids(t), 0], "<u4").tobytes()
        assert (r.doc_id, r.start, r.n_tokens, r.ids) == (d, at, len(want) // 4, want)
        at += r.n_tokens


def test_no_documents_give_no_shard(spark, folder):
    none = documents(spark, rows=[])
    write_planes(none, folder, TOKENIZER)
    assert read_planes(spark, folder).count() == 0
    assert pack_documents(none, folder + "-p", TOKENIZER).count() == 0
    assert write_flat(none, folder + "-f", TOKENIZER, END).count() == 0


@pytest.mark.parametrize("block_ids", [1, 3, 1 << 20])
def test_separator_scan_stitches_blocks(spark, folder, ids, block_ids):
    names = write_flat(documents(spark, extra=[(None, "<|endoftext|> is text here")]), folder, TOKENIZER, END, "u2")
    flat = flat_files(spark, [r.path for r in names.select("path").distinct().collect()])
    if block_ids == 1:
        flat = flat.limit(1)
    found = scan_separators(flat, END, "u2", block_ids).collect()
    paths = {r.path.rsplit("/")[-1] for r in found}
    counts = {(r.path.rsplit("/")[-1], r.doc_no): r.n_tokens for r in found}
    by_id = dict(enumerate(texts()))
    seen = 0
    for r in names.collect():
        name = r.path.rsplit("/")[-1]
        if name in paths and r.doc_id is not None:
            assert counts[name, r.doc_no] == len(ids(by_id[r.doc_id]))
            seen += 1
    assert seen and all(r.ended for r in found)


def test_a_tail_without_end_is_a_document(spark, tmp_path):
    (tmp_path / "a.ids").write_bytes(np.array([1, 2, 9, 9, 3], "<u4").tobytes())
    (tmp_path / "b.ids").write_bytes(b"")
    got = rows_of(scan_separators(flat_files(spark, f"file://{tmp_path}"), 9, "u4", 2).drop("path"))
    assert got == [(0, 0, 2, True), (1, 3, 0, True), (2, 4, 1, False)]


def test_pieces_fill_sequences(spark, folder, ids):
    got = pack_documents(documents(spark, extra=[(None, ""), (3, "one")]), folder, TOKENIZER, 64, end_id=2).collect()
    sequences, pieces = defaultdict(list), defaultdict(list)
    for r in got:
        sequences[r.sequence_id].append((r.offset, r.length))
        pieces[r.doc_id].append((r.piece, r.start, r.length, r.ids_crc32))
    for held in sequences.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= 64
    total = 0
    for d, t in enumerate(texts()):
        if d == 3:
            continue
        want, at = np.array([*ids(t), 2], "<u4"), 0
        for k, (piece, start, length, crc) in enumerate(sorted(pieces[d])):
            assert (piece, start, crc) == (k, at, zlib.crc32(want[at:at + length].tobytes())) and (k == 0 or length == 64)
            at += length
        assert at == len(want) and (len(want) > 64 or len(pieces[d]) == 1)
        total += at
    assert len(pieces[3]) == 2 and len(pieces[None]) == 1
    assert len(sequences) <= total / 64 + 3


def test_best_fit_takes_the_tightest_bin():
    assert sorted(map(sorted, best_fit([6, 5, 4, 3, 2], 10))) == [[0, 2], [1, 3, 4]]
    assert cut(0, 4) == [] and cut(4, 4) == [(0, 4)] and cut(9, 4) == [(0, 1), (1, 4), (5, 4)]
    assert len(best_fit([600] * 7, 1024)) == 7
