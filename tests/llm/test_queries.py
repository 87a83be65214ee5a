"""Registered queries on the smallest tables: SQL twins, and the pipeline against its stages' rules."""

import duckdb
import pytest
from compare import difference, duck
from fixtures import ALNUM, WHITE, lower

import __spark_entry__ as entry
import corpus_pipeline

SF = "/root/testdata/sf0.001"
NAMES = [n for n in entry.oracle_sql() if n.startswith("op") and n[2].isdigit()]


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_sql(spark, name):
    assert difference(spark, duck(SF), SF, entry.queries()[name], entry.oracle_sql()[name]) is None


def test_all_operators_are_registered():
    numbers = {int(n[2:].split("_")[0]) for n in entry.queries() if n.startswith("op") and n[2].isdigit()}
    assert numbers == set(range(1, 14)) and "pipeline" in entry.queries()
    assert [n for n, _ in corpus_pipeline.STAGES] == [
        "quality rules", "n-gram Jaccard join", "benchmark decontamination", "secret scans", "best-fit packing"]


def test_pipeline_keeps_what_plain_rules_keep(spark):
    from test_screens import base
    from test_similarity import groups

    con = duckdb.connect()
    docs = con.execute(f"SELECT doc_id, text FROM '{SF}/documents.parquet' ORDER BY 1").fetchall()
    docs = [(d, t) for d, t in docs if not base(t)[-1]]
    docs = [(d, t) for (d, t), (_, _, c) in zip(docs, groups(docs, 80, 100, 5)) if c == d]
    items = con.execute(f"SELECT text FROM '{SF}/benchmark.parquet'").fetchall()
    windows = {tuple(w[k:k + 10]) for (t,) in items for w in [ALNUM.findall(lower(t))] for k in range(len(w) - 9)}

    def clean(t):
        w = ALNUM.findall(lower(t))
        return not any(tuple(w[k:k + 10]) in windows for k in range(len(w) - 9))

    got = corpus_pipeline.run(spark, SF).collect()
    assert {r.doc_id for r in got} == {d for d, t in docs if clean(t)}
    assert WHITE and len({r.sequence_id for r in got}) <= sum(r.length for r in got) / 1024 + 8
