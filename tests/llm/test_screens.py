"""Decontamination, host rules, secrets and urls against plain loops."""

import hashlib
import re
from collections import Counter

import pytest
from fixtures import ALNUM, WHITE, documents, lower, rows_of, texts
from pyspark.sql import functions as F

from heatframe.llm import decontamination, host_rules, secrets, url_filter

ITEMS = "item_id long, text string, doc_id long, row long"


def overlaps(docs, items, n):
    windows = {}
    for i, t in items:
        w = ALNUM.findall(lower(t))
        for k in range(len(w) - min(n, len(w)) + 1 if w else 0):
            windows.setdefault(tuple(w[k:k + min(n, len(w))]), set()).add(str(i))
    out = []
    for d, t in docs:
        w, own, hit = ALNUM.findall(lower(t)), set(), set()
        for size in {len(x) for x in windows}:
            for k in range(len(w) - size + 1):
                if found := windows.get(tuple(w[k:k + size])):
                    own |= found
                    hit |= set(range(k, k + size))
        out.append((d, len(w), len(hit), sorted(own)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("pass_bytes", [1 << 20, 150])
def test_overlaps_equal_a_plain_scan(spark, pass_bytes):
    known = texts()
    items = [(1, known[6][40:400]), (2, "ONE"), (3, None), (4, ""), (5, known[13]), (5, known[13]), (12, "two three")]
    extra = [(3, "one two three"), (3, "one two three"), (None, "one")]
    docs = documents(spark, extra=extra)
    bench = spark.createDataFrame([(*r, 1, 2) for r in items], ITEMS)
    got = decontamination.find_overlaps(docs, bench, 10, pass_bytes)
    n_hit = F.expr("aggregate(spans, 0L, (n, s) -> n + s[1] - s[0])")
    rows = sorted((tuple(r) for r in got.select("doc_id", "n_words", n_hit, "items").collect()), key=repr)
    want = overlaps([*enumerate(known), *extra], items, 10)
    assert rows == want
    clean = decontamination.drop_contaminated(docs, bench, 10, pass_bytes)
    assert clean.columns == docs.columns
    assert sorted(rows_of(clean.select("doc_id"))) == sorted((d,) for d, _, n, _ in want if not n)


def test_no_items_and_no_documents(spark):
    empty = spark.createDataFrame([], ITEMS)
    docs = documents(spark)
    assert decontamination.find_overlaps(docs, empty).where(F.size("spans") > 0).count() == 0
    assert decontamination.drop_contaminated(docs, empty).count() == docs.count()
    assert decontamination.find_overlaps(documents(spark, rows=[]), empty).count() == 0


def test_spans_are_cut_out_of_the_text(spark):
    bench = spark.createDataFrame([(1, "b c", 1, 2)], ITEMS)
    docs = documents(spark, rows=[(1, "A, b c; d"), (2, None), (3, "c b")])
    assert rows_of(decontamination.remove_spans(docs, bench)) == [(1, "a, ; d"), (2, ""), (3, "c b")]


def base(text):
    text = text or ""
    w, lines = WHITE.findall(text), [x for x in text.split("\n") if WHITE.search(x)]
    windows = Counter(tuple(w[i:i + 3]) for i in range(len(w) - 2))
    covered = {i + j for i in range(len(w) - 2) if windows[tuple(w[i:i + 3])] > 1 for j in range(3)}
    return (len(w), sum(map(len, w)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered),
            len(w) < 50 or 100 * len(covered) > 50 * len(w))


def test_base_rules_equal_plain_counts(spark):
    known = [*texts(), "a b c a b c", "a a a a", "x\ny\nx\n \n \nx", "  a b\x0bc d #*$%&|<> \x1c  ", "😀 é\r\n😀 é\r\n"]
    got = host_rules.base_rules(documents(spark, rows=list(enumerate(known)))).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    assert rows_of(got) == sorted(((k, *base(t)) for k, t in enumerate(known)), key=repr)


def test_a_failing_host_loses_its_documents(spark, folder):
    good, bad = " ".join(f"w{i}" for i in range(60)), "too short"
    rows = [(h, bad if k < n else good) for h, n in (("a", 39), ("b", 2), ("c", 0), (None, 20)) for k in range(40)]
    docs = spark.createDataFrame([(i, t, h) for i, (h, t) in enumerate(rows)], "doc_id long, text string, source string")
    for at in (None, folder):
        judged = host_rules.judge(docs, folder=at).groupBy("source").agg(F.sum(F.col("kept").cast("int")))
        assert {r[0]: r[1] for r in judged.collect()} == {"a": 0, "b": 38, "c": 40, None: 20}
    kept = host_rules.keep_good(docs)
    assert kept.columns == docs.columns and kept.count() == 98
    assert host_rules.judge(docs.limit(0)).count() == 0


def test_rates_shrink_towards_the_prior(spark):
    rows = [("big", k < 50) for k in range(100)] + [("small", True)] * 2 + [("other", False)] * 50 + [(None, True)]
    rates = {r.host: r.shrunk_rate for r in host_rules.host_rates(
        spark.createDataFrame(rows, "h string, f boolean"), "h", "f").collect()}
    assert set(rates) == {"big", "small", "other"}
    assert 0.34 < rates["small"] < 1 and abs(rates["big"] - 0.5) < 0.05 and 0 < rates["other"] < 0.1


HEX = [hashlib.sha1(str(k).encode()).hexdigest() for k in range(60)]


def secret_docs(spark):
    rows = []
    for k, h in enumerate(HEX):
        text = [f'now token = "{h}" and on', f"see https://h.example/{h}/x there", f"call 41228301{k:08d} or so",
                f"mail some.{k:04d}@mailbox.example.com today"][k % 4]
        rows.append((k, text, "k", len(text)))
    rows += [(100, None, "k", 0), (101, "", "k", 0), (102, f'password={HEX[0]} {HEX[0]}', "k", 50), (None, f'token = "{HEX[4]}"', "k", 9)]
    return spark.createDataFrame(rows, "doc_id long, text string, core string, n_chars long")


def test_forest_removes_false_positives(spark, folder):
    docs = secret_docs(spark)
    found = secrets.find_secrets(docs, folder)
    verdict = {r.core: r.is_secret for r in found.collect()}
    held_out = [verdict[h] for k, h in enumerate(HEX) if k % 4 == 0]
    assert all(held_out) and not any(verdict.get(h, False) for k, h in enumerate(HEX) if k % 4 == 1)
    assert not any(v for c, v in verdict.items() if c.isdigit())
    clean = secrets.redact(docs, folder + "-r")
    assert clean.columns == docs.columns and clean.count() == docs.count()
    texts_ = {r.doc_id: (r.text, r.n_chars) for r in clean.collect()}
    assert texts_[0] == ('now token = "<secret>" and on', 29) and texts_[100] == (None, 0) and texts_[101] == ("", 0)
    assert texts_[1][0].startswith("see https") and HEX[1] in texts_[1][0]
    assert texts_[102][0] == "password=<secret> <secret>"


def test_held_out_accuracy(spark, folder):
    docs = secret_docs(spark)
    found = secrets.candidates(docs)
    featured = secrets.with_features(found, secrets.dictionary(docs, found)).where("doc_id < 60")
    labelled = featured.withColumn("label", F.when(F.col("doc_id") % 4 == 0, 1.0).otherwise(0.0))
    model = secrets.fit_forest(labelled.where("doc_id < 40"))
    right = model.transform(labelled.where("doc_id >= 40")).select(F.avg((F.col("prediction") == F.col("label")).cast("int")))
    assert right.first()[0] >= 0.95


def test_every_run_of_a_word_is_a_candidate(spark, folder):
    one, two, three = HEX[0], HEX[4][:26] + "1", HEX[8]
    rows = [(1, f'{{"token":"{one}","password":"{two}"}}'), (2, f"https://a.example/p?id={one}&api_key={two}"),
            (3, f"K1={one};K2={two};"), (4, f'now token = "{one}.{two}.{three}" and'), (5, f"{one}x,{two}")]
    found = secrets.candidates(documents(spark, rows=rows)).collect()
    got = {(r.doc_id, r.run_no): (r.core, r.lead, r.before) for r in found}
    assert got == {
        (1, 0): (one, '{"token":"', ""), (1, 1): (two, '","password":"', ""),
        (2, 0): (one, "https://a.example/p?id=", ""), (2, 1): (two, "&api_key=", ""),
        (3, 0): (one, "K1=", ""), (3, 1): (two, ";K2=", ""),
        (4, 0): (one, '"', "="), (4, 1): (two, '"', "="), (4, 2): (three, '"', "="), (5, 0): (one + "x", "", ""), (5, 1): (two, ",", "")}
    docs = secret_docs(spark).unionByName(spark.createDataFrame([(200, rows[0][1], "k", 9)], "doc_id long, text string, core string, n_chars long"))
    clean = secrets.redact(docs, folder).where("doc_id = 200").first()
    assert clean.text == '{"token":"<secret>","password":"<secret>"}'


def test_copies_of_a_secret_are_no_words(spark):
    key = "QwZxRtyBvnKlmPq7HgfDsaJkWmnTrcXzLpoYtv3B"
    rows = [(k, f'now token = "{key}" in copy {k}') for k in range(5)]
    rows += [(k, "the harmless (number) stands here and ends, so") for k in range(10, 20)]  # one text, ten times
    rows += [(k, f"a silent \"name\" of {k}, page-silent-name-{k:012d}") for k in range(20, 24)]
    docs = documents(spark, rows=rows + [(30, "x harmless-number-0123456789")])
    found = secrets.candidates(docs)
    words = secrets.dictionary(docs, found)
    assert rows_of(words) == [("name",), ("silent",)]
    assert rows_of(secrets.dictionary(docs, found, rate=0.9)) == []
    featured = secrets.with_features(found, words)
    assert featured.where(F.col("core") == key).agg(F.max("covered_share")).first()[0] == 0
    labels = {r.core: r.label for r in secrets.weak_labels(featured).collect()}
    assert labels[key] == 1.0


def test_without_candidates_or_labels(spark, folder):
    plain = documents(spark, rows=[(1, "no such thing"), (2, None)])
    assert secrets.find_secrets(plain, folder).count() == 0
    assert rows_of(secrets.redact(plain, folder + "-r")) == rows_of(plain)
    unsure = documents(spark, rows=[(1, "a1b2c3d4e5f6a7b8 alone")])
    assert [r.is_secret for r in secrets.find_secrets(unsure, folder + "-u").collect()] == [False]


URLS = ["http://WWW.Example.com/en/a?x#y", "https://b.example.com/en/", "http://notexample.com/en/x", "ftp://a.net/es/?q",
        "http://net/fr/z", "http://x.org", "http://x.org/a/", "https://m.x.org/a/index.html?utm_source=q#f", "no scheme", "", None,
        "http://com", "http://a.com?p=/", "http://a://b/c", "http://example.com/en/a", "http://x.org/a?b=2&a=1", "http://x.org/a?a=1&b=2"]


def test_url_verdicts(spark):
    rules = [url_filter.Rule(*r) for r in (("com", "/", "allow"), ("example.com", "/en/", "block"),
                                           ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block"))]
    pages = spark.createDataFrame([(k, u, "h") for k, u in enumerate(URLS * 2)], "page_id long, url string, host string")
    listed = spark.createDataFrame([("http://x.org/a",), ("http://x.org/a?a=1&b=2",), (None,), ("",), ("http://x.org/a",)], "url string")
    got = {r.page_id: r for r in url_filter.judge_urls(pages, listed, rules).collect()}
    assert len(got) == 2 * len(URLS)
    for k, u in enumerate(URLS * 2):
        m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", u or "")
        host, path = (lower(m[1]), m[2]) if m else ("", "")
        fits = [r for r in rules if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
        best = max(fits, key=lambda r: len(r.host + r.path), default=None)
        on_list = host in ("x.org", "m.x.org") and (path != "")
        assert (got[k].host, got[k].path) == (host, path)
        assert got[k].rule == (best.host + best.path if best else None)
        assert got[k].verdict == (best.verdict if best else "block" if on_list else "allow"), u
    empty = spark.createDataFrame([], "url string")
    assert {r.verdict for r in url_filter.judge_urls(pages, empty, []).collect()} == {"allow"}


def test_filter_has_no_false_negatives(spark):
    keys = spark.range(5000).select(F.col("id").cast("string").alias("k"))
    words = url_filter.build_filter(keys, "k")
    probe = spark.range(50000).select(F.xxhash64(F.col("id").cast("string")).alias("h")).toPandas()["h"].to_numpy()
    hit = url_filter.probably(probe, words)
    assert hit[:5000].all() and hit[5000:].mean() < 0.01
