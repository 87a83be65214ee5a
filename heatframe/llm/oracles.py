"""SQL of queries that compare words and windows, for one engine on one machine."""

from __future__ import annotations

from heatframe.llm.host_rules import MAX_HOST_RATE, MAX_REPEAT_PERCENT, MIN_HOST_DOCS, MIN_WORDS

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
ALNUM = "[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
WHITE = "[^\\x20\\x09-\\x0D]+"


def _lowered(column: str) -> str:
    return f"regexp_extract_all(translate(coalesce({column}, ''), '{UPPER}', '{LOWER}'), '{ALNUM}')"


OVERLAP = f"""
WITH d AS (SELECT doc_id, {_lowered('text')} AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, {_lowered('text')} AS w FROM benchmark),
bw AS (SELECT item, least(10, len(w)) AS n, array_to_string(w[i:i + least(10, len(w)) - 1], ' ') AS k
       FROM (SELECT *, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS k
       FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n)),
hits AS (SELECT DISTINCT doc_id, n, i, item FROM dw JOIN bw USING (n, k)),
covered AS (SELECT doc_id, COUNT(*) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(i, i + n)) AS p FROM hits) GROUP BY 1),
items AS (SELECT doc_id, COUNT(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS listed FROM hits GROUP BY 1)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(listed, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN items USING (doc_id)"""

HOST_RULES = f"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{WHITE}') AS w,
                  list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '{WHITE}')) AS l FROM documents),
win AS (SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS k
        FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d WHERE len(w) >= 3)),
twice AS (SELECT doc_id, i FROM win QUALIFY COUNT(*) OVER (PARTITION BY doc_id, k) > 1),
rep AS (SELECT doc_id, COUNT(*) AS n FROM (SELECT DISTINCT doc_id, unnest(range(i, i + 3)) AS p FROM twice) GROUP BY 1),
s AS (SELECT doc_id, source, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars,
             length(t) - length(translate(t, '#*$%&|<>', '')) AS n_symbols, len(l) - len(list_distinct(l)) AS n_dup_lines,
             coalesce(n, 0) AS n_repeat_words FROM d LEFT JOIN rep USING (doc_id)),
j AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words AS base_failed FROM s),
h AS (SELECT source, COUNT(*) AS n, SUM(CAST(base_failed AS INT)) AS f FROM j WHERE source IS NOT NULL GROUP BY 1),
a AS (SELECT SUM(n) AS n_all, SUM(f) / SUM(n) AS mean, COUNT(*) AS k, SUM(f * f / n) AS squares, SUM(n * n) AS n_squares FROM h),
v AS (SELECT *, mean * (1 - mean) AS within,
             (squares - n_all * mean * mean - (k - 1) * mean * (1 - mean)) / nullif(n_all - n_squares / n_all, 0) AS between_hosts FROM a),
p AS (SELECT mean, CASE WHEN k < 2 THEN 1 ELSE greatest(1, coalesce(
             within / nullif(greatest(coalesce(between_hosts, 0), within / 1e6), 0) - 1, 1)) END AS strength FROM v),
bad AS (SELECT source FROM h, p WHERE n >= {MIN_HOST_DOCS} AND (f + mean * strength) / (n + strength) > {MAX_HOST_RATE})
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND coalesce(source NOT IN (SELECT source FROM bad), true) AS kept FROM j"""

REPEATS = f"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{WHITE}') AS w FROM documents),
win AS (SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS k
        FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM d WHERE len(w) >= 13)),
lost AS (SELECT doc_id, i FROM (SELECT doc_id, i, MIN(doc_id) OVER (PARTITION BY k) AS first FROM win) WHERE first < doc_id),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS p FROM lost),
words AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM d),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS t, COUNT(*) AS n FROM words ANTI JOIN gone USING (doc_id, p) GROUP BY 1)
SELECT doc_id, len(w) AS n_words, len(w) - coalesce(n, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)"""
