"""Queries of the operators on whole tables of rows: manifest and prefix trie."""

from __future__ import annotations

from pyspark.sql import functions as F

from heatframe.llm.merkle import manifest
from heatframe.llm.prefix_trie import prefix_trie, turn_sequences, with_shared_starts
from heatframe.llm.registry import query, scratch, table




def crc32_sql(text: str) -> str:
    """Unsigned crc32 of an ASCII text as SQL: eight shifts for each of its bytes."""
    step = "CASE WHEN r & 1 = 1 THEN xor(r >> 1, 3988292384) ELSE r >> 1 END"
    byte = f"list_reduce(list_prepend(xor(c, ch), range(8)), lambda r, i: {step})"
    codes = f"list_transform(string_split({text}, ''), lambda x: CAST(ascii(x) AS BIGINT))"
    return f"xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), {codes}), lambda c, ch: {byte}), CAST(4294967295 AS BIGINT))"


def _fields(n_chars: str) -> str:
    def one(c):
        return f"coalesce(strlen({c}) || ':' || {c}, '-')"

    return " || ".join(one(c) for c in ("CAST(doc_id AS VARCHAR)", "source", "lang", f"CAST({n_chars} AS VARCHAR)", "text"))


MANIFEST = f"""
WITH RECURSIVE d AS (
  SELECT doc_id, coalesce('=' || lang, '-') AS scope, sha256({_fields('n_chars')}) AS leaf,
         sha256({_fields('n_chars + 1')}) AS other, {crc32_sql('CAST(doc_id AS VARCHAR)')} % 7 = 0 AND n_chars IS NOT NULL AS bad
  FROM documents),
p AS (SELECT *, row_number() OVER (PARTITION BY scope ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place, row_number() OVER () AS row FROM d),
up AS (
  SELECT 0 AS level, scope, place, leaf AS node, count(*) OVER (PARTITION BY scope) AS n FROM p
  UNION ALL
  SELECT level + 1, scope, place, node, (n + 1) // 2 FROM (
    SELECT level, scope, place // 2 AS place, sha256(string_agg(node, '' ORDER BY place)) AS node, min(n) AS n
    FROM (SELECT level, scope, place, node, n FROM up WHERE n > 1) GROUP BY level, scope, place // 2)),
tops AS (SELECT scope, node, level, row_number() OVER (ORDER BY scope) - 1 AS place FROM up WHERE n = 1),
high AS (
  SELECT 0 AS level, place, node, count(*) OVER () AS n FROM tops
  UNION ALL
  SELECT level + 1, place, node, (n + 1) // 2 FROM (
    SELECT level, place // 2 AS place, sha256(string_agg(node, '' ORDER BY place)) AS node, min(n) AS n
    FROM (SELECT level, place, node, n FROM high WHERE n > 1) GROUP BY level, place // 2)),
nodes AS (
  SELECT scope, level, place, node, n FROM up WHERE n > 1
  UNION ALL SELECT t.scope, t.level + h.level, h.place, h.node, h.n FROM tops t, high h WHERE h.n > 1),
steps AS (
  SELECT p.row, s.level, s.place % 2 AS side, s.node
  FROM p JOIN tops t ON p.scope = t.scope JOIN nodes s ON s.scope = p.scope AND s.place = xor(
    CASE WHEN s.level < t.level THEN p.place >> CAST(s.level AS INT) ELSE t.place >> CAST(s.level - t.level AS INT) END, 1)),
levels AS (SELECT DISTINCT scope, level FROM nodes),
proofs AS (SELECT row, string_agg(node, '' ORDER BY level) AS proof FROM steps GROUP BY row),
fold AS (
  SELECT row, scope, 0 AS level, CASE WHEN bad THEN other ELSE leaf END AS node FROM p
  UNION ALL
  SELECT f.row, f.scope, f.level + 1, sha256(CASE WHEN s.node IS NULL THEN f.node WHEN s.side = 0 THEN s.node || f.node ELSE f.node || s.node END)
  FROM fold f JOIN levels l ON l.scope = f.scope AND l.level = f.level LEFT JOIN steps s ON s.row = f.row AND s.level = f.level),
ends AS (SELECT row, max(level) AS level FROM fold GROUP BY row)
SELECT p.doc_id, p.leaf, t.node AS subroot, r.node AS root, sha256(coalesce(proof, '')) AS proof_sha256,
       f.node AS folded_root, f.node = r.node AS verified
FROM p JOIN tops t ON p.scope = t.scope JOIN (SELECT node FROM high WHERE n = 1) r ON true
  JOIN ends e ON e.row = p.row JOIN fold f ON f.row = e.row AND f.level = e.level LEFT JOIN proofs q ON q.row = p.row"""


@query("op11_merkle_manifest", MANIFEST)
def merkle_manifest(spark, sf_dir):
    found = manifest(table(spark, sf_dir, "documents"), scratch(spark, "merkle"))
    return found.select("doc_id", "leaf", "subroot", "root", F.sha2(F.col("siblings").cast("binary"), 256).alias("proof_sha256"),
                        "folded_root", "verified")


TRIE = f"""
WITH turns AS (
  SELECT conv_id, list(struct_pack(r := coalesce(role, ''), t := coalesce(text, '')) ORDER BY turn NULLS FIRST, role, text) AS s
  FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
h AS (SELECT *, {crc32_sql('CAST(conv_id AS VARCHAR)')} % 6 AS h FROM turns),
rebuilt AS (
  SELECT a.conv_id, list_concat(CASE WHEN b.s IS NULL THEN [] ELSE b.s[1:a.h] END, a.s[a.h + 1:]) AS s
  FROM h a LEFT JOIN turns b ON b.conv_id = a.conv_id - a.conv_id % 100),
prefixes AS (SELECT conv_id, d, len(s) AS n, s[1:d] AS p FROM (SELECT *, unnest(range(0, len(s) + 1)) AS d FROM rebuilt)),
nodes AS (
  SELECT p, d AS depth, min(conv_id) AS conv_id, count(*) AS n_convs,
    sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (n = d), '')) AS ends_sha256,
    CASE WHEN d = 0 THEN 0 ELSE (count(*) - 1) * length(p[-1].t) END AS saved
  FROM prefixes GROUP BY p, d),
kids AS (SELECT p[1:depth - 1] AS p, depth - 1 AS depth, count(*) AS n FROM nodes WHERE depth > 0 GROUP BY 1, 2),
below AS (
  SELECT p[1:a] AS p, a AS depth, sum(saved) AS saved, count(*) FILTER (leaf) AS leaves
  FROM (SELECT nodes.*, k.n IS NULL AS leaf, unnest(range(0, nodes.depth + 1)) AS a
        FROM nodes LEFT JOIN kids k ON k.p = nodes.p AND k.depth = nodes.depth) GROUP BY 1, 2)
SELECT n.conv_id, n.depth, u.conv_id AS parent_conv_id, n.n_convs, coalesce(k.n, 0) AS n_children, b.leaves AS n_leaves,
       CAST(b.saved AS BIGINT) AS saved_tokens, n.ends_sha256
FROM nodes n JOIN below b ON b.p = n.p AND b.depth = n.depth LEFT JOIN kids k ON k.p = n.p AND k.depth = n.depth
  LEFT JOIN nodes u ON n.depth > 0 AND u.depth = n.depth - 1 AND u.p = n.p[1:n.depth - 1]"""


@query("op12_prefix_trie", TRIE)
def conversation_trie(spark, sf_dir):
    sequences = with_shared_starts(turn_sequences(table(spark, sf_dir, "conversations")))
    return prefix_trie(sequences, scratch(spark, "trie"))
