"""Queries over pages and conversations."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from heatframe.llm.registry import query, scratch, table
from heatframe.llm.reply_trees import conversations_from_trees, format_turns, learned_texts, parse_turns
from heatframe.llm.url_filter import Rule, host_of, judge_urls, path_of

NO_ID = "none"
RULES = [
    Rule("com", "/", "allow"), Rule("example.com", "/en/", "block"), Rule("www.example.com", "/en/", "allow"),
    Rule("net", "/es/", "block"), Rule("net", "/fr/", "block"),
]
RULES_SQL = "(VALUES " + ", ".join(f"('{r.host}', '{r.path}', '{r.verdict}')" for r in RULES) + ") r(rhost, rpath, rverdict)"
CANONICAL_SQL = """CASE WHEN host = '' THEN '' ELSE regexp_replace(host, '^(www|m)\\.', '')
  || regexp_replace(path, '(/index)?(\\.html?)?/*$', '')
  || CASE WHEN len(params) > 0 THEN '?' || array_to_string(list_sort(params), '&') ELSE '' END END"""
URLS_SQL = f"""
WITH parts AS (
  SELECT page_id, coalesce(url, '') AS url,
    translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1),
              'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path,
    list_filter(string_split(regexp_extract(coalesce(url, ''), '(?s)^[^?#]*\\?([^#]*)', 1), '&'),
                lambda p: p <> '' AND NOT regexp_matches(p, '^(utm_[a-z]+|ref|source)(=|$)')) AS params
  FROM pages),
keyed AS (SELECT page_id, host, path, {CANONICAL_SQL} AS key FROM parts),
listed AS (SELECT DISTINCT key FROM keyed WHERE host LIKE '%spam-farm%' OR path LIKE '/de/%'),
fits AS (
  SELECT page_id, rhost || rpath AS rule, rverdict,
    row_number() OVER (PARTITION BY page_id ORDER BY length(rhost || rpath) DESC) AS n
  FROM keyed, {RULES_SQL}
  WHERE (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath))
SELECT k.page_id, host, path, rule,
  coalesce(rverdict, CASE WHEN l.key IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict
FROM keyed k LEFT JOIN fits f ON k.page_id = f.page_id AND n = 1 LEFT JOIN listed l ON k.key = l.key AND k.key <> ''"""

CONVERSATION_SQL = """
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')),
sized AS (
  SELECT *, regexp_replace(text, '([<\\[])', '\\1\\\\', 'g') AS body, regexp_replace(role, '([<\\[])', '\\1\\\\', 'g') AS head
  FROM turns)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(12 + length(head) + 1 + length(body) + 10 + 1) AS BIGINT) AS formatted_chars
FROM sized GROUP BY conv_id"""


@query("op2_reply_tree_chats", CONVERSATION_SQL)
def reply_tree_chats(spark, sf_dir):
    """A conversation is one chain of replies; rows without a conv_id are one conversation too."""
    rows = table(spark, sf_dir, "conversations").select(
        F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    probe = "</s>[INST] ok [/INST]"
    probes = spark.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(probe).alias("text"))
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    messages = rows.unionByName(probes).withColumn("id", F.row_number().over(order).cast("long")).select(
        F.coalesce(F.col("conv_id").cast("string"), F.lit(NO_ID)).alias("tree"), "id", F.when(F.col("id") > 1, F.col("id") - 1).alias("parent"), "role", "text",
        F.lit(0.0).alias("score"))
    folder = scratch(spark, "chats")
    chosen = conversations_from_trees(messages, f"{folder}/paths")
    format_turns(chosen).select(F.when(F.col("tree") != NO_ID, F.col("tree")).cast("long").alias("conv_id"), "formatted", "loss_spans").write.parquet(f"{folder}/out")
    back = spark.read.parquet(f"{folder}/out")
    # parsed once, before the columns that use it
    back = back.withColumns({"turns": parse_turns(F.col("formatted")),
                             "learned": F.array_join(learned_texts(F.col("formatted"), F.col("loss_spans")), "")})
    lines = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(lines.cast("binary"), 256).alias("turns_sha256"),
        F.char_length("learned").cast("long").alias("loss_chars"),
        F.sha2(F.col("learned").cast("binary"), 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"))


@query("op3_url_verdicts", URLS_SQL)
def url_verdicts(spark, sf_dir):
    """Pages of link farms and of the /de/ parts are the list; their mirrors are found by canonical url."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    url = F.col("url")
    listed = pages.where(host_of(url).contains("spam-farm") | path_of(url).startswith("/de/")).select("url")
    return judge_urls(pages, listed, RULES).select("page_id", "host", "path", "rule", "verdict")
