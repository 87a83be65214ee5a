"""Queries of the operators that judge whole documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from heatframe.llm.decontamination import find_overlaps
from heatframe.llm.host_rules import judge
from heatframe.llm.oracles import HOST_RULES, OVERLAP
from heatframe.llm.registry import query, scratch, table
from heatframe.llm.secrets import find_secrets


@query("op4_benchmark_overlap", OVERLAP)
def benchmark_overlap(spark, sf_dir):
    found = find_overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    n_hit = F.expr("aggregate(spans, 0L, (n, s) -> n + s[1] - s[0])")
    return found.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        (F.size("spans") > 0).alias("contaminated"))


@query("op5_host_rules", HOST_RULES)
def host_verdicts(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return judge(docs, folder=scratch(spark, "judged")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


@query("op7_secret_findings")
def secret_findings(spark, sf_dir):
    found = find_secrets(table(spark, sf_dir, "documents"), scratch(spark, "secrets"))
    return found.withColumn("probability", F.round("probability", 6))
