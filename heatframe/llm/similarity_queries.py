"""Queries of the operators that compare documents with each other."""

from __future__ import annotations

from pyspark.sql import functions as F

from heatframe.llm.hamming import near_duplicates
from heatframe.llm.oracles import REPEATS
from heatframe.llm.partenum import jaccard_components
from heatframe.llm.registry import query, scratch, table
from heatframe.llm.substrings import remove_repeats


@query("op9_jaccard_components")
def jaccard_groups(spark, sf_dir):
    return jaccard_components(table(spark, sf_dir, "documents"), scratch(spark, "partenum"), num=85, den=100, width=4)


@query("op10_repeated_passages", REPEATS)
def repeated_passages(spark, sf_dir):
    found = remove_repeats(table(spark, sf_dir, "documents"), scratch(spark, "substrings"), width=13)
    return found.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


@query("op13_minhash_near_duplicates")
def minhash_near_duplicates(spark, sf_dir):
    return near_duplicates(table(spark, sf_dir, "documents"), scratch(spark, "hamming"), num=80, den=100, width=2)
