"""Queries of the operators that write or place token ids."""

from __future__ import annotations

from pyspark.sql import functions as F

from heatframe.llm.packing import pack_documents
from heatframe.llm.planes import read_planes, write_planes
from heatframe.llm.registry import TOKENIZER, query, scratch, table
from heatframe.llm.separators import flat_files, scan_separators, write_flat

END_OF_TEXT = 50256


@query("op1_plane_files")
def plane_files(spark, sf_dir):
    folder = scratch(spark, "planes")
    write_planes(table(spark, sf_dir, "documents"), folder, TOKENIZER, end_id=0)
    return read_planes(spark, folder).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


@query("op6_packed_sequences")
def packed_sequences(spark, sf_dir):
    return pack_documents(table(spark, sf_dir, "documents"), scratch(spark, "packing"), TOKENIZER, 1024, end_id=2)


@query("op8_separator_counts")
def separator_counts(spark, sf_dir):
    """Tokens of every document, counted in flat files; place is where it starts within its file."""
    folder = scratch(spark, "flat")
    names = write_flat(table(spark, sf_dir, "documents"), folder, TOKENIZER, END_OF_TEXT, "u2")
    flat = flat_files(spark, [r.path for r in names.select("path").distinct().collect()])
    # the listing may write a path's scheme another way, so files are matched by their own name
    counts = scan_separators(flat, END_OF_TEXT, "u2").withColumn("name", F.element_at(F.split("path", "/"), -1))
    named = names.select(F.element_at(F.split("path", "/"), -1).alias("name"), "doc_no", "doc_id")
    return counts.join(named, ["name", "doc_no"]).select("doc_id", "n_tokens", F.col("start").alias("place"))
