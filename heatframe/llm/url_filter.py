"""URL verdicts by rules and by a list of canonical URLs behind a blocked Bloom filter (operator 3).

The filter has one 256-bit block for a key, with one bit set in each of its eight 32-bit words. It is built by
grouping keys by block, so its size is the only thing that reaches the driver, and that is bounded. Urls that the
filter passes meet the list in an exact hash join; nothing else is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BITS_PER_KEY = 16
MAX_BLOCKS = 1 << 20  # 32 MB; a longer list gives more false positives, which the join removes
MAX_RULES = 10_000
WORDS = 8
# Salts of the eight bits of a key, fixed values of the split-block filter.
SALTS = np.array([0x47B6137B, 0x44974D91, 0x8824AD5B, 0xA2B7289D, 0x705495C7, 0x2DF1424B, 0x9EFC4947, 0x5C6BFB31], "u4")


@dataclass(frozen=True)
class Rule:
    host: str
    path: str
    verdict: str


def host_of(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z lower-cased; empty for null or without ://."""
    found = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(found, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    """After the host up to ?, # or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def canonical(url: Column) -> Column:
    """A url without what mirrors of a page differ in: scheme, www. and m., index and .html endings, last slash, fragment,
    and the query but for its parameters in order, tracking ones left out. Empty for a url without a host."""
    host = F.regexp_replace(host_of(url), r"^(www|m)\.", "")
    path = F.regexp_replace(path_of(url), r"(/index)?(\.html?)?/*$", "")
    query = F.regexp_extract(url, r"(?s)^[^?#]*\?([^#]*)", 1)
    kept = F.array_sort(F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.rlike("^(utm_[a-z]+|ref|source)(=|$)")))
    tail = F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise("")
    return F.when(host == "", "").otherwise(F.concat(host, path, tail))


def rule_for(host: Column, path: Column, rules: list[Rule]) -> Column:
    """The longest rule that fits, as struct<rule, verdict>; null if none does. One of equal rules is taken by its text."""
    if len(rules) > MAX_RULES:
        raise ValueError(f"more than {MAX_RULES} rules: put them on the list of urls")
    best = sorted(set(rules), key=lambda r: (-len(r.host + r.path), r.host, r.path, r.verdict))
    found = None
    for r in reversed(best):
        fits = ((host == r.host) | host.endswith(f".{r.host}")) & path.startswith(r.path)
        own = F.struct(F.lit(r.host + r.path).alias("rule"), F.lit(r.verdict).alias("verdict"))
        found = F.when(fits, own) if found is None else F.when(fits, own).otherwise(found)
    return found if found is not None else F.lit(None).cast("struct<rule: string, verdict: string>")


def _masks(low: np.ndarray) -> np.ndarray:
    """For the low 32 bits of hashes: the bit of each of the eight words."""
    return np.uint32(1) << ((low[:, None] * SALTS[None, :]) >> np.uint32(27))


def _blocks(hashes: np.ndarray, n_blocks: int) -> tuple[np.ndarray, np.ndarray]:
    h = hashes.view("u8")
    return ((h >> np.uint64(32)) * np.uint64(n_blocks)) >> np.uint64(32), h.astype("u4")


def build_filter(keys: DataFrame, column: str) -> np.ndarray:
    """The filter over a column's values as an array (blocks, 8) of 32-bit words, built in tasks."""
    hashed = keys.select(F.xxhash64(column).alias("h"))
    n = hashed.count()
    n_blocks = min(MAX_BLOCKS, max(1, -(-n * BITS_PER_KEY // (32 * WORDS))))
    names = [f"w{k}" for k in range(WORDS)]

    def masks(incoming: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in incoming:
            block, low = _blocks(b.column(0).to_numpy(), n_blocks)
            bits = _masks(low).astype("i8")
            yield pa.record_batch([pa.array(block.astype("i8")), *(pa.array(bits[:, k]) for k in range(WORDS))],
                                  ["block", *names])

    rows = hashed.mapInArrow(masks, "block long, " + ", ".join(f"{w} long" for w in names))
    words = np.zeros((n_blocks, WORDS), "u4")
    merged = rows.groupBy("block").agg(*(F.bit_or(w).alias(w) for w in names))
    for batch in merged.toArrow().to_batches():  # at most MAX_BLOCKS rows
        words[batch.column(0).to_numpy()] = np.stack([batch.column(1 + k).to_numpy() for k in range(WORDS)], 1).astype("u4")
    return words


def probably(hashes: np.ndarray, words: np.ndarray) -> np.ndarray:
    block, low = _blocks(hashes, len(words))
    masks = _masks(low)
    return ((words[block.astype("i8")] & masks) == masks).all(axis=1)


def judge_urls(pages: DataFrame, listed: DataFrame, rules: list[Rule], id_column: str = "page_id",
               url_column: str = "url", list_column: str = "url", listed_verdict: str = "block",
               other_verdict: str = "allow") -> DataFrame:
    """page_id, url, host, path, rule, verdict and listed of every page.

    A rule fits its host and all subdomains where the path starts with the rule's; the longest decides. Without one a
    url whose canonical form is on the list gets ``listed_verdict``, any other ``other_verdict``. Null urls and those
    without :// have empty host and path, fit no rule and are on no list. Listed nulls and repeated entries don't count.
    """
    spark = pages.sparkSession
    keys = listed.select(canonical(F.col(list_column)).alias("key")).where("key != ''").distinct()
    shared = spark.sparkContext.broadcast(build_filter(keys, "key"))
    url = F.col(url_column)
    judged = pages.select(F.col(id_column).alias("page_id"), url.alias("url"), host_of(url).alias("host"),
                          path_of(url).alias("path"), canonical(url).alias("key"))
    judged = judged.withColumn("found", rule_for(F.col("host"), F.col("path"), rules)).withColumn("h", F.xxhash64("key"))

    def probe(incoming: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in incoming:
            maybe = probably(b.column(b.num_columns - 1).to_numpy(), shared.value)
            yield b.set_column(b.num_columns - 1, "maybe", pa.array(maybe))

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in judged.schema.fields[:-1]]
    probed = judged.mapInArrow(probe, ", ".join([*fields, "maybe boolean"]))
    missed = probed.where("NOT maybe").withColumn("listed", F.lit(False))
    passed = probed.where("maybe").join(keys.withColumn("listed", F.lit(True)), "key", "left").withColumn(
        "listed", F.coalesce("listed", F.lit(False)))
    verdict = F.coalesce("found.verdict", F.when(F.col("listed"), listed_verdict).otherwise(other_verdict))
    return missed.unionByName(passed).select("page_id", "url", "host", "path", F.col("found.rule").alias("rule"),
                                             verdict.alias("verdict"), "listed")
