"""Conversations from reply trees (operator 2); columns, joins and aggregates only.

Messages name their parent. Self-joins that double the known part of every message's path give all root-to-leaf
paths in a number of rounds that grows with the logarithm of the depth. Paths are branches; the best of each tree by
score are formatted, each as one conversation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The template: <|im_start|>role\ntext<|im_end|>\n for every turn.
START, END = "<|im_start|>", "<|im_end|>"
SALTS = 32


def escape(text: Column) -> Column:
    """A backslash after each < and [, so that no control string that begins with one is left. Reversible."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"([<\[])", r"$1\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"([<\[])\\", "$1")


def escape_role(role: Column) -> Column:
    """As ``escape``; a line break, which would end the role, is <n, which no escaped text holds."""
    return F.replace(escape(role), F.lit("\n"), F.lit("<n"))


def unescape_role(role: Column) -> Column:
    return unescape(F.replace(role, F.lit("<n"), F.lit("\n")))


def paths(messages: DataFrame, folder: str) -> DataFrame:
    """tree, leaf, path (ids from the root to the leaf) of every message without replies.

    messages   tree, id, parent. A parent that is null or not there makes a root. Rows without tree or id, and
               messages in a circle, are on no path; of rows with one id in a tree the smallest parent counts.
    """
    spark = messages.sparkSession

    def written(df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{folder}/{name}")
        return spark.read.parquet(f"{folder}/{name}")

    known = messages.where("tree IS NOT NULL AND id IS NOT NULL").groupBy("tree", "id").agg(F.min("parent").alias("parent"))
    ids = known.select("tree", F.col("id").alias("parent"), F.lit(True).alias("there"))
    # up: the next ancestor to look up; path: from below it to the message
    steps = written(known.join(ids, ["tree", "parent"], "left").select(
        "tree", "id", F.when(F.col("there"), F.col("parent")).alias("up"), F.array("id").alias("path")), "paths-0")
    replied = written(steps.select("tree", F.col("up").alias("id")).where("id IS NOT NULL").distinct(), "replied")
    # messages whose path has reached the root are looked up further on, but join no more
    whole, partial = steps.where("up IS NULL"), steps.where("up IS NOT NULL")
    turn, left = 0, partial.count()
    while left:
        turn += 1
        above = whole.unionByName(partial).select(
            "tree", F.col("id").alias("up"), F.col("up").alias("next"), F.col("path").alias("higher"))
        moved = written(partial.join(above, ["tree", "up"]).select(
            "tree", "id", F.col("next").alias("up"), F.concat("higher", "path").alias("path")), f"paths-{turn}")
        whole = whole.unionByName(moved.where("up IS NULL"))
        partial = moved.where("up IS NOT NULL")
        now = partial.count()
        if now == left:
            break  # every message that reaches a root would be nearer to it: what is left are circles
        left = now
    leaves = whole.join(replied, ["tree", "id"], "left_anti")
    return leaves.select("tree", F.col("id").alias("leaf"), "path")


def best_branches(branches: DataFrame, per_tree: int) -> DataFrame:
    """The ``per_tree`` branches of each tree with the highest score, ties by leaf. A tree's branches are cut down in
    salted parts first, so a tree with most of all branches is no single task."""
    order = F.col("score").desc(), F.col("leaf").asc()
    salted = branches.withColumn("_salt", F.pmod(F.xxhash64("leaf"), F.lit(SALTS)))
    for key in (["tree", "_salt"], ["tree"]):
        salted = salted.withColumn("rank", F.row_number().over(Window.partitionBy(*key).orderBy(*order)))
        salted = salted.where(F.col("rank") <= per_tree)
    return salted.drop("_salt")


def conversations_from_trees(messages: DataFrame, folder: str, per_tree: int = 1) -> DataFrame:
    """tree, leaf, rank, score, turns (array of struct<n, role, text>) of the chosen branches.

    messages   tree, id, parent, role, text, score. A branch's score is the mean of its messages' scores, null as 0.
               Repeated ids in a tree are one message, the smallest by (role, text, score).
    """
    one = messages.where("tree IS NOT NULL AND id IS NOT NULL").groupBy("tree", "id").agg(
        F.min(F.struct("role", "text", "score")).alias("m"))
    steps = paths(messages.select("tree", "id", "parent"), folder).select(
        "tree", "leaf", F.posexplode("path").alias("n", "id"))
    # scores alone rank the branches; texts join the chosen ones
    scored = steps.join(one.select("tree", "id", F.col("m.score").alias("score")), ["tree", "id"]).groupBy(
        "tree", "leaf").agg(F.avg(F.coalesce("score", F.lit(0.0))).alias("score"))
    chosen = best_branches(scored, per_tree)
    texts = steps.join(chosen, ["tree", "leaf"]).join(
        one.select("tree", "id", F.col("m.role").alias("role"), F.col("m.text").alias("text")), ["tree", "id"])
    turns = F.array_sort(F.collect_list(F.struct("n", "role", "text")))  # as long as the path
    return texts.groupBy("tree", "leaf", "rank", "score").agg(turns.alias("turns"))


def format_turns(conversations: DataFrame, learned_role: str = "assistant") -> DataFrame:
    """conversations with formatted (string) and loss_spans (array of struct<start, length> in code points of formatted,
    one for each turn of ``learned_role``, in order). Null roles and texts are empty."""
    pieces = F.transform("turns", lambda t: F.struct(
        F.concat(F.lit(START), escape_role(t["role"]), F.lit("\n")).alias("head"), escape(t["text"]).alias("body"),
        (F.coalesce(t["role"], F.lit("")) == learned_role).alias("learned")))
    spans = F.aggregate(
        F.col("_pieces"),
        F.expr("named_struct('at', 0, 'spans', cast(array() as array<struct<start: int, length: int>>))"),
        lambda s, p: F.struct(
            (s["at"] + F.char_length(p["head"]) + F.char_length(p["body"]) + len(END) + 1).alias("at"),
            F.when(p["learned"], F.array_append(s["spans"], F.struct(
                (s["at"] + F.char_length(p["head"])).alias("start"), F.char_length(p["body"]).alias("length"))))
            .otherwise(s["spans"]).alias("spans")),
        lambda s: s["spans"])
    formatted = F.array_join(F.transform("_pieces", lambda p: F.concat(p["head"], p["body"], F.lit(END + "\n"))), "")
    return conversations.withColumn("_pieces", pieces).withColumns(
        {"formatted": formatted, "loss_spans": spans}).drop("_pieces")


def parse_turns(formatted: Column) -> Column:
    """array of struct<role, text> of a formatted conversation."""
    parts = F.filter(F.split(formatted, r"<\|im_start\|>"), lambda p: p != "")
    return F.transform(parts, lambda p: F.struct(
        unescape_role(F.substring_index(p, "\n", 1)).alias("role"),
        unescape(F.regexp_extract(p, r"(?s)^[^\n]*\n(.*)<\|im_end\|>\n$", 1)).alias("text")))


def learned_texts(formatted: Column, loss_spans: Column) -> Column:
    """The texts under the loss mask, unescaped."""
    return F.transform(loss_spans, lambda s: unescape(F.substring(formatted, s["start"] + 1, s["length"])))
