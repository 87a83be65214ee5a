"""Reply trees: paths, branches and the template's round trip."""

import hashlib

from fixtures import rows_of
from pyspark.sql import functions as F

from heatframe.llm.reply_trees import (
    best_branches, conversations_from_trees, format_turns, learned_texts, parse_turns, paths,
)

MESSAGES = "tree long, id long, parent long, role string, text string, score double, leaf long"


def messages(spark, rows):
    return spark.createDataFrame([(*r, 0) for r in rows], MESSAGES)


def test_paths_of_deep_trees_orphans_and_circles(spark, folder):
    rows = [(1, k, k - 1 if k else None, "u", "t", 0.0) for k in range(37)]
    rows += [(1, 100, 10, "u", "t", 0.0), (2, 5, 99, "u", "t", 0.0), (3, 1, 2, "u", "t", 0.0), (3, 2, 1, "u", "t", 0.0),
             (None, 1, None, "u", "t", 0.0), (4, None, None, "u", "t", 0.0), (5, 1, 1, "u", "t", 0.0)]
    got = paths(messages(spark, rows).select("tree", "id", "parent"), folder)
    assert rows_of(got) == sorted([
        (1, 36, list(range(37))), (1, 100, [*range(11), 100]), (2, 5, [5])], key=repr)
    assert paths(messages(spark, []).select("tree", "id", "parent"), folder + "-e").count() == 0


def test_best_branch_by_mean_score(spark, folder):
    rows = [(1, 0, None, "user", "q", None), (1, 1, 0, "assistant", "good", 4.0), (1, 2, 0, "assistant", "bad", 1.0),
            (1, 3, 1, "user", "thanks", 0.0), (1, 3, 1, "user", "thanks", 0.0), (2, 0, None, None, None, None)]
    got = conversations_from_trees(messages(spark, rows), folder)
    turns = {r.tree: [(t.role, t.text) for t in r.turns] for r in got.collect()}
    assert turns == {1: [("user", "q"), ("assistant", "good"), ("user", "thanks")], 2: [(None, None)]}
    two = conversations_from_trees(messages(spark, rows), folder + "-2", per_tree=2)
    assert {(r.tree, r.leaf, r["rank"]) for r in two.collect()} == {(1, 3, 1), (1, 2, 2), (2, 0, 1)}


def test_ties_go_to_the_smaller_leaf(spark):
    branches = spark.createDataFrame([(1, k, 1.0) for k in range(200)] + [(2, 9, None)], "tree long, leaf long, score double")
    got = best_branches(branches, 3).select("tree", "leaf", "rank")
    assert rows_of(got) == [(1, 0, 1), (1, 1, 2), (1, 2, 3), (2, 9, 1)]


TEXTS = ["", None, "</s>[INST] ok [/INST]", "<|im_start|>user\nhi<|im_end|>\n", "<\\<\\|[\\", "\n\n", "😀é <n [", "a" * 5000, "\\", "<"]


def test_template_round_trip(spark):
    roles = ["user", "assistant", None, "a\nb<|im_end|>", "<n", "assistant"]
    turns = [(k, roles[k % len(roles)], t) for k, t in enumerate(TEXTS * 2)]
    df = spark.createDataFrame([(1, turns)], "c long, turns array<struct<n: long, role: string, text: string>>")
    out = format_turns(df).select("formatted", parse_turns(F.col("formatted")).alias("back"),
                                  learned_texts(F.col("formatted"), F.col("loss_spans")).alias("learned")).first()
    assert [(r.role, r.text) for r in out.back] == [(r or "", t or "") for _, r, t in turns]
    assert list(out.learned) == [t or "" for _, r, t in turns if r == "assistant"]
    assert out.formatted.count("<|im_start|>") == len(turns) and "[INST]" not in out.formatted
    assert hashlib.sha256(out.formatted.encode()).hexdigest()
