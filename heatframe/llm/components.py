"""Connected components of a graph given by edges, as a few joins per round; nothing is collected."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heatframe.llm.files import step_table


def components(edges: DataFrame, folder: str) -> DataFrame:
    """node, component (the smallest node reachable) of every node of the edges (a, b: long).

    Every round hooks each component to its smallest neighbour, follows the hooks to their ends and contracts
    the edges; a round at least halves the components that still have edges. Tables of a round are written
    below ``folder``, which cuts the lineage.
    """
    def written(df: DataFrame, name: str) -> DataFrame:
        return step_table(df, f"{folder}/{name}")

    a_b = F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")
    edges = written(edges.where("a != b").select(*a_b).distinct(), "edges-0")
    labels, turn = None, 0
    while not edges.isEmpty():
        turn += 1
        # a component is hooked to its smallest smaller neighbour; the smallest of a group is its root
        hooks = written(edges.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("up")), f"hooks-{turn}-0")
        step = 0
        while True:
            step += 1
            above = hooks.select(F.col("node").alias("up"), F.col("up").alias("next"))
            hooks = written(hooks.join(above, "up", "left").select(
                "node", F.coalesce("next", "up").alias("up"), F.col("next").isNotNull().alias("moved")),
                f"hooks-{turn}-{step}")
            if hooks.where("moved").isEmpty():
                break
        if labels is None:
            own = edges.select(F.col("a").alias("node")).union(edges.select(F.col("b").alias("node"))).distinct()
            labels = own.select("node", F.col("node").alias("component"))
        to = hooks.select(F.col("node").alias("component"), "up")
        labels = written(labels.join(to, "component", "left").select(
            "node", F.coalesce("up", "component").alias("component")), f"labels-{turn}")
        for side in ("a", "b"):
            end = hooks.select(F.col("node").alias(side), "up")
            edges = edges.join(end, side, "left").withColumn(side, F.coalesce("up", side)).drop("up")
        edges = written(edges.where("a != b").select(*a_b).distinct(), f"edges-{turn}")
    if labels is None:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return labels
