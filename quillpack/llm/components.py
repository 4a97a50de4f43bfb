"""Distributed connected components by repeated contraction to least neighbours.

A level labels every node with its least neighbour, follows the labels down to
their roots by doubling, and keeps the edges whose ends still differ as edges
between roots; the next level works on those. Only nodes that are less than all
their neighbours stay roots, so the graph shrinks with each level.
Every join reads checkpointed tables on both sides, so adaptive execution can
split the partition of a node with very many links.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillpack.llm.store import settle


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node and component (the least node reachable) for every node that has an edge to another node.

    Edges with a null end or two equal ends are ignored; repeated edges are harmless.
    """
    edges = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a <> b")
    return contracted(edges)


def contracted(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = settle(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("other")).select("node", F.least("node", "other").alias("label")))
    labels = least.withColumnRenamed("label", "component")
    while True:  # doubles the steps that a label has followed, until all are roots
        onward = labels.select(F.col("node").alias("via"), F.col("component").alias("next"))
        followed = settle(labels.join(onward, F.col("component") == F.col("via")).select("node", "component", "next"))
        labels = followed.select("node", F.col("next").alias("component"))
        if followed.where("component <> next").isEmpty():
            break
    of_a = labels.select(F.col("node").alias("a"), F.col("component").alias("to_a"))
    of_b = labels.select(F.col("node").alias("b"), F.col("component").alias("to_b"))
    rest = edges.join(of_a, "a").join(of_b, "b").where("to_a <> to_b")
    rest = settle(rest.select(F.least("to_a", "to_b").alias("a"), F.greatest("to_a", "to_b").alias("b")).distinct())
    if rest.isEmpty():
        return labels
    higher = contracted(rest).select(F.col("node").alias("via"), F.col("component").alias("final"))
    return settle(labels.join(higher, F.col("component") == F.col("via"), "left").select("node", F.coalesce("final", "component").alias("component")))
