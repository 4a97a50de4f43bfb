"""Values of recursive types, kept as a table of nodes: bytes are built from the leaves up, one join a level."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillpack.functions import codecs as c
from quillpack.functions import wire as w

VALUE = c.i64


def encode_trees(nodes: DataFrame, depth: int, value: str = "node") -> DataFrame:
    """tree and b, the bytes of the root's value, of complete binary trees of ``depth`` whose root is node 1.

    A node is a record of its value and two options of nodes. Each round folds the
    lowest level into its parents, so a round moves half the nodes of the one before.
    """
    own = F.concat(w.constant(b"\0"), VALUE.enc(F.col(value)))
    level = nodes.where(F.col("node") >= (1 << depth)).select("tree", "node", F.concat(own, w.constant(b"\0\0")).alias("b"))
    for up in range(depth - 1, -1, -1):
        parent = F.floor(F.col("node") / 2).alias("parent")
        folded = level.select("tree", parent, "node", "b").groupBy("tree", "parent").agg(
            F.min_by("b", "node").alias("low"), F.max_by("b", "node").alias("high")
        )
        here = nodes.where((F.col("node") >= (1 << up)) & (F.col("node") < (1 << (up + 1)))).select(F.col("tree").alias("of"), F.col("node"), own.alias("own"))
        one = w.constant(b"\1")
        level = here.join(folded, (F.col("of") == F.col("tree")) & (F.col("node") == F.col("parent"))).select("tree", "node", F.concat("own", one, "low", one, "high").alias("b"))
    return level.select("tree", "b")
