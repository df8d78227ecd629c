"""Connected components of a large graph of long ids, by hooking and pointer jumping.

Every step is a join or a grouped minimum over edges or labels; a step's result is written to the shared
folder, so that lineage stays short and a lost executor costs one step.  The driver sees counts only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import kept


def _jumped(labels: DataFrame) -> DataFrame:
    """Follow every node's label to its root.  A label shared by very many nodes is a hot key of the left
    side only; both sides are exchanges of stored rows, which adaptive execution splits."""
    while True:
        to = labels.select(F.col("node").alias("at"), F.col("root").alias("beyond"))
        step = kept(
            labels.join(to, F.col("root") == F.col("at")).select("node", "root", "beyond")
        )
        labels = step.select("node", F.col("beyond").alias("root"))
        if step.where("root <> beyond").isEmpty():
            return labels


def connected(edges: DataFrame) -> DataFrame:
    """(node, root) of all nodes of the edges (a, b); the root is the smallest node that is reachable.

    Edges may repeat, point either way and join a node to itself; an empty table gives an empty one."""
    edges = kept(edges.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")).distinct())
    both = edges.select(F.explode(F.array("a", "b")).alias("node"), F.least("a", "b").alias("low"))
    # Each node starts below its smallest neighbour: a forest, as labels only go down.
    labels = _jumped(kept(both.groupBy("node").agg(F.min("low").alias("root"))))
    while True:
        x = labels.select(F.col("node").alias("a"), F.col("root").alias("ra"))
        y = labels.select(F.col("node").alias("b"), F.col("root").alias("rb"))
        across = edges.join(x, "a").join(y, "b").where("ra <> rb")
        hooks = kept(
            across.groupBy(F.greatest("ra", "rb").alias("high")).agg(F.min(F.least("ra", "rb")).alias("low"))
        )
        if hooks.isEmpty():
            return labels
        moved = labels.join(hooks, F.col("root") == F.col("high"), "left")
        labels = _jumped(kept(moved.select("node", F.coalesce("low", "root").alias("root"))))
