"""Connected components by contraction, all in joins and groupings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logharrow.session import settled


def components(edges: DataFrame) -> DataFrame:
    """The smallest node of each node's component, (node, label), from edges (a, b).

    Every node points at the smallest of its neighbours, pointers are followed two
    steps, and the edges are contracted; that repeats until none is left. Each round halves
    the nodes at least. Neighbour sets are only ever reduced to their minimum, so a node
    with very many neighbours costs no more than its edges.
    """
    edges = settled(edges.select("a", "b").where("a <> b").distinct(), "edges")
    labels = None
    while not edges.isEmpty():
        both = edges.union(edges.select("b", "a"))
        to = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        to = settled(to.select(F.col("a").alias("from"), "m"), "pointers")
        step = to.select(F.col("from").alias("m"), F.col("m").alias("m2"))
        far = to.join(step, "m").select("from", F.col("m2").alias("m"))
        to = settled(far.join(step, "m").select("from", F.col("m2").alias("m")), "pointers")
        if labels is None:  # in the first round every node has a pointer
            labels = to.select(F.col("from").alias("node"), F.col("m").alias("label"))
        else:
            labels = settled(
                labels.join(to, F.col("label") == F.col("from"), "left")
                .select("node", F.coalesce("m", "label").alias("label")),
                "labels",
            )
        left = edges.join(to, F.col("a") == F.col("from")).select(F.col("m").alias("a"), "b")
        right = left.join(to, F.col("b") == F.col("from")).select("a", F.col("m").alias("b"))
        edges = settled(right.where("a <> b").distinct(), "edges")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("label")) if labels is None else labels
