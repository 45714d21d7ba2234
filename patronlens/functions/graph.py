"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from patronlens.session import cut_lineage


def _compressed(parent: DataFrame) -> DataFrame:
    """``node`` and the root its chain of parents (``to``) ends at; paths are halved in length every round."""
    while True:
        further = parent.select(F.col("node").alias("to"), F.col("to").alias("further"))
        jumped = parent.join(further, "to", "left").select("node", F.coalesce("further", "to").alias("next"), "to")
        jumped = cut_lineage(jumped)
        if jumped.where("next <> to").isEmpty():
            return jumped.select("node", "to")
        parent = jumped.select("node", F.col("next").alias("to"))


def connected(edges: DataFrame, left: str = "a", right: str = "b") -> DataFrame:
    """``node`` and ``component``, the smallest node reachable, for every node of an edge table.

    Each round hooks every node to its smallest neighbour if that is smaller, follows the hooks to their
    ends by pointer jumping, so that a chain collapses at once however long it is, and contracts
    the edges to these ends. Rounds and jumps both grow with the logarithm of the nodes. Nulls and
    loops are ignored; a node with only a loop is not listed. Every step is written to the shared
    folder.
    """
    pairs = edges.select(F.col(left).alias("a"), F.col(right).alias("b")).where("a IS NOT NULL AND b IS NOT NULL")
    pairs = cut_lineage(pairs.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    placed = None
    while not pairs.isEmpty():
        ends = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
        nearest = ends.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("node"), F.least("a", "b").alias("to"))
        roots = _compressed(cut_lineage(nearest))
        if placed is None:
            placed = roots.withColumnRenamed("to", "component")
        else:
            step = roots.select(F.col("node").alias("component"), "to")
            placed = placed.join(step, "component", "left").select("node", F.coalesce("to", "component").alias("component"))
            placed = cut_lineage(placed)
        pairs = (
            pairs.join(roots.withColumnsRenamed({"node": "a", "to": "x"}), "a")
            .join(roots.withColumnsRenamed({"node": "b", "to": "y"}), "b")
            .where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
        )
        pairs = cut_lineage(pairs)
    if placed is None:
        return pairs.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return placed
