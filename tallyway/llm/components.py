"""Connected components of an undirected graph by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyway.llm.tables import cut


def components(edges: DataFrame) -> DataFrame:
    """``(node, label)`` for each node of ``edges(a, b)``; label is the smallest node of its component.

    Each round every node points at its smallest neighbour or itself. Pointers only fall, so they are trees; they are followed
    to the roots by doubling, and the edges are rewritten between the roots. Every node that isn't alone joins another, so a round
    leaves at most half the nodes, and a chain of ids however long is one tree. Minima are pre-aggregated before they
    are shuffled, so a hub is no hot key. Edges and pointers are cut to files each round. Self loops and repeated edges do no
    harm; no edges give no rows.
    """
    left = cut(edges.filter("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    labels: DataFrame | None = None
    while not left.isEmpty():
        both = left.select("a", "b").union(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        nearest = both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("node"), F.least("a", "b").alias("to"))
        pointers = rooted(nearest)
        if labels is None:
            labels = pointers
        else:
            moved = pointers.select(F.col("node").alias("label"), F.col("label").alias("next"))
            labels = cut(labels.join(moved, "label", "left").select("node", F.coalesce("next", "label").alias("label")))
        ends = [pointers.select(F.col("node").alias(c), F.col("label").alias(f"{c}_root")) for c in ("a", "b")]
        kept = left.join(ends[0], "a").join(ends[1], "b").filter("a_root != b_root")
        left = cut(kept.select(F.least("a_root", "b_root").alias("a"), F.greatest("a_root", "b_root").alias("b")).distinct())
    if labels is None:
        return left.select(F.col("a").alias("node"), F.col("b").alias("label"))
    return labels


def rooted(pointers: DataFrame) -> DataFrame:
    """``(node, label)`` from ``pointers(node, to)`` of a forest, where roots point at themselves: each node's root, in as many joins as the height has bits."""
    now = cut(pointers)
    while True:
        far = now.select(F.col("node").alias("to"), F.col("to").alias("next"))
        step = cut(now.join(far, "to").select("node", "to", "next"))
        now = step.select("node", F.col("next").alias("to"))
        if step.filter("next != to").isEmpty():
            return now.select("node", F.col("to").alias("label"))
