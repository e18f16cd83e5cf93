"""Connected components of a link table by repeated contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def components(links: DataFrame) -> DataFrame:
    """node and component (smallest node reachable) for every node of ``links`` (a, b); the others have no row.

    Each round, a node points to the neighbour with the least hash if that is less than its own, links move to
    what their ends point to, and those inside one node go. Hashes put the nodes in random order, so the number
    of rounds grows with the logarithm of the nodes even on long chains. Neighbours meet in partial minima before
    the shuffle; a node with many links is a hot key of plain equi-joins only. Every round is checkpointed.
    """
    edges = cut(links.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    labels = None
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        # A node's order is its hash; equal hashes do not occur for 64-bit ids, whose hash is one to one up to chance.
        near = both.groupBy("a").agg(F.min(F.xxhash64("b")).alias("h"), F.min_by("b", F.xxhash64("b")).alias("b"))
        parent = cut(near.select(F.col("a").alias("node"), F.when(F.col("h") < F.xxhash64("a"), F.col("b")).otherwise(F.col("a")).alias("to")))
        if labels is None:
            labels = parent.select("node", F.col("to").alias("root"))
        else:
            step = parent.select(F.col("node").alias("root"), "to")
            labels = cut(labels.join(step, "root", "left").select("node", F.coalesce("to", "root").alias("root")))
        one = parent.select(F.col("node").alias("a"), F.col("to").alias("x"))
        two = parent.select(F.col("node").alias("b"), F.col("to").alias("y"))
        moved = edges.join(one, "a").join(two, "b").filter("x <> y")
        edges = cut(moved.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct())
    if labels is None:
        return links.select(F.col("a").alias("node"), F.col("a").alias("component")).limit(0)
    smallest = cut(labels.groupBy("root").agg(F.min("node").alias("component")))
    return labels.join(smallest, "root").select("node", "component")
