"""Connected components of an edge table, without leaving the cluster."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpoint_narrow

#: Rounds after which the edges must have settled; the need grows with the logarithm of a component's width.
MOST_ROUNDS = 60


def connected_components(edges: DataFrame) -> DataFrame:
    """``node`` and ``component`` (its smallest node) for all nodes of ``edges`` (a, b).

    Large-star and small-star steps in turn: each ties the neighbours of a node to the
    smallest among them, until every node hangs on its component's smallest node. Edges
    are checkpointed in each round; minima are combined before the shuffle, and joins on
    popular nodes can be split. Loops and repeated edges do no harm; null ends are dropped.
    An empty table gives an empty result.
    """
    edges = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    edges = checkpoint_narrow(edges)
    state = None
    for _ in range(MOST_ROUNDS):
        parts = edges.rdd.getNumPartitions()  # edges never become more, so neither need their partitions
        # Large star: every larger neighbour goes to the least of the neighbourhood.
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least("a", F.min("b")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).coalesce(parts)
        # Small star: a node and its smaller neighbours go to the least of these.
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        lower = large.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        edges = checkpoint_narrow(lower.union(least.select("a", F.col("m").alias("b"))).coalesce(parts).distinct())
        now = tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if now == state:
            break
        state = now
    else:
        raise RuntimeError("components have not settled")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).union(edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
