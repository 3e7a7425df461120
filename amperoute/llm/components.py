"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir


# Edges of one partition: an edge table much smaller than its documents needs few tasks and files.
PART_EDGES = 50_000


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _large_star(edges: DataFrame, parts: int) -> DataFrame:
    """Every larger neighbour of a node is tied to the node's smallest neighbour (or itself)."""
    near = _both_ways(edges).coalesce(parts)
    least = near.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")).coalesce(parts)
    return near.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).coalesce(parts).distinct().coalesce(parts)


def _small_star(edges: DataFrame, parts: int) -> DataFrame:
    """A node and its smaller neighbours are tied to the smallest of them. Edges come as a > b."""
    least = edges.groupBy("a").agg(F.min("b").alias("m")).coalesce(parts)
    tied = edges.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
    return tied.union(least.select("a", F.col("m").alias("b"))).coalesce(parts).distinct().coalesce(parts)


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b: long): the root is the smallest node that links reach.

    A node with many links is only ever reduced to a minimum. Each round is checkpointed; the rounds end when the
    edges are stars that no longer change.
    """
    ensure_checkpoint_dir(edges.sparkSession)
    tied = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct().checkpoint()
    state = None
    while True:
        now = tied.agg(F.count("*").alias("n"), F.sum(F.hash("a", "b").cast("long"))).first()
        if now == state or not now.n:
            break
        state, parts = now, -(-now.n // PART_EDGES) or 1
        tied = _small_star(_large_star(tied, parts), parts).checkpoint()
    return tied.select(F.col("a").alias("node"), F.col("b").alias("root")).union(tied.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
