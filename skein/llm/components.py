"""Connected components of a link table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch

#: A chain of n links settles in about log2(n) rounds; this is far beyond any table, and passing it is an error.
MAX_ROUNDS = 60


def components(links: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, comp) for every node of links (a, b); comp is the smallest node of the component.

    Each step is a grouped minimum, whose partial sums meet before the shuffle, and a join that adaptive execution
    splits where one node has very many links. Every round is written, so lost executors cost one round at most.
    The driver sees counts only.
    """
    edges = scratch.put(
        links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct(), "edges"
    )
    before = None
    for _ in range(MAX_ROUNDS):
        # large star: every larger neighbour of a node is linked to the node's smallest neighbour
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = scratch.put(both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "large")
        # small star: a node and its smaller neighbours are linked to the smallest of them
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v")
        small = scratch.put(moved.union(least.select("u", F.col("m").alias("v"))).distinct(), "small")
        scratch.drop(edges, large)
        edges = small
        now = edges.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0))).first()
        if now == before:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("comp")).union(
                edges.select(F.col("v").alias("node"), F.col("v").alias("comp")).distinct()
            )
        before = now
    raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")
