"""What nodes are made of: a membership table (id, part, copied) that follows splits and contractions.

Links from reads stay between the nodes of the first graph. Those of any later node are one aggregation over its parts, so
no rewrite of the graph rewrites links.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.operators.links import node_links


def start(nodes: DataFrame) -> DataFrame:
    """Every node is made of itself."""
    return nodes.select("id", F.col("id").alias("part"), F.lit(False).alias("copied"))


def follow(parts: DataFrame, mapped: DataFrame, copies: bool) -> DataFrame:
    """parts after nodes became others (mapped: old, new): a copy is made of what its node was, a contracted node of all that
    went into it. With copies, what is under a new node is marked: reads can't tell which of the copies they belong to."""
    rows = parts.join(mapped.select(F.col("old").alias("id"), "new"), "id", "left")
    copied = F.col("copied") | F.col("new").isNotNull() if copies else F.col("copied")
    return rows.select(F.coalesce("new", "id").alias("id"), "part", copied.alias("copied"))


def links_of(links: DataFrame, parts: DataFrame, copies: bool = True) -> DataFrame:
    """(a, b, cnt) between different nodes, from those between parts; without copies, what was copied has none."""
    rows = parts if copies else parts.filter(~F.col("copied"))
    return node_links(links, rows.select("id", "part")).filter("a <> b")
