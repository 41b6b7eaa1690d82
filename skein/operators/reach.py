"""An index of reachability: strongly connected parts as one node each, paths that cover them, and for each part the first
place of every path that it leads to. Pairs are answered by a join; they are never all written down."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.operators.cycles import strongly_connected
from skein.operators.graph import chains
from skein.operators.rounds import Rounds


class ReachIndex(NamedTuple):
    """places (id, part, path, pos): each node's part, the path it is on, and where. labels (part, path, pos): the first place of
    a path that a part leads to, its own included. cyclic (part): parts that lead back to themselves."""

    places: DataFrame
    labels: DataFrame
    cyclic: DataFrame


def reach_index(edges: DataFrame) -> ReachIndex:
    """The index of a graph (src, dst). Paths: of each part's ways on, the smallest part whose own smallest way back it is, so
    every part is on one path. Labels go back along edges, only those that changed, until none does: as many rounds as the
    longest way between parts has edges; a part has at most as many labels as there are paths. Tables as large as the graph
    are merged, as broadcasts would take them through the driver."""
    rounds = Rounds(edges.sparkSession)
    edges = rounds.put(edges.select("src", "dst").distinct())
    scc = rounds.put(strongly_connected(edges))
    ids = edges.select(F.col("src").alias("id")).union(edges.select("dst")).distinct()
    part_of = rounds.put(ids.join(scc.hint("merge"), "id", "left").select("id", F.coalesce("scc", "id").alias("part")))
    end = lambda c: part_of.select(F.col("id").alias(c), F.col("part").alias(f"p_{c}")).hint("merge")
    dag = edges.join(end("src"), "src").join(end("dst"), "dst").filter("p_src <> p_dst")
    dag = rounds.put(dag.select(F.col("p_src").alias("src"), F.col("p_dst").alias("dst")).distinct())
    on, back = dag.groupBy("src").agg(F.min("dst").alias("dst")), dag.groupBy("dst").agg(F.min("src").alias("src"))
    found = rounds.put(chains(rounds.put(on.join(back.hint("merge"), ["src", "dst"]).select("src", "dst"))))
    place = part_of.select("part").distinct().join(found.withColumnRenamed("node", "part").hint("merge"), "part", "left")
    place = rounds.put(place.select("part", F.coalesce("head", "part").alias("path"), F.coalesce("rank", F.lit(0)).cast("long").alias("pos")))

    labels = new = place.select("part", "path", "pos")
    while True:
        step = dag.join(new.withColumnRenamed("part", "dst").hint("merge"), "dst").groupBy(F.col("src").alias("part"), "path").agg(F.min("pos").alias("to"))
        step = step.join(labels.hint("merge"), ["part", "path"], "left").filter(F.col("pos").isNull() | (F.col("to") < F.col("pos"))).select("part", "path", F.col("to").alias("pos"))
        new = rounds.put(step)
        if new.isEmpty():
            break
        labels = rounds.put(labels.unionByName(new).groupBy("part", "path").agg(F.min("pos").alias("pos")))
    places = part_of.join(place.hint("merge"), "part").select("id", "part", "path", "pos")
    return ReachIndex(rounds.put(places), labels, rounds.put(scc.select(F.col("scc").alias("part")).distinct()))


def reaches(index: ReachIndex, pairs: DataFrame) -> DataFrame:
    """pairs (source, id) with `reached`: whether a way of at least one edge leads from the first to the second. Nodes that
    the graph doesn't have reach nothing. A node reaches itself only by a cycle."""
    s = index.places.select(F.col("id").alias("source"), F.col("part").alias("from")).hint("merge")
    t = index.places.select("id", F.col("part").alias("to"), "path", "pos").hint("merge")
    rows = pairs.join(s, "source", "left").join(t, "id", "left")
    rows = rows.join(index.labels.select(F.col("part").alias("from"), "path", F.col("pos").alias("first")).hint("merge"), ["from", "path"], "left")
    rows = rows.join(index.cyclic.select(F.col("part").alias("to"), F.lit(True).alias("again")).hint("merge"), "to", "left")
    inside = (F.col("from") == F.col("to")) & F.coalesce("again", F.lit(False))
    beyond = (F.col("from") != F.col("to")) & (F.col("first") <= F.col("pos"))
    return rows.select("source", "id", F.coalesce(inside | beyond, F.lit(False)).alias("reached"))


def reached_from(index: ReachIndex, sources: DataFrame) -> DataFrame:
    """(source, id): what each of the sources (id) reaches by a way of at least one edge."""
    s = index.places.select(F.col("id").alias("source"), F.col("part").alias("from")).join(sources.select(F.col("id").alias("source")).distinct().hint("merge"), "source", "left_semi")
    rows = s.join(index.labels.select(F.col("part").alias("from"), "path", F.col("pos").alias("first")).hint("merge"), "from")
    rows = rows.join(index.places.hint("merge"), "path").filter("first <= pos")
    cyclic = index.cyclic.select("part", F.lit(True).alias("again"))
    rows = rows.join(cyclic.hint("merge"), "part", "left").filter((F.col("from") != F.col("part")) | F.coalesce("again", F.lit(False)))
    return rows.select("source", "id").distinct()
