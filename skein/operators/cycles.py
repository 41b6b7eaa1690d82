"""Strongly connected parts of a directed graph, and the edges whose loss leaves it without cycles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.operators.graph import chains, shortened, stands_for, trimmed
from skein.operators.rounds import Rounds


def _rings(edges: DataFrame, in_chains: DataFrame, rounds: Rounds) -> DataFrame:
    """(id, scc) of the nodes of rings that nothing leads into or out of, by the smallest of each. A node looks twice as far
    ahead each round, so a ring of n nodes takes log2(n)."""
    one = lambda c: edges.groupBy(c).agg(F.count("*").alias("n")).filter("n = 1").select(c)
    simple = edges.join(one("src").hint("merge"), "src", "left_semi").join(one("dst").hint("merge"), "dst", "left_semi").filter("src <> dst")
    alone = simple.join(in_chains.select(F.col("node").alias("src")).hint("merge"), "src", "left_anti")
    now = rounds.put(alone.select(F.col("src").alias("id"), F.col("dst").alias("on"), F.least("src", "dst").alias("scc")))
    changed = now.count()
    while changed:
        ahead = now.select(F.col("id").alias("on"), F.col("on").alias("far"), F.col("scc").alias("there")).hint("merge")
        step = now.join(ahead, "on").select("id", F.col("far").alias("on"), F.least("scc", "there").alias("scc"), (F.col("there") < F.col("scc")).alias("less"))
        now, changed = rounds.counted(step, F.count_if("less"))
        now = now.select("id", "on", "scc")
    return now.select("id", "scc")


def _core(edges: DataFrame, rounds: Rounds) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(edges, inside, rings, loops): what may lie on a cycle of several nodes once chains are one node each and nodes without
    a way in or out are gone; (id, node) of the nodes that stand for others; (id, scc) of plain rings, by the nodes of that
    graph; and (id, scc) of nodes on a cycle that became one node, by that node.

    All are done in turn until nothing changes, so long chains and branching ends go in few rounds. A node that leads to
    itself is a part found, and the edge goes: parts one after the other are then a chain themselves. Where such a node
    later turns out to be in a larger part, that is the part of all it stands for.
    """
    inside, rings, loops = None, None, None
    while True:
        found = rounds.put(chains(edges))
        ring = rounds.put(_rings(edges, found, rounds))
        rings = ring if rings is None else rings.unionByName(ring)
        left = rounds.put(shortened(edges.join(ring.select(F.col("id").alias("src")).hint("merge"), "src", "left_anti"), found))
        inside = rounds.put(stands_for(inside, found))
        own = left.filter("src = dst").select(F.col("src").alias("node"))
        whole = inside.join(own.hint("merge"), "node", "left_semi").select("id", F.col("node").alias("scc"))
        whole = rounds.put(whole.unionByName(own.select(F.col("node").alias("id"), F.col("node").alias("scc"))).distinct())
        loops = whole if loops is None else rounds.put(whole.unionByName(loops.join(whole.select("id").hint("merge"), "id", "left_anti")))
        was = edges.count()
        edges, n = rounds.counted(trimmed(left.filter("src <> dst")), F.count("*"))
        if n == was or not n:
            return edges, inside, rings, loops


def strongly_connected(edges: DataFrame) -> DataFrame:
    """(id, scc) of the nodes that lie on cycles, by the smallest id of their strongly connected part; a node that leads to
    itself lies on one.

    Chains, trees at the ends, rings and what becomes one of these are settled first (see _core). In what is left every node takes the largest id that
    leads to it; a node with its own id and all nodes of that colour that lead to it are one part; parts found go, and the
    rest is coloured again. Rounds grow with the longest way in the contracted graph, and each is a join of what changed.
    """
    rounds = Rounds(edges.sparkSession)
    edges = rounds.put(edges.select("src", "dst").distinct())
    left, inside, found, loops = _core(edges, rounds)
    while not left.isEmpty():
        ids = rounds.put(left.select(F.col("src").alias("id")).union(left.select("dst")).distinct())
        colour = rounds.put(ids.select("id", F.col("id").alias("c")))
        front = colour
        while not front.isEmpty():
            reach = left.join(front.withColumnRenamed("id", "src").hint("merge"), "src").groupBy(F.col("dst").alias("id")).agg(F.max("c").alias("to"))
            step = rounds.put(colour.join(reach.hint("merge"), "id", "left").select("id", F.greatest("c", F.coalesce("to", "c")).alias("c"), (F.col("to") > F.col("c")).alias("more")))
            colour, front = step.select("id", "c"), step.filter("more").select("id", "c")
        of = lambda c: colour.select(F.col("id").alias(c), F.col("c").alias(f"c_{c}")).hint("merge")
        inner = rounds.put(left.join(of("src"), "src").join(of("dst"), "dst").filter("c_src = c_dst").select("src", "dst"))
        part = rounds.put(colour.filter("id = c"))
        front = part
        while not front.isEmpty():
            back = inner.join(front.select(F.col("id").alias("dst"), "c").hint("merge"), "dst").select(F.col("src").alias("id"), "c").distinct()
            front = rounds.put(back.join(part.select("id").hint("merge"), "id", "left_anti"))
            part = rounds.put(part.unionByName(front))
        # edges of one node are gone, so a part of one node is on no cycle
        large = part.groupBy("c").agg(F.count("*").alias("n")).filter("n > 1").select("c")
        cyclic = part.join(large.hint("merge"), "c", "left_semi")
        found = rounds.put(found.unionByName(cyclic.select("id", F.col("c").alias("scc"))))
        left = rounds.put(left.join(part.select(F.col("id").alias("src")).hint("merge"), "src", "left_anti").join(part.select(F.col("id").alias("dst")).hint("merge"), "dst", "left_anti").select("src", "dst"))
    members = inside.filter("id <> node").join(found.withColumnRenamed("id", "node").hint("merge"), "node").select("id", "scc")
    whole = rounds.put(found.unionByName(members).distinct())
    whole = rounds.put(whole.unionByName(loops.join(whole.select("id").hint("merge"), "id", "left_anti")))
    least = whole.groupBy("scc").agg(F.min("id").alias("least"))
    return whole.join(least.hint("merge"), "scc").select("id", F.col("least").alias("scc"))


def break_cycles(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(edges, removed): edges (src, dst) without cycles, and those taken away, in rounds.

    In each strongly connected part the best covered node (nodes: id, dp; of equal ones the smallest id) loses, of its
    edges inside the part, those on the weaker side: into it if the best covered node that leads to it has less than the
    best one that it leads to, else out of it. On a plain cycle that is one edge. Only edges inside parts are looked at
    again, and each round takes a node of each part off all cycles.
    """
    rounds = Rounds(edges.sparkSession)
    whole = rounds.put(edges.select("src", "dst").distinct())
    left, removed = whole, None
    while True:
        part = rounds.put(strongly_connected(left))
        of = lambda c: part.select(F.col("id").alias(c), F.col("scc").alias(f"p_{c}")).hint("merge")
        left = rounds.put(left.join(of("src"), "src").join(of("dst"), "dst").filter("p_src = p_dst").select("src", "dst", F.col("p_src").alias("scc")))
        if left.isEmpty():
            break
        covered = part.join(nodes.select("id", "dp").hint("merge"), "id")
        best = covered.groupBy("scc").agg(F.min(F.struct((-F.col("dp")).alias("d"), "id")).alias("x")).select("scc", F.col("x.id").alias("m"))
        at = left.join(best.hint("merge"), "scc").filter("src = m or dst = m").select("src", "dst", "scc", "m")
        end = lambda c: nodes.select(F.col("id").alias(c), F.col("dp").alias(f"dp_{c}")).hint("merge")
        at = rounds.put(at.join(end("src"), "src").join(end("dst"), "dst"))
        side = at.groupBy("scc").agg(F.max(F.when(F.col("dst") == F.col("m"), F.col("dp_src"))).alias("into"), F.max(F.when(F.col("src") == F.col("m"), F.col("dp_dst"))).alias("out"))
        gone = at.join(side.hint("merge"), "scc").filter(F.when(F.col("into") < F.col("out"), F.col("dst") == F.col("m")).otherwise(F.col("src") == F.col("m"))).select("src", "dst")
        gone = rounds.put(gone)
        removed = gone if removed is None else removed.unionByName(gone)
        left = rounds.put(left.select("src", "dst").join(gone.hint("merge"), ["src", "dst"], "left_anti"))
    if removed is None:
        return whole, whole.limit(0)
    return whole.join(removed.hint("merge"), ["src", "dst"], "left_anti"), removed
