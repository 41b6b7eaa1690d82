"""Coverage graphs as tables: nodes (id, dp[, seq, ord]) and edges (src, dst[, overlap])."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skein.operators import paths, provenance
from skein.operators.rounds import Rounds
from skein.session import ship


def edge_flow(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Flow of an edge: the mean of the source's coverage shared among its targets and the target's among its sources."""
    s, t = nodes.select(F.col("id").alias("src"), F.col("dp").alias("sdp")), nodes.select(F.col("id").alias("dst"), F.col("dp").alias("tdp"))
    rows = Rounds(nodes.sparkSession).put(edges.join(s, "src").join(t, "dst"))  # read three times
    outs = rows.groupBy("src").agg(F.sum("tdp").alias("outs"))
    ins = rows.groupBy("dst").agg(F.sum("sdp").alias("ins"))
    rows = rows.join(outs, "src").join(ins, "dst")
    return rows.select("src", "dst", ((F.col("tdp") / F.col("outs") * F.col("sdp") + F.col("sdp") / F.col("ins") * F.col("tdp")) / 2).alias("flow"))


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, n_in, n_out) of every node."""
    ends = edges.select(F.col("dst").alias("id"), F.lit(1).alias("i"), F.lit(0).alias("o")).unionAll(edges.select("src", F.lit(0), F.lit(1)))
    deg = ends.groupBy("id").agg(F.sum("i").alias("n_in"), F.sum("o").alias("n_out"))
    return nodes.select("id").join(deg, "id", "left").select("id", F.coalesce("n_in", F.lit(0)).cast("long").alias("n_in"), F.coalesce("n_out", F.lit(0)).cast("long").alias("n_out"))


def branches(edges: DataFrame) -> DataFrame:
    """(id, n_in, n_out, n_both): nodes with more sources, and more targets, than neighbours that are both, and than one."""
    ins = edges.groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("n_in"))
    outs = edges.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("n_out"))
    back = edges.join(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")), ["src", "dst"], "left_semi")
    both = back.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("n_both"))
    rows = ins.join(outs, "id").join(both, "id", "left").withColumn("n_both", F.coalesce("n_both", F.lit(0)))
    least = F.greatest("n_both", F.lit(1))
    return rows.filter((F.col("n_in") > least) & (F.col("n_out") > least)).select("id", "n_in", "n_out", "n_both")


def bubble_nodes(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    return degrees(nodes, edges).filter("n_in = 1 and n_out = 1").select("id")


#: Values that the last step of ranked() orders.
HELD = 4096
#: Accuracy of the summaries by which ranked() chooses its ranges.
ACCURACY = 10_000


def ranked(values: DataFrame, column: str, rank: int) -> float | None:
    """The value of that rank, from 0, of a column's values that aren't null; null values have none. Exact, without all
    values ever being in one place: two values near the rank are taken from a summary of bounded size, values below, at
    and between them are counted, and the range that holds the rank is looked at again, until HELD values are left. Each
    pass leaves about one in ACCURACY / 4, whatever the values are; the driver sees counts only."""
    v, inside = F.col("v"), None
    left = values.select(F.col(column).cast("double").alias("v")).filter(v.isNotNull())
    while True:
        inside = left.count() if inside is None else inside
        if not 0 <= rank < inside:
            return None
        if inside <= HELD:
            return left.orderBy("v").offset(rank).first()["v"]
        near = [max(0.0, rank / inside - 2 / ACCURACY), min(1.0, rank / inside + 2 / ACCURACY)]
        a, b = left.agg(F.percentile_approx("v", near, ACCURACY)).first()[0]
        under, at_a, between_, at_b = left.agg(F.count_if(v < a), F.count_if(v == a), F.count_if((v > a) & (v < b)), F.count_if((v == b) & (v > a))).first()
        over = inside - under - at_a - between_ - at_b
        for n, found in ((under, v < a), (at_a, a), (between_, (v > a) & (v < b)), (at_b, b), (over, v > b)):
            if rank < n:
                break
            rank -= n
        if not isinstance(found, Column):
            return found
        left, inside = left.filter(found), n


def median(values: DataFrame, column: str) -> float | None:
    """The exact median, see ranked; of an even number of values the mean of the middle two. Null without values."""
    n = values.filter(F.col(column).isNotNull()).count()
    low = ranked(values, column, (n - 1) // 2)
    if low is None or n % 2:
        return low
    up = values.agg(F.count_if(F.col(column) <= low).alias("n"), F.min(F.when(F.col(column) > low, F.col(column))).alias("next")).first()
    return low if up["n"] > n // 2 else (low + up["next"]) / 2


def histogram(nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Bins of width 0.05 medians over the coverage range: (bin, n), and one row (low, high, median, bins)."""
    stats = nodes.agg(F.min("dp").alias("low"), F.max("dp").alias("high"), F.lit(median(nodes, "dp")).cast("double").alias("median"))
    stats = stats.withColumn("bins", F.floor((F.col("high") - F.col("low")) / (0.05 * F.col("median"))).cast("long"))
    width = (F.col("high") - F.col("low")) / F.col("bins")
    rows = nodes.join(F.broadcast(stats.filter("bins > 0"))).select(F.least(F.floor((F.col("dp") - F.col("low")) / width), F.col("bins") - 1).alias("bin"))
    return rows.groupBy("bin").agg(F.count("*").alias("n")), stats


def coverage_threshold(nodes: DataFrame) -> float:
    """0, or 0.05 to 0.25 medians if the fullest bin is the lowest: 0.05 more for each falling step of the first four.
    Uniform coverage, or a spread of less than one bin, gives 0. Only six numbers reach the driver."""
    bins, stats = histogram(nodes)
    s = stats.first()
    if not s["bins"]:
        return 0.0
    top = bins.orderBy(F.desc("n"), "bin").first()
    if top["bin"] != 0:
        return 0.0
    n = dict(bins.filter("bin <= 4").collect())
    ratio = 0.05
    for i in range(min(4, s["bins"] - 1)):
        if n.get(i, 0) <= n.get(i + 1, 0):
            break
        ratio += 0.05
    return ratio * s["median"]


def prune(nodes: DataFrame, edges: DataFrame, min_cov: float, keep: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Nodes above the coverage, or named in keep (id), and the edges between them."""
    left = nodes.filter(F.col("dp") > min_cov)
    if keep is not None:
        left = left.unionByName(nodes.filter(F.col("dp") <= min_cov).join(keep.select("id"), "id", "left_semi").select(*nodes.columns))
    return left, between(edges, left)


def between(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    return edges.join(nodes.select(F.col("id").alias("src")), "src", "left_semi").join(nodes.select(F.col("id").alias("dst")), "dst", "left_semi").select(*edges.columns)


def compact(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Each node once, and each edge between two of them once."""
    nodes = nodes.dropDuplicates(["id"])
    return nodes, between(edges, nodes).dropDuplicates(["src", "dst"])


def subtract(nodes: DataFrame, flows: DataFrame, walks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes (id, dp) and flows (src, dst, flow) less the coverage of the walks (name, path, cov) that use them."""
    used = walks.select("cov", F.explode(F.array_distinct("path")).alias("id")).groupBy("id").agg(F.sum("cov").alias("_c"))
    taken = paths.steps(walks).join(walks.select("name", "cov"), "name").groupBy("src", "dst").agg(F.sum("cov").alias("_c"))
    left = nodes.join(used, "id", "left").withColumn("dp", F.col("dp") - F.coalesce("_c", F.lit(0.0))).drop("_c")
    rest = flows.join(taken, ["src", "dst"], "left").withColumn("flow", F.col("flow") - F.coalesce("_c", F.lit(0.0))).drop("_c")
    return left, rest


def reindex(nodes: DataFrame, order: Column) -> DataFrame:
    """(id, new_id): dense ordinals as strings. Range partitions are counted, so no task holds all nodes."""
    rows = nodes.select("id", order.alias("_o")).repartitionByRange("_o", "id").sortWithinPartitions("_o", "id")
    rows = Rounds(nodes.sparkSession).put(rows.withColumn("_p", F.spark_partition_id()))
    sizes = rows.groupBy("_p").agg(F.count("*").alias("_n"))
    ahead = sizes.withColumn("_a", F.coalesce(F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    place = F.row_number().over(Window.partitionBy("_p").orderBy("_o", "id")) - 1 + F.col("_a")
    return rows.join(F.broadcast(ahead), "_p").select("id", place.cast("string").alias("new_id"))


def _contracted(links: DataFrame, rounds: Rounds) -> tuple[DataFrame, DataFrame]:
    """Chains of links (id, u, v) of an undirected graph as one link each, and (id, new) of those that are part of one; a
    chain runs through ends of exactly two links. Links of plain rings, which have no end to start from, are left out.

    A link has two darts, 2 id towards v and 2 id + 1 towards u. Where two links meet, the dart that arrives by one goes on
    as the dart that leaves by the other; last_of follows them to where they stop, so a chain of n links takes log2(n)
    joins, and both its ends are known at each of its links.
    """
    darts = links.select((F.col("id") * 2).alias("d"), F.col("v").alias("at")).unionAll(links.select(F.col("id") * 2 + 1, F.col("u")))
    meet = darts.groupBy("at").agg(F.count("*").alias("c"), F.min("d").alias("x"), F.max("d").alias("y")).filter("c = 2 and shiftright(x, 1) <> shiftright(y, 1)")
    turned = lambda c: F.col(c).bitwiseXOR(F.lit(1).cast("long"))
    on = rounds.put(meet.select(F.col("x").alias("src"), turned("y").alias("dst")).unionAll(meet.select("y", turned("x"))))
    stop = rounds.put(last_of(on))
    end = lambda d, name: stop.select(F.col("old").alias(d), F.col("new").alias(name))
    rows = links.select("id", (F.col("id") * 2).alias("f"), (F.col("id") * 2 + 1).alias("g")).join(end("f", "ff"), "f", "left").join(end("g", "gg"), "g", "left")
    moving = on.select(F.shiftright("src", 1).alias("id")).distinct()
    stopped = stop.select(F.shiftright("old", 1).alias("id")).distinct()
    rows = rows.join(moving.join(stopped, "id", "left_anti"), "id", "left_anti")  # rings
    rows = rows.select("id", F.coalesce("ff", "f").alias("f"), F.coalesce("gg", "g").alias("g"))
    rows = rounds.put(rows.withColumn("new", F.least(F.shiftright("f", 1), F.shiftright("g", 1))))
    ends = rows.filter("id = new").select("id", "f", "g")
    ends = ends.join(darts.select(F.col("d").alias("f"), F.col("at").alias("u")), "f").join(darts.select(F.col("d").alias("g"), F.col("at").alias("v")), "g")
    return rounds.put(ends.select("id", "u", "v")), rows.select("id", "new")


def peeled(links: DataFrame) -> DataFrame:
    """(id) of the links (id long, u, v) of an undirected graph that go if links with an end of their own are taken away
    again and again; what is left are rings and what joins them.

    Chains become one link and links with a free end go, in turn. After the first, no end has exactly two links, so at
    least half of the ends of a tree are free: a graph of n links takes at most some log2(n) rounds, each a few joins of
    what is left, and a path of any length goes in the first.
    """
    rounds = Rounds(links.sparkSession)
    left = rounds.put(links.select("id", "u", "v"))
    inside = left.select("id", F.col("id").alias("now"))  # what each link is part of now
    gone = None
    while True:
        left, parts = _contracted(left, rounds)
        inside = rounds.put(inside.join(parts.select(F.col("id").alias("now"), "new"), "now").select("id", F.col("new").alias("now")))
        ends = left.select(F.col("u").alias("at")).unionAll(left.select("v"))
        free = ends.groupBy("at").agg(F.count("*").alias("c")).filter("c = 1").select("at")
        loose = left.join(free.withColumnRenamed("at", "u"), "u", "left_semi").select("id").union(left.join(free.withColumnRenamed("at", "v"), "v", "left_semi").select("id"))
        loose = rounds.put(loose.distinct())
        if loose.isEmpty():
            return links.select("id").limit(0) if gone is None else gone
        now = rounds.put(inside.join(loose.withColumnRenamed("id", "now"), "now", "left_semi").select("id"))
        gone = now if gone is None else gone.unionAll(now)
        left = rounds.put(left.join(loose, "id", "left_anti"))
        inside = rounds.put(inside.join(loose.withColumnRenamed("id", "now"), "now", "left_anti").select("id", "now"))


def clean_edges(edges: DataFrame, on_paths: DataFrame | None = None) -> DataFrame:
    """(src, dst, assigned, kept). An edge is assigned if it is the only unassigned one into its target or out of its
    source, to a fixpoint, or if a path uses it (on_paths: src, dst); an unassigned edge that shares its source or target
    with an assigned one is not kept. Sources and targets are told apart, so a node may be both; see peeled for the rounds."""
    rounds = Rounds(edges.sparkSession)
    rows = rounds.put(edges.select("src", "dst").withColumn("id", F.monotonically_increasing_id()))
    side = lambda name, c: F.concat(F.lit(name), F.col(c).cast("string"))
    found = peeled(rows.select("id", side("s", "src").alias("u"), side("t", "dst").alias("v")))
    rows = rows.join(found.withColumn("hit", F.lit(True)), "id", "left").select("src", "dst", F.coalesce("hit", F.lit(False)).alias("assigned"))
    if on_paths is not None:
        used = on_paths.select("src", "dst").distinct().withColumn("hit", F.lit(True))
        rows = rows.join(used, ["src", "dst"], "left").select("src", "dst", (F.col("assigned") | F.coalesce("hit", F.lit(False))).alias("assigned"))
    rows = rounds.put(rows)
    a = rows.filter("assigned")
    rows = rows.join(a.select("src").distinct().withColumn("s", F.lit(True)), "src", "left").join(a.select("dst").distinct().withColumn("t", F.lit(True)), "dst", "left")
    return rows.select("src", "dst", "assigned", (F.col("assigned") | (F.col("s").isNull() & F.col("t").isNull())).alias("kept"))


def chains(edges: DataFrame) -> DataFrame:
    """(node, head, rank): maximal chains of simple edges (the only way out of one node and into the other), from their
    first node; found by pointer doubling, so a chain of n nodes takes log2(n) joins. Pure cycles are left out."""
    rounds = Rounds(edges.sparkSession)
    proper = edges.filter("src <> dst").select("src", "dst")
    outs = edges.groupBy("src").agg(F.count("*").alias("c")).filter("c = 1").select("src")
    ins = edges.groupBy("dst").agg(F.count("*").alias("c")).filter("c = 1").select("dst")
    simple = rounds.put(proper.join(outs.hint("merge"), "src", "left_semi").join(ins.hint("merge"), "dst", "left_semi"))
    heads = rounds.put(simple.select(F.col("src").alias("node")).join(simple.select(F.col("dst").alias("node")).hint("merge"), "node", "left_anti"))
    first = heads.select(F.col("node").alias("up"), F.lit(True).alias("found")).hint("merge")
    back = simple.select(F.col("dst").alias("node"), F.col("src").alias("up")).join(first, "up", "left")
    back = back.select("node", "up", F.lit(1).cast("long").alias("rank"), F.coalesce("found", F.lit(False)).alias("done"))
    back = back.unionByName(heads.select("node", F.col("node").alias("up"), F.lit(0).cast("long").alias("rank"), F.lit(True).alias("done")))
    seen, before = F.struct(F.count("*").alias("all"), F.count_if("done").alias("done")), None
    back, n = rounds.counted(back, seen)
    while n["done"] != before and n["done"] < n["all"]:
        # both sides are as large as the chains: merged, as broadcasts would take them through the driver each round
        up = back.select(F.col("node").alias("up"), F.col("up").alias("top"), F.col("rank").alias("more"), F.col("done").alias("there")).hint("merge")
        before = n["done"]
        back, n = rounds.counted(back.join(up, "up").select("node", F.col("top").alias("up"), (F.col("rank") + F.col("more")).alias("rank"), F.col("there").alias("done")), seen)
    return back.filter("done").select("node", F.col("up").alias("head"), "rank")


def contract(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Chains as one node: ids joined by &, mean coverage; and the edges between what is left."""
    return contract_mapped(nodes, edges)[:2]


def contract_mapped(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """As contract, and (old, new) of every node that is part of a chain now."""
    found = Rounds(nodes.sparkSession).put(chains(edges))
    parts = found.join(nodes.hint("merge"), found["node"] == nodes["id"]).groupBy("head").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", F.col("node").cast("string").alias("n")))), lambda x: x["n"]), "&").alias("new"),
        F.avg("dp").alias("dp"), F.max_by("node", "rank").alias("tail"),
    )
    alone = nodes.join(found.select(F.col("node").alias("id")).hint("merge"), "id", "left_anti")
    out = parts.select(F.col("new").alias("id"), "dp").unionByName(alone.select(F.col("id").cast("string"), "dp"))
    tails = parts.select(F.col("tail").alias("src"), F.col("new").alias("s"))
    heads = parts.select(F.col("head").alias("dst"), F.col("new").alias("t"))
    inner = found.select("node", "head", "rank")
    left = edges.join(inner.select(F.col("node").alias("dst"), F.col("head").alias("h"), "rank").hint("merge"), "dst", "left")
    left = left.join(inner.select(F.col("node").alias("src"), F.col("head").alias("hs"), F.col("rank").alias("rs")).hint("merge"), "src", "left")
    left = left.filter(~F.coalesce((F.col("h") == F.col("hs")) & (F.col("rank") == F.col("rs") + 1), F.lit(False)))
    left = left.join(tails.hint("merge"), "src", "left").join(heads.hint("merge"), "dst", "left")
    mapped = found.join(parts.select("head", "new").hint("merge"), "head").select(F.col("node").alias("old"), "new")
    return out, left.select(F.coalesce("s", F.col("src").cast("string")).alias("src"), F.coalesce("t", F.col("dst").cast("string")).alias("dst")).distinct(), mapped


def reachable(edges: DataFrame, sources: DataFrame) -> DataFrame:
    """(source, id): nodes that a path of at least one edge leads to, by frontier joins until nothing is new."""
    rounds = Rounds(edges.sparkSession)
    seen = rounds.put(sources.select(F.col("id").alias("source")).join(edges, F.col("source") == F.col("src")).select("source", F.col("dst").alias("id")).distinct())
    front = seen
    while not front.isEmpty():
        step = front.join(edges, front["id"] == edges["src"]).select("source", F.col("dst").alias("id")).distinct()
        front = rounds.put(step.join(seen, ["source", "id"], "left_anti"))
        seen = rounds.put(seen.unionByName(front))
    return seen


def closure(edges: DataFrame) -> DataFrame:
    """(src, dst): every pair that a path of at least one edge joins. Paths double in length each round."""
    rounds = Rounds(edges.sparkSession)
    out, n = rounds.counted(edges.select("src", "dst").distinct(), F.count("*"))
    before = -1
    while n != before:
        far = out.join(out.select(F.col("src").alias("dst"), F.col("dst").alias("to")), "dst").select("src", F.col("to").alias("dst"))
        before = n
        out, n = rounds.counted(out.union(far).distinct(), F.count("*"))
    return out


def last_of(edges: DataFrame) -> DataFrame:
    """(old, new): where the edges of nodes with one way out lead in the end, by pointer doubling; nodes on or before a
    cycle have no end and no row. n rows and log2 of the longest way in joins."""
    rounds = Rounds(edges.sparkSession)
    now = rounds.put(edges.select(F.col("src").alias("old"), F.col("dst").alias("new")))
    seen, before = F.struct(F.count("*").alias("all"), F.count_if("done").alias("done")), None
    while True:
        on = now.select(F.col("old").alias("new"), F.col("new").alias("to")).hint("merge")
        now, n = rounds.counted(now.join(on, "new", "left").select("old", F.coalesce("to", "new").alias("new"), F.col("to").isNull().alias("done")), seen)
        if n["done"] in (before, n["all"]):
            return now.filter("done").select("old", "new")
        before, now = n["done"], now.select("old", "new")


def top_neighbours(nodes: DataFrame, edges: DataFrame, most: int = 2) -> DataFrame:
    """(src, dst, k): the best covered targets of each node, ties by id. Spark keeps `most` rows a node before it shuffles."""
    rank = F.row_number().over(Window.partitionBy("src").orderBy(F.desc("dp"), "dst"))
    rows = edges.select("src", "dst").join(nodes.select(F.col("id").alias("dst"), "dp"), "dst").withColumn("k", rank.cast("long"))
    return rows.filter(F.col("k") <= most).select("src", "dst", "k")


def mutual_nearest(nodes: DataFrame, edges: DataFrame, delta: float | None = None) -> DataFrame:
    """(src, dst, d): edges whose ends are each other's nearest in coverage among their targets and sources, ties by id.
    With delta only those are given for which no second end is within twice the distance, or delta."""
    s, t = nodes.select(F.col("id").alias("src"), F.col("dp").alias("s")), nodes.select(F.col("id").alias("dst"), F.col("dp").alias("t"))
    rows = edges.select("src", "dst").join(s, "src").join(t, "dst").withColumn("d", F.abs(F.col("s") - F.col("t")))
    from_, to = Window.partitionBy("src").orderBy("d", "dst"), Window.partitionBy("dst").orderBy("d", "src")
    rows = rows.withColumn("ks", F.row_number().over(from_)).withColumn("ns", F.lead("d").over(from_))
    rows = rows.withColumn("kt", F.row_number().over(to)).withColumn("nt", F.lead("d").over(to)).filter("ks = 1 and kt = 1")
    if delta is not None:
        margin = F.greatest(F.col("d") * 2, F.lit(float(delta)))
        rows = rows.filter((F.coalesce("ns", F.lit(float("inf"))) > margin) & (F.coalesce("nt", F.lit(float("inf"))) > margin))
    return rows.select("src", "dst", "d")


def first_max(rows: DataFrame, by: str, order: str, group: str | None = None) -> DataFrame:
    """The rows with the largest `by`, of each group if there is one; of equal ones that with the smallest `order`."""
    best = F.min(F.struct((-F.col(by)).alias("_by"), F.col(order).alias("_order"), F.struct(*[F.col(c) for c in rows.columns]).alias("_row")))
    return (rows.groupBy(group) if group else rows.groupBy()).agg(best.alias("_best")).select("_best._row.*")


def best_of_sequence(nodes: DataFrame, key: Column | None = None) -> DataFrame:
    """Of nodes (id, seq, dp) with equal sequences the best covered one, ties by id. Sequences meet as their SHA-256, and a
    partial minimum runs before the shuffle, so a large group of copies is one row a task."""
    key = F.sha2(F.col("seq").cast("binary"), 256) if key is None else key
    best = F.min(F.struct((-F.col("dp")).alias("d"), "id", "dp")).alias("x")
    return nodes.select("id", "dp", key.alias("k")).groupBy("k").agg(best).select("x.id", "x.dp")


def neighbour_sets(edges: DataFrame) -> DataFrame:
    """(id, n_both, n_any, n_in_only) of nodes with sources and targets: sizes of the intersection, union and difference of
    the two sets, by counting each neighbour once, so a node of very many neighbours is no single row. Two neighbours are
    one row, whichever way they lead, until they are counted at both."""
    there, back = F.col("src") <= F.col("dst"), F.col("src") >= F.col("dst")
    two = edges.groupBy(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).agg(F.max(there.cast("int")).alias("ab"), F.max(back.cast("int")).alias("ba"))
    at = lambda id, i, o: F.struct(F.col(id).alias("id"), F.col(i).alias("i"), F.col(o).alias("o"))
    first, second = at("a", "ba", "ab"), at("b", "ab", "ba")
    one = two.select(F.explode(F.when(F.col("a") == F.col("b"), F.array(first)).otherwise(F.array(first, second))).alias("x")).select("x.*")
    rows = one.groupBy("id").agg(F.sum(F.col("i") * F.col("o")).alias("n_both"), F.count("*").alias("n_any"), F.sum(F.col("i") * (1 - F.col("o"))).alias("n_in_only"), F.max("i").alias("i"), F.max("o").alias("o"))
    return rows.filter("i = 1 and o = 1").select("id", "n_both", "n_any", "n_in_only")


def branch_pairs(edges: DataFrame, links: DataFrame, at: DataFrame | None = None) -> DataFrame:
    """(u, branch, w, pe): every source and target of a node, with their links (a, b, cnt), 0 without any. With `at` (id)
    only around those nodes, which are looked up before pairs are formed."""
    into, out = edges.select(F.col("src").alias("u"), F.col("dst").alias("branch")), edges.select(F.col("src").alias("branch"), F.col("dst").alias("w"))
    if at is not None:
        into = into.join(at.select(F.col("id").alias("branch")), "branch", "left_semi")
    rows = into.join(out, "branch")
    on = (F.col("a") == F.least("u", "w")) & (F.col("b") == F.greatest("u", "w"))
    return rows.join(links.select("a", "b", "cnt"), on, "left").select("u", "branch", "w", F.coalesce("cnt", F.lit(0)).cast("long").alias("pe"))


def branch_links(edges: DataFrame, links: DataFrame, support: DataFrame | None = None, at: DataFrame | None = None) -> DataFrame:
    """(u, branch, w, pe): the pairs around a node that reads link, that are one node, or that paths go through (support: u,
    branch, w)."""
    rows = branch_pairs(edges, links, at)
    sure = (F.col("pe") > 0) | (F.col("u") == F.col("w"))
    if support is not None:
        rows = rows.join(support.select("u", "branch", "w").distinct().withColumn("_s", F.lit(True)), ["u", "branch", "w"], "left")
        sure = sure | F.coalesce("_s", F.lit(False))
    return rows.filter(sure).select("u", "branch", "w", "pe")


def statistics(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row (nodes, edges, low, median, high, sources, sinks) of a graph."""
    deg = degrees(nodes, edges)
    ends = deg.agg(F.count_if(F.col("n_in") == 0).alias("sources"), F.count_if(F.col("n_out") == 0).alias("sinks"), F.sum("n_out").cast("long").alias("edges"))
    cov = nodes.agg(F.count("*").alias("nodes"), F.min("dp").alias("low"), F.lit(median(nodes, "dp")).cast("double").alias("median"), F.max("dp").alias("high"))
    return cov.join(ends).select("nodes", "edges", "low", "median", "high", "sources", "sinks")  # two tables of one row


def independent(ids: DataFrame, edges: DataFrame) -> DataFrame:
    """(id): what is left of ids if they are admitted in order and no two are adjacent. Each round admits every id that is
    smaller than all its undecided neighbours."""
    rounds = Rounds(ids.sparkSession)
    near = between(edges, ids).select("src", "dst")
    near = rounds.put(near.union(near.select("dst", "src")).filter("src <> dst").distinct())
    open_, chosen = rounds.put(ids.select("id").distinct()), None
    while not open_.isEmpty():
        least = near.join(open_.withColumnRenamed("id", "dst"), "dst", "left_semi").groupBy(F.col("src").alias("id")).agg(F.min("dst").alias("m"))
        now = rounds.put(open_.join(least, "id", "left").filter(F.col("m").isNull() | (F.col("id") < F.col("m"))).select("id"))
        chosen = now if chosen is None else chosen.union(now)
        out = near.join(now.withColumnRenamed("id", "src"), "src", "left_semi").select(F.col("dst").alias("id"))
        open_ = rounds.put(open_.join(now.union(out), "id", "left_anti"))
    return ids.select("id").limit(0) if chosen is None else chosen


def _replace(nodes: DataFrame, edges: DataFrame, copies: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """copies (old, id, dp, u, w; u or w null for a fork's shared side) in place of their old nodes."""
    old = copies.select(F.col("old").alias("id")).distinct()
    left = nodes.select("id", "dp").join(old, "id", "left_anti").unionByName(copies.select("id", "dp"))
    rest = edges.select("src", "dst").join(old.withColumnRenamed("id", "src"), "src", "left_anti").join(old.withColumnRenamed("id", "dst"), "dst", "left_anti").select("src", "dst")
    ins = copies.filter("u is not null").select(F.col("u").alias("src"), F.col("id").alias("dst"))
    outs = copies.filter("w is not null").select(F.col("id").alias("src"), F.col("w").alias("dst"))
    return left, rest.union(ins).union(outs), copies.select("old", F.col("id").alias("new"))


def pair_ends(rows: list[tuple]) -> list[tuple]:
    """The pairs (u, w) of one branch that coverage suggests. rows: (u, w, flow in, flow out, links, sure).

    Sure pairs stay. Pairs of free ends follow by links, most first. Then each free source takes the target nearest in
    flow, if that is free, the source is the target's nearest too, and either's second nearest is over twice as far.
    """
    flow_in, flow_out = {r[0]: r[2] for r in rows}, {r[1]: r[3] for r in rows}
    kept = [(u, w) for u, w, *_, sure in rows if sure]
    for u, w, *_ in sorted((r for r in rows if not r[5] and r[4] > 0), key=lambda r: (-r[4], r[0], r[1])):
        if all(u != x and w != y for x, y in kept):
            kept.append((u, w))
    for u in sorted(flow_in):
        near = sorted((abs(flow_in[u] - f), w) for w, f in flow_out.items())
        back = sorted((abs(flow_out[near[0][1]] - f), x) for x, f in flow_in.items())
        best, w = near[0]
        alone = all(len(x) < 2 or x[1][0] > 2 * best for x in (near, back))
        if back[0][1] == u and alone and all(u != x and w != y for x, y in kept):
            kept.append((u, w))
    return kept


def split_balanced(nodes: DataFrame, edges: DataFrame, links: DataFrame, delta: float, support: DataFrame | None = None, by_coverage: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """One pass of splitting branches with as many sources as targets: nodes, edges and (old, new).

    Pairs (u, w) around a branch count if a path goes through them (support: u, branch, w), if they are one node, or if
    they have a link (a, b, cnt) and no neighbour of the branch is made of copies only; by_coverage, pair_ends chooses
    instead of the link rule. A branch is split if that uses each end exactly once and no pair's flows differ by more than
    4 delta; its copies carry the mean flow. Branches are admitted in order of id, none next to another.
    """
    ship(nodes.sparkSession)
    balanced = Rounds(nodes.sparkSession).put(branches(edges).filter("n_in = n_out").select(F.col("id").alias("b"), "n_in"))
    flow = edge_flow(nodes, edges)
    into, out = (flow.join(balanced.select(F.col("b").alias(c)), c, "left_semi") for c in ("dst", "src"))
    rows = into.select(F.col("src").alias("u"), F.col("dst").alias("b"), F.col("flow").alias("fi")).join(out.select(F.col("src").alias("b"), F.col("dst").alias("w"), F.col("flow").alias("fo")), "b")
    rows = rows.join(balanced, "b")
    pe = links.select(F.least("a", "b").alias("x"), F.greatest("a", "b").alias("y"), "cnt").groupBy("x", "y").agg(F.sum("cnt").alias("cnt"))
    rows = rows.join(pe, (F.least("u", "w") == F.col("x")) & (F.greatest("u", "w") == F.col("y")), "left").withColumn("cnt", F.coalesce("cnt", F.lit(0)))
    sure = F.col("u") == F.col("w")
    if support is not None:
        rows = rows.join(support.select("u", F.col("branch").alias("b"), "w").distinct().withColumn("s", F.lit(True)), ["u", "b", "w"], "left")
        sure = sure | F.coalesce("s", F.lit(False))
    rows = rows.select("b", "u", "w", "fi", "fo", "n_in", "cnt", sure.alias("sure"))
    if by_coverage:

        def choose(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            """Sorted by branch: a branch has as many rows as sources times targets, few in sequence graphs."""
            held: list[tuple] = []

            def done() -> list[tuple]:
                kept = set(pair_ends([(u, w, fi, fo, cnt, sure) for _, u, w, fi, fo, _, cnt, sure in held]))
                return [x for x in held if (x[1], x[2]) in kept]

            for f in frames:
                out = []
                for x in f.itertuples(index=False, name=None):
                    if held and held[0][0] != x[0]:
                        out += done()
                        held = []
                    held.append(x)
                yield pd.DataFrame(out, columns=f.columns)
            if held:
                yield pd.DataFrame(done(), columns=["b", "u", "w", "fi", "fo", "n_in", "cnt", "sure"])

        rows = rows.repartition("b").sortWithinPartitions("b").mapInPandas(choose, rows.schema)
    else:
        copy = lambda c: F.forall(F.split(c, "&"), lambda x: F.contains(x, F.lit("*")))
        copied = F.max((copy("u") | copy("w")).cast("int")).over(Window.partitionBy("b"))
        rows = rows.withColumn("copied", copied).filter(F.col("sure") | ((F.col("cnt") > 0) & (F.col("copied") == 0))).drop("copied")
    rows = Rounds(nodes.sparkSession).put(rows.select("b", "u", "w", "fi", "fo", "n_in"))
    fit = rows.groupBy("b", "n_in").agg(F.count("*").alias("n"), F.count_distinct("u").alias("nu"), F.count_distinct("w").alias("nw"), F.max(F.abs(F.col("fi") - F.col("fo"))).alias("worst"))
    fit = fit.filter((F.col("n") == F.col("n_in")) & (F.col("nu") == F.col("n")) & (F.col("nw") == F.col("n")) & (F.col("worst") <= 4 * delta)).select(F.col("b").alias("id"))
    chosen = independent(fit, edges).withColumnRenamed("id", "b")
    nth = F.row_number().over(Window.partitionBy("b").orderBy("u", "w")) - 1
    copies = rows.join(chosen, "b").select(F.col("b").alias("old"), F.concat("b", F.lit("*"), nth.cast("string")).alias("id"), ((F.col("fi") + F.col("fo")) / 2).alias("dp"), "u", "w")
    return _replace(nodes, edges, Rounds(nodes.sparkSession).put(copies))


def split_forks(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """One pass of forking the neighbours of branches: a source of a branch with several ways in and one out gets a copy
    for each way in, a target with one way in and several out a copy for each way out, with that edge's flow. Of adjacent
    candidates the smaller id goes first."""
    rounds = Rounds(nodes.sparkSession)
    deg, near = degrees(nodes, edges), branches(edges).select(F.col("id").alias("b"))
    into = edges.join(near, edges["dst"] == near["b"]).select(F.col("src").alias("id")).join(deg.filter("n_in > 1 and n_out = 1"), "id").select("id", F.lit(True).alias("into"))
    out = edges.join(near, edges["src"] == near["b"]).select(F.col("dst").alias("id")).join(deg.filter("n_in = 1 and n_out > 1"), "id").select("id", F.lit(False).alias("into"))
    found = rounds.put(into.union(out).distinct())
    found = rounds.put(found.join(independent(found.select("id"), edges), "id"))
    flow = edge_flow(nodes, edges)
    a = flow.select("src", F.col("dst").alias("id"), F.col("flow").alias("f")).join(found.filter("into"), "id").join(edges.select(F.col("src").alias("id"), F.col("dst").alias("w")), "id").select("id", F.col("src").alias("u"), "w", "f")
    b = flow.select(F.col("src").alias("id"), "dst", F.col("flow").alias("f")).join(found.filter("not into"), "id").join(edges.select(F.col("src").alias("u"), F.col("dst").alias("id")), "id").select("id", "u", F.col("dst").alias("w"), "f")
    nth = F.row_number().over(Window.partitionBy("id").orderBy("u", "w")) - 1
    suffix = F.when(nth < 26, F.char(nth + 65)).otherwise(nth.cast("string"))
    copies = a.union(b).select(F.col("id").alias("old"), F.concat("id", F.lit("*"), suffix).alias("id"), F.col("f").alias("dp"), "u", "w")
    left, rest, mapped = _replace(nodes, edges, rounds.put(copies))
    return left, rest.distinct(), mapped


def raise_branches(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes whose branches carry at least the flow into and out of them; a simple branch (its sources lead only to it, its
    targets come only from it) the summed depths of either side. All are raised from the same flows at once."""
    flow, deg = edge_flow(nodes, edges), degrees(nodes, edges)
    end = lambda at, n: nodes.select("id", "dp").join(deg.select("id", n), "id").select(F.col("id").alias(at), F.col("dp").alias("d"), F.col(n).alias("n"))
    side = lambda at, of, n, x: flow.join(end(of, n), of).groupBy(F.col(at).alias("id")).agg(F.sum("flow").alias(x), F.sum("d").alias(f"{x}_dp"), (F.max("n") == 1).alias(f"{x}_only"))
    rows = nodes.join(branches(edges).select("id", F.lit(True).alias("branch")), "id", "left")
    rows = rows.join(side("dst", "src", "n_out", "i"), "id", "left").join(side("src", "dst", "n_in", "o"), "id", "left")
    raised = F.when(F.col("i_only") & F.col("o_only"), F.greatest("dp", "i_dp", "o_dp")).otherwise(F.greatest("dp", "i", "o"))
    return rows.select("id", F.when(F.col("branch"), raised).otherwise(F.col("dp")).alias("dp"))


def disentangle(
    nodes: DataFrame, edges: DataFrame, links: DataFrame, delta: float, contigs: DataFrame | None = None, most: int | None = None
) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame | None]:
    """disentangled() without the table of parts; the links are those between nodes now, what was copied having none."""
    nodes, edges, parts, contigs = disentangled(nodes, edges, links, delta, contigs, most)
    return nodes, edges, provenance.links_of(links, parts, copies=False), contigs


def disentangled(
    nodes: DataFrame, edges: DataFrame, links: DataFrame, delta: float, contigs: DataFrame | None = None, most: int | None = None
) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame | None]:
    """Nodes, edges, parts and contigs (name, ord, path, cov) after branches are split and chains contracted until a pass
    splits nothing: first by links and contigs, then by coverage. Forks are tried once after each dry pass. On a graph
    that never settles, as forks in cycles may not, more passes than `most` (without it, than nodes) are an error.

    parts (id, part, copied) says which of the given nodes a node is made of, see provenance; links (a, b, cnt) are never
    rewritten. Contraction joins ids by & and sums the links of its parts; copies start without links here, as reads can't
    tell which one they belong to. Contigs follow: a node at an end that was split gives a contig for each copy.
    """
    rounds = Rounds(nodes.sparkSession)
    nodes, edges = rounds.put(nodes.select("id", "dp")), rounds.put(edges.select("src", "dst"))
    links = rounds.put(links.select("a", "b", "cnt"))
    parts = rounds.put(provenance.start(nodes))
    if contigs is not None:
        contigs = rounds.put(contigs.select("name", "ord", "path", "cov"))
    most = max(100, nodes.count()) if most is None else most
    passes = 0
    for by_coverage in (False, True):
        spent = False
        while True:
            passes += 1
            if passes > most:
                raise RuntimeError(f"not disentangled after {most} passes")
            support = None if contigs is None else paths.triples(contigs)
            known = rounds.put(provenance.links_of(links, parts, copies=False))
            new, left, mapped = split_balanced(nodes, edges, known, delta, support, by_coverage)
            dry = mapped.isEmpty()
            if dry and spent:
                break
            if dry:
                new, left, mapped = split_forks(nodes, edges)
            spent = dry
            new, left, mapped = rounds.put(new), rounds.put(left), rounds.put(mapped)
            out, rest, whole = contract_mapped(new, left)
            nodes, edges, whole = rounds.put(out), rounds.put(rest), rounds.put(whole)
            if contigs is not None:
                contigs = paths.remap(contigs, mapped, left, copies=not dry) if not mapped.isEmpty() else contigs
                contigs = rounds.put(paths.joined(contigs, whole))
                contigs = rounds.put(paths.deduplicated(contigs))
            parts = rounds.put(provenance.follow(provenance.follow(parts, mapped, copies=True), whole, copies=False))
    return nodes, edges, parts, contigs


def global_ends(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(src, dst, flow): edges from one global source `src` to nodes that nothing leads to, and from nodes that lead
    nowhere to one global sink `sink`; the flow is the node's coverage."""
    first = nodes.join(edges.select(F.col("dst").alias("id")), "id", "left_anti").select(F.lit("src").alias("src"), F.col("id").alias("dst"), F.col("dp").alias("flow"))
    last = nodes.join(edges.select(F.col("src").alias("id")), "id", "left_anti").select(F.col("id").alias("src"), F.lit("sink").alias("dst"), F.col("dp").alias("flow"))
    return first.unionByName(last)


def shortened(edges: DataFrame, found: DataFrame) -> DataFrame:
    """Edges (src, dst) once each chain (found, see chains) is one node, named by its head. A chain is entered at its head and
    left at its tail only; if its tail leads to its head, the one node leads to itself."""
    now = lambda c, *more: found.select(F.col("node").alias(c), F.col("head").alias(f"{c}_now"), *more).hint("merge")
    left = edges.join(now("src"), "src", "left").join(now("dst", "rank"), "dst", "left")
    inner = F.coalesce(F.col("src_now") == F.col("dst_now"), F.lit(False)) & (F.col("rank") > 0)
    return left.filter(~inner).select(F.coalesce("src_now", "src").alias("src"), F.coalesce("dst_now", "dst").alias("dst")).distinct()


def stands_for(inside: DataFrame | None, found: DataFrame) -> DataFrame:
    """(id, node): which node of the shortened graph stands for each that is part of a chain, now or before (inside)."""
    part = found.select(F.col("node").alias("id"), F.col("head").alias("node"))
    if inside is None:
        return part
    moved = inside.join(part.select(F.col("id").alias("node"), F.col("node").alias("now")).hint("merge"), "node", "left").select("id", F.coalesce("now", "node").alias("node"))
    return moved.unionByName(part.join(inside.select("id").hint("merge"), "id", "left_anti"))


def trimmed(edges: DataFrame) -> DataFrame:
    """Edges out of nodes that something leads to, into nodes that lead on."""
    left = edges.join(edges.select(F.col("dst").alias("src")).hint("merge"), "src", "left_semi")
    return left.join(edges.select(F.col("src").alias("dst")).hint("merge"), "dst", "left_semi").select("src", "dst")


def cyclic_core(edges: DataFrame) -> DataFrame:
    """(src, dst): edges left when edges out of nodes that nothing leads to are taken away again and again, and likewise
    from the other end; empty if and only if the graph has no cycle.

    Chains become one node each before every round, so a chain of any length goes in one, and rounds grow with the branches
    on the longest way to or from a cycle. A chain's own edges stay if its node has an edge left on both sides.
    """
    rounds = Rounds(edges.sparkSession)
    whole, n = rounds.counted(edges.select("src", "dst").distinct(), F.count("*"))
    left, inside, before = whole, None, -1
    while n and n != before:
        found = rounds.put(chains(left))
        before = n
        inside = rounds.put(stands_for(inside, found))
        left, n = rounds.counted(trimmed(rounds.put(shortened(left, found))), F.count("*"))
    if inside is None:
        return whole
    now = lambda c: inside.select(F.col("id").alias(c), F.col("node").alias(f"{c}_now")).hint("merge")
    rows = whole.join(now("src"), "src", "left").join(now("dst"), "dst", "left").select("src", "dst", F.coalesce("src_now", "src").alias("s"), F.coalesce("dst_now", "dst").alias("t"))
    keep = left.union(left.select("src", "src")).distinct().toDF("s", "t").hint("merge")
    return rows.join(keep, ["s", "t"], "left_semi").select("src", "dst")


def is_acyclic(edges: DataFrame) -> bool:
    return cyclic_core(edges).isEmpty()
