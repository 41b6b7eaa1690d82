"""Paths (contigs) over a graph: path table (name, ord, path array)."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skein.operators.rounds import Rounds
from skein.session import ship


def steps(paths: DataFrame) -> DataFrame:
    """(name, pos, src, dst): consecutive pairs."""
    rows = paths.select("name", "path", F.size("path").alias("_n")).filter("_n > 1")
    return rows.select("name", F.posexplode(F.arrays_zip(F.slice("path", 1, F.col("_n") - 1).alias("a"), F.slice("path", 2, F.col("_n") - 1).alias("b"))).alias("pos", "x")).select("name", "pos", F.col("x.a").alias("src"), F.col("x.b").alias("dst"))


def path_length(paths: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(name, length): lengths of nodes (id, len) less the overlaps of the steps that are edges (src, dst, overlap)."""
    whole = paths.select("name", F.explode("path").alias("id")).join(nodes.select("id", "len"), "id").groupBy("name").agg(F.sum("len").alias("whole"))
    cut = steps(paths).join(edges.select("src", "dst", "overlap"), ["src", "dst"]).groupBy("name").agg(F.sum("overlap").alias("cut"))
    return whole.join(cut, "name", "left").select("name", (F.col("whole") - F.coalesce("cut", F.lit(0))).alias("length"))


def path_sequence(paths: DataFrame, nodes: DataFrame, edges: DataFrame, strict: bool = False) -> DataFrame:
    """(name, seq): sequences one after the other, each cut by its overlap with the next. A missing edge has no overlap;
    with strict such a path is left out."""
    rows = paths.select("name", F.posexplode("path").alias("pos", "id"))
    after = F.lead("id").over(Window.partitionBy("name").orderBy("pos"))
    rows = rows.withColumn("dst", after).withColumn("src", F.col("id")).join(edges.select("src", "dst", "overlap"), ["src", "dst"], "left").join(nodes.select("id", "seq"), "id")
    part = F.when(F.col("overlap").isNull(), F.col("seq")).otherwise(F.expr("substring(seq, 1, length(seq) - overlap)"))
    rows = rows.groupBy("name").agg(F.array_sort(F.collect_list(F.struct("pos", part.alias("s")))).alias("x"), F.bool_or(F.col("dst").isNotNull() & F.col("overlap").isNull()).alias("gap"))
    return (rows.filter("not gap") if strict else rows).select("name", F.array_join(F.transform("x", lambda p: p["s"]), "").alias("seq"))


def path_coverage(paths: DataFrame, flows: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """(name, cov): the least flow (src, dst, flow) along the path; with nodes (id, dp), a path of one node has its dp.
    Without nodes such a path has no row."""
    cov = steps(paths).join(flows, ["src", "dst"]).groupBy("name").agg(F.min("flow").alias("cov"))
    if nodes is None:
        return cov
    single = paths.filter(F.size("path") == 1).select("name", F.col("path")[0].alias("id"))
    return cov.unionByName(single.join(nodes.select("id", F.col("dp").alias("cov")), "id").select("name", "cov"))


def repeats(paths: DataFrame) -> DataFrame:
    """(name, id, times) of every node of a path."""
    return paths.select("name", F.explode("path").alias("id")).groupBy("name", "id").agg(F.count("*").alias("times"))


def without_dead(paths: DataFrame, live: DataFrame) -> DataFrame:
    """Paths all of whose nodes are in live (id)."""
    dead = paths.select("name", F.explode("path").alias("id")).join(live.select("id"), "id", "left_anti").select("name").distinct()
    return paths.join(dead, "name", "left_anti")


def contained(paths: DataFrame) -> DataFrame:
    """(name, why) of paths to drop: `same` as an earlier one's node set, or `inside` a larger one.

    Equal sets are one first. A set of one node is inside another if any other has the node. Larger ones meet only those
    larger sets that have their rarest node, by an equi-join whose condition also compares sizes and bits of all nodes'
    hashes; what passes is compared node by node. So a path of n nodes is n rows, and no common node's pairs are formed.
    """
    rounds = Rounds(paths.sparkSession)
    w = Window.partitionBy("s").orderBy("ord", "name")
    sets = paths.select("name", "ord", F.array_sort(F.array_distinct("path")).alias("s"))
    sets = rounds.put(sets.select("name", "s", F.first("name").over(w).alias("first"), F.row_number().over(w).alias("k")))
    same = sets.filter("s is not null and name <> first").select("name", F.lit("same").alias("why"))
    kinds = sets.filter("k = 1").select("name", "s", F.size("s").alias("n"))
    nodes = kinds.select("name", F.explode("s").alias("id"))
    freq = nodes.groupBy("id").agg(F.count("*").alias("f"))
    marks = nodes.join(freq, "id").groupBy("name").agg(F.min(F.struct("f", "id")).alias("r"), F.count("*").alias("n"))
    marks = rounds.put(marks.select("name", "n", "r.f", "r.id"))
    at = lambda v: F.when(F.pmod(F.shiftright(F.xxhash64(v), 6), F.lit(4)) == k, F.call_function("shiftleft", F.lit(1).cast("long"), F.xxhash64(v).bitwiseAND(63).cast("int"))).otherwise(F.lit(0).cast("long"))
    bits = []
    for k in range(4):
        bits.append(F.aggregate("s", F.lit(0).cast("long"), lambda a, v: a.bitwiseOR(at(v))).alias(f"m{k}"))
    x = marks.filter("n > 1").select("name", "id").join(kinds, "name").select("name", "id", "s", "n", *bits).alias("x")
    y = kinds.filter("n > 2").select("name", "s", "n", *bits).select("name", "n", "m0", "m1", "m2", "m3", F.explode("s").alias("id")).alias("y")
    fits = F.col("x.n") < F.col("y.n")
    for k in range(4):
        fits = fits & (F.col(f"x.m{k}").bitwiseAND(F.bitwise_not(F.col(f"y.m{k}"))) == 0)
    met = x.join(y, (F.col("x.id") == F.col("y.id")) & fits).select(F.col("x.name").alias("name"), "s", F.col("y.name").alias("other"))
    met = met.join(kinds.select(F.col("name").alias("other"), F.col("s").alias("big")), "other").filter(F.size(F.array_except("s", "big")) == 0)
    inside = marks.filter("n = 1 and f > 1").select("name").unionByName(met.select("name").distinct())
    return same.unionByName(inside.select("name", F.lit("inside").alias("why")))


def deduplicated(paths: DataFrame) -> DataFrame:
    return paths.join(contained(paths).select("name").hint("merge"), "name", "left_anti")


def expand_repeats(strains: DataFrame, counts: DataFrame) -> DataFrame:
    """(name, path): every node of a strain as often as the most that a count table (name, id, times) gives, once at least."""
    rows = strains.select("name", F.posexplode("path").alias("pos", "id")).join(counts, ["name", "id"], "left")
    rows = rows.groupBy("name").agg(F.array_sort(F.collect_list(F.struct("pos", "id", F.coalesce("times", F.lit(1)).cast("int").alias("t")))).alias("x"))
    return rows.select("name", F.flatten(F.transform("x", lambda p: F.array_repeat(p["id"], p["t"]))).alias("path"))


def valid(paths: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(name, valid): whether all of a path's ids are nodes (id) and all its steps edges; an empty path isn't valid."""
    ids = paths.select("name", F.explode("path").alias("id")).join(nodes.select("id"), "id", "left_anti").select("name")
    gaps = steps(paths).join(edges.select("src", "dst"), ["src", "dst"], "left_anti").select("name")
    bad = ids.union(gaps).distinct().withColumn("bad", F.lit(True))
    return paths.select("name", (F.size("path") > 0).alias("any")).join(bad, "name", "left").select("name", (F.col("any") & F.col("bad").isNull()).alias("valid"))


def by_node(paths: DataFrame) -> DataFrame:
    """(id, name): which paths go through a node, a row each, so that a node on very many paths is no single row."""
    return paths.select(F.explode(F.array_distinct("path")).alias("id"), "name")


def by_edge(paths: DataFrame) -> DataFrame:
    """(src, dst, name): which paths take a step."""
    return steps(paths).select("src", "dst", "name").distinct()


def support(paths: DataFrame) -> DataFrame:
    """(u, branch, w, n): how many paths go through a node from one neighbour to another."""
    rows = paths.select("name", "path", F.size("path").alias("_n")).filter("_n > 2")
    part = lambda k: F.slice("path", k, F.col("_n") - 2)
    rows = rows.select("name", F.explode(F.arrays_zip(part(1).alias("u"), part(2).alias("branch"), part(3).alias("w"))).alias("x")).select("name", "x.*").distinct()
    return rows.groupBy("u", "branch", "w").agg(F.count("*").alias("n"))


def above(paths: DataFrame, min_cov: float) -> DataFrame:
    """Paths whose coverage (cov) is above the limit."""
    return paths.filter(F.col("cov") > min_cov)


def expand_parts(paths: DataFrame, parts: DataFrame) -> DataFrame:
    """(name, path) in which ids that stand for a path themselves (parts: id, path; those may hold such ids again, and a copy
    x*A stands for what x does) are replaced by it, until none is left."""
    rounds = Rounds(paths.sparkSession)
    parts, rows = rounds.put(parts.select("id", "path")), rounds.put(paths.select("name", "path"))
    for _ in range(64):  # ids made of ids made of ids; a part that holds itself is an error
        at = rows.select("name", F.posexplode("path").alias("pos", "v")).withColumn("id", F.substring_index("v", "*", 1))
        at = at.join(parts.withColumnRenamed("path", "whole"), "id", "left")
        if at.filter("whole is not null").isEmpty():
            return rows
        at = at.groupBy("name").agg(F.array_sort(F.collect_list(F.struct("pos", F.coalesce("whole", F.array("v")).alias("x")))).alias("xs"))
        rows = rounds.put(at.select("name", F.flatten(F.transform("xs", lambda p: p["x"])).alias("path")))
    raise ValueError("a part stands for itself")


def triples(paths: DataFrame) -> DataFrame:
    """(u, branch, w): what lies before and after each inner node of a path."""
    rows = paths.select("path", F.size("path").alias("_n")).filter("_n > 2")
    part = lambda k: F.slice("path", k, F.col("_n") - 2)
    rows = rows.select(F.explode(F.arrays_zip(part(1).alias("u"), part(2).alias("branch"), part(3).alias("w"))).alias("x"))
    return rows.select("x.u", "x.branch", "x.w").distinct()


def viable(ways: list[set], steps: list[set]) -> list[set] | None:
    """What of each position's ways lies on a whole path along steps; None if there is no whole path."""
    ok = [set(ways[0])]
    for pairs in steps:
        ok.append({t for s, t in pairs if s in ok[-1]})
    for i in range(len(steps) - 1, -1, -1):
        ok[i] &= {s for s, t in steps[i] if t in ok[i + 1]}
    return ok if all(ok) else None


def remap(paths: DataFrame, mapped: DataFrame, edges: DataFrame, copies: bool = False) -> DataFrame:
    """paths (name, ord, path, cov) after nodes were replaced (old, new; several new ones are alternatives).

    A path with one way along edges takes it; with several it keeps the nodes common to all, and goes if there are none;
    without any it stays as it is. With copies, if only its ends are open, there is a path for each way, named name$i.
    Ways are never enumerated: a pass forward and one back over the alternatives finds what lies on a whole path.
    """
    ship(paths.sparkSession)
    alts = paths.select("name", F.posexplode("path").alias("pos", "old")).join(mapped.select("old", "new"), "old", "left").select("name", "pos", F.coalesce("new", "old").alias("alt"))
    step = alts.withColumnRenamed("alt", "src").join(alts.select("name", (F.col("pos") - 1).alias("pos"), F.col("alt").alias("dst")), ["name", "pos"])
    step = step.join(edges.select("src", "dst"), ["src", "dst"], "left_semi").groupBy("name").agg(F.collect_list(F.struct("pos", "src", "dst")).alias("steps"))
    rows = alts.groupBy("name").agg(F.collect_list(F.struct("pos", "alt")).alias("alts")).join(step, "name", "left").join(paths.select("name", "ord", "path", "cov"), "name")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for name, alts, steps, ord_, path, cov in zip(f.name, f.alts, f.steps, f.ord, f.path, f["cov"]):
                path = list(path)
                ways, pairs = [set() for _ in path], [set() for _ in path[1:]]
                for a in alts:
                    ways[a["pos"]].add(a["alt"])
                for s in steps if steps is not None else ():
                    pairs[s["pos"]].add((s["src"], s["dst"]))
                ok = viable(ways, pairs)
                if ok is None:
                    out.append((name, ord_, path, cov))
                elif copies and all(len(x) == 1 for x in ok[1:-1]) and sum(map(len, ok)) > len(ok):
                    middle, lasts = [min(x) for x in ok[1:-1]], sorted(ok[-1]) if len(ok) > 1 else [None]
                    whole = [[a, *middle, *([z] if z else [])] for a in sorted(ok[0]) for z in lasts]
                    whole = [w for w in whole if len(w) != 2 or tuple(w) in pairs[0]]
                    out += [(f"{name}${i}", ord_, w, cov) for i, w in enumerate(whole)]
                else:
                    sure = [min(x) for x in ok if len(x) == 1]
                    out += [(name, ord_, sure, cov)] if sure else []
            yield pd.DataFrame(out, columns=["name", "ord", "path", "cov"])

    return rows.select("name", "alts", "steps", "ord", "path", "cov").mapInPandas(run, "name string, ord long, path array<string>, cov double")


def joined(paths: DataFrame, whole: DataFrame) -> DataFrame:
    """paths (name, ord, path, cov) in which nodes that became part of another (old, new) are that node, once."""
    rows = paths.select("name", F.posexplode("path").alias("pos", "old")).join(whole.select("old", "new"), "old", "left")
    rows = rows.groupBy("name").agg(F.array_sort(F.collect_list(F.struct("pos", F.coalesce("new", "old").alias("id")))).alias("x"))
    rows = rows.select("name", F.array_distinct(F.transform("x", lambda p: p["id"])).alias("path"))
    return paths.drop("path").join(rows, "name").select("name", "ord", "path", "cov")


def repeat_votes(strains: DataFrame, contigs: DataFrame) -> DataFrame:
    """(name, id, times): the most repeats of a node in any contig (name, path, repeats) that lies wholly in the strain."""
    parts = contigs.select(F.col("name").alias("contig"), F.explode("path").alias("id"), F.size("path").alias("n"))
    inside = strains.select("name", F.explode("path").alias("id")).distinct().join(parts, "id").groupBy("name", "contig", "n").agg(F.count("*").alias("c")).filter("c = n")
    votes = contigs.select(F.col("name").alias("contig"), F.explode("repeats").alias("id", "times"))
    return inside.select("name", "contig").join(votes, "contig").groupBy("name", "id").agg(F.max("times").cast("long").alias("times"))
