"""Paths whose ends overlap, joined where only one other path fits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.operators.graph import chains
from skein.operators.rounds import Rounds


def overlaps(paths: DataFrame, least: int = 1) -> DataFrame:
    """(a, b, n): the last n nodes of path a are the first n of b, n >= least and less than either has, and nothing else
    fits either end; of several such n the largest. Paths: name, path.

    Ends of every length meet as (length, hash). A group of equal ends is counted and never paired: it gives a pair only if
    it is one last end and one first end; if it has several of one kind, those of the other fit more than one path and are
    left out. A path whose two ends are equal fits itself, so what else it fits is left out, too.
    """
    rounds = Rounds(paths.sparkSession)
    rows = paths.select("name", "path", F.size("path").alias("k")).filter(F.col("k") > least).select("*", F.explode(F.sequence(F.lit(least), F.col("k") - 1)).alias("n"))
    ends = rows.select("name", "n", F.explode(F.array(F.struct(F.lit(True).alias("last"), F.slice("path", F.col("k") - F.col("n") + 1, F.col("n")).alias("end")), F.struct(F.lit(False).alias("last"), F.slice("path", 1, F.col("n")).alias("end")))).alias("x"))
    # 128 bits: two hashes of different first values
    ends = rounds.put(ends.select("name", "n", "x.last", F.xxhash64("x.end").alias("h"), F.xxhash64(F.lit(1), "x.end").alias("g")))
    key, last = ["n", "h", "g"], F.col("last")
    groups = ends.groupBy(key).agg(F.count_if(last).alias("lasts"), F.count_if(~last).alias("firsts"), F.min(F.when(last, F.col("name"))).alias("a"), F.min(F.when(~last, F.col("name"))).alias("b"))
    groups = rounds.put(groups.filter("lasts > 0 and firsts > 0"))
    open_ = lambda many, own: ends.filter(own).join(groups.filter(many).select(key), key, "left_semi").select("name")
    pairs = groups.filter("lasts = 1 and firsts = 1 and a <> b").groupBy("a", "b").agg(F.max("n").alias("n"))
    own = groups.filter("lasts = 1 and firsts = 1 and a = b").select(F.col("a").alias("name"))
    pairs = pairs.join(open_("firsts > 1", last).union(own).withColumnRenamed("name", "a"), "a", "left_anti")
    pairs = rounds.put(pairs.join(open_("lasts > 1", ~last).union(own).withColumnRenamed("name", "b"), "b", "left_anti"))
    once = lambda c: pairs.groupBy(c).agg(F.count("*").alias("c")).filter("c = 1").select(c)
    return pairs.join(once("a"), "a", "left_semi").join(once("b"), "b", "left_semi").select("a", "b", "n")


def overlap_joined(paths: DataFrame, least: int = 1) -> DataFrame:
    """paths (name, ord, path, cov) in which those that overlap one another, each end with one other path only, are one: names
    joined by &, the overlap once, the least coverage and the first order. Rings of paths stay as they are."""
    rounds = Rounds(paths.sparkSession)
    pairs = rounds.put(overlaps(paths, least))
    found = rounds.put(chains(pairs.select(F.col("a").alias("src"), F.col("b").alias("dst"))))
    cut = pairs.select(F.col("b").alias("name"), "n")
    rows = found.withColumnRenamed("node", "name").join(paths, "name").join(cut, "name", "left")
    begin = F.when(F.col("rank") > 0, F.coalesce("n", F.lit(0))).otherwise(F.lit(0))
    part = F.slice("path", begin + 1, F.size("path") - begin)
    whole = rows.groupBy("head").agg(F.array_sort(F.collect_list(F.struct("rank", "name", part.alias("part")))).alias("x"), F.min("ord").alias("ord"), F.min("cov").alias("cov"))
    whole = whole.select(F.array_join(F.transform("x", lambda p: p["name"]), "&").alias("name"), "ord", F.flatten(F.transform("x", lambda p: p["part"])).alias("path"), "cov")
    rest = paths.join(found.select(F.col("node").alias("name")), "name", "left_anti").select("name", "ord", "path", "cov")
    return rest.unionByName(whole)
