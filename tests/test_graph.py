"""Operators on small graphs with expected values worked out on paper."""

import random

import pytest

from skein.functions.sequence import base_ids, revcomp, windows
from skein.operators import graph, links, paths
from skein.plans.strains import extend, extract_component
from skein.plans.strands import orient


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


@pytest.fixture
def x_graph(spark):
    nodes = spark.createDataFrame([("a", 60.0), ("b", 40.0), ("c", 100.0), ("d", 60.0), ("e", 40.0)], "id string, dp double")
    edges = spark.createDataFrame([("a", "c"), ("b", "c"), ("c", "d"), ("c", "e")], "src string, dst string")
    return nodes, edges


def test_flow_and_branches(x_graph):
    nodes, edges = x_graph
    assert rows(graph.edge_flow(nodes, edges), "src", "dst", "flow") == [("a", "c", 60.0), ("b", "c", 40.0), ("c", "d", 60.0), ("c", "e", 40.0)]
    assert rows(graph.branches(edges), "id") == [("c",)]


def test_balanced_split_then_contraction(spark, x_graph):
    nodes, edges = x_graph
    pe = spark.createDataFrame([("a", "d", 5), ("b", "e", 3)], "a string, b string, cnt long")
    n, e, m = graph.split_balanced(nodes, edges, pe, 3.0)
    assert rows(n, "id", "dp") == [("a", 60.0), ("b", 40.0), ("c*0", 60.0), ("c*1", 40.0), ("d", 60.0), ("e", 40.0)]
    assert rows(m, "old", "new") == [("c", "c*0"), ("c", "c*1")]
    n, e = graph.contract(n, e)
    assert rows(n, "id", "dp") == [("a&c*0&d", 60.0), ("b&c*1&e", 40.0)] and e.count() == 0


def test_disentangle(spark, x_graph):
    pe = spark.createDataFrame([("a", "d", 5), ("b", "e", 3)], "a string, b string, cnt long")
    n = graph.disentangle(*x_graph, pe, 3.0)[0]
    assert rows(n, "id") == [("a&c*0&d",), ("b&c*1&e",)]


def test_no_link_no_split(spark, x_graph):
    none = spark.createDataFrame([], "a string, b string, cnt long")
    assert graph.split_balanced(*x_graph, none, 3.0)[2].count() == 0


def test_edge_cleaning(spark):
    edges = spark.createDataFrame([("a", "x"), ("a", "y"), ("b", "x"), ("b", "y")], "src string, dst string")
    assert rows(graph.clean_edges(edges).filter("kept"), "src", "dst") == [("a", "x"), ("a", "y"), ("b", "x"), ("b", "y")]
    used = spark.createDataFrame([("a", "x")], "src string, dst string")
    assert rows(graph.clean_edges(edges, used).filter("kept"), "src", "dst") == [("a", "x"), ("b", "y")]


def test_saturation(spark):
    nodes = spark.createDataFrame([("n", "ACGTTGCA")], "node string, seq string")
    pairs = spark.createDataFrame([(1, "CGTTGC", "AAAAAA"), (2, "CGTNGC", "CGTTGC")], "pair long, fseq string, rseq string")
    assert links.kmer_index(nodes, 4).count() == 10
    found = links.hits(pairs, nodes, 4)
    assert rows(found, "pair", "mate", "hits", "node_pos", "read_pos") == [(1, 0, 3, 1, 0)]
    assert links.saturated(found, 4).count() == 1


def test_link_fold(spark):
    n = spark.createDataFrame([("u", "v", 2), ("v", "u", 3), ("u", "u", 7)], "i string, j string, n long")
    s = spark.createDataFrame([("u", "v", 4), ("u", "u", 1)], "i string, j string, n long")
    assert rows(links.fold(n, s), "a", "b", "cnt") == [("u", "u", 8), ("u", "v", 9)]


def test_threshold(spark):
    nodes = spark.createDataFrame([(i, 2.0) for i in range(8)] + [(100 + i, 60.0 + 7 * i) for i in range(12)], "id long, dp double")
    assert graph.coverage_threshold(nodes) == pytest.approx(7.05)
    assert graph.coverage_threshold(spark.createDataFrame([(1, 5.0), (2, 5.0)], "id long, dp double")) == 0.0


def test_containment(spark):
    p = spark.createDataFrame([("1", 1, list("pqr")), ("2", 2, list("rqp")), ("3", 3, list("qr")), ("4", 4, list("qs")), ("5", 5, ["s"])], "name string, ord long, path array<string>")
    assert rows(paths.contained(p), "name", "why") == [("2", "same"), ("3", "inside"), ("5", "inside")]
    assert rows(paths.deduplicated(p), "name") == [("1",), ("4",)]


def test_ids_and_repeats(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([("3&7*A*0&-2",)], "id string")
    assert df.select(base_ids(F.col("id"))).first()[0] == ["3", "7", "-2"]
    s = spark.createDataFrame([("s", ["1", "2", "3"])], "name string, path array<string>")
    c = spark.createDataFrame([("s", "2", 2), ("s", "3", 1)], "name string, id string, times long")
    assert paths.expand_repeats(s, c).first()["path"] == ["1", "2", "2", "3"]


def test_revcomp_is_an_involution(spark):
    from pyspark.sql import functions as F

    r = random.Random(1)
    df = spark.createDataFrame([("".join(r.choice("ACGT") for _ in range(r.randint(0, 30))),) for _ in range(50)], "s string")
    assert df.filter(revcomp(revcomp(F.col("s"))) != F.col("s")).count() == 0
    assert windows(df.filter("length(s) < 3"), "s", 3, ["s"]).count() == 0


def test_chains_spell_paths_and_leave_cycles(spark):
    nodes = spark.createDataFrame([(c, 1.0) for c in "abcdxyz"], "id string, dp double")
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "d"), ("x", "y"), ("y", "z"), ("z", "x")], "src string, dst string")
    n, e = graph.contract(nodes, edges)
    assert rows(n, "id") == [("a&b&c&d",), ("x",), ("y",), ("z",)] and e.count() == 3


def test_closure_and_reachability_agree(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 4), (4, 2), (5, 6)], "src long, dst long")
    a = rows(graph.closure(edges), "src", "dst")
    b = rows(graph.reachable(edges, edges.selectExpr("src as id").distinct()), "source", "id")
    assert a == b and (2, 2) in a and (1, 1) not in a


def test_reindex_is_dense(spark):
    from pyspark.sql import functions as F

    nodes = spark.createDataFrame([(i, float(i % 7)) for i in range(200)], "id long, dp double")
    got = {r["id"]: int(r["new_id"]) for r in graph.reindex(nodes, -F.col("dp")).collect()}
    assert sorted(got.values()) == list(range(200))
    assert [i for i, _ in sorted(got.items(), key=lambda x: x[1])] == sorted(got, key=lambda i: (-(i % 7), i))


def test_strands():
    n, e = orient([("1", "AACC", 5.0), ("2", "GGTT", 3.0)], [("1", "+", "2", "-", 2)])
    assert n == [("1", "AACC", 5.0), ("2", "AACC", 3.0)] and e == [("1", "2", 2)]
    n, e = orient([("1", "A", 5.0), ("2", "C", 3.0)], [("1", "+", "2", "+", 0), ("1", "+", "2", "-", 0)])
    assert [x[0] for x in n] == ["1", "2", "-2"]


def test_extension_takes_linked_way_and_coverage_goes():
    out = {"a": {"c"}, "b": {"c"}, "c": {"d", "e"}}
    dp = {"a": 60.0, "b": 40.0, "c": 100.0, "d": 60.0, "e": 40.0}
    assert extend(["a", "c"], out, dp, {("a", "d"): 5}, 60.0, 3.0) == ["a", "c", "d"]
    got = extract_component(dp, [("a", "c"), ("b", "c"), ("c", "d"), ("c", "e")], [("1", ["a", "c"], 60.0), ("2", ["b", "c"], 40.0)], {("a", "d"): 5, ("b", "e"): 3})
    assert [(n, p) for n, p, _ in got] == [("1", ["a", "c", "d"]), ("2", ["b", "c", "e"])]
