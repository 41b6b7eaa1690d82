"""Walks over a graph that changes: forks, ways on, strains put back as nodes."""

import pytest

from skein.operators import graph, links, schemas
from skein.plans.strains import Component, extract_component, moved_contigs, supported_pairs, walk


def sides(edges):
    out, back = {}, {}
    for s, t in edges:
        out.setdefault(s, set()).add(t)
        back.setdefault(t, set()).add(s)
    return out, back


def test_forks_open_until_there_are_none():
    """a -> c -> d, e: c becomes a copy for each target, with that edge's flow; then a does."""
    g = Component({"r": 90.0, "a": 90.0, "c": 90.0, "d": 60.0, "e": 30.0}, [("r", "a"), ("a", "c"), ("c", "d"), ("c", "e")])
    now = g.fork()
    assert now["c"] == {"c*A", "c*B"} and now["a"] == {"a*A", "a*B"} and now["d"] == {"d"} and now["r"] == {"r"}
    assert g.dp["c*A"] == 60.0 and g.dp["c*B"] == 30.0 and g.spells["c*B"] == ("c",)
    assert set(g.out["r"]) == {"a*A", "a*B"} and set(g.out["c*A"]) == {"d"} and set(g.back["c*B"]) == {"a*B"}
    assert g.out["r"]["a*A"] == 60.0
    assert moved_contigs([("1", ["a", "c", "d"], 1.0), ("2", ["a", "c"], 1.0), ("3", ["r", "a"], 1.0)], now, g) == [("1", ["a*A", "c*A", "d"], 1.0), ("3", ["r"], 1.0)]


def test_flows_are_those_of_the_operator(spark):
    dp, edges = {"a": 60.0, "b": 35.0, "c": 100.0, "d": 70.0, "e": 40.0, "f": 9.0}, [("a", "c"), ("b", "c"), ("c", "d"), ("c", "e"), ("b", "f"), ("f", "e")]
    g = Component(dp, edges)
    want = graph.edge_flow(spark.createDataFrame(list(dp.items()), "id string, dp double"), spark.createDataFrame(edges, "src string, dst string")).collect()
    assert {(s, t): round(f, 9) for s in g.out for t, f in g.out[s].items()} == {(r["src"], r["dst"]): round(r["flow"], 9) for r in want}
    assert g.branches() == ["c"]


X = [("a", "c"), ("b", "c"), ("c", "d"), ("c", "e")]


def test_nearest_both_ways_or_stop():
    out, back = sides(X)
    near = lambda dp, cov, pairs: walk(["a", "c"], out, back, dp, pairs, cov, 3.0)
    dp = {"a": 60.0, "b": 20.0, "c": 80.0, "d": 58.0, "e": 22.0}
    assert near(dp, 60.0, {"c": set()}) == ["a", "c", "d"]  # each other's nearest
    assert near(dp | {"e": 57.0}, 60.0, {"c": set()}) == ["a", "c"]  # a second one is near: stop
    assert near(dp | {"b": 58.0}, 40.0, {"c": set()}) == ["a", "c", "d"]  # not mutual: only d can carry 40
    assert near(dp, 60.0, {}) == ["a", "c", "d"]  # no branch: only d can carry 60
    assert near(dp, 10.0, {}) == ["a", "c"]  # both can carry 10


def test_links_at_a_branch():
    out, back = sides(X)
    dp = {"a": 60.0, "b": 20.0, "c": 80.0, "d": 58.0, "e": 22.0}
    step = lambda cov, pairs: walk(["a", "c"], out, back, dp, pairs, cov, 3.0)
    assert step(20.0, {"c": {("a", "e")}}) == ["a", "c", "e"]
    assert step(40.0, {"c": {("a", "e")}}) == ["a", "c", "d"]  # e can't carry it: only d can
    assert step(20.0, {"c": {("a", "d"), ("a", "e")}}) == ["a", "c"]  # two are linked, both can carry it


def test_open_strain_becomes_a_node():
    """A walk that stops before an ambiguous branch is put back as a node; a later walk goes through it and replaces it."""
    dp = {"s": 50.0, "a": 50.0, "x": 90.0, "y": 40.0, "z": 92.0}
    edges = [("s", "a"), ("a", "x"), ("y", "x"), ("x", "z")]
    got = extract_component(dp, edges, [("1", ["s", "a"], 50.0), ("2", ["y", "x"], 40.0)], {}, delta=2.0)
    assert [(n, p) for n, p, _ in got] == [("1", ["s", "a", "x", "z"]), ("2", ["y", "x", "z"])]


def test_pairs_that_contigs_support():
    g = Component(dict.fromkeys("abcde", 1.0), X)
    assert supported_pairs(g, [("1", ["a", "c", "e"], 1.0)], {("b", "d"): 2}) == {"c": {("a", "e"), ("b", "d")}}


def test_links_of_whole_nodes(spark):
    pe = spark.createDataFrame([("1", "2", 5), ("2", "3", 7), ("1", "1", 2)], "a string, b string, cnt long")
    parts = spark.createDataFrame([("p", "1"), ("p", "2"), ("q", "3"), ("r", "2")], "id string, part string")
    got = {(r["a"], r["b"]): r["cnt"] for r in links.node_links(pe, parts).collect()}
    assert got == {("p", "p"): 12, ("p", "q"): 7, ("p", "r"): 5, ("q", "r"): 7}


def test_last_of_chains_and_rings(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "d"), ("x", "y"), ("y", "x"), ("w", "x")], "src string, dst string")
    assert sorted(map(tuple, graph.last_of(edges).collect())) == [("a", "d"), ("b", "d"), ("c", "d")]


def test_compact_and_subtract(spark):
    nodes = spark.createDataFrame([("a", 5.0), ("a", 5.0), ("b", 4.0)], "id string, dp double")
    edges = spark.createDataFrame([("a", "b"), ("a", "b"), ("a", "x")], "src string, dst string")
    n, e = graph.compact(nodes, edges)
    assert n.count() == 2 and [tuple(r) for r in e.collect()] == [("a", "b")]
    walks = spark.createDataFrame([("w", ["a", "b"], 1.5), ("v", ["b"], 1.0)], "name string, path array<string>, cov double")
    n, f = graph.subtract(n, e.selectExpr("src", "dst", "4.0D as flow"), walks)
    assert sorted((r["id"], r["dp"]) for r in n.collect()) == [("a", 3.5), ("b", 1.5)] and f.first()["flow"] == 2.5


def test_schemas(spark):
    df = spark.createDataFrame([(1, "x", 2)], "dp int, id string, more int").selectExpr("*", "'AC' as seq")
    got = schemas.conform(df, schemas.NODES)
    assert got.dtypes == [("id", "string"), ("seq", "string"), ("dp", "double")]
    with pytest.raises(ValueError, match="overlap"):
        schemas.conform(df.selectExpr("id as src", "id as dst"), schemas.EDGES)


def test_nearest_with_margin_and_first_of_the_best(spark):
    nodes = spark.createDataFrame([("a", 60.0), ("b", 20.0), ("d", 58.0), ("e", 22.0), ("f", 57.0)], "id string, dp double")
    edges = spark.createDataFrame([("a", "d"), ("a", "e"), ("b", "d"), ("b", "e"), ("a", "f")], "src string, dst string")
    get = lambda df: sorted((r["src"], r["dst"]) for r in df.collect())
    assert get(graph.mutual_nearest(nodes, edges)) == [("a", "d"), ("b", "e")]
    assert get(graph.mutual_nearest(nodes, edges, 3.0)) == [("b", "e")]  # f is within twice the distance of d
    rows = spark.createDataFrame([("g", 3, 1.0), ("g", 2, 1.0), ("g", 1, 0.5), ("h", 9, None)], "k string, o long, v double")
    assert sorted((r["k"], r["o"]) for r in graph.first_max(rows.filter("v is not null"), "v", "o", "k").collect()) == [("g", 2)]
    seqs = spark.createDataFrame([("x", "AC", 1.0), ("y", "AC", 2.0), ("z", "G", 0.5)], "id string, seq string, dp double")
    assert sorted(r["id"] for r in graph.best_of_sequence(seqs).collect()) == ["y", "z"]
