"""How many tables iterated plans write, and what they find, on long chains."""

import random

import pytest
from pyspark.sql import functions as F

from skein.operators import cycles, graph, reach
from skein.operators.rounds import Rounds
from skein.plans import strains


@pytest.fixture
def written(monkeypatch):
    seen, put = [], Rounds.put
    monkeypatch.setattr(Rounds, "put", lambda self, df: (seen.append(1), put(self, df))[1])
    return seen


def edges_of(spark, pairs):
    return spark.createDataFrame([(f"n{a}", f"n{b}") for a, b in pairs], "src string, dst string")


def core_of(pairs):
    left, n = set(pairs), -1
    while n != len(left):
        n = len(left)
        left = {(a, b) for a, b in left if any(y == a for _, y in left) and any(x == b for x, _ in left)}
    return left


def test_cyclic_core_of_long_ways_to_and_from_cycles(spark, written):
    way = lambda a, n: [(a + i, a + i + 1) for i in range(n)]
    # a chain into a ring, a chain on to a second ring with a way across, a chain out; a plain ring; a chain alone
    pairs = way(0, 150) + [(150, 148)] + way(150, 60) + way(210, 5) + [(215, 210), (211, 214)] + way(215, 150) + way(500, 9) + [(509, 500)] + way(600, 150)
    found = graph.cyclic_core(edges_of(spark, pairs))
    assert {(int(r.src[1:]), int(r.dst[1:])) for r in found.collect()} == core_of(pairs)
    assert len(written) < 60


def test_cyclic_core_of_graphs(spark):
    rng = random.Random(5)
    for n, m in ((1, 0), (12, 12), (40, 44), (60, 66)):
        pairs = sorted({(rng.randrange(n), rng.randrange(n)) for _ in range(m)})
        found = graph.cyclic_core(edges_of(spark, pairs) if pairs else spark.createDataFrame([], "src string, dst string"))
        assert {(int(r.src[1:]), int(r.dst[1:])) for r in found.collect()} == core_of(pairs)


def test_last_of_and_chains_with_rings_and_without_rows(spark):
    none = spark.createDataFrame([], "src string, dst string")
    assert graph.chains(none).count() == graph.last_of(none).count() == 0
    ring = edges_of(spark, [(0, 1), (1, 2), (2, 0), (7, 8), (8, 9)])
    assert sorted(map(tuple, graph.last_of(ring).collect())) == [("n7", "n9"), ("n8", "n9")]
    assert sorted(map(tuple, graph.chains(ring).collect())) == [("n7", "n7", 0), ("n8", "n7", 1), ("n9", "n7", 2)]


def test_contigs_without_a_walk_of_their_own_leave_the_graph_alone(monkeypatch):
    seen, fork = [], strains.Component.fork
    monkeypatch.setattr(strains.Component, "fork", lambda self: (seen.append(1), fork(self))[1])
    ids = [f"n{i}" for i in range(500)]
    contigs = [(f"c{i}", [a, b], 20.0) for i, (a, b) in enumerate(zip(ids, ids[1:]))]
    found = strains.extract_component(dict.fromkeys(ids, 30.0), list(zip(ids, ids[1:])), contigs, {})
    assert found == [("c0", ids, 20.0)] and len(seen) < 5


def parts_of(pairs):
    reach = {a: set() for p in pairs for a in p}
    for a in reach:
        todo = [a]
        while todo:
            x = todo.pop()
            new = {t for s, t in pairs if s == x} - reach[a]
            reach[a] |= new
            todo += new
    return {f"n{a}": min(f"n{b}" for b in reach[a] if a in reach[b]) for a in reach if a in reach[a]}


def test_strong_parts_one_after_the_other_in_few_rounds(spark, written):
    # each fourth node leads two back, so parts of three nodes follow one another; a ring leads into the second part
    pairs = [(i, i + 1) for i in range(120)] + [(i, i - 2) for i in range(2, 120, 4)] + [(500, 501), (501, 502), (502, 500), (502, 5), (119, 119)]
    assert {r.id: r.scc for r in cycles.strongly_connected(edges_of(spark, pairs)).collect()} == parts_of(pairs)
    assert len(written) < 110


def test_strong_parts_inside_larger_ones(spark):
    rng = random.Random(3)
    for n, m in ((20, 26), (50, 58), (70, 74)):
        pairs = sorted({(rng.randrange(n), rng.randrange(n)) for _ in range(m)} | {(i, i) for i in range(0, n, 7)})
        assert {r.id: r.scc for r in cycles.strongly_connected(edges_of(spark, pairs)).collect()} == parts_of(pairs)


@pytest.fixture
def broadcasts(monkeypatch):
    """Plans of written tables that take a side of a join through the driver."""
    seen, put = [], Rounds.put

    def look(self, df):
        plan = df._jdf.queryExecution().executedPlan().toString()
        if "Broadcast" in plan:
            seen.append(plan)
        return put(self, df)

    monkeypatch.setattr(Rounds, "put", look)
    return seen


#: A ring, a way from it, a part with two rings in it and a chain.
SOME = [(0, 1), (1, 2), (2, 0), (2, 3), (3, 4), (4, 5), (5, 6), (6, 4), (5, 4), (6, 7), (8, 9), (9, 10)]


def test_reachability_takes_no_table_through_the_driver(spark, broadcasts):
    index = reach.reach_index(edges_of(spark, SOME))
    pairs = spark.createDataFrame([("n0", "n7"), ("n7", "n0"), ("n8", "n10"), ("n4", "n4")], "source string, id string")
    found = Rounds(spark).put(reach.reaches(index, pairs))
    assert {(r.source, r.id): r.reached for r in found.collect()} == {("n0", "n7"): True, ("n7", "n0"): False, ("n8", "n10"): True, ("n4", "n4"): True}
    assert Rounds(spark).put(reach.reached_from(index, pairs.select(F.col("source").alias("id")))).filter("source = 'n8'").count() == 2
    assert not broadcasts
