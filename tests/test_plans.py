"""How much some plans shuffle, form and send to the driver, on rows that show what they find, too."""

import pytest
from pyspark.sql import functions as F

from skein import catalogue
from skein.operators import cycles, graph, links, paths
from skein.operators.rounds import Rounds


@pytest.fixture
def plans(monkeypatch):
    """Plans of written tables."""
    seen, put = [], Rounds.put
    monkeypatch.setattr(Rounds, "put", lambda self, df: (seen.append(plan_of(df)), put(self, df))[1])
    return seen


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def shuffles(plans):
    return sum(p.count("Exchange hashpartitioning") for p in plans)


def test_breaking_cycles_takes_no_table_through_the_driver(spark, plans):
    nodes = spark.createDataFrame([(f"n{i}", float(i)) for i in range(7)], "id string, dp double")
    edges = spark.createDataFrame([("n0", "n1"), ("n1", "n2"), ("n2", "n0"), ("n2", "n3"), ("n4", "n5"), ("n5", "n4")], "src string, dst string")
    left, gone = cycles.break_cycles(nodes, edges)
    assert sorted(map(tuple, gone.collect())) == [("n2", "n0"), ("n2", "n3")][:1] + [("n5", "n4")] and left.count() == 4
    assert not any("Broadcast" in p for p in [*plans, plan_of(left)])


def test_contraction_takes_no_table_through_the_driver(spark):
    nodes = spark.createDataFrame([(c, float(i)) for i, c in enumerate("abcde")], "id string, dp double")
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "d"), ("c", "e")], "src string, dst string")
    found = graph.contract_mapped(nodes, edges)
    assert {r.id: r.dp for r in found[0].collect()} == {"a&b&c": 1.0, "d": 3.0, "e": 4.0}
    assert sorted(map(tuple, found[1].collect())) == [("a&b&c", "d"), ("a&b&c", "e")]
    assert not any("Broadcast" in plan_of(df) for df in found)


def test_containment_shuffles_whole_sets_few_times(spark, plans):
    rows = [("a", 1, ["1"]), ("b", 2, ["2", "1"]), ("c", 3, ["1", "2", "1"]), ("d", 4, ["3", "1", "2"]), ("e", 5, ["9"]), ("f", 6, ["2", "7"]), ("g", 7, [f"{i}" for i in range(300)]),
            ("h", 8, ["e"]), ("i", 9, []), ("j", 10, None), ("k", 11, None), ("l", 12, []), ("m", 13, ["9", "9"])]
    found = paths.contained(spark.createDataFrame(rows, "name string, ord long, path array<string>"))
    assert dict(map(tuple, found.collect())) == {"a": "inside", "b": "inside", "c": "same", "d": "inside", "e": "inside", "f": "inside", "l": "same", "m": "same"}
    assert shuffles([*plans, plan_of(found)]) < 16


def test_aligned_hits_of_equal_windows_as_one_row(spark):
    pairs = spark.createDataFrame([(7, "AAAAA", "ACACAC"), (9, "ANAAA", "ACGTA")], "pair long, fseq string, rseq string")
    got = links.read_windows(pairs, 3, counted=True)
    assert sorted(map(tuple, got.collect())) == [("7_0_0", "AAA", 3), ("7_1_0", "ACA", 2), ("7_1_1", "CAC", 2)]
    nodes = spark.createDataFrame([(1, "CACACAAA")], "node long, seq string")
    rows = [("7_0_0", 1, 5, 3, 3, 3), ("7_1_0", 1, 1, 3, 3, 4), ("7_1_1", 1, 0, 3, 3, 4), ("7_1_1", 1, 0, 2, 3, 4)]
    paf = spark.createDataFrame(rows, "query string, target long, start int, matches int, block int, times long")
    found = links.aligned_hits(paf, pairs, nodes, 3)
    assert sorted(map(tuple, found.collect())) == [(7, 0, 1, 5, 8, 3, 5, 0), (7, 1, 1, 6, 8, 8, 0, 0)]


def test_neighbours_are_one_row_until_counted(spark):
    rows = [("a", "b"), ("b", "a"), ("a", "c"), ("d", "a"), ("d", "a"), ("e", "e"), ("f", "c"), ("c", "f"), ("c", "g")]
    found = graph.neighbour_sets(spark.createDataFrame(rows, "src string, dst string"))
    assert sorted(map(tuple, found.collect())) == [("a", 1, 3, 1), ("b", 1, 1, 0), ("c", 1, 3, 1), ("e", 1, 1, 0), ("f", 1, 1, 0)]
    assert "Union" not in plan_of(found)


def test_orders_are_shuffled_once_for_their_paths(spark, plans):
    rows = catalogue._paths(spark, "/root/testdata/sf0.001")
    assert shuffles([plan_of(rows)]) == 1
    assert catalogue.path_coverage(spark, "/root/testdata/sf0.001").filter(F.col("cov").isNull()).count() == 0
    assert sum(p.count("extendedprice") > 0 for p in plans) == 1
