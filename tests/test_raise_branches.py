"""Coverage of simple and other branches."""

import pytest

from skein.operators import graph


def raised(spark, depth, pairs):
    nodes = spark.createDataFrame(list(depth.items()), "id string, dp double")
    return {r["id"]: r["dp"] for r in graph.raise_branches(nodes, spark.createDataFrame(pairs, "src string, dst string")).collect()}


def test_simple_branch_takes_its_neighbours_sum(spark):
    depth = {"a": 30.0, "b": 20.0, "x": 40.0, "c": 25.0, "d": 20.0}
    x = [("a", "x"), ("b", "x"), ("x", "c"), ("x", "d")]
    assert raised(spark, depth, x) == pytest.approx(depth | {"x": 50.0})
    other = raised(spark, depth | {"e": 5.0}, [*x, ("a", "e")])
    assert other["x"] < 50.0
