"""Coverage of paths, of one node too."""

from skein.operators import paths


def test_one_node_has_its_depth(spark):
    p = spark.createDataFrame([("a", ["x", "y", "z"]), ("b", ["y"]), ("c", ["gone"])], "name string, path array<string>")
    flows = spark.createDataFrame([("x", "y", 4.0), ("y", "z", 2.5)], "src string, dst string, flow double")
    nodes = spark.createDataFrame([("x", 5.0), ("y", 7.0), ("z", 3.0)], "id string, dp double")
    assert sorted(tuple(r) for r in paths.path_coverage(p, flows, nodes).collect()) == [("a", 2.5), ("b", 7.0)]
    assert [tuple(r) for r in paths.path_coverage(p, flows).collect()] == [("a", 2.5)]
