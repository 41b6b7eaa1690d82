"""Readers and writers on small files."""

from skein.sources import formats
from skein.streaming.links import streaming_mate_links


def lines(path):
    return [x for p in sorted(path.glob("part-*")) for x in p.read_text().splitlines()]


def test_gfa_round_trip(spark, tmp_path):
    (tmp_path / "g.gfa").write_text("H\tVN\nS\t1\tacgt\tDP:f:7.5\nS\t2\tGGTT\tLN:i:4\tKC:i:10\nL\t1\t+\t2\t+\t2M\nL\t2\t+\t2\t+\t2M\n")
    nodes, links = formats.read_gfa(spark, str(tmp_path / "g.gfa"))
    assert sorted(map(tuple, nodes.select("id", "seq", "dp", "self_loop").collect())) == [("1", "ACGT", 7.5, False), ("2", "GGTT", 2.5, True)]
    formats.write_gfa(nodes, links, str(tmp_path / "out"))
    assert lines(tmp_path / "out") == ["S\t1\tACGT\tDP:f:7.5", "S\t2\tGGTT\tDP:f:2.5", "L\t1\t+\t2\t+\t2M"]


def test_paths(spark, tmp_path):
    (tmp_path / "p.paths").write_text("NODE_1_length_900_cov_12.5\n1+,2+,1+;\n3+\nNODE_1_length_900_cov_12.5'\n3-;\n1-,2-,1-\nNODE_2_length_10_cov_3\n3+\nNODE_2_length_10_cov_3'\n3-\n")
    nodes = spark.createDataFrame([("1",), ("2",), ("3",)], "id string")
    edges = spark.createDataFrame([("1", "2"), ("2", "1")], "src string, dst string")
    got = {r["name"]: (r["path"], r["repeats"]) for r in formats.read_paths(spark, str(tmp_path / "p.paths"), nodes, edges).collect()}
    assert got == {"1$0": (["1", "2"], {"1": 2, "2": 1}), "1$1": (["3"], {"3": 1})}


def test_fastq_and_fasta(spark, tmp_path):
    (tmp_path / "a.fq").write_text("@1\nACGT\n+\nIIII\n@2\nGG\n+\nII\n")
    (tmp_path / "b.fq").write_text("@1\nTTTT\n+\nIIII\n")
    assert [tuple(r) for r in formats.read_fastq_pairs(spark, str(tmp_path / "a.fq"), str(tmp_path / "b.fq")).collect()] == [(0, "ACGT", "TTTT")]
    df = spark.createDataFrame([("a", "ACG", 1.005), ("b", "ACGTT", 2.0)], "name string, seq string, cov double")
    formats.write_fasta(df, str(tmp_path / "fa"))
    assert lines(tmp_path / "fa") == [">b_5_2.0", "ACGTT", ">a_3_1.0", "ACG"]


def test_links(spark, tmp_path):
    (tmp_path / "l").write_text("1:2:3\n2:1:4\n\n")
    assert [tuple(r) for r in formats.read_links(spark, str(tmp_path / "l")).collect()] == [("1", "2", 7)]


def test_streaming_links(spark, tmp_path):
    spark.createDataFrame([(1, ["b", "a"]), (2, ["a"])], "pair long, nodes array<string>").write.json(str(tmp_path / "in"))
    q = streaming_mate_links(spark.readStream.schema("pair long, nodes array<string>").json(str(tmp_path / "in"))).writeStream.format("memory").queryName("links").outputMode("complete").start()
    try:
        q.processAllAvailable()
        assert sorted(map(tuple, spark.sql("select a, b, cnt from links").collect())) == [("a", "a", 2), ("a", "b", 1), ("b", "b", 1)]
    finally:
        q.stop()
