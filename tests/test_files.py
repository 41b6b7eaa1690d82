"""Files that are cut in several places, strict layouts, and alignments."""

import random

import pytest

from skein.operators import links, paths
from skein.sources import formats

from .test_formats import lines


def fastq(path, names):
    path.write_text("".join(f"@{n}\n{n}ACGT\n+\nIIII\n" for n in names))


def test_pairs_over_several_files(spark, tmp_path):
    """Files of different sizes on both sides: pairs go by the record's number over all files in order of their names."""
    for side, cut in (("f", 1), ("r", 3)):
        (tmp_path / side).mkdir()
        names = [f"{side}{i}" for i in range(4)]
        fastq(tmp_path / side / "a.fq", names[:cut])
        fastq(tmp_path / side / "b.fq", names[cut:])
    got = formats.read_fastq_pairs(spark, str(tmp_path / "f"), str(tmp_path / "r")).collect()
    assert sorted(tuple(r) for r in got) == [(i, f"f{i}ACGT", f"r{i}ACGT") for i in range(4)]


def test_lines_are_numbered_over_splits(spark, tmp_path):
    r = random.Random(1)
    want = []
    for name in ("c.txt", "a.txt", "b.txt"):
        (tmp_path / name).write_text("".join(f"{name}{i}{'x' * r.randint(0, 300)}\n" for i in range(r.randint(200, 2000))))
    for name in ("a.txt", "b.txt", "c.txt"):
        want += (tmp_path / name).read_text().splitlines()
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        got = formats.numbered_lines(spark, str(tmp_path)).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert [r["value"] for r in sorted(got, key=lambda r: r["line"])] == want and sorted(r["line"] for r in got) == list(range(len(want)))


def test_links_end_at_a_blank_line_and_need_known_ids(spark, tmp_path):
    (tmp_path / "a").write_text("1:2:3\n2:1:4\n\n1:3:9\n")
    (tmp_path / "b").write_text("3:1:5\n9:1:1\n")
    files = [str(tmp_path / x) for x in "ab"]
    assert sorted(map(tuple, formats.read_links(spark, *files).collect())) == [("1", "2", 7), ("1", "3", 5), ("1", "9", 1)]
    nodes = spark.createDataFrame([("1",), ("2",), ("3",)], "id string")
    assert sorted(map(tuple, formats.read_links(spark, *files, nodes=nodes).collect())) == [("1", "2", 7), ("1", "3", 5)]


def test_coverage_tags(spark, tmp_path):
    rows = ["S\t1\tAC\tDP:f:7.5\tKC:i:9\tLN:i:2", "S\t2\tAC\tKC:i:9\tLN:i:2\tDP:f:7.5", "S\t3\tAC\tkc:i:9\tDP:f:7.5\tln:i:2", "S\t4\tAC\t" + "XX:i:1\t" * 1200 + "dp:f:3"]
    (tmp_path / "g").write_text("\n".join(rows) + "\n")
    got = {r["id"]: r["dp"] for r in formats.read_gfa(spark, str(tmp_path / "g"))[0].collect()}
    assert got == {"1": 7.5, "2": 4.5, "3": 7.5, "4": 3.0}


def test_canonical_gfa_is_strict(spark, tmp_path):
    nodes = spark.createDataFrame([("1", "ACGT", 7.5), ("2", "GGTT", 2.5)], "id string, seq string, dp double")
    formats.write_gfa(nodes, spark.createDataFrame([("1", "2", 2)], "src string, dst string, overlap int"), str(tmp_path / "g"))
    n, e = formats.read_canonical_gfa(spark, str(tmp_path / "g"))
    assert sorted(map(tuple, n.collect())) == [("1", "ACGT", 7.5), ("2", "GGTT", 2.5)] and [tuple(r) for r in e.collect()] == [("1", "2", 2)]
    for k, bad in enumerate(["S\t1\tAC\tKC:i:1", "S\t1\tAC\tDP:f:1\tXX:i:1", "L\t1\t+\t2\t-\t2M", "L\t1\t+\t2\t+\t2S", "L\t1\t+\t2\t+\t2M\tx", "P\tx"]):
        (tmp_path / f"bad{k}").write_text(bad + "\n")
        with pytest.raises(Exception, match="not canonical"):
            for df in formats.read_canonical_gfa(spark, str(tmp_path / f"bad{k}")):
                df.collect()


def test_original_names_and_references(spark, tmp_path):
    p = spark.createDataFrame([("a", ["-1&2*0", "3"], 10, 2.0)], "name string, path array<string>, len long, cov double")
    names = spark.createDataFrame([("-1", "-x"), ("3", "z")], "id string, original string")
    formats.write_paths(p, str(tmp_path / "p"), names)
    assert lines(tmp_path / "p") == ["NODE_a_10_2.0", "x-,2,z"]
    (tmp_path / "ref.fa").write_text(">r1.2 first\nACGT\n>r2\nGG\n")
    got = formats.read_references(spark, str(tmp_path / "ref.fa"))
    assert sorted(map(tuple, got.collect())) == [("r1", "ACGT"), ("r2", "GG")]
    formats.write_references(got, str(tmp_path / "refs"))
    assert lines(tmp_path / "refs" / "name=r1") == [">r1", "ACGT"]


def test_alignments(spark, tmp_path):
    row = lambda q, ql, t, start, m, b, nm: f"{q}\t{ql}\t0\t{ql}\t+\t{t}\t99\t{start}\t99\t{m}\t{b}\t60\ttp:A:P\tNM:i:{nm}\n"
    (tmp_path / "x.paf").write_text(row("c_1", 10, "t", 0, 10, 10, 0) + row("d_1", 10, "t", 0, 9, 10, 1) + row("e_1", 12, "t", 0, 10, 10, 0))
    paf = formats.read_paf(spark, str(tmp_path / "x.paf"))
    assert sorted(map(tuple, links.exact_alignments(paf).collect())) == [("t", "c_1")]
    contigs = spark.createDataFrame([("c",), ("d",)], "name string")
    assert sorted(map(tuple, links.contigs_of_targets(paf, contigs).collect())) == [("t", "c")]
    assert sorted(map(tuple, links.alignment_scores(paf).collect())) == [("c_1", 10, "t", 0), ("d_1", 10, "t", 1), ("e_1", 10, "t", 0)]


def test_hits_from_alignments_of_windows(spark):
    nodes = spark.createDataFrame([("n", "ACGTTGCAAC"), ("m", "CGTTGCCCCC")], "node string, seq string")
    pairs = spark.createDataFrame([(1, "CGTTGC", "AAAAAA"), (2, "CGTNGC", "CGTTGC")], "pair long, fseq string, rseq string")
    found = [(f"1_0_{i}", "n", i + 1, 4, 4) for i in range(3)] + [("1_0_0", "m", 0, 4, 4), ("1_0_1", "m", 1, 3, 4), ("1_1_0", "m", 0, 3, 3)]
    paf = spark.createDataFrame(found, "query string, target string, start long, matches long, block long")
    got = links.aligned_hits(paf, pairs, nodes, 4)
    assert sorted((r["pair"], r["mate"], r["node"], r["hits"], r["node_pos"], r["read_pos"]) for r in got.collect()) == [(1, 0, "m", 1, 0, 0), (1, 0, "n", 3, 1, 0)]
    assert sorted(r["node"] for r in links.saturated(got, 4).collect()) == ["m", "n"]  # one of 6 - 4 windows is enough: (6 - 4 + 1) * 2 / 6 = 1
    assert links.read_windows(pairs, 4).count() == 6
    assert tuple(links.read_counts(pairs, 7).first()) == (2, 1, 1, 0)


def test_sampling_is_the_same_in_every_run(spark):
    pairs = spark.range(3000).selectExpr("id as pair", "'A' as fseq", "'C' as rseq")
    a = {r["pair"] for r in links.sample_pairs(pairs, 4, 1).collect()}
    assert a == {r["pair"] for r in links.sample_pairs(pairs.repartition(7), 4, 1).collect()} and 600 < len(a) < 900
    assert a != {r["pair"] for r in links.sample_pairs(pairs, 4, 2).collect()}
    with pytest.raises(ValueError):
        links.sample_pairs(pairs, 1)


def test_paths_that_are_valid(spark):
    p = spark.createDataFrame([("a", ["1", "2"]), ("b", ["2", "1"]), ("c", ["1", "9"]), ("d", []), ("e", ["2"])], "name string, path array<string>")
    nodes, edges = spark.createDataFrame([("1",), ("2",)], "id string"), spark.createDataFrame([("1", "2")], "src string, dst string")
    assert sorted(map(tuple, paths.valid(p, nodes, edges).collect())) == [("a", True), ("b", False), ("c", False), ("d", False), ("e", True)]


def test_windows_of_long_and_other_letters(spark, monkeypatch):
    from skein.functions import sequence

    r = random.Random(2)
    seqs = ["".join(r.choice("ACGT") for _ in range(n)) for n in (0, 3, 5, 700)] + ["ÄCGTÉ한AC", None]
    df = spark.createDataFrame([(i, s) for i, s in enumerate(seqs)], "i long, seq string")
    monkeypatch.setattr(sequence, "WINDOWS", 64)
    got = sorted(tuple(x) for x in sequence.windows(df, "seq", 4, ["i"]).collect())
    assert got == sorted((i, p, s[p : p + 4]) for i, s in enumerate(seqs) if s for p in range(len(s) - 3))


def test_parts_of_parts(spark):
    p = spark.createDataFrame([("s", ["A2*B", "x"]), ("t", ["y"])], "name string, path array<string>")
    parts = spark.createDataFrame([("A1", ["u", "v"]), ("A2", ["A1*A", "w"])], "id string, path array<string>")
    assert {r["name"]: r["path"] for r in paths.expand_parts(p, parts).collect()} == {"s": ["u", "v", "w", "x"], "t": ["y"]}
    with pytest.raises(ValueError):
        paths.expand_parts(p, spark.createDataFrame([("y", ["y"])], "id string, path array<string>"))
