"""Planted strains: genomes with known differences, their exact graph and error-free read pairs; and the steps on the way."""

import random

import pytest

from skein.operators import graph, paths
from skein.operators.graph import pair_ends
from skein.plans.reconstruct import reconstruct
from skein.plans.strains import extract_component, follow, link_pairs

K = 31


def unitigs(genomes):
    """{name: coverage} graph of the genomes: unitigs over (K + 1)-mers, their links, and each genome's walk."""
    cov, nxt, prev = {}, {}, {}
    for g, c in genomes:
        words = [g[i : i + K + 1] for i in range(len(g) - K)]
        for w in words:
            cov[w] = cov.get(w, 0) + c
        for a, b in zip(words, words[1:]):
            nxt.setdefault(a, set()).add(b)
            prev.setdefault(b, set()).add(a)
    simple = lambda a: len(nxt.get(a, ())) == 1 and len(prev[next(iter(nxt[a]))]) == 1
    heads = [w for w in sorted(cov) if not (len(prev.get(w, ())) == 1 and simple(next(iter(prev[w]))))]
    of, segs = {}, []
    for i, w in enumerate(heads):
        chain = [w]
        while simple(chain[-1]):
            chain.append(next(iter(nxt[chain[-1]])))
        of.update(dict.fromkeys(chain, str(i + 1)))
        segs.append((str(i + 1), chain[0] + "".join(x[-1] for x in chain[1:]), sum(cov[x] for x in chain) / len(chain)))
    edges = sorted({(of[a], of[b]) for a in nxt for b in nxt[a] if of[a] != of[b]})
    walks = []
    for g, _ in genomes:
        walk = []
        for i in range(len(g) - K):
            if not walk or walk[-1] != of[g[i : i + K + 1]]:
                walk.append(of[g[i : i + K + 1]])
        walks.append(walk)
    return segs, edges, walks


def planted(seed, coverages, sites):
    r = random.Random(seed)
    base = [r.choice("ACGT") for _ in range(2000)]
    genomes = []
    for s, c in enumerate(coverages):
        g = list(base)
        for at in sites(s):
            g[at] = "ACGT"[("ACGT".index(base[at]) + 1) % 4]
        genomes.append(("".join(g), c))
    return genomes


def write(tmp_path, genomes, contigs_of):
    segs, edges, walks = unitigs(genomes)
    (tmp_path / "g.gfa").write_text("".join(f"S\t{i}\t{s}\tDP:f:{d}\n" for i, s, d in segs) + "".join(f"L\t{a}\t+\t{b}\t+\t{K}M\n" for a, b in edges))
    lines = []
    for n, (path, cov) in enumerate(contigs_of(walks), 1):
        lines += [f"NODE_{n}_length_500_cov_{cov}", ",".join(f"{x}+" for x in path), f"NODE_{n}_length_500_cov_{cov}'", ",".join(f"{x}-" for x in path[::-1])]
    (tmp_path / "g.paths").write_text("\n".join(lines) + "\n")
    comp, fwd, rve = str.maketrans("ACGT", "TGCA"), [], []
    for g, c in genomes:
        for i in range(0, len(g) - 400 + 1, max(1, 400 // c)):
            fwd.append(g[i : i + 150])
            rve.append(g[i + 250 : i + 400][::-1].translate(comp))
    for name, reads in (("f.fq", fwd), ("r.fq", rve)):
        (tmp_path / name).write_text("".join(f"@{i}\n{s}\n+\n{'I' * len(s)}\n" for i, s in enumerate(reads)))
    return [str(tmp_path / x) for x in ("g.gfa", "g.paths", "f.fq", "r.fq")], segs, edges, walks


def test_planted_strains(spark, tmp_path):
    """Two strains whose sites lie within a read pair of each other: both are spelled exactly."""
    genomes = planted(3, (100, 60), lambda s: range(200, 1800, 120) if s else ())
    files, segs, edges, walks = write(tmp_path, genomes, lambda ws: [(w[:3], c) for w, (_, c) in zip(ws, genomes)])
    got = {r["seq"]: r["cov"] for r in reconstruct(spark, *files, out=str(tmp_path / "out")).collect()}
    assert set(got) == {g for g, _ in genomes}
    assert sorted(got.values()) == pytest.approx([60, 100], rel=0.15)
    assert (tmp_path / "out" / "strain.fasta").exists() and (tmp_path / "out" / "strain.paths").exists()


def test_pair_ends():
    rows = [("a", "d", 60.0, 60.0, 0, False), ("a", "e", 60.0, 40.0, 0, False), ("b", "d", 40.0, 60.0, 0, False), ("b", "e", 40.0, 40.0, 0, False)]
    assert sorted(pair_ends(rows)) == [("a", "d"), ("b", "e")]
    assert sorted(pair_ends([(u, w, i, o, 9 if u + w == "ae" else 0, s) for u, w, i, o, _, s in rows])) == [("a", "e")]
    close = [(u, w, {"a": 52.0, "b": 50.0}[u], {"d": 51.0, "e": 49.0}[w], 0, False) for u, w, *_ in rows]
    assert pair_ends(close) == []


def test_coverage_splits_what_links_do_not(spark):
    nodes = spark.createDataFrame([("a", 60.0), ("b", 40.0), ("c", 100.0), ("d", 60.0), ("e", 40.0)], "id string, dp double")
    edges = spark.createDataFrame([("a", "c"), ("b", "c"), ("c", "d"), ("c", "e")], "src string, dst string")
    none = spark.createDataFrame([], "a string, b string, cnt long")
    assert graph.split_balanced(nodes, edges, none, 3.0)[2].isEmpty()
    contigs = spark.createDataFrame([("1", 1, ["a", "c"], 60.0), ("2", 2, ["c", "e"], 40.0)], "name string, ord long, path array<string>, cov double")
    n, e, _, c = graph.disentangle(nodes, edges, none, 3.0, contigs)
    assert sorted(r["id"] for r in n.collect()) == ["a&c*0&d", "b&c*1&e"] and e.isEmpty()
    assert sorted(tuple(r["path"]) for r in c.collect()) == [("a&c*0&d",), ("b&c*1&e",)]


def test_links_outlive_contraction(spark):
    """Two branches in a row: links of a chain's parts decide the second one."""
    nodes = spark.createDataFrame([("a", 60.0), ("b", 55.0), ("c", 115.0), ("d", 60.0), ("e", 55.0), ("f", 115.0), ("g", 60.0), ("h", 55.0)], "id string, dp double")
    edges = spark.createDataFrame([("a", "c"), ("b", "c"), ("c", "d"), ("c", "e"), ("d", "f"), ("e", "f"), ("f", "g"), ("f", "h")], "src string, dst string")
    pe = spark.createDataFrame([("a", "d", 5), ("b", "e", 3), ("a", "g", 2), ("b", "h", 2)], "a string, b string, cnt long")
    n = graph.disentangle(nodes, edges, pe, 3.0)[0]
    assert sorted(r["id"] for r in n.collect()) == ["a&c*0&d&f*0&g", "b&c*1&e&f*1&h"]


def test_remap(spark):
    p = spark.createDataFrame([("1", 1, ["a", "b", "c"], 1.0), ("2", 2, ["b", "c"], 1.0), ("3", 3, ["b"], 1.0), ("4", 4, ["x", "y"], 1.0)], "name string, ord long, path array<string>, cov double")
    m = spark.createDataFrame([("b", "b*0"), ("b", "b*1")], "old string, new string")
    e = spark.createDataFrame([("a", "b*0"), ("b*0", "c"), ("b*1", "c")], "src string, dst string")
    get = lambda df: sorted((r["name"], r["path"]) for r in df.collect())
    assert get(paths.remap(p, m, e)) == [("1", ["a", "b*0", "c"]), ("2", ["c"]), ("4", ["x", "y"])]
    assert get(paths.remap(p, m, e, copies=True)) == [("1", ["a", "b*0", "c"]), ("2$0", ["b*0", "c"]), ("2$1", ["b*1", "c"]), ("3$0", ["b*0"]), ("3$1", ["b*1"]), ("4", ["x", "y"])]


def test_free_nodes():
    out, back = {"a": {"c"}, "b": {"c"}, "c": {"d", "e"}}, {"c": {"a", "b"}, "d": {"c"}, "e": {"c"}}
    pairs = link_pairs(out, back, {("a", "d"): 5, ("b", "e"): 3, ("a", "e"): 1})
    assert pairs == {"c": [("a", "d"), ("b", "e")]} and follow(["b"], out, pairs) == ["b", "c", "e"]
    got = extract_component({"x": 50.0, "y": 50.0}, [("x", "y")], [], {}, {"x": 700, "y": 10})
    assert got == [("Nx", ["x", "y"], 50.0)]


def test_cycles_and_ends(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "b"), ("c", "d"), ("e", "f")], "src string, dst string")
    assert sorted(map(tuple, graph.cyclic_core(edges).select("src", "dst").collect())) == [("b", "c"), ("c", "b")]
    assert graph.is_acyclic(edges.filter("src <> 'c'")) and not graph.is_acyclic(edges)
    nodes = spark.createDataFrame([(x, float(i)) for i, x in enumerate("abcdef")], "id string, dp double")
    got = sorted(map(tuple, graph.global_ends(nodes, edges).select("src", "dst").collect()))
    assert got == [("d", "sink"), ("f", "sink"), ("src", "a"), ("src", "e")]


def test_repeat_votes(spark):
    s = spark.createDataFrame([("s", ["1", "2", "3"])], "name string, path array<string>")
    c = spark.createDataFrame([("c", ["2", "3"], {"2": 2, "3": 1}), ("d", ["3", "4"], {"3": 9, "4": 1})], "name string, path array<string>, repeats map<string,int>")
    assert sorted(map(tuple, paths.repeat_votes(s, c).collect())) == [("s", "2", 2), ("s", "3", 1)]
