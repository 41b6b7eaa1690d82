"""Peeling in few rounds, strongly connected parts, cycle breaking, exact ranks, hot k-mers and what nodes are made of."""

import collections
import random

import pytest
from pyspark.sql import functions as F

from skein.operators import cycles, graph, links, overlaps, provenance, reach
from skein.operators.rounds import Rounds


@pytest.fixture
def written(monkeypatch):
    """How many tables are written."""
    count, put = [0], Rounds.put

    def counted(self, df):
        count[0] += 1
        return put(self, df)

    monkeypatch.setattr(Rounds, "put", counted)
    return count


def plain_peel(edges):
    left = set(range(len(edges)))
    while True:
        at = collections.Counter(("s", edges[k][0]) for k in left) + collections.Counter(("t", edges[k][1]) for k in left)
        free = {k for k in left if at["s", edges[k][0]] == 1 or at["t", edges[k][1]] == 1}
        if not free:
            return {edges[k] for k in range(len(edges)) if k not in left}
        left -= free


def test_clean_edges_equals_peeling(spark):
    rng = random.Random(4)
    every, want = [], set()
    for g in range(60):
        n = rng.randint(1, 14)
        edges = list({(f"{g}.{rng.randrange(n)}", f"{g}.{rng.randrange(n)}") for _ in range(rng.randint(1, 2 * n))})
        if g % 3 == 0:  # a tail, and trees of trees
            edges += [(f"{g}.0", f"{g}.x0")] + [e for k in range(rng.randint(1, 12)) for e in ((f"{g}.y{k}", f"{g}.x{k}"), (f"{g}.y{k}", f"{g}.x{k + 1}"))]
        edges = list(dict.fromkeys(edges))
        every += edges
        want |= plain_peel(edges)
    got = graph.clean_edges(spark.createDataFrame(every, "src string, dst string")).collect()
    assert len(got) == len(every) and {(r["src"], r["dst"]) for r in got if r["assigned"]} == want


def test_long_zigzag_takes_few_rounds(spark, written):
    edges = [e for k in range(400) for e in ((f"s{k}", f"t{k}"), (f"s{k}", f"t{k + 1}"))]
    df = spark.createDataFrame(edges, "src string, dst string")
    assert graph.clean_edges(df).filter("assigned and kept").count() == len(edges)
    assert written[0] < 60  # an edge an end and round would be 400 rounds
    ring = df.unionByName(spark.createDataFrame([("s400", "t400"), ("s400", "t0")], df.schema))
    assert graph.clean_edges(ring).filter("assigned").isEmpty()


def test_ends_that_are_both(spark):
    df = spark.createDataFrame([("a", "a"), ("a", "b"), ("b", "a"), ("b", "b"), ("c", "a")], "src string, dst string")
    got = {(r["src"], r["dst"]): (r["assigned"], r["kept"]) for r in graph.clean_edges(df).collect()}
    assert got == {("a", "a"): (False, False), ("a", "b"): (False, True), ("b", "a"): (False, False), ("b", "b"): (False, True), ("c", "a"): (True, True)}
    assert graph.clean_edges(df.limit(0)).count() == 0


def plain_parts(edges):
    reach = {v: {v} for e in edges for v in e}
    out = collections.defaultdict(set)
    for s, t in edges:
        out[s].add(t)
    for v in reach:
        todo = [v]
        while todo:
            for w in out[todo.pop()]:
                if w not in reach[v]:
                    reach[v].add(w)
                    todo.append(w)
    parts = {v: min(w for w in reach[v] if v in reach[w]) for v in reach}
    size = collections.Counter(parts.values())
    return {v: p for v, p in parts.items() if size[p] > 1 or (v, v) in edges}


def some_graphs():
    rng = random.Random(11)
    out = []
    for g in range(17):
        n = rng.randint(1, 12)
        name = lambda k: f"{g}.{k}"  # noqa: E731, B023
        edges = {(name(rng.randrange(n)), name(rng.randrange(n))) for _ in range(rng.randint(1, 2 * n))}
        if g % 4 == 0:  # a ring, with a way in and out in some
            m = rng.randint(2, 15)
            edges |= {(f"{g}.r{k:02}", f"{g}.r{(k + 1) % m:02}") for k in range(m)}
            edges |= {(name(0), f"{g}.r00")} if g % 8 == 0 else set()
        if g % 5 == 0:  # a long chain back to the start
            edges |= {(name(0), f"{g}.c00"), (f"{g}.c09", name(0))} | {(f"{g}.c{k:02}", f"{g}.c{k + 1:02}") for k in range(9)}
        out.append(edges)
    return out


def test_strongly_connected(spark):
    graphs = some_graphs()
    df = spark.createDataFrame([e for g in graphs for e in g], "src string, dst string")
    want = {}
    for g in graphs:
        want |= plain_parts(g)
    assert {r["id"]: r["scc"] for r in cycles.strongly_connected(df).collect()} == want
    assert cycles.strongly_connected(df.limit(0)).count() == 0


def test_break_cycles(spark):
    graphs = some_graphs()[:6]
    edges = spark.createDataFrame([e for g in graphs for e in g], "src string, dst string")
    ids = sorted({v for g in graphs for e in g for v in e})
    nodes = spark.createDataFrame([(v, float((k * 37) % 101)) for k, v in enumerate(ids)], "id string, dp double")
    left, removed = cycles.break_cycles(nodes, edges)
    assert graph.is_acyclic(left)
    kept, gone = {tuple(r) for r in left.collect()}, {tuple(r) for r in removed.collect()}
    whole = {e for g in graphs for e in g}
    assert kept | gone == whole and not kept & gone
    parts = plain_parts(whole)
    assert all(parts.get(s) is not None and parts.get(s) == parts.get(t) for s, t in gone)  # nothing outside cycles goes
    plain = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "d")], "src string, dst string")
    for b, want in ((1.0, ("b", "c")), (3.0, ("c", "a"))):
        depth = spark.createDataFrame([("a", 2.0), ("b", b), ("c", 9.0), ("d", 8.0)], "id string, dp double")
        assert [tuple(r) for r in cycles.break_cycles(depth, plain)[1].collect()] == [want]
    assert cycles.break_cycles(nodes, edges.filter("src = 'none'"))[1].count() == 0


@pytest.mark.parametrize("n", [0, 1, 2, 5, 30_001, 30_002])
def test_median_is_exact(spark, n):
    rng = random.Random(n)
    for kind in range(3):
        values = [[rng.random() * 1e6, 2.0 ** rng.randint(-900, 900), float(rng.choice([1, 1, 1, 2, 7]))][kind] for _ in range(n)]
        df = spark.createDataFrame([(v,) for v in values] + [(None,)], "dp double")
        s = sorted(values)
        want = None if not n else s[n // 2] if n % 2 else (s[n // 2 - 1] + s[n // 2]) / 2
        assert graph.median(df, "dp") == want
        for rank in (0, n // 3, n - 1, n):
            assert graph.ranked(df, "dp", rank) == (s[rank] if 0 <= rank < n else None)


def plain_hits(pairs, nodes, k):
    rc = lambda s: s[::-1].translate(str.maketrans("ACGT", "TGCA"))
    out = {}
    for pair, *mates in pairs:
        if any(len(m) < k or "N" in m for m in mates):
            continue
        for mate, read in enumerate(mates):
            for node, seq in nodes:
                found = [(j, i) for i in range(len(read) - k + 1) for j in range(len(seq) - k + 1) for w in (seq[j : j + k], rc(seq[j : j + k])) if w == read[i : i + k]]
                if found:
                    out[pair, mate, node] = (len(read), len(seq), len(found), min(j for j, _ in found), min(i for _, i in found))
    return out


def test_hot_kmers_are_dealt_out(spark, monkeypatch):
    """A k-mer of one letter in half of all windows, and in many nodes: same hits, and no cell has most of the rows."""
    monkeypatch.setattr(links, "CELL_READS", 20)
    monkeypatch.setattr(links, "CELL_NODES", 5)
    monkeypatch.setattr(links, "SAMPLE", 1)
    rng, k = random.Random(3), 6
    word = lambda n: "".join(rng.choice("ACGT") for _ in range(n))
    nodes = [(f"n{j}", word(12) + ("A" * 9 if j % 2 else "") + word(12)) for j in range(24)]
    pairs = [(i, "A" * 14 + word(8) if i % 2 else nodes[i % 24][1][3:20], word(4) + "A" * rng.randint(3, 12) + word(4)) for i in range(120)] + [(900, "ACGTNACGT", "ACGTACGTA"), (901, "ACG", "ACGTACGTA")]
    p, n = spark.createDataFrame(pairs, "pair long, fseq string, rseq string"), spark.createDataFrame(nodes, "node string, seq string")
    got = {(r["pair"], r["mate"], r["node"]): (r["read_len"], r["node_len"], r["hits"], r["node_pos"], r["read_pos"]) for r in links.hits(p, n, k).collect()}
    assert got == plain_hits(pairs, nodes, k)
    seen = []
    monkeypatch.setattr(links, "deal_hits", lambda *a, f=links.deal_hits: seen.append(f(*a)) or seen[-1])
    links.hits(p, n, k)
    left, right = seen[0]
    assert left.filter("kmer = 'AAAAAA'").select("r").distinct().count() >= 5  # 60 reads and more, some 20 a row
    for side in (left, right):
        cells = [r["count"] for r in side.groupBy("kmer", "r", "c").count().collect()]
        assert max(cells) <= 40
    assert links.hits(p.limit(0), n, k).count() == links.hits(p, n.limit(0), k).count() == 0


def test_windows_counted(spark):
    from skein.functions.sequence import windows

    df = spark.createDataFrame([(1, "AAAAACAAAA"), (2, "AC"), (3, None), (4, "éAéAéA")], "i int, s string")
    got = {(r["i"], r["kmer"]): (r["pos"], r["n"]) for r in windows(df, "s", 3, ["i"], counted=True).collect()}
    want = {}
    for r in windows(df, "s", 3, ["i"]).orderBy("i", "pos").collect():
        first, n = want.get((r["i"], r["kmer"]), (r["pos"], 0))
        want[r["i"], r["kmer"]] = (first, n + 1)
    assert got == want


def test_links_follow_splits_and_contractions(spark):
    nodes = spark.createDataFrame([(x, 1.0) for x in "abcde"], "id string, dp double")
    pe = spark.createDataFrame([("a", "c", 5), ("b", "c", 2), ("c", "d", 3), ("d", "e", 7)], "a string, b string, cnt long")
    parts = provenance.start(nodes)
    parts = provenance.follow(parts, spark.createDataFrame([("c", "c*0"), ("c", "c*1")], "old string, new string"), copies=True)
    parts = provenance.follow(parts, spark.createDataFrame([("a", "a&c*0"), ("c*0", "a&c*0")], "old string, new string"), copies=False)
    of = lambda **x: {(r["a"], r["b"]): r["cnt"] for r in provenance.links_of(pe, parts, **x).collect()}
    assert of() == {("a&c*0", "b"): 2, ("a&c*0", "d"): 3, ("a&c*0", "c*1"): 5, ("b", "c*1"): 2, ("c*1", "d"): 3, ("d", "e"): 7}
    assert of(copies=False) == {("d", "e"): 7}
    assert parts.filter("id = 'a&c*0'").select(F.count_if("copied")).first()[0] == 1


def plain_joins(rows, least=1):
    fits = {}
    for a, p in rows:
        for b, q in rows:
            n = max((n for n in range(least, min(len(p), len(q))) if p[-n:] == q[:n]), default=0)
            if n:
                fits[a, b] = n
    first, last = collections.Counter(a for a, _ in fits), collections.Counter(b for _, b in fits)
    return {(a, b, n) for (a, b), n in fits.items() if a != b and first[a] == last[b] == 1}


def test_overlapping_paths(spark):
    rng = random.Random(9)
    for _ in range(4):
        rows = [(f"p{k}", [str(rng.randrange(14)) for _ in range(rng.randint(1, 5))]) for k in range(12)]
        rows += [("r1", ["u", "v", "w"]), ("r2", ["w", "u"]), ("s", ["y", "z", "y"]), ("t1", ["h", "i", "j"]), ("t2", ["i", "j", "k"]), ("t3", ["k", "l"])]
        df = spark.createDataFrame([(n, k, p, float(k + 1)) for k, (n, p) in enumerate(rows)], "name string, ord long, path array<string>, cov double")
        assert {tuple(r) for r in overlaps.overlaps(df).collect()} == plain_joins(rows)
        got = {r["name"]: r["path"] for r in overlaps.overlap_joined(df).collect()}
        assert got["t1&t2&t3"] == list("hijkl") and got["r1"] == list("uvw") and got["s"] == list("yzy")
        assert sorted(n for name in got for n in name.split("&")) == sorted(n for n, _ in rows)
    assert overlaps.overlap_joined(df.limit(0)).count() == 0


def test_reach_index(spark):
    graphs = some_graphs()[:9]
    edges = {e for g in graphs for e in g}
    df = spark.createDataFrame(sorted(edges), "src string, dst string")
    want, step = set(edges), set(edges)
    while step:
        step = {(a, d) for a, b in step for c, d in edges if b == c} - want
        want |= step
    index = reach.reach_index(df)
    ids = sorted({v for e in edges for v in e})
    assert {tuple(r) for r in reach.reached_from(index, spark.createDataFrame([(v,) for v in ids], "id string")).collect()} == want
    rng = random.Random(1)
    pairs = [(rng.choice(ids), rng.choice(ids)) for _ in range(500)] + [(v, v) for v in ids] + [("none", ids[0]), (ids[0], "none")]
    got = reach.reaches(index, spark.createDataFrame(pairs, "source string, id string")).collect()
    assert len(got) == len(pairs) and all(r["reached"] == ((r["source"], r["id"]) in want) for r in got)
    assert index.labels.count() < len(want)  # fewer than the pairs themselves
