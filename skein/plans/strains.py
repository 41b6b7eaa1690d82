"""Strain extraction: walk contigs to both ends of the graph, take their coverage away, put the walk back as a node if an
end is still open, repeat.

Each walk depends on the coverage and the nodes that the ones before it left, so a component is one sequential task;
components are independent and run side by side. Disentangled graphs are small: thousands of nodes, not reads.
"""

from __future__ import annotations

import statistics

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.operators.paths import viable
from skein.operators.rounds import Rounds
from skein.session import ship

DELTA_SHARE = 0.05
#: Nodes longer than this that no contig led to are strains of their own.
FREE_LENGTH = 600


def weak_components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, comp): smallest id of the weakly connected component.

    Stars: every node's larger neighbours are linked to its smallest neighbour, then every node and its smaller neighbours
    to the smallest of them, until nothing changes; a chain of n nodes takes about log2(n) rounds.
    """
    rounds = Rounds(nodes.sparkSession)
    left = rounds.put(edges.filter("src <> dst").select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).distinct())
    state = F.struct(F.count("*").alias("c"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0)).alias("h"))
    before = None
    while True:
        both = left.union(left.select("v", "u"))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = rounds.put(both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v")
        left, now = rounds.counted(moved.union(least.select("u", "m")).distinct(), state)
        if now == before:
            return nodes.select("id").join(left, F.col("id") == F.col("u"), "left").select("id", F.coalesce("v", "id").alias("comp"))
        before = now


def nearest(x, ways, dp):
    """(distance, way) in coverage, the nearest first."""
    return sorted((abs(dp[w] - dp[x]), w) for w in ways)


def next_way(x, before, out, back, dp, pairs, cov, delta):
    """The way on from x, where a walk of coverage cov came from `before`; None if it isn't certain.

    With several ways: at a branch (a key of pairs) one linked with `before` is taken if it can carry about cov. Without
    a linked way the nearest to `before` in coverage is, if each is the other's nearest and no second one is within twice
    the distance, or delta; where one is, the walk ends. Else the best covered way is taken if only it can carry cov.
    """
    ways = out.get(x, ())
    if len(ways) < 2:
        return next(iter(ways), None)
    if before is not None and x in pairs:
        linked = sorted(w for w in ways if (before, w) in pairs[x])
        if len(linked) == 1 and dp[linked[0]] - cov > -2 * delta:
            return linked[0]
        if not linked:
            there = nearest(before, ways, dp)
            again = nearest(there[0][1], back.get(x, ()), dp)
            if again[0][1] == before:
                margin = max(2 * there[0][0], delta)
                return None if any(len(r) > 1 and r[1][0] <= margin for r in (there, again)) else there[0][1]
    first, second = sorted(ways, key=lambda w: (-dp[w], w))[:2]
    return first if dp[first] - cov > -delta and dp[second] - cov <= -delta else None


def walk(path, out, back, dp, pairs, cov, delta):
    """path, going on from its end while the next node is certain and new."""
    path, seen = list(path), set(path)
    while (to := next_way(path[-1], path[-2] if len(path) > 1 else None, out, back, dp, pairs, cov, delta)) is not None and to not in seen:
        path.append(to)
        seen.add(to)
    return path


def extend(path, out, dp, links, cov, delta):
    """walk() by links {(u, w): count} that hold around every node."""
    back = {}
    for s, ts in out.items():
        for t in ts:
            back.setdefault(t, set()).add(s)
    linked = {k for k, n in links.items() if n > 0}
    return walk(path, out, back, dp, dict.fromkeys(out, linked), cov, delta)


def link_pairs(out, back, links):
    """{branch: [(u, w)]}: pairs of free ends by links, most first, around nodes with several ways in and several out."""
    found = {}
    for x in out:
        least = max(1, len(set(out[x]) & set(back.get(x, ()))))
        if len(out[x]) > least and len(back.get(x, ())) > least:
            ways = sorted((-links[u, w], u, w) for u in back[x] for w in out[x] if links.get((u, w), 0) > 0)
            used_u, used_w = set(), set()
            for _, u, w in ways:
                if u not in used_u and w not in used_w:
                    used_u.add(u)
                    used_w.add(w)
                    found.setdefault(x, []).append((u, w))
    return found


def follow(path, out, pairs):
    """Walks from the end of path over only ways on and, at branches, the way paired with the node before."""
    path, seen = list(path), set(path)
    while True:
        x = path[-1]
        ways = sorted(out.get(x, ()))
        if len(ways) > 1:
            ways = [w for u, w in pairs.get(x, ()) if len(path) > 1 and u == path[-2]]
        if len(ways) != 1 or ways[0] in seen:
            return path
        path.append(ways[0])
        seen.add(ways[0])


class Component:
    """A graph that changes: dp by node; flows of edges both ways, as {node: {neighbour: flow}}; by node also its length,
    the nodes of the first graph that it spells, and how often it was walked."""

    def __init__(self, dp, edges, lengths=None, overlap=0):
        self.dp, self.overlap = dict(dp), overlap
        self.out, self.back = {v: {} for v in dp}, {v: {} for v in dp}
        self.size = {v: (lengths or {}).get(v, 1) for v in dp}
        self.spells, self.used = {v: (v,) for v in dp}, dict.fromkeys(dp, 0)
        for s, t in edges:
            self.join(s, t, 0.0)
        self.reflow()

    def join(self, s, t, flow):
        self.out[s][t] = self.back[t][s] = flow

    def add(self, node, dp, like=None, path=()):
        """A node that spells what `like` does, or a path."""
        self.dp[node], self.out[node], self.back[node] = dp, {}, {}
        self.size[node] = self.size[like] if like else self.length(path)
        self.spells[node] = self.spells[like] if like else tuple(x for v in path for x in self.spells[v])
        self.used[node] = self.used[like] if like else 0

    def drop(self, node):
        for t in self.out.pop(node):
            self.back[t].pop(node, None)
        for s in self.back.pop(node):
            self.out.get(s, {}).pop(node, None)
        for table in (self.dp, self.size, self.spells, self.used):
            table.pop(node)

    def length(self, path):
        return sum(self.size[v] for v in path) - self.overlap * max(0, len(path) - 1)

    def reflow(self):
        """Edge flows from the nodes' coverage: each end shares its own among its edges by the other ends' coverage."""
        share = lambda v, t, near: self.dp[t] / total if (total := sum(self.dp[x] for x in near[v])) else 0.0
        for s in self.out:
            for t in self.out[s]:
                self.join(s, t, (share(s, t, self.out) * self.dp[s] + share(t, s, self.back) * self.dp[t]) / 2)

    def branches(self):
        return [x for x in sorted(self.dp) if min(len(self.out[x]), len(self.back[x])) > max(1, len(self.out[x].keys() & self.back[x].keys()))]

    def fork(self):
        """Every node with one way on one side and several on the other becomes a copy for each of these, with that edge's
        flow, in order of id and until there is none; at most as many as nodes squared. {node: what it is now}."""
        first = {v: v for v in self.dp}
        most, done, todo = len(self.dp) ** 2, 0, sorted(self.dp)
        while todo and done < most:
            todo_next = set()
            for v in todo:
                if v not in self.dp or (len(self.out[v]) == 1) == (len(self.back[v]) == 1) or not self.out[v] or not self.back[v]:
                    continue
                many, one = (self.out, self.back) if len(self.back[v]) == 1 else (self.back, self.out)
                (single,), made = one[v], []
                for i, (other, flow) in enumerate(sorted(many[v].items())):
                    copy = f"{v}*{chr(65 + i) if i < 26 else i}"
                    self.add(copy, flow, like=v)
                    for s, t in ((single, copy), (copy, other)) if many is self.out else ((other, copy), (copy, single)):
                        self.join(s, t, flow)
                    made.append(copy)
                    first[copy] = first[v]
                todo_next |= {*made, *self.out[v], *self.back[v]}
                self.drop(v)
                done += 1
            todo = sorted(todo_next)
        self.reflow()
        now = {}
        for v in self.dp:
            now.setdefault(first[v], set()).add(v)
        return now

    def reduce(self, path, cov, delta):
        """Takes a walk's coverage away; nodes left with delta or less go."""
        for v in path:
            self.used[v] += 1
            self.dp[v] -= cov
        for v in [v for v in path if self.dp[v] <= delta]:
            self.drop(v)

    def bubble_cov(self, path, other):
        """The median coverage of a path's nodes with one way in and one out; without any, `other`."""
        inner = [self.dp[v] for v in path if len(self.out[v]) == len(self.back[v]) == 1]
        return statistics.median(inner) if inner else other


def supported_pairs(g, contigs, links):
    """{branch: {(u, w)}}: pairs around a branch that a contig goes through, that are one node, or that reads link."""
    through = {t for _, path, _ in contigs for t in zip(path, path[1:], path[2:])}
    return {x: {(u, w) for u in g.back[x] for w in g.out[x] if (u, x, w) in through or u == w or links.get((u, w), 0) > 0} for x in g.branches()}


def moved_contigs(contigs, now, g):
    """Contigs along what their nodes have become: the only way along edges; of several ways, the nodes common to all;
    none at all leaves a contig as it is."""
    out = []
    for name, path, cov in contigs:
        ways = [now.get(v, {v}) for v in path]
        ok = viable(ways, [{(s, t) for s in a for t in b if t in g.out.get(s, ())} for a, b in zip(ways, ways[1:])])
        path = path if ok is None else [min(x) for x in ok if len(x) == 1]
        if path:
            out.append((name, path, cov))
    return out


def moved_pairs(pairs, now, g):
    """Pairs around the branches that are left, where one end has not been copied or both ends still are neighbours."""
    out = {}
    for x, kept in pairs.items():
        if x in g.dp:
            both = [(now.get(u, {u}), now.get(w, {w})) for u, w in kept]
            out[x] = {(u, w) for us, ws in both if 1 in (len(us), len(ws)) for u in us for w in ws if u in g.back[x] and w in g.out[x]}
    return out


def extract_component(nodes, edges, contigs, links, lengths=None, delta=None, overlap=0, pristine=None):
    """Strains (name, path, cov) of one component. nodes: {id: dp}; edges: (src, dst) pairs; contigs: (name, path, cov) in
    order; links: {(u, w): count}. Longest contig first (ties: in order). With lengths ({id: length}), nodes over
    FREE_LENGTH that no walk used are walked as well, along links only: those of `pristine`, where it is given.

    Before each walk all forks are opened, and contigs and pairs follow; contigs that lead to no walk leave all as it is, so
    the next in order has its turn without that. A walk's nodes lose its coverage. If the graph
    goes on at an end of the walk, the rest of the walk becomes a node beside that end, which later walks may go through;
    such a walk then takes the place of the strain that is part of it.
    """
    if not nodes:
        return []
    delta = DELTA_SHARE * statistics.median(nodes.values()) if delta is None else delta
    g = Component(nodes, edges, lengths, overlap)
    both = lambda x: {**x, **{(w, u): n for (u, w), n in x.items()}}
    links, free = both(links), both(links if pristine is None else pristine)
    contigs = [(name, list(path), cov) for name, path, cov in contigs if set(path) <= g.dp.keys()]
    pairs, found = supported_pairs(g, contigs, links), {}

    def add(key, name, path, cov):
        for v in path:
            found.pop(v, None)
        found[key] = name, [x for v in path for x in g.spells[v]], cov

    turn, taken, same = [], set(), False  # contigs in order of length; those that had their turn; whether all is as it was
    for nth in range(len(contigs)):
        if not same:
            contigs, taken = [c for i, c in enumerate(contigs) if i not in taken], set()
            if not contigs:
                break
            now = g.fork()
            contigs, pairs = moved_contigs(contigs, now, g), moved_pairs(pairs, now, g)
            same = all(now.get(v) == {v} for v in g.dp)  # else forks are looked for again
            turn = sorted(range(len(contigs)), key=lambda i: (g.length(contigs[i][1]) if set(contigs[i][1]) <= g.dp.keys() else -1, -i))
        if not turn:
            break
        taken.add(turn[-1])
        name, path, cov = contigs[turn.pop()]
        if not set(path) <= g.dp.keys() or all(g.used[v] for v in path):
            continue
        own = g.bubble_cov(path, cov)
        whole = walk(path, g.out, g.back, g.dp, pairs, min(cov, own), delta)
        mirrored = {x: {(w, u) for u, w in p} for x, p in pairs.items()}
        whole = walk(whole[::-1], g.back, g.out, g.dp, mirrored, min(cov, own), delta)[::-1]
        cov = min(cov, own, g.bubble_cov(whole, cov))
        key = f"@{nth}"
        add(key, name, whole, cov)
        before, after = bool(g.back[whole[0]]), bool(g.out[whole[-1]])
        inner = whole[1 if before else 0 : len(whole) - 1 if after else len(whole)]
        if not before and not after:
            g.reduce(whole, cov, delta)
        elif len(whole) > 1:
            if inner:
                g.add(key, cov, path=inner)
                if before:
                    g.join(whole[0], key, cov)
                if after:
                    g.join(key, whole[-1], cov)
            g.reduce(inner, cov, delta)
        g.reflow()
        contigs, taken, same = [c for i, c in enumerate(contigs) if i not in taken and set(c[1]) <= g.dp.keys()], set(), False
        pairs = {x: {(u, w) for u, w in p if u in g.dp and w in g.dp} for x, p in pairs.items() if x in g.dp}

    # of nodes that spell the same, the best covered one stays
    best = {}
    for v in sorted(g.dp, key=lambda v: (-g.dp[v], v)):
        if best.setdefault(g.spells[v], v) != v:
            g.drop(v)
    g.reflow()
    if lengths:
        count = lambda u, w: sum(free.get((a, b), 0) for a in g.spells[u] for b in g.spells[w])
        linked = {(u, w): count(u, w) for x in g.branches() for u in g.back[x] for w in g.out[x]}
        around = link_pairs(g.out, g.back, linked)
        turned = {x: [(w, u) for u, w in p] for x, p in around.items()}
        for v in sorted((v for v in g.dp if g.size[v] > FREE_LENGTH), key=lambda v: (-g.size[v], v)):
            if not g.used[v]:
                whole = follow([v], g.out, around)
                whole = follow(whole[::-1], g.back, turned)[::-1]
                add(f"N{v}", f"N{v}", whole, g.bubble_cov(whole, g.dp[v]))
                for x in whole:
                    g.used[x] += 1
    return [s for s in found.values() if s[2] > 2 * delta]


def strains(nodes: DataFrame, edges: DataFrame, contigs: DataFrame, links: DataFrame, delta: float | None = None, overlap: int = 0, pristine: DataFrame | None = None) -> DataFrame:
    """(name, path, cov, nth) over all components, nth counting those of a component in the order they are found. nodes (id,
    dp[, len]), edges (src, dst), contigs (name, ord, path, cov), links (a, b, cnt); pristine are links for nodes that no contig led to, if others than those. delta is 0.05 medians of a
    component's coverage unless given; neighbours overlap by so many letters."""
    ship(nodes.sparkSession)
    measured = "len" in nodes.columns
    comp = Rounds(nodes.sparkSession).put(weak_components(nodes, edges))
    size = F.col("len").cast("double") if measured else F.lit(0.0)
    none = F.array().cast("array<string>")
    n = nodes.join(comp, "id").select("comp", F.lit(0).alias("kind"), F.col("id").alias("a"), F.lit("").alias("b"), F.col("dp").alias("x"), size.alias("y"), none.alias("path"))
    e = edges.join(comp, edges["src"] == comp["id"]).select("comp", F.lit(1), "src", "dst", F.lit(0.0), F.lit(0.0), none)
    c = contigs.join(comp, contigs["path"][0] == comp["id"]).select("comp", F.lit(2), "name", F.lpad(F.col("ord").cast("string"), 20, "0"), "cov", F.lit(0.0), "path")
    li = links.join(comp, links["a"] == comp["id"]).select("comp", F.lit(3), "a", "b", F.col("cnt").cast("double"), F.lit(0.0), none)
    rows = n.unionAll(e).unionAll(c).unionAll(li)
    with_free = pristine is not None
    if with_free:
        rows = rows.unionAll(pristine.join(comp, pristine["a"] == comp["id"]).select("comp", F.lit(4), "a", "b", F.col("cnt").cast("double"), F.lit(0.0), none))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        part = {k: g for k, g in pdf.groupby("kind")}
        get = lambda k: part.get(k, pdf.iloc[:0])
        ns, es, cs, ls, fs = get(0), get(1), get(2).sort_values(["b", "a"]), get(3), get(4)
        lengths = dict(zip(ns.a, ns.y)) if measured else None
        free = None if not with_free else dict(zip(zip(fs.a, fs.b), fs.x))
        found = extract_component(dict(zip(ns.a, ns.x)), list(zip(es.a, es.b)), [(a, list(p), x) for a, p, x in zip(cs.a, cs.path, cs.x)], dict(zip(zip(ls.a, ls.b), ls.x)), lengths, delta, overlap, free)
        return pd.DataFrame([(n, p, float(x), k) for k, (n, p, x) in enumerate(found)], columns=["name", "path", "cov", "nth"])

    return rows.groupBy("comp").applyInPandas(run, "name string, path array<string>, cov double, nth long")
