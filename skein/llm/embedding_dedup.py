"""Embedding near-dedup: cover trees of blocks of vectors, walked two at a time, give every pair above a cosine.

A tree has levels of halving radii. Nodes of a level are further apart than its radius, every vector is within it of a node,
and nodes of a level are nodes of the next. Two nodes whose distance is more than the threshold's and their covering radii
together hold no pair and are dropped; two nodes so near that all their vectors must be within the threshold are counted
whole; children of others are held against each other. Distances are chords between unit vectors.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, hot_join, release, row_keys, table
from .components import components

COSINE = 0.95
#: Radii of a tree's levels below its root; below the last one nodes are single vectors.
RADII = [1.0, 0.5, 0.25, 0.125]
#: Vectors of a tree, fewer where they are long: BLOCK_NUMBERS components at most.
BLOCK, BLOCK_NUMBERS = 1024, 1 << 19
#: Vectors in a group of trees; each two groups meet in one task. The least and the most of them, and groups aimed at between.
LEAST, MOST, GROUPS = 2048, 16384, 8
#: Vectors of a bounded sample that rows are first dealt out by, so that near ones share a tree where they can.
PIVOTS = 256
#: Pairs of vectors below nodes that are compared at once rather than by another step down.
SMALL = 256
#: What single precision may add to a cosine, and more; nearer to the threshold, sums are double. Bounds have it as slack.
ROUNDING = 2e-5


def unit(rows: np.ndarray) -> np.ndarray:
    """Rows of length one, in double precision; scaled first, so that no square overflows or vanishes."""
    x = rows.astype(np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def cosine(x: np.ndarray, y: np.ndarray) -> float:
    """The cosine of two vectors with exact sums, for pairs that lie on the threshold as far as rounding tells."""
    a, b = unit(x[None])[0].tolist(), unit(y[None])[0].tolist()
    dot = math.fsum(u * v for u, v in zip(a, b))
    return dot / math.sqrt(math.fsum(u * u for u in a) * math.fsum(v * v for v in b))


class CoverTree:
    """Levels of nodes over rows of vectors, which are put in the order of the tree: a node's vectors lie side by side."""

    def __init__(self, rows: np.ndarray, keys: np.ndarray, members: np.ndarray):
        x = unit(rows)
        like = x @ x.T
        # the vector farthest from those taken so far is taken next; so at any radius the ones taken farther than that
        # are farther apart than it and cover all others
        far, gap, taken = np.full(len(x), np.inf), [], []
        nxt = 0
        while far[nxt] > RADII[-1]:
            taken.append(nxt)
            gap.append(far[nxt])
            far = np.minimum(far, np.sqrt(np.maximum(0, 2 - 2 * like[nxt])))
            nxt = int(np.argmax(far))
        taken, gap = np.array(taken), np.array(gap)
        nodes = [taken[:1], *(taken[gap > r] for r in RADII), np.arange(len(x))]
        up = [np.argmax(like[np.ix_(below, above)], axis=1) for above, below in zip(nodes, nodes[1:])]
        above = [up[-1]]  # of each level but the last, the node over each vector
        for parent in reversed(up[:-1]):
            above.append(parent[above[-1]])
        above.reverse()
        order = np.lexsort([np.arange(len(x)), *reversed(above)])
        self.rows, self.keys, self.members, self.x = rows[order], keys[order], members[order], x[order]
        self.single = self.x.astype(np.float32)
        place = np.empty(len(x), np.int64)
        place[order] = np.arange(len(x))
        self.center, self.radius, self.first, self.child = [], [], [], []  # center: the places of the nodes' vectors
        for level, centers in enumerate(nodes[:-1]):
            own = above[level]
            reach = np.zeros(len(centers))
            np.maximum.at(reach, own, np.sqrt(np.maximum(0, 2 - 2 * like[np.arange(len(x)), centers[own]])))
            seen = own[order]  # nodes in the order of the tree
            starts = np.flatnonzero(np.concatenate([[True], seen[1:] != seen[:-1]]))
            rank = seen[starts]
            self.center.append(place[centers[rank]])
            self.radius.append(np.where(np.diff(np.append(starts, len(x))) > 1, reach[rank], 0.0))
            self.first.append(np.append(starts, len(x)))
        self.center.append(np.arange(len(x)))
        self.radius.append(np.zeros(len(x)))
        self.first.append(np.arange(len(x) + 1))
        total = np.concatenate([[0], np.cumsum(self.members)])
        for first, below in zip(self.first, self.first[1:]):
            self.child.append(np.searchsorted(below, first))
        self.weight = [total[f[1:]] - total[f[:-1]] for f in self.first]

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k not in ("x", "single")}  # made again from the rows

    def __setstate__(self, state: dict) -> None:
        self.__dict__ |= state
        self.x = unit(self.rows)
        self.single = self.x.astype(np.float32)


class Found:
    """How many vectors link with each of a task's, and links enough to join what belongs together."""

    def __init__(self, size: int):
        self.count, self.size = np.zeros(size, np.int64), size
        self.label, self.held, self.waiting = np.arange(size), [], 0

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        self.held.append((a, b))
        self.waiting += len(a)
        if self.waiting > 500_000:
            self.settle()

    def settle(self) -> None:
        """label: the smallest place that a chain of links leads to."""
        if not self.held:
            return
        a, b = (np.concatenate(x) for x in zip(*self.held))
        self.held, self.waiting = [], 0
        while True:
            x, y = self.label[a], self.label[b]
            apart = x != y
            if not apart.any():
                return
            a, b, x, y = a[apart], b[apart], x[apart], y[apart]
            np.minimum.at(self.label, np.maximum(x, y), np.minimum(x, y))
            while (deeper := self.label[self.label] != self.label).any():
                self.label[deeper] = self.label[self.label[deeper]]


def _below(first: np.ndarray, nodes: np.ndarray, others_first: np.ndarray, others: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Every vector below each node with every one below its other."""
    na, nb = first[nodes + 1] - first[nodes], others_first[others + 1] - others_first[others]
    pairs = na * nb
    k = np.arange(pairs.sum()) - np.repeat(np.cumsum(pairs) - pairs, pairs)
    nb = np.repeat(nb, pairs)
    return np.repeat(first[nodes], pairs) + k // nb, np.repeat(others_first[others], pairs) + k % nb


def walk(a: CoverTree, b: CoverTree, at_a: int, at_b: int, found: Found, threshold: float = COSINE) -> None:
    """Adds all pairs of two trees, or of one with itself; their vectors have places from at_a and at_b on."""
    same, chord = a is b, math.sqrt(2 - 2 * threshold)

    def vectors(u: np.ndarray, v: np.ndarray, like: np.ndarray) -> None:
        """Pairs of single vectors, with their cosines in single precision."""
        ok = like >= threshold
        near = np.flatnonzero(np.abs(like - threshold) <= ROUNDING)
        if len(near):
            exact = np.einsum("ij,ij->i", a.x[u[near]], b.x[v[near]])
            ok[near] = exact >= threshold
            for k in near[np.abs(exact - threshold) < 1e-12]:
                ok[k] = cosine(a.rows[u[k]], b.rows[v[k]]) >= threshold
        if same:
            ok &= u != v
        u, v = u[ok], v[ok]
        if len(u):
            found.count[at_a : at_a + len(a.keys)] += np.bincount(u, b.members[v], len(a.keys)).astype(np.int64)
            if not same:
                found.count[at_b : at_b + len(b.keys)] += np.bincount(v, a.members[u], len(b.keys)).astype(np.int64)
            found.link(at_a + u, at_b + v)

    def whole(fa: np.ndarray, fb: np.ndarray, p: int, q: int, wa: int, wb: int) -> None:
        """Two nodes of which every two vectors link."""
        left, right = np.arange(fa[p], fa[p + 1]), np.arange(fb[q], fb[q + 1])
        found.count[at_a + left] += wb
        if not same:
            found.count[at_b + right] += wa
        elif fa[p] == fb[q]:
            found.count[at_a + left] -= a.members[left]
        found.link(at_a + left, np.full(len(left), at_b + right[0]))
        found.link(np.full(len(right), at_a + left[0]), at_b + right)

    far = math.sqrt(max(0.0, 2 - 2 * float(a.x[a.center[0][0]] @ b.x[b.center[0][0]]))) - a.radius[0][0] - b.radius[0][0]
    todo = [(0, 0, 0)] if far <= chord + ROUNDING else []
    while todo:
        level, i, j = todo.pop()
        ca, cb = slice(a.child[level][i], a.child[level][i + 1]), slice(b.child[level][j], b.child[level][j + 1])
        level += 1
        ra, rb = a.radius[level][ca], b.radius[level][cb]
        like = a.single[a.center[level][ca]] @ b.single[b.center[level][cb]].T
        # for every node the bound with the widest of the others, then for what is left the bound of the two
        least = (1 - ROUNDING - (chord + ra + rb.max()) ** 2 / 2).astype(np.float32)
        x, y = np.nonzero(like >= least[:, None])
        close, reach = like[x, y], ra[x] + rb[y]
        keep = 2 * close + (chord + reach) ** 2 >= 2 - 2 * ROUNDING
        x, y, close, reach = x[keep], y[keep], close[keep], reach[keep]
        if not len(x):
            continue
        fa, fb = a.first[level][ca.start : ca.stop + 1], b.first[level][cb.start : cb.stop + 1]
        pairs = (fa[x + 1] - fa[x]) * (fb[y + 1] - fb[y])
        one = pairs == 1
        vectors(fa[x[one]], fb[y[one]], close[one])
        x, y, close, reach, pairs = x[~one], y[~one], close[~one], reach[~one], pairs[~one]
        # single precision is coarse for short distances
        all_ = np.sqrt(np.maximum(0, 2 - 2 * close.astype(np.float64)) + 2 * ROUNDING) + reach <= chord - 1e-6
        wa, wb = a.weight[level][ca], b.weight[level][cb]
        for p, q in zip(x[all_].tolist(), y[all_].tolist()):
            whole(fa, fb, p, q, wa[p], wb[q])
        x, y, pairs = x[~all_], y[~all_], pairs[~all_]
        few = pairs <= SMALL
        if few.any():
            u, v = _below(fa, x[few], fb, y[few])
            for k in range(0, len(u), 100_000):
                some = slice(k, k + 100_000)
                vectors(u[some], v[some], np.einsum("ij,ij->i", a.single[u[some]], b.single[v[some]]))
        todo += [(level, ca.start + p, cb.start + q) for p, q in zip(x[~few].tolist(), y[~few].tolist())]


def _cells(rows: DataFrame, pivots: list[np.ndarray], scratch: Scratch) -> DataFrame:
    """rows (key, members, e) with the nearest pivot of as many components, -1 without one, and the distance to it."""
    by_size: dict[int, list[int]] = {}
    for k, p in enumerate(pivots):
        by_size.setdefault(len(p), []).append(k)
    known = {n: (np.array(at), unit(np.stack([pivots[k] for k in at]))) for n, at in by_size.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            vectors = [v.values.to_numpy(zero_copy_only=False) for v in b.column("e")]
            cell, far = np.full(len(vectors), -1, np.int32), np.zeros(len(vectors))
            sizes = np.array([len(v) for v in vectors], np.int64)
            for n in np.unique(sizes).tolist():
                if n in known:
                    at, centers = known[n]
                    mine = np.flatnonzero(sizes == n)
                    like = unit(np.stack([vectors[k] for k in mine])) @ centers.T
                    cell[mine] = at[np.argmax(like, axis=1)]
                    far[mine] = np.sqrt(np.maximum(0, 2 - 2 * like.max(axis=1)))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cell), pa.array(far)], names=[*b.schema.names, "cell", "far"])

    return scratch.put(rows.mapInArrow(run, rows.schema.simpleString()[7:-1] + ", cell int, far double"), "cells")


def _may_meet(pivots: list[np.ndarray], order: list[int], radius: dict[int, float], chord: float) -> np.ndarray:
    """Which cells, in their order, may hold two vectors within the chord; the last, of rows without a pivot, any."""
    n = len(order)
    may = np.ones((n + 1, n + 1), bool)
    for size in {len(pivots[k]) for k in order}:
        mine = [i for i, k in enumerate(order) if len(pivots[k]) == size]
        x = unit(np.stack([pivots[order[i]] for i in mine]))
        reach = np.array([radius.get(order[i], 0.0) for i in mine])
        may[np.ix_(mine, mine)] = np.sqrt(np.maximum(0, 2 - 2 * x @ x.T)) <= chord + reach[:, None] + reach[None, :] + ROUNDING
        others = [i for i in range(n) if len(pivots[order[i]]) != size]
        may[np.ix_(mine, others)] = False
    return may


def _linked(rows: DataFrame, threshold: float, scratch: Scratch) -> DataFrame:
    """(key, n, star) of different vectors (key, members, e): parts of the number of vectors that link with one, and some
    key of what it is linked with. At most a row for each vector and pair of groups, however many links there are."""
    spark, chord = rows.sparkSession, math.sqrt(2 - 2 * threshold)
    kind = np.float32 if rows.schema["e"].dataType.elementType.simpleString() == "float" else np.float64
    sample = rows.orderBy(F.xxhash64("key")).limit(PIVOTS).select("e").toArrow()["e"]
    pivots = [np.asarray(v.values.to_numpy(zero_copy_only=False), np.float64) for v in sample]
    placed = _cells(rows, pivots, scratch)
    found = {r["cell"]: r for r in placed.groupBy("cell").agg(F.count("*").alias("n"), F.max("far").alias("far"), F.max(F.size("e")).alias("long")).collect()}  # PIVOTS + 1 rows at most
    total = sum(r["n"] for r in found.values())
    if not total:
        return spark.createDataFrame([], "key long, n long, star long")
    order: list[int] = []  # cells near each other come one after the other
    for size in sorted({len(p) for p in pivots}):
        at = np.array([k for k, p in enumerate(pivots) if len(p) == size])
        order += CoverTree(np.stack([pivots[k] for k in at]), at, np.ones(len(at), np.int64)).keys.tolist()
    may = _may_meet(pivots, order, {k: r["far"] for k, r in found.items()}, chord)
    counts = [found[k]["n"] if k in found else 0 for k in [*order, -1]]
    start = np.concatenate([[0], np.cumsum(counts)])
    trees = max(1, -(-total // max(16, min(BLOCK, BLOCK_NUMBERS // max(r["long"] for r in found.values())))))
    groups = min(trees, -(-total // max(LEAST, min(MOST, total // GROUPS))))
    where = F.create_map(*[F.lit(x) for k, s, n in zip([*order, -1], start.tolist(), counts) for x in (k, f"{s},{n}")])
    cell = F.split(where[F.col("cell")], ",")
    place = cell[0].cast("long") + F.pmod(F.xxhash64("key"), cell[1].cast("long"))
    placed = placed.select("key", "members", "e", "cell", F.floor(place * trees / total).cast("int").alias("tree"))
    rank = {k: i for i, k in enumerate([*order, -1])}
    group_of = lambda place: int(place * trees // total) * groups // trees

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def done() -> Iterator[pa.RecordBatch]:
            t = pa.Table.from_batches(held)
            tree = t.column("tree")[0].as_py()
            own, meets = tree * groups // trees, set()
            for c in set(t.column("cell").to_pylist()):
                for i in np.flatnonzero(may[rank[c]]).tolist():
                    if counts[i]:
                        meets.update(range(group_of(start[i]), group_of(start[i + 1] - 1) + 1))
            vectors = t.column("e").combine_chunks()
            vectors = [v.values.to_numpy(zero_copy_only=False) for v in vectors]
            keys, members = t.column("key").to_numpy(), t.column("members").to_numpy()
            for size in {len(v) for v in vectors}:
                at = [k for k, v in enumerate(vectors) if len(v) == size]
                data = pickle.dumps(CoverTree(np.stack([vectors[k] for k in at]).astype(kind), keys[at], members[at]))
                yield pa.RecordBatch.from_arrays([pa.array([own], pa.int32()), pa.array([sorted(meets)], pa.list_(pa.int32())), pa.array([size], pa.int32()), pa.array([data], pa.binary())], names=["own", "meets", "size", "data"])

        for b in batches:
            trees_ = b.column("tree").to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(trees_)) + 1).tolist(), len(trees_)]
            for lo, hi in zip(cuts, cuts[1:]):
                if hi > lo:
                    if held and held[-1].column("tree")[0].as_py() != trees_[lo]:
                        yield from done()
                        held = []
                    held.append(b.slice(lo, hi - lo))
        if held:
            yield from done()
        release()

    built = placed.repartition(min(trees, 10_000), "tree").sortWithinPartitions("tree").mapInArrow(build, "own int, meets array<int>, size int, data binary")
    built = scratch.put(built, "trees")
    dealt = built.select("own", "size", "data", F.explode("meets").alias("other")).select(F.least("own", "other").alias("p"), F.greatest("own", "other").alias("q"), "own", "size", "data")

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []

        def done() -> Iterator[pa.RecordBatch]:
            p, q = now
            trees_ = [(own, size, pickle.loads(data)) for own, size, data in held]
            ends = np.concatenate([[0], np.cumsum([len(t.keys) for *_, t in trees_])]).astype(np.int64)
            out = Found(int(ends[-1]))
            for i, (g, size, t) in enumerate(trees_):
                for j in range(i, len(trees_)) if p == q else range(len(trees_)):
                    if trees_[j][1] == size and (p == q or (g == p and trees_[j][0] == q)):
                        walk(t, trees_[j][2], int(ends[i]), int(ends[j]), out, threshold)
            out.settle()
            keys = np.concatenate([t.keys for *_, t in trees_])
            keep = np.flatnonzero((out.count > 0) | (out.label != np.arange(out.size)))
            yield pa.RecordBatch.from_arrays([pa.array(keys[keep]), pa.array(out.count[keep]), pa.array(keys[out.label[keep]])], names=["key", "n", "star"])

        for b in batches:
            for p, q, own, size, data in zip(*(b.column(c).to_pylist() for c in ("p", "q", "own", "size", "data"))):
                if (p, q) != now:
                    if held:
                        yield from done()
                    now, held = (p, q), []
                held.append((own, size, data))
        if held:
            yield from done()
        release()

    return scratch.put(dealt.repartition(min(groups * (groups + 1), 10_000), "p", "q").sortWithinPartitions("p", "q").mapInArrow(meet, "key long, n long, star long"), "met")


def embedding_dedup(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = COSINE) -> DataFrame:
    """One row per input row: id_col, n_links (other rows it links with directly), component_id (the smallest id reachable
    by links, itself included) and kept (whether that is its own).

    Two vectors link if their cosine, in double precision, is at least the threshold. Null and empty vectors, those of
    zeros, and those with a null or non-finite component link with nothing, nor do vectors of different lengths. Rows with
    null or repeated ids are vectors of their own; a component without any id has a null component_id, and its rows with a
    null id count as kept. Other columns are not looked at; no rows give none.

    Equal vectors are one with a weight, so a large group of copies is one row. The others are dealt out by the nearest of
    PIVOTS sampled vectors, so that near ones share a cover tree of some BLOCK vectors, and a large cell has many trees;
    each two groups of trees meet in one task, but for those that the cells' radii keep apart. No pair leaves a task, only
    counts and one link a vector. Where neither radii nor distances tell vectors apart, as with random directions, work
    grows with the square of the number of different vectors.
    """
    scratch = Scratch(vectors.sparkSession)
    rows, key = row_keys(vectors, id_col, scratch)
    e = F.col(f"`{vector_col}`")
    e = e if vectors.schema[vector_col].dataType.simpleString() in ("array<float>", "array<double>") else e.cast("array<double>")
    rows = rows.select(F.col(f"`{key}`").alias("key"), F.col(f"`{id_col}`").cast("long").alias("id"), e.alias("e"))
    finite = F.forall("e", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    sound = F.coalesce(finite & F.exists("e", lambda x: x != 0), F.lit(False))
    rows = rows.withColumn("sound", sound)
    good = rows.filter("sound").select("key", "id", "e", F.xxhash64("e").alias("h"), F.xxhash64(F.lit(1), F.col("e")).alias("g"))
    named = scratch.put(good.select("key", "id", "h", "g"), "named")
    classes = scratch.put(named.groupBy("h", "g").agg(F.min("key").alias("rep"), F.count("*").alias("members")), "classes")
    different = good.select("key", "e").join(classes.select(F.col("rep").alias("key"), "members"), "key")
    met = _linked(scratch.put(different.select("key", "members", "e"), "different"), threshold, scratch)
    labels = components(met.select(F.col("key").alias("a"), F.col("star").alias("b")), scratch)
    links = met.groupBy("key").agg(F.sum("n").alias("n"))
    whole = classes.join(links, classes["rep"] == links["key"], "left").join(labels, classes["rep"] == labels["node"], "left")
    whole = scratch.put(whole.select("h", "g", "members", (F.col("members") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"), F.coalesce("comp", "rep").alias("comp")), "whole")
    out = hot_join(named, whole, ["h", "g"], "members", named.count()).select("key", "id", "n_links", "comp")
    if not rows.filter("id is null or id <> key").isEmpty():
        least = out.groupBy("comp").agg(F.min("id").alias("least"), F.count("*").alias("size"))
        out = hot_join(out, least, "comp", "size", named.count()).select("key", "id", "n_links", F.col("least").alias("component_id"))
    else:  # keys are the ids: the smallest names its component
        out = out.select("key", "id", "n_links", F.col("comp").alias("component_id"))
    rest = rows.filter("not sound").select("key", "id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    out = out.unionByName(rest)
    return out.select(F.col("id").alias(id_col), "n_links", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))


def op11_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup(table(spark, sf_dir, "embeddings"))
