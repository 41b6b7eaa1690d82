"""Embedding near-dedup, cross-tokenizer alignment and periodic runs: brute force, edge cases, queries over driver tables."""

import collections
import hashlib
import pickle
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from skein.llm import cross_tokenizer, embedding_dedup, periodic_runs

SF = "/root/testdata/sf0.001"

# ---- periodic runs ----


def plain_runs(w, min_length=6, exponent=4):
    """Islands of every lag, one word after the other; an island whose stretch has a smaller period is no run of its own."""
    n, out = len(w), []
    for q in range(1, n // exponent + 1):
        i = 0
        while i + q < n:
            if w[i] != w[i + q]:
                i += 1
                continue
            start = i
            while i + q < n and w[i] == w[i + q]:
                i += 1
            length = i - start + q
            x = w[start : start + length]
            if length >= max(min_length, exponent * q) and not any(x[d:] == x[: length - d] for d in range(1, q)):
                out.append((start, length, q))
    return sorted(out, key=lambda r: (r[0], r[2]))


def test_runs_equal_brute_force():
    rng = random.Random(5)
    for _ in range(400):
        n, k = rng.randint(0, 60), rng.choice([1, 2, 3, 6])
        w = [rng.randrange(k) for _ in range(n)]
        for _ in range(rng.randint(0, 2)):
            if n > 8:
                a, p, long = rng.randrange(n - 4), rng.randint(1, 7), rng.randint(4, n)
                for i in range(a + p, min(n, a + long)):
                    w[i] = w[i - p]
        # every stretch that no word extends, straight from the definition
        want = []
        for s in range(n):
            for e in range(s + 6, n + 1):
                x = w[s:e]
                q = next(d for d in range(1, e - s + 1) if x[d:] == x[: e - s - d])
                if e - s >= 4 * q and (s == 0 or w[s - 1] != w[s - 1 + q]) and (e == n or w[e] != w[e - q]):
                    want.append((s, e - s, q))
        want.sort(key=lambda r: (r[0], r[2]))
        assert periodic_runs.runs_of(np.array(w, np.int32)) == want == plain_runs(w)


def test_lags_are_counted_exactly():
    for n in (1, 7, 400, 6000):
        w = (np.random.RandomState(n).zipf(1.3, n) % 300).astype(np.int32)  # heavy and light words
        counts = periodic_runs.lag_counts(w, n // 4)
        assert all(counts[q] == (w[q:] == w[:-q]).sum() for q in range(1, n // 4 + 1))


def test_runs_edges(spark):
    long = " ".join(["w"] * 300_000)
    ring = " ".join(f"v{i % 7919}" for i in range(40_000))
    rows = [(1, None), (2, ""), (3, " \t\n"), (None, "a a a a a a"), (4, "a b a b a b a b"), (4, "A a A a A a a a"), (5, long), (6, ring)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("runs", F.lit("clash")).withColumn("id", F.lit(3))
    got = sorted(((r["doc_id"] or 0, r["n_words"], [tuple(x) for x in r["runs"]], r["collapsed"]) for r in periodic_runs.periodic_runs(df).collect()), key=str)
    want = [(1, 0, [], ""), (2, 0, [], ""), (3, 0, [], ""), (0, 6, [(0, 6, 1)], "a"), (4, 8, [(0, 8, 2)], "a b"), (4, 8, [], "A a A a A a a a"),
            (5, 300_000, [(0, 300_000, 1)], "w"), (6, 40_000, [(0, 40_000, 7919)], " ".join(f"v{i}" for i in range(7919)))]
    assert got == sorted(want, key=str)
    assert periodic_runs.periodic_runs(df.limit(0)).count() == 0
    best = periodic_runs.periodic_runs(df).select(periodic_runs.strongest(F.col("runs")).alias("b")).filter("b is not null").collect()
    assert len(best) == 4


def test_strongest_breaks_ties_by_start(spark):
    df = spark.createDataFrame([([(0, 9, 2), (5, 18, 4), (7, 27, 6), (1, 8, 2)],), ([],)], f"runs {periodic_runs.RUNS}")
    got = [r["b"] for r in df.select(periodic_runs.strongest(F.col("runs")).alias("b")).collect()]
    assert tuple(got[0]) == (0, 9, 2) and got[1] is None


def test_op13(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    got = {r["doc_id"]: r for r in periodic_runs.op13_periodic_runs(spark, SF).collect()}
    assert len(got) == len(docs)
    planted = 0
    for i, text in docs:
        w = (text or "").encode().split()
        h = zlib.crc32(str(i).encode())
        if h % 10 == 0 and w:
            planted += 1
            g = h // 10
            a = g % len(w)
            p = 1 + (len(w) - a) // (3 + g % 8)
            w = [x if k < a else w[a + (k - a) % p] for k, x in enumerate(w)]
        runs = plain_runs(w)
        gone = {k for s, n, q in runs for k in range(s + q, s + n)}
        best = min(runs, key=lambda r: (-r[1] / r[2], r[0], r[2]), default=(None,) * 3)
        sha = lambda x: hashlib.sha256(x).hexdigest()
        want = (i, len(runs), *best, 1000 * best[1] // best[2] if runs else None, sha("".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()), sha(b" ".join(x for k, x in enumerate(w) if k not in gone)))
        assert tuple(got[i]) == want
    assert planted


# ---- cross-tokenizer alignment ----


def plain_alignment(docs):
    """Whole texts through both tokenizers, positions in dictionaries: rows as the query's, in the order of docs."""
    pair = cross_tokenizer.Tokenizers(cross_tokenizer.BYTE_BPE, cross_tokenizer.PIECE_BPE)
    counts, found = collections.Counter(), []
    for text in docs:
        a, b = (pair.a.encode(" " + text, add_special_tokens=False).ids, pair.b.encode(text)) if text else ([], [])
        data = (" " + (text or "")).encode()
        if b"".join(pair.bytes_a[i] for i in a) != data or b"".join(pair.bytes_b[i] for i in b) != data:
            a, b = [], []
        ends = []
        for ids, sizes in ((a, pair.bytes_a), (b, pair.bytes_b)):
            ends.append(dict(zip(np.cumsum([len(sizes[i]) for i in ids]).tolist(), ids)))
        cuts = sorted(ends[0].keys() & ends[1].keys())
        links = [(ends[0][e], ends[1][e]) for e in cuts]
        counts.update(links)
        groups, sides = [], ([], [])
        for e in sorted(ends[0].keys() | ends[1].keys()):
            for side, x in zip(sides, ends):
                side += [str(x[e])] if e in x else []
            if e in ends[0] and e in ends[1]:
                groups.append("|".join(map(",".join, sides)))
                sides = ([], [])
        found.append((len(a), len(b), links, ";".join(groups)))
    most = collections.Counter()
    for (a, b), n in counts.items():
        most[b] = max(most[b], n)
    return [(a, b, len(x), len(x), sum(counts[p] == most[p[1]] for p in x), sum(counts[p] for p in x), g) for a, b, x, g in found], counts


ODD = ["", None, " ", "  a  b ", "\n", "a\n\nb", "x \n y", " lead", "trail ", "tab\tb\tc", "it's we'll they've o'clock", "end. Next, one; two: three! four? five", "a.b,c", "wait... what?! no.\nyes,\nno",
       "<s> hi </s> <unk> <0x41> <|endoftext|>", "under▁score", "\x00 nul \x01 mark\x01, \x01.", "naïve café, über; Ångström. ²., ×, ½.", "日本語 テスト。 次, です", "😀 👍🏽 é.", " nb sp  line 　wide", "1,234.56 7. 8, 9\n10",
       "привет, мир. ґ, ѣ.", "a  b", "word\x1cword \x1f x", "﻿bom ​zero", "A. B. C.\nD", "под҂, а҃."]


def fuzz(n):
    rng = random.Random(8)
    letters = ["a", "é", "ж", "7", ".", ",", "!", "'", " ", " ", "\n", "\t", "s", "日", "😀", "▁", "-", "²", "\x01"]
    return ["".join(rng.choice(letters) for _ in range(rng.randint(1, 30))) for _ in range(n)]


def test_segments_give_the_tokens_of_the_whole():
    pair = cross_tokenizer.Tokenizers(cross_tokenizer.BYTE_BPE, cross_tokenizer.PIECE_BPE)
    for text in [t for t in ODD + fuzz(3000) if t]:
        keys = cross_tokenizer.cut(text)
        assert "".join(map(cross_tokenizer.segment, keys)) == " " + text
        b = pair.b.encode(text)
        same = b"".join(pair.bytes_b[i] for i in b).decode() == " " + text
        assert pair.keeps(text) == same == ("▁" not in text)
        if same:
            ids = pair.encode(keys)
            assert [i for x, _ in ids for i in x] == pair.a.encode(" " + text, add_special_tokens=False).ids and [i for _, x in ids for i in x] == b


@pytest.mark.parametrize("most_pairs", [1_000_000, 0])
def test_alignment_edges(spark, monkeypatch, most_pairs):
    monkeypatch.setattr(cross_tokenizer, "MOST_PAIRS", most_pairs)  # below it pairs are sent to every task, above it shuffled
    monkeypatch.setattr(cross_tokenizer, "PART", 300)
    texts = [*ODD, *fuzz(60), "the same text", "the same text", "z" * 50_000, "many short words " * 5_000]
    rows = [(k if k % 7 else None, t) for k, t in enumerate(texts)] + [(5, "second row of an id")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("key", F.lit("clash")).withColumn("part", F.lit(1)).repartition(3)
    documents, pairs = cross_tokenizer.align(df)
    want, counts = plain_alignment([t for _, t in rows])
    got = collections.Counter(tuple(r)[:7] for r in documents.collect())
    assert got == collections.Counter((i, *w[:6]) for (i, _), w in zip(rows, want))
    assert sorted(r["groups"] for r in documents.collect()) == sorted(w[6] for w in want)
    assert {(r["a"], r["b"]): r["count"] for r in pairs.collect()} == dict(counts)
    documents, pairs = cross_tokenizer.align(df.limit(0))
    assert documents.count() == pairs.count() == 0


def test_op12(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    got = {r["doc_id"]: tuple(r)[1:] for r in cross_tokenizer.op12_cross_tokenizer(spark, SF).collect()}
    want, _ = plain_alignment([t for _, t in docs])
    assert len(got) == len(docs)
    for (i, _), w in zip(docs, want):
        assert got[i] == (*w[:6], hashlib.sha256(w[6].encode()).hexdigest() if w[0] else "")


# ---- embedding near-dedup ----


def plain_links(vectors):
    n, sound = len(vectors), [v is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v) and any(v) for v in vectors]
    near = [set() for _ in range(n)]
    for i in range(n):
        for j in range(i):
            if sound[i] and sound[j] and len(vectors[i]) == len(vectors[j]) and embedding_dedup.cosine(np.array(vectors[i], float), np.array(vectors[j], float)) >= 0.95:
                near[i].add(j)
                near[j].add(i)
    return near


def components_of(near):
    label = list(range(len(near)))
    for s in range(len(near)):
        if label[s] == s:
            todo = [s]
            while todo:
                for y in near[todo.pop()]:
                    if label[y] > s:
                        label[y] = s
                        todo.append(y)
    return label


def clustered(rng, n, d):
    x = rng.standard_normal((n, d))
    for spread in (0, 0.02, 0.1, 0.25):
        at = rng.choice(n, n // 6, replace=False)
        x[at] = rng.standard_normal(d) + spread * rng.standard_normal((len(at), d))
    return x


@pytest.mark.parametrize("d", [1, 2, 5, 64])
def test_walks_find_every_pair(d):
    rng = np.random.default_rng(d)
    for n in (2, 30, 300):
        x, w = clustered(rng, n, d), rng.integers(1, 5, n)
        h = n // 2
        a, b = embedding_dedup.CoverTree(x[:h], np.arange(h), w[:h]), embedding_dedup.CoverTree(x[h:], np.arange(h, n), w[h:])
        a = pickle.loads(pickle.dumps(a))
        for tree in (a, b):  # nested levels: children lie side by side under one node, within its radius
            assert all(c[-1] == len(r) for c, r in zip(tree.child, tree.radius[1:])) and sorted(tree.keys) == sorted(tree.keys.tolist())
        found = embedding_dedup.Found(n)
        for s, t, i, j in ((a, a, 0, 0), (a, b, 0, h), (b, b, h, h)):
            embedding_dedup.walk(s, t, i, j, found)
        found.settle()
        keys = np.concatenate([a.keys, b.keys])
        u = embedding_dedup.unit(x)
        near = (u @ u.T >= 0.95) & ~np.eye(n, dtype=bool)
        count, label = np.zeros(n, int), np.zeros(n, int)
        count[keys], label[keys] = found.count, keys[found.label]
        assert (count == near @ w).all()
        want = components_of([set(np.flatnonzero(r)) for r in near])
        assert len(set(zip(want, label.tolist()))) == len(set(want)) == len(set(label.tolist()))


@pytest.mark.parametrize("kind", ["float", "double"])
def test_embedding_edges(spark, monkeypatch, kind):
    monkeypatch.setattr(embedding_dedup, "BLOCK", 32)  # many trees and groups of trees
    monkeypatch.setattr(embedding_dedup, "LEAST", 40)
    rng = np.random.default_rng(7)
    x = clustered(rng, 150, 8).astype(np.float32).astype(float).tolist()
    inf, nan = float("inf"), float("nan")
    x += [None, [], [0.0] * 8, [1.0, None] + [0.0] * 6, [inf] + [1.0] * 7, [nan] * 8, [1.0, 0.0], [2.0, 0.0], [0.0, 1.0], *[x[3]] * 40, [4 * v for v in x[3]], [-v for v in x[3]], [1e-30] + [0.0] * 7, [1e30] + [0.0] * 7]
    near, ids = plain_links(x), [k if k % 11 else None for k in range(len(x))]
    ids[20] = ids[21] = 400  # a repeated id of different vectors
    df = spark.createDataFrame(list(zip(ids, x)), f"vec_id long, embedding array<{kind}>").withColumn("label", F.lit(1)).withColumn("e", F.lit("clash")).withColumn("key", F.lit(0)).repartition(3)
    label = components_of(near)
    least = collections.defaultdict(list)
    for i, c in zip(ids, label):
        least[c] += [] if i is None else [i]
    want = collections.Counter()
    for i, c, links in zip(ids, label, near):
        top = min(least[c], default=None)
        want[i, len(links), top, i == top] += 1
    got = collections.Counter(tuple(r) for r in embedding_dedup.embedding_dedup(df).collect())
    assert got == want
    assert embedding_dedup.embedding_dedup(df.limit(0)).count() == 0
    plain = spark.createDataFrame([(k, v) for k, v in enumerate(x)], f"vec_id long, embedding array<{kind}>")
    assert sorted(tuple(r) for r in embedding_dedup.embedding_dedup(plain).collect()) == [(k, len(near[k]), label[k], label[k] == k) for k in range(len(x))]


def test_one_large_group_takes_no_pairs(spark):
    """Near copies of one vector, a third of all rows: rows out of the walks grow with vectors, not with links."""
    rng = np.random.default_rng(2)
    base = rng.standard_normal((900, 16))
    base[::3] = base[0] + 0.03 * rng.standard_normal((300, 16))
    rows = [(k, 1, v.tolist()) for k, v in enumerate(base)]
    from skein.llm.common import Scratch

    met = embedding_dedup._linked(spark.createDataFrame(rows, "key long, members long, e array<double>"), 0.95, Scratch(spark))
    assert met.count() < 2 * 900
    count = collections.Counter()
    for r in met.collect():
        count[r["key"]] += r["n"]
    u = embedding_dedup.unit(base)
    assert [count[k] for k in range(900)] == ((u @ u.T >= 0.95).sum(1) - 1).tolist()


def test_op11(spark):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding").collect()
    near = plain_links([r["embedding"] for r in rows])
    label = components_of(near)
    order = np.argsort([r["vec_id"] for r in rows])
    assert (order == np.arange(len(rows))).all()  # so that the smallest place is the smallest id
    want = sorted((r["vec_id"], len(x), rows[c]["vec_id"], rows[c]["vec_id"] == r["vec_id"]) for r, x, c in zip(rows, near, label))
    assert sorted(tuple(r) for r in embedding_dedup.op11_embedding_dedup(spark, SF).collect()) == want
