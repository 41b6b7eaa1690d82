"""N-gram Jaccard join: rare-first prefix filter with length, positional and suffix filters, verified once per pair."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WORD_HASHES, Scratch, filtered, hash_filter, held, hot_join, lists, per_text, row_keys, table, without
from .components import components

#: Shingles are counted in 2**COUNT_LOG2 buckets of the hash's first bits (16 MB of levels on every worker, at any size of
#: the input), in CHUNKS parts. Shingles of a bucket share a count, which is at least that of each.
COUNT_LOG2, CHUNKS = 24, 64
#: Characters of texts whose sets a task holds at once, about.
TEXT_RUN = 1_000_000
#: Sketches of so many tasks are summed in a first step.
WORKERS = 256
#: Hash ranges whose shingle counts the suffix filter compares.
RANGES = 16
#: Finer hash ranges of which it compares only whether the count is odd.
PARITIES = 256
#: Sets over LARGE shingles also have counts by finer hash ranges, about SPREAD shingles a range, so that the filter tells
#: sets of any size apart. Candidate pairs are held against them before their texts are fetched.
LARGE, SPREAD = 600, 16
#: Rows of one shingle that meet each other in one task, and pairs of one text that are verified together.
BLOCK = 256
SKETCH = ["r0", "r1", "r2", "r3", "p0", "p1", "p2", "p3"]
_M1 = np.uint64(0x9E3779B97F4A7C15)


def word_hashes(words: list[bytes]) -> np.ndarray:
    """64-bit hashes of the words, remembered up to a bound."""
    known = held(WORD_HASHES, dict)
    new = set(words).difference(known)
    if new:
        if len(known) > 250_000:
            known.clear()
            new = set(words)
        for w in new:
            known[w] = xxhash.xxh3_64_intdigest(w)
    return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))


class Rule(NamedTuple):
    """What links: so many words make a shingle, and the least Jaccard similarity is num / den, in whole numbers."""

    words: int
    num: int
    den: int

    def shingles(self, text: str | None) -> np.ndarray:
        """Sorted distinct 64-bit hashes of a text's word n-grams; fewer words make one shingle, none make no shingle."""
        words = (text or "").encode().lower().split()  # bytes: A-Z only, and ASCII white space only
        if not words:
            return np.zeros(0, np.uint64)
        if len(words) < self.words:
            return np.array([xxhash.xxh3_64_intdigest(b" ".join(words), seed=len(words))], np.uint64)
        w = word_hashes(words)
        last = len(w) - self.words + 1
        h = w[:last].copy()
        for j in range(1, self.words):
            h ^= h >> np.uint64(29)
            h *= _M1
            h += w[j : last + j]
        h ^= h >> np.uint64(32)
        h *= _M1
        h ^= h >> np.uint64(29)
        return np.unique(h)

    def prefix_len(self, n: int) -> int:
        """Of two sets that link, the first so many shingles in any common order share one."""
        return n - (self.num * n + self.den - 1) // self.den + 1


def _digest(h: np.ndarray) -> tuple[int, int]:
    """128 bits that name a set."""
    a, b = np.frombuffer(xxhash.xxh3_128_digest(h.tobytes()), np.int64)
    return int(a), int(b)


def _pack_counts(counts: np.ndarray) -> tuple[bytes, bytes]:
    """Counts as compressed bytes, and (place, count) of those that a byte can't hold."""
    large = np.flatnonzero(counts >= 255)
    return zlib.compress(np.minimum(counts, 255).astype(np.uint8).tobytes(), 1), np.stack([large, counts[large]], 1).astype(np.int64).tobytes()


def _unpack_counts(low: bytes, high: bytes) -> np.ndarray:
    counts = np.frombuffer(zlib.decompress(low), np.uint8).astype(np.int64)
    large = np.frombuffer(high, np.int64).reshape(-1, 2)
    counts[large[:, 0]] = large[:, 1]
    return counts


def _sets_and_counts(rule: Rule) -> Callable:
    """For mapInArrow over (id, text): a row for each text with its set's size and name, then the task's shingle counts."""
    names = ["id", "n", "s1", "s2", "worker", "chunk", "low", "high"]
    kinds = [pa.int64()] * 5 + [pa.int32(), pa.binary(), pa.binary()]

    def batch(*cols: list) -> pa.RecordBatch:
        long = next(len(c) for c in cols if c is not None)
        return pa.RecordBatch.from_arrays([pa.array([None] * long if c is None else c, k) for c, k in zip(cols, kinds)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        counts, above = np.zeros(1 << COUNT_LOG2, np.uint8), {}  # what is above 255

        def some(ids: list, texts: list) -> Iterator[pa.RecordBatch]:
            sets = [rule.shingles(t) for t in texts]
            at, times = np.unique(np.concatenate(sets) >> np.uint64(64 - COUNT_LOG2), return_counts=True)
            total = counts[at.astype(np.int64)] + times
            counts[at.astype(np.int64)] = np.minimum(total, 255)
            for k in np.flatnonzero(total > 255).tolist():
                above[int(at[k])] = above.get(int(at[k]), 0) + int(total[k]) - 255
            s1, s2 = zip(*map(_digest, sets))
            yield batch(ids, [len(h) for h in sets], s1, s2, None, None, None, None)

        yield from per_text(some, TEXT_RUN)(batches)
        worker = TaskContext.get().partitionId()
        for k, part in enumerate(counts.reshape(CHUNKS, -1)):
            if part.any():
                part = part.astype(np.int64)
                for at, more in above.items():
                    if at // len(part) == k:
                        part[at % len(part)] += more
                low, high = _pack_counts(part)
                yield batch(None, None, None, None, [worker], [k], [low], [high])

    return run


def _summed(rows: DataFrame, last: bool) -> DataFrame:
    """Counts summed over the rows of a chunk and `worker`, as a stream; as levels if last."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, total = None, None

        def done() -> pa.RecordBatch:
            low, high = (_levels(total).tobytes(), b"") if last else _pack_counts(total)
            cols = [pa.array([key[1]], pa.int64()), pa.array([key[0]], pa.int32()), pa.array([low], pa.binary()), pa.array([high], pa.binary())]
            return pa.RecordBatch.from_arrays(cols, names=["worker", "chunk", "low", "high"])

        for b in batches:
            for chunk, worker, low, high in zip(*(b.column(c) for c in ("chunk", "worker", "low", "high"))):
                here = (chunk.as_py(), worker.as_py())
                if here != key:
                    if key:
                        yield done()
                    key, total = here, np.zeros(1 << COUNT_LOG2 >> (CHUNKS.bit_length() - 1), np.int64)
                total += _unpack_counts(low.as_py(), high.as_py())
        if key:
            yield done()

    return rows.repartition("chunk", "worker").sortWithinPartitions("chunk", "worker").mapInArrow(run, "worker long, chunk int, low binary, high binary")


def _levels(counts: np.ndarray) -> np.ndarray:
    """Counts as a byte that never falls with them: exact up to 64, then eight steps for each doubling."""
    above = 64 + np.floor(8 * np.log2(np.maximum(counts, 64) / 64))
    return np.where(counts <= 64, counts, np.minimum(above, 255)).astype(np.uint8)


def _order(counts: DataFrame) -> np.ndarray:
    """The level of every bucket: 2**COUNT_LOG2 bytes for the driver and each worker, whatever the input."""
    once = _summed(counts.withColumn("worker", F.floor(F.col("worker") / WORKERS)), False)
    parts = _summed(once.withColumn("worker", F.lit(0).cast("long")), True).select("chunk", "low").toArrow()
    levels = np.zeros((CHUNKS, (1 << COUNT_LOG2) // CHUNKS), np.uint8)
    for k, x in zip(parts["chunk"].to_pylist(), parts["low"]):
        levels[k] = np.frombuffer(x.as_py(), np.uint8)
    return levels.ravel()


def _fine(h: np.ndarray) -> bytes | None:
    """A large set's counts by hash ranges whose number follows the set's size, a byte each (255: or more)."""
    if len(h) <= LARGE:
        return None
    ranges = 1 << (len(h) // SPREAD).bit_length()
    return np.minimum(np.bincount(((h >> np.uint64(16)) & np.uint64(ranges - 1)).astype(np.int64), minlength=ranges), 255).astype(np.uint8).tobytes()


def _apart(a: bytes, b: bytes) -> int:
    """At least so many shingles are in only one of two sets, by their fine counts. Cut off counts only bring it down."""
    x, y = (np.frombuffer(z, np.uint8).astype(np.int64) for z in (a, b))
    while len(x) != len(y):
        if len(x) < len(y):
            x, y = y, x
        x = np.minimum(x[: len(x) // 2] + x[len(x) // 2 :], 255)
    return int(np.abs(x - y).sum())


def _link_conditions(a: str, b: str, rule: Rule) -> Column:
    """Length, positional and suffix filter for two prefix rows that share a shingle."""
    c = lambda t, x: F.col(f"{t}.{x}")
    _, num, den = rule
    both = c(a, "n") + c(b, "n")
    least = F.expr(f"({num} * ({a}.n + {b}.n) + {num + den - 1}) div {num + den}")  # common shingles that a link needs
    length = F.least(c(a, "n"), c(b, "n")) * den >= F.greatest(c(a, "n"), c(b, "n")) * num
    position = F.least(c(a, "n") - c(a, "i"), c(b, "n") - c(b, "i")) >= least
    part = lambda t, k: F.shiftright(c(t, f"r{k // 4}"), 16 * (k % 4)).bitwiseAND(F.lit(65535))
    apart = sum((F.abs(part(a, k) - part(b, k)) for k in range(RANGES)), F.lit(0))
    odd = sum((F.bit_count(c(a, f"p{k}").bitwiseXOR(c(b, f"p{k}"))) for k in range(4)), F.lit(0))
    most = both - least * 2  # shingles that only one of the two has
    return length & position & (odd <= most) & (apart <= most)


def _suffix_filter(pairs: DataFrame, fine: DataFrame, rule: Rule) -> DataFrame:
    """Drops pairs of large sets whose counts by fine hash ranges show too many shingles that only one has."""
    side = lambda x: fine.select(F.col("id").alias(x), F.col("n").alias(f"n{x}"), F.col("fine").alias(f"f{x}"))
    both = pairs.join(side("a"), "a", "left").join(side("b"), "b", "left").select("a", "b", "na", "nb", "fa", "fb")
    _, num, den = rule

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = np.ones(batch.num_rows, bool)
            na, nb, fa, fb = (batch.column(c) for c in ("na", "nb", "fa", "fb"))
            for k in np.flatnonzero(fa.is_valid().to_numpy(False) & fb.is_valid().to_numpy(False)):
                n = na[k].as_py() + nb[k].as_py()
                keep[k] = _apart(fa[k].as_py(), fb[k].as_py()) <= n - 2 * ((num * n + num + den - 1) // (num + den))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep))

    return both.mapInArrow(run, "a long, b long").distinct()


def _verify(pairs: DataFrame, docs: DataFrame, fine: DataFrame, rule: Rule, scratch: Scratch) -> DataFrame:
    """The pairs (a, b) that link, from the whole texts of both. Each pair comes once and is verified once.

    A text that is in many pairs as `a` comes once for each BLOCK of them, followed by the other texts of the block, so its
    shingles are made once for them all, and a very common one is dealt over many tasks.
    """
    pairs = scratch.put(_suffix_filter(pairs, fine, rule), "pairs")
    ids = scratch.put(pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct(), "ids")
    flt = hash_filter(ids.select(F.xxhash64("id").alias("k")), "k", ids.count())
    texts = scratch.put(filtered(docs.withColumn("k", F.xxhash64("id")), "k", flt).join(ids, "id", "left_semi"), "texts")
    many = scratch.put(pairs.groupBy("a").agg(F.count("*").alias("c")), "many")
    dealt = hot_join(pairs, many, "a", "c", pairs.count())
    dealt = scratch.put(dealt.select("a", "b", F.pmod(F.xxhash64("b"), F.ceil(F.col("c") / BLOCK)).cast("int").alias("k")), "blocks")
    text = lambda c: texts.select(F.col("id").alias(c), "text")
    first = dealt.select("a", "k").distinct().join(text("a"), "a").select("a", "k", F.lit(None).cast("long").alias("b"), "text")
    rows = first.unionByName(dealt.join(text("b"), "b").select("a", "k", "b", "text"))
    rows = rows.repartition("a", "k").sortWithinPartitions("a", "k", F.col("b").asc_nulls_first())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = np.zeros(0, np.uint64)
        for batch in batches:
            links = []
            for x, y, t in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), batch.column("text")):
                h = rule.shingles(t.as_py())
                if y is None:
                    own = h
                    continue
                at = np.searchsorted(own, h)
                at[at == len(own)] = 0
                common = int((own[at] == h).sum()) if len(own) else 0
                if rule.den * common >= rule.num * (len(own) + len(h) - common):
                    links.append((x, y))
            if links:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*links)], names=["a", "b"])

    out = scratch.put(rows.mapInArrow(run, "a long, b long").distinct(), "links")
    scratch.drop(ids, texts, many, dealt)
    return out


def _classes(docs: DataFrame, rule: Rule, scratch: Scratch) -> tuple[DataFrame, DataFrame, np.ndarray]:
    """Each row's set, the classes of equal sets with their smallest id and size, and the order of shingles."""
    kinds = "id long, n long, s1 long, s2 long, worker long, chunk int, low binary, high binary"
    found = scratch.put(docs.mapInArrow(_sets_and_counts(rule), kinds), "sets")
    sets = found.filter("chunk is null").select("id", "n", "s1", "s2")
    classes = scratch.put(sets.groupBy("s1", "s2", "n").agg(F.min("id").alias("rep"), F.count("*").alias("members")), "classes")
    return sets, classes, _order(found.filter("chunk is not null").select("worker", "chunk", "low", "high"))


def _prefix_rows(docs: DataFrame, classes: DataFrame, order: np.ndarray, rule: Rule, repeats: bool, scratch: Scratch) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows, ordered, fine): the classes' prefix shingles that another prefix has, their sketches, their fine counts."""
    _, num, den = rule
    reps = classes.filter("n > 0 and rep is not null").select(F.col("rep").alias("id"), "s1", "s2")
    known = docs.sparkSession.sparkContext.broadcast(order)

    def prefixes(ids: list, texts: list) -> Iterator[pa.RecordBatch]:
        levels = known.value
        n, ranges, parities, fine, prefix, s1, s2 = [], [], [], [], [], [], []
        for t in texts:
            h = rule.shingles(t)
            a, b = _digest(h)
            s1.append(a)
            s2.append(b)
            n.append(len(h))
            ranges.append(np.minimum(np.bincount((h & np.uint64(RANGES - 1)).astype(np.int64), minlength=RANGES), 65535).astype(np.uint16).view(np.int64))
            odd = np.bincount(((h >> np.uint64(8)) & np.uint64(PARITIES - 1)).astype(np.int64), minlength=PARITIES) & 1
            parities.append(np.packbits(odd.astype(np.uint8)).view(np.int64))
            fine.append(_fine(h))
            rare = np.argsort(levels[(h >> np.uint64(64 - COUNT_LOG2)).astype(np.int64)], kind="stable")  # ties: by hash
            prefix.append(h[rare[: rule.prefix_len(len(h))]].view(np.int64))
        r = np.hstack([np.stack(ranges), np.stack(parities)])
        yield pa.RecordBatch.from_arrays(
            [pa.array(x, pa.int64()) for x in (ids, s1, s2, n, *r.T)] + [pa.array(fine, pa.binary()), lists(prefix, pa.int64())],
            names=["id", "s1", "s2", "n", *SKETCH, "fine", "prefix"],
        )

    kinds = f"id long, s1 long, s2 long, n long, {', '.join(f'{c} long' for c in SKETCH)}, fine binary, prefix array<long>"
    ordered = docs.mapInArrow(per_text(prefixes, TEXT_RUN), kinds).join(reps, ["id", "s1", "s2"], "left_semi")
    ordered = scratch.put(ordered.dropDuplicates(["id", "s1", "s2"]) if repeats else ordered, "prefixes")
    known.destroy()  # what it was for is written

    # prefix rows whose shingle is in another prefix
    shared = scratch.put(ordered.select(F.explode("prefix").alias("h")).groupBy("h").agg(F.count("*").alias("c")).filter("c > 1"), "shared")
    rows = ordered.select("id", "n", *SKETCH, F.posexplode("prefix").alias("i", "h"))
    rows = filtered(rows.withColumn("k", F.col("h")), "k", hash_filter(shared, "h", shared.count()))
    n_links = F.expr(f"n - i >= ({num} * n + {den - 1}) div {den}")  # positional filter against the smallest partner
    rows = scratch.put(rows.filter(n_links), "rows")
    fine = (ordered if repeats else ordered.filter("fine is not null")).select("id", "n", "fine")
    scratch.drop(shared)
    return rows, ordered, fine


def ngram_jaccard(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, num: int = 9, den: int = 10) -> DataFrame:
    """One row per input row: id_col, n_shingles, component_id (the smallest id reachable by links, itself included).

    Two documents link if the Jaccard similarity of their sets of word n-grams (n is words) is at least num / den. Null and empty texts
    and texts of white space have the empty set and link with nothing. Rows with equal ids are one document: they are
    linked if any of their texts is. A row with a null id can share a class of equal sets, but is no node itself; its
    component is null if nothing else is in its class. Other columns are not looked at.

    Very long texts are hashed whole, one at a time; their prefix and sketch follow their size.

    Equal sets are merged first, so a group of copies counts as one set. Shingles are ordered rarest first by a count
    sketch of all shingles of all rows, ties by hash; any common order loses no link. A set's prefix in that order is
    joined on shingles. In each group of a shared shingle, every member first meets only the member with the fewest
    rarer shingles; pairs that pass the length, positional and suffix filters are verified once, and components follow.
    Then pairs of the same group in different components are tried, which is what is left to lose no link; pairs inside
    a component, such as those of a large group of near copies, are never made; ngram_links makes them.
    """
    rule = Rule(words, num, den)
    scratch = Scratch(docs.sparkSession)
    docs = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))

    sets, classes, order = _classes(docs, rule, scratch)
    total = sets.count()
    again = sets.filter("id is not null").groupBy("id").agg(F.count("*").alias("c"), F.min(F.struct("s1", "s2", "n")).alias("lo"), F.max(F.struct("s1", "s2", "n")).alias("hi"))
    again = scratch.put(again.filter("c > 1").select("id", (F.col("lo") != F.col("hi")).alias("differ")), "again")
    repeats = not again.isEmpty()
    rows, ordered, fine = _prefix_rows(docs, classes, order, rule, repeats, scratch)

    # first the member with the fewest rarer shingles against each other member
    hub = F.min(F.struct("i", "n", "id", *SKETCH)).alias("hub")
    hubs = scratch.put(rows.groupBy("h").agg(hub, F.count("*").alias("c")).filter("c > 1").select("h", "c", "hub.*"), "hubs")
    sides = hubs.select("h", "c", F.struct("i", "n", "id", *SKETCH).alias("x"))
    met = hot_join(rows.select("h", F.struct("i", "n", "id", *SKETCH).alias("y")), sides, "h", "c", rows.count())
    met = met.filter(F.col("x.id") != F.col("y.id")).filter(_link_conditions("x", "y", rule))
    pair = [F.least("x.id", "y.id").alias("a"), F.greatest("x.id", "y.id").alias("b")]
    tried = scratch.put(met.select(*pair).distinct(), "tried")
    links = _verify(tried, docs, fine, rule, scratch)
    if repeats:  # an id with several sets is one document: the classes of its sets belong together
        named = classes.select("s1", "s2", "n", F.col("rep").alias("b"))
        owned = sets.join(again.filter("differ").select("id"), "id", "left_semi").filter("n > 0")
        links = scratch.put(links.union(owned.join(named, ["s1", "s2", "n"]).select(F.col("id").alias("a"), "b").filter("a <> b")), "owned")
    labels = scratch.put(components(links, scratch), "labels")

    # then the rest: pairs of a group that are in different components
    marked = rows.join(labels, rows["id"] == labels["node"], "left").drop("node").withColumn("comp", F.coalesce("comp", "id"))
    marked = scratch.put(marked, "marked")
    split = marked.groupBy("h").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count("*").alias("c")).filter("lo <> hi")
    split = scratch.put(split.select("h", "c"), "split")
    left = scratch.put(hot_join(marked, split, "h", "c", total), "left")
    rest = scratch.put(_met_in_blocks(left, rule, F.col("x.comp") != F.col("y.comp"), "comp").join(tried, ["a", "b"], "left_anti"), "rest")
    if not rest.isEmpty():
        links = links.unionByName(_verify(rest, docs, fine, rule, scratch))
        labels = scratch.put(components(links, scratch), "labels")
    scratch.drop(rows, hubs, marked, split, left, tried, ordered)

    member = classes.join(labels, classes["rep"] == labels["node"], "left").select("s1", "s2", "n", "members", F.coalesce("comp", "rep").alias("component_id"))
    member = scratch.put(member.withColumn("key", F.xxhash64("s1", "s2", "n")).drop("s1", "s2", "n"), "member")
    out = hot_join(sets.filter("n > 0").select("id", "n", F.xxhash64("s1", "s2", "n").alias("key")), member, "key", "members", total)
    out = out.select("id", "n", "component_id").unionByName(sets.filter("n = 0").select("id", "n", F.col("id").alias("component_id")))
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id")


def _met_in_blocks(rows: DataFrame, rule: Rule, but: Column | None = None, *more: str) -> DataFrame:
    """(a, b), a < b: pairs of prefix rows that share a shingle h, of which c rows are, and pass the filters, and `but`.

    A shingle's rows are dealt into blocks of about BLOCK, and each two blocks meet in a key of their own, so that a large
    group's pairs lie over many tasks; a group of fewer rows is one block.
    """
    m = F.ceil(F.col("c") / BLOCK).cast("int")
    dealt = rows.select("h", m.alias("m"), F.pmod(F.xxhash64("id"), m).cast("int").alias("k"), F.struct("i", "n", "id", *SKETCH, *more).alias("s"))
    x = dealt.select("h", F.col("k").alias("p"), F.explode(F.expr("sequence(k, m - 1)")).alias("q"), F.col("s").alias("x"))
    y = dealt.select("h", F.explode(F.expr("sequence(0, k)")).alias("p"), F.col("k").alias("q"), F.col("s").alias("y"))
    met = x.join(y, ["h", "p", "q"]).filter((F.col("p") < F.col("q")) | (F.col("x.id") < F.col("y.id"))).filter(_link_conditions("x", "y", rule))
    met = met if but is None else met.filter(but)
    return met.filter("x.id <> y.id").select(F.least("x.id", "y.id").alias("a"), F.greatest("x.id", "y.id").alias("b")).distinct()


def _all_pairs(rows: DataFrame, rule: Rule, scratch: Scratch) -> DataFrame:
    """(a, b), a < b: every pair of prefix rows that share a shingle and pass the filters, once.

    See _met_in_blocks for large groups.
    """
    sizes = scratch.put(rows.groupBy("h").agg(F.count("*").alias("c")).filter("c > 1"), "sizes")
    dealt = scratch.put(hot_join(rows, sizes, "h", "c", rows.count()), "dealt")
    pairs = scratch.put(_met_in_blocks(dealt, rule), "all")
    scratch.drop(sizes, dealt)
    return pairs


def ngram_links(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, num: int = 9, den: int = 10) -> tuple[DataFrame, DataFrame]:
    """(rows, links) of the join itself, without components.

    rows: one per input row: id_col, n_shingles, class_id, n_links. Rows with equal sets have the same class_id, a hash of
    the set; n_links counts the other rows that a row links with, its own class included. links: (a, b), a < b, every two
    classes that link, once. Rows with an empty set link with nothing. Every row counts as one, also those with a null
    id or with another row's. A group of n different near copies has up to n * (n - 1) / 2 links, and all are verified.
    """
    rule = Rule(words, num, den)
    scratch = Scratch(docs.sparkSession)
    docs = docs.select(F.col(id_col).cast("long").alias("given"), F.col(text_col).cast("string").alias("text"))
    docs = scratch.put(docs.withColumn("id", F.monotonically_increasing_id()), "numbered")
    given, docs = docs.select("id", "given"), docs.select("id", "text")
    sets, classes, order = _classes(docs, rule, scratch)
    rows, ordered, fine = _prefix_rows(docs, classes, order, rule, False, scratch)
    links = _verify(_all_pairs(rows, rule, scratch), docs, fine, rule, scratch)
    scratch.drop(rows, ordered)

    key = F.xxhash64("s1", "s2", "n")
    named = scratch.put(classes.select(F.col("rep").alias("v"), key.alias("class_id"), "n", "members"), "named")
    both = scratch.put(links.select(F.col("a").alias("u"), F.col("b").alias("v")).union(links.select("b", "a")), "both")
    ends = scratch.put(both.groupBy("v").agg(F.count("*").alias("c")).join(named, "v"), "ends")
    both = scratch.put(hot_join(both, ends.select("v", "c", "class_id", "members"), "v", "c", both.count()), "ended")
    more = both.groupBy("u").agg(F.sum("members").alias("more"))
    whole = named.join(more, named["v"] == more["u"], "left")
    whole = whole.select("class_id", "members", F.when(F.col("n") > 0, F.col("members") - 1 + F.coalesce("more", F.lit(0))).otherwise(F.lit(0)).alias("n_links"))
    whole = scratch.put(whole, "whole")
    out = hot_join(sets.select("id", F.col("n").alias("n_shingles"), key.alias("class_id")), whole, "class_id", "members", sets.count())
    out = out.join(given, "id").select(F.col("given").alias(id_col), "n_shingles", "class_id", "n_links")
    pairs = both.select("u", F.col("class_id").alias("other"))
    pairs = hot_join(pairs.withColumnRenamed("u", "v"), ends.select("v", "c", "class_id"), "v", "c", both.count())
    pairs = pairs.filter(F.col("class_id") < F.col("other")).select(F.col("class_id").alias("a"), F.col("other").alias("b"))
    return out, pairs


def one_of_each_group(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, num: int = 8, den: int = 10) -> DataFrame:
    """Of each group of near duplicates the row with the smallest id, with all its columns.

    Every row is a document here: of rows alike in id and text one stays, and rows with equal ids and unrelated texts all
    stay. Null ids come after all others, so a row with a null id stays only if its group has no other id. Rows without
    words stay. Columns may have any names; no rows give none. Texts that stay are not shuffled, see common.without.
    """
    scratch = Scratch(docs.sparkSession)
    rows, key = row_keys(docs, id_col, scratch)
    found = ngram_jaccard(rows.select(F.col(key).alias("row"), F.col(f"`{text_col}`").alias("text")), "row", "text", words, num, den)
    found = scratch.put(found.select("row", "component_id"), "found")
    given = rows.select(F.col(key).alias("row"), F.col(f"`{id_col}`").cast("long").alias("id"))
    if given.filter("id is null or id <> row").isEmpty():  # rows are numbered by their ids: the smallest names its group
        gone = found.filter("row <> component_id").select("row")
    else:
        first = F.min(F.struct(F.col("id").isNull().alias("last"), "id", "row")).alias("x")
        first = scratch.put(found.join(given, "row").groupBy("component_id").agg(first).select("x.row"), "first")
        gone = found.join(first, "row", "left_anti").select("row")
    gone = scratch.put(gone, "gone")
    return without(rows, key, gone, scratch).drop(key)


def op1_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_jaccard(table(spark, sf_dir, "documents"), words=3, num=9, den=10)


OP1_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT doc_id, unnest(list_distinct(CASE WHEN len(w) >= 3 THEN list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])
                                           WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END)) AS h FROM w
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM s a JOIN s b ON a.h = b.h AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * common >= 90 * (x.n + y.n - common)),
r AS (SELECT doc_id AS a, doc_id AS b FROM w UNION SELECT r.a, l.b FROM r JOIN l ON l.a = r.b)
SELECT w.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, (SELECT min(b) FROM r WHERE r.a = w.doc_id) AS component_id FROM w LEFT JOIN n ON n.doc_id = w.doc_id
"""
