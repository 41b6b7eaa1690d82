"""Cross-tokenizer alignment in relations: posexplode, windowed cumulative lengths, an equi-join on ends, running cut counts.

Both tokenizers work on a text's segments one by one (see cut), so a corpus is aligned over its distinct segments: tokens
are exploded, summed up and joined once for each segment, and documents, which are lists of segments, take what their
segments have.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, held, hot_join, lists, per_text, release, table

BYTE_BPE, PIECE_BPE = "byte_bpe_50k.json", "piece_bpe_32k.model"
#: Characters of texts that share one list of segments; a task holds the distinct ones among them.
PART = 32_000_000
#: Pairs of ids that are sent to every task; more of them are joined by a shuffle.
MOST_PAIRS = 1_000_000
#: Segments whose results a task holds before it sends them on, bundled by part.
BUNDLED = 200_000
#: Links of a segment whose text goes with each of them.
SHORT = 64
#: Marks the key of a segment that has neither a space nor a line feed before it.
MARK = "\x01"
#: Texts with white space beside white space, or at the end, or with the mark.
_IRREGULAR = re.compile(r"\s\s|\s$|\x01")
_CUT = re.compile(r"(?<=\S)(?=[ \n]\S)")
#: Punctuation between a Latin or Cyrillic letter or digit and a single white space.
_PUNCTUATION = re.compile("(?<=[A-Za-z0-9\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f\u0400-\u045f])([.,;:!?])(?=[ \n])")


def cut(text: str) -> list[str]:
    """The segments of a space and the text, as keys (see segment).

    A segment begins at a single space or line feed between two characters that aren't white space, or is punctuation
    after a letter or digit and before such a place. No token of a byte-level BPE crosses these, as its pattern starts a
    word there, nor does a piece: pieces have their space first and don't mix letters and such punctuation, and line feeds
    are bytes of their own. So a text's tokens are those of its segments, one after the other.
    """
    s = " " + text
    if _IRREGULAR.search(s):
        return [x[1:] if x[0] == " " and x[1:2] not in (" ", "\n", MARK, "") else x for x in _CUT.split(s)]
    return _PUNCTUATION.sub(" \x01\\1", s).replace("\n", " \n").split(" ")[1:]


def segment(key: str) -> str:
    """Most segments begin with a space, which is left out of their key."""
    return key[1:] if key[0] == MARK else key if key[0] in " \n" else " " + key


def _file(name: str) -> str:
    import os

    import public_tokenizers

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    return name if os.path.isabs(name) else public_tokenizers.path(name)


class Tokenizers:
    """Ids of segments by both tokenizers, and the bytes of every id."""

    def __init__(self, byte_bpe: str, piece_bpe: str):
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(_file(byte_bpe))
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=_file(piece_bpe))
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that stand for themselves; the others follow
        byte = {chr(c): c for c in shown} | {chr(256 + k): c for k, c in enumerate(sorted(set(range(256)).difference(shown)))}
        self.bytes_a = [b""] * self.a.get_vocab_size()
        for token, i in self.a.get_vocab().items():
            self.bytes_a[i] = bytes(map(byte.__getitem__, token)) if all(c in byte for c in token) else token.encode()
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.space = self.b.piece_to_id("▁")
        self.good: set[str] = set()

    def encode(self, keys: list[str]) -> list[tuple[list[int], list[int]]]:
        """Ids of both of each segment; none of either where the bytes of one aren't the segment's."""
        whole = [segment(k) for k in keys]
        a = [e.ids for e in self.a.encode_batch(whole, add_special_tokens=False)]
        # it adds a space, which is a piece of its own before a line feed, as that is after it
        b = self.b.encode([s[1:] if s[0] == " " else s if s[0] == "\n" else "\n" + s for s in whole], num_threads=1)
        out = []
        for s, x, y in zip(whole, a, b):
            data = s.encode()
            if s[0] != " " and y[:1] == [self.space]:
                y = y[1:] if s[0] == "\n" else y[2:]
            same = b"".join(map(self.bytes_a.__getitem__, x)) == data == b"".join(map(self.bytes_b.__getitem__, y))
            out.append((x, y) if same else ([], []))
        return out

    def keeps(self, text: str) -> bool:
        """Whether both tokenizers give back all characters of the text."""
        new = set(text).difference(self.good)
        if new:
            ok = [c for c in new if b"".join(map(self.bytes_b.__getitem__, self.b.encode("x" + c + "x"))) == f" x{c}x".encode()]
            self.good.update(ok)
            return len(ok) == len(new)
        return True


def tokenizers(byte_bpe: str, piece_bpe: str) -> Tokenizers:
    return held(("pair", byte_bpe, piece_bpe), lambda: Tokenizers(byte_bpe, piece_bpe))


def _dealt(docs: DataFrame, names: tuple[str, str]) -> DataFrame:
    """Of (id, text): a row (part, id, codes) for each document, codes naming its segments by their places in the part's
    list, null if it has no tokens; and a row (part, place, key, n) for each distinct segment of a part."""
    kinds = "part long, id long, codes binary, place int, key string, n long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        own = TaskContext.get().partitionId() << 24
        known: dict[str, int] = {}
        parts, chars, times = 0, 0, np.zeros(0, np.int64)

        def out(size: int, **cols: list) -> pa.RecordBatch:
            kind = {"part": pa.int64(), "id": pa.int64(), "codes": pa.binary(), "place": pa.int32(), "key": pa.string(), "n": pa.int64()}
            return pa.RecordBatch.from_arrays([pa.array(cols.get(c, [None] * size), k) for c, k in kind.items()], names=list(kind))

        def ended() -> Iterator[pa.RecordBatch]:
            nonlocal known, parts, chars, times
            keys = list(known)
            for i in range(0, len(keys), 20_000):
                some = keys[i : i + 20_000]
                yield out(len(some), part=[own + parts] * len(some), place=list(range(i, i + len(some))), key=some, n=times[i : i + 20_000])
            known, parts, chars, times = {}, parts + 1, 0, np.zeros(0, np.int64)

        def deal(ids: list, texts: list) -> Iterator[pa.RecordBatch]:
            nonlocal chars, times
            pair, codes, met = tokenizers(*names), [], []
            for t in texts:
                if not t or not pair.keeps(t):
                    codes.append(None)
                    continue
                keys = cut(t)
                for k in keys:
                    if k not in known:
                        known[k] = len(known)
                at = np.fromiter(map(known.__getitem__, keys), np.uint32, len(keys))
                met.append(at)
                codes.append(zlib.compress(at.tobytes(), 1))
                chars += len(t)
            if met:
                times = np.concatenate([times, np.zeros(len(known) - len(times), np.int64)])
                times += np.bincount(np.concatenate(met), minlength=len(known))
            yield out(len(ids), part=[own + parts] * len(ids), id=ids, codes=codes)
            if chars > PART:
                yield from ended()

        yield from per_text(deal, 1_000_000)(batches)
        yield from ended()

    return docs.mapInArrow(run, kinds)


def _encoded(keys: DataFrame, names: tuple[str, str]) -> DataFrame:
    """(key, n) with the ids of both tokenizers, a and b."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = tokenizers(*names).encode(batch.column("key").to_pylist())
            a, b = (lists([np.array(x[k], np.int32) for x in found], pa.int32()) for k in (0, 1))
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("n"), a, b], names=["key", "n", "a", "b"])
        release()

    return keys.mapInArrow(run, "key string, n long, a array<int>, b array<int>")


def token_ends(rows: DataFrame, key: str, lengths: DataFrame, *keep: str) -> DataFrame:
    """(key, side, end, id, keep...): a row for each token of the arrays a and b, side 0 and 1, with the byte where it ends:
    the running sum of the lengths (side, id, bytes) of the tokens of its side so far. Columns kept come with the first
    token of a side only."""
    sides = F.explode(F.array(*(F.struct(F.lit(k).alias("side"), F.col(c).alias("ids")) for k, c in enumerate("ab")))).alias("x")
    tokens = rows.select(key, *keep, sides).select(key, *keep, "x.side", F.posexplode("x.ids").alias("pos", "id"))
    tokens = tokens.select(key, "side", "pos", "id", *(F.when(F.col("pos") == 0, F.col(c)).alias(c) for c in keep)).join(F.broadcast(lengths), ["side", "id"])
    so_far = Window.partitionBy(key, "side").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return tokens.select(key, "side", F.sum("bytes").over(so_far).alias("end"), "id", *keep)


def aligned(tokens: DataFrame, key: str, *keep: str) -> DataFrame:
    """(key, side, end, id, other, grp, keep...) of tokens (key, side, end, id) of both sides: the token of the other side that
    ends at the same byte, or null, and the number of the group: the cuts, ends of both, before it. Where the tokens lie by
    key, nothing is shuffled."""
    theirs = tokens.select(key, (1 - F.col("side")).alias("side"), "end", F.col("id").alias("other"), *(F.col(c).alias(f"{c}_") for c in keep))
    before = Window.partitionBy(key, "side").orderBy("end").rowsBetween(Window.unboundedPreceding, -1)
    both = tokens.join(theirs, [key, "side", "end"], "left")
    return both.select(key, "side", "end", "id", "other", F.count("other").over(before).alias("grp"), *(F.coalesce(c, f"{c}_").alias(c) for c in keep))


def _per_segment(tokens: DataFrame) -> DataFrame:
    """(sid, key, n, groups, links) of the tokens of segments `sid`; groups is text, links are the pairs that end together."""

    def ids(side: int) -> Column:
        rows = F.array_sort(F.collect_list(F.when(F.col("side") == side, F.struct("end", "id"))))
        return F.array_join(F.transform(rows, lambda x: x["id"].cast("string")), ",")

    link = F.when((F.col("side") == 0) & F.col("other").isNotNull(), F.struct(F.col("id").alias("a"), F.col("other").alias("b")))
    groups = aligned(tokens, "sid", "key", "n").groupBy("sid", "grp")
    groups = groups.agg(F.concat(ids(0), F.lit("|"), ids(1)).alias("text"), F.max(link).alias("link"), F.max("key").alias("key"), F.max("n").alias("n"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("grp", "text"))), lambda x: x["text"]), ";")
    return groups.groupBy("sid").agg(F.max("key").alias("key"), F.max("n").alias("n"), text.alias("groups"), F.collect_list("link").alias("links"))


def pair_counts(links: DataFrame) -> DataFrame:
    """(a, b, count, best) of links (a, b, n): how often the corpus links two ids, and whether no other a of b has more."""
    counts = links.groupBy("a", "b").agg(F.sum("n").alias("count"))
    return counts.join(counts.groupBy("b").agg(F.max("count").alias("most")), "b").select("a", "b", "count", (F.col("count") == F.col("most")).alias("best"))


def _weighed(found: DataFrame, key: str, pairs: DataFrame, scratch: Scratch, *keep: str) -> DataFrame:
    """(key, keep..., n_best, count_sum) of segments by what their links count. Pairs are sent to every task if there are at
    most MOST_PAIRS of them, else those of very many links."""
    links = found.select(key, *keep, F.explode("links").alias("ab"))
    known = pairs.select(F.struct("a", "b").alias("ab"), "count", "best")
    if pairs.count() <= MOST_PAIRS:
        rows = links.join(F.broadcast(known), "ab")
    else:
        often = scratch.put(known.join(links.groupBy("ab").agg(F.count("*").alias("rows")), "ab"), "often")
        rows = hot_join(links, often, "ab", "rows", links.count())
    return rows.groupBy(key).agg(*(F.first(c).alias(c) for c in keep), F.count_if("best").alias("n_best"), F.sum("count").alias("count_sum"))


def _bundles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(part, line) to compressed bundles of a part's lines: a row takes far less of them than of lines of their own."""
    held: dict[int, list[str]] = {}

    def out() -> pa.RecordBatch:
        lines = [zlib.compress("\n".join(x).encode(), 1) for x in held.values()]
        return pa.RecordBatch.from_arrays([pa.array(list(held), pa.int64()), pa.array(lines, pa.binary())], names=["part", "lines"])

    rows = 0
    for b in batches:
        for part, line in zip(b.column("part").to_pylist(), b.column("line").to_pylist()):
            held.setdefault(part, []).append(line)
        rows += b.num_rows
        if rows > BUNDLED:
            yield out()
            held, rows = {}, 0
    if held:
        yield out()


def align(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", byte_bpe: str = BYTE_BPE, piece_bpe: str = PIECE_BPE) -> tuple[DataFrame, DataFrame]:
    """(documents, pairs). documents, a row each: id_col, n_a, n_b, n_groups, n_links, n_best, count_sum, groups.

    a are the ids of a space and the text by the byte-level BPE, b those of the text by the piece BPE, which adds the space;
    strings of special tokens are plain text. Byte offsets where tokens of both end cut them into groups, written
    `a1,a2|b1;a3|b2,b3`. Links are the pairs of tokens that end together; pairs (a, b, count, best) counts them over all
    documents; n_best are those with the largest count of their b, ties included, count_sum is the sum of their counts.
    Null and empty texts, and those that a tokenizer doesn't give back, such as with U+2581, have no tokens: zeros, and an
    empty text for groups. Rows with null or repeated ids are documents of their own and each counts. Other columns are
    not looked at; no rows give none.

    Texts move as lists of segments. A task holds the distinct segments of some PART characters of texts, and a very long
    text, its segments or one very long segment whole. Links of very common pairs meet their counts by broadcast.
    """
    spark = docs.sparkSession
    scratch, names = Scratch(spark), (byte_bpe, piece_bpe)
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    dealt = scratch.put(_dealt(rows, names), "dealt")
    placed = dealt.filter("key is not null").select("part", "place", "key", "n")
    distinct = placed.groupBy("key").agg(F.sum("n").alias("n"))
    segments = scratch.put(_encoded(distinct, names).withColumn("sid", F.monotonically_increasing_id()), "segments")
    scratch.settle()

    pair = Tokenizers(*names)
    sizes = [(side, i, len(x)) for side, data in enumerate((pair.bytes_a, pair.bytes_b)) for i, x in enumerate(data)]
    sizes = spark.createDataFrame(pa.table({c: pa.array(x, pa.int32()) for c, x in zip(("side", "id", "bytes"), zip(*sizes))}))
    whole = "spark.sql.requireAllClusterKeysForCoPartition"  # tokens are dealt by segment once; a join on segment and end needs no other deal
    was = spark.conf.get(whole)
    spark.conf.set(whole, "false")
    try:
        # the filter is what the join would add on one side only; with it both sides read the same shuffle
        tokens = token_ends(segments.filter("sid is not null").repartition("sid"), "sid", sizes, "key", "n")
        found = scratch.put(_per_segment(tokens), "found")
    finally:
        spark.conf.set(whole, was)
    scratch.settle()

    pairs = scratch.put(pair_counts(found.select("n", F.explode("links").alias("l")).select("n", "l.a", "l.b")), "pairs")
    scratch.settle()
    # texts of short segments go with their links, so they move once; those of long ones wait for the sums
    short = F.size("links") <= SHORT
    weighed = _weighed(found.filter(short), "key", pairs, scratch, "groups")
    long = found.filter(~short).select("sid", "key", "groups").join(_weighed(found.filter(~short), "sid", pairs, scratch), "sid").drop("sid")
    weighed = weighed.unionByName(long)
    given = placed.drop("n").join(weighed, "key").select("part", F.concat_ws("\t", "place", "n_best", "count_sum", "groups").alias("line"))
    given = given.mapInArrow(_bundles, "part long, lines binary").select("part", "lines", F.lit(None).cast("long").alias("id"), F.lit(None).cast("binary").alias("codes"))
    of_docs = dealt.filter("key is null").select("part", F.lit(None).cast("binary").alias("lines"), "id", "codes")
    both = given.unionByName(of_docs).repartition("part").sortWithinPartitions("part", F.col("lines").isNull())
    numbers = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum"]

    def assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows of a part: the bundles of its segments, which come first, then its documents."""
        part, texts, values = None, {}, {}

        def out(rows: list[tuple]) -> pa.RecordBatch:
            cols = list(zip(*rows))
            return pa.RecordBatch.from_arrays([pa.array(c, pa.string() if k == "groups" else pa.int64()) for k, c in zip(["id", *numbers, "groups"], cols)], names=["id", *numbers, "groups"])

        def learn(lines: str) -> None:
            for line in lines.split("\n"):
                place, best, total, text = line.split("\t")
                place, groups = int(place), text.count(";") + 1  # each is a list of a, a bar and a list of b
                left = sum(x.count(",", 0, x.index("|")) for x in text.split(";")) if "," in text else 0
                texts[place] = text
                values[place] = (groups + left, groups + text.count(",") - left, groups, groups, int(best), int(total))

        for batch in batches:
            parts = batch.column("part").to_numpy()
            starts = [0, *(np.flatnonzero(np.diff(parts)) + 1).tolist(), len(parts)]
            for lo, hi in zip(starts, starts[1:]):
                some = batch.slice(lo, hi - lo)
                if hi > lo and parts[lo] != part:
                    part, texts, values, table_ = parts[lo], {}, {}, None
                of_segments = some.column("lines").is_valid()
                for lines in some.filter(of_segments).column("lines"):
                    learn(zlib.decompress(lines.as_buffer()).decode())
                mine = some.filter(pc.invert(of_segments))
                if mine.num_rows and table_ is None:
                    table_ = np.zeros((max(values, default=-1) + 1, len(numbers)), np.int64)
                    if values:
                        table_[list(values)] = list(values.values())
                        values = {}
                rows, size = [], 0
                for i, codes in zip(mine.column("id").to_pylist(), mine.column("codes")):
                    at = np.frombuffer(zlib.decompress(codes.as_buffer()), np.uint32) if codes.is_valid else np.zeros(0, np.uint32)
                    own = list(map(texts.get, at.tolist()))  # none for segments that a tokenizer doesn't give back
                    if not own or None in own:
                        rows.append((i, *[0] * len(numbers), ""))
                    else:
                        rows.append((i, *table_[at].sum(0).tolist(), ";".join(own)))
                        size += len(rows[-1][-1])
                    if size > 4_000_000:
                        yield out(rows)
                        rows, size = [], 0
                if rows:
                    yield out(rows)
        release()

    kinds = "id long, " + ", ".join(f"{c} long" for c in numbers) + ", groups string"
    return both.mapInArrow(assemble, kinds).select(F.col("id").alias(id_col), *numbers, "groups"), pairs


def op12_cross_tokenizer(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents, _ = align(table(spark, sf_dir, "documents").select("doc_id", "text"))
    digest = F.when(F.col("n_a") > 0, F.sha2("groups", 256)).otherwise(F.lit(""))
    return documents.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", digest.alias("groups_sha256"))
