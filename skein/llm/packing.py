"""Harmonic packing of token sequences.

Piece lengths are partitioned into reciprocal classes: class k holds lengths in (C / (k + 1), C / k], and a bin of class k
takes exactly k pieces. Bins of a class never wait for another class, so workers fill them independently; what remains
on each worker is filled the same way in a second, far smaller step. Documents are cut at reciprocal lengths, which
leaves a class's bins almost full.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, held, per_text, release, table

CAPACITY = 2048
END_ID = 1
#: A piece may leave at most this share of its class's length unused; else it is cut once more. Pieces of up to SHORT
#: tokens are never cut, as their classes are next to each other.
SLACK = 0.01
SHORT = 45
#: Remainders of so many workers are packed together.
WORKERS = 256
TOKENIZER = "word_bpe_49k.json"
#: Words whose ids a worker remembers, about 200 bytes each.
CACHED_WORDS = 700_000
#: A worker gives freed memory back after so many runs of about a million characters.
RUNS = 12


class WordTokenizer:
    """Ids of whole texts as little-endian 32-bit bytes.

    The tokenizer lower-cases, its words never cross white space, and its normalisation doesn't reach across it; so a
    text's ids are those of its parts between ASCII white space, one after the other, and A-Z can be lower-cased first.
    Not so in parts with CONTROL, how the tokenizer's control tokens begin: it looks for those before it lower-cases, so
    such parts are encoded as they are. A run of TAIL after an ASCII letter or digit is a word of its own. Ids of parts
    are remembered, up to a bound. Parts that are letters only are encoded many at a time: each ends with the only token
    that ends a word.
    """

    TAIL = b".,!?;:"
    CONTROL = b"<|"

    def __init__(self, path: str, cached: int = CACHED_WORDS):
        from tokenizers import Tokenizer

        self.cached = cached
        self.inner = Tokenizer.from_file(path)
        self.many = getattr(self.inner, "encode_batch_fast", self.inner.encode_batch)  # the fast one leaves out offsets
        self.known: dict[bytes, bytes] = {}
        vocab = self.inner.get_vocab()
        self.ends = np.zeros(max(vocab.values()) + 1, bool)
        self.ends[[i for t, i in vocab.items() if t.endswith("</w>")]] = True

    def learn(self, words: set[bytes]) -> None:
        known, halves, todo = self.known, [], set()
        for w in words:
            if w.isalpha():
                todo.add(w)
                continue
            core = w.rstrip(self.TAIL)
            if core is not w and self.CONTROL not in w and core and core[-1] < 128 and core[-1:].isalnum():
                tail = w[len(core) :]
                halves.append((w, core, tail))
                todo.add(core)
                todo.add(tail)
            else:
                todo.add(w)
        fast, slow = [], []
        for w in todo.difference(known):
            (fast if w.isalpha() or (t := w.decode()).isalpha() and t.lower().isalpha() else slow).append(w)
        for i in range(0, len(fast), 2000):
            some = fast[i : i + 2000]
            ids = np.array(self.many([b" ".join(some).decode()], add_special_tokens=False)[0].ids, "<u4")
            cut = (4 * (np.flatnonzero(self.ends[ids]) + 1)).tolist()
            if len(cut) != len(some):  # not the words expected: encode them one by one
                slow += some
                continue
            data = ids.tobytes()
            known.update(zip(some, map(data.__getitem__, map(slice, [0, *cut], cut))))
        for i in range(0, len(slow), 20_000):
            some = slow[i : i + 20_000]
            found = self.many([w.decode() for w in some], add_special_tokens=False)
            known.update((w, np.array(e.ids, "<u4").tobytes()) for w, e in zip(some, found))
        for w, core, tail in halves:
            known[w] = known[core] + known[tail]

    def split(self, data: bytes) -> list[bytes]:
        if self.CONTROL not in data:
            return data.lower().split()
        return [w if self.CONTROL in w else w.lower() for w in data.split()]

    def encode(self, texts: list[str | None]) -> list[bytes]:
        if len(self.known) > self.cached:
            self.known.clear()
        parts = [self.split((t or "").encode()) for t in texts]
        found = [list(map(self.known.get, p)) for p in parts]
        new = [[i for i, ids in enumerate(f) if ids is None] for f in found]
        self.learn({p[i] for p, at in zip(parts, new) for i in at})
        for p, f, at in zip(parts, found, new):
            for i in at:
                f[i] = self.known[p[i]]
        return [b"".join(f) for f in found]


def tokenizer(name: str, cached: int = CACHED_WORDS) -> WordTokenizer:
    def make() -> WordTokenizer:
        import os

        import public_tokenizers

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        return WordTokenizer(name if os.path.isabs(name) else public_tokenizers.path(name), cached)

    return held(("words", name, cached), make)


def cuts(length: int, capacity: int = CAPACITY) -> list[int]:
    """Lengths of the pieces of a document: whole bins, then the longest reciprocal length that fits, until what remains
    nearly fills its class."""
    out = [capacity] * (length // capacity)
    left = length % capacity
    while left:
        full = capacity // (capacity // left)  # the longest length of the class of `left`
        if left <= SHORT or full - left <= SLACK * full:
            out.append(left)
            break
        part = capacity // (capacity // left + 1)  # the next class's length; it is shorter than what is left
        out.append(part)
        left -= part
    return out


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokens: str = TOKENIZER, with_ids: bool = True, cached: int = CACHED_WORDS) -> DataFrame:
    """One row per piece: id_col, start, length, ids_crc32, doc_tokens, sequence_id, offset, and ids if with_ids, 32 bits
    each, little-endian. A worker remembers the ids of so many words; fewer take less memory and more time.

    A document is the ids of its whole text (null: empty), then END_ID; so even an empty text gives a piece. Pieces of a
    row lie one after the other from start 0; no sequence is longer than CAPACITY and offsets have no gaps. Rows with
    equal or null ids are separate documents. Equal input files give equal sequences; no rows give none. A very long text
    is one string, its parts and its ids in memory, some 15 bytes a character. Other columns are not looked at.

    The first step is one pass without a shuffle, bins being numbered by worker; only pieces of bins that a worker
    couldn't fill move, fewer than k per class k and worker, in groups of WORKERS workers; so a task of the second step
    has fewer than k * WORKERS pieces of a class, whatever the input.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark)
    schema = "id long, start long, length long, ids_crc32 long, doc_tokens long, k int, worker long, bin long, offset long, ids binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        worker, open_bins, made, runs = TaskContext.get().partitionId(), {}, 0, 0

        def out(rows: list[tuple]) -> pa.RecordBatch:
            cols = list(zip(*rows)) if rows else [[]] * 10
            kinds = [pa.int64()] * 5 + [pa.int32()] + [pa.int64()] * 3 + [pa.binary()]
            names = ["id", "start", "length", "ids_crc32", "doc_tokens", "k", "worker", "bin", "offset", "ids"]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names=names)

        def fill(ids: list, texts: list) -> Iterator[pa.RecordBatch]:
            nonlocal made, runs
            runs += 1
            if runs % RUNS == 0:
                release()
            rows = []
            for i, data in zip(ids, tokenizer(tokens, cached).encode(texts)):
                data += END_ID.to_bytes(4, "little")
                start = 0
                for length in cuts(len(data) // 4):
                    piece = data[4 * start : 4 * (start + length)]
                    row = (i, start, length, zlib.crc32(piece), len(data) // 4, CAPACITY // length, worker)
                    waiting = open_bins.setdefault(row[5], [])
                    waiting.append((row, piece if with_ids else None))
                    if len(waiting) == row[5]:
                        offset = 0
                        for r, ids_ in waiting:
                            rows.append((*r, made, offset, ids_))
                            offset += r[2]
                        made += 1
                        waiting.clear()
                    start += length
            yield out(rows)

        yield from per_text(fill, 1_000_000)(batches)
        yield out([(*r, None, None, ids_) for waiting in open_bins.values() for r, ids_ in waiting])

    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"))
    pieces = scratch.put(rows.mapInArrow(run, schema), "pieces")
    full = pieces.filter("bin is not null").withColumn("sequence_id", F.col("worker") * (1 << 31) + F.col("bin"))
    group = F.floor(F.col("worker") / WORKERS)
    rest = pieces.filter("bin is null").withColumn("g", group)
    order = Window.partitionBy("g", "k").orderBy("worker", "id", "start", "doc_tokens", "ids_crc32")
    rest = rest.withColumn("bin", F.floor((F.row_number().over(order) - 1) / F.col("k")))
    inside = Window.partitionBy("g", "k", "bin").orderBy("worker", "id", "start", "doc_tokens", "ids_crc32").rowsBetween(Window.unboundedPreceding, -1)
    rest = rest.withColumn("offset", F.coalesce(F.sum("length").over(inside), F.lit(0)))
    # below all ids of the first step, which are not negative
    rest = rest.withColumn("sequence_id", -1 - ((F.col("g") * (CAPACITY + 1) + F.col("k")) * (1 << 31) + F.col("bin"))).drop("g")
    out = full.unionByName(rest)
    cols = [F.col("id").alias(id_col), "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    return out.select(*cols, *(["ids"] if with_ids else []))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), with_ids=False)
