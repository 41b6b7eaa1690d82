"""Shared pieces of the training-data operators: scratch tables, hot-key joins, hashed filters."""

from __future__ import annotations

import ctypes
import gc
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.operators.rounds import shared_folder
from skein.session import ship

#: A group is hot if it holds at least one row in HOT_SHARE of all rows; so there are at most HOT_SHARE hot groups.
HOT_SHARE = 1000
#: Bits of a hashed filter: at most 2**26 (8 MB), however many keys it holds.
MAX_FILTER_LOG2 = 26
#: Bits of a filter that the JVM looks up: 2**18 rows of 64 bits at most, about 12 MB on every executor.
MAX_WORDS_LOG2 = 24

#: Rows that go to Python at once, where the session has Spark's default of 10,000: texts are long, and a batch of them
#: is held by the JVM and by Python at the same time.
BATCH_ROWS = 512

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z only."""
    return F.translate(text, UPPER, LOWER)


_held: dict = {}
#: Key of the word hashes that a worker holds during a partition.
WORD_HASHES = "word hashes"


def release() -> None:
    """Gives a Python worker's freed memory back to the system; workers stay idle beside the next stage's."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def held(key, make: Callable[[], object]) -> object:
    """What a Python worker keeps between tasks, such as a tokenizer. Workers outlive a stage, so the next operator's
    needs replace those of the last one."""
    if key not in _held:
        if _held:
            _held.clear()
            release()
        _held[key] = make()
    return _held[key]


def bounded_batches(spark: SparkSession) -> None:
    """Lowers Spark's default batch of 10,000 rows to BATCH_ROWS; a session's own setting stays. Ships the package."""
    ship(spark)
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key) == "10000":
        spark.conf.set(key, str(BATCH_ROWS))


class Scratch:
    """Written tables that cut lineage: a lost executor costs a re-read of a shared file, never a recomputation."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        bounded_batches(spark)
        self.base = f"{shared_folder(spark)}/skein-{uuid.uuid4().hex}"
        self.paths: dict[int, str] = {}

    def put(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.base}/{name}-{len(self.paths)}"
        df.write.option("compression", "zstd").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(out)] = path
        out._skein_path = path
        return out

    def settle(self) -> None:
        """Has the driver forget the plans of written tables now: Spark's cleaner then removes their shuffle files, which
        else lie on the executors' disks until the driver's memory runs low."""
        gc.collect()
        for _ in range(2):  # the first finds the plans, the second what only they held
            self.spark.sparkContext._jvm.System.gc()

    def drop(self, *tables: DataFrame) -> None:
        """Deletes tables that no later plan reads."""
        jvm = self.spark.sparkContext._jvm
        for t in tables:
            path = jvm.org.apache.hadoop.fs.Path(t._skein_path)
            path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def hot_join(rows: DataFrame, groups: DataFrame, key: str, count: str, total: int, how: str = "inner") -> DataFrame:
    """rows joined with one row per key of groups, without gathering a hot key's rows in one task.

    Keys with at least total / HOT_SHARE rows (so at most HOT_SHARE of them) are joined by broadcast, where the rows
    lie; all others by a shuffle, in which no key has more rows than that.
    """
    hot = groups.filter(F.col(count) * HOT_SHARE >= F.lit(total))
    cold = groups.filter(F.col(count) * HOT_SHARE < F.lit(total))
    left = rows.join(F.broadcast(hot), key, "inner")
    rest = rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(cold, key, how)
    return left.unionByName(rest)


class HashFilter:
    """Fixed-size bitmap over 64-bit hashes. No key that is in it is ever missed; others may pass, so a join follows."""

    def __init__(self, words: np.ndarray):
        self.words = words
        self.mask = np.uint64(len(words) * 64 - 1)

    def contains(self, keys: np.ndarray) -> np.ndarray:
        at = keys.view(np.uint64) & self.mask
        return ((self.words[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1)).astype(bool)


def hash_filter(keys: DataFrame, key: str, n: int) -> HashFilter:
    """Bitmap of the long column `key` (already a hash). The driver gets at most 2**20 words, whatever the input."""
    log2 = min(MAX_FILTER_LOG2, max(12, int(n * 16).bit_length()))
    at = F.col(key).bitwiseAND(F.lit((1 << log2) - 1))
    words = (
        keys.select(F.shiftright(at, 6).alias("w"), F.expr(f"shiftleft(1L, cast({key} & 63 as int))").alias("b"))
        .groupBy("w").agg(F.bit_or("b").alias("b")).toArrow()
    )
    out = np.zeros(1 << (log2 - 6), dtype=np.uint64)
    out[words["w"].to_numpy().astype(np.int64)] = words["b"].to_numpy().astype(np.int64).view(np.uint64)
    return HashFilter(out)


def filtered(rows: DataFrame, key: str, flt: HashFilter) -> DataFrame:
    """Rows whose long column `key` may be in the filter; the column goes."""
    shared = rows.sparkSession.sparkContext.broadcast(flt)
    keep = [c for c in rows.columns if c != key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            hit = shared.value.contains(b.column(key).to_numpy(zero_copy_only=False))
            if hit.any():
                yield pa.RecordBatch.from_arrays([b.column(c) for c in keep], names=keep).filter(pa.array(hit))

    return rows.mapInArrow(run, rows.select(*keep).schema)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names like those given that df doesn't have (Spark doesn't tell upper from lower case)."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def word_filter(keys: DataFrame, key: str, scratch: Scratch) -> DataFrame:
    """(w, b): a bitmap of the long column `key` (already a hash), 64 bits a row and at most 2**MAX_WORDS_LOG2 in all."""
    log2 = min(MAX_WORDS_LOG2, max(12, int(keys.count() * 16).bit_length()))
    at = F.col(key).bitwiseAND(F.lit((1 << log2) - 1))
    words = keys.select(F.shiftright(at, 6).alias("w"), F.expr(f"shiftleft(1L, cast({key} & 63 as int))").alias("b"))
    words = scratch.put(words.groupBy("w").agg(F.bit_or("b").alias("b")), "words")
    words._skein_log2 = log2
    return words


def flagged(rows: DataFrame, key: Column, words: DataFrame, flag: str) -> DataFrame:
    """rows with a column that says whether the key (a hash) may be in the filter; no row moves."""
    w, b, k = fresh(rows, "w", "b", "k")
    at = F.col(k).bitwiseAND(F.lit((1 << words._skein_log2) - 1))
    found = rows.withColumn(k, key).join(F.broadcast(words.select(F.col("w").alias(w), F.col("b").alias(b))), F.shiftright(at, 6) == F.col(w), "left")
    hit = F.expr(f"shiftright(`{b}`, cast(`{k}` & 63 as int)) & 1L") == 1
    return found.select(*[F.col(f"`{c}`") for c in rows.columns], F.coalesce(hit, F.lit(False)).alias(flag))


def without(docs: DataFrame, key: str, dropped: DataFrame, scratch: Scratch) -> DataFrame:
    """The rows of docs whose long column `key` is not in `dropped` (one long column, no nulls).

    A bitmap of the dropped keys is looked up where the rows lie; only rows that it can't clear are shuffled to be held
    against the keys themselves, so texts that stay don't move (beyond some 10 million dropped keys more and more do).
    """
    name = dropped.columns[0]
    flag, gone = fresh(docs, "maybe", "gone")
    words = word_filter(dropped.select(F.xxhash64(F.col(name).cast("long")).alias("k")), "k", scratch)
    rows = flagged(docs, F.xxhash64(F.col(f"`{key}`").cast("long")), words, flag)
    rest = rows.filter(F.col(flag)).join(dropped.select(F.col(name).cast("long").alias(gone)).hint("merge"), F.col(f"`{key}`") == F.col(gone), "left_anti")
    return rows.filter(~F.col(flag)).unionByName(rest).select(*[F.col(f"`{c}`") for c in docs.columns])


def row_keys(docs: DataFrame, id_col: str, scratch: Scratch) -> tuple[DataFrame, str]:
    """docs and the column that tells its rows apart: the id, cast to long, where it is never null nor repeated; else rows
    are numbered and written."""
    (name,) = fresh(docs, "skein_row")
    ids = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"))
    if ids.groupBy("id").agg(F.count("*").alias("c")).filter("c > 1 or id is null").isEmpty():
        return docs.withColumn(name, F.col(f"`{id_col}`").cast("long")), name
    return scratch.put(docs.withColumn(name, F.monotonically_increasing_id()), "numbered"), name


def per_text(fn: Callable[[list, list], Iterator[pa.RecordBatch]], limit: int = 4_000_000) -> Callable:
    """For mapInArrow over two columns (id, text): calls fn(ids, texts) on runs of at most about `limit` characters,
    so that a batch of very long texts needs no more memory than one of short ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, texts, held, got = [], [], 0, zip(b.column(0).to_pylist(), b.column(1))
            for i, t in got:
                text = t.as_py()
                ids.append(i)
                texts.append(text)
                held += len(text or "") + 100
                if held >= limit:
                    yield from fn(ids, texts)
                    ids, texts, held = [], [], 0
            if ids:
                yield from fn(ids, texts)
        _held.pop(WORD_HASHES, None)  # cheap to make again, and idle workers stay beside the next stage's
        release()

    return run


def lists(values: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    """A list column from numpy arrays, without a Python object per element."""
    ends = np.zeros(len(values) + 1, dtype=np.int32)
    np.cumsum([len(v) for v in values], out=ends[1:])
    flat = np.concatenate(values) if values else np.zeros(0)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat, type=kind))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
