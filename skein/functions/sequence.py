"""Sequence and id expressions; all run inside the JVM except window expansion."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.session import ship


#: Windows that go to the JVM at once, about.
WINDOWS = 200_000


def acgt(text: Column) -> Column:
    """The letters A, C, G and T of a text, upper-cased."""
    return F.regexp_replace(F.upper(F.coalesce(text, F.lit(""))), "[^ACGT]", "")


def revcomp(seq: Column, strict: bool = False) -> Column:
    """Reverse complement; strict raises an error on any other letter."""
    out = F.translate(F.reverse(seq), "ACGT", "TGCA")
    return F.when(seq.rlike("^[ACGT]*$"), out).otherwise(F.raise_error(F.concat(F.lit("not a sequence: "), seq))) if strict else out


def windows(df: DataFrame, seq: str, k: int, keep: list[str], counted: bool = False) -> DataFrame:
    """Every window of length k of column seq, as (keep..., pos, kmer); shorter or null sequences have none. If counted, equal
    windows of a sequence are one row with its first pos and n, how many they are (of each WINDOWS of a long sequence)."""
    ship(df.sparkSession)
    rows = df.select(*keep, seq)

    def batch(b: pa.RecordBatch, at: np.ndarray, pos: np.ndarray, kmers: pa.Array) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([*(b.column(c).take(pa.array(at)) for c in range(len(keep))), pa.array(pos), kmers], names=[*keep, "pos", "kmer"])

    def plain(text: bytes) -> pa.Array:
        """All windows of ASCII letters, as one buffer."""
        data = np.lib.stride_tricks.sliding_window_view(np.frombuffer(text, np.uint8), k)
        ends = np.arange(len(data) + 1, dtype=np.int32) * k
        return pa.StringArray.from_buffers(len(data), pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(data)))

    def flush(b: pa.RecordBatch, at: list[tuple[int, int, int]], out: list[pa.Array]) -> pa.RecordBatch:
        row = np.repeat(np.array([i for i, _, _ in at], np.int32), [n for _, _, n in at])
        pos = np.concatenate([np.arange(first, first + n, dtype=np.int32) for _, first, n in at])
        return batch(b, row, pos, pa.concat_arrays(out))

    def each_once(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        row, pos, n, kmers, held = [], [], [], [], 0
        for i, s in enumerate(b.column(len(keep)).to_pylist()):
            for first in range(0, max(0, len(s or "") - k + 1), WINDOWS):
                part = s[first : first + WINDOWS + k - 1]
                if part.isascii():
                    data = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(np.frombuffer(part.encode(), np.uint8), k)).view(f"S{k}").ravel()
                else:
                    data = np.array([part[j : j + k] for j in range(len(part) - k + 1)])
                found, at, times = np.unique(data, return_index=True, return_counts=True)
                row.append(np.full(len(found), i))
                pos.append(at + first)
                n.append(times)
                kmers.append(pa.array(found.tolist(), pa.binary()).cast(pa.string()) if part.isascii() else pa.array(found.tolist(), pa.string()))
                held += len(found)
                if held >= WINDOWS:
                    yield counts_of(b, row, pos, n, kmers)
                    row, pos, n, kmers, held = [], [], [], [], 0
        if row:
            yield counts_of(b, row, pos, n, kmers)

    def counts_of(b: pa.RecordBatch, row: list, pos: list, n: list, kmers: list) -> pa.RecordBatch:
        out = batch(b, np.concatenate(row), np.concatenate(pos).astype(np.int32), pa.concat_arrays(kmers))
        return pa.RecordBatch.from_arrays([*out.columns, pa.array(np.concatenate(n).astype(np.int64))], names=[*out.schema.names, "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if counted:
                yield from each_once(b)
                continue
            at, out, held = [], [], 0
            for i, s in enumerate(b.column(len(keep)).to_pylist()):
                for first in range(0, max(0, len(s or "") - k + 1), WINDOWS):  # a long sequence comes in parts
                    part = s[first : first + WINDOWS + k - 1]
                    n = len(part) - k + 1
                    at.append((i, first, n))
                    out.append(plain(part.encode()) if part.isascii() else pa.array([part[j : j + k] for j in range(n)], pa.string()))
                    held += n
                    if held >= WINDOWS:
                        yield flush(b, at, out)
                        at, out, held = [], [], 0
            if out:
                yield flush(b, at, out)

    n = [F.lit(0).cast("long").alias("n")] if counted else []
    return rows.mapInArrow(run, rows.select(*keep, F.lit(0).alias("pos"), F.lit("").alias("kmer"), *n).schema)


def base_ids(node_id: Column) -> Column:
    """The original ids behind an id: contracted parts are joined by &, copies end in * and a suffix."""
    return F.transform(F.split(node_id, "&"), lambda x: F.substring_index(x, "*", 1))


def join_ids(ids: Column) -> Column:
    return F.array_join(ids, "&")
