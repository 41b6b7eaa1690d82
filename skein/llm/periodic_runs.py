"""Periodic runs of words: heavy/light lag counting, then island scans of the lags that have enough matches."""

from __future__ import annotations

import zlib
from bisect import bisect_right
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, per_text, table

MIN_LENGTH, MIN_EXPONENT = 6, 4
RUNS = "array<struct<start: long, length: long, period: long>>"


def words_of(text: str | None) -> list[bytes]:
    """Words between ASCII white space, as they are."""
    return (text or "").encode().split()


def _smooth(n: int) -> int:
    """The smallest length from n on that only 2, 3 and 5 divide: transforms of it are fast."""
    best = 1 << max(0, n - 1).bit_length()
    five = 1
    while five < best:
        three = five
        while three < best:
            two = three << max(0, (-(-n // three) - 1).bit_length())
            best = min(best, two) if two >= n else best
            three *= 3
        five *= 5
    return best


def lag_counts(codes: np.ndarray, most: int) -> np.ndarray:
    """counts[q], q up to `most`: how many words equal the word q further on. Exact.

    A heavy word, one with more pairs than a transform has steps, is counted by autocorrelation of its occurrences: the
    power spectra of all heavy words are added up and transformed back once; a word of f occurrences is heavy if
    2 f * f > m * log2(m), m being the padded length, so there are at most some sqrt(2 n / log2(n)). Light words are
    counted by differences of positions, the k-th next occurrence for k = 1, 2, ... until all are too far away.
    """
    n, counts = len(codes), np.zeros(most + 1, np.int64)
    size = _smooth(n + most)  # the last `most` places are empty, so nothing wraps around onto a lag that counts
    times = np.bincount(codes)
    heavy = 2.0 * times * times > size * np.log2(size)
    if heavy.any():
        power = np.zeros(size // 2 + 1)
        for word in np.flatnonzero(heavy):
            spectrum = np.fft.rfft(codes == word, size)
            power += spectrum.real**2 + spectrum.imag**2
        counts += np.rint(np.fft.irfft(power, size)[: most + 1]).astype(np.int64)
    order = np.argsort(codes, kind="stable")
    word = codes[order]
    place = order[~heavy[word]]
    light = times[~heavy]
    last = np.repeat(np.cumsum(light), light)  # where a word's places end
    at, k = np.arange(len(place)), 1
    while True:
        at = at[at + k < last[at]]
        if not len(at):
            return counts
        lag = place[at + k] - place[at]
        near = lag <= most
        at, lag = at[near], lag[near]
        if len(lag):
            counts += np.bincount(lag, minlength=most + 1)
        k += 1


def runs_of(codes: np.ndarray, min_length: int = MIN_LENGTH, min_exponent: int = MIN_EXPONENT) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run, by start and period.

    A run has period q, none smaller, at least max(min_length, min_exponent * q) words, and can't be longer. At lag q it
    is an island of matching words, of at least as many as that less q. Lags go up; a lag is scanned only if it has so
    many matches beside those inside runs found so far whose period divides it. (A run of period q shares fewer than q
    words with such a run, else it would have that period itself; so none of its matches lies there.)
    """
    n = len(codes)
    if n < min_length:
        return []
    most = n // min_exponent
    q = np.arange(most + 1)
    spare = lag_counts(codes, most) - np.maximum(min_length - q, (min_exponent - 1) * q)
    found, ends = [], {}  # ends: of each period the starts and ends of its runs, which overlap by less than the period
    for q in (np.flatnonzero(spare[1:] >= 0) + 1).tolist():
        if spare[q] < 0:  # found runs explain its matches
            continue
        least = max(min_length - q, (min_exponent - 1) * q)
        stops = np.concatenate([[-1], np.flatnonzero(codes[q:] != codes[:-q]), [n - q]])
        islands = np.diff(stops) - 1
        for k in np.flatnonzero(islands >= least):
            start, length = int(stops[k]) + 1, int(islands[k]) + q
            inside = False
            for d, (starts, lasts) in ends.items():
                if q % d == 0 and (j := bisect_right(starts, start)) and lasts[j - 1] >= start + length:
                    inside = True
                    break
            if not inside:
                found.append((start, length, q))
                starts, lasts = ends.setdefault(q, ([], []))
                starts.append(start)
                lasts.append(start + length)
                more = np.arange(2 * q, min(most, length - 1) + 1, q)
                spare[more] -= length - more
    return sorted(found, key=lambda r: (r[0], r[2]))


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """The words but those of each run after its first period."""
    if not runs:
        return words
    keep = np.ones(len(words), bool)
    for start, length, period in runs:
        keep[start + period : start + length] = False
    return [words[k] for k in np.flatnonzero(keep).tolist()]


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rewrite: Callable[[int | None, list[bytes]], list[bytes]] | None = None, min_length: int = MIN_LENGTH, min_exponent: int = MIN_EXPONENT) -> DataFrame:
    """One row per document: id_col, n_words, runs (start, length, period; by start, then period) and collapsed, the text
    without the words of each run after its first period, words joined by one space.

    Words lie between ASCII white space and are numbered from 0; they are equal if their bytes are. `rewrite` may change a
    document's words (id, words) before runs are looked for. Null, empty and white texts have no words, no runs and an
    empty collapsed text. Rows with null or repeated ids are documents of their own. Other columns are not looked at; no
    rows give none.

    Nothing is shuffled: a text's runs depend on nothing else. A text is handled whole, in some 100 bytes a word.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def some(ids: list, texts: list) -> Iterator[pa.RecordBatch]:
        counts, spans, left = [], [], []
        for i, text in zip(ids, texts):
            words = words_of(text)
            if rewrite:
                words = rewrite(i, words)
            number = {w: k for k, w in enumerate(dict.fromkeys(words))}
            codes = np.fromiter(map(number.__getitem__, words), np.int32, len(words))
            runs = runs_of(codes, min_length, min_exponent)
            counts.append(len(words))
            spans.append([dict(zip(("start", "length", "period"), r)) for r in runs])
            left.append(b" ".join(collapsed(words, runs)).decode())
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(counts, pa.int64()), pa.array(spans, kind), pa.array(left, pa.string())], names=["id", "n_words", "runs", "collapsed"])

    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    out = rows.mapInArrow(per_text(some), f"id long, n_words long, runs {RUNS}, collapsed string")
    return out.select(F.col("id").alias(id_col), "n_words", "runs", "collapsed")


def strongest(runs: Column) -> Column:
    """Of runs the one with the greatest length / period, compared as fractions; of equal ones the first, then that of the
    smallest period. Null without runs."""

    def better(best: Column, run: Column) -> Column:
        more = run["length"] * best["period"] > best["length"] * run["period"]
        return F.when(best.isNull() | more, run).otherwise(best)  # runs come by start and period, so ties stay

    return F.aggregate(runs, F.lit(None).cast("struct<start: long, length: long, period: long>"), better)


def planted(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """The words of op13's contract: of one document in ten, by a hash of its id, all from some word on repeat a period."""
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    if doc_id is None or h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + (i - a) % p] for i in range(a, n)]


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs(table(spark, sf_dir, "documents").select("doc_id", "text"), rewrite=planted)
    best = strongest(F.col("runs"))
    line = lambda r: F.concat(F.concat_ws(",", *(r[c].cast("string") for c in ("start", "length", "period"))), F.lit("\n"))
    found = found.select("doc_id", "runs", "collapsed", best.alias("best"))
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
        F.floor(F.lit(1000) * F.col("best.length") / F.col("best.period")).alias("exponent_milli"),
        F.sha2(F.array_join(F.transform("runs", line), ""), 256).alias("runs_sha256"), F.sha2(F.col("collapsed"), 256).alias("collapsed_sha256"),
    )
