"""Quality rules: plain limits, then gradient-boosted trees over document statistics.

The trees learn from labelled documents, with monotonic constraints on the shares that can only speak against a document,
and are flattened into numpy arrays for scoring whole batches.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, per_text, table
from .ngram_jaccard import word_hashes
from .trees import Ensemble, boost

MIN_WORDS = 10
WINDOW = 5
#: At most so many labelled documents are learned from, the first by a hash of the id over all labelled rows.
SAMPLE = 8192
#: A document goes if the trees give it at least this probability of being bad.
BAD = 0.5
WHITE, SYMBOLS = b" \t\n\x0b\x0c\r", b"#*$%&|<>"
UPPER, DIGITS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789"
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_upper", "n_digits", "n_bangs", "n_lines", "n_distinct"]
#: Features, and whether the probability of being bad may not fall (+1) as they rise.
FEATURES = {
    "log_words": 0, "word_length": 0, "symbol_share": 1, "dup_line_share": 1, "repeat_share": 1,
    "upper_share": 1, "digit_share": 0, "bang_share": 1, "line_words": 0, "distinct_share": 0,
}
_M = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)]


def statistics(text: str | None) -> tuple[int, ...]:
    """COUNTS of one whole text."""
    data = (text or "").encode()
    words = data.split()  # bytes: ASCII white space only
    n = len(words)
    less = lambda drop: len(data) - len(data.translate(None, drop))
    lines = data.split(b"\n")
    worded = [x for x in lines if x.strip(WHITE)]
    repeat = 0
    if n > WINDOW:
        w = word_hashes(words)
        h = sum((w[k : n - WINDOW + 1 + k] ^ (w[k : n - WINDOW + 1 + k] >> np.uint64(31 - k))) * _M[k] for k in range(WINDOW))
        s = np.sort(h)
        again = s[1:][s[1:] == s[:-1]]
        if len(again):
            at = np.minimum(np.searchsorted(again, h), len(again) - 1)
            start = np.flatnonzero(again[at] == h)
            edge = np.zeros(n + 1, np.int64)
            np.add.at(edge, start, 1)
            np.add.at(edge, start + WINDOW, -1)
            repeat = int((np.cumsum(edge)[:n] > 0).sum())
    return (n, len(text or "") - less(WHITE), less(SYMBOLS), len(worded) - len(set(worded)), repeat,
            less(UPPER), less(DIGITS), data.count(b"!"), len(worded), len(set(words)))


def _counts(ids: list, texts: list) -> Iterator[pa.RecordBatch]:
    cols = zip(*map(statistics, texts))
    yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), *(pa.array(c, pa.int64()) for c in cols)], names=["id", *COUNTS])


def features(cols: dict[str, np.ndarray]) -> np.ndarray:
    c = {k: v.astype(float) for k, v in cols.items()}
    words, chars, lines = np.maximum(c["n_words"], 1), np.maximum(c["word_chars"], 1), np.maximum(c["n_lines"], 1)
    return np.stack([
        np.log1p(c["n_words"]), c["word_chars"] / words, c["n_symbols"] / chars, c["n_dup_lines"] / lines, c["n_repeat_words"] / words,
        c["n_upper"] / chars, c["n_digits"] / chars, c["n_bangs"] / words, c["n_words"] / lines, c["n_distinct"] / words,
    ], 1)


def train(stats: DataFrame, labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality") -> Ensemble | None:
    """Trees for `bad` (label 0) from labelled documents; None without labels of both kinds."""
    rows = labels.filter(F.col(label_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), (F.col(label_col) == 0).cast("int").alias("bad"))
    rows = rows.groupBy("id").agg(F.max("bad").alias("bad")).withColumn("r", F.xxhash64("id"))
    rows = rows.orderBy("r", "id").limit(SAMPLE)  # top-k on each task, then of those
    one = F.min(F.struct(*COUNTS)).alias("x")  # rows with equal ids are one to learn from, so the driver gets SAMPLE rows at most
    got = stats.join(F.broadcast(rows.select("id", "bad")), "id").groupBy("id", "bad").agg(one).select("id", "bad", "x.*").orderBy("id").toArrow()
    y = got["bad"].to_numpy()
    if len(set(y.tolist())) < 2:
        return None
    return boost(features({k: got[k].to_numpy() for k in COUNTS}), y, list(FEATURES.values()))


def quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """One row per document: id_col, COUNTS, base_failed, bad (probability), kept.

    Words are runs without ASCII white space. base_failed: fewer than 10 words, or over 20 % of the words in 5-word windows
    that come twice or more. kept is false if base_failed, else if the trees find it bad. Null texts have no words. Null and
    repeated ids are scored row by row; of repeated ids one row is learned from. Without labels of both kinds only the base
    rules hold (bad is null). A very long text is one bytes object and some arrays of 8 bytes a word. No rows give none.
    Other columns are not looked at. One pass over whole texts; only labels, statistics and at most SAMPLE rows for the driver move.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark)
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    stats = scratch.put(rows.mapInArrow(per_text(_counts), "id long, " + ", ".join(f"{c} long" for c in COUNTS)), "stats")
    model = train(stats, labels, id_col, label_col)
    shared = spark.sparkContext.broadcast(model)  # a few thousand nodes

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            c = {k: b.column(k).to_numpy() for k in COUNTS}
            failed = (c["n_words"] < MIN_WORDS) | (100 * c["n_repeat_words"] > 20 * c["n_words"])
            bad = shared.value.scores(features(c)) if shared.value else np.full(len(failed), np.nan)
            kept = ~failed & ~(bad >= BAD)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(failed), pa.array(bad, mask=np.isnan(bad)), pa.array(kept)], names=["id", *COUNTS, "base_failed", "bad", "kept"])

    out = stats.mapInArrow(judge, "id long, " + ", ".join(f"{c} long" for c in COUNTS) + ", base_failed boolean, bad double, kept boolean")
    return out.withColumnRenamed("id", id_col)


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return found.select("doc_id", *COUNTS[:5], "base_failed", "kept", "bad")
