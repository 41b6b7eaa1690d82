"""Exact dedup by progressive refinement: length, then prefix hash, then full hash of what is still in a group."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, ascii_lower, flagged, hot_join, row_keys, table, without, word_filter

#: Code points of the normalised text that the second step hashes.
PREFIX = 64


def _hashes(docs: DataFrame, digest_all: bool, scratch: Scratch) -> DataFrame:
    """docs (row, id, text) to (row, id, again, full_hash), by three passes over the texts, each over what the one before
    left: lengths; prefix hashes of rows whose length comes again; full hashes of rows whose length and prefix do."""
    text = F.coalesce(F.col("text"), F.lit(""))
    keyed = docs.select("row", "id", text.alias("text"), F.octet_length(text).alias("len"))
    lengths = keyed.groupBy("len").agg(F.count("*").alias("n")).filter("n > 1")
    lengths = word_filter(scratch.put(lengths.select(F.xxhash64("len").alias("k")), "lengths"), "k", scratch)
    again = flagged(keyed, F.xxhash64("len"), lengths, "same")
    prefix = F.xxhash64("len", ascii_lower(F.substring("text", 1, PREFIX)))
    classes = again.filter("same").groupBy(prefix.alias("k")).agg(F.count("*").alias("n")).filter("n > 1")
    classes = word_filter(scratch.put(classes.select("k"), "classes"), "k", scratch)
    again = flagged(again, F.when(F.col("same"), prefix), classes, "again")
    wanted = F.lit(True) if digest_all else F.col("again")
    again = again.select("row", "id", "again", F.when(wanted, F.col("text")).alias("text"))

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            full = [hashlib.sha256(t.as_buffer().to_pybytes().lower()).hexdigest() if t.is_valid else None for t in b.column("text")]
            yield pa.RecordBatch.from_arrays([b.column("row"), b.column("id"), b.column("again"), pa.array(full, pa.string())], names=["row", "id", "again", "full_hash"])

    return again.mapInArrow(hashed, "row long, id long, again boolean, full_hash string")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest_all: bool = False) -> DataFrame:
    """One row per document: id_col, keep_id, group_size, kept, full_hash, n_rows.

    Texts are equal if identical after lower-casing A-Z; of equal texts the largest id stays. A null text counts as
    empty. Rows alike in id and text are one document: they give one row with n_rows > 1, and group_size counts each.
    Null ids sort below all others; a group of null ids only keeps its null id. An empty table gives no rows. Other
    columns are not looked at. full_hash (SHA-256 of the normalised text, hex) is null where no other document may have
    the same length and prefix, unless digest_all.

    The first pass groups lengths, the second prefix hashes of the rows whose length comes again, the third hashes the
    full content of those rows only whose length and prefix hash do; both are found through bitmaps of fixed size. So
    8 bytes a row move, and no text; a hot group is joined by broadcast. Very long texts are read one at a time.
    """
    scratch = Scratch(docs.sparkSession)
    docs = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    rows = _hashes(docs.select(F.col("id").alias("row"), "id", "text"), digest_all, scratch)
    rows = scratch.put(rows.groupBy("id", "again", "full_hash").agg(F.count("*").alias("n_rows")), "rows")
    groups = rows.filter("again").groupBy("full_hash").agg(F.max("id").alias("keep_id"), F.sum("n_rows").alias("group_size"), F.count("*").alias("members"))
    groups = scratch.put(groups, "groups")
    total = rows.count()
    merged = hot_join(rows.filter("again"), groups, "full_hash", "members", total)
    alone = rows.filter("not again").select(*rows.columns, F.col("id").alias("keep_id"), F.col("n_rows").alias("group_size"))
    out = merged.drop("members").unionByName(alone)
    return out.select(
        F.col("id").alias(id_col), "keep_id", "group_size", F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"), "full_hash", "n_rows"
    )


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Of rows with equal texts the one with the largest id, with all its columns.

    Of rows alike in id and text one stays; null ids come below all others. Null and empty texts are equal. Columns may
    have any names; no rows give none. Only hashes of rows that may have a copy are grouped, and texts that stay are not
    shuffled, see common.without.
    """
    scratch = Scratch(docs.sparkSession)
    rows, key = row_keys(docs, id_col, scratch)
    plain = rows.select(F.col(key).alias("row"), F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    found = scratch.put(_hashes(plain, False, scratch).filter("again").select("row", "id", "full_hash"), "found")
    groups = found.groupBy("full_hash").agg(F.max(F.struct("id", "row")).alias("top"), F.count("*").alias("n")).filter("n > 1")
    groups = scratch.put(groups.select("full_hash", "n", F.col("top.row").alias("stays")), "groups")
    gone = hot_join(found, groups, "full_hash", "n", found.count()).filter("row <> stays").select("row")
    return without(rows, key, scratch.put(gone, "gone"), scratch).drop(key)


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = exact_dedup(table(spark, sf_dir, "documents"), digest_all=True)
    return found.select("doc_id", "keep_id", "group_size", "kept", F.col("full_hash").alias("text_sha256"))


OP4_SQL = """
WITH d AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents
), h AS (SELECT doc_id, sha256(t) AS text_sha256 FROM d)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, text_sha256
FROM h WINDOW w AS (PARTITION BY text_sha256)
"""
