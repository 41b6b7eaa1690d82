"""Line dedup: range-partitioned line hashes, sorted by document and position, and a keep bitmap per document."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import HOT_SHARE, Scratch, flagged, fresh, per_text, row_keys, table, word_filter

MIN_CHARS = 40
MIN_DOCS = 5
BLANK = " \t\n\x0b\x0c\r"
_LOWER = {c: c + 32 for c in range(65, 91)}


def line_key(line: str) -> str:
    """The line without ASCII white space at both ends, A-Z lower-cased."""
    return line.strip(BLANK).translate(_LOWER)


def _lines(keys: list, texts: list) -> Iterator[pa.RecordBatch]:
    """(h, g, id, row, at): the 128-bit hash and the positions of each long line key of a row, a row each. keys: (id, row)."""
    hs, ids, rows, at = [], [], [], []
    for key, t in zip(keys, texts):
        found: dict[bytes, list[int]] = {}
        for k, line in enumerate((t or "").split("\n")):
            if len(line) >= MIN_CHARS:
                line_ = line.strip(BLANK)
                if len(line_) >= MIN_CHARS:
                    h = xxhash.xxh3_128_digest(line_.encode().lower())  # bytes: A-Z only
                    found.setdefault(h, []).append(k)
        hs += found
        ids += [key["id"]] * len(found)
        rows += [key["row"]] * len(found)
        at += found.values()
    both = np.frombuffer(b"".join(hs), np.int64).reshape(-1, 2)
    cols = [pa.array(both[:, 0]), pa.array(both[:, 1]), pa.array(ids, pa.int64()), pa.array(rows, pa.int64()), pa.array(at, pa.list_(pa.int32()))]
    yield pa.RecordBatch.from_arrays(cols, names=["h", "g", "id", "row", "at"])


def _later_documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows (h, g, id, row, at), sorted by key and id descending: those of keys in at least MIN_DOCS documents, without the
    first document of a key. Rows of the last key are held until its documents suffice, fewer than MIN_DOCS of them."""
    held = None  # rows of a key that is still undecided
    key, top = None, None  # a key that is decided, and its first document
    for b in batches:
        t = pa.Table.from_batches([b]) if held is None else pa.concat_tables([held, pa.Table.from_batches([b])])
        h, g, i = (t.column(c).to_numpy() for c in ("h", "g", "id"))
        if not len(h):
            continue
        new = np.concatenate([[True], (h[1:] != h[:-1]) | (g[1:] != g[:-1])])
        start = np.flatnonzero(new)
        group = np.cumsum(new) - 1
        another = np.concatenate([[True], new[1:] | (i[1:] != i[:-1])])
        docs, tops = np.add.reduceat(another, start), i[start].copy()
        if key == (h[0], g[0]):
            docs[0], tops[0] = MIN_DOCS, top
        enough = docs >= MIN_DOCS
        drop = enough[group] & (i != tops[group])
        if drop.any():
            yield t.select(["row", "at"]).filter(pa.array(drop)).combine_chunks().to_batches()[0]
        if enough[-1]:
            held, key, top = None, (h[-1], g[-1]), tops[-1]
        else:
            held, key, top = t.slice(start[-1]), None, None


def _bitmaps(rows: DataFrame, scratch: Scratch) -> DataFrame:
    """(row, n_dropped, keep) of the rows (row, id, text) that lose lines."""
    rows = rows.filter("id is not null").select(F.struct("id", "row").alias("k"), "text")
    lines = scratch.put(rows.mapInArrow(per_text(_lines), "h long, g long, id long, row long, at array<int>"), "lines")
    total, key = lines.count(), ["h", "g"]
    hot = lines.groupBy(key).agg(F.count("*").alias("n"), F.max("id").alias("top")).filter(F.col("n") * HOT_SHARE >= total)
    hot = scratch.put(hot, "hot")  # at most HOT_SHARE rows
    exact = lines.join(F.broadcast(hot.select(key)), key).groupBy(key).agg(F.count_distinct("id").alias("docs"))
    decided = lines.join(F.broadcast(hot.join(exact, key).filter(F.col("docs") >= MIN_DOCS).select(*key, "top")), key)
    decided = decided.filter(F.col("id") != F.col("top")).select("row", "at")
    cold = lines.join(F.broadcast(hot.select(key)), key, "left_anti").repartitionByRange(*key).sortWithinPartitions(*key, F.desc("id"), "row", "at")
    dropped = decided.unionByName(cold.mapInArrow(_later_documents, "row long, at array<int>"))
    dropped = dropped.select("row", F.explode("at").alias("line"))  # a line has one key, so none comes twice
    dropped = dropped.groupBy("row").agg(F.collect_list("line").alias("lines"))

    def bitmaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for x in b.column("lines").to_pylist():
                bits = np.ones(-(-(max(x) + 1) // 8) * 8, np.uint8)  # whole bytes
                bits[x] = 0
                out.append(zlib.compress(np.packbits(bits, bitorder="little").tobytes()))
            n = [len(x) for x in b.column("lines").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("row"), pa.array(n, pa.int64()), pa.array(out, pa.binary())], names=["row", "n_dropped", "keep"])

    return scratch.put(dropped.mapInArrow(bitmaps, "row long, n_dropped long, keep binary"), "bitmaps")


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id_col, n_dropped and keep, without texts. See with_bitmaps."""
    return with_bitmaps(docs.select(F.col(f"`{id_col}`"), F.col(f"`{text_col}`")), id_col, text_col).drop(text_col)


def with_bitmaps(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with two more columns: n_dropped, and `keep`, a zlib-compressed bitmap of the row's lines (bit set, least
    significant first: the line stays; those beyond it stay), null where all stay. kept_lines applies it. (If docs has
    columns of these names, the new ones get a _.)

    Texts are split at \\n. A line's key of at least MIN_CHARS code points that is found in at least MIN_DOCS documents
    stays in the largest id that holds it, with all its repeats there, and goes elsewhere. Null and empty texts are one
    empty line. Rows with equal ids are one document for the counts and for which id is the largest; each loses lines of
    its own text only. Rows with a null id never lose lines and don't count. Other columns may have any names and are kept;
    no rows give none.

    Very long texts are split one at a time. Lines are equal if their 128-bit hashes are.

    Only hashes and line numbers are shuffled. They are range-partitioned by hash and sorted by (hash, id descending);
    one pass over each partition streams past the first document of a key and marks the others, holding fewer than
    MIN_DOCS documents of a key. Hashes of at least 1 / HOT_SHARE of all rows are decided where they lie, against a
    broadcast of at most HOT_SHARE rows with their count and largest id. Texts that surely lose no line, by a bitmap of
    the rows that do, stay where they lie.
    """
    scratch = Scratch(docs.sparkSession)
    rows, key = row_keys(docs, id_col, scratch)
    n_dropped, keep, maybe, at = fresh(rows, "n_dropped", "keep", "maybe", "row")
    plain = rows.select(F.col(f"`{key}`").alias("row"), F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    drops = _bitmaps(plain, scratch).select(F.col("row").alias(at), F.col("n_dropped").alias(n_dropped), F.col("keep").alias(keep))
    own = F.xxhash64(F.col(f"`{key}`"))
    rows = flagged(rows, own, word_filter(drops.select(F.xxhash64(at).alias("k")), "k", scratch), maybe)
    met = rows.filter(F.col(maybe)).join(drops.hint("merge"), F.col(f"`{key}`") == F.col(at), "left").drop(at)
    rest = rows.filter(~F.col(maybe)).withColumn(n_dropped, F.lit(None).cast("long")).withColumn(keep, F.lit(None).cast("binary"))
    both = met.unionByName(rest).withColumn(n_dropped, F.coalesce(n_dropped, F.lit(0).cast("long")))
    return both.select(*(F.col(f"`{c}`") for c in docs.columns), n_dropped, keep)


def kept_lines(text: str | None, keep: bytes | None) -> list[str]:
    """The lines of a text that its bitmap leaves."""
    lines = (text or "").split("\n")
    if keep is None:
        return lines
    bits = np.unpackbits(np.frombuffer(zlib.decompress(keep), np.uint8), bitorder="little")
    return [x for k, x in enumerate(lines) if k >= len(bits) or bits[k]]


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = with_bitmaps(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "text", "keep")

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, gone, sha = [], [], []
            for t, d in zip(b.column("text"), b.column("keep")):
                text = t.as_py() or ""
                left = kept_lines(text, d.as_py())
                n.append(text.count("\n") + 1)
                gone.append(n[-1] - len(left))
                sha.append(hashlib.sha256("\n".join(left).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(sha, pa.string())], names=["doc_id", "n_lines", "n_dropped", "kept_sha256"])

    return both.mapInArrow(digest, "doc_id long, n_lines long, n_dropped long, kept_sha256 string")


OP9_SQL = r"""
WITH l AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents
), k AS (
  SELECT *, translate(regexp_replace(regexp_replace(line, '^[\x20\x09-\x0D]+', ''), '[\x20\x09-\x0D]+$', ''),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l
), r AS (
  SELECT key, max(doc_id) AS top FROM k WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5
), m AS (
  SELECT k.doc_id, k.pos, k.line, r.key IS NOT NULL AND k.doc_id <> r.top AS dropped FROM k LEFT JOIN r ON k.key = r.key
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (dropped) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT dropped), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""
