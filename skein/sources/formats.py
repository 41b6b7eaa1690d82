"""Readers and writers of assembly graphs (GFA), contig paths, paired reads (FASTQ), FASTA and link tables."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skein.functions.sequence import base_ids
from skein.operators.rounds import Rounds
from skein.session import ship

#: What a contig's header begins with, and the rest of it.
CONTIG = "NODE_"
CONTIG_HEADER = r"^(\d+)_length_(\d+)_cov_([0-9.eE+-]+)('?)$"


def numbered_lines(spark: SparkSession, *paths: str, sep: str | None = None) -> DataFrame:
    """(file, line, value): every line of the files in order of their names, numbered from 0 over all of them; with sep,
    what lies between these strings instead of lines.

    Each split counts its lines where it lies; one row a split then gives what comes before it, so a file of any size is
    read by many tasks. A folder's files count as one text, cut between any two lines. `file` is the file's place by name.
    """
    ship(spark)
    rows = spark.read.text(list(paths), lineSep=sep).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("start"), "value")
    splits = rows.groupBy("path", "start").agg(F.count("*").alias("n"))
    ahead = Window.orderBy("path", "start").rowsBetween(Window.unboundedPreceding, -1)  # a row a split
    splits = splits.select("path", "start", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("ahead"), (F.dense_rank().over(Window.orderBy("path")) - 1).alias("file"))

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, n = None, 0
        for b in batches:
            nth = []
            for key in zip(b.column("path").to_pylist(), b.column("start").to_pylist()):
                here, n = (here, n + 1) if key == here else (key, 0)
                nth.append(n)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(nth, pa.int64())], names=["path", "start", "value", "nth"])

    placed = rows.mapInArrow(number, "path string, start long, value string, nth long").join(splits, ["path", "start"])
    return placed.select("file", (F.col("ahead") + F.col("nth")).alias("line"), "value")


def _coverage(f):
    """The DP tag, else KC / LN; a DP tag that comes after both KC and LN doesn't count. Tags are in upper or lower case."""
    tags = F.slice(f, 4, F.greatest(F.size(f), F.lit(1)))
    names = F.transform(tags, lambda x: F.upper(F.substring(x, 1, 2)))
    at = {t: F.array_position(names, t) for t in ("DP", "KC", "LN")}
    value = {t: F.when(at[t] > 0, F.substring_index(F.get(tags, (at[t] - 1).cast("int")), ":", -1).cast("double")) for t in at}
    late = (at["KC"] > 0) & (at["LN"] > 0) & (at["DP"] > F.greatest(at["KC"], at["LN"]))
    ratio = value["KC"] / F.nullif(value["LN"], F.lit(0.0))
    return F.when((at["DP"] > 0) & ~late, value["DP"]).otherwise(ratio)


def read_gfa(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """nodes (id, seq, dp, self_loop) and links (src, src_ori, dst, dst_ori, overlap). Coverage is the DP tag, else KC / LN;
    a segment with neither is an error. A link of a segment with itself only marks the segment."""
    rows = spark.read.text(path).select(F.split("value", "\t").alias("f"))
    links = rows.filter("f[0] = 'L'").select(F.col("f")[1].alias("src"), F.col("f")[2].alias("src_ori"), F.col("f")[3].alias("dst"), F.col("f")[4].alias("dst_ori"),
                                             F.regexp_extract(F.col("f")[5], r"^(\d+)M$", 1).cast("int").alias("overlap"))
    dp = F.coalesce(_coverage(F.col("f")), F.raise_error(F.concat(F.lit("no coverage: "), F.col("f")[1])).cast("double"))
    nodes = rows.filter("f[0] = 'S'").select(F.col("f")[1].alias("id"), F.upper(F.col("f")[2]).alias("seq"), dp.alias("dp"))
    loops = links.filter("src = dst").select(F.col("src").alias("id")).distinct().withColumn("self_loop", F.lit(True))
    nodes = nodes.join(loops, "id", "left").withColumn("self_loop", F.coalesce("self_loop", F.lit(False)))
    return nodes, links.filter("src <> dst")


def read_canonical_gfa(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """nodes (id, seq, dp) and edges (src, dst, overlap) of a file as write_gfa writes it. Any other line is an error:
    segments have 4 fields with a DP tag, links 6 with equal signs and an overlap in M."""
    rows = spark.read.text(path).filter("value <> ''").select("value", F.split("value", "\t").alias("f"))
    good = F.when(F.col("f")[0] == "S", (F.size("f") == 4) & F.get("f", F.lit(3)).rlike("^DP:f:[-+0-9.eE]+$"))
    good = good.when(F.col("f")[0] == "L", (F.size("f") == 6) & (F.get("f", F.lit(2)) == F.get("f", F.lit(4))) & F.get("f", F.lit(5)).rlike(r"^\d+M$")).otherwise(False)
    field = lambda k: F.when(good, F.get("f", F.lit(k))).otherwise(F.raise_error(F.concat(F.lit("not canonical: "), F.col("value"))).cast("string"))
    s, other = rows.filter(F.col("f")[0] == "S"), rows.filter(F.col("f")[0] != "S")
    return (
        s.select(field(1).alias("id"), field(2).alias("seq"), F.substring_index(field(3), ":", -1).cast("double").alias("dp")),
        other.select(field(1).alias("src"), field(3).alias("dst"), F.regexp_replace(field(5), "M$", "").cast("int").alias("overlap")),
    )


def write_gfa(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """Canonical GFA: segments with DP, then forward links between them; the order of lines is segments first."""
    s = nodes.select(F.lit(0).alias("k"), F.concat_ws("\t", F.lit("S"), "id", "seq", F.concat(F.lit("DP:f:"), F.col("dp").cast("string"))).alias("value"))
    live = nodes.select("id")
    e = edges.join(live.withColumnRenamed("id", "src"), "src", "left_semi").join(live.withColumnRenamed("id", "dst"), "dst", "left_semi")
    e = e.select(F.lit(1).alias("k"), F.concat_ws("\t", F.lit("L"), "src", F.lit("+"), "dst", F.lit("+"), F.concat(F.col("overlap").cast("string"), F.lit("M"))).alias("value"))
    s.unionByName(e).repartitionByRange("k", "value").sortWithinPartitions("k", "value").select("value").write.text(path)


def read_paths(spark: SparkSession, path: str, nodes: DataFrame, edges: DataFrame, min_len: int = 250, min_cov: float = 0.0) -> DataFrame:
    """Contig path file to (name, ord, path, repeats, len, cov).

    A record is a header, then segments of ids with + or -, a line ending in ; going on in the next segment; then the same
    with a quoted name for the other strand. The strand with more ids in nodes (id; reverse ids begin with -) is taken,
    the forward one on ties. Ids are kept that are known and linked; contigs of one id must be long and covered enough.
    """
    lines = F.filter(F.transform(F.split("value", "\n"), lambda x: F.btrim(x, F.lit(" \t\r"))), lambda x: x != "")
    head = lambda k: F.regexp_extract(F.get("lines", F.lit(0)), CONTIG_HEADER, k)
    records = numbered_lines(spark, path, sep=CONTIG).select(F.col("line").alias("ord"), lines.alias("lines")).filter(head(1) != "")
    rows = records.select(head(1).alias("name"), "ord", F.when(head(4) == "", "+").otherwise("-").alias("strand"), head(2).cast("long").alias("len"), head(3).cast("double").alias("cov"),
                          F.posexplode(F.slice("lines", 2, F.size("lines"))).alias("seg", "text"))
    parts = F.filter(F.split(F.regexp_replace("text", ";+$", ""), ","), lambda x: x != "")
    rows = rows.withColumn("ids", F.transform(parts, lambda x: F.concat(F.when(x.endswith("-"), "-").otherwise(""), F.substring(x, F.lit(1), F.length(x) - 1)))).drop("text")
    rows = Rounds(spark).put(rows)
    known = rows.select("name", "strand", F.explode("ids").alias("id")).join(nodes.select("id"), "id").groupBy("name", "strand").agg(F.count("*").alias("hits"))
    best = rows.select("name", "strand").distinct().join(known, ["name", "strand"], "left").groupBy("name").agg(F.max_by("strand", F.struct(F.coalesce("hits", F.lit(0)), F.when(F.col("strand") == "+", 1).otherwise(0))).alias("strand"))
    ids = rows.join(best, ["name", "strand"])
    step = ids.select("name", "seg", F.posexplode("ids").alias("pos", "id"))
    gone = step.join(nodes.select("id"), "id", "left_anti").select("name", "seg").distinct()
    pair = ids.filter(F.size("ids") > 1).select("name", "seg", F.explode(F.arrays_zip(F.expr("slice(ids, 1, size(ids) - 1)").alias("src"), F.expr("slice(ids, 2, size(ids) - 1)").alias("dst"))).alias("x")).select("name", "seg", "x.src", "x.dst")
    gone = gone.union(pair.join(edges.select("src", "dst"), ["src", "dst"], "left_anti").select("name", "seg")).distinct()
    ids = ids.join(gone, ["name", "seg"], "left_anti")
    many = ids.groupBy("name").agg(F.count("*").alias("segs"))
    counts = ids.select("name", "seg", F.explode("ids").alias("id")).groupBy("name", "seg", "id").agg(F.count("*").cast("int").alias("n")).groupBy("name", "seg").agg(F.map_from_entries(F.collect_list(F.struct("id", "n"))).alias("repeats"))
    ids = ids.join(many, "name").join(counts, ["name", "seg"]).withColumn("path", F.array_distinct("ids"))
    ids = ids.filter((F.size("path") > 1) | ((F.col("cov") > min_cov) & (F.col("len") >= min_len)))
    return ids.select(F.when(F.col("segs") > 1, F.concat_ws("$", "name", F.col("seg").cast("string"))).otherwise(F.col("name")).alias("name"), "ord", "path", "repeats", "len", "cov")


def read_fastq_pairs(spark: SparkSession, forward: str, reverse: str) -> DataFrame:
    """(pair, fseq, rseq): four-line records of each side's files, in order of their names, paired by their number; the
    longer side's rest is dropped. Files may be cut anywhere between lines and differently on both sides."""

    def reads(path: str, name: str) -> DataFrame:
        lines = numbered_lines(spark, path).filter("line % 4 = 1")
        return lines.select(F.floor(F.col("line") / 4).alias("pair"), F.btrim("value", F.lit(" \t\r")).alias(name))

    return reads(forward, "fseq").join(reads(reverse, "rseq"), "pair")


def write_fastq(rows: DataFrame, path: str) -> None:
    """rows (name, seq) as four-line records of the best quality."""
    rows.select(F.concat(F.lit("@"), "name", F.lit("\n"), "seq", F.lit("\n+\n"), F.expr("repeat('I', length(seq))")).alias("value")).write.text(path)


def read_references(spark: SparkSession, path: str) -> DataFrame:
    """(name, seq) of a FASTA file with two lines a record; a name ends at its first space or dot."""
    lines = numbered_lines(spark, path)
    head = lines.filter("line % 2 = 0").select((F.col("line") / 2).cast("long").alias("n"), F.substring_index(F.substring_index(F.regexp_replace("value", "^>", ""), " ", 1), ".", 1).alias("name"))
    return head.join(lines.filter("line % 2 = 1").select(((F.col("line") - 1) / 2).cast("long").alias("n"), F.btrim("value", F.lit(" \t\r")).alias("seq")), "n").select("name", "seq")


def write_references(rows: DataFrame, path: str) -> None:
    """A folder name=... with a FASTA file for each record (name, seq)."""
    rows.select("name", F.concat(F.lit(">"), "name", F.lit("\n"), "seq").alias("value")).write.partitionBy("name").text(path)


def read_paf(spark: SparkSession, path: str) -> DataFrame:
    """(query, query_len, target, start, matches, block, nm) of alignments in PAF; nm is null without that tag."""
    f = F.split("value", "\t")
    at = lambda k: F.get(f, F.lit(k))
    nm = F.get(F.filter(F.slice(f, 13, F.greatest(F.size(f), F.lit(1))), lambda x: x.startswith("NM:i:")), F.lit(0))
    rows = spark.read.text(path).filter("value <> ''")
    return rows.select(at(0).alias("query"), at(1).cast("long").alias("query_len"), at(5).alias("target"), at(7).cast("long").alias("start"), at(9).cast("long").alias("matches"), at(10).cast("long").alias("block"),
                       F.substring_index(nm, ":", -1).cast("long").alias("nm"))


def write_fasta(rows: DataFrame, path: str) -> None:
    """rows (name, seq, cov): longest first, headers >name_length_coverage, rounded as Python rounds a double."""
    ship(rows.sparkSession)

    def form(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [f">{n}_{len(s)}_{round(c, 2)}\n{s}" for n, s, c in zip(*(b.column(i).to_pylist() for i in range(3)))]
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], names=["value"])

    rows.select("name", "seq", "cov").repartitionByRange(F.desc(F.length("seq")), "name").sortWithinPartitions(F.desc(F.length("seq")), "name").mapInArrow(form, "value string").write.text(path)


def write_paths(paths: DataFrame, path: str, names: DataFrame | None = None) -> None:
    """NODE_name_length_cov, then the ids joined by commas, a leading - of an id becoming a suffix. With names (id,
    original), ids are written by their original names, those without one as they are. Contracted and copied ids are
    written as what they are made of."""
    paths = paths.withColumn("path", F.flatten(F.transform("path", base_ids)))
    if names is not None:
        rows = paths.select("name", F.posexplode("path").alias("pos", "id")).join(names.select("id", "original"), "id", "left")
        rows = rows.groupBy("name").agg(F.array_sort(F.collect_list(F.struct("pos", F.coalesce("original", "id").alias("id")))).alias("x"))
        paths = paths.drop("path").join(rows.select("name", F.transform("x", lambda p: p["id"]).alias("path")), "name")
    ids = F.transform("path", lambda x: F.when(x.startswith("-"), F.concat(F.regexp_replace(x, "^-", ""), F.lit("-"))).otherwise(x))
    paths.select(F.concat(F.lit("NODE_"), F.concat_ws("_", "name", F.col("len").cast("string"), F.col("cov").cast("string")), F.lit("\n"), F.array_join(ids, ",")).alias("value")).write.text(path)


def read_links(spark: SparkSession, *paths: str, nodes: DataFrame | None = None) -> DataFrame:
    """Link tables u:v:count, folded on unordered pairs. A file ends at its first blank line; with nodes (id), links of any
    other id are left out."""
    lines = numbered_lines(spark, *paths)
    ends = lines.filter(F.trim("value") == "").groupBy("file").agg(F.min("line").alias("end"))
    at = lambda k: F.get(F.split(F.trim("value"), ":"), F.lit(k))
    rows = lines.join(F.broadcast(ends), "file", "left").filter("end is null or line < end")  # a row a file at most
    rows = rows.select(F.least(at(0), at(1)).alias("a"), F.greatest(at(0), at(1)).alias("b"), at(2).cast("long").alias("n"))
    rows = rows.groupBy("a", "b").agg(F.sum("n").alias("cnt"))
    if nodes is not None:
        for end in ("a", "b"):
            rows = rows.join(nodes.select(F.col("id").alias(end)), end, "left_semi")
    return rows.select("a", "b", "cnt")


def write_links(links: DataFrame, path: str) -> None:
    links.select(F.concat_ws(":", "a", "b", F.col("cnt").cast("string")).alias("value")).write.text(path)
