"""Links over streams: of accepted read hits, and of raw reads. The counts are sums, so they can grow batch by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from skein.operators import links
from skein.operators.rounds import Rounds


def streaming_mate_links(accepted: DataFrame) -> DataFrame:
    """accepted: a stream of (pair, mate, nodes array). (a, b, cnt) of unordered node pairs of a read, self included; for
    the complete or update output mode. State grows with the links, not with the reads."""
    n = F.sort_array("nodes")
    both = accepted.select(n.alias("n"), F.posexplode(n).alias("i", "a")).select("a", F.explode(F.expr("slice(n, i + 1, size(n))")).alias("b"))
    return both.groupBy("a", "b").agg(F.count("*").alias("cnt"))


def stream_reads(spark: SparkSession, folder: str, most_files: int = 100) -> DataFrame:
    """A stream of (name, seq, at) from FASTQ files that arrive in a folder, whole records in each; a name ends at the first
    blank, and a last /1 or /2 is not part of it. `at` is the time of the file, for watermarks."""
    files = spark.readStream.schema("value string").option("maxFilesPerTrigger", most_files).text(folder, wholetext=True)
    lines = F.split(F.regexp_replace("value", r"\r|\n+$", ""), "\n")
    records = files.select(lines.alias("lines"), F.col("_metadata.file_modification_time").alias("at"))
    heads = F.filter(F.sequence(F.lit(0), F.greatest(F.size("lines") - 2, F.lit(0)), F.lit(4)), lambda i: i + 1 < F.size("lines"))
    records = records.select("at", F.explode(F.transform(heads, lambda i: F.struct(F.get("lines", i).alias("head"), F.get("lines", i + 1).alias("seq")))).alias("r"))
    name = F.regexp_replace(F.regexp_extract("r.head", r"^@(\S*)", 1), "/[12]$", "")
    return records.select(name.alias("name"), F.btrim("r.seq", F.lit(" \t")).alias("seq"), "at")


def stream_pairs(forward: DataFrame, reverse: DataFrame, late: str = "1 day") -> DataFrame:
    """A stream of (pair, fseq, rseq): mates of equal name from two streams of reads, however they arrive. A read whose mate
    is not there within `late` is given up; until then it is what the state holds."""
    f = forward.select(F.col("name").alias("pair"), F.col("seq").alias("fseq"), F.col("at").alias("f_at")).withWatermark("f_at", late)
    r = reverse.select(F.col("name").alias("r_pair"), F.col("seq").alias("rseq"), F.col("at").alias("r_at")).withWatermark("r_at", late)
    near = F.expr(f"r_at >= f_at - interval {late} and r_at <= f_at + interval {late}")
    return f.join(r, (F.col("pair") == F.col("r_pair")) & near).select("pair", "fseq", "rseq")


def write_links(pairs: DataFrame, nodes: DataFrame, k: int, out: str, state: str, **trigger) -> StreamingQuery:
    """Starts a query that turns a stream of pairs into links between nodes (node, seq) with k-mers, as the batch plan does:
    hits, saturation, links of pairs and of single reads, folded.

    Each micro-batch writes the links of its own pairs to a folder of its own, which a batch that is run again replaces, so
    every pair counts once. links_so_far sums them up. state is the query's checkpoint.
    """

    def add(batch: DataFrame, number: int) -> None:
        rounds = Rounds(batch.sparkSession)
        found = rounds.put(links.saturated(links.hits(rounds.put(batch), nodes, k), k))
        links.fold(links.pair_links(found), links.mate_links(found)).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return pairs.writeStream.foreachBatch(add).option("checkpointLocation", state).trigger(**trigger).start()


def links_so_far(spark: SparkSession, out: str) -> DataFrame:
    """(a, b, cnt) over all batches that are there. Only sums are kept, so their size follows the links and the batches."""
    return spark.read.parquet(out).groupBy("a", "b").agg(F.sum("cnt").alias("cnt"))
