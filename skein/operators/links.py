"""Links between nodes from read pairs: k-mer index, hits, saturation, pair counts and their fold."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.functions.sequence import revcomp, windows
from skein.operators.rounds import Rounds


def kmer_index(nodes: DataFrame, k: int) -> DataFrame:
    """nodes (node, seq) to (node, pos, kmer): every window and, at the same offset, its reverse complement, so a window
    that is its own complement comes twice."""
    return _both_strands(windows(nodes, "seq", k, ["node"]))


def _both_strands(found: DataFrame) -> DataFrame:
    keep = [c for c in found.columns if c != "kmer"]
    return found.select(*keep, F.explode(F.array("kmer", revcomp(F.col("kmer")))).alias("kmer"))


def usable_pairs(pairs: DataFrame, k: int) -> DataFrame:
    """Pairs (pair, fseq, rseq) without N whose mates both have at least k letters."""
    n = F.instr("fseq", "N") + F.instr("rseq", "N")
    return pairs.filter((n == 0) & (F.length("fseq") >= k) & (F.length("rseq") >= k))


def read_counts(pairs: DataFrame, k: int) -> DataFrame:
    """One row (pairs, with_n, short, used): pairs (pair, fseq, rseq) with an N in either mate, those of the rest with a mate
    of fewer than k letters, and those that are used."""
    n = F.instr("fseq", "N") + F.instr("rseq", "N") > 0
    short = (F.length("fseq") < k) | (F.length("rseq") < k)
    return pairs.agg(F.count("*").alias("pairs"), F.count_if(n).alias("with_n"), F.count_if(~n & short).alias("short"), F.count_if(~n & ~short).alias("used"))


def sample_pairs(pairs: DataFrame, ratio: float, seed: int = 0) -> DataFrame:
    """About one in `ratio` pairs, both mates or none. The choice is a hash of the pair's number and the seed, so it is the
    same in every run, however the pairs are dealt out."""
    if not ratio > 1:
        raise ValueError("the ratio must be above 1")
    drawn = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("pair").cast("string")).cast("binary")), 1, 8), 16, 10).cast("long")
    return pairs.filter(drawn * ratio < 1 << 32)


def read_windows(pairs: DataFrame, k: int, counted: bool = False) -> DataFrame:
    """(name, seq): every window of the usable pairs' mates as a read of its own, named pair_mate_position, for an aligner. If
    counted, equal windows of a mate are one read, named by the first, with n, how many they are."""
    reads = usable_pairs(pairs, k)
    reads = reads.select("pair", F.lit(0).alias("mate"), F.col("fseq").alias("seq")).unionAll(reads.select("pair", F.lit(1).alias("mate"), F.col("rseq").alias("seq")))
    rows = windows(reads, "seq", k, ["pair", "mate"], counted)
    return rows.select(F.concat_ws("_", "pair", "mate", "pos").alias("name"), F.col("kmer").alias("seq"), *(["n"] if counted else []))


def aligned_hits(alignments: DataFrame, pairs: DataFrame, nodes: DataFrame, k: int) -> DataFrame:
    """hits() from alignments (query, target, start, matches, block) of read_windows to nodes: a window counts where all of
    its k letters match. A row with a column times is as many alignments of equal windows, named by the first of each side.
    They are summed by the mates' names, which are taken apart once for each mate and node."""
    reads = usable_pairs(pairs, k)
    reads = reads.select("pair", F.lit(0).alias("mate"), F.length("fseq").alias("read_len")).unionAll(reads.select("pair", F.lit(1).alias("mate"), F.length("rseq").alias("read_len")))
    times = F.col("times").cast("long") if "times" in alignments.columns else F.lit(1).cast("long")
    found = alignments.filter((F.col("block") == k) & (F.col("matches") == k))
    found = found.select(F.substring_index("query", "_", 2).alias("mate_name"), F.substring_index("query", "_", -1).cast("int").alias("read_pos"), F.col("target").alias("node"), "start", times.alias("times"))
    found = found.groupBy("mate_name", "node").agg(F.sum("times").alias("hits"), F.min("start").alias("node_pos"), F.min("read_pos").alias("read_pos"))
    part = F.split("mate_name", "_")
    found = found.select(part[0].cast("long").alias("pair"), part[1].cast("int").alias("mate"), "node", "hits", "node_pos", "read_pos")
    lengths = nodes.select("node", F.length("seq").alias("node_len"))
    return found.join(reads, ["pair", "mate"]).join(lengths, "node").select("pair", "mate", "node", "read_len", "node_len", "hits", "node_pos", "read_pos")


def exact_alignments(alignments: DataFrame) -> DataFrame:
    """(target, query) of alignments over the whole query without a mismatch."""
    return alignments.filter((F.col("nm") == 0) & (F.col("block") == F.col("query_len"))).select("target", "query").distinct()


def contigs_of_targets(alignments: DataFrame, contigs: DataFrame, identity: float = 0.999) -> DataFrame:
    """(target, name): contigs (name) with an alignment of at least that share of matches; a query's name ends at its first _."""
    rows = alignments.filter(F.col("matches") / F.nullif(F.col("block"), F.lit(0)) >= identity)
    return rows.select("target", F.substring_index("query", "_", 1).alias("name")).distinct().join(contigs.select("name"), "name", "left_semi").select("target", "name")


def alignment_scores(alignments: DataFrame) -> DataFrame:
    """(query, block, target, apart): each alignment's length and what of it doesn't match."""
    return alignments.select("query", "block", "target", (F.col("block") - F.col("matches")).alias("apart"))


def node_links(links: DataFrame, parts: DataFrame) -> DataFrame:
    """(a, b, cnt): links between whole nodes, summed over those (a, b, cnt) between what they are made of (parts: id, part).
    No pair of nodes is formed but those that some link joins. A node's own links count in both orders of two parts."""
    x, y = parts.select(F.col("id").alias("x"), F.col("part").alias("p")), parts.select(F.col("id").alias("y"), F.col("part").alias("q"))
    both = links.select(F.col("a").alias("p"), F.col("b").alias("q"), "cnt").unionAll(links.filter("a <> b").select("b", "a", "cnt"))
    rows = both.join(x, "p").join(y, "q").filter("x <= y")
    return rows.groupBy(F.col("x").alias("a"), F.col("y").alias("b")).agg(F.sum("cnt").alias("cnt"))


#: A k-mer is hot if it has at least one in HOT_SHARE of all rows of a side; so at most HOT_SHARE k-mers of a side are.
HOT_SHARE = 1000
#: Pairs of which one is looked at to find the k-mers that are hot among reads.
SAMPLE = 16
#: Reads and nodes of a hot k-mer that meet in one task, about.
CELL_READS, CELL_NODES = 10_000, 200


def _hot_kmers(reads: DataFrame, index: DataFrame) -> DataFrame:
    """(kmer, rows, cols): into how many parts a hot k-mer's reads and nodes are dealt. Reads are counted in a sample, so a
    k-mer may be taken for hot or not when it is near the bound; its hits are the same either way."""
    of = lambda rows, scale: rows.groupBy("kmer").agg((F.count("*") * scale).alias("c"))
    seen, known = of(reads.join(index.select("kmer").distinct(), "kmer", "left_semi"), SAMPLE), of(index, 1)
    hot = []
    for side, least, name in ((seen, CELL_READS, "rows"), (known, CELL_NODES, "cols")):
        total = side.agg(F.coalesce(F.sum("c"), F.lit(0))).first()[0]
        hot.append(side.filter((F.col("c") * HOT_SHARE >= total) & (F.col("c") > least)).select("kmer", F.ceil(F.col("c") / least).cast("int").alias(name)))
    both = hot[0].join(hot[1], "kmer", "full_outer")
    return both.select("kmer", F.coalesce("rows", F.lit(1)).alias("rows"), F.coalesce("cols", F.lit(1)).alias("cols"))


def deal_hits(reads: DataFrame, index: DataFrame, hot: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both sides with the cell (r, c) in which they meet. A hot k-mer's reads are dealt into rows and its nodes into
    columns of a table, and each row meets each column in a cell of its own; other k-mers have one cell."""
    grid = F.broadcast(hot)  # 2 * HOT_SHARE k-mers at most
    one = lambda df: df.withColumn("r", F.coalesce("rows", F.lit(1))).withColumn("c", F.coalesce("cols", F.lit(1))).drop("rows", "cols")
    left, right = one(reads.join(grid, "kmer", "left")), one(index.join(grid, "kmer", "left"))
    left = left.withColumn("r", F.pmod(F.xxhash64("pair", "mate"), F.col("r")).cast("int")).withColumn("c", F.explode(F.sequence(F.lit(0), F.col("c") - 1)))
    right = right.withColumn("c", F.pmod(F.xxhash64("node"), F.col("c")).cast("int")).withColumn("r", F.explode(F.sequence(F.lit(0), F.col("r") - 1)))
    return left, right


def hits(pairs: DataFrame, nodes: DataFrame, k: int) -> DataFrame:
    """(pair, mate, node): matches, first node offset, first read offset, and both lengths.

    Equal windows of a read are one row with their number, and so are those of a node, so a read of one letter and a node
    of one letter meet once and not once for each two windows. k-mers that very many reads or nodes have meet in cells, see
    deal_hits, so no task gets all rows of a k-mer. Matches are summed by read and node before they are shuffled.
    """
    rounds = Rounds(pairs.sparkSession)
    reads = usable_pairs(pairs, k)
    reads = reads.select("pair", F.lit(0).alias("mate"), F.col("fseq").alias("seq")).unionAll(reads.select("pair", F.lit(1).alias("mate"), F.col("rseq").alias("seq")))
    reads = reads.withColumn("read_len", F.length("seq"))
    found = lambda rows: windows(rows, "seq", k, ["pair", "mate", "read_len"], counted=True).withColumnsRenamed({"pos": "read_pos", "n": "read_n"})
    index = _both_strands(windows(nodes.withColumn("node_len", F.length("seq")), "seq", k, ["node", "node_len"], counted=True))
    index = rounds.put(index.groupBy("kmer", "node", "node_len").agg(F.sum("n").alias("n"), F.min("pos").alias("pos")))
    hot = rounds.put(_hot_kmers(found(reads.filter(F.pmod(F.xxhash64("pair"), F.lit(SAMPLE)) == 0)), index))
    left, right = deal_hits(found(reads), index, hot)
    return (
        left.join(right, ["kmer", "r", "c"]).groupBy("pair", "mate", "node", "read_len", "node_len")
        .agg(F.sum(F.col("read_n") * F.col("n")).alias("hits"), F.min("pos").alias("node_pos"), F.min("read_pos").alias("read_pos"))
    )


def saturated(found: DataFrame, k: int) -> DataFrame:
    """Hits of reads that match a node as much as their overlap, or their expected share of windows, allows."""
    right = F.least(F.col("node_pos") + F.col("node_len") - 1, F.col("node_pos") - F.col("read_pos") + F.col("read_len") - 1)
    sat = right - F.col("node_pos") - (k - 1) + 1
    exp = (F.least("read_len", "node_len") - k + 1) * (F.col("read_len") - k) / F.col("read_len")
    return found.filter(F.col("hits") >= F.greatest(F.least(sat.cast("double"), exp), F.lit(1.0)))


def pair_links(accepted: DataFrame) -> DataFrame:
    """(i, j, n): pairs whose first mate is on i and whose second is on j."""
    a = accepted.filter("mate = 0").select("pair", F.col("node").alias("i"))
    b = accepted.filter("mate = 1").select("pair", F.col("node").alias("j"))
    return a.join(b, "pair").groupBy("i", "j").agg(F.count("*").alias("n"))


def mate_links(accepted: DataFrame) -> DataFrame:
    """(i, j, n), i <= j: single reads that are on both nodes, a node with itself included."""
    a = accepted.select("pair", "mate", F.col("node").alias("i"))
    b = accepted.select("pair", "mate", F.col("node").alias("j"))
    return a.join(b, ["pair", "mate"]).filter("i <= j").groupBy("i", "j").agg(F.count("*").alias("n"))


def fold(*counts: DataFrame) -> DataFrame:
    """(a, b, cnt) over unordered pairs, summed over all count tables (i, j, n)."""
    rows = counts[0]
    for c in counts[1:]:
        rows = rows.unionAll(c)
    return rows.groupBy(F.least("i", "j").alias("a"), F.greatest("i", "j").alias("b")).agg(F.sum("n").alias("cnt"))
