"""From an assembly graph, contig paths and read pairs to strains: every stage in order, each written to shared storage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.functions.sequence import base_ids
from skein.operators import graph, links, paths, provenance, schemas
from skein.operators.rounds import Rounds
from skein.plans.strains import DELTA_SHARE, strains
from skein.plans.strands import one_strand
from skein.sources import formats


def _delta(nodes: DataFrame) -> float:
    return DELTA_SHARE * (graph.median(nodes, "dp") or 0.0)


def assemble(nodes: DataFrame, edges: DataFrame, contigs: DataFrame, pairs: DataFrame, min_cov: float | None = None) -> DataFrame:
    """(name, path, seq, len, cov) of the strains, from nodes (id, seq, dp) and edges (src, dst, overlap) of one strand,
    contigs (name, ord, path, repeats, cov) and read pairs (pair, fseq, rseq). min_cov is estimated unless given."""
    spark = nodes.sparkSession
    r = Rounds(spark)
    nodes, edges, contigs = r.put(schemas.conform(nodes, schemas.NODES)), r.put(schemas.conform(edges, schemas.EDGES)), r.put(contigs)
    cut = graph.coverage_threshold(nodes) if min_cov is None else min_cov
    live, between = graph.prune(nodes, edges, cut)
    live, between = r.put(live), r.put(between)
    known = r.put(paths.without_dead(contigs, live))
    overlap = between.agg(F.max("overlap")).first()[0]
    if not overlap:
        raise ValueError("the graph has no overlaps, so there is no k for the read index")
    found = r.put(links.saturated(links.hits(pairs, live.select(F.col("id").alias("node"), "seq"), overlap + 1), overlap + 1))
    pe = r.put(links.fold(links.pair_links(found), links.mate_links(found)))
    clean = graph.clean_edges(between, paths.steps(known)).filter("kept").select("src", "dst")
    n, e, parts, known = graph.disentangled(live, r.put(clean), pe, _delta(live), known)
    n = r.put(graph.raise_branches(n, e))
    base = n.select("id", F.explode(base_ids(F.col("id"))).alias("part")).join(nodes.select(F.col("id").alias("part"), F.length("seq").alias("l")), "part")
    size = base.groupBy("id").agg((F.sum("l") - overlap * (F.count("*") - 1)).alias("len"))
    # walks over branches go by links that tell copies apart, nodes that no contig led to by those of all their parts
    near, all_ = r.put(provenance.links_of(pe, parts, copies=False)), r.put(provenance.links_of(pe, parts))
    got = r.put(strains(n.join(size, "id"), e, known, near, _delta(n), overlap, all_))
    got = got.select("name", "cov", F.array_distinct(F.flatten(F.transform("path", base_ids))).alias("path"), "nth")
    got = r.put(paths.deduplicated(r.put(got.select("name", "cov", "path", F.col("nth").alias("ord")))))
    whole = r.put(paths.expand_repeats(got, paths.repeat_votes(got, contigs)))
    seq = paths.path_sequence(whole, nodes, edges)
    return whole.join(seq, "name").join(got.select("name", "cov"), "name").select("name", "path", "seq", F.length("seq").alias("len"), "cov")


def reconstruct(spark: SparkSession, gfa: str, contig_paths: str, forward: str, reverse: str, out: str | None = None, min_len: int = 250, min_cov: float | None = None) -> DataFrame:
    """assemble() on files; with out, also strain.fasta, strain.paths and the oriented graph.gfa in that folder."""
    r = Rounds(spark)
    nodes, edges = one_strand(*formats.read_gfa(spark, gfa))
    nodes, edges = r.put(nodes), r.put(edges)
    cut = graph.coverage_threshold(nodes) if min_cov is None else min_cov  # contigs of one node are held against it, too
    contigs = formats.read_paths(spark, contig_paths, nodes, edges, min_len, cut)
    found = r.put(assemble(nodes, edges, contigs, formats.read_fastq_pairs(spark, forward, reverse), cut))
    if out:
        formats.write_fasta(found.select("name", "seq", "cov"), f"{out}/strain.fasta")
        formats.write_paths(found, f"{out}/strain.paths")
        formats.write_gfa(nodes, edges, f"{out}/graph.gfa")
    return found
