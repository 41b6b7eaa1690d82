"""Mixing sources to target weights by a time-varying curriculum, in DataFrame functions only.

Every source has a weight schedule over training time 0..1. Its integral is the source's demand for tokens; inverting
the cumulative demand gives each document the moments at which it is read, and documents are range-sorted by them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, fresh, table

#: Weights of the sources in code point order, repeating; the mix as a share of all sizes; the most uses of a document.
WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST = 2
#: Slopes of the schedules, repeating: a source's weight goes from (1 - slope) to (1 + slope) times its mean.
SLOPES = (0.5, 0.0, -0.5)
#: Documents of a source are dealt to 4096 parts by the first hash digits; running sums are taken part by part.
DIGITS = 3
WORD = r"[^\x20\x09-\x0D]+"


def targets(sizes: DataFrame) -> DataFrame:
    """sizes (source, source_size) with weight, slope and target: demand is shared by weight, what exceeds MOST times a
    source's size is shared again by weight among the others, until none is above. In closed form: with sources in
    order of size / weight, those before some point get their most, the rest a common multiple of their weight."""
    by_name = Window.partitionBy(F.lit(0)).orderBy(F.col("source").cast("binary").asc_nulls_last())  # a row a source
    pick = lambda xs: F.element_at(F.array(*[F.lit(x) for x in xs]), (F.col("nth") % len(xs) + 1).cast("int"))
    rows = sizes.withColumn("nth", F.row_number().over(by_name) - 1).select("*", pick(WEIGHTS).alias("weight"), pick(SLOPES).alias("slope"))
    most = F.col("source_size") * MOST
    by_ratio = Window.partitionBy(F.lit(0)).orderBy(most / F.col("weight"), "nth")
    everyone = Window.partitionBy(F.lit(0))
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.select(
        "*",
        (F.sum("source_size").over(everyone) * SHARE - F.coalesce(F.sum(most).over(before), F.lit(0))).alias("open"),
        (F.sum("weight").over(everyone) - F.coalesce(F.sum("weight").over(before), F.lit(0))).alias("shares"),
    )
    level = F.min(F.when(F.col("open") / F.col("shares") <= most / F.col("weight"), F.col("nth_ratio"))).over(everyone)
    rows = rows.withColumn("nth_ratio", F.row_number().over(by_ratio)).withColumn("first", level)
    unit = F.max(F.when(F.col("nth_ratio") == F.col("first"), F.col("open") / F.col("shares"))).over(everyone)
    target = F.when(F.col("nth_ratio") < F.col("first"), most.cast("double")).otherwise(F.least(most.cast("double"), unit * F.col("weight")))
    return rows.select("source", "source_size", "weight", "slope", F.coalesce(target, most.cast("double")).alias("target"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """One row per input row: id_col, source, size (words), source_size, target, taken (words that the mix takes), position
    and again (moments 0..1 of the first and second use, null if there is none).

    A source's documents stand in an order by hash of the id (ties: id, then size), as often as needed; a document is
    taken each time its start lies before the target, so taken words exceed a target by less than one document, and no
    document is taken more than twice. Null texts have size 0; null sources are one source, the last; null ids come
    first. Documents of size 0 take no words: their position is where they stand. Repeated rows are dealt one after
    the other. Of very long texts only the words are counted. No rows give no rows. Other columns are not looked at.

    The heavy source is cut to 4096 parts by hash digits: running sums go over parts (one row each), then inside each.
    """
    scratch = Scratch(docs.sparkSession)
    rows = docs.select(
        F.col(id_col).alias("id"),
        F.col(source_col).cast("string").alias("source"),
        F.coalesce(F.regexp_count(F.col(f"`{text_col}`"), F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")).alias("key"),
    )
    rows = scratch.put(rows.withColumn("part", F.substring("key", 1, DIGITS)), "sizes")
    parts = scratch.put(rows.groupBy("source", "part").agg(F.sum("size").alias("part_size")), "parts")
    sources = targets(parts.groupBy("source").agg(F.sum("part_size").alias("source_size")))
    ahead = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("ahead", F.coalesce(F.sum("part_size").over(ahead), F.lit(0))).drop("part_size")
    parts = parts.withColumnRenamed("source", "s").withColumnRenamed("part", "p")
    sources = sources.withColumnRenamed("source", "ss")
    parts = scratch.put(parts.join(sources, F.col("s").eqNullSafe(F.col("ss"))).drop("ss"), "dealt")
    inside = Window.partitionBy("source", "part").orderBy("key", "id", "size").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("inside", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    rows = rows.join(parts, F.col("source").eqNullSafe(F.col("s")) & (F.col("part") == F.col("p")))
    start = F.col("ahead") + F.col("inside")
    uses = sum(((start + F.col("source_size") * k) < F.col("target")).cast("long") for k in range(MOST))

    def moment(k: int):
        """The time at which the source's demand reaches the document's k-th start: t + slope * (t * t - t) = share."""
        a, share = F.col("slope"), (start + F.col("source_size") * k) / F.nullif(F.col("target"), F.lit(0.0))
        root = (a - 1 + F.sqrt((1 - a) * (1 - a) + 4 * a * share)) / F.nullif(2 * a, F.lit(0.0))
        return F.when(F.col("uses") > k, F.when(a == 0, share).otherwise(root))

    rows = rows.withColumn("uses", uses)
    rows = rows.select(F.col("id").alias(id_col), "source", "size", "source_size", "target", (F.col("size") * F.col("uses")).alias("taken"),
                       "uses", moment(0).alias("position"), moment(1).alias("again"))
    return rows


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = mix(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "size", "source_size", "target", "taken", "position", "again").orderBy("position", "doc_id")


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The documents as training reads them: each once per use, range-sorted by position, with all their columns.

    Rows with equal ids are told apart by source and size only; alike rows get the uses of each, spread evenly. Null and
    empty texts have no words and are read where they stand, while the target is above it. Very long texts move whole, as
    rows do. Columns may have any names; no rows give none.
    """
    found = mix(docs, id_col, text_col, source_col)
    i, s, n, first, at, k, ri, rs, rn, rk, position = fresh(docs, "i", "s", "n", "first", "at", "k", "ri", "rs", "rn", "rk", "position")
    size = F.coalesce(F.regexp_count(F.col(f"`{text_col}`"), F.lit(WORD)), F.lit(0)).cast("long")
    moments = F.filter(F.array("position", "again"), lambda x: x.isNotNull())
    uses = found.select(F.col(f"`{id_col}`").alias(i), F.col("source").alias(s), F.col("size").alias(n), F.col("position").alias(first), moments.alias(at))
    uses = Scratch(docs.sparkSession).put(uses.withColumn(k, F.row_number().over(Window.partitionBy(i, s, n).orderBy(first))), "uses")
    rows = docs.select("*", F.col(f"`{id_col}`").alias(ri), F.col(f"`{source_col}`").cast("string").alias(rs), size.alias(rn))
    if uses.filter(F.col(k) > 1).isEmpty():  # no rows alike: texts need not be gathered to number them
        rows = rows.withColumn(rk, F.lit(1))
    else:
        rows = rows.withColumn(rk, F.row_number().over(Window.partitionBy(ri, rs, rn).orderBy(rn)))
    on = F.col(ri).eqNullSafe(F.col(i)) & F.col(rs).eqNullSafe(F.col(s)) & (F.col(rn) == F.col(n)) & (F.col(rk) == F.col(k))
    out = rows.join(uses.hint("merge"), on).select(*[F.col(f"`{c}`") for c in docs.columns], F.explode(at).alias(position))
    return out.repartitionByRange(position).sortWithinPartitions(position).drop(position)


OP10_SQL = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(length(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size, md5(doc_id::VARCHAR) AS key FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         row_number() OVER (ORDER BY source NULLS LAST) - 1 AS nth FROM d GROUP BY source
), w AS (
  SELECT *, CASE nth % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS weight, CASE nth % 3 WHEN 0 THEN 0.5::DOUBLE WHEN 1 THEN 0.0::DOUBLE ELSE -0.5::DOUBLE END AS slope FROM s
), r AS (
  SELECT *, row_number() OVER o AS k,
         ((SELECT sum(source_size)::BIGINT FROM s) * 1.5::DOUBLE - coalesce(sum(2 * source_size) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT)
         / ((SELECT sum(weight)::BIGINT FROM w) - coalesce(sum(weight) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT) AS unit
  FROM w WINDOW o AS (ORDER BY (2 * source_size)::DOUBLE / weight, nth)
), f AS (SELECT min(k) AS first FROM r WHERE unit <= (2 * source_size)::DOUBLE / weight),
t AS (
  SELECT source, source_size, slope, CASE WHEN k < first THEN (2 * source_size)::DOUBLE
         ELSE least((2 * source_size)::DOUBLE, (SELECT unit FROM r, f WHERE k = first) * weight) END AS target FROM r, f
), p AS (
  SELECT d.*, t.source_size, t.target, t.slope,
         coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY key, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target,
       size * ((start < target)::BIGINT + (start + source_size < target)::BIGINT) AS taken,
       CASE WHEN start < target THEN CASE WHEN slope = 0 THEN start / target
            ELSE (slope - 1 + sqrt((1 - slope) * (1 - slope) + 4 * slope * (start / target))) / (2 * slope) END END AS position,
       CASE WHEN start + source_size < target THEN CASE WHEN slope = 0 THEN (start + source_size) / target
            ELSE (slope - 1 + sqrt((1 - slope) * (1 - slope) + 4 * slope * ((start + source_size) / target))) / (2 * slope) END END AS again
FROM p
"""
