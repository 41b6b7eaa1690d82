"""Corpus pipeline: language ID, exact dedup, n-gram Jaccard join, mixing to target weights, packing.

Each stage gets all rows that the one before kept, written as Parquet and read again, and returns documents with their
columns; the last returns pieces of packed sequences. Columns beyond those of documents may have any names and are kept;
very long texts are handled whole; a table without rows gives none.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from skein.llm import exact_dedup, language_id, mixing, ngram_jaccard, packing
from skein.llm.common import Scratch


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a language go: null, empty and letterless texts. Null and repeated ids are rows like others."""
    return language_id.in_known_languages(docs)


def copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest doc_id stays (null below all others), of rows alike in both one."""
    return exact_dedup.drop_copies(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates (five words a shingle, Jaccard similarity 0.8 or more) the row with the smallest
    doc_id stays (null after all others). Rows with equal ids and different texts are documents of their own; those
    without words stay."""
    return ngram_jaccard.one_of_each_group(docs, words=5, num=8, den=10)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, in training order; null sources are one source, the last."""
    return mixing.mixed(docs)


#: Words that packing remembers here, fewer than by itself: its workers stay beside those of the stages before.
REMEMBERED = 300_000


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of packed token sequences with their token ids; a null text is empty and gives the end id alone."""
    return packing.pack(docs, cached=REMEMBERED)


STAGES = [
    ("2 language ID", language),
    ("4 exact dedup", copies),
    ("1 n-gram Jaccard join", near_copies),
    ("10 mixing", mixture),
    ("3 packing", sequences),
]

#: Language ID and the tokeniser's packing are not expressible in SQL; tests/llm holds the stages against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = scratch.put(stage(spark, docs, sf_dir), name.split()[0])
    return STAGES[-1][1](spark, docs, sf_dir)
