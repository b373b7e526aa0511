"""A corpus from quality filter to token identifiers, in stages that each work on all that the one before kept.

Each stage takes (spark, docs, sf_dir) and returns a table, which is written and read again before the next. The first stages return the columns of documents and
drop whole rows; the last returns identifiers. Null and empty texts are one text, of which one row stays if the classifier lets it pass. Of rows that repeat a doc_id
with the same text one stays; with another text they are documents of their own. An empty table passes through as such.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from convolake.llm import decontamination, exact_dedup, ngram_join, piece_codec, quality
from convolake.llm.common import keep_rows, released, saved, table


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier predicts as good."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the one with the smallest doc_id."""
    return keep_rows(docs, exact_dedup.exact_dedup(docs))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the one with the smallest doc_id."""
    return keep_rows(docs, ngram_join.near_duplicates(docs))


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontamination.without_items(docs, table(spark, sf_dir, "benchmark"))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents as token identifiers."""
    return piece_codec.encode(docs)


STAGES = [
    ("quality classifier", quality_filter),
    ("exact dedup", exact_copies),
    ("n-gram Jaccard join", near_copies),
    ("benchmark decontamination", benchmark_leaks),
    ("SentencePiece encoding", encoded),
]

#: The classifier, the similarity join and the tokenizer are beyond SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written and read again."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES[:-1]):
        with released(spark):
            docs = saved(stage(spark, docs, sf_dir), f"stage{k}", outer=True)
    return STAGES[-1][1](spark, docs, sf_dir)
