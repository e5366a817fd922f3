"""A training corpus in five stages: each is one operator over all rows that the stage before kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes each result as Parquet to the shared folder
and reads it back as the next stage's docs. All but the last return the columns of documents, whatever further columns those
have and however they are named. No stage fails on nulls in any column, empty or very long texts, ties, repeated rows or an
empty table; what each does with them stands at its function.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tidemill.llm.common import read, written
from tidemill.llm.exact_dups import exact_dedup
from tidemill.llm.near_dups import near_dedup
from tidemill.llm.packing import packed
from tidemill.llm.quality import quality_filter
from tidemill.llm.secrets import redact_secrets


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go. A null or empty text is judged like any other; repeated rows share their fate."""
    return quality_filter(docs, read(spark, sf_dir, "labels"))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of texts that are equal but for white space stays: the longest, then the smallest doc_id, null last. Null texts
    equal empty ones, of which one row stays; of repeated rows one stays."""
    return exact_dedup(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates stays: shingles of five words, similarity 0.8 or more; the smallest doc_id, null last, then
    the smaller hash of the text. Texts without words are no one's duplicates and stay."""
    return near_dedup(docs, width=5, percent=80)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a mark; all rows stay, null and empty texts as they are, repeated rows with equal texts."""
    return redact_secrets(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document's pieces with their places in sequences of 4096 tokens. A null or empty text is one end token; repeated rows
    are packed each for itself."""
    return packed(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("quality", quality), ("exact_dedup", exact), ("near_dedup", near), ("secrets", secrets), ("packing", packing)]
#: The stages fit a model, draw trees and search for a packing, which SQL can't express; the tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
