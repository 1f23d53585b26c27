"""Corpus pipeline: reject poor documents, drop repeated lines, drop near
duplicates, mix the sources, pack what is left into sequences.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written
and read again as the next stage's ``docs``; all but the last return the columns
of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from loghawk.llm.catalog import tokenizer_path
from loghawk.llm.common import store, table
from loghawk.llm.line_dedup import documents_without_repeated_lines
from loghawk.llm.mixing import mixed_documents
from loghawk.llm.near_dedup import first_of_near_duplicates
from loghawk.llm.packing import pack_documents
from loghawk.llm.quality import good_documents


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    return good_documents(docs, table(spark, sf_dir, "labels"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that stand earlier go, and documents with no other text."""
    return documents_without_repeated_lines(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: five words, 0.8."""
    return first_of_near_duplicates(docs, k=5, percent=80, rows=5)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at their target weights; rows repeat where a source is short."""
    return mixed_documents(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 4096 tokens: one row for each piece."""
    return pack_documents(docs, tokenizer_path())


STAGES = [("quality", quality), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("mixing", mixing), ("packing", packing)]

#: The classifier and the tokenizer have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = store(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
