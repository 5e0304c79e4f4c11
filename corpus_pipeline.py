"""Corpus pipeline: language ID, exact dedup, near-duplicates, mixing, tokenising.

Every stage takes ``(spark, docs, sf_dir)`` and works on all rows that the stage before kept; all but
the last return the columns of ``documents``.

* ``language_id`` drops documents without a letter or out of place in every learned language.
* ``exact_dedup`` keeps the row with the largest id of equal texts.
* ``ngram_join`` keeps the document with the least id of each near-duplicate component.
* ``mixing`` repeats each document as often as the mix to target weights takes it.
* ``sentencepiece`` gives ids: ``doc_id, n_tokens, ids, lossless``; copies of a document are cut each on its own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from segspark.llm import exact_dedup, langid, mixing, ngram_join, pieces
from segspark.llm.common import Scratch, swept


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows written in a learned language; null, empty and letterless texts go."""
    return langid.accepted(docs)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of rows with equal texts, null being empty, the one with the largest id; of identical rows one."""
    return exact_dedup.keep_one(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each near-duplicate component, that of the least id; rows without words all stay."""
    return ngram_join.keep_one(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row as often as the mix takes it, 0 to 3 times; null sources are one source, empty texts take nothing."""
    return mixing.mixed(docs)


def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every row, copies cut each on its own; a null text has none."""
    return pieces.encode(docs, copies=True)


STAGES = [
    ("language_id", language_id),
    ("exact_dedup", drop_copies),
    ("ngram_join", drop_near_copies),
    ("mixing", mix),
    ("sentencepiece", tokenise),
]

#: SQL has no rank-order profiles or merges; tests hold the rows against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written and read again as the next one's input.

    Once a stage is written, its input and the tables of its operator are deleted, so the scratch folder
    holds one stage's input at a time; the last one stays, as the result reads it.
    """
    scratch = Scratch(spark, "pipeline")
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        with swept():
            docs = scratch.save(stage(spark, docs, sf_dir), name)
        if before:
            scratch.drop(before)
        before = name
    return STAGES[-1][1](spark, docs, sf_dir)
