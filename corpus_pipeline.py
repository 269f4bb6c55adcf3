"""The corpus pipeline: five stages over ``documents``, each written as Parquet and read as the next one's docs."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarn.llm import decontaminate, exact_dedup, language, sentencepieces, shingles
from tarn.llm.shared import read, table

PIECES = os.environ.get("PIECES_MODEL", "/opt/tokenizers/piece_bpe_32k.model")


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Learns from the documents outside the held-out quarter; a text that no language can be told for goes.

    Those are null texts and texts without letters.  Equal texts go or stay together, whatever their
    ids; a null id is like any other.  Columns are handed on as they are; an empty table stays empty.
    """
    profiles = language.fit(docs.filter(~language.held_out()))
    return language.identify(docs, profiles, pred_col="__lang", score_col="__score").filter(F.col("__lang") != language.UNKNOWN).drop("__lang", "__score")


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts that are equal but for white space the row with the smallest doc_id stays, as ``exact_dedup.deduplicate`` says."""
    return exact_dedup.deduplicate(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of documents whose five-word shingles are 0.8 alike or more the row with the smallest doc_id stays.

    Candidates are SimHash's links and those of min-wise keys, as ``shingles`` says; null ids, repeated
    rows and empty tables are as there.
    """
    return shingles.deduplicate(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text holds a window of a benchmark item go, whatever their ids, as ``decontaminate.clean`` says."""
    return decontaminate.clean(docs, read(spark, sf_dir, "benchmark"))


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids and n_ids of what is left, a row for each row; a null or empty text has no ids."""
    return sentencepieces.encode(docs, sentencepieces.Pieces.load(PIECES)).select("doc_id", "ids", F.size("ids").alias("n_ids"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language_id),
    ("exact_dedup", exact),
    ("near_dedup", near),
    ("decontamination", decontamination),
    ("pieces", pieces),
]

#: Neither profiles, components of near copies nor the search for pieces can be told in SQL; tests/llm holds the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = table(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
