"""The corpus pipeline: documents in, encoded training text out.

``STAGES`` lists (name, function); each function takes (spark, docs, sf_dir) and
returns a DataFrame, which is written as Parquet and read again as the next
one's docs.  All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from boxwright.llm import mixing, near_dup, quality_rules, secret_scan, sentence_pieces
from boxwright.llm.queries import PIECE_MODEL
from boxwright.llm.shared import materialise, table

#: Documents this similar, in per cent of their shingles, are near duplicates to the pipeline.
NEAR_PERCENT = 80


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go."""
    return quality_rules.keep_good(docs)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays."""
    return near_dup.keep_one(docs, NEAR_PERCENT)


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets and linked parts of credentials are masked in the texts."""
    return secret_scan.mask_secrets(docs)


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are left out or repeated so that sources meet their weights."""
    return mixing.mixed(docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of every text, a row for each document as often as it was taken."""
    return sentence_pieces.gathered(sentence_pieces.encode(docs, sentence_pieces.load(spark, PIECE_MODEL)))


STAGES = [
    ("quality rules", good_documents),
    ("near duplicates", one_of_each),
    ("secret scan", without_secrets),
    ("source mixing", mixed_sources),
    ("sentence pieces", encoded),
]

#: Balanced sampling and merges over a lattice are not expressible in SQL; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
