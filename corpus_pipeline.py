"""From raw documents to packed sequences: five stages, each written as Parquet and read again.

Every stage works on all that the one before it kept, and all but the last return the columns of ``documents``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from assetloom.llm import exact_dedup, language_id, packing, secrets, simhash
from assetloom.llm.common import materialise, table
from assetloom.llm.queries import PACK_ENCODER

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a letter, and those whose best language has a score under one half."""
    return language_id.keep_known(docs, language_id.train(docs))


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts equal up to white space, keeps the row of the least id."""
    return exact_dedup.exact_dedup(docs, carry=True).filter("kept").select("row.*")


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by fingerprint, keeps that of the least id."""
    return simhash.one_of_each(docs)


def secret_marks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps all documents; secrets in their texts become a mark, and n_chars follows."""
    return secrets.redact(docs, length_col="n_chars")


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of fixed length."""
    return packing.pack(docs, PACK_ENCODER)


STAGES: list[tuple[str, Stage]] = [
    ("language_id", known_language),
    ("exact_dedup", exact_copies),
    ("simhash_near_dedup", near_copies),
    ("secret_scan", secret_marks),
    ("packing", packed),
]

#: Language ID, fingerprints and token ids have no SQL; the tests hold the stages against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
