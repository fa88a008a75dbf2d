"""The registered queries of the operators: thin digests over their general interfaces."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assetloom.llm import bpe, exact_dedup, factorisation, language_id, packing, quality_rules, secrets, sharding, simhash, substring_dedup
from assetloom.llm.common import crc_fold, table

SHARDS = 24
PACK_ENCODER = (public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op1_collinear_chaining(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.passages(table(spark, sf_dir, "documents"))


def op2_ftrl_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = language_id.predict(docs, language_id.train(docs))
    return found.select("doc_id", (crc_fold(F.col("doc_id"), 4) == 2).alias("held_out"), "lang_pred", "score")


def op3_mincost_flow_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents from the files that they are in now to 24 shards of equal bytes."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.col("_metadata.file_path").alias("old_file"))
    placed = sharding.reshard(docs, SHARDS, F.col("old_file"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "old_shard")


def op4_assignment_lexing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(table(spark, sf_dir, "documents"))


def op5_ball_hashing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_dedup(table(spark, sf_dir, "documents")).select("doc_id", "fingerprint", "component_id")


def op6_first_fit_decreasing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), PACK_ENCODER)


def op7_content_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"))


def op8_log_likelihood_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_factorisation_machine(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = factorisation.score(docs, factorisation.train(docs, table(spark, sf_dir, "labels")))
    return found.select("doc_id", (crc_fold(F.col("doc_id"), 5) == 0).alias("held_out"), "score", (F.col("score") >= factorisation.CUT).cast("int").alias("predicted"))


def op10_segment_tree_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_collinear_chaining,
        op2_ftrl_language_id,
        op3_mincost_flow_sharding,
        op4_assignment_lexing,
        op5_ball_hashing,
        op6_first_fit_decreasing,
        op7_content_sort,
        op8_log_likelihood_ratio,
        op9_factorisation_machine,
        op10_segment_tree_bpe,
    )
}
ORACLE_SQL: dict[str, str] = {"op7_content_sort": exact_dedup.ORACLE_SQL}
