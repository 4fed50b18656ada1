"""The registered queries of this subpackage: thin digests of its operators, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.byte_bpe import digest, encode_documents
from tidemark.llm.common import table
from tidemark.llm.decontamination import contamination, decontamination_digest
from tidemark.llm.language_id import language_id
from tidemark.llm.quality import quality
from tidemark.llm.secret_scan import scan, secret_digest
from tidemark.llm.simhash_dedup import near_duplicates
from tidemark.llm.substring_dedup import dedup_digest, substring_dedup
from tidemark.llm.token_counts import token_counts
from tidemark.llm.vector_topk import top_k
from tidemark.llm.warc import page_digest, round_trip


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_digest(substring_dedup(table(spark, sf_dir, "documents")))


def op3_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_digest(round_trip(table(spark, sf_dir, "pages"), with_payload=False))


def op5_vector_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"))


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_digest(scan(table(spark, sf_dir, "documents")))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination_digest(contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(encode_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id(table(spark, sf_dir, "documents")).select("doc_id", "held_out", "lang_pred", "score")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op") and name[2].isdigit()}


def oracle_sql() -> dict[str, str]:
    return {}
