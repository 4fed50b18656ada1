"""The corpus pipeline over `documents`: language ID, near-duplicates, decontamination, secret scan, byte-level BPE.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of
documents. Null and empty texts, null ids, repeated rows and further columns are handled as the
operators' docstrings say; an empty table gives an empty result. Very long texts pass every stage whole, in
one row; no stage gathers texts.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.byte_bpe import digest, encode_documents
from tidemark.llm.common import settle, table
from tidemark.llm.decontamination import contamination
from tidemark.llm.language_id import UNKNOWN, identify, learn
from tidemark.llm.secret_scan import redact
from tidemark.llm.simhash_dedup import near_duplicates


def _keyed(docs: DataFrame) -> DataFrame:
    """docs with a key (__key, never null) of id and text: stages decide by row, as ids may be null or repeat. Rows that share a key share every decision."""
    return docs.withColumn("__key", F.xxhash64(F.col("doc_id").isNull(), "doc_id", F.col("text").isNull(), "text"))


def _without(keyed: DataFrame, gone: DataFrame) -> DataFrame:
    """The rows of keyed whose key is not in gone."""
    return keyed.join(gone, "__key", "left_anti")


def languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows without a language (no letter, or none learnt) go."""
    keyed = _keyed(docs)
    found = identify(keyed, learn(docs), id_col="__key").filter(F.col("lang_pred") == UNKNOWN)
    return _without(keyed, found.select(F.col("doc_id").alias("__key")).distinct()).drop("__key")


def near_duplicates_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates one row stays: the one of the smallest doc_id, a null id only where there is no other; of rows that share it, the smallest key.

    Near means op3's 3 of 64 SimHash bits over three-word shingles: most pairs of 5-word similarity 0.8 are farther apart and stay (README has the recall).
    """
    keyed = _keyed(docs)
    found = settle(near_duplicates(keyed, id_col="__key").select(F.col("doc_id").alias("__key"), F.col("component_id").alias("__group")), "near-duplicates")
    rows = settle(keyed.select("__key", "doc_id").distinct().join(found.distinct(), "__key"), "groups")
    first = rows.groupBy("__group").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "__key")).alias("first")).select("first.__key")
    kept = _without(keyed, rows.select("__key").join(first, "__key", "left_anti"))
    twice = settle(found.groupBy("__key").count().filter("count > 1").select("__key"), "repeated")
    # Rows that share id and text are rare; only they are grouped.
    once = kept.join(twice, "__key", "left_anti")
    again = kept.join(twice, "__key", "left_semi")
    return once.unionByName(again.dropDuplicates(["__key"])).drop("__key")


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows with any benchmark window go."""
    keyed = _keyed(docs)
    found = contamination(keyed, table(spark, sf_dir, "benchmark"), id_col="__key").filter("n_hit > 0")
    return _without(keyed, found.select(F.col("doc_id").alias("__key")).distinct()).drop("__key")


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every secret in a text becomes a mark; n_chars follows."""
    return redact(docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256)."""
    return digest(encode_documents(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN))


STAGES = [("language ID", languages), ("near-duplicates", near_duplicates_stage), ("decontamination", decontaminated), ("secrets", without_secrets), ("byte-level BPE", encoded)]

#: Language ID and the ratio model can't be said in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order; each result is written as Parquet and read again."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = settle(stage(spark, docs, sf_dir), "stage")
    return docs
