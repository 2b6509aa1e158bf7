"""A training-data pipeline over `documents`: five stages, each an operator of matchloom.llm.

Each stage works on all that the one before it kept, is written as Parquet to the shared
folder, and is read again from there. An empty table gives an empty table in each of them, a repeated row
is as many rows (near-dedup keeps one), and texts may be as long as a string can be.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from matchloom.llm import langid, mixing, pii, simhash, tokens
from matchloom.llm.common import materialize, ship, table


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that are in no language (null texts, and texts without letters, thus empty ones). Null languages,
    sources and ids stay."""
    ship(spark)
    return langid.in_a_language(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near-duplicates, the one with the smallest doc_id (a null one only if all are). Null
    and empty texts have one fingerprint, and so are one group."""
    ship(spark)
    return simhash.deduplicated(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data in the texts by its kind. Null texts stay null, empty ones empty."""
    ship(spark)
    return pii.redacted(docs)


def mixing_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes each document 0, 1 or 2 times, so that the sources' words come near their targets. A null source is one of its
    own; null and empty texts have no words and go along once where their source has any copy."""
    ship(spark)
    return mixing.mixed_documents(docs)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Encodes the texts, and decodes them again: doc_id, n_tokens, ids and the digests of both. Null and empty texts have no
    ids."""
    ship(spark)
    return tokens.bpe_round_trip(docs, whole=True).drop("decoded")


STAGES = [
    ("language ID", language),
    ("SimHash near-dedup", near_duplicates),
    ("PII", personal_data),
    ("mixing sources to target weights", mixing_sources),
    ("byte-level BPE encoding and decoding", token_ids),
]

#: SQL expresses none of the stages' models; tests/llm compares them with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialize(docs, f"stage{k}")
    return docs
