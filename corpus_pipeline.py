"""The corpus pipeline: five stages over ``documents``, each of which works on
what the one before it kept, written as Parquet and read again in between."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lodestar.llm import bpe, line_dedup, minhash, mixing, quality
from lodestar.llm.shared import settled


def drop_bad(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    return quality.keep_good(docs)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that a smaller doc_id holds go; every document stays."""
    return line_dedup.without_repeated_lines(docs, n_chars="n_chars")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays."""
    return minhash.drop_near_duplicates(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them; at a source's cut, in part."""
    return mixing.mixed(docs, n_chars="n_chars")


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids in place of texts, with the digest of the decoded bytes."""
    import public_tokenizers

    path, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    return bpe.digests(docs, path, pattern, ids=True)


STAGES = [
    ("quality", drop_bad),
    ("line_dedup", drop_repeated_lines),
    ("near_dedup", drop_near_copies),
    ("mixing", mix),
    ("byte_bpe", encode),
]

#: SQL can't express the first stage, nor the third.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = settled(spark, lambda: stage(spark, docs, sf_dir), name)  # noqa: B023  called at once
    return STAGES[-1][1](spark, docs, sf_dir)
