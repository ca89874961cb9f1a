"""A training-data pipeline over `documents`: each stage calls one operator and works on all that the one before kept."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from chronoward.llm import bpe, decontaminate, line_dedup, near_dup, quality
from chronoward.llm.common import MADE, deleted, table, written


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts. Null and empty texts are scored too; repeated rows are judged alike."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that nearly repeat an earlier one.

    A document that loses all its lines stays, with an empty text, as null and empty texts do. Rows without an id keep
    their lines; rows equal in id and text lose the same ones.
    """
    return line_dedup.deduplicated(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates. Null and empty texts are in no group; rows without an id stay."""
    return near_dup.keep_one(docs)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item. Null and empty texts and rows without an id stay."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, with digests of the ids and of the decoded bytes; a null text has no ids."""
    return bpe.encode_decode(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, keep_ids=True)


STAGES = [
    ("quality", keep_quality),
    ("line_dedup", drop_repeated_lines),
    ("near_dup", drop_near_duplicates),
    ("decontaminate", drop_benchmark),
    ("bpe", encode),
]

#: The stages rest on learned models and signatures, which SQL cannot express; tests hold each against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every stage in turn, each written as Parquet in the shared folder and read again for the next.

    What a stage wrote on its way, and its input, are deleted once its own result is there.
    """
    docs = table(spark, sf_dir, "documents")
    before: list[str] = []
    for name, stage in STAGES:
        kept = set(MADE)
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
        deleted(spark, [x for x in MADE if x not in kept and x != docs.folder] + before)
        before = [docs.folder]
    return docs
