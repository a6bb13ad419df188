"""From raw documents to token ids: five stages, each on what the one before kept."""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from logharrow.llm.bpe import byte_bpe
from logharrow.llm.exact import DigestIndex
from logharrow.llm.mixing import mixed_documents
from logharrow.llm.ngram_join import Jaccard, group_leaders
from logharrow.llm.quality import good_documents
from logharrow.session import settled, work_dir


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go; the others stay as they are."""
    return good_documents(docs)


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts that are equal but for blanks, one document stays."""
    index = DigestIndex(spark, f"digest_index_{uuid.uuid4().hex}", work_dir(spark, "digest-index"))
    return index.new_documents(docs, load="pipeline")


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by a similarity of 0.8 or more on five-word shingles, one stays."""
    return group_leaders(docs, Jaccard(n=5, up=80, down=100))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as many times (0, 1 or 2) as the mix takes them."""
    return mixed_documents(docs)


def tokens_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document of the mix, and the digests of ids and decoded bytes."""
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return byte_bpe(docs, path, public_tokenizers.PATTERN)


STAGES = [
    ("quality rules", quality_stage),
    ("exact dedup", exact_stage),
    ("n-gram Jaccard join", near_stage),
    ("mixing sources", mixing_stage),
    ("byte-level BPE", tokens_stage),
]

# SQL cannot express byte-pair merges, nor the links by similarity.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on documents, each written as Parquet and read by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = settled(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
