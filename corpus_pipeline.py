"""From raw documents to packed training sequences: five stages, each written as Parquet and read again by the next."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratum.llm.exact_dedup import keep_first
from stratum.llm.langid import fold, keep_known
from stratum.llm.minhash import keep_one
from stratum.llm.mixing import default_tree, mix, word_count
from stratum.llm.packing import pack
from stratum.llm.scratch import documents, settle, temporary


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a letter, whose language can't be told; all others stay."""
    return keep_known(docs, ~F.coalesce(fold(F.col("doc_id"), 4) == 2, F.lit(False)))


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the row with the largest doc_id stays."""
    return keep_first(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents linked by similarity 0.8 or more, the smallest doc_id stays."""
    return keep_one(docs, numerator=80)


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """As many tokens as there are, divided by the tree's weights; a document taken in two epochs stands twice."""
    return mix(docs, default_tree(), word_count(F.col("text")), total_share=1.0, columns=False)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every piece of every document left, with its sequence and place."""
    return pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("language", known_language),
    ("exact dedup", exact_copies),
    ("near dedup", near_copies),
    ("mixing", mixed_sources),
    ("packing", packed),
]

#: Signatures, profiles and token ids can't be expressed in SQL: tests/llm hold the result against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage."""
    docs = documents(spark, sf_dir)
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = settle(docs, f"stage-{i}-{name.replace(' ', '-')}")
    return docs
