"""A corpus pipeline: stages over the documents table, each written as Parquet and read again by the next.

All but the last return the columns of documents. Near copies are judged on five-word shingles at a
similarity of 0.8; personal data is masked and n_chars follows; the last stage returns packed pieces.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from gleanframe.llm import packing, pii, quality
from gleanframe.llm.common import saved
from gleanframe.llm.exact_dedup import without_copies
from gleanframe.llm.jaccard import without_near_copies
from gleanframe.session import configure


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.clean(docs)


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return without_copies(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return without_near_copies(docs, width=5, percent=80)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pii.masked(docs, length_col="n_chars" if "n_chars" in docs.columns else None)


def best_fit(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    paths = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")
    return packing.pack(docs, *paths, public_tokenizers.PATTERN)


STAGES = [
    ("quality_rules", quality_rules),
    ("exact_dedup", exact_copies),
    ("jaccard_join", near_copies),
    ("pii", personal_data),
    ("packing", best_fit),
]

#: SQL cannot express the stages; tests hold them against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; the last one's rows."""
    configure(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = saved(stage(spark, docs, sf_dir))
    return docs
