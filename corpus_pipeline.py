"""A training corpus from ``documents``: five stages, each written as Parquet and read by the next."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from chronolake.llm.bpe import bpe_encode
from chronolake.llm.decontam import drop_contaminated
from chronolake.llm.exact_dedup import drop_copies
from chronolake.llm.near_dedup import drop_near_copies
from chronolake.llm.quality import drop_poor
from chronolake.llm.scratch import materialize


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that importance resampling draws."""
    return drop_poor(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each text, the one with the largest id."""
    return drop_copies(docs, keep="max")


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate component: sets of five-word shingles, similarity 0.8."""
    return drop_near_copies(docs, shingle=5, percent=80)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a ten-word window of the benchmark."""
    return drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), window=10)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids and decoded_sha256 of each document."""
    return bpe_encode(docs, public_tokenizers.path("byte_bpe_50k.json"), digest=True)


STAGES = [("quality classifier", quality), ("exact dedup", exact), ("near dedup", near), ("decontamination", benchmark), ("bpe", tokens)]

#: SQL can express neither the resampling nor the tokenizer; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "_"))
    return docs
