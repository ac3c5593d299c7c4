"""Corpus pipeline: quality rules, near-duplicates, mixing to target weights, sampled encoding."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from stavework.llm.gumbel_encode import sample_encode
from stavework.llm.mixing import mix
from stavework.llm.near_dups import keep_one
from stavework.llm.quality_rules import keep_good


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_good(docs)


def near_dups(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_one(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mix(docs)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return sample_encode(docs)


STAGES = [("quality_rules", quality), ("near_duplicates", near_dups), ("source_mixing", mixing), ("gumbel_encoding", encoding)]

#: Sampling and rounding draw from hashes that SQL of another engine doesn't have.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages. Near-duplicates and mixing write the rows that they get to the checkpoint folder once, with row numbers, and
    use only these, so a stage's plan is run once and its order doesn't matter."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
    return docs
