"""The registered queries of this subpackage: thin applications of its operators to their whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import contract_sql
from .chat_format import format_chats, read_back, tricky_conversation
from .common import table
from .fingerprints import compare_with_next
from .gumbel_encode import sample_encode
from .html_text import main_texts
from .importance import resample
from .licenses import scan_licenses
from .mixing import decide
from .near_dups import near_duplicates
from .neighbours import nearest
from .quality_rules import assess
from .runs import periodic_runs, with_digests, with_repeated_tails
from .sharding import shard
from .token_counts import count_tokens


def op1_gumbel_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sample_encode(table(spark, sf_dir, "documents"))


def op2_prefix_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare_with_next(table(spark, sf_dir, "documents"))


def op3_license_diagonals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents"))


def op4_feistel_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(table(spark, sf_dir, "documents"))


def op5_weak_supervision(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assess(table(spark, sf_dir, "documents")).withColumn("p_good", F.round("p_good", 6))


def op6_best_region(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_texts(table(spark, sf_dir, "pages"))


def op7_weighted_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents")).drop("r")


def op8_chat_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return read_back(format_chats(turns.unionByName(tricky_conversation(spark))))


def op9_pivotal_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decide(table(spark, sf_dir, "documents")).drop("r")


def op10_viterbi_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"))


def op11_importance_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_digests(periodic_runs(with_repeated_tails(table(spark, sf_dir, "documents"))))


def op13_hilbert_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op")}


def oracle_sql() -> dict[str, str]:
    return contract_sql.texts()
