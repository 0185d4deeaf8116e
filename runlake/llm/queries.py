"""Registered queries of this subpackage: ``(spark, sf_dir) -> DataFrame``."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from runlake.llm import (extraction, langid, lexical, merkle, mixing, neardup, packing, preference, quality, sharding,
                         toxicity, url_filter, whitening)
from runlake.llm.common import crc32_fold

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")

# Rules that override the list, and the listed hosts.
URL_RULES = {"com/": "allow", "example.com/en/": "block", "www.example.com/en/": "allow", "net/es/": "block",
             "net/fr/": "block"}
BLOCKED_SITES = ["ads-track", "adult-x", "casino-win", "cheap-pills", "free-bets", "spam-farm"]
BLOCKED_HOSTS = [f"{site}.example.{top}" for site in BLOCKED_SITES for top in ("com", "net", "org")]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def training(doc_id: str = "doc_id"):
    """Rows a classifier may learn from; the others are held out."""
    return crc32_fold(F.col(doc_id)) != 0


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judged(table(spark, sf_dir, "pages"), URL_RULES, BLOCKED_HOSTS)


def op2_distribution_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_report(table(spark, sf_dir, "documents"))


def op3_byte_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    shards = sharding.byte_shards(table(spark, sf_dir, "documents"), 8)
    return shards.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
                         F.lit(None).cast("int").alias("grown_shard"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = toxicity.toxicity_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), training())
    return scores.select("doc_id", (~training()).alias("held_out"), "score",
                         (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op5_preference_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return preference.format_pairs(*preference.contrasted(table(spark, sf_dir, "conversations")))


def op6_large_item_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), VOCABULARY, 4096)


def op7_merkle_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.fingerprints(table(spark, sf_dir, "documents"))


def op8_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_counts(table(spark, sf_dir, "documents"))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.predictions(table(spark, sf_dir, "documents"), training()).select(
        "doc_id", (~training()).alias("held_out"), "lang_pred", "score")


def op10_minhash_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"))


def op11_host_consensus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extraction.main_texts(table(spark, sf_dir, "pages"))


def op12_dual_tree_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.ranked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), 20)


def op13_incremental_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"), 16)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (
        op1_url_filter, op2_distribution_quality, op3_byte_shards, op4_toxicity, op5_preference_pairs,
        op6_large_item_packing, op7_merkle_fingerprints, op8_source_mixing, op9_language_id, op10_minhash_neardup,
        op11_host_consensus, op12_dual_tree_search, op13_incremental_whitening)}
QUERIES["pipeline"] = corpus_pipeline.run
