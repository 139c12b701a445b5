"""The queries of this subpackage, over whole tables with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from corrobora.llm.chat import CHAT_SQL, chat_digest, with_probe
from corrobora.llm.decontam import contamination_report
from corrobora.llm.jaccard import jaccard_components
from corrobora.llm.licenses import LICENSE_SQL, licenses_found
from corrobora.llm.merkle import merkle_report
from corrobora.llm.minhash import near_duplicates
from corrobora.llm.oracles import JACCARD_SQL, contamination_sql, merkle_sql, near_duplicate_sql, quality_sql, trie_sql
from corrobora.llm.packing import pack
from corrobora.llm.pii import checked_report
from corrobora.llm.quality import quality_report
from corrobora.llm.sharding import shard
from corrobora.llm.tokenfile import tokenize_to_files
from corrobora.llm.trie import rebuilt_trie
from corrobora.llm.wrapper import extract


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(_documents(spark, sf_dir))


def op2_rendezvous_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(_documents(spark, sf_dir))


def op3_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(_documents(spark, sf_dir))


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses_found(_documents(spark, sf_dir))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination_report(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), slop=1)


def op6_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_digest(with_probe(spark.read.parquet(f"{sf_dir}/conversations.parquet")))


def op7_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenize_to_files(_documents(spark, sf_dir))


def op9_repetition_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_report(_documents(spark, sf_dir))


def op10_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checked_report(_documents(spark, sf_dir))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle_report(_documents(spark, sf_dir))


def op12_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_documents(spark, sf_dir))


def op13_conversation_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rebuilt_trie(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_best_fit_packing, op2_rendezvous_sharding, op3_ngram_jaccard_join, op4_license_scan, op5_decontamination, op6_chat_formatting, op7_html_extraction, op8_token_files, op9_repetition_quality, op10_pii_surrogates,
        op11_merkle_manifest, op12_minhash_near_dedup, op13_conversation_prefix_trie,
    )
}

ORACLE_SQL: dict[str, str] = {
    "op3_ngram_jaccard_join": JACCARD_SQL, "op4_license_scan": LICENSE_SQL, "op5_decontamination": contamination_sql(), "op6_chat_formatting": CHAT_SQL, "op9_repetition_quality": quality_sql(),
    "op11_merkle_manifest": merkle_sql(), "op12_minhash_near_dedup": near_duplicate_sql(), "op13_conversation_prefix_trie": trie_sql(),
}
