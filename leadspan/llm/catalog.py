"""Registered queries of the corpus operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline
from leadspan.llm import chat, decontaminate, grid_join, lines, manifest, mixing, repair, rules, secrets, simhash, toxicity, urls, wavelet
from leadspan.llm.texts import documents

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(documents(spark, sf_dir))


@query
def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.measures(documents(spark, sf_dir))


@query
def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.remove_repeated(documents(spark, sf_dir))


@query
def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(documents(spark, sf_dir), documents(spark, sf_dir, "labels"))


@query
def op5_chat_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.canonical(documents(spark, sf_dir, "conversations"))


@query
def op6_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(documents(spark, sf_dir), documents(spark, sf_dir, "benchmark"))


@query
def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(documents(spark, sf_dir, "pages"))


ORACLES["op7_url_filter"] = urls.ORACLE


@query
def op8_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wavelet.encode_documents(documents(spark, sf_dir))


@query
def op9_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.taken_words(documents(spark, sf_dir))


@query
def op10_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(documents(spark, sf_dir))


@query
def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.repair_damaged(documents(spark, sf_dir, "conversations"))


@query
def op12_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grid_join.near_duplicates(documents(spark, sf_dir, "embeddings"))


@query
def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest.tampered_audit(documents(spark, sf_dir))


QUERIES["pipeline"] = corpus_pipeline.run
if corpus_pipeline.ORACLE_SQL is not None:
    ORACLES["pipeline"] = corpus_pipeline.ORACLE_SQL
