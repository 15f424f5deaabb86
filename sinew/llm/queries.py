"""Registered queries of the training-data operators and their SQL counterparts."""

from __future__ import annotations

from collections.abc import Callable

import corpus_pipeline
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sinew.llm import backoff
from sinew.llm.decontaminate import contamination
from sinew.llm.frames import documents, ready, scratch
from sinew.llm.licences import licences
from sinew.llm.mixing import mixed
from sinew.llm.parsing import repeats
from sinew.llm.positive_unlabelled import quality
from sinew.llm.quality_rules import judged
from sinew.llm.repair import audited, damaged
from sinew.llm.simhash import near_duplicates
from sinew.llm.tokens import token_digest, write_tokens
from sinew.llm.toxicity import toxicity
from sinew.llm.trie import prefix_trie, rebuilt
from sinew.llm.wordtable import round_trip

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = lambda spark, sf_dir: fn(ready(spark), sf_dir)
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


@register("op1_source_mixing")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixed(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")


@register("op2_license_scan")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences(documents(spark, sf_dir)).drop("detections")


@register("op3_toxicity")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


@register("op4_benchmark_decontamination")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.drop("spans", "items")


@register("op5_repeated_substrings")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats(documents(spark, sf_dir)).drop("spans")


@register("op6_backoff_scores", backoff.sql())
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return backoff.scores(documents(spark, sf_dir)).withColumn("score", F.round("score", 6))


@register("op7_quality_rules")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(documents(spark, sf_dir))


@register("op8_simhash_near_duplicates")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir))


@register("op9_quality_classifier")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


@register("op10_token_files")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "tokens")
    write_tokens(documents(spark, sf_dir), path, public_tokenizers.path("byte_bpe_50k.json"))
    return token_digest(spark, path)


@register("op11_conversation_trie")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(*rebuilt(spark.read.parquet(f"{sf_dir}/conversations.parquet")))


@register("op12_conversation_repair")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return audited(conversations, damaged(conversations))


@register("op13_bpe_words")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))


register("pipeline", corpus_pipeline.ORACLE_SQL)(corpus_pipeline.run)
