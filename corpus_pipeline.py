"""From documents to token files: the stages of a training-data pipeline, each one operator of `sinew.llm`."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from sinew.llm.decontaminate import decontaminated
from sinew.llm.frames import documents, ready, scratch, stored
from sinew.llm.mixing import resampled
from sinew.llm.shingles import deduplicated
from sinew.llm.tokens import token_digest, write_tokens
from sinew.llm.toxicity import without_toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that their language's threshold does not reject."""
    return without_toxic(docs, ready(spark).read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every group linked by a similarity of 0.8 of five-word shingles: the one with the smallest id."""
    ready(spark)
    return deduplicated(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the passages that hold a window of a benchmark item."""
    return decontaminated(docs, ready(spark).read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    ready(spark)
    return resampled(docs)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document in the token files written from the mix."""
    path = scratch(ready(spark), "tokens")
    write_tokens(docs, path, public_tokenizers.path("byte_bpe_50k.json"))
    return token_digest(spark, path)


STAGES = [
    ("toxicity", toxicity),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("mixing", mixing),
    ("token_ids", token_ids),
]

#: Neither the trained network nor fingerprints and token ids can be stated in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table; every stage's rows are written and read again by the next."""
    docs = documents(ready(spark), sf_dir)
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
