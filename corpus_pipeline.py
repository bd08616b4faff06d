"""The corpus pipeline: from raw documents to token shards, one written table per stage."""

from __future__ import annotations

import public_tokenizers
import pyspark.sql.functions as F
from pyspark.sql import DataFrame, SparkSession

from stationweave.llm import decontamination, minhash_dedup, mixing, token_files, toxicity
from stationweave.llm._common import prepare, settled


def _toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose expected severity stays below the model's first step; the model is fitted on the labelled ones."""
    return toxicity.keep_clean(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def _near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: five-word shingles, similarity of 0.8 or more."""
    return minhash_dedup.keep_first(docs, shingle_words=5, percent=80)


def _decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold less than 0.8 of every benchmark item."""
    return decontamination.keep_clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), short_items=True)


def _mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return mixing.mixed(docs)


def _tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token shards of the mix, read back: one row per document copy with its place and a checksum of its ids."""
    tokens = token_files.token_table(docs, public_tokenizers.path("word_bpe_49k.json"), end_id=1, word_memo=True)
    return tokens.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


STAGES = [("toxicity", _toxicity), ("near_dedup", _near_dedup), ("decontamination", _decontaminate), ("mixing", _mix),
          ("token_files", _tokens)]

# SQL can't express the fitted model and the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written and read again as the next one's documents.

    What a stage made on the way, token shards included, is deleted when its result is written, and so is the result of
    the stage before.
    """
    folder = sf_dir.rstrip("/")

    def upto(k: int) -> DataFrame:
        if k < 0:
            return prepare(spark).read.parquet(f"{folder}/documents.parquet")
        name, stage = STAGES[k]
        return settled(spark, lambda: stage(spark, upto(k - 1), folder), f"stage-{name}")

    return upto(len(STAGES) - 1)
