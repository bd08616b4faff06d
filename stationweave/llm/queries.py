"""Queries of the training-data operators, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
import pyspark.sql.functions as F
from pyspark.sql import DataFrame, SparkSession

from stationweave.llm import (decontamination, embedding_dedup, hilbert_shards, line_templates, minhash_dedup, mixing,
                              packing, prefix_trie, quality, token_files, toxicity, warc, whitening)
from stationweave.llm._common import prepare

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _query(function: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[function.__name__] = function
    return function


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


@_query
def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Rows are judged by their own text, also those that repeat an id or have none.
    key = F.concat_ws(":", F.col("doc_id").cast("string"), F.xxhash64("text").cast("string"))
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", key.alias("_key"))
    found = decontamination.contamination(docs, _table(spark, sf_dir, "benchmark"), id_column="_key", short_items=True)
    return docs.select("doc_id", "_key").join(found, "_key", "left").select(
        "doc_id", F.coalesce("items", F.lit(0)).alias("items"), F.coalesce("coverage", F.lit(0.0)).alias("coverage"),
        F.col("items").isNotNull().alias("contaminated"), F.col("items").isNull().alias("kept"))


@_query
def op2_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_dedup.near_duplicates(_table(spark, sf_dir, "documents"), shingle_words=3, percent=85)


@_query
def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokens = token_files.token_table(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"),
                                     end_id=1, word_memo=True)
    return tokens.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


@_query
def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    scored = toxicity.score(docs.select("doc_id", "text"), toxicity.train(docs, labels))
    return scored.select("doc_id", "severity", (F.col("severity") >= toxicity.TOXIC_FROM).alias("toxic"),
                         (F.col("severity") < toxicity.TOXIC_FROM).alias("kept"))


@_query
def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.taken_words(_table(spark, sf_dir, "documents")).select(
        "doc_id", "source", "size", "source_size", "target", "copies", "taken")


@_query
def op5_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_vectors(_table(spark, sf_dir, "embeddings"), threshold=0.93)


def _without_templates(spark: SparkSession, sf_dir: str, least_tokens: int) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", F.col("text").alias("before"))
    cleaned = line_templates.drop_recurring(docs, dropped="n_dropped", least_tokens=least_tokens)
    n_lines = F.when(F.col("before").isNull(), 0).otherwise(F.size(F.split("before", "\n"))).cast("long")
    return cleaned.select("doc_id", n_lines.alias("n_lines"), "n_dropped", F.md5(F.encode("text", "UTF-8")).alias("text_md5"))


@_query
def op6_line_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _without_templates(spark, sf_dir, line_templates.LEAST_TOKENS)


@_query
def op6_line_templates_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of any length, also those that ``op6_line_templates`` never looks at."""
    return _without_templates(spark, sf_dir, 1)


ORACLES["op6_line_templates"] = line_templates.SQL
ORACLES["op6_line_templates_all"] = line_templates.ALL_SQL


@_query
def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_table(_table(spark, sf_dir, "pages")).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@_query
def op9_hilbert_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hilbert_shards.document_shards(_table(spark, sf_dir, "documents"), shards=16).withColumns(
        {"law": F.lit("rows"), "grown_shard": F.lit(None).cast("int")})


@_query
def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _table(spark, sf_dir, "documents").select("doc_id", "text"), _table(spark, sf_dir, "labels")
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    model = quality.train(docs, labels.where(~held_out))
    return quality.score(docs, model).select(
        "doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


@_query
def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(_table(spark, sf_dir, "embeddings"))


@_query
def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    rebuilt = prefix_trie.rebuilt(_table(spark, sf_dir, "conversations"))
    return prefix_trie.nodes(rebuilt)


ORACLES["op12_prefix_trie"] = prefix_trie.SQL


@_query
def op13_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = packing.pack(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), end_id=1, cut="spaces")
    return packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
