"""Registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from eigenforge.llm import bpe_trie, chat, embedding_dedup, language, line_dedup, merkle, mixing, ngram_join, periodic, quality, token_store, toxicity, warc

TOKENIZER = "word_bpe_49k.json"


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_store.token_digests(spark, _read(spark, sf_dir, "documents"), tokenizer_path())


def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(spark, _read(spark, sf_dir, "documents")).drop("row_hash")


def op3_bpe_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_trie.encode_digests(spark, _read(spark, sf_dir, "documents"), tokenizer_path())


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.digests(spark, _read(spark, sf_dir, "documents"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.verdicts(_read(spark, sf_dir, "documents"))


def op6_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(spark, _read(spark, sf_dir, "embeddings"))


def op7_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.similar_components(spark, _read(spark, sf_dir, "documents"), width=4, percent=85)


def op8_chat_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.digests(spark, _read(spark, sf_dir, "conversations"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    return toxicity.score(spark, docs, toxicity.fit(spark, docs, _read(spark, sf_dir, "labels")))


def op10_warc_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.digests(spark, _read(spark, sf_dir, "pages"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic.digests(_read(spark, sf_dir, "documents"))


def op12_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    return language.predict(spark, docs, language.fit(spark, docs))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.digests(spark, _read(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_token_store": op1_token_store,
        "op2_mix_sources": op2_mix_sources,
        "op3_bpe_trie": op3_bpe_trie,
        "op4_line_dedup": op4_line_dedup,
        "op5_quality_rules": op5_quality_rules,
        "op6_embedding_near_dedup": op6_embedding_near_dedup,
        "op7_ngram_jaccard": op7_ngram_jaccard,
        "op8_chat_repair": op8_chat_repair,
        "op9_toxicity": op9_toxicity,
        "op10_warc_index": op10_warc_index,
        "op11_periodic_runs": op11_periodic_runs,
        "op12_language_id": op12_language_id,
        "op13_merkle_manifest": op13_merkle_manifest,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op4_line_dedup": line_dedup.ORACLE,
        "op5_quality_rules": quality.ORACLE,
        "op6_embedding_near_dedup": embedding_dedup.ORACLE,
        "op7_ngram_jaccard": ngram_join.ORACLE,
        "op10_warc_index": warc.ORACLE,
        "op13_merkle_manifest": merkle.ORACLE,
    }
