"""Registered queries of the operators that SQL cannot express; tests hold them against brute force."""

from __future__ import annotations

import importlib

from pyspark.sql import DataFrame, SparkSession

from judgealign.llm import bpe, embedding_dedup, language_codes, minhash, mix_cube, periodic_runs, quality_pu, suffix_dedup, whitening


def documents(spark: SparkSession, sf: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/documents.parquet")


def tokenizer_path() -> str:
    """The vocabulary file of the registered query; operators take any path."""
    return importlib.import_module("public_tokenizers").path("word_bpe_49k.json")


def op1_suffix_dedup(spark: SparkSession, sf: str) -> DataFrame:
    docs = documents(spark, sf).select("doc_id", "text")
    return suffix_dedup.kept_digests(docs, suffix_dedup.repeated_spans(docs, keep="none"))


def op3_embedding_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return embedding_dedup.near_vectors(spark.read.parquet(f"{sf}/embeddings.parquet"))


def op4_bpe(spark: SparkSession, sf: str) -> DataFrame:
    return bpe.encode_documents(documents(spark, sf), tokenizer_path(), keep_ids=False)


def op6_quality_pu(spark: SparkSession, sf: str) -> DataFrame:
    docs = documents(spark, sf).select("doc_id", "text")
    return quality_pu.score_documents(docs, quality_pu.train(docs, spark.read.parquet(f"{sf}/labels.parquet")))


def op7_mix_cube(spark: SparkSession, sf: str) -> DataFrame:
    return mix_cube.taken(mix_cube.mix_sources(documents(spark, sf).select("doc_id", "text", "source")))


def op9_minhash(spark: SparkSession, sf: str) -> DataFrame:
    found = minhash.near_duplicates(documents(spark, sf).select("doc_id", "text"), size=4)
    return found.select("doc_id", "n_shingles", "component_id", "kept")


def op11_language(spark: SparkSession, sf: str) -> DataFrame:
    docs = documents(spark, sf)
    return language_codes.predict(docs.select("doc_id", "text"), language_codes.train(docs.select("doc_id", "text", "lang")))


def op12_periodic_runs(spark: SparkSession, sf: str) -> DataFrame:
    docs = periodic_runs.planted(documents(spark, sf).select("doc_id", "text"))
    return periodic_runs.digests(periodic_runs.periodic_runs(docs, keep_text=False))


def op13_whitening(spark: SparkSession, sf: str) -> DataFrame:
    return whitening.whiten(spark.read.parquet(f"{sf}/embeddings.parquet"))


QUERIES = {
    "op1_suffix_dedup": op1_suffix_dedup,
    "op3_embedding_dedup": op3_embedding_dedup,
    "op4_bpe": op4_bpe,
    "op6_quality_pu": op6_quality_pu,
    "op7_mix_cube": op7_mix_cube,
    "op9_minhash": op9_minhash,
    "op11_language": op11_language,
    "op12_periodic_runs": op12_periodic_runs,
    "op13_whitening": op13_whitening,
}
ORACLES: dict[str, str] = {}
