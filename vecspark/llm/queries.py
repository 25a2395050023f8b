"""Queries of the training-data operators, by name, and their SQL where there is any."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from vecspark.llm import bpe, decontaminate, langid, matroska, ppm, simhash, token_count, token_store, toxicity, url_filter


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_count.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicate_classes(table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.hex_digits("fingerprint").alias("fingerprint"), "component_id")


RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages"), RULES)


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fuses all sources: the pages' text, <html lang=...>, address suffix and host.
    (The pipeline's stage has the table documents, which has no addresses.)"""
    return langid.identify_pages(table(spark, sf_dir, "pages"))


def op5_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = token_store.write_token_store(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return token_store.read_token_store(spark, path)


def op6_matroska(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matroska.media_features(matroska.media_column(table(spark, sf_dir, "documents")))


def op7_ppm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ppm.score(table(spark, sf_dir, "documents"))


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_decode(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    return toxicity.toxicity(documents, toxicity.train(documents, table(spark, sf_dir, "labels")))


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_token_counts, op2_simhash, op3_url_filter, op4_language_id, op5_token_store, op6_matroska, op7_ppm, op8_bpe, op9_toxicity, op10_decontaminate)}


def oracle_sql() -> dict[str, str]:
    return {"op3_url_filter": url_filter.sql(RULES), "op10_decontaminate": decontaminate.sql()}
