"""A corpus pipeline of five stages over the table documents.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept,
and returns a DataFrame; ``run`` writes each as Parquet to the folder that the
cluster shares and reads it back for the next.  The stages bound the rows of the
session's Arrow batches to ``BATCH_ROWS``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from vecspark.llm import bpe, decontaminate, langid, near_dedup, toxicity
from vecspark.llm.shared import bound_batches, discard, temporary, written

#: Whole documents go through Python, so batches have fewer rows than Spark's 10,000.
BATCH_ROWS = 2000


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity is under the threshold."""
    bound_batches(spark, BATCH_ROWS)
    # learned from all labelled documents of the table, whatever is left of it here
    model = toxicity.train(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.keep_clean(docs, model)


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is known for sure and not against their text."""
    bound_batches(spark, BATCH_ROWS)
    return langid.keep_identified(docs)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each group of near copies."""
    bound_batches(spark, BATCH_ROWS)
    return near_dedup.keep_one(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window of a benchmark item."""
    bound_batches(spark, BATCH_ROWS)
    return decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' token counts and digests of their ids and decoded texts."""
    bound_batches(spark, BATCH_ROWS)
    return bpe.encode_decode(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("toxicity", toxicity_stage),
    ("language_id", language_stage),
    ("near_dedup", near_dedup_stage),
    ("decontamination", decontamination_stage),
    ("bpe", bpe_stage),
]

#: Stages that learn a model can't be put in SQL; a test holds the rows against a
#: brute-force version of all five stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    *before, (_, last) = STAGES
    for k, (name, stage) in enumerate(before):
        with temporary() as keep:  # what a stage writes besides goes once its rows are there
            found = keep(written(stage(spark, docs, sf_dir), f"stage-{name}"))
        if k:
            discard(docs)
        docs = found
    return last(spark, docs, sf_dir)
