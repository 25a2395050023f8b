"""Hash shards: routing, receipts, and top-k in two steps."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vecspark.functions.vectors import shard_of
from vecspark.model import InvalidArgument


def with_shard(points: DataFrame, shards: int) -> DataFrame:
    if shards < 1:
        raise InvalidArgument("there is at least one shard")
    return points.withColumn("shard", shard_of(F.col("id"), shards))


def shard_commits(log: DataFrame, shards: int) -> DataFrame:
    """Receipts: for each batch and shard how many distinct ids it touches."""
    return with_shard(log, shards).groupBy("sequence", "shard").agg(F.countDistinct("id").alias("affected_points"))


def min_applied(shard_state: DataFrame) -> DataFrame:
    """The least applied index over shards; null if a shard reports none."""
    return shard_state.agg(F.when(F.count("applied_index") == F.count("*"), F.min("applied_index")).alias("applied_index"))


def topk_by_shard(hits: DataFrame, k: int) -> DataFrame:
    """The k best of each shard, and of those the k best."""
    w = Window.partitionBy("shard").orderBy(F.desc("score"), F.asc("id"))
    return hits.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= k).drop("_n").orderBy(F.desc("score"), F.asc("id")).limit(k)
