"""A collection in hash shards: each shard is a collection of its own.

A batch is routed by the hash of the ids and becomes one commit in each shard that
it touches; receipts say which.  A search asks all shards in one job: each gives
its k best, and of those the k best are taken.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vecspark.functions.filters import Filter, MatchAll
from vecspark.functions.vectors import shard_of
from vecspark.model import CollectionConfig, ConfigMismatch, InvalidArgument, VectorError
from vecspark.operators import search
from vecspark.sources.files import Files
from vecspark.sources.store import Collection, Request, points_frame

RECEIPT = "shard int, sequence long, affected_points long"


class ShardedCollection:
    def __init__(self, spark: SparkSession, path: str, shards: list[Collection]):
        self.spark, self.path, self.shards = spark, path, shards

    @classmethod
    def open(cls, spark: SparkSession, path: str, config: CollectionConfig | None = None, shards: int | None = None, **options) -> ShardedCollection:
        files, name = Files(spark), f"{path.rstrip('/')}/shards.json"
        if not files.exists(name):
            if config is None or shards is None:
                raise VectorError(f"no sharded collection at {path}")
            if shards < 1:
                raise InvalidArgument("there is at least one shard")
            files.make(path)
            files.create(name, json.dumps({"shards": shards}))
        found = json.loads(files.read(name))["shards"]
        if shards is not None and shards != found:
            raise ConfigMismatch(f"the collection has {found} shards, not {shards}")
        return cls(spark, path, [Collection.open(spark, f"{path.rstrip('/')}/shard={k}", config, **options) for k in range(found)])

    def close(self) -> None:
        for shard in self.shards:
            shard.close()

    def _dealt(self, rows: DataFrame) -> list[tuple[int, int, DataFrame]]:
        """(shard, distinct ids, rows) of each shard that rows touch."""
        dealt = rows.withColumn("_shard", shard_of(F.col("id"), len(self.shards)))
        touched = dealt.groupBy("_shard").agg(F.countDistinct("id").alias("n")).orderBy("_shard").collect()  # a row a shard
        return [(r["_shard"], r["n"], dealt.where(F.col("_shard") == r["_shard"]).drop("_shard")) for r in touched]

    def _receipts(self, rows: list[tuple[int, int, int]]) -> DataFrame:
        return self.spark.createDataFrame(rows, RECEIPT)

    def upsert(self, points: DataFrame | Iterable[dict], request: Request | None = None) -> DataFrame:
        """shard, sequence and affected_points of each shard that the batch touches."""
        rows = points if isinstance(points, DataFrame) else points_frame(self.spark, points)
        return self._receipts([(k, self.shards[k].upsert(part, request), n) for k, n, part in self._dealt(rows)])

    def delete(self, ids: Sequence[str] | DataFrame, request: Request | None = None) -> DataFrame:
        rows = ids if isinstance(ids, DataFrame) else self.spark.createDataFrame([(i,) for i in ids], "id string")
        return self._receipts([(k, self.shards[k].delete(part, request), n) for k, n, part in self._dealt(rows)])

    def flush(self, full: bool = False) -> DataFrame:
        """shard and sequence up to which each shard is flushed."""
        return self.spark.createDataFrame([(k, s.flush(full)) for k, s in enumerate(self.shards)], "shard int, sequence long")

    def points(self) -> DataFrame:
        parts = [s.points().withColumn("shard", F.lit(k)) for k, s in enumerate(self.shards)]
        out = parts[0]
        for part in parts[1:]:
            out = out.unionByName(part)
        return out

    def get(self, id_: str) -> DataFrame:
        """The point of an id, from its shard alone."""
        k = self.spark.range(1).select(shard_of(F.lit(id_), len(self.shards))).first()[0]
        return self.shards[k].get(id_)

    def search(self, query: Sequence[float], k: int, where: Filter = MatchAll()) -> DataFrame:
        """id, score, metadata and sequence of the k best of all shards."""
        parts = [s.search(query, k, where) for s in self.shards]
        out = parts[0]
        for part in parts[1:]:
            out = out.unionByName(part)
        return search.top(out, k)
