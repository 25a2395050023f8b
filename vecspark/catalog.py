"""Named collections under one folder, with backups."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from vecspark.model import AlreadyExists, CollectionConfig, InvalidArgument, Metric, NotFound
from vecspark.sources.files import Files
from vecspark.sources.store import Collection

NAME = re.compile(r"[A-Za-z0-9_-]{1,64}")
SUMMARY = "name string, dimension int, metric string, points long, latest_sequence long, pending long"


def checked(name: str) -> str:
    if not isinstance(name, str) or not NAME.fullmatch(name):
        raise InvalidArgument("a name has 1 to 64 letters, digits, - or _")
    return name


class Catalog:
    """Collections are found when the catalog is opened and when they are asked for."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self.files = spark, path.rstrip("/"), Files(spark)
        self.files.make(self.path)
        self.opened: dict[str, Collection] = {}

    def _at(self, name: str) -> str:
        return f"{self.path}/{checked(name)}"

    def names(self) -> list[str]:
        return [n for n in self.files.names(self.path) if NAME.fullmatch(n) and self.files.exists(f"{self.path}/{n}/collection.json")]

    def create(self, name: str, dimension: int, metric: Metric | str) -> Collection:
        if self.files.exists(f"{self._at(name)}/collection.json"):
            raise AlreadyExists(f"there is a collection {name}")
        self.opened[name] = Collection.open(self.spark, self._at(name), CollectionConfig(dimension, Metric(metric)))
        return self.opened[name]

    def get(self, name: str) -> Collection:
        if name not in self.opened:
            if not self.files.exists(f"{self._at(name)}/collection.json"):
                raise NotFound(f"there is no collection {name}")
            self.opened[name] = Collection.open(self.spark, self._at(name))
        return self.opened[name]

    def summaries(self) -> DataFrame:
        """name, dimension, metric, points, latest_sequence and pending of each collection, by name."""
        rows = []
        for name in self.names():
            c = self.get(name)
            rows.append((name, c.config.dimension, c.config.metric.value, c.count(), c.sequence, c.pending()))
        return self.spark.createDataFrame(rows, SUMMARY).orderBy("name")

    def backup(self, name: str, backup: str) -> None:
        target = f"{self.path}/.backups/{checked(backup)}"
        if self.files.exists(target):
            raise AlreadyExists(f"there is a backup {backup}")
        self.files.make(f"{self.path}/.backups")
        self.get(name).backup(target)

    def backups(self) -> list[str]:
        return self.files.names(f"{self.path}/.backups")

    def restore(self, backup: str, name: str) -> Collection:
        source = f"{self.path}/.backups/{checked(backup)}"
        if not self.files.exists(source):
            raise NotFound(f"there is no backup {backup}")
        if self.files.exists(self._at(name)):
            raise AlreadyExists(f"there is a collection {name}")
        beside = f"{self.path}/.restore-{name}"
        self.files.delete(beside)
        try:
            self.files.copy(source, beside)
            self.files.rename(beside, self._at(name))
        except Exception:
            self.files.delete(beside)
            raise
        return self.get(name)
