"""A client of the service: methods instead of dictionaries, errors instead of statuses."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from typing import Any

from vecspark import model
from vecspark.service import VERSION, Service


class Client:
    def __init__(self, service: Service, token: str | None = None):
        self.service, self.token = service, token
        self._ask("hello", version=VERSION)

    def _ask(self, op: str, **fields: Any) -> Any:
        answer = self.service.dispatch({"op": op, **{k: v for k, v in fields.items() if v is not None}}, self.token)
        if "error" not in answer:
            return answer["body"]
        kind = getattr(model, answer["error"]["kind"], None)
        known = isinstance(kind, type) and issubclass(kind, model.VectorError)
        raise (kind if known else model.VectorError)(answer["error"]["message"])

    def collections(self) -> list[dict]:
        return self._ask("list_collections")

    def create(self, collection: str, dimension: int, metric: str) -> None:
        self._ask("create_collection", collection=collection, dimension=dimension, metric=metric)

    def upsert(self, collection: str, points: Iterable[dict], request: tuple[str, object] | None = None) -> int:
        return self._ask("upsert", collection=collection, points=list(points), request=request)["sequence"]

    def delete(self, collection: str, ids: Sequence[str], request: tuple[str, object] | None = None) -> int:
        return self._ask("delete", collection=collection, ids=list(ids), request=request)["sequence"]

    def query(self, collection: str, vector: Sequence[float], k: int, filter: dict | None = None, ef_search: int | None = None) -> list[dict]:
        return self._ask("query", collection=collection, vector=list(vector), k=k, filter=filter, ef_search=ef_search)["hits"]

    def flush(self, collection: str) -> int:
        return self._ask("flush", collection=collection)["sequence"]

    def backup(self, collection: str, backup: str) -> None:
        self._ask("backup", collection=collection, backup=backup)

    def backups(self) -> list[str]:
        return self._ask("list_backups")

    def restore(self, backup: str, collection: str) -> None:
        self._ask("restore", backup=backup, collection=collection)
