"""Requests as dictionaries, answered from a catalog: the service without a socket."""

from __future__ import annotations

import hmac
import threading
import time

from vecspark.catalog import Catalog
from vecspark.functions.filters import MatchAll, parse_filter
from vecspark.model import PAYLOAD, InvalidArgument, NotFound, ResourceExhausted, Unauthorized, VectorError

VERSION = 1
MAX_K = 1000
MAX_EF = 4096
MAX_BATCH = 1000
MAX_CONCURRENT = 64
COUNTERS = ("requests", "errors", "queries", "query_seconds", "upserted_points", "deleted_points", "flushes", "backups", "restores")


def plain(metadata: dict | None) -> dict:
    """Metadata values as plain scalars."""
    return {k: v[PAYLOAD[v["kind"]]] for k, v in (metadata or {}).items()}


class Service:
    def __init__(self, catalog: Catalog, token: str | None = None, concurrent: int = MAX_CONCURRENT):
        self.catalog, self.token = catalog, token
        self.admitted = threading.Semaphore(concurrent)
        self.counters = dict.fromkeys(COUNTERS, 0)

    def dispatch(self, request: dict, token: str | None = None) -> dict:
        """The answer to a request (op and its fields): status, and body or error."""
        self.counters["requests"] += 1
        try:
            if not isinstance(request, dict):
                raise InvalidArgument("a request is an object")
            op = request.get("op")
            if op not in ("healthz", "readyz") and self.token is not None and not hmac.compare_digest((token or "").encode(), self.token.encode()):
                raise Unauthorized("no valid token")
            handler = getattr(self, f"_{op}", None) if isinstance(op, str) and op in OPS else None
            if handler is None:
                raise NotFound(f"no such request: {op!r}")
            if not self.admitted.acquire(blocking=False):
                raise ResourceExhausted("too many requests at a time")
            try:
                status, body = handler(request)
            finally:
                self.admitted.release()
            return {"version": VERSION, "status": status, "body": body}
        except VectorError as e:
            self.counters["errors"] += 1
            return {"version": VERSION, "status": e.code, "error": {"kind": type(e).__name__, "message": str(e)}}
        except (KeyError, TypeError, ValueError) as e:
            self.counters["errors"] += 1
            return {"version": VERSION, "status": 400, "error": {"kind": "InvalidArgument", "message": str(e)}}

    def _healthz(self, _):
        return 200, {"status": "ok"}

    def _readyz(self, _):
        return 200, {"collections": len(self.catalog.names())}

    def _hello(self, request):
        if request.get("version", VERSION) != VERSION:
            raise InvalidArgument(f"the version is {VERSION}")
        return 200, {"version": VERSION}

    def _metrics(self, _):
        return 200, "".join(f"# TYPE vector_{k}_total counter\nvector_{k}_total {v}\n" for k, v in self.counters.items())

    def _list_collections(self, _):
        return 200, [r.asDict() for r in self.catalog.summaries().collect()]

    def _create_collection(self, r):
        self.catalog.create(r["collection"], r["dimension"], r["metric"])
        return 201, {"collection": r["collection"]}

    @staticmethod
    def _request_of(r: dict) -> tuple[str, object] | None:
        """(client, request) of a change that is to take effect once."""
        given = r.get("request")
        if given is not None and (not isinstance(given, (list, tuple)) or len(given) != 2):
            raise InvalidArgument("a request is a client's name and a number")
        return None if given is None else tuple(given)

    def _upsert(self, r):
        if not 0 < len(r["points"]) <= MAX_BATCH:
            raise ResourceExhausted(f"a batch has 1 to {MAX_BATCH} points")
        number = self.catalog.get(r["collection"]).upsert(r["points"], self._request_of(r))
        self.counters["upserted_points"] += len(r["points"])
        return 200, {"sequence": number}

    def _delete(self, r):
        if len(r["ids"]) > MAX_BATCH:
            raise ResourceExhausted(f"a batch has at most {MAX_BATCH} ids")
        number = self.catalog.get(r["collection"]).delete(r["ids"], self._request_of(r))
        self.counters["deleted_points"] += len(r["ids"])
        return 200, {"sequence": number}

    def _query(self, r):
        k, ef = r["k"], r.get("ef_search")
        if k > MAX_K or (ef or 0) > MAX_EF:
            raise ResourceExhausted(f"k is at most {MAX_K} and ef_search {MAX_EF}")
        where = parse_filter(r["filter"]) if r.get("filter") is not None else MatchAll()
        began = time.monotonic()
        rows = self.catalog.get(r["collection"]).search(r["vector"], k, where, ef).collect()
        self.counters["queries"] += 1
        self.counters["query_seconds"] += time.monotonic() - began
        return 200, {"hits": [{"id": h["id"], "score": h["score"], "metadata": plain(h["metadata"]), "sequence": h["sequence"]} for h in rows]}

    def _flush(self, r):
        self.counters["flushes"] += 1
        return 200, {"sequence": self.catalog.get(r["collection"]).flush()}

    def _backup(self, r):
        self.catalog.backup(r["collection"], r["backup"])
        self.counters["backups"] += 1
        return 201, {"backup": r["backup"]}

    def _list_backups(self, _):
        return 200, self.catalog.backups()

    def _restore(self, r):
        self.catalog.restore(r["backup"], r["collection"])
        self.counters["restores"] += 1
        return 201, {"collection": r["collection"]}


OPS = ("healthz", "readyz", "hello", "metrics", "list_collections", "create_collection", "upsert", "delete", "query", "flush", "backup", "list_backups", "restore")
