"""A durable collection: immutable segments, manifests, and a log of commits.

A commit is a file ``log/N.json`` that is created if there is none of that number;
it names the folder with the batch's rows, which is written before.  ``segments/NAME``
holds a full or delta snapshot with the vectors' codes; ``manifest.json`` names the
segments in order, a full one first, with sizes and check sums of their files, and
the sequence up to which they go; ``manifests`` keeps the earlier ones.  A flush
writes the segment, then replaces the manifest, so a stop between any two steps
loses nothing.  What no kept manifest needs is removed after ``retain`` seconds, so
readers and reads of the past have that long.

One handle writes: the first change takes ``writer.json``, and others are refused
until ``close`` or until one opens with ``take_over``.  A handle that lost its
place commits nothing more.

Reads take the full segment without the ids changed since (their number is known,
so they are broadcast if they are few), and the newest rows of those; the vectors
of the full segment are never dealt out.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable, Iterable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vecspark.functions import vectors as V
from vecspark.functions.filters import Filter, MatchAll, compile_filter
from vecspark.model import (
    METADATA,
    MUTATION,
    SEGMENT,
    VECTOR,
    CollectionConfig,
    ConfigMismatch,
    CorruptData,
    InvalidDimension,
    InvalidId,
    InvalidMetadata,
    InvalidVector,
    Metric,
    SequenceGap,
    VectorError,
    WriterBusy,
    metadata_row,
)
from vecspark.operators import search, versions
from vecspark.plans import planner
from vecspark.sources.files import Files

#: Segments after which a flush writes a full one instead of a further delta.
COMPACT_AT = 8
#: Changed rows, and bytes of their ids, that are broadcast at most.
BROADCAST_ROWS, BROADCAST_BYTES = 1_000_000, 32 << 20
#: Seconds that replaced segments, manifests and commits stay.
RETAIN = 3600.0
#: Bytes of a segment's file at most, roughly.
FILE_BYTES = 512 << 20
REJECTED = {e.__name__: e for e in (InvalidDimension, InvalidId, InvalidMetadata, InvalidVector)}

Request = tuple[str, object]


def points_frame(spark: SparkSession, points: Iterable[dict]) -> DataFrame:
    """A batch of points given as dictionaries with id, vector and metadata, in their order."""
    rows = [(n, p["id"], [float(x) for x in p["vector"]], metadata_row(p.get("metadata"))) for n, p in enumerate(points)]
    return spark.createDataFrame([(i, v, m, n) for n, i, v, m in rows], "id string, vector array<float>, metadata " + METADATA.simpleString() + ", ordinal int")


class Collection:
    """A collection under a folder; ``open`` creates or opens it."""

    def __init__(self, spark: SparkSession, path: str, config: CollectionConfig, retain: float = RETAIN, take_over: bool = False):
        self.spark, self.path, self.config, self.files, self.retain = spark, path.rstrip("/"), config, Files(spark), retain
        self.owner, self.writing, self.take_over = uuid.uuid4().hex, False, take_over
        self.sequence = self._recover()

    @classmethod
    def open(cls, spark: SparkSession, path: str, config: CollectionConfig | None = None, **options) -> Collection:
        files, name = Files(spark), f"{path.rstrip('/')}/collection.json"
        if not files.exists(name):
            if config is None:
                raise VectorError(f"no collection at {path}")
            files.make(path)
            files.create(name, json.dumps({"dimension": config.dimension, "metric": config.metric.value}))
        held = json.loads(files.read(name))
        found = CollectionConfig(held["dimension"], Metric(held["metric"]))
        if config is not None and config != found:
            raise ConfigMismatch(f"the collection is {found}, not {config}")
        return cls(spark, path, found, **options)

    def close(self) -> None:
        """Lets another handle write."""
        if self.writing and self._holder() == self.owner:
            self.files.delete(f"{self.path}/writer.json")
        self.writing = False

    def __enter__(self) -> Collection:
        return self

    def __exit__(self, *_) -> None:
        self.close()

    # What is there.

    def manifest(self) -> dict:
        name = f"{self.path}/manifest.json"
        return json.loads(self.files.read(name)) if self.files.exists(name) else {"sequence": 0, "segments": [], "streams": {}}

    def _numbers(self) -> list[int]:
        return sorted(int(n[:-5]) for n in self.files.names(f"{self.path}/log") if n.endswith(".json") and n[:-5].isdigit())

    def _commit_of(self, number: int) -> dict | None:
        """The record of a commit; None if its writer stopped half-way."""
        try:
            return json.loads(self.files.read(f"{self.path}/log/{number}.json"))
        except ValueError:
            return None

    def commits(self, after: int = 0, until: int | None = None) -> list[dict]:
        """The records of the commits after a sequence, in order."""
        numbers = [n for n in self._numbers() if n > after and (until is None or n <= until)]
        found = [self._commit_of(n) for n in numbers]
        if found and found[-1] is None:
            found.pop()
        if None in found:
            raise CorruptData(f"commit {numbers[found.index(None)]} can't be read")
        for n, c in enumerate(found, after + 1):
            if c["sequence"] != n:
                raise SequenceGap(f"the log goes from {n - 1} to {c['sequence']}")
        return found

    def _recover(self) -> int:
        """Checks what the manifest and log say; gives the last sequence."""
        manifest = self.manifest()
        for segment in manifest["segments"]:
            if self.files.sizes(f"{self.path}/segments/{segment['name']}") != segment["files"]:
                raise CorruptData(f"segment {segment['name']} is not as it was written")
        found = self.commits(manifest["sequence"])
        for c in found:
            if self.files.sizes(f"{self.path}/{c['data']}") != c["files"]:
                raise CorruptData(f"the rows of commit {c['sequence']} are not as they were written")
        return found[-1]["sequence"] if found else manifest["sequence"]

    def _sums(self, folder: str) -> dict[str, str]:
        """Check sums of the data files of a folder, made where the files are read."""
        rows = self.spark.read.format("binaryFile").load(folder).select(F.element_at(F.split("path", "/"), -1).alias("name"), F.sha2("content", 256).alias("sum")).collect()
        return {r["name"]: r["sum"] for r in rows}

    def verify(self) -> None:
        """Reads all segments and holds their check sums against the manifest."""
        for segment in self.manifest()["segments"]:
            if self._sums(f"{self.path}/segments/{segment['name']}") != segment["sums"]:
                raise CorruptData(f"segment {segment['name']} is damaged")

    def _read(self, folders: list[str], schema=MUTATION) -> DataFrame:
        if not folders:
            return self.spark.createDataFrame([], schema)
        # a damaged page fails the job that reads it
        return self.spark.read.schema(schema).option("parquet.page.verify-checksum.enabled", "true").parquet(*folders)

    def log(self, after: int = 0, until: int | None = None) -> DataFrame:
        """The rows of the commits after a sequence."""
        return self._read([f"{self.path}/{c['data']}" for c in self.commits(after, until)])

    def segments(self, manifest: dict | None = None) -> DataFrame:
        manifest = manifest or self.manifest()
        return self._read([f"{self.path}/segments/{s['name']}" for s in manifest["segments"]], SEGMENT)

    def _manifest_at(self, as_of: int | None) -> dict:
        now = self.manifest()
        if as_of is None or as_of >= now["sequence"]:
            return now
        kept = [n for n in self.files.names(f"{self.path}/manifests") if n.endswith(".json")]
        for name in sorted(kept, reverse=True):
            if int(name.split("-")[0]) <= as_of:
                found = json.loads(self.files.read(f"{self.path}/manifests/{name}"))
                break
        else:
            found = {"sequence": 0, "segments": [], "streams": {}}
        held = self._numbers()
        if not set(range(found["sequence"] + 1, as_of + 1)) <= set(held):
            raise VectorError(f"what was at {as_of} isn't kept any more")
        return found

    def _parts(self, as_of: int | None = None) -> tuple[DataFrame, DataFrame, bool]:
        """The rows of the full segment, the newest row of each id changed since, and
        whether those ids are few enough to be broadcast."""
        manifest = self._manifest_at(as_of)
        commits = self.commits(manifest["sequence"], as_of)
        base = self._read([f"{self.path}/segments/{s['name']}" for s in manifest["segments"][:1]], SEGMENT)
        changes = [*manifest["segments"][1:], *commits]
        rows = self._read([f"{self.path}/segments/{s['name']}" for s in manifest["segments"][1:]]).unionByName(self._read([f"{self.path}/{c['data']}" for c in commits]))
        few = sum(c["rows"] for c in changes) <= BROADCAST_ROWS and sum(c["id_bytes"] for c in changes) <= BROADCAST_BYTES
        return base, versions.newest(rows), few

    def _unchanged(self, base: DataFrame, changed: DataFrame, few: bool) -> DataFrame:
        ids = changed.select("id")
        return base.join(F.broadcast(ids) if few else ids, "id", "left_anti")

    def points(self, as_of: int | None = None) -> DataFrame:
        """The live points, now or as they were after a sequence that is still kept."""
        base, changed, few = self._parts(as_of)
        columns = ["id", "vector", "metadata", "sequence"]
        return self._unchanged(base.select(*columns), changed, few).unionByName(changed.where("op = 'upsert'").select(*columns))

    def get(self, id_: str) -> DataFrame:
        return self.points().where(F.col("id") == id_)

    def count(self) -> int:
        return self.points().count()

    def pending(self) -> int:
        return self.log(self.manifest()["sequence"]).select("id").distinct().count()

    # Changes.

    def _holder(self) -> str | None:
        name = f"{self.path}/writer.json"
        return json.loads(self.files.read(name))["owner"] if self.files.exists(name) else None

    def _write_begins(self) -> None:
        """Makes this handle the writer, or refuses."""
        name, mine = f"{self.path}/writer.json", json.dumps({"owner": self.owner})
        if self.writing:
            if self._holder() != self.owner:
                raise WriterBusy("another handle writes to the collection now")
            return
        if not self.files.create(name, mine):
            if not self.take_over:
                raise WriterBusy("another handle writes to the collection")
            self.files.write(name, mine)
        self.writing = True
        numbers = self._numbers()
        if numbers and self._commit_of(numbers[-1]) is None:
            self.files.delete(f"{self.path}/log/{numbers[-1]}.json")
        self.sequence = self._recover()
        for c in self.commits(self.manifest()["sequence"]):
            if c.get("request"):
                self._remember(tuple(c["request"]), {"sequence": c["sequence"]})

    def _ledger(self, request: Request) -> str:
        key = hashlib.sha256(json.dumps([str(request[0]), str(request[1])]).encode()).hexdigest()
        return f"{self.path}/requests/{key[:2]}/{key}.json"

    def _remember(self, request: Request, outcome: dict) -> None:
        self.files.create(self._ledger(request), json.dumps(outcome))

    def _once(self, request: Request | None, change: Callable[[], int]) -> int:
        """The outcome of a change; a request that was answered before, also one that
        was rejected, gets the same answer and changes nothing."""
        self._write_begins()
        if request is None:
            return change()
        name = self._ledger(request)
        if self.files.exists(name):
            held = json.loads(self.files.read(name))
            if "error" in held:
                raise REJECTED.get(held["error"], VectorError)(held["message"])
            return held["sequence"]
        try:
            number = change()
        except tuple(REJECTED.values()) as e:
            self._remember(request, {"error": type(e).__name__, "message": str(e)})
            raise
        self._remember(request, {"sequence": number})
        return number

    def _commit(self, rows: DataFrame, about: dict) -> int:
        number = self.sequence + 1
        data = f"data/{uuid.uuid4().hex}"
        rows.withColumn("sequence", F.lit(number).cast("long")).select(*[F.col(f.name).cast(f.dataType) for f in MUTATION.fields]).write.parquet(f"{self.path}/{data}")
        record = {"sequence": number, "data": data, "files": self.files.sizes(f"{self.path}/{data}"), **about}
        self._write_begins()  # still the writer after the rows are there
        if not self.files.create(f"{self.path}/log/{number}.json", json.dumps(record)):
            self.files.delete(f"{self.path}/{data}")
            self.writing = False
            raise WriterBusy(f"commit {number} is another handle's")
        self.sequence = number
        return number

    def apply(self, rows: DataFrame, request: Request | None = None, stream: tuple[str, int] | None = None) -> int:
        """Commits a batch of mutations (id, op, and for upserts vector and metadata)
        as a whole; of rows of one id the last one counts, by the column ordinal if
        there is one.  ``stream`` is a stream's name and its batch's number: a batch
        that was committed before changes nothing."""
        return self._once(request, lambda: self._apply(rows, request, stream))

    def _apply(self, rows: DataFrame, request: Request | None, stream: tuple[str, int] | None) -> int:
        if stream is not None and self.batch_of(stream[0]) >= stream[1]:
            return self.sequence
        if "ordinal" not in rows.columns:
            rows = rows.withColumn("ordinal", F.lit(0))
        if "vector" not in rows.columns:
            rows = rows.withColumn("vector", F.lit(None).cast(VECTOR))
        if "metadata" not in rows.columns:
            rows = rows.withColumn("metadata", F.create_map().cast(METADATA))
        live = F.col("op") == "upsert"
        rows = rows.select("id", F.when(live, F.col("vector").cast(VECTOR)).alias("vector"), F.when(live, F.col("metadata")).alias("metadata"), "op", "ordinal")
        values = F.map_values(F.coalesce("metadata", F.create_map().cast(METADATA)))
        ready = V.normalized(F.col("vector")) if self.config.metric == Metric.COSINE else F.col("vector")
        found = rows.agg(
            F.count_if(F.coalesce(F.length("id"), F.lit(0)) == 0).alias("id"),
            F.count_if(live & (F.coalesce(F.size("vector"), F.lit(-1)) != self.config.dimension)).alias("dimension"),
            F.count_if(live & (~V.is_valid(F.col("vector"), self.config.dimension) | ready.isNull())).alias("vector"),
            F.count_if(F.exists(values, lambda v: (v["kind"] == "float") & ~F.coalesce(V.finite(v["f"]), F.lit(False)))).alias("metadata"),
            F.count("*").alias("rows"),
            F.coalesce(F.sum(F.octet_length("id")), F.lit(0)).alias("id_bytes"),
        ).first()
        for name, error in (("id", InvalidId), ("dimension", InvalidDimension), ("vector", InvalidVector), ("metadata", InvalidMetadata)):
            if found[name]:
                raise error(f"{found[name]} rows of the batch have no valid {name}; none is stored")
        about = {"rows": found["rows"], "id_bytes": found["id_bytes"], "request": list(map(str, request)) if request else None, "stream": list(stream) if stream else None}
        return self._commit(rows.withColumn("vector", F.when(live, ready.cast(VECTOR))), about)

    def upsert(self, points: DataFrame | Iterable[dict], request: Request | None = None) -> int:
        """Commits points; of rows of one id the last one counts."""

        def change() -> int:
            rows = points if isinstance(points, DataFrame) else points_frame(self.spark, points)
            return self._apply(rows.withColumn("op", F.lit("upsert")), request, None)

        return self._once(request, change)

    def delete(self, ids: Sequence[str] | DataFrame, request: Request | None = None) -> int:
        """Commits tombstones; ids that aren't there are no error."""

        def change() -> int:
            rows = ids
            if not isinstance(rows, DataFrame):
                if not rows or not all(rows):
                    raise InvalidId("ids to delete are given and not empty")
                rows = self.spark.createDataFrame([(i,) for i in rows], "id string")
            return self._apply(rows.select("id").distinct().withColumn("op", F.lit("delete")), request, None)

        return self._once(request, change)

    def batch_of(self, stream: str) -> int:
        """The last batch of a stream that is committed; -1 for none."""
        manifest = self.manifest()
        own = [c["stream"][1] for c in self.commits(manifest["sequence"]) if c.get("stream") and c["stream"][0] == stream]
        return max([manifest.get("streams", {}).get(stream, -1), *own])

    def flush(self, full: bool = False) -> int:
        """Writes what changed since the last flush as a segment, a full one on
        the first flush, after ``COMPACT_AT`` segments or if asked for."""
        self._write_begins()
        manifest, number = self.manifest(), self.sequence
        if number == manifest["sequence"] and not full:
            return number
        full = full or not manifest["segments"] or len(manifest["segments"]) >= COMPACT_AT
        if full:
            base, changed, few = self._parts()
            columns = [f.name for f in MUTATION.fields]
            rows = self._unchanged(base.select(*columns), changed, few).unionByName(changed.where("op = 'upsert'").select(*columns))
        else:
            rows = versions.newest(self.log(manifest["sequence"]))
        name = f"{'full' if full else 'delta'}-{number:020d}-{uuid.uuid4().hex[:8]}"
        search.with_codes(rows, keep=True).write.option("maxRecordsPerFile", max(10_000, FILE_BYTES // (5 * self.config.dimension + 200))).parquet(f"{self.path}/segments/{name}")
        return self.publish(manifest, name, number, full)

    def publish(self, manifest: dict, name: str, number: int, full: bool) -> int:
        """Makes a written segment part of the collection, unless the manifest has moved on."""
        held, folder = self.manifest(), f"{self.path}/segments/{name}"
        if held["sequence"] > manifest["sequence"] or held["segments"] != manifest["segments"]:
            self.files.delete(folder)
            return held["sequence"]
        size = self._read([folder], SEGMENT).agg(F.count("*").alias("rows"), F.coalesce(F.sum(F.octet_length("id")), F.lit(0)).alias("id_bytes")).first()
        entry = {"name": name, "sequence": number, "rows": size["rows"], "id_bytes": size["id_bytes"], "files": self.files.sizes(folder), "sums": self._sums(folder)}
        streams = dict(manifest.get("streams", {}))
        for c in self.commits(manifest["sequence"], number):
            if c.get("stream"):
                streams[c["stream"][0]] = max(c["stream"][1], streams.get(c["stream"][0], -1))
        new = json.dumps({"sequence": number, "segments": [entry] if full else [*manifest["segments"], entry], "streams": streams})
        self._write_begins()
        self.files.create(f"{self.path}/manifests/{number:020d}-{uuid.uuid4().hex[:8]}.json", new)
        self.files.write(f"{self.path}/manifest.json", new)
        self.clean(self.retain)
        return number

    def clean(self, older_than: float = 0.0) -> None:
        """Removes what the manifest of now doesn't need and is older than so many
        seconds: earlier manifests, then segments, commits and rows that no kept
        manifest needs."""
        now = self.manifest()
        old = lambda path: self.files.age(path) >= older_than
        kept = [now]
        for name in self.files.names(f"{self.path}/manifests"):
            path = f"{self.path}/manifests/{name}"
            if name.endswith(".json"):
                held = json.loads(self.files.read(path))
                if old(path) and held != now:
                    self.files.delete(path)
                else:
                    kept.append(held)
        named = {s["name"] for m in kept for s in m["segments"]}
        for name in self.files.names(f"{self.path}/segments"):
            if name not in named and old(f"{self.path}/segments/{name}"):
                self.files.delete(f"{self.path}/segments/{name}")
        first = min(m["sequence"] for m in kept)
        for n in self._numbers():
            path = f"{self.path}/log/{n}.json"
            if n <= first and old(path):
                held = self._commit_of(n)
                self.files.delete(path)
                if held:
                    self.files.delete(f"{self.path}/{held['data']}")

    def compact(self) -> int:
        return self.flush(full=True)

    def backup(self, path: str) -> None:
        """Copies what the manifest names to a folder that isn't there yet."""
        if self.files.exists(path):
            raise VectorError(f"{path} is there already")
        self.flush()
        beside = f"{path}.{uuid.uuid4().hex}.tmp"
        self.files.make(f"{beside}/segments")
        for s in self.manifest()["segments"]:
            self.files.copy(f"{self.path}/segments/{s['name']}", f"{beside}/segments/{s['name']}")
        for name in ("collection.json", "manifest.json"):
            if self.files.exists(f"{self.path}/{name}"):
                self.files.copy(f"{self.path}/{name}", f"{beside}/{name}")
        self.files.rename(beside, path)

    # Questions.

    def _scored(self, query: Sequence[float], where: Filter, as_of: int | None = None) -> DataFrame:
        """id, score, metadata and sequence of the live points that pass; vectors go no
        further than their scan."""
        base, changed, few = self._parts(as_of)
        q = V.literal(search.prepare_query(query, self.config.metric).tolist())
        score = V.score(self.config.metric, F.col("vector"), q).alias("score")

        def of(rows: DataFrame) -> DataFrame:
            passing = rows if isinstance(where, MatchAll) else rows.where(compile_filter(where))
            return passing.select("id", score, "metadata", "sequence")

        return self._unchanged(of(base), changed, few).unionByName(of(changed.where("op = 'upsert'")))

    def search(self, query: Sequence[float], k: int, where: Filter = MatchAll(), ef: int | None = None, as_of: int | None = None) -> DataFrame:
        """id, score (single precision), metadata and sequence of the k best, now or
        as they were after a sequence that is still kept."""
        search.check_query(query, k, self.config.dimension, ef)
        found = search.top(self._scored(query, where, as_of), k)
        return found.select("id", F.col("score").cast("float").alias("score"), "metadata", "sequence").orderBy(F.desc("score"), F.asc("id"))

    def search_ann(self, query: Sequence[float], k: int, where: Filter = MatchAll(), ef: int | None = None) -> DataFrame:
        """id and score of the k best, candidates by the segment's codes."""
        search.check_query(query, k, self.config.dimension, ef)
        return self.search_many([("q", query)], k, where, ef).orderBy("rank").select("id", "score")

    def search_many(self, queries: list[tuple[object, Sequence[float]]], k: int, where: Filter = MatchAll(), ef: int | None = None) -> DataFrame:
        """qid, id, score and rank of the k best of each of a stated set of queries.

        Of the full segment the scan of candidates reads codes and, for a filter,
        metadata; only candidates' vectors are read, and scored in full, as are all
        points changed since.
        """
        base, changed, few = self._parts()
        metric, width = self.config.metric, max(ef or 0, planner.default_ef(k, True))
        passes = lambda rows: rows if isinstance(where, MatchAll) else rows.where(compile_filter(where))
        coded = self._unchanged(passes(base).select("id", "codes", "scale", "squared"), changed, few)
        old = search.rescore(search.candidates_int8(coded, queries, width, metric), base, queries, k, metric, width)
        new = search.batch_gemm(passes(changed.where("op = 'upsert'")), queries, k, metric)
        return search.top_by_query(old.unionByName(new).drop("rank"), k)

    def stats(self) -> DataFrame:
        """One row: segments, live points, pending ids, bytes of segments, last sequence."""
        manifest = self.manifest()
        size = sum(sum(s["files"].values()) for s in manifest["segments"])
        return self.points().agg(F.count("*").alias("points")).select(F.lit(len(manifest["segments"])).alias("segments"), "points", F.lit(self.pending()).cast("long").alias("pending"), F.lit(size).cast("long").alias("bytes"), F.lit(self.sequence).cast("long").alias("sequence"))
