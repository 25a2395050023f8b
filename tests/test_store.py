"""Durable collections, catalogs, the service and streams."""

import json
import math
import os
import time

import pytest
from pyspark.sql import functions as F

from vecspark.catalog import Catalog
from vecspark.client import Client
from vecspark.functions.filters import And, Eq, MatchAll, Range
from vecspark.functions.metadata import metadata_json
from vecspark.model import METADATA, AlreadyExists, CollectionConfig, ConfigMismatch, CorruptData, InvalidArgument, InvalidDimension, InvalidId, InvalidMetadata, InvalidVector, Metric, NotFound, SequenceGap, Unauthorized, VectorError, WriterBusy, metadata_row
from vecspark.operators import versions
from vecspark.service import Service
from vecspark.sources.sharded import ShardedCollection
from vecspark.sources.store import Collection, points_frame
from vecspark.streaming import ingest


def p(i, v, **metadata):
    return {"id": i, "vector": v, "metadata": metadata}


def hit_ids(c, q, k, *where):
    return [r["id"] for r in c.search(q, k, *where).collect()]


@pytest.fixture
def new(spark, tmp_path):
    return lambda metric=Metric.COSINE, name="c": Collection.open(spark, str(tmp_path / name), CollectionConfig(2, metric))


def again(c, **options):
    c.close()
    return Collection.open(c.spark, c.path, c.config, **options)


def test_log_and_restart(new):
    c = new()
    assert c.upsert([p("keep", [1, 0]), p("remove", [0, 1])]) == 1
    assert c.delete(["remove"]) == 2
    c = again(c)
    assert c.sequence == 2 and [r["id"] for r in c.points().collect()] == ["keep"]
    with pytest.raises(ConfigMismatch):
        Collection.open(c.spark, c.path, CollectionConfig(3, Metric.COSINE))


def test_delta_over_snapshot(new):
    c = new()
    c.upsert([p("updated", [1, 0]), p("deleted", [1, 0])])
    c.flush()
    c.upsert([p("updated", [0, 1])])
    c.delete(["deleted"])
    assert c.pending() == 2
    c.flush()
    c = again(c)
    found = c.search([1, 0], 10).collect()
    assert [r["id"] for r in found] == ["updated"] and abs(found[0]["score"]) < 1e-6
    assert len(c.manifest()["segments"]) == 2 and c.pending() == 0


def test_filters_over_snapshot_and_delta(new):
    c = new()
    c.upsert([p("a", [1, 0], tenant="one", price=10), p("b", [0, 1], tenant="two", price=20)])
    c.flush()
    c.upsert([p("a", [1, 0], tenant="two", price=10)])
    assert hit_ids(c, [1, 0], 5, Eq("tenant", "one")) == []
    assert hit_ids(c, [1, 0], 5, And((Eq("tenant", "two"), Range("price", 10, 21)))) == ["a", "b"]


def test_compaction_after_eight_segments(new):
    c = new(Metric.DOT)
    for k in range(9):
        c.upsert([p(f"p{k}", [k, 1])])
        c.flush()
    assert [s["sequence"] for s in c.manifest()["segments"]] == [9]
    assert c.count() == 9 and len(c.files.names(f"{c.path}/segments")) == 9
    held = c.points()  # by the manifest of before
    c.upsert([p("more", [1, 1])])
    c.compact()
    assert held.count() == 9
    c.clean()
    assert len(c.files.names(f"{c.path}/segments")) == 1 and c.files.names(f"{c.path}/log") == [] and again(c).count() == 10


def test_many_deletes_keep_the_collection_readable(new):
    c = new(Metric.DOT)
    c.upsert([p(f"p{k}", [k, 1]) for k in range(12)])
    c.flush()
    for k in range(9):
        c.delete([f"p{k}"])
        c.flush()
    assert again(c).count() == 3


def test_batches_are_atomic(new):
    c = new(Metric.EUCLIDEAN)
    with pytest.raises(InvalidDimension):
        c.upsert([p("valid", [1, 2]), p("invalid", [1])])
    with pytest.raises(InvalidVector):
        c.upsert([p("x", [1, float("inf")])])
    with pytest.raises(InvalidId):
        c.upsert([p("", [1, 2])])
    with pytest.raises(InvalidMetadata):
        c.upsert([p("x", [1, 2], a=None)])
    with pytest.raises(InvalidId):
        c.delete([])
    assert c.sequence == 0 and c.count() == 0
    assert c.upsert([p("twice", [1, 1]), p("twice", [2, 2])]) == 1
    assert list(c.get("twice").first()["vector"]) == [2.0, 2.0]
    assert c.delete(["nobody"]) == 2
    with pytest.raises(InvalidVector):
        Collection.open(c.spark, c.path + "2", CollectionConfig(2, Metric.COSINE)).upsert([p("zero", [0, 0])])


def test_sequences_and_as_of(new):
    c = new(Metric.DOT)
    assert [c.upsert([p("p", [1, 0])]), c.upsert([p("p", [2, 0])])] == [1, 2]
    assert c.get("p").first()["sequence"] == 2
    assert c.points(as_of=1).first()["sequence"] == 1
    assert c.delete(["p"]) == 3 and c.get("p").isEmpty()
    c.flush()
    c.upsert([p("q", [5, 0])])
    c.flush()
    c.compact()
    # beyond the log of now, as long as it is kept
    assert [[r["sequence"] for r in c.points(as_of=n).collect()] for n in (0, 1, 2, 3, 4)] == [[], [1], [2], [], [4]]
    assert [r["id"] for r in c.search([1, 0], 5, as_of=2).collect()] == ["p"]
    c.clean()
    with pytest.raises(VectorError):
        c.points(as_of=1)


def test_stops_between_the_steps_of_a_flush(new):
    c = new(Metric.DOT)
    c.upsert([p("a", [1, 0])])
    c.flush()
    c.upsert([p("b", [2, 0])])
    # after the segment, before the manifest: the segment isn't named yet
    versions.newest(c.log(1)).write.parquet(f"{c.path}/segments/delta-orphan")
    assert again(c).count() == 2
    # after the manifest the commits it has are there still
    c.flush()
    assert again(c).count() == 2
    # rows without a commit, and a commit whose writer stopped half-way
    c = again(c)
    os.makedirs(f"{c.path}/data/half")
    with open(f"{c.path}/log/3.json", "w") as f:
        f.write('{"seq')
    c = again(c)
    assert c.count() == 2 and c.sequence == 2
    assert c.upsert([p("c", [3, 0])]) == 3 and again(c).count() == 3


def test_stale_flush_changes_nothing(new):
    c = new(Metric.DOT)
    c.upsert([p("a", [1, 0])])
    stale = c.manifest()
    c.points().write.parquet(f"{c.path}/segments/full-stale")
    c.upsert([p("b", [1, 0])])
    c.flush()
    assert c.publish(stale, "full-stale", 1, True) == 2
    assert again(c).count() == 2


def test_one_writer(new):
    c, d = new(Metric.DOT), new(Metric.DOT)
    assert c.upsert([p("a", [1, 0])]) == 1
    for change in (lambda: d.upsert([p("b", [1, 0])]), lambda: d.delete(["a"]), d.flush):
        with pytest.raises(WriterBusy):
            change()
    assert d.count() == 1  # it may read
    c.close()
    assert d.upsert([p("b", [1, 0])]) == 2
    # one that takes over shuts the other out, which has lost nothing
    e = Collection.open(c.spark, c.path, c.config, take_over=True)
    assert e.upsert([p("c", [1, 0])]) == 3
    with pytest.raises(WriterBusy):
        d.upsert([p("d", [1, 0])])
    assert sorted(r["id"] for r in again(e).points().collect()) == ["a", "b", "c"]


def test_a_number_is_given_once(new):
    c = new(Metric.DOT)
    c.upsert([p("a", [1, 0])])
    c.files.create(f"{c.path}/log/2.json", json.dumps({"sequence": 2}))  # by whomever
    with pytest.raises(WriterBusy):
        c.upsert([p("b", [1, 0])])


def test_damage_and_gaps_are_errors(new):
    c = new(Metric.DOT)
    c.upsert([p(f"a{k}", [k, 0]) for k in range(50)])
    c.flush()
    folder = f"{c.path}/segments/{c.manifest()['segments'][0]['name']}"
    part = next(f for f in os.listdir(folder) if f.endswith(".parquet"))
    c.verify()
    with open(f"{folder}/{part}", "r+b") as f:  # one bit, the length stays
        f.seek(40)
        byte = f.read(1)
        f.seek(40)
        f.write(bytes([byte[0] ^ 1]))
    os.remove(f"{folder}/.{part}.crc")  # the local file system's own
    with pytest.raises(CorruptData):
        again(c).verify()
    with open(f"{folder}/{part}", "ab") as f:
        f.write(b"x")
    with pytest.raises(CorruptData):
        again(c)
    d = new(Metric.DOT, "d")
    for k in range(3):
        d.upsert([p("a", [k, 0])])
    d.files.delete(f"{d.path}/log/2.json")
    with pytest.raises(SequenceGap):
        again(d)


def test_requests_take_effect_once(new):
    c = new(Metric.DOT)
    assert c.upsert([p("a", [1, 0])], request=("x", 1)) == 1
    assert c.delete(["a"], request=("x", 2)) == 2
    assert c.upsert([p("a", [1, 0])], request=("x", 1)) == 1 and c.count() == 0
    assert c.upsert([p("a", [1, 0])], request=("y", 1)) == 3
    # what was rejected stays so, also with another body
    with pytest.raises(InvalidDimension):
        c.upsert([p("b", [1])], request=("x", 3))
    c = again(c)
    with pytest.raises(InvalidDimension):
        c.upsert([p("b", [1, 0])], request=("x", 3))
    # a stop after the commit, before the answer is kept
    c.files.delete(c._ledger(("y", 1)))
    c = again(c)
    assert c.upsert([p("c", [1, 0])], request=("y", 1)) == 3 and c.sequence == 3


def test_search_by_codes_and_plans(new):
    c = new()
    t = [k * 0.01 for k in range(300)]
    c.upsert([p(f"p{k:03}", [math.cos(x), math.sin(x)], half=k % 2) for k, x in enumerate(t)])
    c.flush()
    c.upsert([p("p100", [-1, 0], half=0), p("new", [math.cos(1), math.sin(1)], half=1)])
    c.delete(["p101"])
    q = [math.cos(1), math.sin(1)]
    for where in (MatchAll(), Eq("half", 1)):
        want = [(r["id"], round(r["score"], 5)) for r in c.search(q, 7, where).collect()]
        assert [(r["id"], round(r["score"], 5)) for r in c.search_ann(q, 7, where).collect()] == want
        assert "p100" not in dict(want) and "p101" not in dict(want) and want[0][0] == "new"
    # the segment's vectors aren't dealt out, and the scan of candidates doesn't read them
    plan = c.search(q, 7)._jdf.queryExecution().explainString(c.spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    scans = [x for x in plan.split("\n\n") if "Scan parquet" in x and "/segments/" in x]
    assert scans and "LeftAnti" in plan and "SortMergeJoin" not in plan
    plan = c.search_many([("q", q)], 7)._jdf.queryExecution().explainString(c.spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    assert any("ReadSchema: struct<id:string,codes:binary,scale:float,squared:double>" in x for x in plan.split("\n\n"))


def test_background_flush(new):
    c = new(Metric.DOT)
    flusher = ingest.BackgroundFlush(c, every=3600, at=2, look=0.1)
    with flusher.lock:
        c.upsert([p("a", [1, 0]), p("b", [1, 0])])
    until = time.monotonic() + 60
    while not flusher.flushes and time.monotonic() < until:
        time.sleep(0.1)
    with flusher.lock:
        c.upsert([p("c", [1, 0])])
    flusher.close()
    assert flusher.flushes == 2 and c.manifest()["sequence"] == 2 and c.pending() == 0 and c.count() == 3


def test_sharded_collection(spark, tmp_path):
    c = ShardedCollection.open(spark, str(tmp_path / "s"), CollectionConfig(2, Metric.DOT), 4)
    receipts = c.upsert([p(i, [n, 0]) for i, n in (("a", 1), ("b", 4), ("c", 3), ("d", 2))])
    assert sorted(tuple(r) for r in receipts.collect()) == [(k, 1, 1) for k in range(4)]
    assert [tuple(r) for r in c.delete(["b"]).collect()] == [(1, 2, 1)]
    assert sorted(tuple(r) for r in c.flush().collect()) == [(0, 1), (1, 2), (2, 1), (3, 1)]
    c.close()
    c = ShardedCollection.open(spark, str(tmp_path / "s"))
    assert [r["id"] for r in c.search([1, 0], 2).collect()] == ["c", "d"] and c.points().count() == 3
    assert c.get("a").count() == 1 and c.get("b").count() == 0
    with pytest.raises(ConfigMismatch):
        ShardedCollection.open(spark, str(tmp_path / "s"), CollectionConfig(2, Metric.DOT), 5)


def test_replay_and_requests(spark):
    rows = [("a", "upsert", 1, 0, "x", 7), ("b", "upsert", 2, 0, "x", 7), ("a", "delete", 3, 0, "y", 7), ("c", "upsert", 4, 0, "x", 8)]
    log = spark.createDataFrame(rows, "id string, op string, sequence long, ordinal int, client_id string, request_id long")
    assert sorted(r["id"] for r in versions.latest(log).collect()) == ["b", "c"]
    assert sorted(r["id"] for r in versions.replay(log.where("sequence <= 2"), log, 2).collect()) == ["b", "c"]
    with pytest.raises(SequenceGap):
        versions.replay(log.where("sequence <= 1"), log.where("sequence <> 2"), 1)
    assert sorted(r["sequence"] for r in versions.dedup_requests(log).collect()) == [1, 3, 4]


def test_catalog_backup_and_restore(spark, tmp_path):
    catalog = Catalog(spark, str(tmp_path / "db"))
    c = catalog.create("docs", 2, "cosine")
    c.upsert([p("doc", [1, 0])])
    catalog.backup("docs", "b1")
    c.delete(["doc"])
    c.close()
    restored = catalog.restore("b1", "copy")
    assert restored.sequence == 1 and hit_ids(restored, [1, 0], 1) == ["doc"] and c.count() == 0
    assert [(r["name"], r["points"]) for r in Catalog(spark, str(tmp_path / "db")).summaries().collect()] == [("copy", 1), ("docs", 0)]
    for error, call in ((InvalidArgument, lambda: catalog.create("../escape", 2, "dot")), (AlreadyExists, lambda: catalog.create("docs", 2, "dot")), (NotFound, lambda: catalog.get("none")), (AlreadyExists, lambda: catalog.backup("docs", "b1"))):
        with pytest.raises(error):
            call()


def test_service(spark, tmp_path):
    service = Service(Catalog(spark, str(tmp_path / "db")), token="t")
    ask = lambda op, **r: service.dispatch({"op": op, **r}, "t")
    assert service.dispatch({"op": "list_collections"})["status"] == 401
    assert ask("create_collection", collection="d", dimension=2, metric="cosine")["status"] == 201
    assert ask("upsert", collection="d", points=[{"id": "doc-1", "vector": [1, 0], "metadata": {"tenant": "acme", "n": 1}}])["body"] == {"sequence": 1}
    found = ask("query", collection="d", vector=[1, 0], k=3, filter={"op": "eq", "field": "tenant", "value": "acme"})
    assert found["status"] == 200 and found["body"]["hits"][0]["metadata"] == {"tenant": "acme", "n": 1}
    json.dumps(found)
    assert ask("backup", collection="d", backup="b")["status"] == 201
    assert ask("restore", collection="d2", backup="b")["status"] == 201
    assert ask("query", collection="d2", vector=[1, 0], k=1)["body"]["hits"][0]["id"] == "doc-1"
    assert ask("query", collection="d", vector=[1], k=1)["error"]["kind"] == "InvalidDimension"
    assert ask("query", collection="d", vector=[1, 0], k=10**6)["status"] == 429
    assert ask("drop", collection="d")["status"] == 404
    assert ask("upsert", collection="d", points=[{"id": "x", "vector": [1, 0], "metadata": {"a": []}}])["status"] == 400
    client = Client(service, "t")
    assert client.upsert("d", [{"id": "y", "vector": [0, 1]}], ("me", 1)) == client.upsert("d", [{"id": "z", "vector": [0, 1]}], ("me", 1)) == 2
    assert [h["id"] for h in client.query("d", [0, 1], 1)] == ["y"] and client.backups() == ["b"] and len(client.collections()) == 2
    with pytest.raises(NotFound):
        client.query("nothing", [0, 1], 1)
    with pytest.raises(Unauthorized):
        Client(service, "wrong").collections()
    assert service.dispatch("text", "t")["status"] == 400
    assert service.counters["queries"] == 3 and service.counters["backups"] == service.counters["restores"] == 1


def test_stream_into_a_collection(spark, tmp_path):
    c = Collection.open(spark, str(tmp_path / "c"), CollectionConfig(2, Metric.DOT))
    source = str(tmp_path / "in")
    rows = points_frame(spark, [p("a", [1, 0]), p("b", [2, 0])]).withColumn("op", F.lit("upsert"))
    rows.coalesce(1).write.parquet(source)
    more = points_frame(spark, [p("a", [0, 0]), p("c", [3, 0])]).withColumn("op", F.when(F.col("id") == "a", "delete").otherwise("upsert"))
    state = str(tmp_path / "state")
    run = lambda: ingest.to_collection(spark.readStream.schema(rows.schema).parquet(source), c, state, flush_at=2).awaitTermination()
    run()
    more.coalesce(1).write.mode("append").parquet(source)
    run()
    assert hit_ids(c, [1, 0], 5) == ["c", "b"]
    assert c.count() == 2 and METADATA is not None
    assert c.sequence == 2 and c.batch_of(state) == 1  # a commit a batch
    # a batch that is tried again, also after a flush and by another handle
    before = c.sequence
    assert c.apply(rows.drop("ordinal"), stream=(state, 1)) == before and c.apply(rows.drop("ordinal"), stream=(state, 0)) == before
    c = again(c)
    assert c.apply(rows.drop("ordinal"), stream=(state, 1)) == before and c.count() == 2


def test_stream_of_requests(spark, tmp_path):
    schema = "id string, op string, sequence long, client_id string, request_id long"
    source, path, state = (str(tmp_path / n) for n in ("in", "log", "state"))
    run = lambda: ingest.to_log(spark.readStream.schema(schema).parquet(source), path, state, dedup=True).awaitTermination()
    for k in range(3):
        rows = [("a", "upsert", 10 * k + r, "x", r) for r in range(k, k + 3)]
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
        run()
    assert sorted((r["request_id"], r["sequence"]) for r in spark.read.parquet(path).collect()) == [(0, 0), (1, 1), (2, 2), (3, 13), (4, 24)]


def test_metadata_as_json(spark):
    rows = [({"b": 'quote " and \\ é', "a": 1, "f": 2.5, "t": True}, ), ({},), (None,)]
    df = spark.createDataFrame([(k, metadata_row(m[0]) if m[0] is not None else None) for k, m in enumerate(rows)], "k int, m " + METADATA.simpleString())
    got = [json.loads(r[0]) for r in df.orderBy("k").select(metadata_json(F.col("m"))).collect()]
    assert got == [{"a": 1, "b": 'quote " and \\ é', "f": 2.5, "t": True}, {}, {}]
