"""Search, quantisation and routing on small fixtures with known answers."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from vecspark.functions import vectors as V
from vecspark.functions.filters import And, Eq, Not, Range
from vecspark.model import METADATA, InvalidArgument, InvalidDimension, InvalidVector, Metric, metadata_row
from vecspark.operators import graphs, postings, search, sharding
from vecspark.plans import planner


def frame(spark, points):
    rows = [(i, [float(x) for x in v], metadata_row(m)) for i, v, m in points]
    return spark.createDataFrame(rows, "id string, vector array<double>, metadata " + METADATA.simpleString())


def ids(df):
    return [r["id"] for r in df.collect()]


def test_cosine(spark):
    p = search.prepare(frame(spark, [("north", [0, 8], {}), ("east", [2, 0], {}), ("diagonal", [1, 1], {})]), Metric.COSINE)
    found = search.exact(p, [0, 3], 2, Metric.COSINE).collect()
    assert [r["id"] for r in found] == ["north", "diagonal"]
    assert found[0]["score"] == pytest.approx(1.0, abs=1e-6)


def test_filter_comes_before_ranking(spark):
    p = frame(spark, [("wrong-tenant", [10, 0], {"tenant": "b", "price": 5}), ("too-cheap", [9, 0], {"tenant": "a", "price": 3}), ("match", [8, 0], {"tenant": "a", "price": 12})])
    assert ids(search.exact(p, [1, 0], 10, Metric.DOT, And((Eq("tenant", "a"), Range("price", 10))))) == ["match"]


def test_ties_go_by_id(spark):
    assert ids(search.exact(frame(spark, [("b", [1, 0], {}), ("a", [1, 0], {})]), [1, 0], 2, Metric.DOT)) == ["a", "b"]
    p = frame(spark, [(f"p{k}", [1, 0], {}) for k in range(50)])
    assert ids(search.batch_gemm(p, [("q", [1, 0])], 3, Metric.DOT).orderBy("rank")) == ["p0", "p1", "p10"]


@pytest.mark.parametrize("metric", list(Metric))
def test_all_metrics_agree_between_forms(spark, metric):
    rng = np.random.default_rng(3)
    p = search.prepare(frame(spark, [(f"v{k:03}", rng.normal(size=8) * (1 + k % 3), {}) for k in range(120)]), metric).cache()
    queries = [(f"q{k}", rng.normal(size=8).tolist()) for k in range(4)]
    q = spark.createDataFrame([(n, search.prepare_query(v, metric).tolist()) for n, v in queries], "qid string, query array<double>")
    by = lambda df: {(r["qid"], r["rank"]): (r["id"], round(r["score"], 9)) for r in df.collect()}
    one = by(search.batch_sql(p, q, 5, metric))
    assert one == by(search.batch_gemm(p, queries, 5, metric, block=3)) == by(search.ann_int8(p, queries, 5, metric, oversample=8))
    for n, v in queries:
        assert [one[n, r][0] for r in range(1, 6)] == ids(search.exact(p, v, 5, metric))


def test_equal_vectors_tie_by_id_over_batches(spark):
    """Copies in many batches and tasks, more than k of each: products of matrices may
    differ in their last bits by place, sums in order don't."""
    rng = np.random.default_rng(11)
    kinds = rng.normal(size=(40, 67))
    rows = [(f"{k:04}-{n % 7}", [float(v) for v in kinds[k % 40]]) for n, k in enumerate(rng.permutation(1200).tolist())]
    p = spark.createDataFrame(rows, "id string, vector array<double>").repartition(3).cache()
    queries = [(f"q{k}", kinds[k].tolist()) for k in range(0, 40, 3)]
    q = spark.createDataFrame(queries, "qid string, query array<double>")
    by = lambda df: {(r["qid"], r["rank"]): (r["id"], r["score"]) for r in df.collect()}
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "37")
    try:
        for metric in (Metric.DOT, Metric.EUCLIDEAN):
            assert by(search.batch_gemm(p, queries, 8, metric, block=5)) == by(search.batch_sql(p, q, 8, metric))
        # a task gives k rows a query at most, whatever its batches and copies
        sent = search.batch_gemm(p, queries, 8, Metric.DOT)
        assert sent.count() == 8 * len(queries)
        assert search.batch_gemm(p.union(spark.createDataFrame([("none", None)], p.schema)), queries, 8, Metric.DOT).count() == 8 * len(queries)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_a_task_gives_k_rows_a_query():
    rng = np.random.default_rng(12)
    x, q = rng.normal(size=(5000, 6)), rng.normal(size=(3, 6))
    best = search.Best(Metric.DOT, q, 4)
    for at in range(0, 5000, 50):
        best.add([str(n) for n in range(at, at + 50)], x[at : at + 50], 2)
    out = [b for b in best.hits(["a", "b", "c"])]
    assert sum(b.num_rows for b in out) == 12
    assert [int(i) for i in out[0].column(1).to_pylist()[:4]] == np.argsort(-(x @ q[0]))[:4].tolist()


def test_what_an_approximate_search_missed(spark):
    rng = np.random.default_rng(13)
    p = frame(spark, [(f"p{k:03}", rng.normal(size=6), {}) for k in range(300)]).cache()
    queries = [(f"q{k}", rng.normal(size=6).tolist()) for k in range(5)]
    exact = search.batch_gemm(p, queries, 5, Metric.DOT).cache()
    by = lambda df: sorted((r["qid"], r["rank"], r["id"], r["score"]) for r in df.collect())
    poor = search.batch_gemm(p.where("id < 'p150'"), queries, 5, Metric.DOT).where("qid <> 'q3'")
    few = exact.where("rank > 3")
    for found in (poor, few, exact, exact.limit(0)):
        assert by(search.completed(found, p, queries, 5, Metric.DOT)) == by(exact)


def test_rescoring_tells_equal_codes_apart(spark):
    p = frame(spark, [("a-worse", [0, 1, 0.5, 0], {}), ("z-better", [0, 1, 0.503, 0], {})])
    found = search.ann_int8(p, [("q", [0, 0, 1, 0])], 1, Metric.DOT).collect()
    assert [r["id"] for r in found] == ["z-better"] and found[0]["score"] == pytest.approx(0.503)


def test_codes_in_columns_and_arrays(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(40, 6)).astype(np.float32)
    x[0] = 0
    df = spark.createDataFrame([(k, [float(v) for v in row]) for k, row in enumerate(x)], "k int, vector array<float>")
    rows = df.select("k", V.quantize(F.col("vector")).alias("q")).orderBy("k").collect()
    codes, scale, squared = search.quantize_array(x)
    assert [list(r["q"]["codes"]) for r in rows] == codes.tolist()
    assert [r["q"]["scale"] for r in rows] == pytest.approx(scale.tolist())
    assert [r["q"]["squared"] for r in rows] == pytest.approx(squared.tolist(), rel=1e-6)


def test_codes_come_from_single_precision(spark):
    """Doubles that are rounded to singles before they are divided, and one just below a half."""
    x = np.array([[1.4554425477981567, 0.7048008888959885, 1.1173673272132874], [127.0, np.nextafter(np.float32(0.5), np.float32(0)), -2.5]])
    df = spark.createDataFrame([(k, [float(v) for v in row]) for k, row in enumerate(x)], "k int, vector array<double>")
    rows = df.select("k", V.quantize(F.col("vector")).alias("q")).orderBy("k").collect()
    assert [list(r["q"]["codes"]) for r in rows] == search.quantize_array(x)[0].tolist() == [[127, 62, 97], [127, 0, -3]]


def test_recall_of_int8(spark):
    x = [[math.sin((67 * i + 13 * d) * 0.019) + math.cos((i + 7 * d) * 0.007) for d in range(64)] for i in range(500)]
    p = search.prepare(frame(spark, [(f"p{i:04}", v, {}) for i, v in enumerate(x)]), Metric.COSINE).cache()
    queries = [(str(i), x[i]) for i in range(0, 500, 29)]
    found = search.recall(search.batch_gemm(p, queries, 10, Metric.COSINE), search.ann_int8(p, queries, 10, Metric.COSINE)).first()["recall"]
    assert found >= 0.95


def test_cells_widen_until_enough_pass(spark):
    rng = np.random.default_rng(1)
    p = frame(spark, [(f"p{k:03}", rng.normal(size=4), {"g": k % 2}) for k in range(200)]).cache()
    centres = search.fit_cells(p, 4)
    found = search.ann_ivf(search.with_cell(p, centres), centres, [1, 0, 0, 0], 80, Metric.DOT, 1, Eq("g", 0))
    assert ids(found) == ids(search.exact(p, [1, 0, 0, 0], 80, Metric.DOT, Eq("g", 0)))


def test_cells_for_many_queries(spark):
    rng = np.random.default_rng(2)
    p = frame(spark, [(f"p{k:03}", rng.normal(size=4), {}) for k in range(300)]).cache()
    centres = search.fit_cells(p, 6)
    celled = search.with_cell(p, centres).cache()
    queries = [(f"q{k}", rng.normal(size=4).tolist()) for k in range(9)]
    key = lambda df: sorted((r["qid"], r["rank"], r["id"]) for r in df.collect())
    assert key(search.ann_ivf_many(celled, centres, queries, 5, Metric.EUCLIDEAN, 6)) == key(search.batch_gemm(p, queries, 5, Metric.EUCLIDEAN))
    some = search.ann_ivf_many(celled, centres, queries, 5, Metric.EUCLIDEAN, 2).collect()
    for n, q in queries:
        near = set(search.nearest_cells(centres, np.array(q), 2).tolist())
        inside = celled.where(F.col("cell").isin(sorted(near)))
        assert [r["id"] for r in sorted(some, key=lambda r: r["rank"]) if r["qid"] == n] == ids(search.exact(inside, q, 5, Metric.EUCLIDEAN))


def test_snapshot_and_delta(spark):
    old = frame(spark, [("a", [1, 0], {}), ("b", [0, 1], {}), ("q", [0, 5], {})])
    delta = frame(spark, [("a", [-1, 0], {})])
    dirty = spark.createDataFrame([("a",), ("q",)], "id string")
    assert ids(search.snapshot_and_delta(old, delta, dirty, [1, 0], 2, Metric.DOT)) == ["b", "a"]


def test_errors(spark):
    p = frame(spark, [("a", [1, 0], {})])
    with pytest.raises(InvalidDimension):
        search.exact(p, [1], 1, Metric.DOT, dimension=2)
    with pytest.raises(InvalidArgument):
        search.exact(p, [1, 0], 0, Metric.DOT)
    with pytest.raises(InvalidVector):
        search.exact(p, [0, 0], 1, Metric.COSINE)
    with pytest.raises(InvalidVector):
        search.exact(p, [float("nan"), 0], 1, Metric.DOT)
    with pytest.raises(InvalidArgument):
        search.check_query([1, 0], 10, 2, ef=9)


def test_postings(spark):
    p = frame(spark, [("a", [1], {"t": "one", "price": 5, "on": True}), ("b", [1], {"t": "one", "price": 15, "on": False}), ("c", [1], {"t": "two", "price": 25, "on": True})])
    index = postings.postings(p)
    assert ids(postings.candidates(index, p, And((Eq("t", "one"), Range("price", 10, 20), Not(Eq("on", True)))))) == ["b"]
    assert ids(postings.candidates(index, p, Range("price", 20, 10))) == []
    assert sorted(ids(postings.candidates(index, p, Not(Eq("zzz", 1))))) == ["a", "b", "c"]


def test_adaptive_search_with_a_filter(spark):
    p = frame(spark, [(f"filtered-{i:03}", [i, 1], {"group": "even" if i % 2 == 0 else "odd"}) for i in range(1024)]).cache()
    coded = search.with_codes(p).cache()
    found = planner.adaptive(p, coded, [1, 0], 10, Metric.DOT, Eq("group", "even"), 128).collect()
    assert [r["id"] for r in found] == [f"filtered-{i:03}" for i in range(1022, 1002, -2)]
    assert planner.default_ef(10) == 96 and planner.default_ef(100) == 400 and planner.default_ef(10, True) == 256
    assert planner.goes_exact(10, 1000, 10) and not planner.goes_exact(900, 1000, 10)
    assert planner.rebuild_due(256, 100, False) and not planner.rebuild_due(255, 100, False) and not planner.rebuild_due(256, 10_000, True)


def test_hash_and_shards(spark):
    row = spark.createDataFrame([("hello",), ("",), ("é",)], "id string").select(F.hex(V.fnv1a64(F.col("id"))).alias("h")).collect()
    assert [r["h"] for r in row][:2] == ["A430D84680AABD0B", "CBF29CE484222325"]
    assert spark.createDataFrame([("point-42",)], "id string").select(V.shard_of(F.col("id"), 7)).first()[0] == 0
    p = sharding.with_shard(frame(spark, [("a", [1, 0], {}), ("b", [4, 0], {}), ("c", [3, 0], {}), ("d", [2, 0], {})]), 4)
    assert [r["shard"] for r in p.orderBy("id").collect()] == [0, 1, 2, 3]
    scored = p.withColumn("score", F.col("vector")[0])
    assert ids(sharding.topk_by_shard(scored, 3)) == ["b", "c", "d"]
    state = spark.createDataFrame([(0, 5), (1, 3)], "shard int, applied_index long")
    assert sharding.min_applied(state).first()[0] == 3
    assert sharding.min_applied(state.unionByName(spark.createDataFrame([(2, None)], "shard int, applied_index long"))).first()[0] is None


def test_graphs(spark):
    t = [i * 0.137 for i in range(1000)]
    p = search.prepare(frame(spark, [(f"point-{i:04}", [math.cos(x), math.sin(x), math.cos(0.31 * x)], {}) for i, x in enumerate(t)]), Metric.COSINE).cache()
    queries = [(str(i), [math.cos(t[i]), math.sin(t[i]), math.cos(0.31 * t[i])]) for i in range(0, 1000, 37)]
    held = graphs.build(p, Metric.COSINE, 2, m=12, ef_construction=80).cache()
    found = graphs.ann(held, p, queries, 10, Metric.COSINE, ef=64)
    assert search.recall(search.batch_gemm(p, queries, 10, Metric.COSINE), found).first()["recall"] >= 0.98
    assert graphs.statistics(held).agg(F.sum("nodes")).first()[0] == 1000
    again = graphs.build(p.repartition(5), Metric.COSINE, 2, m=12, ef_construction=80)
    by = lambda df: {r["part"]: bytes(r["graph"]) for r in df.collect()}
    assert {k: graphs.Graph.unpack(v, Metric.COSINE).levels for k, v in by(held).items()} == {k: graphs.Graph.unpack(v, Metric.COSINE).levels for k, v in by(again).items()}
    with pytest.raises(InvalidArgument):
        graphs.Graph([], np.empty((0, 2)), Metric.DOT, m=1)
    assert graphs.Graph([], np.empty((0, 2)), Metric.DOT).nearest(np.zeros(2), 1, 10) == []
    # ids may hold anything, and 14.5 % of these are on a higher level
    odd = graphs.Graph(["a\nb", "", "é"], np.eye(3), Metric.DOT)
    assert graphs.Graph.unpack(odd.pack(), Metric.DOT).ids == odd.ids
    many = graphs.Graph.__new__(graphs.Graph)
    many.ids, many.m = [str(k) for k in range(2000)], 16
    assert sum(many._level(k) > 0 for k in range(2000)) == 290


def test_graphs_of_many_points():
    """Partitions stay bounded as points grow, lists keep to their length, a walk
    comes to every node, and a large group of copies doesn't cut the graph in two."""
    assert [graphs.parts_for(n) for n in (0, 2000, 50_000, 50_001, 5_000_000)] == [2, 2, 2, 3, 200]
    rng = np.random.default_rng(8)
    x = rng.normal(size=(3000, 12))
    x[500:900] = x[500]
    for metric in (Metric.DOT, Metric.EUCLIDEAN):
        v = x / np.linalg.norm(x, axis=1)[:, None] if metric == Metric.DOT else x
        graph = graphs.Graph([f"{k:04}" for k in range(3000)], v, metric, m=12, ef_construction=80)
        assert all(len(to) <= (24 if level == 0 else 12) and node not in to and len(set(to)) == len(to) for level, links in enumerate(graph.levels) for node, to in links.items())
        assert [len(level) for level in graph.levels][0] == 3000 and graph.start in graph.levels[-1]
        found = 0
        for k in range(0, 500, 10):
            scores = search.scores_of(metric, v, v[k : k + 1])[:, 0]
            found += len({i for i, _ in graph.nearest(v[k].astype(np.float32), 10, 96)} & {f"{n:04}" for n in np.argsort(-scores, kind="stable")[:10].tolist()})
        assert found >= 0.95 * 500


def test_graph_query_gives_what_walks_missed(spark, monkeypatch):
    from vecspark import queries as core

    d = "/root/testdata/sf0.001"
    walked = core._by_graphs
    monkeypatch.setattr(core, "_by_graphs", lambda *a: walked(*a).where("CAST(id AS BIGINT) % 3 <> 1"))
    by = lambda name: sorted(tuple(r) for r in core.queries()[name](spark, d).collect())
    assert by("knn_ann_graph") == by("knn_gemm")
