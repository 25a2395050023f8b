"""Nearest-neighbour search: exact, batched, quantised with exact rescoring, and
by cells; results are ordered by score (larger first), then id.

Points are rows with id, vector and, where a filter asks for it, metadata; for
the cosine metric their vectors are of length one (``prepare``).
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vecspark.functions import vectors as V
from vecspark.functions.filters import Filter, MatchAll, compile_filter
from vecspark.model import CODES, InvalidArgument, InvalidDimension, InvalidVector, Metric

#: Queries that are held against all points at a time.
QUERY_BLOCK = 256


def check_query(query: Sequence[float], k: int, dimension: int | None, ef: int | None = None) -> None:
    if k <= 0:
        raise InvalidArgument("k is positive")
    if dimension is not None and len(query) != dimension:
        raise InvalidDimension(f"the query has {len(query)} components, the collection {dimension}")
    if ef is not None and ef < k:
        raise InvalidArgument("ef_search is at least k")
    if not np.isfinite(np.asarray(query, dtype=float)).all():
        raise InvalidVector("a query is finite")


def prepare_query(query: Sequence[float], metric: Metric) -> np.ndarray:
    q = np.asarray(query, dtype=np.float64)
    if metric == Metric.COSINE:
        norm = float(np.sqrt((q * q).sum()))
        if not np.isfinite(norm) or norm == 0:
            raise InvalidVector("a vector of length zero has no direction")
        q = q / norm
    return q


def prepare(points: DataFrame, metric: Metric) -> DataFrame:
    """Points whose vectors are ready to be scored."""
    return points.withColumn("vector", V.normalized(F.col("vector"))) if metric == Metric.COSINE else points


def top(hits: DataFrame, k: int) -> DataFrame:
    return hits.orderBy(F.desc("score"), F.asc("id")).limit(k)


def top_by_query(hits: DataFrame, k: int) -> DataFrame:
    """The k best of each qid; what can't be among them goes before rows are dealt out."""
    w = Window.partitionBy("qid").orderBy(F.desc("score"), F.asc("id"))
    return hits.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def exact(points: DataFrame, query: Sequence[float], k: int, metric: Metric, where: Filter = MatchAll(), dimension: int | None = None, promoted: dict | None = None) -> DataFrame:
    """The k best points of those a filter holds for, with their score."""
    check_query(query, k, dimension)
    q = V.literal(prepare_query(query, metric).tolist())
    found = points.where(compile_filter(where, promoted=promoted)) if not isinstance(where, MatchAll) else points
    return top(found.withColumn("score", V.score(metric, F.col("vector"), q)).drop("vector"), k)


def exact_in(points: DataFrame, ids: DataFrame, query: Sequence[float], k: int, metric: Metric) -> DataFrame:
    """The same among the points of the column id of ``ids``."""
    return exact(points.join(ids.select("id").distinct(), "id", "left_semi"), query, k, metric)


def batch_sql(points: DataFrame, queries: DataFrame, k: int, metric: Metric) -> DataFrame:
    """qid, id, score and rank for a stated set of prepared queries (qid, query), by columns alone."""
    pairs = points.select("id", "vector").join(F.broadcast(queries))
    return top_by_query(pairs.select("qid", "id", V.score(metric, F.col("vector"), F.col("query")).alias("score")), k)


def matrix(column: pa.Array) -> np.ndarray:
    """The vectors of a batch as the rows of a matrix."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def best_of_batch(scores: np.ndarray, k: int) -> np.ndarray:
    """Whether each (row, query) may be among the k best of its query: ties of the last one stay."""
    if scores.shape[0] <= k:
        return np.ones(scores.shape, dtype=bool)
    least = np.partition(scores, scores.shape[0] - k, axis=0)[scores.shape[0] - k]
    return scores >= least


def scores_of(metric: Metric, x: np.ndarray, q: np.ndarray) -> np.ndarray:
    if metric == Metric.EUCLIDEAN:
        # summed from differences: squares of lengths would cancel
        return np.stack([-((x - row) ** 2).sum(axis=1) for row in q], axis=1) + 0.0
    return x @ q.T + 0.0


def first_copies(ids: list[str], x: np.ndarray, k: int) -> np.ndarray:
    """Rows that may be among k best: of equal vectors the k least ids."""
    _, group, sizes = np.unique(np.ascontiguousarray(x).view(np.dtype((np.void, x.itemsize * x.shape[1]))).ravel(), return_inverse=True, return_counts=True)
    kept = np.ones(len(x), dtype=bool)
    if sizes.max(initial=0) > k:
        many = np.flatnonzero(sizes[group] > k)
        of = group[many].tolist()
        seen: dict[int, int] = {}
        for n in sorted(range(len(many)), key=lambda n: ids[many[n]]):
            seen[of[n]] = seen.get(of[n], 0) + 1
            kept[many[n]] = seen[of[n]] <= k
    return np.flatnonzero(kept)


def in_order(metric: Metric, x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Scores of the rows of one matrix with those of another, summed from the first
    component to the last as in ``functions.vectors``: equal vectors score the same."""
    out = np.zeros(len(x))
    for j in range(x.shape[1]):
        d = x[:, j] - q[:, j] if metric == Metric.EUCLIDEAN else None
        out += x[:, j] * q[:, j] if d is None else d * d
    return (-out if metric == Metric.EUCLIDEAN else out) + 0.0


#: Pairs that are scored in order at a time.
PAIRS = 65_536


class Best:
    """The k best (score, then id) of each query so far, of which rows come in batches."""

    def __init__(self, metric: Metric, queries: np.ndarray, k: int, floors: np.ndarray | None = None):
        self.metric, self.q, self.k = metric, queries, k
        self.lengths = np.sqrt((queries * queries).sum(axis=1))
        self.floors = np.full(len(queries), -np.inf) if floors is None else floors
        self.scores = np.full((len(queries), k), -np.inf)
        self.ids = np.full((len(queries), k), None, dtype=object)

    def add(self, ids: list[str], x: np.ndarray, block: int) -> None:
        rows = first_copies(ids, x, self.k)
        x, held = x[rows], np.empty(len(rows), dtype=object)
        held[:] = [ids[n] for n in rows.tolist()]
        squares = (x * x).sum(axis=1)
        long = np.sqrt(squares.max(initial=0))
        for at in range(0, len(self.q), block):
            some = slice(at, at + block)
            scores = self.q[some] @ x.T
            # what sums of products in any order may differ by, several times
            off = (x.shape[1] + 4) * 2.0**-49
            margin = off * long * self.lengths[some]
            if self.metric == Metric.EUCLIDEAN:
                scores = 2 * scores - squares - (self.lengths[some] ** 2)[:, None]
                margin = off * (long + self.lengths[some]) ** 2
            least = np.maximum(self.floors[some], self.scores[some, -1])
            new = np.flatnonzero(np.isneginf(least)) if len(x) > self.k else []
            if len(new):
                least[new] = np.partition(scores[new], len(x) - self.k, axis=1)[:, len(x) - self.k]
            col, row = np.nonzero(~(scores < (least - margin)[:, None]))
            exact = np.concatenate([np.empty(0), *[in_order(self.metric, x[row[n : n + PAIRS]], self.q[at + col[n : n + PAIRS]]) for n in range(0, len(row), PAIRS)]])
            passed = np.flatnonzero(exact >= self.floors[at + col])
            self._merge(at + col[passed], exact[passed], held[row[passed]])

    def _merge(self, col: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
        cols = np.unique(col)
        old, place = np.nonzero(self.ids[cols] != None)  # noqa: E711
        col = np.concatenate([cols[old], col])
        scores = np.concatenate([self.scores[cols[old], place], scores])
        ids = np.concatenate([self.ids[cols[old], place], ids])
        order = np.lexsort((np.unique(ids, return_inverse=True)[1], -scores, col)) if len(ids) else np.empty(0, dtype=int)
        col, scores, ids = col[order], scores[order], ids[order]
        rank = np.arange(len(col)) - np.searchsorted(col, col)
        top_ = np.flatnonzero(rank < self.k)
        self.scores[col[top_], rank[top_]] = scores[top_]
        self.ids[col[top_], rank[top_]] = ids[top_]

    def hits(self, qids: list[str], rows: int = 65_536) -> Iterator[pa.RecordBatch]:
        col, place = np.nonzero(self.ids != None)  # noqa: E711
        for at in range(0, len(col), rows):
            c, p = col[at : at + rows], place[at : at + rows]
            yield pa.RecordBatch.from_arrays([pa.array([qids[n] for n in c.tolist()], pa.string()), pa.array(self.ids[c, p].tolist(), pa.string()), pa.array(self.scores[c, p])], ["qid", "id", "score"])


def batch_gemm(points: DataFrame, queries: list[tuple[object, Sequence[float]]], k: int, metric: Metric, block: int = QUERY_BLOCK, floors: dict[str, float] | None = None) -> DataFrame:
    """The same by matrix products of Arrow batches: they say what may be among the k
    best, whose scores are then summed in order.  A task keeps the k best of each query
    over all its batches, so it gives k rows a query at most, of which a window takes
    the k best of all.  With ``floors`` only scores from a query's floor on count.
    Points without a vector don't take part."""
    if not queries:
        raise InvalidArgument("there is at least one query")
    least = None if floors is None else np.array([floors.get(str(qid), -np.inf) for qid, _ in queries])
    shared = points.sparkSession.sparkContext.broadcast(([str(qid) for qid, _ in queries], np.stack([prepare_query(q, metric) for _, q in queries]), least))

    def run(batches: Iterator[pa.RecordBatch]):
        qids, all_, least = shared.value
        best = Best(metric, all_, k, least)
        for batch in batches:
            if batch.num_rows:
                best.add(batch.column(0).to_pylist(), matrix(batch.column(1)), block)
        yield from best.hits(qids)

    return top_by_query(points.select("id", "vector").where("vector IS NOT NULL").mapInArrow(run, HITS), k)


def completed(found: DataFrame, points: DataFrame, queries: list[tuple[object, Sequence[float]]], k: int, metric: Metric) -> DataFrame:
    """qid, id, score and rank: what an approximate search has found (qid, id, score),
    and what it missed.  Its k-th score is the floor of a scan of all points, which
    only gives rows from there on.  The rows found (k a query) go through the driver."""
    spark = points.sparkSession
    held = found.select("qid", "id", "score").toArrow()
    scores: dict[str, list[float]] = {}
    for qid, score in zip(held.column("qid").to_pylist(), held.column("score").to_pylist()):
        scores.setdefault(qid, []).append(score)
    # scores of columns and of products are the same sums; a floor just below is safe in any case
    floors = {qid: min(s) - 1e-9 * max(1.0, abs(min(s))) for qid, s in scores.items() if len(s) >= k}
    rest = batch_gemm(points, queries, k, metric, floors=floors).select("qid", "id", "score")
    known = spark.createDataFrame(held) if held.num_rows else found.select("qid", "id", "score").limit(0)
    return top_by_query(known.unionByName(rest).groupBy("qid", "id").agg(F.max("score").alias("score")), k)


HITS = "qid string, id string, score double"


def _hits(qids: list[str], at: int, ids: pa.Array, scores: np.ndarray, k: int) -> pa.RecordBatch:
    """What may be among the k best of scores (rows by queries, of which the first is number ``at``)."""
    row, col = np.nonzero(best_of_batch(scores, k))
    return pa.RecordBatch.from_arrays([pa.array([qids[at + c] for c in col.tolist()], pa.string()), ids.take(pa.array(row)), pa.array(scores[row, col].astype(np.float64))], ["qid", "id", "score"])


# Quantised search.


def round_half_away(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)  # in singles the sum with a half would be rounded up just below it
    return np.sign(x) * np.floor(np.abs(x) + 0.5)


def quantize_array(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes, scales and squared norms of the rows of a matrix."""
    x32 = x.astype(np.float32)
    most = np.abs(x32).max(axis=1, initial=0).astype(np.float32)
    scale = np.where(most > 0, most / np.float32(127), np.float32(1))
    codes = np.clip(round_half_away(x32 / scale[:, None]), -127, 127).astype(np.int8)
    squared = (codes.astype(np.int64) ** 2).sum(axis=1) * scale.astype(np.float64) ** 2
    return codes, scale, squared


def with_codes(points: DataFrame, keep: bool = False) -> DataFrame:
    """Points with their codes (binary), scale and squared norm, for the scan of
    candidates; with ``keep`` next to all their columns, null where there is no vector."""
    points = points if keep else points.select("id", "vector")
    held = [f for f in points.schema.fields if keep or f.name == "id"]

    def run(batches):
        for batch in batches:
            vectors = batch.column(batch.schema.get_field_index("vector"))
            has = vectors.is_valid()
            x = matrix(vectors.filter(has))
            codes, scale, squared = quantize_array(x) if len(x) else (np.empty((0, 0), np.int8), np.empty(0, np.float32), np.empty(0))
            there = has.to_numpy(zero_copy_only=False)
            place = pa.array(np.cumsum(there) - 1, mask=~there)
            made = [pa.array([row.tobytes() for row in codes], pa.binary()), pa.array(scale, pa.float32()), pa.array(squared, pa.float64())]
            yield pa.RecordBatch.from_arrays([*[batch.column(batch.schema.get_field_index(f.name)) for f in held], *[c.take(place) for c in made]], [*[f.name for f in held], "codes", "scale", "squared"])

    return points.mapInArrow(run, T.StructType([*held, *CODES.fields]))


def candidates_int8(coded: DataFrame, queries: list[tuple[object, Sequence[float]]], n: int, metric: Metric, block: int = QUERY_BLOCK) -> DataFrame:
    """qid, id and score by codes of the n best candidates of each query; reads codes only."""
    prepared = [(str(qid), prepare_query(q, metric)) for qid, q in queries]
    shared = coded.sparkSession.sparkContext.broadcast(([qid for qid, _ in prepared], quantize_array(np.stack([q for _, q in prepared]))))

    def run(batches):
        qids, (q_codes, q_scale, q_squared) = shared.value
        # products of up to 127^2 a component: sums of 1,024 of them are exact in floats, of 2^39 in doubles
        kind = np.float32 if q_codes.shape[1] <= 1024 else np.float64
        q_codes = q_codes.astype(kind)
        for batch in batches:
            if not batch.num_rows:
                continue
            codes = np.frombuffer(b"".join(batch.column(1).to_pylist()), dtype=np.int8).reshape(batch.num_rows, -1).astype(kind)
            scale = batch.column(2).to_numpy().astype(np.float64)
            squared = batch.column(3).to_numpy()
            for at in range(0, len(q_codes), block):
                some = slice(at, at + block)
                product = (codes @ q_codes[some].T).astype(np.float64) * scale[:, None] * q_scale[some].astype(np.float64)
                if metric == Metric.COSINE:
                    lengths = np.sqrt(squared[:, None] * q_squared[some])
                    product = np.divide(product, lengths, out=np.zeros_like(product), where=lengths > 0)
                elif metric == Metric.EUCLIDEAN:
                    product = -np.maximum(0.0, squared[:, None] + q_squared[some] - 2 * product)
                yield _hits(qids, at, batch.column(0), product, n)

    return top_by_query(coded.select("id", "codes", "scale", "squared").mapInArrow(run, HITS), n)


#: Candidates that are broadcast at most; more are dealt out with the points' vectors.
BROADCAST_CANDIDATES = 1_000_000


def rescore(candidates: DataFrame, points: DataFrame, queries: list[tuple[object, Sequence[float]]], k: int, metric: Metric, width: int | None = None) -> DataFrame:
    """The k best of each query among candidates (qid, id), by full-precision scores;
    ``width`` is how many candidates a query has at most, if that is known."""
    rows = [(str(qid), prepare_query(q, metric).tolist()) for qid, q in queries]
    q = points.sparkSession.createDataFrame(rows, "qid string, query array<double>")
    wanted = candidates.select("qid", "id").distinct()
    if width is not None and width * len(rows) <= BROADCAST_CANDIDATES:
        wanted = F.broadcast(wanted)
    held = points.select("id", "vector").join(wanted, "id").join(F.broadcast(q), "qid")
    return top_by_query(held.select("qid", "id", V.score(metric, F.col("vector"), F.col("query")).alias("score")), k)


def ann_int8(points: DataFrame, queries: list[tuple[object, Sequence[float]]], k: int, metric: Metric, oversample: int = 4, coded: DataFrame | None = None) -> DataFrame:
    """Candidates by codes, ``oversample`` times as many as asked for, rescored in full."""
    coded = with_codes(points) if coded is None else coded
    return rescore(candidates_int8(coded, queries, oversample * k, metric), points, queries, k, metric, oversample * k)


# Search by cells.


def fit_cells(points: DataFrame, cells: int, seed: int = 1, sample_rows: int = 100_000) -> list[list[float]]:
    """Centres of k-means over at most ``sample_rows`` points, those whose hashed id comes first."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    sample = points.orderBy(F.xxhash64("id"), "id").limit(sample_rows)
    fitted = KMeans(k=cells, seed=seed, maxIter=20, featuresCol="features").fit(sample.select(array_to_vector(F.col("vector").cast("array<double>")).alias("features")))
    return [c.tolist() for c in fitted.clusterCenters()]


def with_cell(points: DataFrame, centres: list[list[float]]) -> DataFrame:
    """Points with the number of their nearest centre, every row of them."""
    shared = points.sparkSession.sparkContext.broadcast(np.array(centres))

    def run(batches):
        c = shared.value
        lengths = (c**2).sum(1)
        for batch in batches:
            x = matrix(batch.column(batch.schema.get_field_index("vector")))
            cell = (lengths - 2 * x @ c.T).argmin(1) if len(x) else np.empty(0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell.astype(np.int32))], [*batch.schema.names, "cell"])

    return points.mapInArrow(run, T.StructType([*points.schema.fields, T.StructField("cell", T.IntegerType())]))


def nearest_cells(centres: list[list[float]], q: np.ndarray, probes: int) -> np.ndarray:
    return np.argsort(((np.array(centres) - q) ** 2).sum(1), kind="stable")[:probes]


def ann_ivf_many(celled: DataFrame, centres: list[list[float]], queries: list[tuple[object, Sequence[float]]], k: int, metric: Metric, probes: int) -> DataFrame:
    """qid, id, score and rank of the k best of each of a stated set of queries, among
    the points of its ``probes`` nearest cells; a point is only held against the
    queries that look into its cell, and cells of no query are not read where
    ``celled`` is stored by cell."""
    prepared = [(str(qid), prepare_query(q, metric)) for qid, q in queries]
    asks: dict[int, list[int]] = {}
    for n, (_, q) in enumerate(prepared):
        for cell in nearest_cells(centres, q, probes).tolist():
            asks.setdefault(cell, []).append(n)
    shared = celled.sparkSession.sparkContext.broadcast(([qid for qid, _ in prepared], np.stack([q for _, q in prepared]), asks))

    def run(batches):
        qids, all_, asks = shared.value
        for batch in batches:
            cells = batch.column(2).to_numpy()
            for cell in np.unique(cells).tolist():
                rows = pa.array(np.flatnonzero(cells == cell))
                who = asks.get(cell, [])
                x = matrix(batch.column(1).take(rows))
                for at in range(0, len(who), QUERY_BLOCK):
                    some = who[at : at + QUERY_BLOCK]
                    yield _hits([qids[n] for n in some], 0, batch.column(0).take(rows), scores_of(metric, x, all_[some]), k)

    inside = celled.where(F.col("cell").isin(sorted(asks)))
    return top_by_query(inside.select("id", "vector", "cell").mapInArrow(run, HITS), k)


def ann_ivf(celled: DataFrame, centres: list[list[float]], query: Sequence[float], k: int, metric: Metric, probes: int, where: Filter = MatchAll()) -> DataFrame:
    """Exact search in the ``probes`` nearest cells; widened until k points are found or all cells are read."""
    q = prepare_query(query, metric)
    order = nearest_cells(centres, q, len(centres)).tolist()
    while True:
        inside = celled.where(F.col("cell").isin(order[:probes]))
        if probes >= len(order) or len(inside.where(compile_filter(where)).select("id").take(k)) >= k:
            return exact(inside, query, k, metric, where)
        probes *= 2


def merge(parts: list[DataFrame], k: int) -> DataFrame:
    """The k best of several results; an id counts once, with its best score."""
    hits = parts[0]
    for part in parts[1:]:
        hits = hits.unionByName(part)
    return top(hits.groupBy("id").agg(F.max("score").alias("score")), k)


def snapshot_and_delta(segment: DataFrame, delta: DataFrame, dirty: DataFrame, query: Sequence[float], k: int, metric: Metric, where: Filter = MatchAll()) -> DataFrame:
    """The k best of a segment without the ids changed since, and of the live changed points."""
    clean = segment.join(dirty.select("id").distinct(), "id", "left_anti")
    parts = [exact(part, query, k, metric, where).select("id", "score") for part in (clean, delta)]
    return merge(parts, k)


def recall(exact_hits: DataFrame, approximate: DataFrame) -> DataFrame:
    """Which part of the exact results (qid, id) an approximate search has found."""
    marked = approximate.select("qid", "id").distinct().withColumn("found", F.lit(1))
    n = exact_hits.select("qid", "id").join(marked, ["qid", "id"], "left").agg(F.count("*").alias("n"), F.count("found").alias("found"))
    return n.select((F.col("found") / F.greatest("n", F.lit(1))).alias("recall"))
