"""Graph indexes: a layered small-world graph for each partition of the points.

A partition's graph is built in one task over the points that hash to it and kept
as a row with a binary column; a search goes through the graphs in parallel,
takes the nearest of each, and rescores the union in full precision.  The number
of partitions (``parts_for``) bounds what a task holds and does.  Builds are deterministic: points come in
the order of their ids, and a point's level comes from its id.
"""

from __future__ import annotations

import heapq
import io
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vecspark.functions.vectors import shard_of
from vecspark.model import InvalidArgument, Metric
from vecspark.operators import search

# The FNV-1a hash, and how a hash becomes the next one of a node's levels.
FNV_BASIS, FNV_PRIME = 0xCBF29CE484222325, 0x100000001B3
LEVEL_TURN, LEVEL_FACTOR = 17, 0x9E3779B97F4A7C15
MAX_LEVEL = 32
#: Nodes that are linked at a time, and points of a partition, about: the work on a
#: partition is bounded by their square.
LOT, PART_POINTS = 256, 25_000


class Graph:
    """Vectors as rows of a matrix, and for each level each node's neighbours."""

    def __init__(self, ids: list[str], x: np.ndarray, metric: Metric, m: int = 16, ef_construction: int = 200):
        if m < 2 or ef_construction < m:
            raise InvalidArgument("m is at least 2 and ef_construction at least m")
        self.ids, self.x, self.metric, self.m = ids, np.ascontiguousarray(x, dtype=np.float32), metric, m
        tops = np.array([self._level(node) for node in range(len(ids))], dtype=np.int64)
        self.start = int(tops.argmax()) if len(ids) else -1
        self.levels: list[dict[int, list[int]]] = [self._link(np.flatnonzero(tops >= level), m * (2 if level == 0 else 1), ef_construction) for level in range(int(tops.max(initial=-1)) + 1)]

    def scores(self, q: np.ndarray, nodes: list[int]) -> np.ndarray:
        x = self.x[nodes]
        return -((x - q) ** 2).sum(axis=1) if self.metric == Metric.EUCLIDEAN else x @ q

    def _level(self, node: int) -> int:
        """How many levels above the lowest a node is on: as often in a row as its
        id's hash, mixed again each time, is among the lowest m-th of all hashes."""
        word = (1 << 64) - 1
        h = FNV_BASIS
        for octet in self.ids[node].encode():
            h = (h ^ octet) * FNV_PRIME & word
        for level in range(MAX_LEVEL):
            if h >= max(1, word // self.m):
                return level
            turned = h << LEVEL_TURN | h >> 64 - LEVEL_TURN
            h = (turned & word) * LEVEL_FACTOR & word
        return MAX_LEVEL

    def _beam(self, q: np.ndarray, starts: list[int], width: int, level: int) -> list[tuple[float, int]]:
        """The ``width`` nearest nodes that a best-first walk finds, nearest first."""
        links = self.levels[level]
        first = self.scores(q, starts).tolist()
        seen = set(starts)
        open_ = [(-s, n) for s, n in zip(first, starts)]
        heapq.heapify(open_)
        held = [(s, -n) for s, n in zip(first, starts)]
        heapq.heapify(held)
        while open_:
            s, node = heapq.heappop(open_)
            if len(held) >= width and -s < held[0][0]:
                break
            fresh = [n for n in links.get(node, ()) if n not in seen]
            if not fresh:
                continue
            seen.update(fresh)
            for s, n in zip(self.scores(q, fresh).tolist(), fresh):
                if len(held) < width or s > held[0][0]:
                    heapq.heappush(open_, (-s, n))
                    heapq.heappush(held, (s, -n))
                    if len(held) > width:
                        heapq.heappop(held)
        return sorted(((s, -n) for s, n in held), key=lambda x: (-x[0], x[1]))

    def _pool(self, rows: np.ndarray, before: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """The ``width`` nearest of ``before`` for each of the rows that end it, which
        only see what comes before themselves: places and scores, nearest first."""
        x, y = self.x[rows], self.x[before]
        scores = x @ y.T
        if self.metric == Metric.EUCLIDEAN:
            scores = 2 * scores - (y * y).sum(axis=1) - (x * x).sum(axis=1)[:, None]
        first = len(before) - len(rows)
        scores[:, first:][np.triu_indices(len(rows))[0], np.triu_indices(len(rows))[1]] = -np.inf
        width = min(width, len(before))
        place = np.argpartition(-scores, width - 1, axis=1)[:, :width]
        held = np.take_along_axis(scores, place, axis=1)
        order = np.lexsort((place, -held))
        return before[np.take_along_axis(place, order, axis=1)], np.take_along_axis(held, order, axis=1)

    def _spread(self, pool: np.ndarray, scores: np.ndarray, most: int) -> list[list[int]]:
        """Neighbours in unlike directions of many nodes, each with its pool, nearest
        first (a score of minus infinity: no node): one that is nearer to a chosen one
        than to the node waits, and fills up what is left."""
        free = np.isfinite(scores)
        there, chosen, x = free.copy(), np.zeros_like(free), self.x[pool]
        squares = (x * x).sum(axis=2) if self.metric == Metric.EUCLIDEAN else None
        rows = np.arange(len(pool))
        for _ in range(most):
            rows = rows[free[rows].any(axis=1)]
            if not len(rows):
                break
            next_ = free[rows].argmax(axis=1)
            chosen[rows, next_] = True
            free[rows, next_] = False
            near = np.matmul(x[rows], x[rows, next_][:, :, None])[:, :, 0]
            if squares is not None:
                near = 2 * near - squares[rows] - squares[rows, next_][:, None]
            free[rows] &= scores[rows] > near
        # what waits comes after what is chosen, each nearest first
        rank = np.argsort(np.where(chosen, 0, np.where(there, 1, 2)), axis=1, kind="stable")[:, :most]
        nodes, kept = np.take_along_axis(pool, rank, axis=1), np.take_along_axis(there, rank, axis=1)
        return [row[some].tolist() for row, some in zip(nodes, kept)]

    def _link(self, nodes: np.ndarray, most: int, width: int) -> dict[int, list[int]]:
        """Neighbours on one level.  A node takes its own from the nodes before it, of
        which the nearest are found by products of matrices; those it chose may choose
        it in turn, and of all that a node has by then ``most`` stay."""
        links: dict[int, list[int]] = {}
        for at in range(0, len(nodes), LOT):
            rows = nodes[at : at + LOT]
            links.update(zip(rows.tolist(), self._spread(*self._pool(rows, nodes[: at + len(rows)], width), most)))
        a = np.repeat(nodes, [len(links[n]) for n in nodes.tolist()])
        b = np.array([n for node in nodes.tolist() for n in links[node]], dtype=np.int64)
        a, b = np.concatenate([a, b]), np.concatenate([b, a])
        score = np.concatenate([self._pairs(a[n : n + 65_536], b[n : n + 65_536]) for n in range(0, len(a), 65_536)] or [np.empty(0, np.float32)])
        order = np.lexsort((b, -score, a))
        a, b, score = a[order], b[order], score[order]
        rank = np.arange(len(a)) - np.searchsorted(a, a)
        few = rank < width
        a, b, score, rank = a[few], b[few], score[few], rank[few]
        for at in range(0, len(nodes), LOT):
            rows = nodes[at : at + LOT]
            some = slice(np.searchsorted(a, rows[0]), np.searchsorted(a, rows[-1], "right"))
            if some.start == some.stop:
                continue
            wide = int(rank[some].max()) + 1
            pool, scores = np.zeros((len(rows), wide), dtype=np.int64), np.full((len(rows), wide), -np.inf, dtype=np.float32)
            place = np.searchsorted(rows, a[some])
            pool[place, rank[some]], scores[place, rank[some]] = b[some], score[some]
            links.update(zip(rows.tolist(), self._spread(pool, scores, most)))
        return links

    def _pairs(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        x, y = self.x[a], self.x[b]
        return -((x - y) ** 2).sum(axis=1) if self.metric == Metric.EUCLIDEAN else (x * y).sum(axis=1)

    def nearest(self, q: np.ndarray, k: int, ef: int) -> list[tuple[str, float]]:
        if self.start < 0:
            return []
        at = [self.start]
        for level in range(len(self.levels) - 1, 0, -1):
            at = [self._beam(q, at, 1, level)[0][1]]
        return [(self.ids[n], s) for s, n in self._beam(q, at, max(ef, k), 0)[:k]]

    def pack(self) -> bytes:
        out = io.BytesIO()
        nodes = [np.array(sorted(level), dtype=np.int32) for level in self.levels]
        links = {}
        for k, level in enumerate(self.levels):
            links[f"n{k}"] = nodes[k]
            links[f"c{k}"] = np.array([len(level[n]) for n in nodes[k].tolist()], dtype=np.int32)
            links[f"l{k}"] = np.array([x for n in nodes[k].tolist() for x in level[n]], dtype=np.int32)
        ids = [i.encode() for i in self.ids]
        np.savez(out, x=self.x, ids=np.frombuffer(b"".join(ids), dtype=np.uint8), ends=np.cumsum([0, *map(len, ids)]), head=np.array([self.m, self.start, len(self.levels)]), **links)
        return out.getvalue()

    @classmethod
    def unpack(cls, data: bytes, metric: Metric) -> Graph:
        held = np.load(io.BytesIO(data))
        out = cls.__new__(cls)
        out.m, out.start, levels = held["head"].tolist()
        text, ends = held["ids"].tobytes(), held["ends"].tolist()
        out.ids, out.x, out.metric = [text[a:b].decode() for a, b in zip(ends, ends[1:])], held["x"], metric
        out.levels = []
        for k in range(levels):
            ends = np.cumsum(held[f"c{k}"])[:-1]
            out.levels.append(dict(zip(held[f"n{k}"].tolist(), (x.tolist() for x in np.split(held[f"l{k}"], ends)))))
        return out


def parts_for(points: int, least: int = 2) -> int:
    """As many partitions as keep each near ``PART_POINTS``."""
    return max(least, -(-points // PART_POINTS))


def build(points: DataFrame, metric: Metric, parts: int, m: int = 16, ef_construction: int = 200) -> DataFrame:
    """part, points and graph (binary) of each partition of prepared points."""

    def run(key, table):
        rows = sorted(zip(table.column("id").to_pylist(), range(table.num_rows)))
        x = search.matrix(table.column("vector").combine_chunks())[[k for _, k in rows]]
        graph = Graph([i for i, _ in rows], x, metric, m, ef_construction)
        return pa.table({"part": pa.array([key[0].as_py()], pa.int32()), "points": pa.array([len(rows)], pa.int64()), "graph": pa.array([graph.pack()], pa.binary())})

    dealt = points.select("id", F.col("vector").cast("array<float>").alias("vector"), shard_of(F.col("id"), parts).alias("part"))
    # a task a partition: by hash, some tasks would build several graphs
    return dealt.repartitionById(parts, "part").groupBy("part").applyInArrow(run, "part int, points long, graph binary")


def ann(graphs: DataFrame, points: DataFrame, queries: list[tuple[object, Sequence[float]]], k: int, metric: Metric, ef: int | None = None) -> DataFrame:
    """qid, id, score and rank: the k nearest that the graphs find, rescored in full."""
    width = max(ef or 0, 4 * k, 96)
    prepared = [(str(qid), search.prepare_query(q, metric).astype(np.float32)) for qid, q in queries]
    shared = points.sparkSession.sparkContext.broadcast(prepared)

    def run(batches):
        for batch in batches:
            for data in batch.column(0):
                graph = Graph.unpack(data.as_py(), metric)
                found = [(qid, i, float(s)) for qid, q in shared.value for i, s in graph.nearest(q, k, width)]
                yield pa.RecordBatch.from_arrays([pa.array([x[j] for x in found], t) for j, t in enumerate((pa.string(), pa.string(), pa.float64()))], ["qid", "id", "score"])

    found = search.top_by_query(graphs.select("graph").mapInArrow(run, "qid string, id string, score double"), 4 * k)
    return search.rescore(found, points, queries, k, metric, 4 * k)


def statistics(graphs: DataFrame) -> DataFrame:
    """part, nodes, layers, links and bytes of each graph."""

    def run(batches):
        for batch in batches:
            for part, data in zip(batch.column(0), batch.column(1)):
                data = data.as_py()
                graph = Graph.unpack(data, Metric.DOT)
                links = sum(len(to) for level in graph.levels for to in level.values())
                values = (len(graph.ids), len(graph.levels), links, len(data))
                yield pa.RecordBatch.from_arrays([pa.array([part.as_py()], pa.int32()), *[pa.array([v], pa.int64()) for v in values]], ["part", "nodes", "layers", "links", "bytes"])

    return graphs.select("part", "graph").mapInArrow(run, "part int, nodes long, layers long, links long, bytes long")
