"""Toxicity by FTRL-proximal logistic regression over hashed word features.

A text's features are the 64-bit hashes of its words, of adjacent pairs and of
pairs with one word between; a feature is present or not.  Weights are learned
with per-coordinate rates, and the L1 term keeps nearly all of them at zero, so
what scoring needs is a short sorted list that is broadcast.

Learning takes a bounded sample of labelled rows, those whose hashed id comes
first (``sample_rows``); scoring takes every text whole.  Scores use the text
alone.

Defined cases: null and empty texts and texts without words score by the bias;
rows without label, or with a label for an id that has no text, teach nothing;
an id with several labels counts as toxic if one of them is; without any
labelled row every score is one half; rows of equal id teach once, by the text
that sorts first; of ids whose hashes are equal at the sample's edge the smaller
comes first; very long texts are scored and learned from whole; repeated rows and
null ids give a row each; other columns are not read, so any names are fine.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vecspark.llm.shared import by_value, opened, release
from vecspark.llm.text import keyed_text, sub_batches

WORD = rb"[0-9a-z\x80-\xff]+"
MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(31))
    x = x * MIX[1]
    return x ^ (x >> np.uint64(29))


class Hasher:
    """Word hashes, kept for the words of a bounded number of texts."""

    def __init__(self, limit: int = 100_000):
        self.known: dict[bytes, int] = {}
        self.limit = limit

    def words(self, text: bytes) -> np.ndarray:
        found = re.findall(WORD, text.lower())
        known = self.known
        if len(known) > self.limit:
            known.clear()
        digest = xxhash.xxh64_intdigest
        for w in set(found).difference(known):
            known[w] = digest(w)
        return np.fromiter(map(known.__getitem__, found), dtype=np.uint64, count=len(found))


def features(words: np.ndarray) -> np.ndarray:
    """Hashes of words, adjacent pairs and pairs with one word between."""
    one = _mixed(words + MIX[2])
    two = _mixed(words[:-1] * MIX[0] + words[1:])
    skip = _mixed(words[:-2] * MIX[2] + words[2:] * MIX[0] + MIX[1])
    return np.concatenate([one, two, skip])


def ftrl(rows: list[np.ndarray], labels: list[int], size: int, alpha: float, beta: float, l1: float, l2: float, epochs: int, seed: int) -> tuple[np.ndarray, float]:
    """Weights of ``size`` features and the bias, learned row by row."""
    z, n = np.zeros(size), np.zeros(size)
    zb = nb = 0.0

    def weights(i: np.ndarray) -> np.ndarray:
        zi = z[i]
        return np.where(np.abs(zi) <= l1, 0.0, -(zi - np.sign(zi) * l1) / ((beta + np.sqrt(n[i])) / alpha + l2))

    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        for k in rng.permutation(len(rows)):
            i = rows[k]
            w = weights(i)
            b = -zb / ((beta + math.sqrt(nb)) / alpha)
            g = 1 / (1 + math.exp(-max(-35.0, min(35.0, w.sum() + b)))) - labels[k]
            sigma = (np.sqrt(n[i] + g * g) - np.sqrt(n[i])) / alpha
            z[i] += g - sigma * w
            n[i] += g * g
            zb += g - (math.sqrt(nb + g * g) - math.sqrt(nb)) / alpha * b
            nb += g * g
    return weights(np.arange(size)), -zb / ((beta + math.sqrt(nb)) / alpha)


def frequent(rows: list[np.ndarray], least: int, shards: int = 16) -> np.ndarray:
    """The features that at least ``least`` rows have, counted a range of hashes at a time."""
    found = []
    for k in range(shards):
        low, high = np.uint64(k << 60), np.uint64((k << 60) + (1 << 60) - 1)
        # the rows are sorted
        part = np.concatenate([r[np.searchsorted(r, low) : np.searchsorted(r, high, "right")] for r in rows])
        keys, counts = np.unique(part, return_counts=True)
        found.append(keys[counts >= least])
    return np.concatenate(found)


class Model:
    """Sorted feature hashes with their weights, and the bias."""

    def __init__(self, keys: np.ndarray, weights: np.ndarray, bias: float):
        by = np.argsort(keys)
        self.keys, self.weights, self.bias = keys[by], weights[by], bias
        self.screen = np.zeros(1 << 20, dtype=bool)
        self.screen[(self.keys >> np.uint64(44)).astype(np.int64)] = True

    def score(self, text: bytes, hasher: Hasher) -> float:
        total = self.bias
        if len(self.keys):
            found = features(hasher.words(text))
            found = np.unique(found[self.screen[(found >> np.uint64(44)).astype(np.int64)]])
            at = np.minimum(np.searchsorted(self.keys, found), len(self.keys) - 1)
            total += float(self.weights[at[self.keys[at] == found]].sum())
        return 1 / (1 + math.exp(-max(-35.0, min(35.0, total))))


def held_out(doc_id) -> F.Column:
    """Whether crc32 of the id as text leaves 2 when divided by 4."""
    return F.coalesce(F.crc32(doc_id.cast("long").cast("string").cast("binary")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample_rows: int = 8000, least_rows: int = 3, alpha: float = 2.0, beta: float = 1.0, l1: float = 3.0, l2: float = 0.1, epochs: int = 10, seed: int = 11) -> Model:
    """Learns from at most ``sample_rows`` labelled rows that are not held out.

    Features that fewer than ``least_rows`` of them have are left out.  One task
    learns, as the sample is bounded; the driver gets the non-zero weights only.
    """
    given = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("y")).where(F.col("doc_id").isNotNull() & F.col("y").isin(0, 1))
    given = given.where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("y").alias("y"))
    chosen = given.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)
    text = keyed_text(docs, id_col, text_col).where("doc_id is not null")
    rows = text.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "y").agg(F.min("text").alias("text"))

    def learn(batches: Iterator[pa.RecordBatch]):
        hasher, given = Hasher(), []
        for part, texts in sub_batches(batches, limit=1 << 20):
            given += [(d, y, np.unique(features(hasher.words(t)))) for d, y, t in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), texts)]
        given.sort(key=lambda x: (x[0], x[1], len(x[2])))  # as it were in any order of arrival
        if not given:
            return
        keys = frequent([x[2] for x in given], least_rows)
        indices, truth = [], [x[1] for x in given]
        while given:  # hashes leave as soon as they are numbered
            f = given.pop()[2]
            at = np.minimum(np.searchsorted(keys, f), max(0, len(keys) - 1))
            indices.append((at[keys[at] == f] if len(keys) else at[:0]).astype(np.int32))
        indices.reverse()
        w, bias = ftrl(indices, truth, len(keys), alpha, beta, l1, l2, epochs, seed)
        kept = np.flatnonzero(w)
        del given, indices, hasher
        release()
        yield pa.RecordBatch.from_arrays(
            [pa.array([None, *keys[kept].view(np.int64).tolist()], pa.int64()), pa.array([bias, *w[kept].tolist()], pa.float64())], ["key", "weight"]
        )

    learned = rows.repartition(1).mapInArrow(learn, "key long, weight double").collect()
    bias = next((r["weight"] for r in learned if r["key"] is None), 0.0)
    pairs = [(r["key"], r["weight"]) for r in learned if r["key"] is not None]
    return Model(np.array([k for k, _ in pairs], dtype=np.int64).view(np.uint64), np.array([w for _, w in pairs], dtype=np.float64), bias)


def toxicity(df: DataFrame, model: Model, threshold: float = 0.3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score and predicted of each row."""
    shared = by_value(df.sparkSession, model)

    def run(batches):
        model, hasher = opened(shared), Hasher()
        for part, texts in sub_batches(batches, limit=1 << 20):
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([model.score(t, hasher) for t in texts], pa.float64())], ["doc_id", "score"])
        del hasher  # an idle worker holds nothing
        release()

    scored = keyed_text(df, id_col, text_col).mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_clean(df: DataFrame, model: Model, threshold: float = 0.3, text_col: str = "text") -> DataFrame:
    """The rows of ``df`` whose score is under the threshold, with all columns."""
    shared = by_value(df.sparkSession, model)

    def run(batches):
        model, hasher = opened(shared), Hasher()
        for part, texts in sub_batches(batches, text_col, limit=1 << 20):
            yield part.filter(pa.array([model.score(t, hasher) < threshold for t in texts], pa.bool_()))
        del hasher
        release()

    return df.mapInArrow(run, df.schema)
