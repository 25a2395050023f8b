"""Language-model scoring by prediction by partial matching of bytes.

A text is the bytes of its words, each with a space after it, then an end byte.
A byte is predicted from the ``order`` bytes before it, also across words: first
among the bytes that training documents have after that context, then, by an
escape, after one byte fewer, down to no context and at last to any byte.  An
escape has half the weight of each distinct byte that the context has had (method
D), and bytes that a longer context has had are excluded below it.  All counts are
of all training documents; a document's code length is that of its whole text.

The trie of contexts is never in one place.  Documents come in lots of a few MB.  A
lot asks for each distinct window (context and byte) that its texts have, once,
and says how often its training documents have it.  Windows go to a shard by the
last ``SHARED`` bytes of their context, so a shard has all that longer contexts
hold: it adds up the counts, scores each distinct window once, and answers the
lots.  What shorter contexts hold is a table of windows of ``SHARED`` bytes, of
which there are at most 2^24, that is broadcast.  Words are counted in the same
way, by lots that ask and word partitions that answer, so a frequent word or
window is one entry of a lot and no burden.  A lot then scores its documents.

Defined cases: null and empty texts are the end token alone; a null id is not held
out; repeated rows and ids count and are scored as documents each; without any
training document all bytes are equally likely; bytes of any kind may be part of
words; texts of any length are read whole, a long one in segments, and the code
length grows without bound; equal texts have equal scores; an empty table gives no
rows; only the id and text columns are read, so others of any name don't clash.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vecspark.llm.shared import by_value, fresh_path, opened, partitions, release, written
from vecspark.llm.text import keyed_text, sub_batches

#: The byte that stands before and after a text; it parts words, so no word has it.
EDGE = b"\n"
#: Bytes that may be predicted: neither A-Z nor white space but the space and the edge.
ALPHABET = 226
#: Windows of so many bytes have a table that every task gets.
SHARED = 3
#: Bytes of text, with 64 for each document, that are a lot: 60,000 documents at most.
LOT_BYTES = 60_000 * 64
#: Windows that are sorted at a time.
SEGMENT = 6 << 20
WORDS, WINDOWS, TEXTS, SHORT, TOTALS = range(5)


def held_out(doc_id) -> F.Column:
    """Whether crc32 of the id as text leaves 1 when divided by 5."""
    return F.coalesce(F.crc32(doc_id.cast("long").cast("string").cast("binary")) % 5 == 1, F.lit(False))


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays as compressed bytes; those of equal worth stand side by side."""
    head = np.array([len(a) for a in arrays], dtype="<u8").tobytes()
    planes = [np.ascontiguousarray(np.ascontiguousarray(a).view(np.uint8).reshape(-1, a.itemsize).T).tobytes() for a in arrays]
    return zstandard.ZstdCompressor(level=3).compress(head + b"".join(planes))


def unpack(data: bytes, *kinds: str) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(data)
    at, out = 8 * len(kinds), []
    for kind, n in zip(kinds, np.frombuffer(raw, "<u8", len(kinds)).tolist()):
        size = np.dtype(kind).itemsize
        out.append(np.ascontiguousarray(np.frombuffer(raw, np.uint8, size * n, at).reshape(size, n).T).view(kind).reshape(-1))
        at += size * n
    return out


def as_bytes(joined: bytes) -> np.ndarray:
    return np.frombuffer(joined, dtype=np.uint8)


# Windows of bytes.


def lot_windows(texts: list[bytes], order: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct pairs of a window and a text's number, as window << 16 | number
    in ascending order, and how often each occurs.  A window has the ``order`` bytes
    before a byte and the byte, which is lowest; ``texts`` end with the edge."""
    sizes = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts)) + order
    edge = EDGE * order
    flat = as_bytes(edge + edge.join(texts))
    number = np.repeat(np.arange(len(texts), dtype=np.uint16), sizes)
    found = []
    for at in range(0, len(flat) - order, SEGMENT):
        end = min(at + SEGMENT, len(flat) - order)
        code = flat[at:end].astype(np.uint64)
        for k in range(1, order + 1):
            code <<= np.uint64(8)
            code |= flat[at + k : end + k]
        code <<= np.uint64(16)
        code |= number[at + order : end + order]
        code = code[number[at:end] == number[at + order : end + order]]
        code.sort()
        first = np.flatnonzero(np.r_[True, code[1:] != code[:-1]]) if len(code) else np.empty(0, dtype=np.int64)
        found.append((code[first], np.diff(first, append=len(code))))
    if len(found) == 1:
        return found[0]
    code, count = (np.concatenate([x[k] for x in found]) for k in (0, 1))
    by = np.argsort(code, kind="stable")
    code, count = code[by], count[by]
    first = np.flatnonzero(np.r_[True, code[1:] != code[:-1]])
    return code[first], np.add.reduceat(count, first)


def runs(values: np.ndarray) -> np.ndarray:
    """Where a run of equal values starts."""
    return np.flatnonzero(np.r_[True, values[1:] != values[:-1]]) if len(values) else np.empty(0, dtype=np.int64)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(16))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(32))


def shard_of(windows: np.ndarray, order: int, shards: int) -> np.ndarray:
    """The shard of each window, by the bytes that its longer contexts share."""
    shared = (windows >> np.uint64(8)) & np.uint64((1 << 8 * min(order, SHARED)) - 1)
    return (mixed(shared) % np.uint64(shards)).astype(np.int64)


class Level:
    """What contexts of ``k`` bytes have had: windows (distinct, ascending) and their counts."""

    def __init__(self, k: int, windows: np.ndarray, n: np.ndarray):
        seen = n > 0
        self.k, self.windows, self.n = k, windows[seen], n[seen].astype(np.float64)
        context = self.windows >> np.uint64(8)
        first = runs(context)
        self.contexts = context[first]
        self.group = np.repeat(np.arange(len(first)), np.diff(first, append=len(context)))
        # the last is that of a context that isn't there
        self.all = np.append(np.bincount(self.group, self.n, len(first)), 0.0)
        self.distinct = np.append(np.bincount(self.group, minlength=len(first)), 0).astype(np.float64)

    @classmethod
    def of(cls, k: int, windows: np.ndarray, n: np.ndarray) -> Level:
        """From counts of windows of ``k`` + 1 bytes or more."""
        short, place = np.unique(windows & np.uint64((1 << 8 * (k + 1)) - 1), return_inverse=True)
        return cls(k, short, np.bincount(place, n, len(short)))

    def place(self, windows: np.ndarray, of: np.ndarray) -> np.ndarray:
        """Where ``windows`` stand in ``of``; -1: nowhere."""
        if not len(of):
            return np.full(len(windows), -1)
        at = np.minimum(np.searchsorted(of, windows), len(of) - 1)
        return np.where(of[at] == windows, at, -1)

    def counts(self, windows: np.ndarray) -> np.ndarray:
        at = self.place(windows & np.uint64((1 << 8 * (self.k + 1)) - 1), self.windows)
        return np.append(self.n, 0.0)[at]

    def context(self, windows: np.ndarray) -> np.ndarray:
        return self.place((windows >> np.uint64(8)) & np.uint64((1 << 8 * self.k) - 1), self.contexts)


def short_levels(windows: np.ndarray, n: np.ndarray, order: int) -> list[Level]:
    """The levels of less than ``SHARED`` bytes, the longest first."""
    return [Level.of(k, windows, n) for k in range(min(order, SHARED - 1), -1, -1)]


def code_lengths(windows: np.ndarray, n: np.ndarray, short: list[Level], order: int) -> np.ndarray:
    """log10 of the chance of each window's byte after its context, of all windows
    of a shard (distinct) and their counts in training documents."""
    levels = [Level.of(k, windows, n) for k in range(order, len(short) - 1, -1)] + short
    total, left = np.zeros(len(windows)), np.ones(len(windows), dtype=bool)
    distinct_above, all_above = np.zeros(len(windows)), np.zeros(len(windows))
    for level, below in zip(levels, [*levels[1:], None]):
        at = level.context(windows)
        own = level.counts(windows)
        all_, distinct = level.all[at] - all_above, level.distinct[at] - distinct_above
        some = left & (distinct > 0)
        hit, miss = some & (own > 0), some & (own == 0)
        total[hit] += np.log10((own[hit] - 0.5) / all_[hit])
        total[miss] += np.log10(0.5 * distinct[miss] / all_[miss])
        left &= ~hit
        if below is not None:
            excluded = np.append(np.bincount(level.group, below.counts(level.windows), len(level.contexts)), 0.0)
            all_above = excluded[at]
        distinct_above = level.distinct[at]
    total[left] -= np.log10(ALPHABET - distinct_above[left])
    return total


# Lots ask, shards and word partitions answer.


def asked(docs: DataFrame, order: int, parts: int) -> DataFrame:
    """(kind, p, lot, data) of ``docs`` (row, doc_id, held_out, text): what each lot
    asks the word partitions and shards, its short windows, and its texts."""

    def run(batches):
        for part, texts in sub_batches(batches, limit=LOT_BYTES):
            lot = part.column(0)[0].as_py()
            ids, held = part.column(1).to_pylist(), np.array(part.column(2).to_pylist(), dtype=bool)
            tokens = [[*t.lower().split(), b""] for t in texts]  # the end token is the empty word
            rows: list[tuple[int, int, bytes]] = []
            words = list(set().union(*tokens))
            own = np.fromiter(map(zlib.crc32, words), dtype=np.int64, count=len(words)) % parts
            by = np.argsort(own, kind="stable")
            words = [words[i] for i in by.tolist()]
            place = dict(zip(words, range(len(words))))
            sizes = np.fromiter(map(len, tokens), dtype=np.int64, count=len(tokens))
            flat = np.fromiter(map(place.__getitem__, chain.from_iterable(tokens)), dtype=np.int64, count=int(sizes.sum()))
            del place
            flat = flat << 16 | np.repeat(np.arange(len(tokens)), sizes)
            flat.sort()
            first = runs(flat)
            word, doc, count = flat[first] >> 16, flat[first] & 0xFFFF, np.diff(first, append=len(flat))
            taught = np.bincount(word, np.where(held[doc], 0, count), len(words)).astype("<u4")
            cut = np.searchsorted(own[by], np.arange(parts + 1)).tolist()
            rows += [(WORDS, p, pack(as_bytes(EDGE.join(words[a:b])), taught[a:b])) for p, (a, b) in enumerate(zip(cut, cut[1:])) if a < b]
            streams = [b" ".join(t) + EDGE for t in tokens]
            about = [np.array([i or 0 for i in ids], dtype="<i8"), np.array([(i is None) | h << 1 for i, h in zip(ids, held.tolist())], dtype="<u1"), sizes.astype("<u4")]
            lengths = np.fromiter(map(len, streams), dtype=np.int64, count=len(streams)).astype("<u8")
            texts_ = as_bytes(b"".join(streams))
            rows.append((TEXTS, 0, pack(*about, lengths, texts_, np.diff(flat[first], prepend=0).astype("<u8"), count.astype("<u4"))))
            del tokens, words, flat, first, word, doc, texts_
            pairs, count = lot_windows(streams, order)
            first = runs(pairs >> np.uint64(16))
            windows = pairs[first] >> np.uint64(16)
            taught = np.add.reduceat(np.where(held[(pairs & np.uint64(0xFFFF)).astype(np.int64)], 0, count), first)
            del pairs, count, streams
            short, at = np.unique(windows & np.uint64((1 << 8 * min(SHARED, order + 1)) - 1), return_inverse=True)
            rows.append((SHORT, 0, pack(short.astype("<u4"), np.bincount(at, taught).astype("<u8"))))
            own = shard_of(windows, order, parts)
            by = np.argsort(own, kind="stable")
            windows, taught = windows[by], taught[by].astype("<u4")
            cut = np.searchsorted(own[by], np.arange(parts + 1)).tolist()
            rows += [(WINDOWS, p, pack(np.diff(windows[a:b], prepend=np.uint64(0)), taught[a:b])) for p, (a, b) in enumerate(zip(cut, cut[1:])) if a < b]
            for at in range(0, len(rows), 64):
                some = rows[at : at + 64]
                yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in some], pa.int32()), pa.array([x[1] for x in some], pa.int32()), pa.array([lot] * len(some), pa.int64()), pa.array([x[2] for x in some], pa.binary())], ["kind", "p", "lot", "data"])
        release()

    return docs.select("row", "doc_id", "held_out", "text").mapInArrow(run, ASKED)


ASKED = "kind int, p int, lot long, data binary"


def grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[tuple]]]:
    """(first column, rows) of each run of equal values of the first column."""
    key, held = None, []
    for batch in batches:
        for row in zip(*[c.to_pylist() for c in batch.columns]):
            if held and row[0] != key:
                yield key, held
                held = []
            key = row[0]
            held.append(row)
    if held:
        yield key, held


def answer(kind: int, p: int, lot: int | None, data: bytes) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([kind], pa.int32()), pa.array([p], pa.int32()), pa.array([lot], pa.int64()), pa.array([data], pa.binary())], ["kind", "p", "lot", "data"])


def word_answers(lists: DataFrame, parts: int) -> DataFrame:
    """For each list of words the training counts of its words, and for each
    partition its totals (all tokens, distinct words)."""

    def run(batches):
        for p, rows in grouped(batches):
            counts: dict[bytes, int] = {}
            for _, _, data in rows:
                text, taught = unpack(data, "u1", "<u4")
                for w, n in zip(text.tobytes().split(EDGE), taught.tolist()):
                    counts[w] = counts.get(w, 0) + n
            for _, lot, data in rows:
                words = unpack(data, "u1", "<u4")[0].tobytes().split(EDGE)
                yield answer(WORDS, p, lot, pack(np.fromiter(map(counts.__getitem__, words), dtype="<u8", count=len(words))))
            yield answer(TOTALS, p, None, pack(np.array([sum(counts.values()), sum(n > 0 for n in counts.values())], dtype="<u8")))
        release()

    return lists.select("p", "lot", "data").repartition(parts, "p").sortWithinPartitions("p", "lot").mapInArrow(run, ASKED)


def window_answers(lists: DataFrame, short: tuple[np.ndarray, np.ndarray], order: int, parts: int) -> DataFrame:
    """For each list of windows the log10 chances of their bytes."""
    shared = by_value(lists.sparkSession, short)

    def run(batches):
        levels = None
        for p, rows in grouped(batches):
            levels = levels or short_levels(*opened(shared), order)
            found = np.empty(0, dtype=np.uint64)
            held: list[np.ndarray] = []
            for at, (_, _, data) in enumerate(rows):
                held.append(np.cumsum(unpack(data, "<u8", "<u4")[0], dtype=np.uint64))
                if sum(map(len, held)) > max(1 << 20, len(found)) or at + 1 == len(rows):
                    found, held = np.unique(np.concatenate([found, *held])), []
            n = np.zeros(len(found), dtype=np.int64)
            for _, _, data in rows:
                steps, taught = unpack(data, "<u8", "<u4")
                n[np.searchsorted(found, np.cumsum(steps, dtype=np.uint64))] += taught
            chances = code_lengths(found, n, levels, order).astype("<f4")
            for _, lot, data in rows:
                yield answer(WINDOWS, p, lot, pack(chances[np.searchsorted(found, np.cumsum(unpack(data, "<u8", "<u4")[0], dtype=np.uint64))]))
        release()

    return lists.select("p", "lot", "data").repartition(parts, "p").sortWithinPartitions("p", "lot").mapInArrow(run, ASKED)


def scored(answers: DataFrame, texts: DataFrame, order: int, parts: int, tokens: int, distinct: int) -> DataFrame:
    """The rows of all lots, from their texts and what they were answered."""
    share = float(np.log10(tokens + 0.5 * (distinct + 1)))

    def run(batches):
        for _, rows in grouped(batches):
            replies: dict[int, list] = {WORDS: [], WINDOWS: [], TEXTS: []}
            for _, kind, _, data in rows:  # in the order of kinds and partitions
                replies[kind].append(data)
            ids, flags, sizes, lengths, flat, steps, count = unpack(replies[TEXTS][0], "<i8", "<u1", "<u4", "<u8", "<u1", "<u8", "<u4")
            entry = np.cumsum(steps.astype(np.int64))  # word << 16 | document
            doc = entry & 0xFFFF
            c = np.concatenate([unpack(x, "<u8")[0] for x in replies[WORDS]]).astype(np.int64)[entry >> 16]
            known = np.bincount(doc, np.where(c > 0, count, 0), len(ids))
            base = np.bincount(doc, count * np.log10(c + 0.5), len(ids)) - sizes * share
            ends, raw = np.cumsum(lengths.astype(np.int64)), flat.tobytes()
            streams = [raw[a:b] for a, b in zip((ends - lengths.astype(np.int64)).tolist(), ends.tolist())]
            del flat, raw, c, entry, steps, doc, count
            pairs, count = lot_windows(streams, order)
            window = pairs >> np.uint64(16)
            first = runs(window)
            by = np.argsort(shard_of(window[first], order, parts), kind="stable")
            chance = np.empty(len(first))
            chance[by] = np.concatenate([unpack(x, "<f4")[0] for x in replies[WINDOWS]])
            of_pair = np.repeat(chance, np.diff(first, append=len(pairs)))
            score = np.bincount((pairs & np.uint64(0xFFFF)).astype(np.int64), of_pair * count, len(ids))
            null = (flags & 1).astype(bool)
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64(), mask=null), pa.array((flags & 2) > 0), pa.array(sizes.astype(np.int64)), pa.array(known.astype(np.int64)), pa.array(base), pa.array(score)],
                ["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score"],
            )
        release()

    both = answers.where(F.col("kind") != TOTALS).unionByName(texts)
    by_lot = both.select("lot", "kind", "p", "data").repartition(partitions(both.sparkSession), "lot").sortWithinPartitions("lot", "kind", "p")
    return by_lot.mapInArrow(run, "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double")


def short_windows(lists: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The counts of all short windows, 2^24 at most, on the driver."""

    def run(batches):
        for batch in batches:
            for data in batch.column(0):
                code, n = unpack(data.as_py(), "<u4", "<u8")
                yield pa.RecordBatch.from_arrays([pa.array(code.astype(np.int64)), pa.array(n.astype(np.int64))], ["code", "n"])

    found = lists.select("data").mapInArrow(run, "code long, n long").groupBy("code").agg(F.sum("n").alias("n")).toArrow()
    code, n = found["code"].to_numpy().astype(np.uint64), found["n"].to_numpy()
    by = np.argsort(code)
    return code[by], n[by]


def score(df: DataFrame, order: int = 5, id_col: str = "doc_id", text_col: str = "text", parts: int | None = None) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of each row.

    ``order`` is 5 at most, as a window and its document are one number.  ``parts``
    is the number of shards and of word partitions, by default a third of the
    shuffle partitions: it follows the input, and a task holds one part's lists.
    """
    if not 0 <= order <= 5:
        raise ValueError("order is 0 to 5")
    spark = df.sparkSession
    parts = parts or max(4, partitions(spark) // 3)
    docs = keyed_text(df, id_col, text_col).select(F.monotonically_increasing_id().alias("row"), "doc_id", held_out(F.col("doc_id")).alias("held_out"), "text")
    path = fresh_path(spark, "asked")
    asked(docs, order, parts).write.partitionBy("kind").parquet(path)

    def of(kind: int) -> DataFrame:
        return spark.read.schema(ASKED).option("basePath", path).parquet(path).where(F.col("kind") == kind)

    words = written(word_answers(of(WORDS), parts), "word-answers")
    # a row a partition
    totals = [unpack(bytes(r["data"]), "<u8")[0].tolist() for r in words.where(F.col("kind") == TOTALS).select("data").collect()]
    tokens, distinct = (sum(x[k] for x in totals) for k in (0, 1))
    windows = window_answers(of(WINDOWS), short_windows(of(SHORT)), order, parts)
    done = scored(words.unionByName(windows), of(TEXTS), order, parts, tokens, distinct)
    return done.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(tokens).cast("long").alias("train_tokens"), "base_score", "score")
