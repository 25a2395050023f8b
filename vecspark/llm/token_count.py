"""Token counts by rank-synchronous array merging.

The pre-tokens of a batch are held as one ragged array of symbol ids.  In each
round every pre-token finds its lowest-rank adjacent pair, and all pre-tokens
merge theirs at once; a pre-token leaves when no pair of it is in the
vocabulary.  What survives is counted.

Symbols follow the piece vocabulary of a ``sentencepiece`` BPE model: spaces
are U+2581, a text gets one in front, and a character without a piece counts
as its UTF-8 bytes.  No piece has U+2581 after another character, so a text
may be cut before every run of spaces without changing a merge.

Defined cases: null and empty texts have no tokens; texts of any length are
counted whole; repeated rows, repeated or null ids give a row each; only the
id and text columns are read.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from vecspark.llm.pairs import PairTable
from vecspark.llm.shared import by_value, opened
from vecspark.llm.text import WordMemo, keyed_text, sub_batches

SPACE = "▁"
NO_RANK = np.int64(1) << 40


def _fields(data: bytes) -> Iterator[tuple[int, object]]:
    """(number, value) of each field of a protocol-buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        key = varint()
        kind = key & 7
        if kind == 0:
            value: object = varint()
        elif kind == 2:
            n = varint()
            value, at = data[at : at + n], at + n
        elif kind == 5:
            value, at = struct.unpack_from("<f", data, at)[0], at + 4
        else:
            value, at = struct.unpack_from("<d", data, at)[0], at + 8
        yield key >> 3, value


class PieceTables:
    """Arrays made from a piece model: character ids and the ranks of pairs."""

    def __init__(self, model: bytes):
        pieces, scores = [], []
        for number, value in _fields(model):
            if number == 1:
                piece = dict(_fields(value))
                if piece.get(3, 1) == 1:  # normal pieces only
                    pieces.append(piece[1].decode())
                    scores.append(piece.get(2, 0.0))
        if any(SPACE in p.lstrip(SPACE) for p in pieces):
            raise ValueError("a piece crosses a space; texts can't be cut there")
        ids = {p: i for i, p in enumerate(pieces)}
        order = {s: r for r, s in enumerate(sorted(set(scores), reverse=True))}
        self.n = len(pieces)
        chars = [(ord(p), i) for p, i in ids.items() if len(p) == 1]
        self.char_at = np.array([c for c, _ in chars], dtype=np.int64)
        self.char_id = np.array([i for _, i in chars], dtype=np.int32)
        keys, ranks, merged = [], [], []
        for p, i in ids.items():
            for cut in range(1, len(p)):
                a, b = ids.get(p[:cut]), ids.get(p[cut:])
                if a is not None and b is not None:
                    keys.append(a * self.n + b)
                    ranks.append(order[scores[i]])
                    merged.append(i)
        self.pairs = PairTable(np.array(keys, dtype=np.int64))
        self.ranks = np.array([*ranks, NO_RANK], dtype=np.int64)
        self.merged = np.array([*merged, -1], dtype=np.int32)
        self.by_char: np.ndarray | None = None
        self.memo: WordMemo | None = None

    def symbols(self, points: np.ndarray) -> np.ndarray:
        """Piece ids of characters; -1 where there is none."""
        if self.by_char is None:
            self.by_char = np.full(0x110000, -1, dtype=np.int32)
            self.by_char[self.char_at] = self.char_id
        return self.by_char[points]

    def pair(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ranks (NO_RANK: none) and merged ids of pairs."""
        at = self.pairs.find(np.where((left < 0) | (right < 0), -2, left.astype(np.int64) * self.n + right))
        return self.ranks[at], self.merged[at]


def merge_all(tables: PieceTables, symbols: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """How many symbols of each sequence merging takes away.

    A round applies a sequence's lowest-rank pair at every place at once, left
    to right.  Where a merge would make a neighbouring pair that comes no later
    than the one applied, only the leftmost place is merged in that round, which
    is what one-by-one merging does.
    """
    gone = np.zeros(len(lengths), dtype=np.int64)
    keep = lengths > 1
    where = np.flatnonzero(keep)  # index of each live sequence
    sym = symbols[np.repeat(keep, lengths)]
    size = lengths[keep].astype(np.int64)
    if not len(size):
        return gone
    seq = np.repeat(np.arange(len(size)), size)
    last = np.zeros(len(sym), dtype=bool)
    last[np.cumsum(size) - 1] = True
    rank = np.full(len(sym), NO_RANK)
    made = np.full(len(sym), -1, dtype=np.int32)
    inner = np.flatnonzero(~last)
    rank[inner], made[inner] = tables.pair(sym[inner], sym[inner + 1])
    while len(size):
        starts = np.cumsum(size) - size
        low = np.minimum.reduceat(rank, starts)
        live = low < NO_RANK
        if not live.all():  # sequences that are done leave
            stay = live[seq]
            sym, rank, made, last = sym[stay], rank[stay], made[stay], last[stay]
            where, size, low = where[live], size[live], low[live]
            if not len(size):
                break
            seq = np.repeat(np.arange(len(size)), size)
        hit = np.flatnonzero(rank == low[seq])
        # of overlapping places, every second one from the left
        first = np.ones(len(hit), dtype=bool)
        first[1:] = hit[1:] != hit[:-1] + 1
        run = np.arange(len(hit))
        offset = run - np.maximum.accumulate(np.where(first, run, 0))
        take = hit[offset % 2 == 0]
        owner = seq[take]
        lead = np.ones(len(take), dtype=bool)
        lead[1:] = owner[1:] != owner[:-1]
        if not lead.all():
            new, bound = made[take], low[owner]
            right = np.minimum(take + 2, len(sym) - 1)
            left = np.maximum(take - 1, 0)
            after = np.where((take + 2 < len(sym)) & (seq[right] == owner), tables.pair(new, sym[right])[0], NO_RANK)
            beside = sym[left].copy()
            joined = np.zeros(len(take), dtype=bool)
            joined[1:] = take[1:] == take[:-1] + 2
            beside[1:] = np.where(joined[1:], new[:-1], beside[1:])
            before = np.where((take > 0) & (seq[left] == owner), tables.pair(beside, new)[0], NO_RANK)
            unsafe = np.zeros(len(size), dtype=bool)
            unsafe[owner[(after <= bound) | (before <= bound)]] = True
            take = take[lead | ~unsafe[owner]]
        sym[take] = made[take]
        changed = np.zeros(len(sym), dtype=bool)
        changed[take] = True
        last[take] = last[take + 1]
        stay = np.ones(len(sym), dtype=bool)
        stay[take + 1] = False
        taken = np.bincount(seq[take], minlength=len(size))
        gone[where] += taken
        size = size - taken
        sym, rank, made, last, seq, changed = sym[stay], rank[stay], made[stay], last[stay], seq[stay], changed[stay]
        rank[changed & last] = NO_RANK
        fresh = changed.copy()
        fresh[:-1] |= changed[1:]
        at = np.flatnonzero(fresh & ~last)
        rank[at], made[at] = tables.pair(sym[at], sym[at + 1])
    return gone


def count_words(tables: PieceTables, words: list[bytes]) -> list[int]:
    """Tokens of each word with one space in front."""
    texts = [SPACE + w.decode("utf-8", "replace").replace(" ", SPACE) for w in words]
    lengths = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
    points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    symbols = tables.symbols(points)
    width = 1 + (points > 0x7F) + (points > 0x7FF) + (points > 0xFFFF)
    weight = np.where(symbols < 0, width, 1)
    starts = np.cumsum(lengths) - lengths
    return (np.add.reduceat(weight, starts) - merge_all(tables, symbols, lengths)).tolist()


def words_of(text: bytes) -> list[bytes]:
    """The pre-tokens of a text, each without its own one space in front; the
    further spaces of a run stay with the word that follows them."""
    if not text:
        return []
    text = text.replace(b"\xe2\x96\x81", b" ")
    if b"  " in text or text[:1] == b" " or text[-1:] == b" ":
        return [w[1:] for w in re.findall(rb" +[^ ]+| +", b" " + text)]
    return text.split(b" ")


def token_counts(df: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 4096) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit (more than ``limit`` tokens) of each row."""
    with open(model_path, "rb") as f:
        shared = by_value(df.sparkSession, PieceTables(f.read()))

    def count(batches):
        tables = opened(shared)
        if tables.memo is None:  # later tasks use it too
            tables.memo = WordMemo(lambda words: count_words(tables, words))
        for part, texts in sub_batches(batches):
            words = [words_of(t) for t in texts]
            get = tables.memo.of(words).__getitem__
            n = [sum(map(get, w)) for w in words]
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array(map(len, texts), pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())],
                ["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )

    return keyed_text(df, id_col, text_col).mapInArrow(count, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
