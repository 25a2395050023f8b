"""BPE encoding and decoding with a segment tree over adjacent pair ranks.

A pre-token of n symbols has a tree with a leaf for each adjacent pair that
holds the pair's rank and place.  The root is the leftmost lowest-rank pair;
merging it changes three leaves, each updated in logarithmic time, until the
root holds no pair.  Trees of one size are kept as the rows of a matrix, so a
step of all of them is a few array operations; a long word has a tree of plain
numbers.

Texts are handled as a ``tokenizers`` JSON file of this kind says: special
tokens are cut out of the raw text, the rest is put into NFC, lower-cased
character by character and split by the file's pattern, white space is dropped,
and bytes become symbols of which the last of a word has an end mark.  Decoding
joins the tokens with spaces, as the file has no decoder of its own.

Defined cases: null and empty texts have no ids and decode to an empty text;
texts and words of any length are encoded whole; repeated rows, repeated or
null ids give a row each; only the id and text columns are read.  Characters
newer than Unicode 15.1 may be classed otherwise than by the library.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import unicodedata

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from vecspark.llm.pairs import PairTable
from vecspark.llm.shared import by_value, opened, release
from vecspark.llm.text import WordMemo, keyed_text, sub_batches

# The characters that \s stands for in the files' patterns.
WHITE = r"\x09-\x0D\x20\x85\xA0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000"
#: Elements of the trees that are worked on at a time.
TREE_ELEMENTS = 1 << 16
#: Words of more bytes have a tree of their own, of plain numbers.
LONG_WORD = 256


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level files."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in own else chr(next(spare)) for b in range(256)]


class BpeTables:
    """What a tokenizer file of this kind says, as arrays."""

    def __init__(self, file: str):
        spec = json.loads(file)
        model = spec["model"]
        vocab, end = model["vocab"], model["end_of_word_suffix"] or ""
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        if any(t.get(k) for t in spec["added_tokens"] for k in ("single_word", "lstrip", "rstrip", "normalized")) or any(s.split() != [s] for s in self.special):
            raise ValueError("special tokens that take in white space or normalised text aren't handled")
        #: What every special token begins with; texts without it have none.
        self.opening = os.path.commonprefix(list(self.special)) if self.special else None
        self.tokens = [""] * (1 + max([*vocab.values(), *self.special.values()]))
        for token, i in [*vocab.items(), *self.special.items()]:
            self.tokens[i] = token
        self.pattern = next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        symbols = byte_symbols()
        self.inner = np.array([vocab[s] for s in symbols], dtype=np.int32)
        self.final = np.array([vocab[s + end] for s in symbols], dtype=np.int32)
        self.n = len(self.tokens)
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.keys = np.array([vocab[a] * self.n + vocab[b] for a, b in pairs], dtype=np.int64)
        self.made = np.array([vocab[a + b] for a, b in pairs], dtype=np.int32)
        self.pairs = PairTable(self.keys)
        # ranks of two bytes of which the second is (row 1) or isn't (row 0) the word's last
        second = np.stack([self.inner, self.final])
        self.first = np.stack([self.rank(np.repeat(self.inner, 256), np.tile(of, 256)) for of in second]).astype(np.int32)
        self._split: regex.Pattern | None = None
        self._ranks: dict[int, int] | None = None

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of pairs, -1 where the file has no merge or an id is negative."""
        # merges stand in the order of their ranks
        return self.pairs.find(np.where((left < 0) | (right < 0), -2, left.astype(np.int64) * self.n + right))

    def ranks(self) -> dict[int, int]:
        """The rank of each pair, by left id times the number of ids plus right id."""
        if self._ranks is None:
            self._ranks = {k: r for r, k in enumerate(self.keys.tolist())}
        return self._ranks

    def _open(self) -> None:
        self._split = regex.compile(self.pattern.replace(r"\s", WHITE), regex.V0)
        self._split_ascii = re.compile(self.pattern.replace(r"\p{L}", "a-z").replace(r"\p{N}", "0-9").encode())
        self._cut = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None

    def folded(self, text: bytes) -> bytes:
        """The text with A-Z in lower case where that touches neither a special
        token nor what a letter and a mark after it become (as with H and a line
        below): the fewer chunks there are, the fewer are encoded."""
        if self.opening is not None and self.opening.encode() in text:
            return text
        # the marks that ASCII letters may be joined with
        return text if b"\xcc" in text or b"\xcd" in text else text.lower()

    def pieces(self, chunks: list[bytes]) -> list[list[bytes | int]]:
        """Pre-tokens (UTF-8) and special ids of each chunk of text, in order; a
        chunk has no ASCII white space."""
        if self._split is None:
            self._open()
        out: list[list] = [[]] * len(chunks)
        opening = None if self.opening is None else self.opening.encode()
        wide = []
        for k, chunk in enumerate(chunks):
            if chunk.isalpha():  # ASCII letters only
                out[k] = [chunk.lower()]
            elif opening is not None and opening in chunk:
                out[k] = [x for part in self._cut.split(chunk.decode("utf-8", "replace")) if part for x in ([self.special[part]] if part in self.special else self._split_text([part])[0])]
            elif chunk.isascii():
                out[k] = self._split_ascii.findall(chunk.lower())
            else:
                wide.append(k)
        # together: no rule looks beyond a line end
        if wide:
            for k, found in zip(wide, self._split_text(b"\n".join([chunks[k] for k in wide]).decode("utf-8", "replace").split("\n"))):
                out[k] = found
        return out

    def _split_text(self, texts: list[str]) -> list[list[bytes]]:
        # character by character: no rule looks at a character's neighbours
        lower = unicodedata.normalize("NFC", "\n".join(texts)).replace("Σ", "σ").lower().split("\n")
        find = self._split.findall
        return [[t.encode()] if t.isalpha() else [p.encode() for p in find(t)] for t in lower]


def _merge_rows(tables: BpeTables, sym: np.ndarray, leaves: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Merges the rows of ``sym`` (ids, then -1 up to a power of two) to the end;
    ``leaves`` has the ranks of adjacent pairs, -1 for none.

    Returns the ids that survive, row after row, and how many each row has.
    """
    rows, size = sym.shape
    bits = size.bit_length() - 1
    kind = np.int32 if len(tables.made) << bits < 1 << 31 else np.int64
    none = np.iinfo(kind).max
    place = np.arange(size, dtype=kind)
    tree = np.full((rows, 2 * size), none, dtype=kind)
    tree[:, size:] = np.where(leaves >= 0, (leaves.astype(kind) << bits) | place, none)
    level = size
    while level > 1:
        level //= 2
        tree[:, level : 2 * level] = np.minimum(tree[:, 2 * level : 4 * level : 2], tree[:, 2 * level + 1 : 4 * level : 2])
    node_of, symbol = tree.reshape(-1), sym.reshape(-1)
    after, before = np.tile(place + 1, rows), np.tile(place - 1, rows)
    live = np.flatnonzero(tree[:, 1] < none)
    while len(live):
        base, top = live << bits, live << bits + 1
        root = node_of[top + 1]
        left = root & (size - 1)
        at = base + left
        right = after[at]
        gone = base + right
        made = tables.made[root >> bits]
        symbol[at], symbol[gone] = made, -1
        nxt = after[gone]
        after[at] = nxt
        more = nxt < size
        beside = base + np.minimum(nxt, size - 1)
        before[beside[more]] = left[more]
        prev = before[at]
        has = prev >= 0
        ahead = base + np.maximum(prev, 0)
        right_id, left_id = np.where(more, symbol[beside], -1), np.where(has, symbol[ahead], -1)
        rank = tables.rank(np.concatenate([made, left_id]), np.concatenate([right_id, made])).astype(kind)
        own, other = rank[: len(live)], rank[len(live) :]
        # three leaves change, and what stands above them
        prev = np.where(has, prev, left)
        node_of[top + size + right] = none
        node_of[top + size + prev] = np.where(other >= 0, (other << bits) | prev, none)
        node_of[top + size + left] = np.where(own >= 0, (own << bits) | left, none)
        node = np.concatenate([right, left, prev]).astype(np.int64) + size
        tops = np.tile(top, 3)
        for _ in range(bits):
            node >>= 1
            below = tops + 2 * node
            node_of[tops + node] = np.minimum(node_of[below], node_of[below + 1])
        live = live[node_of[top + 1] < none]
    alive = sym >= 0
    return sym[alive], alive.sum(axis=1)


def _merge_one(tables: BpeTables, word: bytes) -> list[int]:
    """The same for one long word, by a tree of plain numbers."""
    data = np.frombuffer(word, dtype=np.uint8)
    ids = tables.inner[data].tolist()
    ids[-1] = int(tables.final[data[-1]])
    n, size = len(ids), 1 << (len(ids) - 1).bit_length()
    ranks, width, made = tables.ranks().get, tables.n, tables.made.tolist()
    none = len(made) * size
    tree = [none] * (2 * size)
    for k in range(n - 1):
        rank = ranks(ids[k] * width + ids[k + 1])
        if rank is not None:
            tree[size + k] = rank * size + k
    for k in range(size - 1, 0, -1):
        tree[k] = min(tree[2 * k], tree[2 * k + 1])
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))

    def update(leaf: int, value: int) -> None:
        node = leaf + size
        tree[node] = value
        while node > 1:
            other = tree[node ^ 1]
            node >>= 1
            value = other if other < value else value
            if tree[node] == value:
                return
            tree[node] = value

    while tree[1] < none:
        rank, left = divmod(tree[1], size)
        right = after[left]
        nxt, prev = after[right], before[left]
        ids[left], ids[right] = made[rank], -1
        after[left] = nxt
        update(right, none)
        if nxt < n:
            before[nxt] = left
            rank = ranks(ids[left] * width + ids[nxt])
            update(left, none if rank is None else rank * size + left)
        else:
            update(left, none)
        if prev >= 0:
            rank = ranks(ids[prev] * width + ids[left])
            update(prev, none if rank is None else rank * size + prev)
    return [i for i in ids if i >= 0]


def merge_words(tables: BpeTables, words: list[bytes]) -> list[bytes]:
    """Token ids of each pre-token (UTF-8 bytes), as bytes of 32-bit numbers."""
    out: list[bytes] = [b""] * len(words)
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    for i in np.flatnonzero(lengths > LONG_WORD).tolist():
        out[i] = np.array(_merge_one(tables, words[i]), dtype="<i4").tobytes()
    bits_of = np.ceil(np.log2(np.maximum(lengths, 2))).astype(int)
    bits_of[(lengths == 0) | (lengths > LONG_WORD)] = 0
    for bits in range(1, LONG_WORD.bit_length()):
        size = 1 << bits
        chosen = np.flatnonzero(bits_of == bits)
        step = max(1, TREE_ELEMENTS // size)
        for at in range(0, len(chosen), step):
            part = chosen[at : at + step]
            n = lengths[part]
            data = np.frombuffer(b"".join([words[i] for i in part.tolist()]), dtype=np.uint8)
            row = np.repeat(np.arange(len(part)), n)
            ends = np.cumsum(n) - 1
            last = np.zeros(len(data), dtype=np.int64)
            last[ends] = 1
            col = np.arange(len(data)) - (ends + 1 - n)[row]
            sym = np.full((len(part), size), -1, dtype=np.int32)
            sym[row, col] = np.where(last, tables.final[data], tables.inner[data])
            leaves = np.full((len(part), size), -1, dtype=np.int32)
            inner = np.flatnonzero(last == 0)
            leaves[row[inner], col[inner]] = tables.first[last[inner + 1], data[inner].astype(np.int64) * 256 + data[inner + 1]]
            ids, counts = _merge_rows(tables, sym, leaves)
            raw, start = ids.astype("<i4").tobytes(), 0
            for i, end in zip(part.tolist(), (4 * np.cumsum(counts)).tolist()):
                out[i] = raw[start:end]
                start = end
    return out


class BpeEncoder:
    """Ids of texts; chunks between ASCII white space are encoded once as long as
    the memo holds them."""

    def __init__(self, tables: BpeTables, limit: int = 120_000):
        self.tables = tables
        self.chunks = WordMemo(self._chunks, limit)

    def _chunks(self, chunks: list[bytes]) -> list[bytes]:
        parts = self.tables.pieces(chunks)
        words = list({p for c in parts for p in c if isinstance(p, bytes)})
        ids: dict = dict(zip(words, self.merged(words)))
        ids |= {i: np.array([i], dtype="<i4").tobytes() for i in self.tables.special.values()}
        return [ids[c[0]] if len(c) == 1 else b"".join([ids[p] for p in c]) for c in parts]

    def merged(self, words: list[bytes]) -> list[bytes]:
        return merge_words(self.tables, words)

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """Little-endian 32-bit ids of each text."""
        parts = [self.tables.folded(t).split() for t in texts]
        get = self.chunks.of(parts).__getitem__
        return [b"".join(map(get, p)) for p in parts]


class Joiner:
    """Ids in decimal and their tokens, each with spaces between."""

    def __init__(self, tables: BpeTables):
        if any("\n" in t for t in tables.tokens):
            raise ValueError("a token has a line end")
        self.n = tables.n
        # with what follows: a space, or a line end for the last of a text
        decimal, tokens = [str(i).encode() for i in range(self.n)], [t.encode() for t in tables.tokens]
        self.decimal, self.text = (np.array([x + end for end in (b" ", b"\n") for x in of], dtype=object) for of in (decimal, tokens))

    def join(self, ids: list[bytes]) -> tuple[list[bytes], list[bytes]]:
        """The decimals and the decoded text of each text's ids."""
        sizes = np.fromiter(map(len, ids), dtype=np.int64, count=len(ids)) // 4
        flat = np.frombuffer(b"".join(ids), dtype="<i4").astype(np.int64)
        flat[np.cumsum(sizes)[sizes > 0] - 1] += self.n
        out = []
        for of in (self.decimal, self.text):
            found = iter(b"".join(of[flat].tolist()).split(b"\n"))
            out.append([next(found) if n else b"" for n in sizes.tolist()])
        return out[0], out[1]


def decode(tables: BpeTables, ids: list[int]) -> str:
    """The text of ids: their tokens with a space between each two."""
    return " ".join(tables.tokens[i] for i in ids if 0 <= i < tables.n)


def load_tables(path: str) -> BpeTables:
    with open(path, encoding="utf-8") as f:
        return BpeTables(f.read())


def encode_decode(df: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 (decimal ids joined by a space) and
    decoded_sha256 of each row; with ``keep_ids`` also ids and decoded."""
    shared = by_value(df.sparkSession, load_tables(tokenizer_path))
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>, decoded string" * keep_ids

    def run(batches):
        tables = opened(shared)
        encoder, joiner = BpeEncoder(tables), Joiner(tables)
        for part, texts in sub_batches(batches, limit=1 << 20):
            ids = encoder.encode(texts)
            decimal, decoded = joiner.join(ids)
            sha = lambda of: pa.array([hashlib.sha256(x).hexdigest() for x in of], pa.string())
            arrays = [part.column(0), pa.array([len(x) // 4 for x in ids], pa.int64()), sha(decimal), sha(decoded)]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if keep_ids:
                arrays += [pa.array([np.frombuffer(x, "<i4") for x in ids], pa.list_(pa.int32())), pa.array([x.decode() for x in decoded], pa.string())]
                names += ["ids", "decoded"]
            yield pa.RecordBatch.from_arrays(arrays, names)
        del encoder, joiner  # an idle worker holds nothing
        release()

    return keyed_text(df, id_col, text_col).mapInArrow(run, schema)
