"""Token ids in files of compressed bit or byte planes.

A frame has a fixed head, a table of its documents, an index of its
chunks, and the chunks.  Ids are dealt into blocks of a fixed number; a block is
transposed into 4 byte planes (or 32 bit planes), so that the planes of high
bits are nearly constant, and each plane is one zstandard chunk that can be read
alone.  A plane of zeros takes no chunk.

Frame, integers big-endian::

    magic "PLN1" | shard u32 | frame u32 | documents u64 | ids u64 |
    ids in a block u32 | planes u8 | length of the document table u32 |
    document table (zstandard: ids present u8, doc_ids i64, counts u64) |
    chunk index (per block and plane: offset u64, length u32) | chunks | crc32 u32

Frames are the rows of a Parquet table next to their numbers and check sums, so
commits, retries and any file system work as for other tables.  A manifest,
written last, has for each frame how many ids are before it; a reader holds the
frames against it, so lost or foreign files are an error.

Defined cases: null and empty texts hold the end id alone; a document is never
split between frames, so a frame is at least as long as its longest document;
equal doc_ids stand in the order of their texts, null doc_ids come first; an
empty table gives no rows; only the id and text columns are read, so others of
any name don't clash.
"""

from __future__ import annotations

import json
import os
import struct
import unicodedata
import zlib
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from vecspark.llm.bpe import BpeEncoder, BpeTables, byte_symbols
from vecspark.llm.shared import by_value, fresh_path, opened, partitions, release
from vecspark.llm.text import keyed_text, sub_batches

HEAD = ">4sIIQQIBI"
HEAD_SIZE = struct.calcsize(HEAD)
ENTRY = np.dtype([("offset", ">u8"), ("length", ">u4")])
MAGIC = b"PLN1"
#: What the table of frames and the manifest say of a frame.
ABOUT = ("shard", "frame", "documents", "ids", "crc")
#: Words that the library gets as one text.
WORDS_A_TEXT = 200


def to_planes(ids: np.ndarray, planes: int) -> list[bytes]:
    """The planes of a block of unsigned 32-bit ids, lowest first."""
    as_bytes = np.ascontiguousarray(ids, dtype="<u4").view(np.uint8).reshape(-1, 4)
    if planes == 4:
        return [np.ascontiguousarray(as_bytes[:, k]).tobytes() for k in range(4)]
    bits = np.unpackbits(as_bytes, axis=1, bitorder="little")
    return [np.packbits(bits[:, k]).tobytes() for k in range(32)]


def from_planes(planes: list[bytes | None], n: int) -> np.ndarray:
    """The ids of a block from its planes; None is a plane of zeros."""
    if len(planes) == 4:
        out = np.zeros((n, 4), dtype=np.uint8)
        for k, p in enumerate(planes):
            if p is not None:
                out[:, k] = np.frombuffer(p, dtype=np.uint8)
    else:
        bits = np.zeros((n, 32), dtype=np.uint8)
        for k, p in enumerate(planes):
            if p is not None:
                bits[:, k] = np.unpackbits(np.frombuffer(p, dtype=np.uint8), count=n)
        out = np.packbits(bits, axis=1, bitorder="little")
    return np.ascontiguousarray(out).view("<u4").reshape(-1)


def pack_frame(doc_ids: list[int | None], counts: list[int], ids: np.ndarray, shard: int = 0, frame: int = 0, block: int = 1 << 16, planes: int = 4, level: int = 1) -> bytes:
    """One frame of documents whose ids stand one after another in ``ids``."""
    if planes not in (4, 32):
        raise ValueError("planes is 4 (bytes) or 32 (bits)")
    zip_ = zstandard.ZstdCompressor(level=level)
    table = zip_.compress(
        np.array([d is not None for d in doc_ids], dtype=np.uint8).tobytes() + np.array([d or 0 for d in doc_ids], dtype=">i8").tobytes() + np.array(counts, dtype=">u8").tobytes()
    )
    index, chunks, at = [], [], 0
    for start in range(0, len(ids), block):
        for plane in to_planes(ids[start : start + block], planes):
            chunk = b"" if not any(plane) else zip_.compress(plane)
            index.append((at, len(chunk)))
            chunks.append(chunk)
            at += len(chunk)
    body = b"".join([struct.pack(HEAD, MAGIC, shard, frame, len(doc_ids), len(ids), block, planes, len(table)), table, np.array(index, dtype=ENTRY).tobytes(), *chunks])
    return body + struct.pack(">I", zlib.crc32(body))


class Frame:
    """A frame opened for reading; blocks are decompressed when asked for."""

    def __init__(self, data: bytes):
        magic, self.shard, self.frame, docs, self.n, self.block, self.planes, table = struct.unpack_from(HEAD, data)
        if magic != MAGIC:
            raise ValueError("not a frame of token ids")
        self.unzip = zstandard.ZstdDecompressor()
        at = HEAD_SIZE
        raw = self.unzip.decompress(data[at : at + table])
        has = np.frombuffer(raw, np.uint8, docs)
        ids = np.frombuffer(raw, ">i8", docs, docs).tolist()
        self.doc_ids = [d if h else None for d, h in zip(ids, has)]
        self.counts = np.frombuffer(raw, ">u8", docs, 9 * docs).astype(np.int64)
        at += table
        blocks = -(-self.n // self.block)
        self.index = np.frombuffer(data, ENTRY, blocks * self.planes, at).reshape(blocks, self.planes)
        self.start = at + self.index.nbytes
        end = self.start + int(self.index["length"].sum())
        if struct.unpack_from(">I", data, end)[0] != zlib.crc32(data[:end]):
            raise ValueError("a frame of token ids is damaged")
        self.data = data

    def read_block(self, k: int) -> np.ndarray:
        n = min(self.block, self.n - k * self.block)
        planes = []
        for offset, length in self.index[k].tolist():
            at = self.start + offset
            planes.append(self.unzip.decompress(self.data[at : at + length]) if length else None)
        return from_planes(planes, n)

    def ids(self) -> np.ndarray:
        return np.concatenate([self.read_block(k) for k in range(len(self.index))] or [np.empty(0, "<u4")])


class Encoder(BpeEncoder):
    """The library's encoding of text, of which its BPE model is asked once for
    each distinct pre-token as long as the memo holds it: white space touches no
    id, so pre-tokens are encoded many to a text, with spaces between."""

    def __init__(self, file: str, limit: int = 400_000):
        self.file, self.tokenizer = file, None
        super().__init__(BpeTables(file), limit)

    def __getstate__(self):
        return {"file": self.file, "limit": self.chunks.limit}

    def __setstate__(self, state):
        self.__init__(**state)

    def _open(self) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        spec = json.loads(self.file)
        self.tokenizer = Tokenizer.from_str(self.file)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        end = spec["model"]["end_of_word_suffix"]
        self.ends = np.array([bool(end) and t.endswith(end) for t in self.tables.tokens])
        self.symbols = dict(enumerate(byte_symbols()))

    def merged(self, words: list[bytes]) -> list[bytes]:
        if self.tokenizer is None:
            self._open()
        out: list[bytes] = [b""] * len(words)
        # what NFC would change after lower-casing, and what isn't text by itself, goes to the model
        plain, rest = [], []
        for k, w in enumerate(words):
            (plain if w.isascii() or unicodedata.is_normalized("NFC", w.decode("utf-8", "replace")) else rest).append(k)
        texts = [b" ".join([words[k] for k in plain[at : at + WORDS_A_TEXT]]).decode("utf-8", "replace") for at in range(0, len(plain), WORDS_A_TEXT)]
        for at in range(0, len(texts), 64):
            found = [np.array(e.ids, dtype="<i4") for e in self.tokenizer.encode_batch_fast(texts[at : at + 64], add_special_tokens=False)]
            ids = np.concatenate(found)
            some = plain[at * WORDS_A_TEXT : (at + 64) * WORDS_A_TEXT]
            last = 4 * (np.flatnonzero(self.ends[ids]) + 1)
            if len(last) != len(some):  # a word came apart
                rest += some
                continue
            raw, start = ids.tobytes(), 0
            for k, end in zip(some, last.tolist()):
                out[k] = raw[start:end]
                start = end
        for k in rest:
            out[k] = np.array([t.id for t in self.tokenizer.model.tokenize(words[k].decode("latin-1").translate(self.symbols))], dtype="<i4").tobytes()
        return out


def write_token_store(df: DataFrame, tokenizer_path: str, path: str | None = None, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text", frame_ids: int = 1 << 20, block: int = 1 << 16, planes: int = 4) -> str:
    """Encodes every text, adds ``end_id``, and writes frames in ascending
    doc_id order, then the manifest; gives the folder."""
    spark = df.sparkSession
    path = path or fresh_path(spark, "token-store")
    with open(tokenizer_path, encoding="utf-8") as f:
        shared = by_value(spark, Encoder(f.read()))
    end = np.array([end_id], dtype="<u4").tobytes()

    def encode(batches):
        encoder = opened(shared)  # with its memo, which later tasks use too
        shard, frame = TaskContext.get().partitionId(), 0
        docs: list[int | None] = []
        held: list[bytes] = []
        size = 0

        def flush() -> pa.RecordBatch:
            nonlocal frame, docs, held, size
            data = pack_frame(docs, [len(x) // 4 for x in held], np.frombuffer(b"".join(held), "<u4"), shard, frame, block, planes)
            about = (shard, frame, len(docs), size, zlib.crc32(data))
            frame, docs, held, size = frame + 1, [], [], 0
            return pa.RecordBatch.from_arrays([*[pa.array([x], pa.int64()) for x in about], pa.array([data], pa.binary())], [*ABOUT, "data"])

        for part, texts in sub_batches(batches, limit=2 << 20):
            for doc, ids in zip(part.column(0).to_pylist(), encoder.encode(texts)):
                if size and size + len(ids) // 4 >= frame_ids:
                    yield flush()
                docs.append(doc)
                held.append(ids + end)
                size += len(ids) // 4 + 1
        if docs:
            yield flush()
        release()

    rows = keyed_text(df, id_col, text_col).repartitionByRange(partitions(spark), "doc_id").sortWithinPartitions("doc_id", "text")
    frames = rows.mapInArrow(encode, ", ".join(f"{c} long" for c in ABOUT) + ", data binary")
    # planes are compressed already; small groups of rows, as a frame is some MB
    frames.write.option("compression", "none").option("parquet.block.size", 16 << 20).option("parquet.enable.dictionary", "false").parquet(f"{path}/frames")
    about = spark.read.schema(", ".join(f"{c} long" for c in ABOUT)).parquet(f"{path}/frames")
    # one row for each task that wrote, in their order, which is that of the doc_ids
    totals = sorted((r["shard"], r["n"]) for r in about.groupBy("shard").agg(F.sum("ids").alias("n")).collect())
    before = spark.createDataFrame([(s, sum_) for (s, _), sum_ in zip(totals, accumulate([0, *[n for _, n in totals]]))], "shard long, before long")
    earlier = F.coalesce(F.sum("ids").over(Window.partitionBy("shard").orderBy("frame").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    about.join(F.broadcast(before), "shard").select(*ABOUT, (F.col("before") + earlier).alias("start")).write.parquet(f"{path}/manifest")
    return path


def read_token_store(spark: SparkSession, path: str, keep_ids: bool = False) -> DataFrame:
    """doc_id, start (ids of all documents before), n_tokens and ids_crc32 of
    each document, from the files alone; with ``keep_ids`` also ids.

    A store whose frames aren't those of its manifest is a ValueError; a damaged
    frame fails the job that reads it.
    """
    kinds = ", ".join(f"{c} long" for c in ABOUT)
    manifest = spark.read.schema(kinds + ", start long").parquet(f"{path}/manifest")
    frames = spark.read.schema(kinds + ", data binary").parquet(f"{path}/frames")
    wrong = frames.select(*ABOUT, F.lit(1).alias("has")).unionByName(manifest.select(*ABOUT, F.lit(-1).alias("has")))
    lost = wrong.groupBy(*ABOUT).agg(F.sum("has").alias("has")).where("has <> 0")
    if not lost.isEmpty():
        raise ValueError(f"the token store {path} lacks frames or has others than its manifest")
    schema = "shard long, frame long, doc_id long, local long, n_tokens long, ids_crc32 long" + ", ids array<long>" * keep_ids

    def read(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            for shard, number, crc, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3)):
                data = content.as_py()
                frame = Frame(data)
                if (frame.shard, frame.frame, zlib.crc32(data)) != (shard, number, crc):
                    raise ValueError("a frame of token ids isn't the one of its manifest")
                ids = frame.ids().astype("<u4")
                ends = np.cumsum(frame.counts)
                starts = ends - frame.counts
                view = memoryview(ids.tobytes())
                crcs = [zlib.crc32(view[4 * a : 4 * b]) for a, b in zip(starts.tolist(), ends.tolist())]
                n = len(crcs)
                arrays = [pa.array([frame.shard] * n, pa.int64()), pa.array([frame.frame] * n, pa.int64()), pa.array(frame.doc_ids, pa.int64()), pa.array(starts), pa.array(frame.counts), pa.array(crcs, pa.int64())]
                if keep_ids:
                    arrays.append(pa.array([ids[a:b].astype(np.int64) for a, b in zip(starts, ends)], pa.list_(pa.int64())))
                yield pa.RecordBatch.from_arrays(arrays, ["shard", "frame", "doc_id", "local", "n_tokens", "ids_crc32", *["ids"] * keep_ids])
        release()

    docs = frames.select("shard", "frame", "crc", "data").mapInArrow(read, schema).join(manifest.select("shard", "frame", "start"), ["shard", "frame"])
    return docs.select("doc_id", (F.col("start") + F.col("local")).alias("start"), "n_tokens", "ids_crc32", *["ids"] * keep_ids)
