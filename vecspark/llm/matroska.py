"""Matroska: an EBML reader that makes packet tables, and a writer for media columns.

The reader parses variable-length ids and sizes, also unknown sizes, walks
segment, clusters, simple blocks and block groups, opens the four lacings, and
gives a packet a row: track, timestamp in nanoseconds, key frame, and the byte
range of the frame.  Cues are read as a table of times and cluster positions.

The writer stores bytes as one track of 8-bit PCM samples at 8,000 a second:
frames of ``FRAME`` bytes, up to ``LACE`` of them laced into a block, up to
``BLOCKS`` blocks in a cluster, and a cue for each cluster.

Defined cases: null and empty media have no packets; a damaged or cut file
gives an error in the strict reader and ends the packets in the lenient one;
null and empty texts are stored as 64 zero bytes; repeated rows give the same
bytes; null ids stay.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vecspark.llm.text import keyed_text, sub_batches, texts_of

RATE = 8000
FRAME = 4096
LACE = 8
BLOCKS = 7

# Element ids of the Matroska specification.
EBML, SEGMENT, INFO, TRACKS, CLUSTER, CUES = 0x1A45DFA3, 0x18538067, 0x1549A966, 0x1654AE6B, 0x1F43B675, 0x1C53BB6B
DOC_TYPE, DOC_VERSION, DOC_READ_VERSION = 0x4282, 0x4287, 0x4285
TIMESTAMP_SCALE, DURATION, MUXING_APP, WRITING_APP = 0x2AD7B1, 0x4489, 0x4D80, 0x5741
TRACK_ENTRY, TRACK_NUMBER, TRACK_UID, TRACK_TYPE, CODEC_ID, FLAG_LACING, DEFAULT_DURATION = 0xAE, 0xD7, 0x73C5, 0x83, 0x86, 0x9C, 0x23E383
AUDIO, SAMPLING_FREQUENCY, CHANNELS, BIT_DEPTH = 0xE1, 0xB5, 0x9F, 0x6264
TIMESTAMP, SIMPLE_BLOCK, BLOCK_GROUP, BLOCK, BLOCK_DURATION, REFERENCE_BLOCK = 0xE7, 0xA3, 0xA0, 0xA1, 0x9B, 0xFB
CUE_POINT, CUE_TIME, CUE_TRACK_POSITIONS, CUE_TRACK, CUE_CLUSTER_POSITION = 0xBB, 0xB3, 0xB7, 0xF7, 0xF1
MASTERS_OF_UNKNOWN_SIZE = (SEGMENT, CLUSTER)
TOP_LEVEL = (INFO, TRACKS, CLUSTER, CUES, 0x114D9B74, 0x1941A469, 0x1043A770, 0x1254C367)


class MediaError(ValueError):
    """The bytes are no Matroska file, or a damaged one."""


class Packet(NamedTuple):
    track: int
    timestamp_ns: int
    keyframe: bool
    offset: int
    size: int


class Media(NamedTuple):
    doc_type: str
    scale: int
    tracks: list[dict]
    packets: list[Packet]
    cues: list[tuple[int, int, int]]  # timestamp_ns, track, position of the cluster in the file


# Reading.


def read_id(data: bytes, at: int) -> tuple[int, int]:
    """An element id with its length marker, and where it ends."""
    if at >= len(data) or not data[at]:
        raise MediaError(f"no element id at {at}")
    n = 9 - data[at].bit_length()
    if n > 4 or at + n > len(data):
        raise MediaError(f"no element id at {at}")
    return int.from_bytes(data[at : at + n], "big"), at + n


def read_vint(data: bytes, at: int) -> tuple[int | None, int]:
    """A variable-length integer without its marker (None: all ones, unknown), and where it ends."""
    if at >= len(data) or not data[at]:
        raise MediaError(f"no integer at {at}")
    n = 9 - data[at].bit_length()
    if at + n > len(data):
        raise MediaError(f"an integer is cut at {at}")
    value = int.from_bytes(data[at : at + n], "big") & (1 << 7 * n) - 1
    return (None if value == (1 << 7 * n) - 1 else value), at + n


def elements(data: bytes, at: int, end: int, parent: int = 0) -> Iterator[tuple[int, int, int]]:
    """(id, start, end) of the bodies of the elements in a range; one of unknown
    size ends where an element that can't be in it begins."""
    while at < end:
        kind, at = read_id(data, at)
        size, at = read_vint(data, at)
        if size is None:
            if kind not in MASTERS_OF_UNKNOWN_SIZE:
                raise MediaError(f"unknown size of element {kind:x}")
            stop = end
            if kind == CLUSTER:
                probe = at
                while probe < end:
                    inner, body = read_id(data, probe)
                    if inner in TOP_LEVEL:
                        break
                    length, body = read_vint(data, body)
                    if length is None:
                        break
                    probe = body + length
                stop = min(probe, end)
        else:
            stop = at + size
        if stop > end:
            raise MediaError(f"element {kind:x} is cut at {end}")
        yield kind, at, stop
        at = stop


def _uint(data: bytes) -> int:
    if len(data) > 8:
        raise MediaError("an integer has more than 8 bytes")
    return int.from_bytes(data, "big")


def _float(data: bytes) -> float:
    if len(data) not in (0, 4, 8):
        raise MediaError("a number has 0, 4 or 8 bytes")
    return struct.unpack(">d" if len(data) == 8 else ">f", data)[0] if data else 0.0


def _stamp(value: int) -> int:
    """A time that fits the columns."""
    if not -(1 << 63) <= value < 1 << 63:
        raise MediaError("a time is beyond 63 bits")
    return value


def lace_sizes(data: bytes, at: int, end: int, lacing: int) -> tuple[list[int], int]:
    """Sizes of the frames of a block and where the first begins.
    Lacing: 0 none, 1 Xiph, 2 fixed size, 3 EBML."""
    if not lacing:
        return [end - at], at
    if at >= end:
        raise MediaError("a lace is cut")
    count, at = data[at] + 1, at + 1
    sizes: list[int] = []
    if lacing == 1:
        for _ in range(count - 1):
            size = 0
            while True:
                if at >= end:
                    raise MediaError("a lace is cut")
                size, at = size + data[at], at + 1
                if data[at - 1] < 255:
                    break
            sizes.append(size)
    elif lacing == 3:
        for k in range(count - 1):
            value, to = read_vint(data, at)
            if value is None:
                raise MediaError("a lace has an unknown size")
            # after the first, differences that are centred on zero
            sizes.append(value if not k else sizes[-1] + value - ((1 << 7 * (to - at) - 1) - 1))
            at = to
    else:
        if (end - at) % count:
            raise MediaError("a lace of equal frames has a remainder")
        return [(end - at) // count] * count, at
    sizes.append(end - at - sum(sizes))
    if min(sizes) < 0:
        raise MediaError("the frames of a lace are longer than its block")
    return sizes, at


def parse(data: bytes, strict: bool = True) -> Media:
    """The tracks, packets and cues of a file.  Not strict: what stands before damage."""
    media = Media("", 1_000_000, [], [], [])
    doc_type, scale = "", 1_000_000
    raw_cues: list[tuple[int, int, int]] = []
    base = 0

    def block(at: int, end: int, time: int, key: bool | None, duration: int | None = None) -> None:
        track, at = read_vint(data, at)
        if at + 3 > end or track is None:
            raise MediaError("a block is cut")
        rel, flags = struct.unpack_from(">hB", data, at)
        sizes, at = lace_sizes(data, at + 3, end, flags >> 1 & 3)
        step = next((t.get("default_duration", 0) for t in media.tracks if t["number"] == track), 0)
        if duration is not None:
            step = duration * scale // len(sizes)
        for k, size in enumerate(sizes):
            media.packets.append(Packet(track, _stamp((time + rel) * scale + k * step), bool(flags & 0x80) if key is None else key, at, size))
            at += size

    try:
        for kind, a, b in elements(data, 0, len(data)):
            if kind == EBML:
                doc_type = next((data[c:d].rstrip(b"\0").decode("ascii", "replace") for k, c, d in elements(data, a, b) if k == DOC_TYPE), "")
            if kind != SEGMENT:
                continue
            base = a
            for top, c, d in elements(data, a, b):
                if top == INFO:
                    scale = next((_uint(data[e:f]) for k, e, f in elements(data, c, d) if k == TIMESTAMP_SCALE), scale)
                elif top == TRACKS:
                    for entry, e, f in elements(data, c, d):
                        if entry != TRACK_ENTRY:
                            continue
                        track = {"number": 0, "type": 0, "codec": "", "rate": 0.0, "channels": 1, "bits": 0, "default_duration": 0}
                        for k, g, h in elements(data, e, f):
                            if k == TRACK_NUMBER:
                                track["number"] = _uint(data[g:h])
                            elif k == TRACK_TYPE:
                                track["type"] = _uint(data[g:h])
                            elif k == CODEC_ID:
                                track["codec"] = data[g:h].rstrip(b"\0").decode("ascii", "replace")
                            elif k == DEFAULT_DURATION:
                                track["default_duration"] = _uint(data[g:h])
                            elif k == AUDIO:
                                for m, i, j in elements(data, g, h):
                                    if m == SAMPLING_FREQUENCY:
                                        track["rate"] = _float(data[i:j])
                                    elif m == CHANNELS:
                                        track["channels"] = _uint(data[i:j])
                                    elif m == BIT_DEPTH:
                                        track["bits"] = _uint(data[i:j])
                        media.tracks.append(track)
                elif top == CLUSTER:
                    time = 0
                    for k, e, f in elements(data, c, d):
                        if k == TIMESTAMP:
                            time = _uint(data[e:f])
                        elif k == SIMPLE_BLOCK:
                            block(e, f, time, None)
                        elif k == BLOCK_GROUP:
                            inner = {m: (g, h) for m, g, h in elements(data, e, f)}
                            if BLOCK in inner:
                                length = _uint(data[slice(*inner[BLOCK_DURATION])]) if BLOCK_DURATION in inner else None
                                block(*inner[BLOCK], time, REFERENCE_BLOCK not in inner, length)
                elif top == CUES:
                    for k, e, f in elements(data, c, d):
                        if k != CUE_POINT:
                            continue
                        time, places = 0, []
                        for m, g, h in elements(data, e, f):
                            if m == CUE_TIME:
                                time = _uint(data[g:h])
                            elif m == CUE_TRACK_POSITIONS:
                                own = {x: _uint(data[i:j]) for x, i, j in elements(data, g, h)}
                                places.append((own.get(CUE_TRACK, 0), own.get(CUE_CLUSTER_POSITION, 0)))
                        raw_cues += [(_stamp(time * scale), t, p) for t, p in places]
    except MediaError:
        if strict:
            raise
    return media._replace(doc_type=doc_type, scale=scale, cues=[(t, n, base + p) for t, n, p in raw_cues])


# Writing.


def vint(value: int, length: int = 0) -> bytes:
    """A variable-length integer in as few bytes as it needs, or in ``length``."""
    n = length or next(k for k in range(1, 9) if value < (1 << 7 * k) - 1)
    return (value | 1 << 7 * n).to_bytes(n, "big")


def element(kind: int, body: bytes) -> bytes:
    return kind.to_bytes((kind.bit_length() + 7) // 8, "big") + vint(len(body)) + body


def uint(kind: int, value: int) -> bytes:
    return element(kind, value.to_bytes(max(1, (value.bit_length() + 7) // 8), "big"))


def laced(frames: list[bytes], lacing: int) -> bytes:
    """The body of a block's frames under a lacing."""
    if not lacing:
        return frames[0]
    sizes = list(map(len, frames))
    if lacing == 1:
        head = b"".join(b"\xff" * (n // 255) + bytes([n % 255]) for n in sizes[:-1])
    elif lacing == 3:
        head = vint(sizes[0]) if len(sizes) > 1 else b""
        for a, b in zip(sizes, sizes[1:-1]):
            n = next(k for k in range(1, 9) if abs(b - a) < (1 << 7 * k - 1) - 1)
            head += vint(b - a + (1 << 7 * n - 1) - 1, n)
    else:
        head = b""
    return bytes([len(frames) - 1]) + head + b"".join(frames)


def mux(payload: bytes) -> bytes:
    """A file whose one track has the bytes of ``payload`` as samples."""
    header = element(EBML, element(DOC_TYPE, b"matroska") + uint(DOC_VERSION, 4) + uint(DOC_READ_VERSION, 2))
    info = element(INFO, uint(TIMESTAMP_SCALE, 1_000_000) + element(DURATION, struct.pack(">d", 1000 * len(payload) / RATE)) + element(MUXING_APP, b"column") + element(WRITING_APP, b"column"))
    audio = element(AUDIO, element(SAMPLING_FREQUENCY, struct.pack(">d", RATE)) + uint(CHANNELS, 1) + uint(BIT_DEPTH, 8))
    track = uint(TRACK_NUMBER, 1) + uint(TRACK_UID, 1) + uint(TRACK_TYPE, 2) + uint(FLAG_LACING, 1) + element(CODEC_ID, b"A_PCM/INT/LIT") + uint(DEFAULT_DURATION, FRAME * 1_000_000_000 // RATE) + audio
    parts = [info, element(TRACKS, element(TRACK_ENTRY, track))]
    at, cues = sum(map(len, parts)), []
    for start in range(0, len(payload), FRAME * LACE * BLOCKS):
        time = start * 1000 // RATE
        body = [uint(TIMESTAMP, time)]
        for first in range(start, min(len(payload), start + FRAME * LACE * BLOCKS), FRAME * LACE):
            frames = [payload[k : k + FRAME] for k in range(first, min(len(payload), first + FRAME * LACE), FRAME)]
            # one frame: none; equal frames: fixed size; else EBML
            lacing = 0 if len(frames) == 1 else 2 if len(frames[-1]) == FRAME else 3
            body.append(element(SIMPLE_BLOCK, vint(1) + struct.pack(">hB", first * 1000 // RATE - time, 0x80 | lacing << 1) + laced(frames, lacing)))
        cluster = element(CLUSTER, b"".join(body))
        cues.append(element(CUE_POINT, uint(CUE_TIME, time) + element(CUE_TRACK_POSITIONS, uint(CUE_TRACK, 1) + uint(CUE_CLUSTER_POSITION, at))))
        parts.append(cluster)
        at += len(cluster)
    return header + element(SEGMENT, b"".join([*parts, element(CUES, b"".join(cues))]))


# Columns.


def media_column(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes and media: each text, zero-padded to a positive multiple of 64, as a file."""

    def run(batches):
        for part, texts in sub_batches(batches):
            files = [mux(t + b"\0" * (64 if not t else -len(t) % 64)) for t in texts]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(map(len, texts), pa.int64()), pa.array(files, pa.binary())], ["doc_id", "n_bytes", "media"])

    return keyed_text(df, id_col, text_col).mapInArrow(run, "doc_id long, n_bytes long, media binary")


def packet_table(df: DataFrame, id_col: str = "doc_id", media_col: str = "media", strict: bool = False) -> DataFrame:
    """doc_id, packet, track, timestamp_ns, keyframe, offset and size of each packet."""

    def run(batches):
        for batch in batches:
            for doc, data in zip(batch.column(0), texts_of(batch.column(1))):
                found = parse(data, strict).packets
                columns = list(zip(*found)) or [(), (), (), (), ()]
                kinds = (pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array([doc.as_py()] * len(found), pa.int64()), pa.array(range(len(found)), pa.int64()), *[pa.array(c, k) for c, k in zip(columns, kinds)]], ["doc_id", "packet", "track", "timestamp_ns", "keyframe", "offset", "size"])

    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(media_col).cast("binary").alias("media"))
    return rows.mapInArrow(run, "doc_id long, packet long, track long, timestamp_ns long, keyframe boolean, offset long, size long")


def feature(media: Media, payload: bytes) -> str:
    """Packets, cues, duration, mean level, and zero crossings of the samples read back."""
    samples = np.frombuffer(payload, dtype=np.uint8)
    signs = samples >= 128
    return f"packets={len(media.packets)} cues={len(media.cues)} ms={len(payload) * 1000 // RATE} sum={int(samples.sum(dtype=np.int64))} crossings={int((signs[1:] != signs[:-1]).sum())}"


def media_features(media: DataFrame) -> DataFrame:
    """What ``media`` (doc_id, n_bytes, media) holds, from its stored bytes."""

    def run(batches):
        for part, files in sub_batches(batches, "media"):
            cols: list[list] = [[] for _ in range(6)]
            for data in files:
                found = parse(data)
                payload = b"".join([data[p.offset : p.offset + p.size] for p in found.packets])
                values = (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(data), hashlib.sha256(data).hexdigest(), feature(found, payload))
                for col, value in zip(cols, values):
                    col.append(value)
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *[pa.array(c, k) for c, k in zip(cols, kinds)]], ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])

    return media.mapInArrow(run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
