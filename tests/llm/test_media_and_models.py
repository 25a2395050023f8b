"""Matroska files and language-model scores against plain versions."""

import hashlib
import math
import struct
import zlib
from collections import Counter

import numpy as np
import pytest

from vecspark.llm import matroska as M
from vecspark.llm import ppm


@pytest.mark.parametrize("n", [64, 128, 4096, 4160, 4096 * 8, 4096 * 8 + 64, 4096 * 61 + 64])
def test_payload_comes_back(n):
    payload = np.random.default_rng(n).integers(0, 256, n, dtype=np.uint8).tobytes()
    data = M.mux(payload)
    media = M.parse(data)
    assert b"".join(data[p.offset : p.offset + p.size] for p in media.packets) == payload
    assert media.doc_type == "matroska" and media.tracks[0]["codec"] == "A_PCM/INT/LIT" and media.tracks[0]["bits"] == 8 and media.tracks[0]["rate"] == 8000.0
    for k, p in enumerate(media.packets):
        assert (p.track, p.timestamp_ns, p.keyframe) == (1, k * 512_000_000, True)
    for time, track, place in media.cues:
        assert data[place : place + 4] == M.CLUSTER.to_bytes(4, "big") and track == 1 and time % (M.FRAME * M.LACE * M.BLOCKS * 125_000) == 0


@pytest.mark.parametrize("lacing", [1, 2, 3])
@pytest.mark.parametrize("sizes", [[5], [5, 5, 5], [300, 2, 700, 255, 254, 1], [0, 0, 3]])
def test_lacings(lacing, sizes):
    if lacing == 2:
        sizes = [7] * len(sizes)
    frames = [bytes([k]) * n for k, n in enumerate(sizes)]
    body = M.laced(frames, lacing)
    got, at = M.lace_sizes(body, 0, len(body), lacing)
    assert got == sizes and body[at:] == b"".join(frames)


def test_unknown_sizes_and_block_groups():
    unknown = b"\x01" + b"\xff" * 7
    group = M.element(M.BLOCK_GROUP, M.element(M.BLOCK, M.vint(300) + struct.pack(">hB", -5, 0) + b"abc") + M.uint(M.BLOCK_DURATION, 40) + M.element(M.REFERENCE_BLOCK, b"\x01"))
    cluster = lambda t, body: M.CLUSTER.to_bytes(4, "big") + unknown + M.uint(M.TIMESTAMP, t) + body
    data = M.element(M.EBML, M.element(M.DOC_TYPE, b"webm\0")) + M.SEGMENT.to_bytes(4, "big") + unknown + M.element(0xEC, b"void") + M.element(M.INFO, M.uint(M.TIMESTAMP_SCALE, 1000)) + cluster(100, group) + cluster(200, group)
    media = M.parse(data)
    assert media.doc_type == "webm" and [(p.track, p.timestamp_ns, p.keyframe, data[p.offset : p.offset + p.size]) for p in media.packets] == [(300, 95_000, False, b"abc"), (300, 195_000, False, b"abc")]


def test_damage():
    data = M.mux(bytes(range(256)) * 100)
    for cut in range(len(data) - 1, 40, -997):
        with pytest.raises(M.MediaError):
            M.parse(data[:cut])
        assert len(M.parse(data[:cut], strict=False).packets) <= 7
    assert M.parse(b"").packets == [] and M.parse(b"\0\0", strict=False).packets == []
    rng = np.random.default_rng(1)
    for _ in range(300):
        broken = bytearray(data)
        for at in rng.integers(0, 200, 3):
            broken[at] = int(rng.integers(256))
        M.parse(bytes(broken), strict=False)
    for _ in range(2000):  # the heads of all elements, wherever they stand
        broken = bytearray(data)
        for at in [*rng.integers(0, 300, 2), *(len(broken) - rng.integers(1, 60, 2))]:
            broken[at] = int(rng.integers(256))
        media = M.parse(bytes(broken), strict=False)
        assert all(-(1 << 63) <= x < 1 << 63 for p in media.packets for x in (p.track, p.timestamp_ns, p.offset, p.size))


@pytest.mark.parametrize("body", [M.element(M.AUDIO, M.element(M.SAMPLING_FREQUENCY, b"abc")), M.element(M.DEFAULT_DURATION, b"\x01" * 9)])
def test_numbers_of_odd_lengths(body):
    data = M.element(M.SEGMENT, M.element(M.TRACKS, M.element(M.TRACK_ENTRY, body)))
    with pytest.raises(M.MediaError):
        M.parse(data)
    assert M.parse(data, strict=False).packets == []


def test_media_columns(documents, strange, empty):
    texts = [None, "", "x", "é" * 32, "y" * 64, "long " * 9000, "x"]
    got = {r["doc_id"]: r for r in M.media_features(M.media_column(documents(texts))).collect()}
    for k, t in enumerate(texts):
        raw = (t or "").encode()
        payload = raw + b"\0" * (64 if not raw else -len(raw) % 64)
        r = got[k]
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
    assert got[2].asDict() | {"doc_id": 6} == got[6].asDict()
    table = M.packet_table(M.media_column(documents(texts))).collect()
    assert sum(r["size"] for r in table) == sum(r["payload_bytes"] for r in got.values())
    assert M.media_features(M.media_column(strange)).count() == 6 and M.media_features(M.media_column(empty)).count() == 0


def plain_scores(rows, order):
    """The model written out byte by byte."""
    tokens = {i: [*(t or "").encode().lower().split(), b""] for i, t in rows}
    held = {i: zlib.crc32(str(i).encode()) % 5 == 1 for i in tokens}
    c = Counter(w for i, ts in tokens.items() if not held[i] for w in ts)
    n, v = sum(c.values()), len(c)
    streams = {i: b"\n" * order + b" ".join(ts) + b"\n" for i, ts in tokens.items()}
    seen = {}
    for i, s in streams.items():
        if not held[i]:
            for at in range(order, len(s)):
                for o in range(order + 1):
                    seen.setdefault(s[at - o : at], Counter())[s[at]] += 1

    def chance(s, at):
        gone, p = set(), 1.0
        for o in range(order, -1, -1):
            there = {x: k for x, k in seen.get(s[at - o : at], {}).items() if x not in gone}
            if not there:
                continue
            if s[at] in there:
                return p * (there[s[at]] - 0.5) / sum(there.values())
            p *= 0.5 * len(there) / sum(there.values())
            gone |= set(there)
        return p / (226 - len(gone))

    out = {}
    for i, s in streams.items():
        base = sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in tokens[i])
        out[i] = (held[i], len(tokens[i]), sum(c[w] > 0 for w in tokens[i]), n, base, sum(math.log10(chance(s, at)) for at in range(order, len(s))))
    return out


@pytest.mark.parametrize(("order", "lot", "segment"), [(5, ppm.LOT_BYTES, ppm.SEGMENT), (3, 500, 64), (2, 100, 1 << 20), (0, 1000, 10)])
def test_scores(documents, sentences, monkeypatch, order, lot, segment):
    monkeypatch.setattr(ppm, "LOT_BYTES", lot)
    monkeypatch.setattr(ppm, "SEGMENT", segment)
    texts = [sentences("en", 30) for _ in range(25)] + [None, "", "the the the THE\tthe", "Neu neu neu " + sentences("de", 10), "\x00\xff é", sentences("en", 300)] + ["copy of a text"] * 3
    want = plain_scores(list(enumerate(texts)), order)
    got = ppm.score(documents(texts), order=order, parts=3).collect()
    assert len(got) == len(texts)
    for r in got:
        held, n, known, total, base, score = want[r["doc_id"]]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held, n, known, total)
        assert r["base_score"] == pytest.approx(base) and r["score"] == pytest.approx(score, rel=1e-6)


def test_chances_after_a_context_sum_to_one():
    rng = np.random.default_rng(3)
    symbols = [x for x in range(256) if not (65 <= x <= 90 or x in (9, 11, 12, 13))]
    assert len(symbols) == ppm.ALPHABET
    text = bytes(rng.choice([97, 98, 99, 32, 195, 169], 400).tolist()) + b"\n"
    pairs, n = ppm.lot_windows([text], 4)
    windows = pairs >> np.uint64(16)
    context = np.unique(windows >> np.uint64(8))[::7]
    unseen = np.array([0x7A7A6162, 0x7A7A7A7A], dtype=np.uint64)
    asked = np.unique(np.concatenate([windows, (np.concatenate([context, unseen])[:, None] << np.uint64(8) | np.array(symbols, dtype=np.uint64)).reshape(-1)]))
    counts = np.zeros(len(asked), dtype=np.int64)
    counts[np.searchsorted(asked, windows)] = n
    chances = 10 ** ppm.code_lengths(asked, counts, ppm.short_levels(asked, counts, 4), 4)
    for c in [*context, *unseen]:
        assert chances[(asked >> np.uint64(8)) == c].sum() == pytest.approx(1.0)


def test_words_in_their_order_are_likelier(documents, sentences):
    held = [i for i in range(1000, 2000) if zlib.crc32(str(i).encode()) % 5 == 1][:2]
    words = sentences("en", 60).split()
    texts = [" ".join(words)] * 3 + [sentences("en", 60) for _ in range(10)] + [" ".join(words), " ".join(sorted(words))]
    got = {r["doc_id"]: r for r in ppm.score(documents(texts, ids=[*range(13), *held])).collect()}
    assert got[held[0]]["base_score"] == pytest.approx(got[held[1]]["base_score"])
    assert got[held[0]]["score"] > got[held[1]]["score"] + 5


def test_code_length_of_long_unknown_words(documents, sentences):
    texts = [sentences("en", 30) for _ in range(20)]
    long = ["\x01\x02" * n for n in (200, 400, 4000)]
    ids = [i for i in range(100, 2000) if zlib.crc32(str(i).encode()) % 5 == 1][:3]
    got = [r["score"] for r in ppm.score(documents([*texts, *long], ids=[*range(20), *ids])).where("doc_id >= 100").orderBy("doc_id").collect()]
    assert got[1] - got[0] == pytest.approx(got[0], rel=0.05) and got[1] < got[0] < -900
    assert got[2] - got[0] == pytest.approx(19 * got[0], rel=0.05)


def test_strange_rows_of_scores(strange, empty):
    assert ppm.score(strange).count() == 6 and ppm.score(empty).count() == 0
