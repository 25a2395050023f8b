"""Token counts, BPE and the token store against the libraries."""

import glob
import hashlib
import os
import time
import zlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from tests.llm.conftest import odd_texts
from vecspark.llm import bpe, token_count, token_store

PIECES = public_tokenizers.path("piece_bpe_32k.model")
WORDS = public_tokenizers.path("word_bpe_49k.json")


def test_counts_are_the_library_s(documents):
    texts = odd_texts()
    want = [len(x) for x in sentencepiece.SentencePieceProcessor(model_file=PIECES).encode(texts)]
    got = {r["doc_id"]: r for r in token_count.token_counts(documents(texts), PIECES, limit=100).collect()}
    for k, (text, n) in enumerate(zip(texts, want)):
        assert (got[k]["n_tokens"], got[k]["n_bytes"], got[k]["over_limit"]) == (n, len(text.encode()), n > 100), text


def test_bpe_is_the_library_s(documents):
    texts = odd_texts()
    library = Tokenizer.from_file(WORDS)
    got = {r["doc_id"]: r for r in bpe.encode_decode(documents(texts), WORDS, keep_ids=True).collect()}
    for k, text in enumerate(texts):
        ids = library.encode(text, add_special_tokens=False).ids
        text_again = library.decode(ids, skip_special_tokens=False)
        r = got[k]
        assert (list(r["ids"]), r["decoded"], r["n_tokens"]) == (ids, text_again, len(ids)), text
        assert r["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(text_again.encode()).hexdigest()


def test_one_by_one_merging_of_long_words():
    tables = bpe.load_tables(WORDS)
    for word in (b"a" * 70, b"thethe" * 30, "ééaé".encode() * 9, b"the" * 100, b"abcabd" * 200, bytes(range(97, 123)) * 20):
        symbols = [int(tables.inner[b]) for b in word[:-1]] + [int(tables.final[word[-1]])]
        while len(symbols) > 1:
            rank = tables.rank(np.array(symbols[:-1]), np.array(symbols[1:])).astype(np.int64)
            at = int(np.where(rank < 0, 1 << 40, rank).argmin())
            if rank[at] < 0:
                break
            symbols[at : at + 2] = [int(tables.made[rank[at]])]
        assert np.frombuffer(bpe.merge_words(tables, [word])[0], "<i4").tolist() == symbols == bpe._merge_one(tables, word)


def test_a_word_of_a_megabyte():
    tables = bpe.load_tables(WORDS)
    word = b"abandonment" * 100_000
    began = time.process_time()
    ids = np.frombuffer(bpe.merge_words(tables, [word])[0], "<i4")
    assert time.process_time() - began < 60
    assert sum(len(tables.tokens[i].removesuffix("</w>")) for i in ids.tolist()) == len(word)


def test_letters_that_a_mark_joins_in_lower_case_only(documents):
    texts = ["H\u0331 T\u0308 J\u030c", "h\u0331 t\u0308 j\u030c", "\u1e96", "THE \u00c9 THE"]
    library = Tokenizer.from_file(WORDS)
    got = {r["doc_id"]: list(r["ids"]) for r in bpe.encode_decode(documents(texts), WORDS, keep_ids=True).collect()}
    assert [got[k] for k in range(len(texts))] == [library.encode(t, add_special_tokens=False).ids for t in texts]


def test_store_is_the_library_s(spark, documents):
    texts = odd_texts(60)
    ids = [3 * k - 20 for k in range(len(texts))]
    library = Tokenizer.from_file(WORDS)
    path = token_store.write_token_store(documents(texts, ids=ids).repartition(3), WORDS, frame_ids=500, block=64)
    got = {r["doc_id"]: r for r in token_store.read_token_store(spark, path, keep_ids=True).collect()}
    start = 0
    for doc, text in zip(ids, texts):
        want = [*library.encode(text, add_special_tokens=False).ids, 1]
        r = got[doc]
        assert (r["start"], r["n_tokens"], list(r["ids"])) == (start, len(want), want)
        assert r["ids_crc32"] == zlib.crc32(np.array(want, dtype="<u4").tobytes())
        start += len(want)


def test_a_store_that_lost_a_file_is_an_error(spark, documents):
    path = token_store.write_token_store(documents(odd_texts(60)).repartition(3), WORDS, frame_ids=200)
    parts = sorted(glob.glob(f"{path.removeprefix('file://')}/frames/part-*.parquet"))
    assert len(parts) > 1
    os.remove(parts[1])
    with pytest.raises(ValueError):
        token_store.read_token_store(spark, path)


@pytest.mark.parametrize("planes", [4, 32])
@pytest.mark.parametrize("n", [0, 1, 63, 64, 65, 1000])
def test_frames_round_trip(planes, n):
    ids = np.random.default_rng(n).integers(0, 1 << 32, n, dtype=np.uint32)
    data = token_store.pack_frame([7, None], [n, 0], ids, 3, 4, block=64, planes=planes)
    frame = token_store.Frame(data + b"\n")
    assert frame.ids().tolist() == ids.tolist() and frame.doc_ids == [7, None] and frame.counts.tolist() == [n, 0] and (frame.shard, frame.frame) == (3, 4)
    if n > 64:
        assert frame.read_block(1).tolist() == ids[64:128].tolist()
        damaged = bytearray(data)
        damaged[-10] ^= 1
        with pytest.raises(ValueError):
            token_store.Frame(bytes(damaged))


def test_strange_rows(spark, strange, empty):
    assert sorted(r["n_tokens"] for r in token_count.token_counts(strange, PIECES).collect())[:2] == [0, 0]
    assert bpe.encode_decode(strange, WORDS).count() == 6
    path = token_store.write_token_store(strange, WORDS)
    rows = token_store.read_token_store(spark, path).orderBy("start").collect()
    assert [r["doc_id"] for r in rows] == [None, 1, 2, 2, 3, 4] and [r["start"] for r in rows][:2] == [0, 1]
    assert token_count.token_counts(empty, PIECES).count() == bpe.encode_decode(empty, WORDS).count() == 0
    assert token_store.read_token_store(spark, token_store.write_token_store(empty, WORDS)).count() == 0
