"""SimHash near-duplicates with covering locality-sensitive hashing.

Covering masks: every bit place i gets a code m(i) of r + 1 bits, and for each
non-zero v of r + 1 bits a mask holds the places whose code has odd parity with
v.  For r places there is always a v that is even on all of them, so two
fingerprints that differ in at most r places agree under some mask: every pair
within the radius collides in some of the 2^(r+1) - 1 tables.

A bucket of few fingerprints is compared whole.  The rows of a larger one are
dealt out again under a second set of covering masks on the places the first
mask leaves open; what is still open then is so few places that a bucket is
bounded by two to their number, whatever the data.  Exact copies are one
fingerprint from the start.

Defined cases: null and empty texts and texts without words have fingerprint 0
and link as any other; a text of fewer words than a shingle is one shingle;
repeated shingles count each time; equal rows fall into one class; null ids
take part and are never the smallest; an empty table gives no rows.
"""

from __future__ import annotations

from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vecspark.llm.graph import connected_components
from vecspark.llm.shared import written
from vecspark.llm.text import keyed_text, sub_batches

#: Shingles whose bits are counted at a time.
COUNT_ROWS = 1 << 16


def shingle_hashes(text: bytes, shingle: int, seed: int) -> list[int]:
    """XXH64 of each shingle of the lower-cased words of a text."""
    words = text.lower().split()
    digest = xxhash.xxh64_intdigest
    if len(words) <= shingle:
        return [digest(b" ".join(words), seed)] if words else []
    joined = b" ".join(words)
    sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1
    ends = np.cumsum(sizes) - 1
    starts = ends - sizes + 1
    return [digest(joined[a:b], seed) for a, b in zip(starts[: 1 - shingle].tolist(), ends[shingle - 1 :].tolist())] if shingle > 1 else [digest(w, seed) for w in words]


def majority_bits(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """One fingerprint for each run of ``counts`` hashes: the bits set in over half."""
    total = np.zeros((len(counts), 64), dtype=np.int64)
    run = np.repeat(np.arange(len(counts)), counts)
    for at in range(0, len(hashes), COUNT_ROWS):
        part, own = hashes[at : at + COUNT_ROWS], run[at : at + COUNT_ROWS]
        bits = np.unpackbits(part.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        starts = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
        total[own[starts]] += np.add.reduceat(bits, starts, axis=0, dtype=np.int32)
    over = (2 * total > counts[:, None]).astype(np.uint8)
    return np.packbits(over, axis=1, bitorder="little").view("<u8").reshape(-1)


def fingerprints(df: DataFrame, shingle: int = 3, seed: int = 42, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and fingerprint (the 64 bits as a long) of each row."""

    def run(batches):
        for part, texts in sub_batches(batches):
            hashes = [shingle_hashes(t, shingle, seed) for t in texts]
            counts = np.fromiter(map(len, hashes), dtype=np.int64, count=len(hashes))
            flat = np.fromiter(chain.from_iterable(hashes), dtype=np.uint64, count=int(counts.sum()))
            prints = majority_bits(flat, counts).view(np.int64)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(prints)], ["doc_id", "fingerprint"])

    return keyed_text(df, id_col, text_col).mapInArrow(run, "doc_id long, fingerprint long")


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def covering_masks(radius: int, places: list[int], seed: int) -> list[int]:
    """The masks of one covering set over the given bit places, as unsigned integers.

    Codes are dealt out evenly in a random order, so masks are of nearly equal size.
    """
    codes = 1 << (radius + 1)
    order = np.random.default_rng(seed).permutation(places).tolist()
    code = {p: 1 + k % (codes - 1) for k, p in enumerate(order)}
    return [sum(1 << p for p in places if (code[p] & v).bit_count() % 2) for v in range(1, codes)]


def _near(values: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Links that join the values of a bucket that reach each other by steps
    within the radius; one fewer than there are values at most."""
    left, links = values, []
    while len(left) > 1:
        root, left = left[0], left[1:]
        queue = [root]
        while queue and len(left):
            close = np.bitwise_count(left ^ queue.pop()) <= radius
            if close.any():
                found = left[close]
                left = left[~close]
                links += [(int(root), int(x)) for x in found]
                queue.extend(found)
    return links


def near_links(prints: DataFrame, radius: int = 3, bucket: int = 256, seed: int = 7) -> DataFrame:
    """Links (a, b) between the distinct longs of the column ``fingerprint``,
    such that two of them are joined by links exactly if they are by steps of
    at most ``radius`` differing bits."""
    masks = covering_masks(radius, list(range(64)), seed)
    inner = []
    for k, mask in enumerate(masks):
        places = [p for p in range(64) if not mask >> p & 1]
        inner.append([mask | m for m in covering_masks(radius, places, seed + 1 + k)])
    value = F.col("fingerprint")

    def keys(masks_: list[int]):
        return F.array(*[value.bitwiseAND(F.lit(signed(m)).cast("long")) for m in masks_])

    keyed = prints.select("fingerprint", F.posexplode(keys(masks)).alias("t", "k"))
    large = written(keyed.groupBy("t", "k").count().where(F.col("count") > bucket).select("t", "k"), "large-buckets")
    small = keyed.join(large, ["t", "k"], "left_anti").groupBy("t", "k").agg(F.collect_list("fingerprint").alias("f")).where(F.size("f") > 1).select("f")
    deeper = F.lit(None).cast("array<bigint>")
    for k in reversed(range(len(masks))):
        deeper = F.when(F.col("t") == k, keys(inner[k])).otherwise(deeper)
    dealt = keyed.join(large, ["t", "k"], "left_semi").select("fingerprint", "t", F.posexplode(deeper).alias("u", "k"))
    bounded = dealt.groupBy("t", "u", "k").agg(F.collect_list("fingerprint").alias("f")).where(F.size("f") > 1).select("f")

    def compare(batches):
        for batch in batches:
            links = []
            column = batch.column(0)
            flat = column.values.to_numpy().view(np.uint64)
            ends = column.offsets.to_numpy()
            for a, b in zip(ends[:-1].tolist(), ends[1:].tolist()):
                links += _near(flat[a:b], radius)
            pairs = np.array(links, dtype=np.uint64).reshape(-1, 2).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0].copy()), pa.array(pairs[:, 1].copy())], ["a", "b"])

    def pairs_of(buckets: DataFrame) -> DataFrame:
        two = F.size("f") == 2
        quick = buckets.where(two & (F.bit_count(F.col("f")[0].bitwiseXOR(F.col("f")[1])) <= radius)).select(F.col("f")[0].alias("a"), F.col("f")[1].alias("b"))
        return quick.unionByName(buckets.where(~two).mapInArrow(compare, "a long, b long"))

    return pairs_of(small).unionByName(pairs_of(bounded)).distinct()


def near_duplicate_classes(df: DataFrame, shingle: int = 3, radius: int = 3, seed: int = 42, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fingerprint (long) and component_id, the smallest doc_id that a
    row reaches by links of at most ``radius`` differing bits, of each row."""
    docs = written(fingerprints(df, shingle, seed, id_col, text_col), "fingerprints")
    prints = written(docs.groupBy("fingerprint").agg(F.min("doc_id").alias("least")), "prints")
    labels = connected_components(near_links(prints.select("fingerprint"), radius))
    labelled = prints.join(labels.withColumnRenamed("node", "fingerprint"), "fingerprint", "left").select("fingerprint", "least", F.coalesce("label", "fingerprint").alias("label"))
    least = labelled.groupBy("label").agg(F.min("least").alias("component_id"))
    known = labelled.join(least, "label").select("fingerprint", "component_id")
    return docs.join(known, "fingerprint").select("doc_id", "fingerprint", "component_id")


def hex_digits(column):
    """A long's 64 bits as 16 lower-case hexadecimal digits."""
    return F.lower(F.lpad(F.hex(column), 16, "0"))
