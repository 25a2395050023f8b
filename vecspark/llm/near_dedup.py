"""Near-duplicate groups: SimHash with covering masks, over the whole text and over samples of it.

Documents of a similarity (Jaccard, of distinct five-word shingles) of 0.8 differ
in some ten of 64 SimHash bits, for which covering masks would need thousands of
tables.  So next to the whole-text fingerprints, which covering masks link at
three bits, each document has ``views`` sampled ones: under each of a number of
hash orders the SimHash of the ``sample`` shingles that come first.  Near copies
share those shingles often, so some view of theirs is equal (0.8 to the power of
``sample`` for each view); documents that share a passage only rarely do.

The documents of an equal view are first held against one of them, the one
nearest to the middle, that is to the majority of their wide fingerprints, which
joins most copies at little cost.  Views whose documents are then of more than
one component are settled whole: any two of their documents that are not yet
joined are held against each other, in squares of blocks of bounded size, and once
for all the views that they share.  Wide fingerprints are four SimHashes of 64 bits
over the distinct shingles.

Fingerprints only propose: pairs of one view whose 256 bits differ in at most
``bits`` places, and pairs that whole-text fingerprints give.  ``bits`` is six
standard deviations over what a similarity of 0.8 makes differ (38.5 +- 5.5).
Each proposed pair is then linked exactly if the Jaccard similarity of its
distinct shingles (as 64-bit hashes) is at least ``similarity``.  Within a square
that is decided in place by the shingles themselves, and of the links found those
that join something new are kept, so that many alike texts below the similarity
give no rows at all.  Texts of over ``SAMPLE`` distinct shingles bring a part of
these, by hash; where that part comes within ``SLACK`` of the similarity, the pair
goes on to be decided by all shingles.  Rows of equal text are one from the start.

Defined cases: null and empty texts and texts without words are copies of each
other; a text of fewer words than a shingle is one shingle; rows of equal id and
text are copies, of which any one stays; of equal ids with unlike texts the one of
the smaller text hash comes first; null ids come last; very long texts are read
whole; an empty table gives no rows; other columns, of any name, stay as they are.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vecspark.llm.graph import connected_components
from vecspark.llm.shared import few, release, temporary, written
from vecspark.llm.simhash import majority_bits, near_links, shingle_hashes
from vecspark.llm.text import sub_batches

WIDE = 4
#: Rows of a view that are held against as many others at a time.
BLOCK = 2048
#: Distinct shingles that a text brings into a square: all, or half of these to all of them.
SAMPLE = 1024
#: Five standard deviations of the similarity that such a part shows.
SLACK = 0.08


def remixed(hashes: np.ndarray, k: int) -> np.ndarray:
    """Another hash of each hash."""
    x = hashes + np.uint64((k + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: Keys of texts that are broadcast at most; a key takes some 50 bytes.
BROADCAST_KEYS = 500_000


def key_of(text) -> list:
    """The key of a text, two hashes of it: texts of equal keys are taken as equal."""
    return [F.xxhash64(text).alias("a"), F.xxhash64(text, F.lit(1)).alias("b")]


def prints_of(texts: DataFrame, shingle: int, views: int, sample: int, seed: int) -> DataFrame:
    """a, b, fingerprint, wide (four longs), views (longs) and size of ``texts`` (a, b, text)."""

    def run(batches):
        for part, given in sub_batches(batches, limit=1 << 20):
            hashes = [np.array(shingle_hashes(t, shingle, seed), dtype=np.uint64) for t in given]
            distinct = [np.unique(h) for h in hashes]
            whole = majority_bits(np.concatenate(hashes), np.array([len(h) for h in hashes]))
            flat, counts = np.concatenate(distinct), np.array([len(d) for d in distinct])
            wide = np.stack([majority_bits(remixed(flat, k), counts) for k in range(WIDE)], axis=1)
            sampled = np.empty((len(given), views), dtype=np.uint64)
            ends = np.cumsum(counts)
            for k in range(views):
                order = remixed(flat, WIDE + k)
                for row, (a, b) in enumerate(zip((ends - counts).tolist(), ends.tolist())):
                    own = order[a:b]
                    first = np.sort(np.partition(own, sample - 1)[:sample] if b - a > sample else own)
                    sampled[row, k] = first[0] if len(first) else 0
                    if len(first) == 3:
                        x, y, z = first
                        sampled[row, k] = x & y | y & z | x & z
                    elif len(first) > 1:
                        sampled[row, k] = majority_bits(first, np.array([len(first)]))[0]
            longs = lambda x: pa.array(list(x.view(np.int64)), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(whole.view(np.int64)), longs(wide), longs(sampled), pa.array(counts.astype(np.int32))], ["a", "b", "fingerprint", "wide", "views", "size"])
        release()

    return texts.mapInArrow(run, "a long, b long, fingerprint long, wide array<long>, views array<long>, size int")


def shingle_sets(texts: DataFrame, shingle: int, seed: int) -> DataFrame:
    """Of ``texts`` (node, text) node, the hashes of the distinct shingles, and a part
    of these, all under a bound that is halved ``level`` times, with the number of
    those under half the bound."""

    def run(batches):
        for part, given in sub_batches(batches, limit=1 << 20):
            sets, parts, levels, halves = [], [], [], []
            for t in given:
                own = np.unique(np.array(shingle_hashes(t, shingle, seed), dtype=np.uint64))  # ascending
                level = max(0, int(np.ceil(np.log2(max(1, len(own)) / SAMPLE))))
                under = lambda n: int(np.searchsorted(own, np.uint64((1 << 64 - n) - 1), "right"))  # noqa: B023, E731
                sets.append(own.view(np.int64))
                parts.append(own[: under(level)].view(np.int64))
                levels.append(level)
                halves.append(under(level + 1))
            longs = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sets, longs), pa.array(parts, longs), pa.array(levels, pa.int32()), pa.array(halves, pa.int32())], ["node", "shingles", "sample", "level", "half"])
        release()

    return texts.mapInArrow(run, "node long, shingles array<long>, sample array<long>, level int, half int")


def similar(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) whose sets have a Jaccard similarity of at least
    ``similarity``; empty sets are equal."""
    of = lambda c: sets.select(F.col("node").alias(c), F.col("shingles").alias(f"of_{c}"))
    both = F.size(F.array_intersect("of_a", "of_b"))
    held = pairs.join(of("a"), "a").join(of("b"), "b").select("a", "b", both.alias("both"), (F.size("of_a") + F.size("of_b")).alias("sum"))
    return held.where(F.col("both") >= similarity * (F.col("sum") - F.col("both")) - 1e-9).select("a", "b")


def distance(a, b):
    """Differing bits of two wide fingerprints."""
    return sum((F.bit_count(a[k].bitwiseXOR(b[k])) for k in range(WIDE)), F.lit(0))


def alike_in_size(a, b, similarity: float):
    """Whether sets of these sizes can have the similarity."""
    return F.least(a, b) >= similarity * F.greatest(a, b) - 1e-9


def shared_views(prints: DataFrame) -> DataFrame:
    """(v, key, node, wide, size) of each view that several nodes have."""
    keyed = prints.select("node", F.posexplode("views").alias("v", "key"))
    shared = keyed.groupBy("v", "key").agg(F.count("*").alias("n")).where("n > 1").drop("n")
    return written(keyed.join(shared, ["v", "key"]).join(prints.select("node", "wide", "size"), "node"), "view-rows")


def view_pairs(seen: DataFrame, bits: int, similarity: float) -> DataFrame:
    """Pairs (a, b) of each node of a view with the head of the view's nodes that
    fingerprints and sizes allow."""
    # the middle of a group is the majority of every fourth bit, from sums that
    # are made before rows are dealt out
    places = [(k, b) for k in range(WIDE) for b in range(0, 64, 4)]
    bit = {(k, b): F.shiftrightunsigned(F.col("wide")[k], b).bitwiseAND(F.lit(1)) for k, b in places}
    sums = seen.groupBy("v", "key").agg(F.count("*").alias("m"), *[F.sum(bit[p]).alias(f"s{i}") for i, p in enumerate(places)])
    middle = sums.select("v", "key", F.array(*[(2 * F.col(f"s{i}") > F.col("m")).cast("long") for i in range(len(places))]).alias("middle"))
    off = sum((F.abs(bit[p] - F.col("middle")[i]) for i, p in enumerate(places)), F.lit(0))
    placed = written(seen.join(middle, ["v", "key"]).select("v", "key", "node", "wide", "size", off.cast("int").alias("off")), "placed-rows")
    heads = placed.groupBy("v", "key").agg(F.min(F.struct("off", "node", "wide", "size")).alias("head"))
    near = (distance(F.col("wide"), F.col("head.wide")) <= bits) & alike_in_size(F.col("size"), F.col("head.size"), similarity)
    pairs = placed.join(heads, ["v", "key"]).where((F.col("node") != F.col("head.node")) & near)
    return pairs.select(F.col("node").alias("a"), F.col("head.node").alias("b"))


def settle(square: dict[str, np.ndarray], same: bool, v: int, bits: int, similarity: float) -> tuple[list, list, list]:
    """Links between rows of a square that nothing joins yet: (a, b, whether that is
    decided).  Rows are held against those after them, or, unless ``same``, those of
    the first block against those of the second."""
    node, size, level, half = (square[c] for c in ("node", "size", "level", "half"))
    wide, views, first = square["wide"], square["views"], square["first"]
    _, component = np.unique(square["label"], return_inverse=True)
    counts = square["counts"]
    owner, ends = np.repeat(np.arange(len(node)), counts), np.cumsum(counts)
    values, code = np.unique(square["sample"], return_inverse=True)
    marked = np.zeros(len(values), dtype=bool)
    a, b, sure = [], [], []
    rows = np.arange(len(node))
    left, others = (rows, rows) if same else (rows[first], rows[~first])
    for row in left.tolist():
        to = others[row + 1 :] if same else others
        to = to[component[to] != component[row]]
        if not len(to):
            continue
        fits = np.minimum(size[to], size[row]) >= similarity * np.maximum(size[to], size[row]) - 1e-9
        # a pair belongs to the first view that both have
        fits &= ~(views[to, :v] == views[row, :v]).any(axis=1)
        to = to[fits]
        to = to[sum((np.bitwise_count(wide[to, k] ^ wide[row, k]).astype(np.int16) for k in range(WIDE)), np.zeros(len(to), dtype=np.int16)) <= bits]
        if not len(to):
            continue
        own = code[ends[row] - counts[row] : ends[row]]
        marked[own] = True
        if 16 * len(to) > len(node):
            both = np.bincount(owner, marked[code], len(node))[to]
        else:
            both = np.array([np.count_nonzero(marked[code[ends[t] - counts[t] : ends[t]]]) for t in to.tolist()])
        marked[own] = False
        # under the smaller of the two bounds; levels of such sizes differ by one at most
        mine, theirs = np.where(level[to] > level[row], half[row], counts[row]), np.where(level[to] < level[row], half[to], counts[to])
        whole = (level[to] == 0) & (level[row] == 0)
        near = both >= (similarity - np.where(whole, 0.0, SLACK)) * (mine + theirs - both) - 1e-9
        for t, decided in zip(to[near].tolist(), whole[near].tolist()):
            if component[t] == component[row]:
                continue
            a.append(int(node[row]))
            b.append(int(node[t]))
            sure.append(decided)
            if decided:
                component[component == component[t]] = component[row]
    return a, b, sure


def unsettled_links(seen: DataFrame, prints: DataFrame, sets: DataFrame, links: DataFrame, bits: int, similarity: float) -> DataFrame:
    """(a, b, sure) between nodes of a view that ``links`` do not join: links, and,
    where ``sure`` is false, pairs of long texts that are still to be decided."""
    labels = connected_components(links)
    labelled = written(seen.join(labels, "node", "left").select("v", "key", "node", "wide", "size", F.coalesce("label", "node").alias("label")), "labelled-rows")
    parted = labelled.groupBy("v", "key").agg(F.count("*").alias("n"), F.min("label").alias("least"), F.max("label").alias("most")).where("least <> most")
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    rows = labelled.join(parted.select("v", "key", blocks.alias("blocks")), ["v", "key"])
    rows = rows.withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    rows = rows.join(sets.select("node", "sample", "level", "half"), "node").join(prints.select("node", "views"), "node")
    dealt = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    squares = dealt.groupBy("v", "key", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))
    row = F.struct("node", "label", "size", "level", "half", (F.col("block") == F.least("block", "other")).alias("first"), "wide", "views", "sample")
    lists = squares.agg(F.sort_array(F.collect_list(row)).alias("rows")).select("v", (F.col("i") == F.col("j")).alias("same"), "rows")

    def compare(batches):
        for batch in batches:
            vs, sames, column = batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)
            for k, (v, same) in enumerate(zip(vs, sames)):
                held = column.slice(k, 1).flatten()
                square = {c: held.field(c).to_numpy(zero_copy_only=False) for c in ("node", "label", "size", "level", "half", "first")}
                for c in ("wide", "views"):
                    square[c] = held.field(c).flatten().to_numpy().view(np.uint64).reshape(len(held), -1)
                square["sample"] = held.field("sample").flatten().to_numpy()
                square["counts"] = np.diff(held.field("sample").offsets.to_numpy())
                a, b, sure = settle(square, same, v, bits, similarity)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(sure, pa.bool_())], ["a", "b", "sure"])
        release()

    found = lists.mapInArrow(compare, "a long, b long, sure boolean")
    return written(found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "sure").distinct(), "unsettled-links", arrow_rows=64)


def groups(df: DataFrame, text_col: str = "text", shingle: int = 5, radius: int = 3, views: int = 16, sample: int = 3, bits: int = 72, seed: int = 42, similarity: float = 0.8) -> tuple[DataFrame, DataFrame]:
    """(a, b, node): the key of each distinct text and its number; and (node, label)
    of each text that has near copies, which share the label."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    texts = df.select(*key_of(text), text.alias("text"))
    # numbered as they are written, so that a number stays
    prints = written(prints_of(texts, shingle, views, sample, seed).dropDuplicates(["a", "b"]).withColumn("node", F.monotonically_increasing_id()), "near-prints")
    whole = near_links(prints.select("fingerprint").distinct(), radius)
    first = written(prints.groupBy("fingerprint").agg(F.min("node").alias("first")), "first-of-print")
    to = lambda c: first.select(F.col("fingerprint").alias(c), F.col("first").alias(f"{c}_node"))
    whole = whole.join(to("a"), "a").join(to("b"), "b").select(F.col("a_node").alias("a"), F.col("b_node").alias("b"))
    equal = prints.select("node", "fingerprint").join(first, "fingerprint").select(F.col("node").alias("a"), F.col("first").alias("b"))
    seen = shared_views(prints)
    pairs = whole.unionByName(equal).unionByName(view_pairs(seen, bits, similarity)).where("a <> b")
    pairs = written(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "near-pairs")
    # only texts that a pair may have are read again
    nodes = seen.select("node").unionByName(pairs.select(F.explode(F.array("a", "b")).alias("node"))).distinct()
    keys = written(prints.select("a", "b", "node").join(nodes, "node"), "keys-of-pairs")
    some = texts.join(few(keys, BROADCAST_KEYS), ["a", "b"]).select("node", "text")
    sets = written(shingle_sets(some, shingle, seed).dropDuplicates(["node"]), "shingle-sets")
    links = written(similar(pairs, sets, similarity), "near-links")
    more = unsettled_links(seen, prints, sets, links, bits, similarity)
    links = links.unionByName(more.where("sure").drop("sure")).unionByName(similar(more.where("NOT sure").drop("sure"), sets, similarity))
    return prints.select("a", "b", "node"), connected_components(links)


def keep_one(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``df`` with one row, that of the smallest id, of each group of near copies."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = df.select(F.struct(*[F.col(c) for c in df.columns]).alias("doc"), F.col(id_col).alias("own"), *key_of(text))
    with temporary() as keep:
        texts, labels = groups(df, text_col, **options)
        label = texts.join(labels, "node", "left").select("a", "b", F.coalesce("label", "node").alias("label"))
        # how often each id has each text, and which of a group's comes first
        counted = rows.groupBy("own", "a", "b").agg(F.count("*").alias("n")).join(label, ["a", "b"])
        rank = F.struct(F.col("own").isNull().alias("no_id"), F.col("own").alias("own"), F.col("a").alias("a"), F.col("b").alias("b"))
        ranked = written(counted.withColumn("rank", rank), "ranked-texts")
        best = ranked.groupBy("label").agg(F.min("rank").alias("best"))
        judged = keep(written(ranked.join(best, "label").select("own", "a", "b", "n", (F.col("rank") == F.col("best")).alias("stays")), "judged-texts"))
    is_ = lambda c: F.col("own").eqNullSafe(F.col(f"{c}_own")) & (F.col("a") == F.col(f"{c}_a")) & (F.col("b") == F.col(f"{c}_b"))
    of = lambda found, c: few(found.select(*[F.col(x).alias(f"{c}_{x}") for x in ("own", "a", "b")]), BROADCAST_KEYS)
    # rows that go, and rows that are there more than once, are fewer than those that stay
    alone = rows.join(of(judged.where("NOT stays OR n > 1"), "gone"), is_("gone"), "left_anti").select("doc")
    repeated = rows.join(of(judged.where("stays AND n > 1"), "again"), is_("again"), "left_semi")
    one = repeated.groupBy("own", "a", "b").agg(F.first("doc").alias("doc")).select("doc")
    return alone.unionByName(one).select(*[F.col("doc").getField(c).alias(c) for c in df.columns])
