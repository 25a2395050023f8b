"""Benchmark decontamination with a broadcast hash set of test n-grams.

Texts become words: A-Z lower-cased, then runs of digits, a-z and characters
beyond ASCII.  The windows of the test items are hashed into a set that is
broadcast while its size stays under a bound, else joined by a shuffle.  Each
document's windows are hashed in place and looked up; a hit counts once the
words themselves are equal.  All of it are DataFrame functions.

Defined cases: null and empty texts and texts without words are never hit; an
item of fewer words than a window is one window of its own length, an item
without words none; repeated items and windows count once an item id; rows of
equal id and text share one result, each row keeping its own; null ids work as
any id; words of any length and texts of any length are scanned whole; an empty
benchmark hits nothing; columns of any names are kept as they are.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vecspark.llm.shared import few, written

#: Anything that parts words once A-Z are lower-cased.
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Windows of the test set that are broadcast at most; a window takes some 300 bytes.
BROADCAST_WINDOWS = 200_000
#: Keys of documents that are broadcast at most; a key takes some 100 bytes.
BROADCAST_KEYS = 300_000


def words_of(text: Column) -> Column:
    """The words of a text; none for null."""
    lower = F.translate(F.coalesce(text, F.lit("")), string.ascii_uppercase, string.ascii_lowercase)
    return F.array_remove(F.split(lower, GAP), "")


def word_count(text: Column) -> Column:
    """How many words a text has: where a word starts after none."""
    return F.size(words_of(text)).cast("long")


def item_windows(benchmark: DataFrame, window: int, id_col: str, text_col: str) -> DataFrame:
    """Each distinct window of the test items: n (its words), words, h, wid, and the items' ids."""
    items = benchmark.select(F.col(id_col).alias("item_id"), words_of(F.col(text_col)).alias("w")).where(F.size("w") > 0)
    starts = F.explode(F.sequence(F.lit(1), F.greatest(F.size("w") - window + 1, F.lit(1)))).alias("at")
    parts = items.select("item_id", "w", starts).select("item_id", F.slice("w", F.col("at"), window).alias("words"))
    by = parts.groupBy("words").agg(F.collect_set("item_id").alias("items"))
    return by.select(F.size("words").alias("n"), "words", F.xxhash64("words").alias("h"), F.sha2(F.concat_ws(" ", "words"), 256).alias("wid"), "items")


def find_hits(docs: DataFrame, benchmark: DataFrame, window: int = 10, item_id_col: str = "item_id", item_text_col: str = "text", broadcast_windows: int = BROADCAST_WINDOWS) -> tuple[DataFrame, DataFrame]:
    """Hits (key, at, n, wid) of ``docs`` (key, text), and the windows' items (wid, items).

    ``at`` counts words from 1; a window covers ``n`` of them.
    """
    windows = written(item_windows(benchmark, window, item_id_col, item_text_col), "windows")
    sizes = {r["n"]: r["count"] for r in windows.groupBy("n").count().collect()}  # one row a length, at most ``window``
    hits = None
    for n, count in sorted(sizes.items()):
        set_ = windows.where(F.col("n") == n).select(F.col("h").alias("wh"), F.col("words").alias("window_words"), "wid")
        worded = docs.select("key", words_of(F.col("text")).alias("w")).where(F.size("w") >= n)
        hashed = worded.select("key", "w", F.transform(F.sequence(F.lit(1), F.size("w") - n + 1), lambda i: F.xxhash64(F.slice("w", i, n))).alias("hs"))
        # equality in two halves is no join key, so only windows whose hash is found are compared
        words = F.slice("w", F.col("p") + 1, n)
        equal = (words <= F.col("window_words")) & (words >= F.col("window_words"))
        if count <= broadcast_windows:
            # outer: else a filter on the hashes is inferred and makes them twice
            scanned = hashed.select("key", "w", F.posexplode_outer("hs").alias("p", "h"))
            met = scanned.join(F.broadcast(set_), (F.col("h") == F.col("wh")) & equal)
        else:
            # places and hashes are dealt out, words stay; what a hash proposes is held against the words
            places = hashed.select("key", F.posexplode_outer("hs").alias("p", "h"))
            proposed = written(places.join(set_.hint("merge"), F.col("h") == F.col("wh")).select("key", "p", "window_words", "wid"), "proposed")
            keys = proposed.select("key").distinct()
            some = worded.join(few(keys, BROADCAST_KEYS), "key", "left_semi")
            met = proposed.join(some, "key").where(equal)
        found = met.select("key", (F.col("p") + 1).alias("at"), F.lit(n).alias("n"), "wid")
        hits = found if hits is None else hits.unionByName(found)
    if hits is None:
        hits = docs.select("key", F.lit(1).alias("at"), F.lit(1).alias("n"), F.lit("").alias("wid")).limit(0)
    return hits, windows.select("wid", "items")


def contamination(df: DataFrame, benchmark: DataFrame, window: int = 10, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", broadcast_windows: int = BROADCAST_WINDOWS, spans: bool = False) -> DataFrame:
    """For each row: doc_id, n_words, n_hit, n_items, items_sha256 and
    contaminated; with ``spans`` also text_key and hit_words (places of hit words, from 1)."""
    key = F.struct(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("a"), F.xxhash64(text_col, F.lit(1)).alias("b"))
    docs = df.select(key.alias("key"), F.col(text_col).alias("text"))
    hits, items = find_hits(docs, benchmark, window, item_id_col, item_text_col, broadcast_windows)
    hits = written(hits, "hits")  # read twice, found once
    places = F.array_distinct(F.flatten(F.transform("hit", lambda x: F.sequence(x["at"], x["at"] + x["n"] - 1))))
    by_key = hits.groupBy("key").agg(F.collect_set(F.struct("at", "n")).alias("hit")).select("key", places.alias("hit_words"))
    ids = hits.select("key", "wid").distinct().join(items, "wid").select("key", F.explode("items").alias("item"))
    by_item = ids.groupBy("key").agg(F.sort_array(F.collect_set(F.col("item").cast("string"))).alias("items"))
    # null-safe on the id; the texts' hashes are never null
    hit = by_key.join(by_item, "key").select(F.coalesce(F.col("key.id").cast("string"), F.lit("")).alias("i"), F.col("key.id").isNull().alias("no_id"), F.col("key.a").alias("a"), F.col("key.b").alias("b"), "hit_words", "items")
    rows = docs.select(F.col("key.id").alias("doc_id"), F.coalesce(F.col("key.id").cast("string"), F.lit("")).alias("i"), F.col("key.id").isNull().alias("no_id"), F.col("key.a").alias("a"), F.col("key.b").alias("b"), word_count(F.col("text")).alias("n_words"))
    none = F.array().cast("array<string>")
    return rows.join(hit, ["i", "no_id", "a", "b"], "left").select(
        "doc_id",
        "n_words",
        F.when(F.col("hit_words").isNull(), 0).otherwise(F.size("hit_words")).cast("long").alias("n_hit"),
        F.when(F.col("items").isNull(), 0).otherwise(F.size("items")).cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", F.coalesce("items", none)), 256).alias("items_sha256"),
        F.col("hit_words").isNotNull().alias("contaminated"),
        *([F.struct("a", "b").alias("text_key"), "hit_words"] if spans else []),
    )


def decontaminate(df: DataFrame, benchmark: DataFrame, mode: str = "documents", window: int = 10, id_col: str = "doc_id", text_col: str = "text", **columns) -> DataFrame:
    """``df`` without contaminated rows, or, with mode ``spans``, with the hit
    words (and what parts them from the next) cut out of their texts."""
    if mode not in ("documents", "spans"):
        raise ValueError("mode is documents or spans")
    found = contamination(df, benchmark, window, id_col, text_col, spans=True, **columns).where("contaminated")
    found = found.select(F.col("doc_id").alias("hit_id"), F.col("text_key.a").alias("hit_a"), F.col("text_key.b").alias("hit_b"), *(["hit_words"] if mode == "spans" else [])).distinct()
    found = written(found, "contaminated")
    # as one column, so that names can't clash
    rows = df.select(F.struct(*[F.col(c) for c in df.columns]).alias("doc"), F.col(id_col).alias("own_id"), F.xxhash64(text_col).alias("own_a"), F.xxhash64(text_col, F.lit(1)).alias("own_b"))
    same = F.col("own_id").eqNullSafe(F.col("hit_id")) & (F.col("own_a") == F.col("hit_a")) & (F.col("own_b") == F.col("hit_b"))
    if mode == "documents":
        kept = rows.join(few(found, BROADCAST_KEYS), same, "left_anti")
        return kept.select(*[F.col("doc").getField(c).alias(c) for c in df.columns])
    given = F.col("doc").getField(text_col)
    # each word with what follows it; what precedes the first word is kept apart
    lead = F.regexp_extract(given, r"^[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]*", 0)
    parts = F.regexp_extract_all(given, F.lit(r"([^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]*)"), F.lit(1))
    spaced = F.transform(parts, lambda x, i: F.when(F.array_contains("hit_words", i + 1), F.lit("")).otherwise(x))
    text = F.when(F.col("hit_words").isNull(), given).otherwise(F.concat(lead, F.array_join(spaced, "")))
    return rows.join(found, same, "left").select(*[text.alias(c) if c == text_col else F.col("doc").getField(c).alias(c) for c in df.columns])


def sql(window: int = 10) -> str:
    """The same for tables documents and benchmark."""

    def words(of: str) -> str:
        return f"regexp_extract_all(translate(coalesce({of}, ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"

    return f"""
WITH d AS (SELECT doc_id, {words("text")} AS w FROM documents),
b AS (SELECT item_id, {words("text")} AS w FROM benchmark),
v AS (SELECT DISTINCT item_id, list_slice(w, s, s + {window} - 1) AS g FROM (
  SELECT item_id, w, unnest(range(1, greatest(len(w) - {window} + 1, 1) + 1)) AS s FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT len(g) AS n FROM v),
c AS (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM d, sizes WHERE len(w) >= n),
h AS (SELECT doc_id, s, n, item_id FROM (SELECT doc_id, s, n, list_slice(w, s, s + n - 1) AS g FROM c) x JOIN v USING (g)),
p AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) AS q FROM h) y GROUP BY doc_id),
i AS (SELECT doc_id, count(*) AS n_items, string_agg(t, ',' ORDER BY t) AS items FROM (
  SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS t FROM h) z GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN p USING (doc_id) LEFT JOIN i USING (doc_id)"""
