"""Language identification by Bayesian evidence fusion.

Four sources speak for each language, and their log chances are added: the
text, by hashed byte trigrams of its words; the declared markup language, by how often a
declaration is right; the address suffix; and the host, by a prior that is
smoothed level by level, from all rows to the host's domains to the host itself,
with counts from grouped aggregation over all rows.

Rows are dealt into folds by the hash of their id.  The text tables and the host
priors that judge a row come from the other folds, so a row's own declaration
speaks for it once, as a declaration.

A text may also be of none of the languages: its trigrams are then hardly likelier
by the best table than if dealt out evenly.  Such a text is not kept, nor one
that speaks against the language that the other sources outvote it with.

The trigram tables are fitted on a bounded sample of labelled rows
(``sample_rows``), those whose hashed id comes first; all else covers all rows.

Defined cases: null and empty texts and texts without letters give no text
evidence, so that the other evidence decides; null, unknown or empty
declarations, suffixes and hosts say nothing; without any evidence the prior of
all rows decides; of equally likely languages the first of the list is named; very
long texts are read whole; an empty table gives no rows; repeated rows and null ids
give a row each; columns of clashing names are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vecspark.llm.shared import by_value, opened, release, written
from vecspark.llm.text import sub_batches
from vecspark.llm.url_filter import host_and_path

LANGUAGES = ("de", "en", "es", "fr")
BUCKET_BITS = 16
FOLDS = 4
#: Bytes that may be part of a word, A-Z lower-cased; all others are spaces.
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c > 127 else 32 for c in range(256))


def trigrams(text: bytes) -> np.ndarray:
    """Buckets of the byte trigrams within the words of a text and at their ends."""
    folded = b" " + b" ".join(text.translate(FOLD).split()) + b" "
    x = np.frombuffer(folded, dtype=np.uint8).astype(np.uint32)
    if len(x) < 3:
        return np.empty(0, dtype=np.int64)
    code = (x[:-2] << 16 | x[1:-1] << 8 | x[2:])[x[1:-1] != 32]
    return ((code * np.uint32(2654435761)) >> np.uint32(32 - BUCKET_BITS)).astype(np.int64)


class TextModel:
    """Log chances of trigram buckets by fold and language; ``weight`` trigrams count
    in full, more only as much as that many, as they don't speak independently.

    ``counts`` are of each fold's rows; the tables for a fold have those of all others.
    ``floor`` is the log chance a trigram under which a text is of none of the
    languages: ``GAIN`` over that of evenly dealt trigrams.  Tables of fewer than
    ``ENOUGH`` trigrams can't tell and have none."""

    GAIN = 1.0
    ENOUGH = 10_000

    def __init__(self, counts: np.ndarray, weight: float):
        others = counts.sum(axis=0) - counts if len(counts) > 1 else counts
        total = others.sum(axis=2, keepdims=True)
        buckets = counts.shape[2]
        self.log = np.log((others + 0.1) / (total + 0.1 * buckets)).astype(np.float32)
        self.weight = weight
        self.floor = [self.GAIN - float(np.log(buckets)) if n >= self.ENOUGH else float("-inf") for n in total.sum(axis=(1, 2)).tolist()]

    def evidence(self, text: bytes, fold: int) -> tuple[int, list[float], float]:
        """How many trigrams a text has, the log chances against the best language,
        and what speaks for none of the languages against the best."""
        grams, fold = trigrams(text), fold % len(self.log)
        if not len(grams):
            return 0, [0.0] * self.log.shape[1], 0.0
        sums = np.array([row[grams].sum(dtype=np.float64) for row in self.log[fold]])
        sums *= min(1.0, self.weight / len(grams))
        other = self.floor[fold] * min(len(grams), self.weight) - sums.max()
        return len(grams), (sums - sums.max()).tolist(), float(other)


def fold_of(id_: Column) -> Column:
    """The fold of a row: what judges it is fitted on the other folds."""
    return F.pmod(F.xxhash64(id_), F.lit(FOLDS)).cast("int")


def fit_text(rows: DataFrame, languages: tuple[str, ...] = LANGUAGES, sample_rows: int = 4000, weight: float = 60.0) -> TextModel:
    """Fits on at most ``sample_rows`` of ``rows`` (doc_id, fold, text, declared)."""
    labelled = rows.where(F.col("declared").isin(*languages) & F.col("text").isNotNull())
    chosen = labelled.select("doc_id", "declared").orderBy(F.xxhash64("doc_id"), "doc_id", "declared").limit(sample_rows).distinct()
    sample = labelled.join(F.broadcast(chosen), ["doc_id", "declared"]).select("declared", "fold", "text")

    def count(batches: Iterator[pa.RecordBatch]):
        counts = np.zeros((FOLDS, len(languages), 1 << BUCKET_BITS), dtype=np.int32)
        for part, texts in sub_batches(batches, limit=1 << 20):
            for declared, fold, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), texts):
                np.add.at(counts[fold, languages.index(declared)], trigrams(text), 1)
        for fold, tables in enumerate(counts):
            for k, row in enumerate(tables):
                at = np.flatnonzero(row)
                yield pa.RecordBatch.from_arrays([pa.array([fold] * len(at), pa.int32()), pa.array([k] * len(at), pa.int32()), pa.array(at), pa.array(row[at].astype(np.int64))], ["fold", "k", "bucket", "n"])
        release()

    # folds times languages times buckets at most
    found = sample.mapInArrow(count, "fold int, k int, bucket long, n long").groupBy("fold", "k", "bucket").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros((FOLDS, len(languages), 1 << BUCKET_BITS), dtype=np.int64)
    counts[found["fold"].to_numpy(), found["k"].to_numpy(), found["bucket"].to_numpy()] = found["n"].to_numpy()
    return TextModel(counts, weight)


def host_levels(host: Column) -> Column:
    """The host's domains from the last name to the whole host; empty for none."""
    names = F.reverse(F.split(F.lower(host), r"\."))
    whole = F.transform(F.sequence(F.lit(1), F.size(names)), lambda n: F.array_join(F.reverse(F.slice(names, 1, n)), "."))
    return F.when(F.length(F.coalesce(host, F.lit(""))) > 0, whole).otherwise(F.array().cast("array<string>"))


def host_priors(rows: DataFrame, languages: tuple[str, ...], smoothing: float, trust: float) -> DataFrame:
    """(host_key, prior): for each host and fold the log chances of the languages,
    from the declarations of the rows (host, fold, declared) of all other folds.

    A declaration counts ``trust`` for what it says and the rest evenly for the
    others.  Each level adds its own counts to ``smoothing`` times the chances of
    the level above.
    """
    k = len(languages)
    said = [F.sum(F.when(F.col("declared") == l, trust).when(F.col("declared").isin(*languages), (1 - trust) / (k - 1)).otherwise(0.0)).alias(f"c{i}") for i, l in enumerate(languages)]
    hosts = rows.groupBy(F.lower(F.coalesce("host", F.lit(""))).alias("host"), "fold").agg(*said)
    # what the folds other than f have, for each f
    others = [[F.sum(F.when(F.col("fold") != f, F.col(f"c{i}")).otherwise(0.0)) for i in range(k)] for f in range(FOLDS)]
    all_ = F.array(*[F.array(*of) for of in others]).alias("c")
    everyone = hosts.agg(all_).first()["c"]
    start = F.array(*[F.array(*[F.lit(((n or 0.0) + 1.0) / (sum(x or 0.0 for x in of) + k)) for n in of]) for of in everyone])
    levels = hosts.select("host", "fold", *[f"c{i}" for i in range(k)], F.posexplode(host_levels(F.col("host"))).alias("depth", "domain"))
    by_domain = levels.groupBy("domain").agg(all_)
    # a host has few levels, which are folded from the top down
    path = levels.select("host", "depth", "domain").distinct().join(by_domain, "domain").groupBy("host").agg(F.sort_array(F.collect_list(F.struct("depth", "c"))).alias("path"))

    def step(chances: Column, level: Column) -> Column:
        def one(chance: Column, counts: Column) -> Column:
            added = F.zip_with(chance, counts, lambda p, c: c + smoothing * p)
            total = F.aggregate(added, F.lit(0.0), lambda a, x: a + x)
            return F.transform(added, lambda x: x / total)

        return F.zip_with(chances, level["c"], one)

    chances = F.aggregate("path", start, step)
    return path.select(F.col("host").alias("host_key"), F.transform(chances, lambda of: F.transform(of, lambda x: F.log(x))).alias("prior"))


def said_by(given: Column, languages: tuple[str, ...], right: float) -> Column:
    """Log chances of what a declaration says: it names the language itself in
    the part ``right`` of cases; one that names none of the languages says nothing."""
    code = F.lower(F.regexp_extract(F.coalesce(given, F.lit("")), r"^\s*([A-Za-z]{2,3})(?![A-Za-z])", 1))
    wrong = float(np.log((1 - right) / (len(languages) - 1)))
    return F.when(code.isin(*languages), F.array(*[F.when(code == l, float(np.log(right))).otherwise(wrong) for l in languages])).otherwise(F.array(*[F.lit(0.0)] * len(languages)))


def identify(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    declared: Column | str = "lang",
    suffix: Column | str | None = None,
    host: Column | str = "source",
    languages: tuple[str, ...] = LANGUAGES,
    model: TextModel | None = None,
    sample_rows: int = 4000,
    right: float = 0.9,
    suffix_right: float = 0.7,
    smoothing: float = 20.0,
    least: float = 0.5,
    contradiction: float = 3.0,
    broadcast_hosts: int = 100_000,
    keep_columns: bool = False,
) -> DataFrame:
    """doc_id, lang_pred, confidence, text_lang, n_trigrams and keep of each row.

    A row is kept if its language has a chance of at least ``least`` and the text
    does not contradict it by more than ``contradiction`` (natural logarithm), be
    it for another of the languages or for none of them.  What prior and
    declaration can put against a text is 6.6 with four languages (8.5 with a
    suffix), so the bound can be reached.
    With ``keep_columns`` the columns of ``df`` are given as ``row``.
    """
    none = F.lit(None).cast("string")
    as_col = lambda c: none if c is None else F.col(c).cast("string") if isinstance(c, str) else c.cast("string")
    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), fold_of(F.col(id_col).cast("long")).alias("fold"), as_col(declared).alias("declared"), as_col(suffix).alias("suffix"), as_col(host).alias("host"), *([F.struct(*[F.col(c) for c in df.columns]).alias("row")] if keep_columns else []))
    model = model or fit_text(rows, languages, sample_rows)
    shared = by_value(df.sparkSession, model)
    k = len(languages)

    # only texts go to Python, a batch at a time
    @F.arrow_udf("struct<n: long, log: array<double>, other: double>")
    def evidence(texts: pa.Array, folds: pa.Array) -> pa.Array:
        model = opened(shared)
        found = [model.evidence(t.as_buffer().to_pybytes() if t.is_valid else b"", fold) for t, fold in zip(texts.cast(pa.binary()), folds.to_pylist())]
        columns = [pa.array([x[0] for x in found], pa.int64()), pa.array([x[1] for x in found], pa.list_(pa.float64())), pa.array([x[2] for x in found], pa.float64())]
        return pa.StructArray.from_arrays(columns, ["n", "log", "other"])

    prior = written(host_priors(rows, languages, smoothing, right), "host-priors")
    if prior.count() <= broadcast_hosts:  # else documents are dealt out by host
        prior = F.broadcast(prior)
    judged = rows.withColumn("e", evidence("text", "fold")).drop("text").withColumn("h", F.lower(F.coalesce("host", F.lit(""))))
    joined = judged.join(prior, judged["h"] == prior["host_key"], "left")
    flat = F.array(*[F.lit(float(-np.log(k)))] * k)
    add = lambda a, b: F.zip_with(a, b, lambda x, y: x + y)
    logs = add(add(F.col("e.log"), F.coalesce(F.get("prior", F.col("fold")), flat)), add(said_by(F.col("declared"), languages, right), said_by(F.col("suffix"), languages, suffix_right)))
    out = joined.withColumn("logs", logs).withColumn("top", F.array_max("logs"))
    total = F.aggregate("logs", F.lit(0.0), lambda a, x: a + F.exp(x - F.col("top")))
    out = out.withColumn("at", F.array_position("logs", F.col("top"))).withColumn("confidence", F.lit(1.0) / total)
    names = F.array(*[F.lit(l) for l in languages])
    text_at = F.array_position("e.log", F.array_max("e.log"))
    against = -F.element_at("e.log", F.col("at").cast("int"))
    return out.select(
        "doc_id",
        F.element_at(names, F.col("at").cast("int")).alias("lang_pred"),
        "confidence",
        F.when(F.col("e.n") > 0, F.element_at(names, text_at.cast("int"))).alias("text_lang"),
        F.col("e.n").alias("n_trigrams"),
        ((F.col("confidence") >= least) & (F.greatest(against, F.col("e.other")) <= contradiction)).alias("keep"),
        *["row"] * keep_columns,
    )


def keep_identified(df: DataFrame, **options) -> DataFrame:
    """The rows of ``df`` that identification keeps, with their own columns."""
    found = identify(df, keep_columns=True, **options).where("keep")
    return found.select(*[F.col("row").getField(c).alias(c) for c in df.columns])


def identify_pages(pages: DataFrame, url_col: str = "url", html_col: str = "html", **options) -> DataFrame:
    """page_id and what ``identify`` gives, of pages (page_id, url, html): text from
    the html without tags, scripts, styles and entities, the declaration from
    <html lang=...>, the suffix and the host from the url.

    Null html has no text and declares nothing; a null url has no suffix and no host.
    """
    html = F.coalesce(F.col(html_col), F.lit(""))
    text = F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->", " ")
    text = F.regexp_replace(text, r"(?s)<[^>]*>|&#?\w+;", " ")
    declared = F.regexp_extract(html, r"(?is)<html\b[^>]*?\slang\s*=\s*[\"']?([\w-]+)", 1)
    host = F.regexp_extract(host_and_path(F.col(url_col))[0], r"^(?:[^@]*@)?([^:]*)", 1)
    rows = pages.select(F.col("page_id").alias("doc_id"), text.alias("text"), declared.alias("declared"), F.regexp_extract(host, r"\.([^.]+)$", 1).alias("suffix"), host.alias("host"))
    return identify(rows, declared="declared", suffix="suffix", host="host", **options).withColumnRenamed("doc_id", "page_id")
