import random

import pytest
from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
ALPHABET = "ab the▁  \n\t日本é🎉ſİΣς'.,12aaaá <|endoftext|>"


def odd_texts(n=150, seed=1):
    rng = random.Random(seed)
    made = ["".join(rng.choice(ALPHABET) for _ in range(rng.randint(0, 40))) for _ in range(n)]
    return made + ["a" * 3000, " " * 200, "   x", " x  ", "", " ", "ab" * 500, "<|endoftext|><|endoftext|>A<|startoftext|>b", "\x1c a\x85b", "it's I'LL we'Ve", "İSTANBUL ΑΣ", "x<|y|>z <|endoftext", "\x00 nul"]


@pytest.fixture(scope="session")
def documents(spark):
    """Makes a documents table from texts; ids count from 0."""

    def make(texts, ids=None, langs=None):
        rows = [(k if ids is None else ids[k], t, "en" if langs is None else langs[k], f"src{k % 3}", len(t or "")) for k, t in enumerate(texts)]
        return spark.createDataFrame(rows, SCHEMA)

    return make


@pytest.fixture(scope="session")
def strange(documents):
    """Nulls in any column, repeated rows, and columns of clashing names."""
    df = documents([None, "", "same text here", "same text here", "same text here", "x" * 20000], ids=[None, 1, 2, 2, 3, 4])
    extra = {c: F.lit("clash") for c in ("n_tokens", "score", "fingerprint", "key", "w", "h", "label", "node", "item_id", "row", "p", "doc", "own", "a", "b", "at", "hit_id", "hit_words", "_id", "_row", "fold", "e", "kind", "lot")}
    return df.withColumns(extra).withColumn("source", F.lit(None).cast("string")).withColumn("lang", F.when(F.col("doc_id") == 1, F.lit(None)).otherwise(F.col("lang")))


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture
def sentences():
    """Random sentences of made-up words in four invented languages, the same in each test."""
    rng = random.Random(4)
    parts = {"en": "the th er on an re".split(), "de": "sch ung der die ein keit".split(), "fr": "eau ré que é la oi".split(), "es": "ción ía ado el la ñ".split()}

    def make(lang, words):
        return " ".join("".join(rng.choice(parts[lang]) for _ in range(rng.randint(1, 4))) for _ in range(words))

    return make
