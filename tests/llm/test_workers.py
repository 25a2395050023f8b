"""Workers need no copy of this repository, and the entry no library of these operators."""

import os
import subprocess
import sys
from pathlib import Path

REPO = str(Path(__file__).resolve().parents[2])
JOB = """
import sys
sys.path.insert(0, {repo!r})
from pyspark.sql import SparkSession
import public_tokenizers as P
from vecspark.llm import bpe, decontaminate, langid, matroska, ppm, simhash, token_count, token_store, toxicity
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
docs = spark.createDataFrame([(k, "the text %d of a table" % k, "en", "s") for k in range(6)], "doc_id long, text string, lang string, source string")
labels = spark.createDataFrame([(k, k % 2) for k in range(6)], "doc_id long, toxic int")
words, pieces = P.path("word_bpe_49k.json"), P.path("piece_bpe_32k.model")
for df in (
    token_count.token_counts(docs, pieces),
    simhash.near_duplicate_classes(docs),
    langid.identify(docs),
    token_store.read_token_store(spark, token_store.write_token_store(docs, words)),
    matroska.media_features(matroska.media_column(docs)),
    ppm.score(docs),
    bpe.encode_decode(docs, words),
    toxicity.toxicity(docs, toxicity.train(docs, labels)),
    decontaminate.contamination(docs, docs.selectExpr("doc_id AS item_id", "text")),
):
    assert df.count() == 6, df.columns
print("all ran")
"""
ENTRY = """
import sys
sys.path.insert(0, {repo!r})
sys.modules["xxhash"] = None
import __spark_entry__ as entry
names = entry.queries()
assert len(names) > 70 and set(entry.oracle_sql()) <= set(names) and not any(n.startswith("op") for n in names)
print("all there")
"""


def python(code, folder):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    return subprocess.run([sys.executable, "-c", code.format(repo=REPO)], cwd=folder, env=env, capture_output=True, text=True, timeout=600)


def test_without_the_repository_on_workers(tmp_path):
    done = python(JOB, tmp_path)
    assert "all ran" in done.stdout, done.stderr[-3000:]


def test_without_a_library(tmp_path):
    done = python(ENTRY, tmp_path)
    assert "all there" in done.stdout, done.stderr[-3000:]
