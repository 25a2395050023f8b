"""The driver's contract: names, columns, and SQL of the queries."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the tables aren't here")


def test_names():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).count() == 10


@pytest.mark.parametrize("name", ["knn_exact_euclidean", "knn_filtered_not", "filter_not", "quantize_int8", "latest_version", "dedup_requests", "shard_route", "knn_gemm", "stream_latest", "restore_roundtrip"])
def test_same_as_sql(spark, name):
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    mine = entry.queries()[name](spark, SF)
    theirs = con.sql(entry.oracle_sql()[name])
    columns = sorted(mine.columns)
    assert columns == sorted(theirs.columns)
    order = [theirs.columns.index(c) for c in columns]
    assert sorted(str(tuple(r[c] for c in columns)) for r in mine.collect()) == sorted(str(tuple(r[i] for i in order)) for r in theirs.fetchall())
