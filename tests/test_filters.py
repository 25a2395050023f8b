"""Filters against a plain evaluator, and their JSON forms."""

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from vecspark.functions.filters import And, Eq, MatchAll, Not, Or, Range, compile_filter, matches, parse_filter
from vecspark.model import METADATA, InvalidFilter, ResourceExhausted, Value, metadata_row

POINTS = [
    ("a", {"n": 1, "k": "x", "f": 1.0, "b": True}),
    ("b", {"n": 1.0, "k": "y", "b": False}),
    ("c", {"n": "1", "f": -0.0}),
    ("d", {}),
    ("e", {"n": 15, "k": "x", "f": 2.5}),
    ("f", {"n": True, "k": "X"}),
]

leaf = st.one_of(
    st.just(MatchAll()),
    st.builds(Eq, st.sampled_from(["n", "k", "f", "b", "z"]), st.sampled_from([1, 1.0, "1", "x", True, False, 0.0, 15]).map(Value.of)),
    st.builds(Range, st.sampled_from(["n", "k", "f", "z"]), st.sampled_from([None, -1.0, 0.0, 1.0, 2.0, float("nan")]), st.sampled_from([None, 0.0, 1.0, 2.0, 16.0])),
)
tree = st.recursive(leaf, lambda x: st.one_of(st.builds(Not, x), st.lists(x, max_size=3).map(lambda v: And(tuple(v))), st.lists(x, max_size=3).map(lambda v: Or(tuple(v)))), max_leaves=6)


@pytest.fixture(scope="module")
def frame(spark):
    rows = [(i, metadata_row(m)) for i, m in POINTS]
    return spark.createDataFrame(rows, "id string, metadata " + METADATA.simpleString()).cache()


@settings(max_examples=4, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(tree, min_size=30, max_size=30))
def test_algebra(frame, filters):
    found = frame.select("id", *[compile_filter(f).alias(f"f{k}") for k, f in enumerate(filters)]).collect()
    for row in found:
        metadata = {k: Value.of(v) for k, v in dict(POINTS)[row["id"]].items()}
        for k, f in enumerate(filters):
            assert row[f"f{k}"] is matches(f, metadata), (f, row["id"])


def test_nan_is_never_equal(spark):
    point = spark.createDataFrame([("a", {"f": {"kind": "float", "s": None, "i": None, "f": float("nan"), "b": None}})], "id string, metadata " + METADATA.simpleString())
    for f in (Eq("f", Value("float", float("nan"))), Range("f"), Range("f", 0.0)):
        assert point.where(compile_filter(f)).count() == 0
        assert point.where(compile_filter(Not(f))).count() == 1


def test_promoted_columns_reach_the_scan(spark, tmp_path):
    spark.range(10).select(F.col("id").cast("string").alias("id"), F.col("id").alias("label")).write.parquet(str(tmp_path / "p"))
    df = spark.read.parquet(str(tmp_path / "p")).where(compile_filter(Eq("label", 3), promoted={("label", "integer"): "label"}))
    assert df.count() == 1


def test_json_forms():
    assert parse_filter({"op": "eq", "field": "a", "value": 1}) == Eq("a", 1)
    assert parse_filter({"Eq": {"field": "a", "value": {"Keyword": "x"}}}) == Eq("a", "x")
    assert parse_filter({"op": "and", "filters": [{"op": "range", "field": "p", "gte": 1}, {"op": "not", "filter": {"op": "match_all"}}]}) == And((Range("p", 1.0, None), Not(MatchAll())))
    assert parse_filter({"Not": {"Or": ["MatchAll"]}}) == Not(Or((MatchAll(),)))


@pytest.mark.parametrize("bad", [{}, {"op": "like"}, {"op": "eq", "field": "", "value": 1}, {"op": "eq", "field": "a", "value": None}, {"op": "and", "filters": 3}, {"op": "range", "field": "a", "gte": True}, {"op": "eq", "field": "x" * 129, "value": 1}])
def test_bad_filters(bad):
    with pytest.raises(InvalidFilter):
        parse_filter(bad)


def test_bounds_of_filters():
    deep = {"op": "match_all"}
    for _ in range(33):
        deep = {"op": "not", "filter": deep}
    with pytest.raises(ResourceExhausted):
        parse_filter(deep)
    with pytest.raises(ResourceExhausted):
        parse_filter({"op": "or", "filters": [{"op": "match_all"}] * 1025})
