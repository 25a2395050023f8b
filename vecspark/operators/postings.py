"""Metadata postings: a row for each field, kind and value that a point has.

The set algebra on them is the counterpart of an inverted index; columns that
are promoted out of the map are the faster way, as they reach the scan.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vecspark.functions.filters import And, Eq, Filter, MatchAll, Not, Or, Range
from vecspark.functions.vectors import finite
from vecspark.model import PAYLOAD, InvalidFilter


def postings(points: DataFrame) -> DataFrame:
    """field, kind, s, i, f, b, number and id of each metadata value."""
    rows = points.select("id", F.explode("metadata").alias("field", "v"))
    number = F.when(F.col("v.kind") == "integer", F.col("v.i").cast("double")).when(F.col("v.kind") == "float", F.col("v.f"))
    return rows.select("field", F.col("v.kind").alias("kind"), *[F.col(f"v.{c}").alias(c) for c in "sifb"], number.alias("number"), "id")


def candidates(index: DataFrame, everyone: DataFrame, f: Filter) -> DataFrame:
    """The ids that a filter holds for; ``everyone`` has all ids."""
    if isinstance(f, MatchAll):
        return everyone.select("id").distinct()
    if isinstance(f, Eq):
        stored = F.col(PAYLOAD[f.value.kind])
        test = (F.col("field") == f.field) & (F.col("kind") == f.value.kind) & (stored == F.lit(f.value.value))
        return index.where(test & ~F.isnan("f") if f.value.kind == "float" else test).select("id").distinct()
    if isinstance(f, Range):
        test = (F.col("field") == f.field) & finite(F.col("number"))
        if f.gte is not None:
            test &= (F.col("number") >= F.lit(float(f.gte))) & ~F.isnan(F.lit(float(f.gte)))
        if f.lt is not None:
            test &= (F.col("number") < F.lit(float(f.lt))) & ~F.isnan(F.lit(float(f.lt)))
        return index.where(test).select("id").distinct()
    if isinstance(f, And):
        return reduce(lambda a, b: a.intersect(b), (candidates(index, everyone, x) for x in f.filters)) if f.filters else everyone.select("id").distinct()
    if isinstance(f, Or):
        return reduce(lambda a, b: a.union(b), (candidates(index, everyone, x) for x in f.filters)).distinct() if f.filters else everyone.select("id").limit(0)
    if isinstance(f, Not):
        return everyone.select("id").distinct().join(candidates(index, everyone, f.filter), "id", "left_anti")
    raise InvalidFilter(f"no filter: {f!r}")
