"""Which way a search goes, and how wide.

A filter that few points pass is answered exactly; else candidates come from
codes, widened until enough of them pass, and exactly if they never do.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vecspark.functions.filters import Filter, MatchAll, compile_filter
from vecspark.model import Metric
from vecspark.operators import search

# The widths searches have when none is asked for.
EF_LOCAL = (4, 96)
EF_REPLICATED = (16, 256)
REBUILD_PENDING = 256


def default_ef(k: int, replicated: bool = False) -> int:
    factor, least = EF_REPLICATED if replicated else EF_LOCAL
    return max(factor * k, least)


def goes_exact(passing: int, indexed: int, k: int) -> bool:
    """Whether a filter is selective enough for an exact answer."""
    return 4 * passing < indexed or passing <= max(EF_REPLICATED[0] * k, EF_REPLICATED[1])


def rebuild_due(pending: int, points: int, has_index: bool) -> bool:
    """Whether the codes are worth building again."""
    return pending >= REBUILD_PENDING and (not has_index or pending >= max(-(-points // 5), REBUILD_PENDING))


def adaptive(points: DataFrame, coded: DataFrame, query: Sequence[float], k: int, metric: Metric, where: Filter = MatchAll(), ef: int | None = None) -> DataFrame:
    """id and score of the k best that pass, by the way that fits the filter."""
    search.check_query(query, k, None, ef)
    passing = points.where(compile_filter(where))
    indexed, n = coded.count(), passing.count()
    if goes_exact(n, indexed, k):
        return search.exact(passing, query, k, metric).select("id", "score")
    width = max(ef or default_ef(k, True), 8 * 4 * k)
    ids = passing.select("id")
    while True:
        found = search.candidates_int8(coded, [("q", query)], width, metric).join(ids, "id", "left_semi")
        if len(found.select("id").take(k)) >= min(k, n):
            return search.rescore(found, points, [("q", query)], k, metric, width).select("id", "score").orderBy(F.desc("score"), F.asc("id"))
        if width >= indexed:
            return search.exact(passing, query, k, metric).select("id", "score")
        width *= 2
