"""Connected components by contraction, for links between long node ids."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vecspark.llm.shared import temporary, written

#: Links that one task joins at most; with more there is a further round.
TAIL = 10_000


def joined(batches):
    """(node, label) of the nodes of a bounded number of links, by union and find."""
    above: dict[int, int] = {}

    def root(x: int) -> int:
        while above.setdefault(x, x) != x:
            above[x] = above[above[x]]
            x = above[x]
        return x

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            above[root(a)] = root(b)
    nodes = list(above)
    yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array([root(x) for x in nodes], pa.int64())], ["node", "label"])


def connected_components(links: DataFrame) -> DataFrame:
    """(node, label) of every node that has a link; nodes that reach each other
    share a label.  ``links`` has the long columns a and b.

    In each round a node joins that node among itself and its neighbours whose
    hash comes first, and the links are drawn between what nodes have joined.  Random
    order makes the number of rounds logarithmic, also for chains; minima are
    taken before rows are dealt out, so a node with very many links is no burden.
    Once ``TAIL`` links are left, a count that doesn't grow with the input, one task
    joins these.
    """
    with temporary() as keep:
        return keep(_components(links))


def _components(links: DataFrame) -> DataFrame:
    rounds = []
    links = written(links.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links")
    while left := links.count():
        if left <= TAIL:
            rounds.append(written(links.repartition(1).mapInArrow(joined, "node long, label long"), "step"))
            break
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        order = F.struct(F.xxhash64("b", F.lit(len(rounds))).alias("h"), F.col("b").alias("n"))
        own = F.struct(F.xxhash64("a", F.lit(len(rounds))).alias("h"), F.col("a").alias("n"))
        step = written(both.groupBy("a").agg(F.min(order).alias("m")).select(F.col("a").alias("node"), F.least("m", own)["n"].alias("label")), "step")
        rounds.append(step)
        to_a, to_b = (step.select(F.col("node").alias(c), F.col("label").alias("to_" + c)) for c in ("a", "b"))
        moved = links.join(to_a, "a").join(to_b, "b").where("to_a <> to_b")
        links = written(moved.select(F.least("to_a", "to_b").alias("a"), F.greatest("to_a", "to_b").alias("b")).distinct(), "links")
    if not rounds:
        return written(links.select(F.col("a").alias("node"), F.col("b").alias("label")), "components")
    out = rounds[0]
    for step in rounds[1:]:
        more = step.select(F.col("node").alias("label"), F.col("label").alias("further"))
        out = out.join(more, "label", "left").select("node", F.coalesce("further", "label").alias("label"))
    return written(out, "components") if len(rounds) > 1 else out
