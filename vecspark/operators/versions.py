"""The mutation log: the newest version of each id, as-of reads, dedup, replay.

A log row has id, op (upsert or delete), sequence (of its batch) and ordinal (its
place in the batch); the last one of an id counts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vecspark.model import SequenceGap


def newest(log: DataFrame) -> DataFrame:
    """The last row of each id, deletes included."""
    order = [F.col("sequence").desc(), *([F.col("ordinal").desc()] if "ordinal" in log.columns else [])]
    # the row number is limited to one before rows are dealt out, too
    return log.withColumn("_n", F.row_number().over(Window.partitionBy("id").orderBy(*order))).where("_n = 1").drop("_n")


def latest(log: DataFrame) -> DataFrame:
    """The live points: the newest version of each id that isn't deleted."""
    return newest(log).where("op = 'upsert'")


def as_of(log: DataFrame, sequence: int) -> DataFrame:
    """The live points as they were after a sequence."""
    return latest(log.where(F.col("sequence") <= sequence))


def pending(log: DataFrame, flushed: int) -> DataFrame:
    """Ids changed after a sequence."""
    return log.where(F.col("sequence") > flushed).select("id").distinct()


def delta_segment(log: DataFrame, flushed: int) -> DataFrame:
    """What a flush after ``flushed`` writes: the changed points that live."""
    return latest(log.where(F.col("sequence") > flushed))


def delta_tombstones(log: DataFrame, flushed: int) -> DataFrame:
    """The ids that such a flush marks as deleted."""
    return newest(log.where(F.col("sequence") > flushed)).where("op = 'delete'").select("id")


def dedup_requests(log: DataFrame) -> DataFrame:
    """Each (client_id, request_id) once, as it came first; without any horizon."""
    w = Window.partitionBy("client_id", "request_id").orderBy("sequence")
    return log.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def check_consecutive(sequences: DataFrame, after: int) -> int:
    """The last sequence of a log that continues ``after`` without a gap."""
    found = sequences.where(F.col("sequence") > after).agg(F.countDistinct("sequence").alias("n"), F.max("sequence").alias("last")).first()
    if found["n"] and found["last"] != after + found["n"]:
        raise SequenceGap(f"{found['n']} batches after {after} end with {found['last']}")
    return found["last"] or after


def replay(base: DataFrame, log: DataFrame, after: int) -> DataFrame:
    """The live points of a base that stood at ``after`` and the log beyond it."""
    check_consecutive(log, after)
    return latest(base.unionByName(log.where(F.col("sequence") > after), allowMissingColumns=True))
