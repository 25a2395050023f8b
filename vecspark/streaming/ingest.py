"""Streams of mutations into a log or a collection.

A batch of the stream is one commit.  Requests that the log has seen are left out,
without any horizon; a batch that is tried again replaces itself, as its folder is
named by its number, or is known from the collection's commits.
"""

from __future__ import annotations

import threading
import time
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from vecspark.operators import versions
from vecspark.sources.files import Files
from vecspark.sources.store import Collection

#: Folders that the keys of requests are dealt into; a batch reads those it has keys for.
LEDGER_BUCKETS = 64


def to_log(stream: DataFrame, path: str, checkpoint: str, dedup: bool = False, trigger: dict | None = None) -> StreamingQuery:
    """Appends a stream of mutations to the log at ``path``, all that there are now.

    With ``dedup`` each (client_id, request_id) takes effect once.  The keys seen
    are kept next to the rows, by key hash: a batch reads the keys alone, and of the
    buckets that it has keys for.
    """
    ledger = f"{path}/_requests"
    keys = ["client_id", "request_id"]
    bucket = F.pmod(F.xxhash64(*keys), F.lit(LEDGER_BUCKETS)).cast("int")

    def commit(batch: DataFrame, number: int) -> None:
        spark, rows = batch.sparkSession, batch
        if dedup:
            rows = versions.dedup_requests(rows)
            if Files(spark).exists(ledger):
                touched = [r[0] for r in rows.select(bucket).distinct().collect()]  # at most the buckets
                seen = spark.read.schema(rows.select(*keys, F.lit(0).alias("bucket"), F.lit(0).alias("batch")).schema).parquet(ledger)
                # a batch that is tried again doesn't see itself
                seen = seen.where(F.col("bucket").isin(touched) & (F.col("batch") < number)).select(*keys)
                rows = rows.join(seen, keys, "left_anti")
        rows.select(*batch.columns).write.mode("overwrite").parquet(f"{path}/batch={number}")
        if dedup:
            done = spark.read.schema(batch.schema).parquet(f"{path}/batch={number}")
            done.select(*keys, bucket.alias("bucket"), F.lit(number).alias("batch")).write.mode("append").partitionBy("bucket", "batch").parquet(ledger)

    return stream.writeStream.foreachBatch(commit).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def to_collection(
    stream: DataFrame,
    collection: Collection,
    checkpoint: str,
    flush_at: int = 10_000,
    flush_every: float | None = None,
    on_commit: Callable[[int], None] | None = None,
    trigger: dict | None = None,
) -> StreamingQuery:
    """Commits a stream of points (id, vector, metadata, op, ordinal) to a
    collection, one commit a batch, which holds the batch's number: one that is
    tried again after its commit does nothing.  Flushes when ``flush_at`` ids are
    pending or ``flush_every`` seconds have gone since the last flush."""
    flushed = time.monotonic()

    def commit(batch: DataFrame, number: int) -> None:
        nonlocal flushed
        last = versions.newest(batch.withColumn("sequence", F.lit(0))).select("id", "vector", "metadata", "op")
        collection.apply(last, stream=(checkpoint, number))
        if collection.pending() >= flush_at or flush_every is not None and time.monotonic() - flushed >= flush_every:
            collection.flush()
            flushed = time.monotonic()
        if on_commit:
            on_commit(number)

    return stream.writeStream.foreachBatch(commit).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


class BackgroundFlush:
    """Flushes a collection from a thread when ``at`` ids are pending, or any are and
    ``every`` seconds have gone.  Changes take ``lock``, so that a flush and a change
    follow each other.  An error stops the thread; ``close`` raises it."""

    def __init__(self, collection: Collection, every: float = 60.0, at: int = 10_000, look: float = 1.0):
        self.collection, self.every, self.at, self.look = collection, every, at, look
        self.lock, self.ended, self.error, self.flushes = threading.RLock(), threading.Event(), None, 0
        self.thread = threading.Thread(target=self._run, daemon=True)
        self.thread.start()

    def _run(self) -> None:
        last = time.monotonic()
        while not self.ended.wait(self.look):
            try:
                with self.lock:
                    pending = self.collection.pending()
                    if pending >= self.at or pending and time.monotonic() - last >= self.every:
                        self.collection.flush()
                        self.flushes += 1
                        last = time.monotonic()
            except Exception as e:  # noqa: BLE001
                self.error = e
                return

    def close(self) -> None:
        self.ended.set()
        self.thread.join()
        if self.error is not None:
            raise self.error
        with self.lock:
            if self.collection.pending():
                self.collection.flush()
                self.flushes += 1
