"""The folder that driver and executors share, and tables written there to cut
lineage so that a lost executor costs a re-read and nothing more."""

from __future__ import annotations

import ctypes
import pickle
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from typing import Any

import pyarrow as pa
from pyspark import Broadcast, cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def by_value(spark: SparkSession, value: Any) -> Broadcast:
    """A broadcast of ``value`` with its classes, so that workers need no copy of
    this repository; ``opened`` gives the value back."""
    return spark.sparkContext.broadcast(cloudpickle.dumps(value))


def opened(shared: Broadcast) -> Any:
    """What ``by_value`` was given, made once in each worker."""
    held = shared.__dict__
    if "_opened" not in held:
        held["_opened"] = pickle.loads(shared.value)
    return held["_opened"]


def release() -> None:
    """Gives memory that a worker no longer uses back to the system, as workers
    stay for the tasks of later stages."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not glibc
        pass


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir as the cluster names it; only where it is unset and
    all runs on one machine, as in tests, a temporary folder is made."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = getattr(spark.sparkContext, "_own_shared_folder", None)
        if not folder:
            folder = spark.sparkContext._own_shared_folder = "file://" + tempfile.mkdtemp(prefix="shared-")
    return folder.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


#: Of each ``temporary`` that is open, what was written in it.
_OPEN: list[list[DataFrame]] = []


ARROW_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def bound_batches(spark: SparkSession, rows: int) -> None:
    """From now on Python functions of this session get so many rows at a time at most:
    buffers of batches, in the JVM and in workers, are some times their size."""
    spark.conf.set(ARROW_ROWS, str(min(rows, int(spark.conf.get(ARROW_ROWS)))))


def written(df: DataFrame, name: str, arrow_rows: int | None = None) -> DataFrame:
    """``df`` written to the shared folder and read back.  With ``arrow_rows`` Python
    functions in its plan get so many rows at a time at most, where rows are long."""
    path, conf = fresh_path(df.sparkSession, name), df.sparkSession.conf
    before = conf.get(ARROW_ROWS)
    if arrow_rows is not None:
        conf.set(ARROW_ROWS, str(arrow_rows))
    try:
        df.write.parquet(path)
    finally:
        conf.set(ARROW_ROWS, before)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._written_at = path
    if _OPEN:
        _OPEN[-1].append(out)
    return out


def discard(df: DataFrame) -> None:
    """Removes what ``written`` wrote; no DataFrame may need it any more."""
    context = df.sparkSession.sparkContext
    path = context._jvm.org.apache.hadoop.fs.Path(df._written_at)
    path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def temporary() -> Iterator[Callable[[DataFrame], DataFrame]]:
    """What is written inside is removed at the end, but for what is given to the
    function that this yields; all results must stand on such tables alone."""
    tables: list[DataFrame] = []
    _OPEN.append(tables)

    def keep(df: DataFrame) -> DataFrame:
        tables[:] = [t for t in tables if t is not df]
        if len(_OPEN) > 1:
            _OPEN[-2].append(df)
        return df

    try:
        yield keep
    finally:
        _OPEN.pop()
        for table in tables:
            discard(table)


def few(keys: DataFrame, bound: int) -> DataFrame:
    """``keys`` marked for broadcast if they are no more than ``bound`` rows, which
    are counted; else to be dealt out."""
    return F.broadcast(keys) if keys.count() <= bound else keys


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
