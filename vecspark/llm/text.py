"""Helpers shared by the text operators: Arrow columns to bytes, bounded
sub-batches, and a bounded memo of results per distinct word."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes of text handled at a time inside a worker.
SUB_BATCH_BYTES = 4 << 20


def keyed_text(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the id and the text of ``df``, as ``doc_id`` (long) and ``text``.

    Columns that the caller does not use are pruned, so other columns of any
    name cannot clash with what an operator adds.
    """
    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def texts_of(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string or binary column; null is empty."""
    return [b if b is not None else b"" for b in column.cast(pa.binary()).to_pylist()]


def sub_batches(batches: Iterable[pa.RecordBatch], text_col: str = "text", limit: int = SUB_BATCH_BYTES) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Slices of the incoming batches with about ``limit`` bytes of text each
    (one longer text stays whole), together with the texts as bytes."""
    for batch in batches:
        column = batch.column(batch.schema.get_field_index(text_col))
        sizes = [n or 0 for n in pc.binary_length(column).to_pylist()]
        start = held = 0
        for i, n in enumerate(sizes):
            if held and held + n > limit:
                part = batch.slice(start, i - start)
                yield part, texts_of(column.slice(start, i - start))
                start, held = i, 0
            held += n + 64
        if start < len(sizes):
            yield batch.slice(start), texts_of(column.slice(start))


class WordMemo:
    """Results per distinct word, computed in vectorised lots.  Two generations
    of a bounded number of words are kept; words in use move to the younger."""

    def __init__(self, compute: Callable[[list[bytes]], list], limit: int = 200_000):
        self.compute, self.limit = compute, limit
        self.young: dict = {}
        self.old: dict = {}

    def of(self, token_lists: list[list[bytes]]) -> dict:
        words = set().union(*token_lists)
        missing = words.difference(self.young)
        if len(self.young) + len(missing) > self.limit:
            self.old, self.young, missing = self.young, {}, words
        old = self.old
        if old:
            self.young.update((w, old[w]) for w in missing if w in old)
            missing = [w for w in missing if w not in old]
        else:
            missing = list(missing)
        if missing:
            self.young.update(zip(missing, self.compute(missing)))
        return self.young
