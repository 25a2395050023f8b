"""Errors, metrics, configuration, metadata values and schemas."""

from __future__ import annotations

import math
from dataclasses import dataclass
from enum import Enum

from pyspark.sql import types as T


class VectorError(Exception):
    """What goes wrong in a collection; ``code`` is the service's status for it."""

    code = 400


class InvalidDimension(VectorError):
    pass


class InvalidVector(VectorError):
    pass


class InvalidId(VectorError):
    pass


class InvalidArgument(VectorError):
    pass


class InvalidFilter(VectorError):
    pass


class InvalidMetadata(VectorError):
    pass


class ConfigMismatch(VectorError):
    code = 409


class WriterBusy(VectorError):
    code = 409


class NotFound(VectorError):
    code = 404


class AlreadyExists(VectorError):
    code = 409


class ResourceExhausted(VectorError):
    code = 429


class Unauthorized(VectorError):
    code = 401


class CorruptData(VectorError):
    code = 500


class SequenceGap(VectorError):
    code = 500


class Metric(str, Enum):
    COSINE = "cosine"
    DOT = "dot"
    EUCLIDEAN = "euclidean"


MAX_DIMENSION = 4096


@dataclass(frozen=True)
class CollectionConfig:
    dimension: int
    metric: Metric

    def __post_init__(self) -> None:
        if not 0 < self.dimension <= MAX_DIMENSION:
            raise InvalidDimension(f"a dimension is from 1 to {MAX_DIMENSION}, not {self.dimension}")
        object.__setattr__(self, "metric", Metric(self.metric))


# A metadata value is one of four kinds and compares equal to its own kind only.
KINDS = ("keyword", "integer", "float", "boolean")
PAYLOAD = {"keyword": "s", "integer": "i", "float": "f", "boolean": "b"}

VALUE = T.StructType(
    [
        T.StructField("kind", T.StringType()),
        T.StructField("s", T.StringType()),
        T.StructField("i", T.LongType()),
        T.StructField("f", T.DoubleType()),
        T.StructField("b", T.BooleanType()),
    ]
)
METADATA = T.MapType(T.StringType(), VALUE)
VECTOR = T.ArrayType(T.FloatType())
POINT = T.StructType([T.StructField("id", T.StringType()), T.StructField("vector", VECTOR), T.StructField("metadata", METADATA)])
#: A mutation: ``ordinal`` is the place in its batch; ``op`` is upsert or delete.
MUTATION = T.StructType([*POINT.fields, T.StructField("op", T.StringType()), T.StructField("sequence", T.LongType()), T.StructField("ordinal", T.IntegerType())])


#: What a segment has besides: the codes of upserted vectors, for the scan of candidates.
CODES = T.StructType([T.StructField("codes", T.BinaryType()), T.StructField("scale", T.FloatType()), T.StructField("squared", T.DoubleType())])
SEGMENT = T.StructType([*MUTATION.fields, *CODES.fields])


@dataclass(frozen=True)
class Value:
    kind: str
    value: str | int | float | bool

    @classmethod
    def of(cls, given: object) -> Value:
        """The value of a JSON scalar; 1 is an integer and 1.0 is a float."""
        if isinstance(given, Value):
            return given
        if isinstance(given, bool):
            return cls("boolean", given)
        if isinstance(given, int):
            return cls("integer", given) if -(1 << 63) <= given < 1 << 63 else cls("float", float(given))
        if isinstance(given, float):
            if not math.isfinite(given):
                raise InvalidMetadata("a number in metadata is finite")
            return cls("float", given)
        if isinstance(given, str):
            return cls("keyword", given)
        raise InvalidMetadata(f"metadata holds strings, numbers and booleans, not {type(given).__name__}")

    def row(self) -> dict:
        return {"kind": self.kind} | {c: self.value if PAYLOAD[self.kind] == c else None for c in "sifb"}


def metadata_row(metadata: dict | None) -> dict[str, dict]:
    return {k: Value.of(v).row() for k, v in (metadata or {}).items()}
