"""Scores, normalisation and quantisation of vectors as columns.

Sums are taken in double precision.  A larger score is always better: the
Euclidean score is the negative squared distance.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from vecspark.model import Metric


def literal(vector: Sequence[float]) -> Column:
    return F.array(*[F.lit(float(x)) for x in vector]).cast("array<double>")


def finite(x: Column) -> Column:
    return ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))


def is_valid(vector: Column, dimension: int) -> Column:
    """Whether a vector has its dimension and finite components only."""
    return F.coalesce((F.size(vector) == dimension) & F.forall(vector, lambda x: F.coalesce(finite(x), F.lit(False))), F.lit(False))


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def squared_norm(v: Column) -> Column:
    return total(F.transform(v, lambda x: x.cast("double") * x.cast("double")))


def squared_distance(a: Column, b: Column) -> Column:
    def square(x: Column, y: Column) -> Column:
        d = x.cast("double") - y.cast("double")
        return d * d

    return total(F.zip_with(a, b, square))


def normalized(v: Column) -> Column:
    """The vector of length one in the same direction; null for a vector of length zero."""
    norm = F.sqrt(squared_norm(v))
    return F.when(finite(norm) & (norm > 0), F.transform(v, lambda x: x.cast("double") / norm))


def score(metric: Metric, stored: Column, query: Column) -> Column:
    """Score of prepared vectors: for cosine both are of length one already."""
    if metric == Metric.EUCLIDEAN:
        return -squared_distance(stored, query) + F.lit(0.0)
    return dot(stored, query) + F.lit(0.0)


def single(x: Column) -> Column:
    """Rounded to single precision, as a double."""
    return x.cast("float").cast("double")


def bound(value: Column, make: Callable[[Column], Column]) -> Column:
    """What ``make`` gives for a value that is computed once, also where lambdas use it."""
    return F.transform(F.array(value), make)[0]


def quantize(v: Column) -> Column:
    """Struct of codes from -127 to 127, the scale, and the squared norm of what the
    codes stand for; components count as rounded to single precision."""

    def codes_of(v: Column, scale: Column) -> Column:
        return F.transform(v, lambda x: F.greatest(F.lit(-127), F.least(F.lit(127), F.round(single(x / scale)).cast("int"))))

    def scale_of(v: Column) -> Column:
        most = F.array_max(F.transform(v, lambda x: F.abs(x)))
        return F.when(most > 0, single(most / 127)).otherwise(F.lit(1.0))

    def made(codes: Column, scale: Column) -> Column:
        squares = F.aggregate(codes, F.lit(0).cast("long"), lambda a, c: a + c * c)
        return F.struct(codes.cast("array<tinyint>").alias("codes"), scale.cast("float").alias("scale"), (squares.cast("double") * scale * scale).alias("squared"))

    return bound(F.transform(v, single), lambda v: bound(scale_of(v), lambda scale: bound(codes_of(v, scale), lambda codes: made(codes, scale))))


def score_int8(metric: Metric, a: Column, b: Column) -> Column:
    """Score of two quantised vectors."""
    codes = F.aggregate(F.zip_with(a["codes"], b["codes"], lambda x, y: x.cast("long") * y.cast("long")), F.lit(0).cast("long"), lambda s, x: s + x)
    product = codes.cast("double") * a["scale"].cast("double") * b["scale"].cast("double")
    if metric == Metric.DOT:
        return product
    if metric == Metric.EUCLIDEAN:
        return -F.greatest(F.lit(0.0), a["squared"] + b["squared"] - 2 * product) + F.lit(0.0)
    lengths = F.sqrt(a["squared"] * b["squared"])
    return F.when(lengths > 0, product / lengths).otherwise(F.lit(0.0))


def fnv1a64(text: Column) -> Column:
    """The 64-bit FNV-1a hash of a string's UTF-8 bytes, as the bits of a long.

    The product with the prime is taken in halves, as a long product would overflow.
    """
    data = F.encode(text, "UTF-8")
    octets = F.transform(F.sequence(F.lit(1), F.octet_length(data)), lambda i: F.conv(F.hex(F.substring(data, i, F.lit(1))), 16, 10).cast("long"))
    octets = F.when(F.octet_length(data) > 0, octets).otherwise(F.array().cast("array<bigint>"))
    low32 = F.lit(0xFFFFFFFF)

    def step(h: Column, octet: Column) -> Column:
        x = h.bitwiseXOR(octet)
        low = x.bitwiseAND(low32) * F.lit(0x1B3)
        high = F.shiftrightunsigned(x, 32) * F.lit(0x1B3) + F.shiftrightunsigned(low, 32) + F.shiftleft(x.bitwiseAND(F.lit(0xFFFFFF)), 8)
        return F.shiftleft(high.bitwiseAND(low32), 32).bitwiseOR(low.bitwiseAND(low32))

    # fixed value: the offset basis 0xcbf29ce484222325 as a signed long
    return F.aggregate(octets, F.lit(-3750763034362895579).cast("long"), step)


def shard_of(id_: Column, shards: int) -> Column:
    """The hash of an id, unsigned, modulo the number of shards."""
    h = fnv1a64(id_)
    half = F.shiftrightunsigned(h, 1) % shards
    return ((half * 2 + h.bitwiseAND(F.lit(1).cast("long"))) % shards).cast("int")
