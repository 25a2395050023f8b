"""Metadata filters: a tree, its JSON forms, and its compilation to a column.

A filter is true or false and never null: a leaf on a field that a point does
not have is false, and its negation is true.  Equality holds within a kind only.
"""

from __future__ import annotations

import math
from collections.abc import Mapping
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from vecspark.functions.vectors import finite
from vecspark.model import PAYLOAD, InvalidFilter, ResourceExhausted, Value

MAX_DEPTH = 32
MAX_NODES = 1024
MAX_FIELD_BYTES = 128


@dataclass(frozen=True)
class MatchAll:
    pass


@dataclass(frozen=True)
class Eq:
    field: str
    value: Value

    def __post_init__(self) -> None:
        object.__setattr__(self, "value", Value.of(self.value))


@dataclass(frozen=True)
class Range:
    """At least ``gte`` and less than ``lt``; either may be missing."""

    field: str
    gte: float | None = None
    lt: float | None = None


@dataclass(frozen=True)
class And:
    filters: tuple = field(default_factory=tuple)


@dataclass(frozen=True)
class Or:
    filters: tuple = field(default_factory=tuple)


@dataclass(frozen=True)
class Not:
    filter: object


Filter = MatchAll | Eq | Range | And | Or | Not


def sure(condition: Column) -> Column:
    """Null is false."""
    return F.coalesce(condition, F.lit(False))


def compile_filter(f: Filter, metadata: Column | str = "metadata", promoted: Mapping[tuple[str, str], str] | None = None) -> Column:
    """The column of a filter over a metadata map.

    ``promoted`` names top-level columns that hold a field's payload of one kind
    (null where the field has another kind or is missing); leaves on those use
    them, so that they reach the Parquet scan.
    """
    at = F.col(metadata) if isinstance(metadata, str) else metadata
    promoted = promoted or {}

    def go(f: Filter) -> Column:
        if isinstance(f, MatchAll):
            return F.lit(True)
        if isinstance(f, Eq):
            kind, value = f.value.kind, f.value.value
            if isinstance(value, float) and math.isnan(value):
                return F.lit(False)
            if (f.field, kind) in promoted:
                stored = F.col(promoted[f.field, kind])
                same = stored == F.lit(value)
            else:
                entry = at[f.field]
                stored = entry[PAYLOAD[kind]]
                same = (entry["kind"] == kind) & (stored == F.lit(value))
            return sure(same & ~F.isnan(stored)) if kind == "float" else sure(same)
        if isinstance(f, Range):
            bounds = [b for b in (f.gte, f.lt) if b is not None]
            if any(math.isnan(b) for b in bounds) or len(bounds) == 2 and f.gte >= f.lt:
                return F.lit(False)
            held = [k for k in ("integer", "float") if (f.field, k) in promoted]
            if len(held) == 2:
                number = F.coalesce(F.col(promoted[f.field, "integer"]).cast("double"), F.col(promoted[f.field, "float"]))
            else:
                entry = at[f.field]
                number = F.when(entry["kind"] == "integer", entry["i"].cast("double")).when(entry["kind"] == "float", entry["f"])
            tests = [finite(number)]
            if f.gte is not None:
                tests.append(number >= F.lit(float(f.gte)))
            if f.lt is not None:
                tests.append(number < F.lit(float(f.lt)))
            return sure(reduce(lambda a, b: a & b, tests))
        if isinstance(f, And):
            return reduce(lambda a, b: a & b, map(go, f.filters), F.lit(True))
        if isinstance(f, Or):
            return reduce(lambda a, b: a | b, map(go, f.filters), F.lit(False))
        if isinstance(f, Not):
            return ~go(f.filter)
        raise InvalidFilter(f"no filter: {f!r}")

    return go(f)


def matches(f: Filter, metadata: Mapping[str, Value]) -> bool:
    """The same for one point in plain Python, as tests and the service use it."""
    if isinstance(f, MatchAll):
        return True
    if isinstance(f, Eq):
        v = metadata.get(f.field)
        return v is not None and v.kind == f.value.kind and v.value == f.value.value
    if isinstance(f, Range):
        v = metadata.get(f.field)
        if v is None or v.kind not in ("integer", "float") or not math.isfinite(v.value):
            return False
        return (f.gte is None or float(v.value) >= f.gte) and (f.lt is None or float(v.value) < f.lt)
    if isinstance(f, And):
        return all(matches(x, metadata) for x in f.filters)
    if isinstance(f, Or):
        return any(matches(x, metadata) for x in f.filters)
    return not matches(f.filter, metadata)


def parse_filter(given: object) -> Filter:
    """A filter from its JSON form, ``{"op": "eq", ...}`` or tagged ``{"Eq": {...}}``."""
    nodes = 0

    def name(x: object) -> str:
        if not isinstance(x, str) or not 0 < len(x.encode()) <= MAX_FIELD_BYTES:
            raise InvalidFilter(f"a field's name has 1 to {MAX_FIELD_BYTES} bytes")
        return x

    def bound(x: object) -> float | None:
        if x is None:
            return None
        if isinstance(x, bool) or not isinstance(x, int | float):
            raise InvalidFilter("a bound is a number")
        return float(x)

    def value(x: object) -> Value:
        if isinstance(x, dict) and len(x) == 1:
            (tag, inner), = x.items()
            kind = str(tag).lower()
            if kind not in PAYLOAD:
                raise InvalidFilter(f"no kind of value: {tag}")
            return Value(kind, float(inner) if kind == "float" else inner)
        try:
            return Value.of(x)
        except Exception as e:
            raise InvalidFilter(str(e)) from None

    def many(x: object, depth: int) -> tuple:
        if not isinstance(x, list):
            raise InvalidFilter("filters come in a list")
        return tuple(go(y, depth + 1) for y in x)

    def go(x: object, depth: int) -> Filter:
        nonlocal nodes
        nodes += 1
        if depth >= MAX_DEPTH or nodes > MAX_NODES:
            raise ResourceExhausted(f"a filter has at most {MAX_NODES} nodes and a depth under {MAX_DEPTH}")
        if x == "MatchAll":
            return MatchAll()
        if not isinstance(x, dict):
            raise InvalidFilter("a filter is an object")
        if "op" not in x:
            if len(x) != 1:
                raise InvalidFilter("a filter has an op")
            (tag, body), = x.items()
            key = {"And": "filters", "Or": "filters", "Not": "filter"}.get(tag)
            x = {"op": {"MatchAll": "match_all"}.get(tag, str(tag).lower())} | ({key: body} if key else body if isinstance(body, dict) else {})
        op = x["op"]
        if op == "match_all":
            return MatchAll()
        if op == "eq":
            return Eq(name(x.get("field")), value(x.get("value")))
        if op == "range":
            return Range(name(x.get("field")), bound(x.get("gte")), bound(x.get("lt")))
        if op in ("and", "or"):
            return (And if op == "and" else Or)(many(x.get("filters"), depth))
        if op == "not":
            return Not(go(x.get("filter"), depth + 1))
        raise InvalidFilter(f"no such op: {op!r}")

    return go(given, 0)
