"""Metadata values as JSON."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def quoted(text: Column) -> Column:
    """A string as JSON, with its quotes."""
    listed = F.to_json(F.array(text))
    return F.substring(listed, F.lit(2), F.length(listed) - 2)


def metadata_json(metadata: Column) -> Column:
    """Metadata as a JSON object of plain values, in the order of their names;
    null metadata is an empty object."""
    fields = F.array_sort(F.filter(F.map_keys(metadata), lambda k: metadata[k].isNotNull()))

    def value(v: Column) -> Column:
        number = F.to_json(F.array(v["f"]))
        return F.when(v["kind"] == "keyword", quoted(v["s"])).when(v["kind"] == "integer", v["i"].cast("string")).when(v["kind"] == "float", F.substring(number, F.lit(2), F.length(number) - 2)).otherwise(v["b"].cast("string"))

    shown = F.transform(fields, lambda k: F.concat(quoted(k), F.lit(":"), value(metadata[k])))
    return F.concat(F.lit("{"), F.array_join(F.coalesce(shown, F.array().cast("array<string>")), ","), F.lit("}"))
