"""Canonical JSON of nested, typed values, and matching by it."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def canonical_json(text: Column) -> Column:
    """JSON with sorted keys at every depth and no white space; null for what is no JSON, or has a key twice.

    Spark's variant keeps the fields of an object in the order of their keys, whatever their order in
    the text, and writes 1.50 as 1.5, so equal values are equal text; 1, "1" and true stay apart.
    """
    inside = F.concat(F.lit("["), text, F.lit("]"))
    whole = F.size(F.from_json(inside, "array<variant>")) == 1  # nothing may follow the value
    return F.when(whole, F.to_json(F.try_parse_json(text)))


def canonical_hash(text: Column) -> Column:
    return F.sha2(canonical_json(text), 256)


def where_dimensions(rows: DataFrame, wanted: dict[str, object], dimensions: str = "dimensions") -> DataFrame:
    """Rows whose dimensions have every wanted value, of the wanted type: a number is not its text. Values may be lists and objects."""
    found = F.from_json(dimensions, "map<string,variant>")
    for k, v in wanted.items():
        same = canonical_json(F.to_json(F.element_at(found, F.lit(k)))) == canonical_json(F.lit(json.dumps(v)))
        rows = rows.where(F.map_contains_key(found, F.lit(k)) & (F.coalesce(same, F.lit(False)) if v is not None else F.is_variant_null(F.element_at(found, F.lit(k)))))
    return rows
