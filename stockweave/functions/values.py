"""Attribute values held as JSON text: ``"abc"``, ``12.5``, ``true``, ``null``, ``["a","b"]``.

The text keeps the type of a value and tells a null value from an absent one, yet compares and groups as a
plain string.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from stockweave.functions.columns import col

NUMBER = r"^-?(0|[1-9][0-9]*)(\.[0-9]+)?([eE][+-]?[0-9]+)?$"


def quoted(text) -> Column:
    """Plain text as a JSON string."""
    escaped = F.regexp_replace(F.regexp_replace(col(text), r"\\", r"\\\\"), '"', r'\\"')
    return F.concat(F.lit('"'), escaped, F.lit('"'))


def plain(value) -> Column:
    """The value as text, without quotes; null for JSON null or an absent value."""
    v = col(value)
    return F.when(v.startswith('"'), F.get_json_object(F.concat(F.lit('{"v":'), v, F.lit("}")), "$.v")) \
        .when(v != "null", v)


def is_list(value) -> Column:
    return col(value).startswith("[")


def items(value) -> Column:
    """Elements of a list value as text; null when the value is no list."""
    return F.when(is_list(value), F.from_json(col(value), "array<string>"))


def pairs_text(attrs) -> Column:
    """An attribute map as ``k=v  k2=v2`` in key order, empty values left out; empty text for an empty map."""
    kept = F.filter(F.map_entries(col(attrs)), lambda e: ~is_empty(e["value"]))
    return F.array_join(F.transform(F.array_sort(kept), lambda e: F.concat(e["key"], F.lit("="), shown(e["value"]))), "  ")


def shown(value) -> Column:
    """A value as displayed: list elements joined by ``; ``."""
    return F.coalesce(F.array_join(items(value), "; "), plain(value))


def canonical(value) -> Column:
    """Equal numbers get equal text (1, 1.0 and 1e0 agree); other values stay as they are."""
    v = col(value)
    return F.when(v.rlike(NUMBER), v.cast("double").cast("string")).otherwise(v)


def is_empty(value) -> Column:
    """Absent, null, empty text, empty list or empty map."""
    v = col(value)
    return v.isNull() | v.isin("null", '""', "[]", "{}")
