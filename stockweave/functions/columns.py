"""Helpers that build one column from another."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def col(c) -> Column:
    return c if isinstance(c, Column) else F.col(c)


def trim_number(x) -> Column:
    """A double as text with no trailing zeros: 12.5 -> ``12.5``, 12.0 -> ``12`` (six significant decimals)."""
    fixed = F.format_string("%.6f", col(x).cast("double"))
    return F.regexp_replace(F.regexp_replace(fixed, "0+$", ""), "\\.$", "")


def cents(amount) -> Column:
    """Money in integer cents, halves rounded up."""
    return F.round(col(amount) * 100).cast("bigint")


def truthy(c) -> Column:
    """Null and empty text count as missing."""
    c = col(c)
    return c.isNotNull() & (c.cast("string") != "")


def micros(ts) -> Column:
    return F.unix_micros(col(ts).cast("timestamp"))


def first_upper(c) -> Column:
    c = col(c)
    return F.concat(F.upper(F.substring(c, 1, 1)), F.substr(c, F.lit(2)))
