"""Identity keys: normalised names, node ids, references, name tokens."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from stockweave.functions.columns import col


def norm_key(name) -> Column:
    """Lower case with everything outside ``[a-z0-9]`` removed."""
    return F.regexp_replace(F.lower(col(name)), "[^a-z0-9]+", "")


def node_id(type_, name) -> Column:
    return F.concat(col(type_), F.lit(":"), norm_key(name))


def has_type_prefix(ref) -> Column:
    return F.instr(col(ref), ":") > 0


def ref_type(ref) -> Column:
    """Part before the first colon, trimmed; null when there is no colon."""
    r = col(ref)
    return F.when(has_type_prefix(r), F.trim(F.substring_index(r, ":", 1)))


def ref_name(ref) -> Column:
    """Part after the first colon (it may itself hold colons), trimmed; null without a colon."""
    r = col(ref)
    return F.when(has_type_prefix(r), F.trim(F.element_at(F.split(r, ":", 2), 2)))


def tokens(name) -> Column:
    """Distinct non-empty ``[a-z0-9]+`` runs of the lower-cased name."""
    words = F.split(F.lower(col(name)), "[^a-z0-9]+")
    return F.array_distinct(F.filter(words, lambda w: w != ""))


def name_keys(name, aliases) -> Column:
    """Distinct keys of a node: its name and all its aliases."""
    surfaces = F.concat(F.array(col(name)), F.coalesce(col(aliases), F.array().cast("array<string>")))
    return F.array_distinct(F.transform(surfaces, norm_key))
