"""Helpers the operators share."""

from __future__ import annotations

import gc

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

WORD = r"[^\x20\x09-\x0D]+"  # fixed: a word is a run of characters other than blank and the five ASCII controls


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def text_of(c) -> Column:
    """Null counts as the empty text."""
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))


def n_words(c) -> Column:
    return F.regexp_count(text_of(c), F.lit(WORD)).cast("bigint")


def key_of(c) -> Column:
    """A key that is never null: null and every text keep apart."""
    c = F.col(c) if isinstance(c, str) else c
    return F.coalesce(F.concat(F.lit("="), c.cast("string")), F.lit(""))


def even_parts(spark: SparkSession, rows: int, most: int) -> int:
    """Partitions for so many rows with at most ``most`` in each, never fewer than the session's shuffle partitions."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // most))


def give_back() -> None:
    """Freed memory of this process goes back to the system."""
    import ctypes

    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc; others do it by themselves
    if trim is not None:
        trim(0)


def released(rows):
    """All of ``rows``, and at the task's end freed memory goes back to the system, as Python workers wait for the next stage beside the JVM."""
    try:
        yield from rows
    finally:
        give_back()
