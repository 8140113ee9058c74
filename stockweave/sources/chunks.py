"""Cutting long texts into overlapping chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def chunk_text(docs: DataFrame, size: int = 6000, overlap: float = 0.12) -> DataFrame:
    """(source, chunk, chunk_id, text) in characters: a text within ``size`` stays whole, else chunks start at every
    ``size * (1 - overlap)`` characters while inside the text, so the last may hold only overlap."""
    step = int(size * (1 - overlap))
    n = F.length("text")
    starts = F.when(n <= size, F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), n - 1, F.lit(step)))
    cut = docs.select("source", "text", F.posexplode(starts).alias("chunk", "start"))
    return cut.select("source", "chunk", F.concat("source", F.lit("#chunk"), F.col("chunk").cast("string")).alias("chunk_id"),
                      F.col("text").substr(F.col("start") + 1, F.lit(size)).alias("text"))
