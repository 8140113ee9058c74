"""Connected components of a table of links, by distributed rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from stockweave.functions.runtime import materialize


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of ``links`` (a, b bigint): the smallest node that can be reached.

    Rounds of large-star and small-star: every node's neighbours are tied to the smallest of them, first the larger ones, then the
    smaller ones. The number of rounds grows with the logarithm of the longest path. A node's neighbours are never gathered in
    one row: its smallest one is an aggregate that is joined back, so a node with most of the links is split like any skewed join.
    """
    edges = materialize(links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    while True:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = materialize(both.filter("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct(), "links")
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e"))
        fresh = materialize(small.select("e.a", "e.b").filter("a <> b").distinct(), "links")
        same = fresh.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first() == edges.agg(
            F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        edges = fresh
        if same:
            break
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(edges.select("b", "b").distinct())
