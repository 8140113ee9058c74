"""Shape of the graph tables and plain access to them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F
from pyspark.sql.types import StructType

NODE_SCHEMA = ("id string, type string, name string, attrs map<string,string>, aliases array<string>, source string, "
               "confidence string, extracted_at timestamp, valid_from string, valid_to string, "
               "merged_from array<struct<id:string,name:string,source:string>>")
EDGE_SCHEMA = ("src string, rel string, dst string, attrs map<string,string>, source string, confidence string, "
               "extracted_at timestamp, valid_from string, valid_to string, evidence string")


def conform(df: DataFrame, schema: str) -> DataFrame:
    """Exactly the columns of ``schema``; those ``df`` lacks are null."""
    have = set(df.columns)
    fields = [(f.name, f.dataType) for f in StructType.fromDDL(schema)]
    return df.select(*[(F.col(c) if c in have else F.lit(None)).cast(t).alias(c) for c, t in fields])


def as_nodes(df: DataFrame) -> DataFrame:
    """Give ``df`` all node columns; missing ones are null, missing collections empty."""
    out = conform(df, NODE_SCHEMA)
    empty = {"attrs": F.create_map().cast("map<string,string>"), "aliases": F.array().cast("array<string>"),
             "merged_from": F.array().cast("array<struct<id:string,name:string,source:string>>")}
    return out.withColumns({c: F.coalesce(c, e) for c, e in empty.items()})


def as_edges(df: DataFrame) -> DataFrame:
    out = conform(df, EDGE_SCHEMA)
    return out.withColumn("attrs", F.coalesce("attrs", F.create_map().cast("map<string,string>")))


def long_attrs(nodes: DataFrame) -> DataFrame:
    """One row per (node, attribute)."""
    return nodes.select("id", "type", F.explode("attrs").alias("attr", "value"))


def nodes_of(nodes: DataFrame, type_: str | None = None) -> DataFrame:
    """Nodes of one type (or all), by type and name."""
    picked = nodes.filter(F.col("type") == type_) if type_ else nodes
    return picked.orderBy("type", "name", "id")


def counts(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Rows (kind, label, n): one per node type and one for all edges."""
    per_type = nodes.groupBy("type").agg(F.count("*").alias("n")).select(F.lit("node").alias("kind"), F.col("type").alias("label"), "n")
    total = edges.agg(F.count("*").alias("n")).select(F.lit("edge").alias("kind"), F.lit("all").alias("label"), "n")
    return per_type.unionByName(total)


def neighbours(ids: DataFrame, edges: DataFrame, rel: str | None = None, direction: str = "both") -> DataFrame:
    """Edges at each ``id`` with the node at the other end; with ``both`` a self loop appears twice."""
    e = edges.filter(F.col("rel") == rel) if rel else edges
    ways = []
    if direction in ("out", "both"):
        ways.append(e.withColumns({"id": F.col("src"), "dir": F.lit("out"), "other": F.col("dst")}))
    if direction in ("in", "both"):
        ways.append(e.withColumns({"id": F.col("dst"), "dir": F.lit("in"), "other": F.col("src")}))
    both = ways[0] if len(ways) == 1 else ways[0].unionByName(ways[1])
    return ids.select("id").join(both, "id")


def delete_nodes(nodes: DataFrame, edges: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Drop nodes and every edge at either end. Aliases live on the node rows and go with them."""
    gone = ids.select("id").distinct()
    kept_edges = (edges.join(gone, F.col("src") == F.col("id"), "left_anti")
                  .join(gone, F.col("dst") == F.col("id"), "left_anti"))
    return nodes.join(gone, "id", "left_anti"), kept_edges


def delete_edges(edges: DataFrame, keys: DataFrame) -> DataFrame:
    return edges.join(keys.select("src", "rel", "dst").distinct(), ["src", "rel", "dst"], "left_anti")


def type_index(nodes: DataFrame, max_names: int = 40) -> DataFrame:
    """Per type: its count, the first ``max_names`` names and how many more there are.

    The rank filter runs inside each map task first, so a large type sends only its first names to the shuffle.
    """
    first = W.partitionBy("type").orderBy("name", "id")
    names = (nodes.select("type", "name", "id").withColumn("_at", F.row_number().over(first)).filter(F.col("_at") <= max_names)
             .groupBy("type").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_at", "name"))),
                                                           lambda s: s["name"]), ", ").alias("names")))
    sizes = nodes.groupBy("type").agg(F.count("*").alias("n"))
    return sizes.join(names, "type").withColumn("more", F.greatest(F.col("n") - max_names, F.lit(0)))
