"""Writers: graph as JSON or triples, the graph without internal facts, the catalogue as CSV."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from stockweave.operators.catalog import csv_rows
from stockweave.operators.ontology import Ontology


def graph_rows(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes by type and name, edges by source, relation and target."""
    return nodes.orderBy("type", "name", "id"), edges.orderBy("src", "rel", "dst")


def write_graph_json(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """Two folders of JSON lines, ``nodes`` and ``edges``, in listing order across files, packed by gzip: as plain text they take several times the disk of all the rest."""
    n, e = graph_rows(nodes, edges)
    n.write.option("compression", "gzip").json(f"{path}/nodes")
    e.write.option("compression", "gzip").json(f"{path}/edges")


def triples(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One ``(name)-[REL]->(name)`` text per edge."""
    of = lambda end: nodes.select(F.col("id").alias(end), F.col("name").alias(f"{end}_name"))
    j = edges.join(of("src"), "src").join(of("dst"), "dst")
    return j.select("src", "rel", "dst", F.format_string("(%s)-[%s]->(%s)", "src_name", "rel", "dst_name").alias("triple"))


def _without(names: list[str]) -> Column:
    return F.map_filter("attrs", lambda k, v: ~k.isin(*names))


def masked_graph(nodes: DataFrame, edges: DataFrame, ontology: Ontology) -> tuple[DataFrame, DataFrame]:
    """The graph without internal attributes; an internal relation keeps its edge but no attributes."""
    kept = F.col("attrs")
    for type_, names in ontology.internal_attrs().items():
        if names:
            kept = F.when(F.col("type") == type_, _without(names)).otherwise(kept)
    rels = ontology.internal_rels()
    hidden = F.col("rel").isin(*rels) if rels else F.lit(False)
    empty = F.create_map().cast("map<string,string>")
    return (nodes.withColumn("attrs", kept).select("id", "type", "name", "confidence", "source", "aliases", "valid_to", "attrs"),
            edges.withColumn("attrs", F.when(hidden, empty).otherwise(F.col("attrs"))).select("src", "dst", "rel", "attrs", "confidence", "source"))


def write_catalog_csv(items: DataFrame, path: str) -> None:
    """Bulk-import files with a header row, in family and size order."""
    csv_rows(items.orderBy("family", "size_mg", "sku")).write.option("header", True).option("quoteAll", True).option("emptyValue", "").csv(path)


def read_csv(spark: SparkSession, path: str, columns) -> DataFrame:
    schema = ", ".join(f"{c} string" for c in columns)
    return spark.read.schema(schema).option("header", True).csv(path)
