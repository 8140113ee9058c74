"""Readers and writers over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from stockweave.functions.runtime import materialize, new_path
from stockweave.functions.values import shown
from stockweave.operators import catalog as c
from stockweave.plans import graph_views as gv
from stockweave.plans.catalog_queries import DIFF, items, remote
from stockweave.plans.graph_queries import ATTRS, EDGES, NODES
from stockweave.plans.registry import query
from stockweave.plans.views import table
from stockweave.sources import exports
from stockweave.sources.batches import SnapshotTable
from stockweave.sources.chunks import chunk_text
from stockweave.sources.records import read_records


@query("chunk_text", """SELECT doc_id, chunk, md5(substr(text, start + 1, 6000)) AS text_hash, length(substr(text, start + 1, 6000)) AS n_chars
  FROM (SELECT doc_id, text, unnest(starts) AS start, generate_subscripts(starts, 1) - 1 AS chunk FROM (
    SELECT doc_id, text, CASE WHEN length(text) <= 6000 THEN [0] ELSE range(0, length(text), 5280) END AS starts FROM documents))""")
def _chunks(spark, sf):
    docs = table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("source"), "text")
    return chunk_text(docs).select(F.col("source").cast("bigint").alias("doc_id"), F.col("chunk").cast("bigint").alias("chunk"), F.md5("text").alias("text_hash"),
                                   F.length("text").cast("bigint").alias("n_chars"))


@query("read_records", """SELECT 'Part' AS type, 'part ' || p_partkey AS name, p_name AS alias, CASE WHEN p_partkey % 2 = 0 THEN 'sheet' ELSE 'parts' END AS source,
  CASE WHEN p_partkey % 3 = 0 THEN 'high' ELSE 'medium' END AS confidence, CAST(p_size AS VARCHAR) AS size, '"' || p_brand || '"' AS brand, 'Brand:' || p_brand AS target FROM part""")
def _records(spark, sf):
    """Every part written as a record document and read back."""
    part, k = table(spark, sf, "part"), F.col("p_partkey")
    item = F.struct(
        F.concat(F.lit("part "), k.cast("string")).alias("name"), F.array("p_name").alias("aliases"), F.when(k % 2 == 0, "sheet").alias("source"),
        F.struct(F.col("p_size").alias("size"), F.col("p_brand").alias("brand")).alias("attrs"),
        F.array(F.struct(F.lit("MADE_BY").alias("rel"), F.concat(F.lit("Brand:"), "p_brand").alias("to"))).alias("edges"))
    path = new_path(spark, "records")
    part.select(F.lit("Part").alias("type"), F.lit("parts").alias("source"), F.when(k % 3 == 0, "high").alias("confidence"), F.array(item).alias("items")).write.json(path)
    r = read_records(spark, path)
    return r.select("type", "name", F.col("aliases")[0].alias("alias"), "source", "confidence", F.col("attrs")["size"].alias("size"), F.col("attrs")["brand"].alias("brand"),
                    F.col("edges")[0]["to"].alias("target"))


@query("export_json", f"""WITH {NODES}, {EDGES} SELECT 'node' AS kind, id AS a, name AS b, source AS c FROM nodes UNION ALL SELECT 'edge', src, rel, dst FROM edges""")
def _json(spark, sf):
    """The graph written as JSON lines and read back."""
    path = new_path(spark, "graph-json")
    exports.write_graph_json(gv.nodes(spark, sf), gv.edges(spark, sf), path)
    n = spark.read.schema("id string, name string, source string").json(f"{path}/nodes")
    e = spark.read.schema("src string, rel string, dst string").json(f"{path}/edges")
    return n.select(F.lit("node").alias("kind"), F.col("id").alias("a"), F.col("name").alias("b"), F.col("source").alias("c")).unionByName(
        e.select(F.lit("edge").alias("kind"), F.col("src").alias("a"), F.col("rel").alias("b"), F.col("dst").alias("c")))


@query("export_triples", f"WITH {NODES}, {EDGES} SELECT '(' || s.name || ')-[' || rel || ']->(' || d.name || ')' AS triple FROM edges JOIN nodes s ON s.id = src JOIN nodes d ON d.id = dst")
def _triples(spark, sf):
    return exports.triples(gv.nodes(spark, sf), gv.edges(spark, sf)).select("triple")


@query("masked_nodes", f"WITH {ATTRS} SELECT id, attr, v AS value FROM attrs WHERE attr <> 'balance'")
def _masked_nodes(spark, sf):
    n, _ = exports.masked_graph(gv.nodes(spark, sf), gv.edges(spark, sf), gv.ONTOLOGY)
    return n.select("id", F.explode("attrs").alias("attr", "v")).select("id", "attr", shown("v").alias("value"))


@query("masked_edges", f"""WITH {EDGES}, units AS (SELECT 'Order:order' || l_orderkey AS src, 'Part:part' || l_partkey AS dst, CAST(CAST(sum(l_quantity) AS BIGINT) AS VARCHAR) AS units FROM lineitem GROUP BY ALL)
  SELECT src, rel, dst, CASE rel WHEN 'CONTAINS' THEN units WHEN 'SUPPLIED_BY' THEN NULL ELSE 'shown' END AS units FROM edges LEFT JOIN units USING (src, dst)""")
def _masked_edges(spark, sf):
    """All relations, every edge with an attribute; the internal relation's are blanked."""
    told = F.when(F.col("rel") == "CONTAINS", F.col("attrs")).otherwise(F.create_map(F.lit("units"), F.when(F.col("rel") == "SUPPLIED_BY", "secret").otherwise("shown")))
    _, e = exports.masked_graph(gv.nodes(spark, sf), gv.edges(spark, sf).withColumn("attrs", told), gv.ONTOLOGY)
    return e.select("src", "rel", "dst", F.col("attrs")["units"].alias("units"))


@query("snapshot_resync", f"WITH {DIFF} SELECT sku, CASE action WHEN 'orphan' THEN 'orphan' ELSE 'unchanged' END AS action FROM diff")
def _resync(spark, sf):
    """A plan applied to a snapshot table leaves nothing to do but the orphans."""
    store = SnapshotTable(spark, new_path(spark, "catalog"))
    local = materialize(items(spark, sf), "items")
    r = remote(local)
    r = r.groupBy("sku").agg(F.max_by(F.struct(*[x for x in r.columns if x not in ("sku", "seq")]), "seq").alias("r")).select("sku", "r.*")
    store.replace(r)
    held = store.fetch()
    store.replace(c.apply_plan(held, local, c.catalog_diff(local, held)))
    return c.catalog_diff(local, store.fetch()).select("sku", "action")
