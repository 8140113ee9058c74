"""Keys, resolution, upserts, validation and serving over the tables seen as a graph."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from stockweave.functions import keys
from stockweave.functions.values import plain
from stockweave.operators import gate, graph as g, paths, resolve as r, serve, upsert, validate
from stockweave.plans import graph_views as gv
from stockweave.plans.registry import query
from stockweave.plans.views import table

KEY = "regexp_replace(lower({0}), '[^a-z0-9]+', '', 'g')"
NODES = f"""nodes AS (SELECT type || ':' || {KEY.format('name')} AS id, *, CASE WHEN k % 7 = 0 THEN 'high' ELSE 'medium' END AS confidence,
    lower(type) || ' table' AS source FROM (
  SELECT 'Region' AS type, r_regionkey AS k, r_name AS name, NULL AS alias, NULL AS valid_to FROM region
  UNION ALL SELECT 'Nation', n_nationkey, n_name, NULL, NULL FROM nation
  UNION ALL SELECT 'Customer', c_custkey, c_name, NULL, NULL FROM customer
  UNION ALL SELECT 'Supplier', s_suppkey, s_name, NULL, NULL FROM supplier
  UNION ALL SELECT 'Part', p_partkey, 'part ' || p_partkey, p_name, CASE WHEN p_partkey % 17 = 0 THEN '1999-01-01' END FROM part
  UNION ALL SELECT 'Order', o_orderkey, 'order ' || o_orderkey, NULL, NULL FROM orders))"""
ATTRS = """attrs AS (
  SELECT 'Nation:nation' || n_nationkey AS id, 'Nation' AS type, n_nationkey AS k, 'region_key' AS attr, CAST(n_regionkey AS VARCHAR) AS v FROM nation
  UNION ALL SELECT 'Customer:customer' || printf('%09d', c_custkey), 'Customer', c_custkey, 'segment', c_mktsegment FROM customer
  UNION ALL SELECT 'Customer:customer' || printf('%09d', c_custkey), 'Customer', c_custkey, 'balance', CAST(CAST(floor(c_acctbal) AS BIGINT) AS VARCHAR) FROM customer
  UNION ALL SELECT 'Supplier:supplier' || printf('%09d', s_suppkey), 'Supplier', s_suppkey, 'balance', CAST(CAST(floor(s_acctbal) AS BIGINT) AS VARCHAR) FROM supplier
  UNION ALL SELECT 'Part:part' || p_partkey, 'Part', p_partkey, 'brand', p_brand FROM part
  UNION ALL SELECT 'Part:part' || p_partkey, 'Part', p_partkey, 'class', p_type FROM part
  UNION ALL SELECT 'Part:part' || p_partkey, 'Part', p_partkey, 'size', CAST(p_size AS VARCHAR) FROM part
  UNION ALL SELECT 'Part:part' || p_partkey, 'Part', p_partkey, 'scope', CASE p_size % 3 WHEN 0 THEN 'product_page; faq' WHEN 1 THEN 'all' ELSE 'faq' END FROM part
  UNION ALL SELECT 'Order:order' || o_orderkey, 'Order', o_orderkey, 'status', o_orderstatus FROM orders
  UNION ALL SELECT 'Order:order' || o_orderkey, 'Order', o_orderkey, 'ordered_on', strftime(o_orderdate, '%Y-%m-%d') FROM orders
  UNION ALL SELECT 'Order:order' || o_orderkey, 'Order', o_orderkey, 'priority', o_orderpriority FROM orders)"""
EDGES = f"""edges AS (
  SELECT 'Nation:nation' || n_nationkey AS src, 'IN_REGION' AS rel, 'Region:' || {KEY.format('r_name')} AS dst FROM nation JOIN region ON n_regionkey = r_regionkey
  UNION ALL SELECT 'Customer:customer' || printf('%09d', c_custkey), 'IN_NATION', 'Nation:nation' || c_nationkey FROM customer
  UNION ALL SELECT 'Supplier:supplier' || printf('%09d', s_suppkey), 'IN_NATION', 'Nation:nation' || s_nationkey FROM supplier
  UNION ALL SELECT 'Order:order' || o_orderkey, 'PLACED_BY', 'Customer:customer' || printf('%09d', o_custkey) FROM orders
  UNION ALL SELECT DISTINCT 'Order:order' || l_orderkey, 'CONTAINS', 'Part:part' || l_partkey FROM lineitem
  UNION ALL SELECT DISTINCT 'Part:part' || l_partkey, 'SUPPLIED_BY', 'Supplier:supplier' || printf('%09d', l_suppkey) FROM lineitem)"""
ALIASES = f"""aliases AS (SELECT DISTINCT {KEY.format('surface')} AS alias_key, type, id FROM (
  SELECT id, type, name AS surface FROM nodes UNION ALL SELECT id, type, alias FROM nodes WHERE alias IS NOT NULL))"""
REFERENCES = """references_ AS (SELECT o_orderkey AS ref_id, coalesce(CASE o_orderkey % 5 WHEN 0 THEN 'Order: ORDER-' || o_orderkey
    WHEN 1 THEN 'Part:' || upper(p_name[1:1]) || split_part(p_name, ' ', 1)[2:] || ' ' || upper(split_part(p_name, ' ', 2)[1:1]) || split_part(p_name, ' ', 2)[2:]
    WHEN 2 THEN 'customer#' || printf('%09d', o_custkey) WHEN 3 THEN p_name ELSE 'nothing ' || o_orderkey END,
    'Order:order ' || o_orderkey) AS ref FROM orders LEFT JOIN part ON o_orderkey = p_partkey)"""
RESOLVED = f"""{NODES}, {ALIASES}, {REFERENCES}, typed AS (SELECT ref_id, ref, n.id AS canonical, a.id AS alias FROM (SELECT *, split_part(ref, ':', 1) AS t,
      {KEY.format("trim(substr(ref, instr(ref, ':') + 1))")} AS k FROM references_ WHERE contains(ref, ':')) x
    LEFT JOIN nodes n ON n.id = x.t || ':' || x.k LEFT JOIN (SELECT alias_key, type, min(id) AS id FROM aliases GROUP BY ALL) a ON a.alias_key = x.k AND a.type = x.t),
  per_key AS (SELECT alias_key, count(*) AS n, min(id) AS id FROM aliases GROUP BY alias_key),
  bare AS (SELECT ref_id, ref, coalesce(n, 0) AS n, CASE WHEN n = 1 THEN id END AS node_id FROM references_ LEFT JOIN per_key ON alias_key = {KEY.format('ref')}
    WHERE NOT contains(ref, ':')),
  resolved AS (SELECT ref_id, ref, coalesce(canonical, alias) AS node_id, CASE WHEN coalesce(canonical, alias) IS NULL THEN 0 ELSE 1 END AS n_matches FROM typed
    UNION ALL SELECT ref_id, ref, node_id, n FROM bare)"""


@query("norm_key", f"SELECT doc_id, md5({KEY.format('text')}) AS key_hash, length({KEY.format('text')}) AS key_length FROM documents")
def _norm_key(spark, sf):
    key = keys.norm_key("text")
    return table(spark, sf, "documents").select("doc_id", F.md5(key).alias("key_hash"), F.length(key).cast("bigint").alias("key_length"))


@query("tokens", """SELECT doc_id, len(t) AS n_tokens, md5(array_to_string(list_sort(t), ' ')) AS token_hash FROM (
  SELECT doc_id, list_distinct(list_filter(string_split_regex(lower(text), '[^a-z0-9]+'), lambda x: x <> '')) AS t FROM documents)""")
def _tokens(spark, sf):
    t = keys.tokens("text")
    return table(spark, sf, "documents").select("doc_id", F.size(t).cast("bigint").alias("n_tokens"),
                                                F.md5(F.array_join(F.array_sort(t), " ")).alias("token_hash"))


@query("parse_refs", f"""WITH {REFERENCES} SELECT ref_id, CASE WHEN contains(ref, ':') THEN trim(split_part(ref, ':', 1)) END AS ref_type,
  CASE WHEN contains(ref, ':') THEN trim(substr(ref, instr(ref, ':') + 1)) END AS ref_name,
  CASE WHEN contains(ref, ':') THEN trim(split_part(ref, ':', 1)) || ':' || {KEY.format("substr(ref, instr(ref, ':') + 1)")} END AS node_id FROM references_""")
def _parse(spark, sf):
    t, n = keys.ref_type("ref"), keys.ref_name("ref")
    return gv.references(spark, sf).select("ref_id", t.alias("ref_type"), n.alias("ref_name"), keys.node_id(t, n).alias("node_id"))


@query("alias_index", f"WITH {NODES}, {ALIASES} SELECT * FROM aliases")
def _aliases(spark, sf):
    return r.alias_index(gv.nodes(spark, sf))


@query("resolve_typed", f"WITH {RESOLVED} SELECT ref_id, coalesce(canonical, alias) AS node_id FROM typed")
def _resolve(spark, sf):
    refs = gv.references(spark, sf).filter(keys.has_type_prefix("ref"))
    refs = refs.withColumns({"type": keys.ref_type("ref"), "name": keys.ref_name("ref")})
    return r.resolve(refs, gv.nodes(spark, sf)).select("ref_id", "node_id")


@query("resolve_any", f"""WITH {RESOLVED} SELECT ref_id, node_id, n_matches, CASE n_matches WHEN 0 THEN 'not_found' WHEN 1 THEN 'found' ELSE 'ambiguous' END AS status FROM resolved""")
def _resolve_any(spark, sf):
    return r.resolve_any(gv.references(spark, sf), gv.nodes(spark, sf)).select("ref_id", "node_id", "n_matches", "status")


@query("ambiguous_candidates", f"""WITH {NODES}, {ALIASES}, {REFERENCES} SELECT DISTINCT ref, id FROM references_ JOIN aliases ON alias_key = {KEY.format('ref')} WHERE NOT contains(ref, ':')""")
def _candidates(spark, sf):
    return r.candidates_of(gv.references(spark, sf), gv.nodes(spark, sf))


WRITES = """w AS (SELECT event_id AS seq, 'User:user' || user_id AS id, event_type AS attr, CAST(CAST(json_extract_string(props, '$.k') AS DOUBLE) AS VARCHAR) AS value,
    'feed ' || event_id % 3 AS source, ts FROM events),
  owners AS (SELECT id, arg_min(source, seq) AS owner FROM w GROUP BY id),
  x AS (SELECT w.*, source = owner AS owned, owner FROM w JOIN owners USING (id)),
  vals AS (SELECT id, attr, coalesce(arg_max(value, seq) FILTER (owned), arg_min(value, seq)) AS value FROM x GROUP BY id, attr),
  y AS (SELECT *, coalesce(last_value(CASE WHEN owned THEN value END IGNORE NULLS) OVER p, first_value(value) OVER p) AS current FROM x
    WINDOW p AS (PARTITION BY id, attr ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
  clash AS (SELECT * FROM y WHERE NOT owned AND current IS NOT NULL AND value <> current),
  base AS (SELECT id, attr, arg_min(current, seq) AS bv, arg_min(owner, seq) AS bo FROM clash GROUP BY id, attr)"""


@query("upsert_attrs", f"WITH {WRITES} SELECT * FROM vals")
def _upsert(spark, sf):
    empty = g.as_nodes(spark.createDataFrame([], "id string"))
    return upsert.upsert_nodes(empty, gv.attribute_writes(spark, sf)).attrs


@query("upsert_conflicts", f"""WITH {WRITES} SELECT id, attr, bv AS value, bo AS source FROM base
  UNION ALL SELECT c.id, c.attr, c.value, arg_min(c.source, c.seq) FROM clash c JOIN base b ON c.id = b.id AND c.attr = b.attr AND c.value <> b.bv GROUP BY c.id, c.attr, c.value""")
def _conflicts(spark, sf):
    return user_conflicts(spark, sf).select("id", "attr", "value", "source")


def user_conflicts(spark, sf):
    empty = g.as_nodes(spark.createDataFrame([], "id string"))
    return upsert.upsert_nodes(empty, gv.attribute_writes(spark, sf)).conflicts


@query("upsert_nodes", f"""WITH {WRITES} SELECT id, 'User' AS type, replace(replace(id, 'User:user', 'user '), ':', '') AS name, owner AS source,
  CASE WHEN bool_or(seq % 101 = 0) THEN 'high' ELSE 'medium' END AS confidence, CAST(count(DISTINCT attr) AS INTEGER) AS n_attrs FROM x GROUP BY id, owner""")
def _upsert_nodes(spark, sf):
    empty = g.as_nodes(spark.createDataFrame([], "id string"))
    n = upsert.assemble(upsert.upsert_nodes(empty, gv.attribute_writes(spark, sf)))
    return n.select("id", "type", "name", "source", "confidence", F.size("attrs").alias("n_attrs"))


@query("upsert_edges", """WITH w AS (SELECT 'User:user' || user_id AS src, 'DID' AS rel, 'Act:' || event_type AS dst, event_id AS seq, json_extract_string(props, '$.k') AS k,
    CASE WHEN event_id % 3 = 0 THEN 'event ' || event_id END AS evidence, CASE WHEN event_id % 5 = 0 THEN strftime(ts, '%Y-%m-%d') END AS valid_from,
    CASE WHEN event_id % 2 = 0 THEN strftime(ts, '%Y-%m-%d') END AS valid_to FROM events)
  SELECT src, rel, dst, arg_max(k, seq) AS k, arg_max('feed ' || seq % 3, seq) AS source, max_by(struct_pack(v := valid_to), seq).v AS valid_to,
    arg_max(evidence, seq) FILTER (evidence IS NOT NULL) AS evidence, arg_max(valid_from, seq) FILTER (valid_from IS NOT NULL) AS valid_from FROM w GROUP BY src, rel, dst""")
def _upsert_edges(spark, sf):
    day = F.date_format("ts", "yyyy-MM-dd")
    w = table(spark, sf, "events").select(
        F.concat(F.lit("User:user"), F.col("user_id").cast("string")).alias("src"), F.lit("DID").alias("rel"),
        F.concat(F.lit("Act:"), "event_type").alias("dst"), F.col("event_id").alias("seq"),
        F.create_map(F.lit("k"), F.get_json_object("props", "$.k")).alias("attrs"),
        F.concat(F.lit("feed "), (F.col("event_id") % 3).cast("string")).alias("source"), F.lit("medium").alias("confidence"),
        F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("event "), F.col("event_id").cast("string"))).alias("evidence"),
        F.when(F.col("event_id") % 5 == 0, day).alias("valid_from"), F.when(F.col("event_id") % 2 == 0, day).alias("valid_to"))
    empty = g.as_edges(spark.createDataFrame([], "src string"))
    return upsert.upsert_edges(empty, w).select("src", "rel", "dst", F.col("attrs")["k"].alias("k"), "source", "valid_to", "evidence", "valid_from")


def records(spark, sf):
    """Parts, customers, suppliers (as an unknown type) and orders as records; every order carries two edges."""
    t = lambda name: table(spark, sf, name)
    edge = "array<struct<rel:string,to:string,attrs:map<string,string>,source:string,confidence:string,evidence:string,valid_from:string,valid_to:string>>"
    e = lambda rel, to: F.struct(rel.alias("rel"), to.alias("to"), F.lit(None).cast("map<string,string>").alias("attrs"), F.lit(None).cast("string").alias("source"),
                                 F.lit(None).cast("string").alias("confidence"), F.lit(None).cast("string").alias("evidence"),
                                 F.lit(None).cast("string").alias("valid_from"), F.lit(None).cast("string").alias("valid_to"))
    make = lambda df, base, key, type_, name, alias=None, es=None: df.select(
        (F.col(key) + base).cast("bigint").alias("seq"), F.lit(type_).alias("type"), name.alias("name"), F.create_map().cast("map<string,string>").alias("attrs"),
        (F.array(alias) if alias else F.array().cast("array<string>")).alias("aliases"), F.lit(f"{type_.lower()} file").alias("source"), F.lit("medium").alias("confidence"),
        F.lit(None).cast("string").alias("valid_from"), F.lit(None).cast("string").alias("valid_to"), F.lit(None).cast("timestamp").alias("seen_at"),
        (F.array(*es) if es else F.array().cast(edge)).cast(edge).alias("edges"))
    k, rest = F.col("o_orderkey").cast("string"), F.col("o_orderkey") % 10
    buyer = F.concat(F.lit("Customer:Customer#"), F.format_string("%09d", "o_custkey"))
    rel = F.when(rest == 1, "SHIPPED_TO").otherwise("CONTAINS")
    to = F.when(rest.isin(1, 2), buyer).when(rest == 3, F.concat(F.lit("Part:lost "), k)).otherwise(
        F.concat(F.lit("Part:Part-"), (F.col("o_orderkey") % 200).cast("string")))
    billion = 1_000_000_000_000
    return (make(t("part"), 0, "p_partkey", "Part", F.concat(F.lit("part "), F.col("p_partkey").cast("string")), "p_name")
            .unionByName(make(t("customer"), billion, "c_custkey", "Customer", F.col("c_name")))
            .unionByName(make(t("supplier"), 2 * billion, "s_suppkey", "Vendor", F.col("s_name")))
            .unionByName(make(t("orders"), 3 * billion, "o_orderkey", "Order", F.concat(F.lit("order "), k), None,
                              [e(F.lit("PLACED_BY"), buyer), e(rel, to)])))


def ingested(spark, sf):
    empty_n, empty_e = g.as_nodes(spark.createDataFrame([], "id string")), g.as_edges(spark.createDataFrame([], "src string"))
    return upsert.ingest(records(spark, sf), empty_n, empty_e, gv.ONTOLOGY, strict=False)


BUYER = "printf('%09d', o_custkey)"


@query("ingest_errors", f"""SELECT 'vendor file' AS source, NULL AS item, NULL AS rel, 'Vendor' AS target, 'unknown_type' AS error
  UNION ALL SELECT 'order file', 'order ' || o_orderkey, CASE WHEN o_orderkey % 10 = 1 THEN 'SHIPPED_TO' ELSE 'CONTAINS' END,
    CASE WHEN o_orderkey % 10 = 3 THEN 'Part:lost ' || o_orderkey ELSE 'Customer:Customer#' || {BUYER} END,
    CASE o_orderkey % 10 WHEN 1 THEN 'unknown_relation' WHEN 2 THEN 'range' ELSE 'target_not_found' END FROM orders WHERE o_orderkey % 10 IN (1, 2, 3)""")
def _ingest_errors(spark, sf):
    return ingested(spark, sf).errors


@query("ingest_edges", f"""SELECT 'Order:order' || o_orderkey AS src, 'PLACED_BY' AS rel, 'Customer:customer' || {BUYER} AS dst, 'order file' AS source FROM orders
  UNION ALL SELECT 'Order:order' || o_orderkey, 'CONTAINS', 'Part:part' || o_orderkey % 200, 'order file' FROM orders WHERE o_orderkey % 10 NOT IN (1, 2, 3)""")
def _ingest_edges(spark, sf):
    return ingested(spark, sf).edges.select("src", "rel", "dst", "source")


@query("add_edges", f"""WITH {NODES}, {ALIASES}, per_key AS (SELECT alias_key, count(*) AS n, min(id) AS id FROM aliases GROUP BY alias_key),
  w AS (SELECT o_orderkey AS k, {BUYER} AS buyer, p_name FROM orders LEFT JOIN part ON p_partkey = o_orderkey AND o_orderkey % 8 = 5)
  SELECT 'Order:order' || k AS src, CASE WHEN k % 4 = 0 THEN 'IN_NATION' ELSE 'PLACED_BY' END AS rel,
    CASE WHEN p_name IS NOT NULL THEN CASE WHEN n = 1 THEN id END WHEN k % 4 <> 1 THEN 'Customer:customer' || buyer END AS dst,
    CASE WHEN k % 4 = 0 THEN 'domain' WHEN p_name IS NOT NULL THEN CASE WHEN n = 1 THEN 'range' ELSE 'endpoint_ambiguous' END WHEN k % 4 = 1 THEN 'endpoint_not_found' ELSE 'added' END AS outcome
  FROM w LEFT JOIN per_key ON alias_key = {KEY.format('p_name')}""")
def _add_edges(spark, sf):
    """Orders tied to their buyers; some name nobody, some a part by a name that it may share with others."""
    o, k = table(spark, sf, "orders"), F.col("o_orderkey")
    part = table(spark, sf, "part").select(F.col("p_partkey").alias("o_orderkey"), "p_name").filter(k % 8 == 5)
    buyer = F.concat(F.lit("Customer#"), F.format_string("%09d", "o_custkey"))
    wanted = o.join(part, "o_orderkey", "left").select(F.concat(F.lit("order "), k.cast("string")).alias("src_ref"), F.when(k % 4 == 0, "IN_NATION").otherwise("PLACED_BY").alias("rel"),
                                                       F.coalesce("p_name", F.when(k % 4 == 1, F.concat(F.lit("nobody "), k.cast("string"))).otherwise(buyer)).alias("dst_ref"))
    empty = g.as_edges(spark.createDataFrame([], "src string"))
    added, refused = upsert.add_edges(wanted, gv.nodes(spark, sf), empty, gv.ONTOLOGY)
    return added.select("src", "rel", "dst", F.lit("added").alias("outcome")).unionByName(refused.select("src", "rel", "dst", F.col("error").alias("outcome")))


@query("delete_nodes", f"""WITH {NODES}, {EDGES}, gone AS (SELECT id FROM nodes WHERE valid_to IS NOT NULL)
  SELECT src, rel, dst FROM edges WHERE src NOT IN (SELECT id FROM gone) AND dst NOT IN (SELECT id FROM gone)
  UNION ALL SELECT id, 'node', type FROM nodes WHERE id NOT IN (SELECT id FROM gone)""")
def _delete_nodes(spark, sf):
    """What is left, nodes and edges."""
    n = gv.nodes(spark, sf)
    nodes, edges = g.delete_nodes(n, gv.edges(spark, sf), n.filter("valid_to IS NOT NULL"))
    return edges.select("src", "rel", "dst").unionByName(nodes.select(F.col("id").alias("src"), F.lit("node").alias("rel"), F.col("type").alias("dst")))


@query("delete_edges", f"WITH {EDGES} SELECT src, rel, dst FROM edges WHERE rel NOT IN ('CONTAINS', 'SUPPLIED_BY')")
def _delete_edges(spark, sf):
    e = gv.edges(spark, sf)
    return g.delete_edges(e, e.filter(F.col("rel").isin("CONTAINS", "SUPPLIED_BY"))).select("src", "rel", "dst")


@query("neighbours", f"""WITH {EDGES}, ids AS (SELECT 'Customer:customer' || printf('%09d', c_custkey) AS id FROM customer)
  SELECT id, 'out' AS dir, rel, dst AS other FROM ids JOIN edges ON src = id UNION ALL SELECT id, 'in', rel, src FROM ids JOIN edges ON dst = id""")
def _neighbours(spark, sf):
    ids = gv.nodes(spark, sf).filter("type = 'Customer'")
    return g.neighbours(ids, gv.edges(spark, sf)).select("id", "dir", "rel", "other")


@query("list_nodes", f"WITH {NODES} SELECT id, name, confidence, source FROM nodes WHERE type = 'Part'")
def _list_nodes(spark, sf):
    return g.nodes_of(gv.nodes(spark, sf), "Part").select("id", "name", "confidence", "source")


@query("graph_counts", f"WITH {NODES}, {EDGES} SELECT 'node' AS kind, type AS label, count(*) AS n FROM nodes GROUP BY type UNION ALL SELECT 'edge', 'all', count(*) FROM edges")
def _counts(spark, sf):
    return g.counts(gv.nodes(spark, sf), gv.edges(spark, sf))


@query("type_index", f"""WITH {NODES} SELECT type, count(*) AS n, string_agg(name, ', ' ORDER BY name, id) FILTER (rn <= 40) AS names, greatest(count(*) - 40, 0) AS more
  FROM (SELECT *, row_number() OVER (PARTITION BY type ORDER BY name, id) AS rn FROM nodes) GROUP BY type""")
def _index(spark, sf):
    return g.type_index(gv.nodes(spark, sf))


NODE_ISSUES = f"""{NODES}, {ATTRS}, node_issues AS (
  SELECT id AS subject, NULL AS detail, 'unknown_type' AS issue FROM nodes WHERE type = 'Supplier' AND k % 5 = 0
  UNION ALL SELECT id, 'colour', 'unknown_attr' FROM nodes WHERE type = 'Part' AND k % 11 = 0
  UNION ALL SELECT id, 'checked', 'boolean' FROM nodes WHERE type = 'Part' AND k % 11 = 1
  UNION ALL SELECT id, 'size', 'number' FROM nodes WHERE type = 'Part' AND k % 13 = 0
  UNION ALL SELECT id, 'wealth', 'unknown_attr' FROM nodes WHERE type = 'Nation' AND k % 3 = 0
  UNION ALL SELECT id, 'ordered_on', 'date' FROM nodes WHERE type = 'Order' AND k % 19 = 0
  UNION ALL SELECT id, 'status', 'enum' FROM nodes WHERE type = 'Order' AND k % 19 = 0
  UNION ALL SELECT a.id, a.attr, 'enum' FROM attrs a WHERE a.attr = 'segment' AND v NOT IN ('AUTOMOBILE','BUILDING','FURNITURE','HOUSEHOLD','MACHINERY'))"""
EDGE_ISSUES = f"""{EDGES}, edge_issues AS (
  SELECT src, rel, dst, 'unknown_type_end' AS issue FROM edges WHERE false
  UNION ALL SELECT src, rel, dst, 'domain' FROM edges WHERE rel = 'IN_NATION' AND src[1:9] = 'Supplier:' AND CAST(src[-9:] AS BIGINT) % 5 = 0
  UNION ALL SELECT src, rel, dst, 'range' FROM edges WHERE rel = 'SUPPLIED_BY' AND CAST(dst[-9:] AS BIGINT) % 5 = 0
  UNION ALL SELECT 'Customer:customer' || {BUYER}, 'PLACED_BY', 'Order:order' || o_orderkey, 'domain' FROM orders WHERE o_orderkey % 10 = 1
  UNION ALL SELECT 'Order:order' || o_orderkey, 'SHIPPED_TO', 'Customer:customer' || {BUYER}, 'unknown_relation' FROM orders WHERE o_orderkey % 10 = 2
  UNION ALL SELECT 'Order:order' || o_orderkey, 'CONTAINS', 'Customer:customer' || {BUYER}, 'range' FROM orders WHERE o_orderkey % 10 = 3
  UNION ALL SELECT 'Order:order' || o_orderkey, 'CONTAINS', 'Part:lost' || o_orderkey, 'dangling' FROM orders WHERE o_orderkey % 10 = 4)"""


@query("check_nodes", f"WITH {NODE_ISSUES} SELECT subject AS id, detail AS attr, issue FROM node_issues")
def _check_nodes(spark, sf):
    return validate.check_nodes(gv.flawed_nodes(spark, sf), gv.ONTOLOGY)


@query("check_edges", f"WITH {EDGE_ISSUES} SELECT src, rel, dst, issue FROM edge_issues")
def _check_edges(spark, sf):
    return validate.check_edges(gv.flawed_edges(spark, sf), gv.flawed_nodes(spark, sf), gv.ONTOLOGY)


@query("validate_graph", f"""WITH {NODE_ISSUES}, {EDGE_ISSUES} SELECT * FROM node_issues
  UNION ALL SELECT id, NULL, 'missing_source' FROM nodes WHERE type = 'Customer' AND k % 23 = 0
  UNION ALL SELECT concat_ws(' ', src, rel, dst), rel, issue FROM edge_issues""")
def _validate(spark, sf):
    return validate.validate_graph(gv.flawed_nodes(spark, sf), gv.flawed_edges(spark, sf), gv.ONTOLOGY)


@query("cards", f"""WITH {NODES}, {ATTRS}, {EDGES}, units AS (SELECT 'Part:part' || l_partkey AS id, 'Order:order' || l_orderkey AS src, CAST(CAST(sum(l_quantity) AS BIGINT) AS VARCHAR) AS units FROM lineitem GROUP BY l_orderkey, l_partkey), hub AS (SELECT *, type || ':' || name AS ref FROM nodes WHERE type IN ('Customer', 'Nation', 'Part'))
  SELECT ref, 'head' AS section, type AS label, name AS value, NULL AS other_type, NULL AS other_name, source, confidence FROM hub
  UNION ALL SELECT ref, 'alias', NULL, alias, NULL, NULL, NULL, NULL FROM hub WHERE alias IS NOT NULL
  UNION ALL SELECT ref, 'attr', attr, v, NULL, NULL, NULL, NULL FROM hub JOIN attrs USING (id)
  UNION ALL SELECT ref, 'stale', NULL, valid_to, NULL, NULL, NULL, NULL FROM hub WHERE valid_to IS NOT NULL
  UNION ALL SELECT ref, 'out', rel, NULL, o.type, o.name, 'tables', 'medium' FROM hub JOIN edges ON src = hub.id JOIN nodes o ON o.id = dst
  UNION ALL SELECT ref, 'in', rel, 'units=' || u.units, o.type, o.name, 'tables', 'medium' FROM hub JOIN edges e ON dst = hub.id JOIN nodes o ON o.id = e.src LEFT JOIN units u ON u.id = hub.id AND u.src = e.src""")
def _cards(spark, sf):
    n = gv.nodes(spark, sf)
    refs = n.filter(F.col("type").isin("Customer", "Nation", "Part")).select(F.concat("type", F.lit(":"), "name").alias("ref"))
    return serve.cards(refs, n, gv.edges(spark, sf))


REACH = f"""{NODES}, {EDGES}, seeds AS (SELECT id AS seed FROM nodes WHERE type = 'Part'),
  s1 AS (SELECT seed, src AS id, src, rel, dst FROM seeds JOIN edges ON dst = seed AND rel = 'CONTAINS'),
  s2 AS (SELECT DISTINCT seed, e.dst AS id, e.src, e.rel, e.dst FROM s1 JOIN edges e ON e.src = s1.id AND e.rel = 'PLACED_BY'),
  s3 AS (SELECT DISTINCT seed, e.dst AS id, e.src, e.rel, e.dst FROM s2 JOIN edges e ON e.src = s2.id AND e.rel = 'IN_NATION'),
  s4 AS (SELECT DISTINCT seed, e.dst AS id, e.src, e.rel, e.dst FROM s3 JOIN edges e ON e.src = s3.id AND e.rel = 'IN_REGION'),
  s5 AS (SELECT seed, e.dst AS id, e.src, e.rel, e.dst FROM seeds JOIN edges e ON e.src = seed AND e.rel = 'SUPPLIED_BY'),
  hops AS (SELECT * FROM s1 UNION SELECT * FROM s2 UNION SELECT * FROM s3 UNION SELECT * FROM s4 UNION SELECT * FROM s5)"""


@query("recipe_reach", f"""WITH {REACH} SELECT seed, 'node' AS kind, split_part(id, ':', 1) AS label, count(DISTINCT id) AS n FROM (SELECT seed, id FROM hops UNION ALL SELECT seed, seed FROM seeds) GROUP BY ALL
  UNION ALL SELECT seed, 'edge', rel, count(DISTINCT (src, dst)) FROM hops GROUP BY ALL""")
def _reach(spark, sf):
    n = gv.nodes(spark, sf)
    c = serve.context(n.filter("type = 'Part'"), n, gv.edges(spark, sf), gv.ONTOLOGY, gv.ONTOLOGY.recipes["part_reach"])
    return (c.nodes.groupBy("seed", F.lit("node").alias("kind"), F.col("type").alias("label")).agg(F.count("*").alias("n"))
            .unionByName(c.edges.groupBy("seed", F.lit("edge").alias("kind"), F.col("rel").alias("label")).agg(F.count("*").alias("n"))))


UNITS = "units AS (SELECT 'Order:order' || l_orderkey AS src, 'Part:part' || l_partkey AS dst, CAST(CAST(sum(l_quantity) AS BIGINT) AS VARCHAR) AS units FROM lineitem GROUP BY l_orderkey, l_partkey)"
BRIEF = f"""{NODES}, {EDGES}, {ATTRS}, hops AS (SELECT src AS seed, src, rel, dst FROM edges WHERE rel = 'PLACED_BY'
    UNION ALL SELECT src, src, rel, dst FROM edges WHERE rel = 'CONTAINS' AND dst NOT IN (SELECT id FROM nodes WHERE valid_to IS NOT NULL)),
  members AS (SELECT id AS seed, id FROM nodes WHERE type = 'Order' UNION ALL SELECT seed, dst FROM hops)"""


def brief(spark, sf, lines=False):
    n = gv.nodes(spark, sf)
    recipe = gv.ONTOLOGY.recipes["order_brief"]
    return serve.context(n.filter("type = 'Order'"), n, gv.edges(spark, sf), gv.ONTOLOGY, recipe, lines), n, recipe


@query("recipe_context", f"WITH {BRIEF} SELECT seed, src, rel, dst FROM hops")
def _context(spark, sf):
    return brief(spark, sf)[0].edges


@query("context_lines", f"""WITH {BRIEF}, {UNITS}, shown AS (SELECT id, '  ' || string_agg(attr || '=' || v, '  ' ORDER BY attr) AS line FROM attrs WHERE attr <> 'balance' GROUP BY id),
  m AS (SELECT seed, n.*, CASE n.type WHEN 'Order' THEN -1 WHEN 'Customer' THEN 2 ELSE 4 END AS t FROM members JOIN nodes n USING (id)),
  size AS (SELECT seed, count(*) AS n FROM members GROUP BY seed), degree AS (SELECT seed, count(*) AS m FROM hops GROUP BY seed),
  lines AS (SELECT seed, 1 AS block, t, name, id, 0 AS kind, '' AS sub, '## ' || type || ': ' || name || '  [src: ' || source || '; conf: ' || confidence || ']' AS text FROM m
    UNION ALL SELECT seed, 1, t, name, id, 1, '', line FROM m JOIN shown USING (id)
    UNION ALL SELECT h.seed, 1, -1, m.name, m.id, 3, concat_ws(' ', h.rel, d.type, d.name), '  - ' || h.rel || ' -> ' || d.type || ': ' || d.name || coalesce(' units=' || u.units, '') || '  [src: tables; conf: medium]' FROM hops h LEFT JOIN units u ON u.src = h.src AND u.dst = h.dst JOIN m ON m.seed = h.seed AND m.id = h.src JOIN nodes d ON d.id = h.dst
    UNION ALL SELECT seed, 0, 0, '', '', 0, '', '# CONTEXT recipe=order_brief seed=' || seed || ' (' || n || ' nodes, ' || coalesce(m, 0) || ' edges, 0 rules)' FROM size LEFT JOIN degree USING (seed)
    UNION ALL SELECT seed, 0, 0, '', '', 1, '', '{serve.CAUTION}' FROM size),
  placed AS (SELECT *, row_number() OVER (PARTITION BY seed ORDER BY block, t, name, id, kind, sub, text) AS line_no FROM lines)
  SELECT seed, line_no, text FROM placed WHERE line_no <= 12
  UNION ALL SELECT seed, 13, '# ' || (count(*) - 12) || ' lines omitted' FROM placed GROUP BY seed HAVING count(*) > 12""")
def _lines(spark, sf):
    c, n, recipe = brief(spark, sf, True)
    return serve.context_lines(c, n, gv.edges(spark, sf), gv.ONTOLOGY, recipe, "order_brief", max_lines=12).withColumn("line_no", F.col("line_no").cast("bigint"))


@query("rules_in_scope", "SELECT 'Part:part' || p_partkey AS id FROM part WHERE p_size % 3 IN (0, 1)")
def _rules(spark, sf):
    return serve.rules_in_scope(gv.nodes(spark, sf), "Part", "product_page").select("id")


@query("attribute_query", "SELECT 'Part:part' || p_partkey AS id, p_brand AS brand FROM part WHERE p_type = 'SMALL' AND p_size % 3 IN (0, 1)")
def _query(spark, sf):
    n = serve.query(gv.nodes(spark, sf), "Part", {"class": "small", "scope": "product_page", "checked": "None"})
    return n.select("id", plain(F.col("attrs")["brand"]).alias("brand"))


@query("attribute_queries", f"""SELECT 'page ' || p_type AS query, 'Part:part' || p_partkey AS id FROM part WHERE p_size % 3 IN (0, 1)
  UNION ALL SELECT 'brand ' || p_brand, 'Part:part' || p_partkey FROM part UNION ALL SELECT 'made ' || p_type || ' ' || p_size, 'Part:part' || p_partkey FROM part
  UNION ALL SELECT 'order ' || o_orderstatus || ' ' || o_orderpriority, 'Order:order' || o_orderkey FROM orders
  UNION ALL SELECT 'bare', 'Region:' || {KEY.format('r_name')} FROM region""")
def _queries(spark, sf):
    """Some hundred named queries over all nodes in one job."""
    part, orders = table(spark, sf, "part"), table(spark, sf, "orders")
    ask = lambda df, name, type_, **where: df.select(F.concat_ws(" ", *name).alias("query"), F.lit(type_).alias("type"), F.explode(F.array(
        *[F.struct(F.lit(a).alias("attr"), w.cast("string").alias("want")) for a, w in where.items()])).alias("c")).select("query", "type", "c.*").distinct()
    conditions = [ask(part, [F.lit("page"), "p_type"], "Part", **{"class": F.lower("p_type"), "scope": F.lit("product_page"), "checked": F.lit("None")}),
                  ask(part, [F.lit("brand"), "p_brand"], "Part", brand=F.upper("p_brand"), scope=F.lit("faq")),
                  ask(part, [F.lit("made"), "p_type", "p_size"], "Part", **{"class": F.col("p_type"), "size": F.col("p_size")}),
                  ask(orders, [F.lit("order"), "o_orderstatus", "o_orderpriority"], "Order", status=F.col("o_orderstatus"), priority=F.col("o_orderpriority")),
                  ask(part.limit(1), [F.lit("bare")], "Region", anything=F.lit("none"))]
    return serve.query_all(gv.nodes(spark, sf), reduce(DataFrame.unionByName, conditions))


@query("siblings", f"""WITH {EDGES}, c AS (SELECT src, dst FROM edges WHERE rel = 'CONTAINS'),
  last AS (SELECT 'Order:order' || arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS id FROM orders GROUP BY o_custkey)
  SELECT DISTINCT l.id, o.src AS sibling FROM last l JOIN c ON c.src = l.id JOIN c o ON o.dst = c.dst
    JOIN orders ON 'Order:order' || o_orderkey = o.src WHERE o.src <> l.id AND o_orderstatus = 'O'""")
def _siblings(spark, sf):
    """Open orders that share a part with each customer's latest order."""
    o = table(spark, sf, "orders")
    last = o.groupBy("o_custkey").agg(F.max_by("o_orderkey", F.struct("o_orderdate", "o_orderkey")).alias("k")).select(gv.order_id("k").alias("id"))
    active = o.filter("o_orderstatus = 'O'").select(gv.order_id("o_orderkey").alias("id"))
    return serve.siblings(last, gv.edges(spark, sf), "CONTAINS", active)


PAIRS = "pairs AS (SELECT 'Customer:customer' || printf('%09d', c_custkey) AS a, 'Part:part' || c_custkey % (SELECT count(*) FROM part) AS b FROM customer)"


@query("shortest_paths", f"""WITH {EDGES}, {PAIRS}, adj AS (SELECT src AS u, dst AS v FROM edges UNION SELECT dst, src FROM edges),
  f1 AS (SELECT a, v AS x FROM (SELECT DISTINCT a FROM pairs) JOIN adj ON u = a), b1 AS (SELECT b, v AS x FROM (SELECT DISTINCT b FROM pairs) JOIN adj ON u = b),
  f2 AS (SELECT DISTINCT a, v AS x FROM f1 JOIN adj ON u = x), b2 AS (SELECT DISTINCT b, v AS x FROM b1 JOIN adj ON u = x),
  hit AS (SELECT a, b, 1 AS hops FROM pairs JOIN f1 USING (a) WHERE x = b UNION ALL SELECT a, b, 2 FROM pairs JOIN f1 USING (a) JOIN b1 USING (b, x)
    UNION ALL SELECT a, b, 3 FROM pairs JOIN f2 USING (a) JOIN b1 USING (b, x) UNION ALL SELECT a, b, 4 FROM pairs JOIN f2 USING (a) JOIN b2 USING (b, x))
  SELECT a, b, min(hops) AS hops FROM pairs LEFT JOIN hit USING (a, b) GROUP BY a, b""")
def _paths(spark, sf):
    n = table(spark, sf, "part").count()
    c = F.col("c_custkey")
    pairs = table(spark, sf, "customer").select(
        gv.numbered_id("Customer", "c_custkey").alias("a"), F.concat(F.lit("Part:part"), (c % n).cast("string")).alias("b"))
    return paths.shortest_paths(pairs, gv.edges(spark, sf)).select("a", "b", "hops")


ADMIT = f"""{NODES}, {ALIASES}, t AS (SELECT DISTINCT l_orderkey AS c, l_partkey AS k, l_linenumber AS n FROM lineitem),
  recognised AS MATERIALIZED (SELECT DISTINCT c, 'Part:part ' || k AS ref FROM t WHERE n <> 7 UNION SELECT c, 'Order:order ' || c FROM t),
  rels AS (SELECT DISTINCT c AS chunk_id, CASE WHEN n = 5 THEN 'Part:part ' || k ELSE 'Order:order ' || c END AS src, CASE WHEN n = 6 THEN 'SHIPS' ELSE 'CONTAINS' END AS rel,
    CASE n WHEN 5 THEN 'Order:order ' || c WHEN 4 THEN 'Part:part ' || (k + 1000000) ELSE 'Part:part ' || k END AS dst FROM t),
  judged AS MATERIALIZED (SELECT r.*, CASE WHEN s.ref IS NULL OR d.ref IS NULL THEN 'unrecognised' WHEN rel = 'SHIPS' THEN 'unknown_relation' WHEN r.src[1:5] = 'Part:' THEN 'domain' END AS reason
    FROM rels r LEFT JOIN recognised s ON s.c = chunk_id AND s.ref = src LEFT JOIN recognised d ON d.c = chunk_id AND d.ref = dst),
  staged AS (SELECT 'node' AS kind, c AS chunk_id, split_part(ref, ':', 1) AS type, split_part(ref, ':', 2) AS canonical, replace(ref, ' ', '') AS resolved_to, NULL AS src, NULL AS rel, NULL AS dst FROM recognised
    UNION ALL SELECT 'edge', chunk_id, NULL, NULL, NULL, src, rel, dst FROM judged WHERE reason IS NULL)"""


def admitted(spark, sf):
    entities, relations = gv.extractions(spark, sf)
    return gate.admit_extractions(entities, relations, gv.nodes(spark, sf), gv.ONTOLOGY)


@query("admit_extractions", f"WITH {ADMIT} SELECT *, CASE WHEN kind = 'edge' THEN 0 WHEN type = 'Part' THEN 1 ELSE 0 END AS n_attrs FROM staged")
def _admit(spark, sf):
    return admitted(spark, sf).staged.select("kind", "chunk_id", "type", "canonical", "resolved_to", "src", "rel", "dst", F.size("attrs").alias("n_attrs"))


@query("rejected_extractions", f"""WITH {ADMIT} SELECT chunk_id, 'edge' AS kind, reason FROM judged WHERE reason IS NOT NULL
  UNION ALL SELECT c, 'node', 'unknown_type' FROM (SELECT DISTINCT c, k FROM t WHERE n = 7)""")
def _rejected(spark, sf):
    return admitted(spark, sf).rejected


@query("admission_counts", f"""WITH {ADMIT} SELECT (SELECT count(*) FROM staged WHERE kind = 'node') AS entities, (SELECT count(*) FROM staged WHERE kind = 'edge') AS relations,
  (SELECT count(*) FROM judged WHERE reason IS NOT NULL) + (SELECT count(*) FROM (SELECT DISTINCT c, k FROM t WHERE n = 7)) AS rejected""")
def _admission(spark, sf):
    return gate.admission_counts(admitted(spark, sf))


@query("candidates", "SELECT 'entity' AS kind, 'part ' || l_partkey AS text, CAST(l_orderkey AS VARCHAR) AS source FROM lineitem WHERE l_linenumber = 7 UNION ALL SELECT 'relation', 'SHIPS', CAST(l_orderkey AS VARCHAR) FROM lineitem WHERE l_linenumber = 6")
def _add_candidates(spark, sf):
    t = table(spark, sf, "lineitem")
    row = lambda df, kind, text: df.select(F.lit(kind).alias("kind"), text.alias("text"), F.col("l_orderkey").cast("string").alias("source"))
    return gate.add_candidates(row(t.filter("l_linenumber = 7"), "entity", F.concat(F.lit("part "), F.col("l_partkey").cast("string"))),
                               row(t.filter("l_linenumber = 6"), "relation", F.lit("SHIPS")))


def staging(spark, sf):
    """Labelled documents as scored rows; the rest is pending."""
    d, q = table(spark, sf, "documents").select("doc_id", "lang"), table(spark, sf, "labels").select("doc_id", "quality")
    status = F.when(F.col("quality") == 1, "accepted").when(F.col("quality") == 0, "rejected").otherwise("pending")
    return d.join(q, "doc_id", "left").select(F.col("doc_id").alias("id"), F.col("lang").alias("kind"), status.alias("status"), F.lit(None).cast("string").alias("note"))


STAGING = """staging AS (SELECT doc_id AS id, lang AS kind, CASE quality WHEN 1 THEN 'accepted' WHEN 0 THEN 'rejected' ELSE 'pending' END AS status
  FROM documents LEFT JOIN labels USING (doc_id))"""


@query("sample_pending", f"WITH {STAGING} SELECT id, kind FROM (SELECT * FROM staging WHERE status = 'pending' ORDER BY md5('0:' || id), id LIMIT 50)")
def _sample(spark, sf):
    return gate.sample_pending(staging(spark, sf)).select("id", "kind")


STATS = f"""{STAGING}, stats AS (SELECT kind, count(*) FILTER (status = 'pending') AS pending, count(*) FILTER (status = 'accepted') AS accepted,
    count(*) FILTER (status = 'rejected') AS rejected FROM staging GROUP BY GROUPING SETS ((kind), ()))"""


@query("gate_stats", f"WITH {STATS} SELECT *, accepted + rejected AS scored, accepted / nullif(accepted + rejected, 0) AS precision FROM stats")
def _stats(spark, sf):
    return gate.gate_stats(staging(spark, sf))


@query("gate_open", f"WITH {STATS} SELECT accepted + rejected AS scored, accepted / (accepted + rejected) AS precision, accepted + rejected >= 20 AND accepted / (accepted + rejected) >= 0.9 AS open FROM stats WHERE kind IS NULL")
def _open(spark, sf):
    return gate.gate_open(staging(spark, sf))


@query("set_status", f"WITH {STAGING} SELECT id, CASE WHEN status = 'pending' THEN 'rejected' ELSE status END AS status, CASE WHEN status = 'pending' THEN 'below bar' END AS note FROM staging")
def _set_status(spark, sf):
    s = staging(spark, sf)
    return gate.set_status(s, s.filter("status = 'pending'"), "rejected", "below bar").select("id", "status", "note")


@query("ingest_staged", f"WITH {ADMIT} SELECT DISTINCT replace(src, ' ', '') AS src, rel, replace(dst, ' ', '') AS dst FROM staged WHERE kind = 'edge'")
def _ingest_staged(spark, sf):
    """All staged rows accepted by force into an empty graph."""
    empty_n, empty_e = g.as_nodes(spark.createDataFrame([], "id string")), g.as_edges(spark.createDataFrame([], "src string"))
    rows = gate.number_staged(admitted(spark, sf).staged)
    return gate.accept(rows, empty_n, empty_e, gv.ONTOLOGY, force=True).loaded.edges.select("src", "rel", "dst")
