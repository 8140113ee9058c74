"""Folding records into the graph: conflict-keeping node merge, edge upsert, two-pass ingest.

Nodes are folded in ``seq`` order by set operations. Attribute values, aliases and conflicts stay in long form
(one row each) until :func:`assemble`, so a node with a large share of all writes is never one group.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from stockweave.functions.keys import node_id, norm_key, ref_name, ref_type
from stockweave.functions.ordered import SLICE_ROWS, Running, running
from stockweave.functions.runtime import materialize
from stockweave.functions.values import canonical
from stockweave.operators.graph import EDGE_SCHEMA, as_edges, as_nodes, conform, long_attrs
from stockweave.operators.ontology import Ontology
from stockweave.operators.resolve import alias_index, resolve
from stockweave.operators.validate import edge_fault

BEFORE = -1  # seq of what the graph already holds


@dataclass
class Folded:
    nodes: DataFrame      # id, type, name, source, confidence, extracted_at, valid_from, valid_to, merged_from
    attrs: DataFrame      # id, attr, value
    aliases: DataFrame    # id, alias
    conflicts: DataFrame  # id, attr, value, source, seen_at, seq
    merged: DataFrame | None = None  # id, was(id, name, source), turn: nodes merged away in this step


def link_records(records: DataFrame, nodes: DataFrame) -> DataFrame:
    """Add ``id``: the node each record lands on, given what the graph and earlier records established.

    All records with one (type, key) land together. The key is taken as canonical if such a node exists; else it
    follows an alias of the graph; else the earliest record before it that lists the key as an alias; else it
    founds a node. Following an earlier record's key may lead on to another, so the links are doubled until
    none moves (each link leads to an earlier record, so they end).
    """
    keyed = records.withColumn("key", norm_key("name"))
    keys = keyed.groupBy("type", "key").agg(F.min("seq").alias("first_seq"))
    given = alias_index(nodes).groupBy("type", F.col("alias_key").alias("key")).agg(F.min("id").alias("by_alias"))
    ids = nodes.select(F.col("id").alias("canonical"))
    offers = (keyed.select("type", "seq", F.col("key").alias("via"), F.explode("aliases").alias("alias")).filter(F.col("alias") != "")
              .groupBy("type", norm_key("alias").alias("key")).agg(F.min(F.struct("seq", "via")).alias("offer")))
    k = keys.withColumn("want", F.concat("type", F.lit(":"), "key"))
    k = k.join(ids, k["want"] == ids["canonical"], "left").join(given, ["type", "key"], "left").join(offers, ["type", "key"], "left")
    known = F.coalesce("canonical", "by_alias")
    follows = F.when(known.isNull() & (F.col("offer.seq") < F.col("first_seq")), F.col("offer.via"))
    links = materialize(k.select("type", "key", known.alias("known"), F.coalesce(follows, "key").alias("root")), "links")
    while True:
        up = links.select("type", F.col("key").alias("root"), F.col("root").alias("next"))
        moved = materialize(links.join(up, ["type", "root"]), "links")
        if moved.filter("next <> root").isEmpty():
            break
        links = moved.select("type", "key", "known", F.col("next").alias("root"))
    head = links.select("type", F.col("key").alias("root"), F.coalesce("known", F.concat("type", F.lit(":"), "key")).alias("id"))
    landed = links.join(head, ["type", "root"]).select("type", "key", "id")
    return keyed.join(landed, ["type", "key"])


def fold_attrs(writes: DataFrame, owners: DataFrame, held: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Values and new conflicts of attribute writes (id, attr, value, source, seq, seen_at).

    The owner of a node may overwrite; another source may only set what is absent. Its differing values become
    conflicts, kept once per value after the value they first clashed with. ``held`` are conflicts recorded
    before; ``writes`` holds earlier values at seq -1.
    """
    w = writes.withColumn("value", canonical("value")).join(owners, "id")
    w = w.withColumn("owned", (F.col("source") == F.col("owner")) & (F.col("seq") > BEFORE))
    values = w.groupBy("id", "attr").agg(F.coalesce(
        F.max_by("value", F.when(F.col("owned"), F.col("seq"))), F.min_by("value", "seq")).alias("value"))

    steps = running(w, ["id", "attr"], "seq", F.floor(F.col("seq") / SLICE_ROWS), [
        Running("_owned", "last", F.when(F.col("owned"), F.col("value")), through=False),
        Running("_first", "first", F.col("value"), through=False)])
    current = F.coalesce("_owned", "_first")
    clashes = (steps.withColumn("current", current)
               .filter(~F.col("owned") & (F.col("seq") > BEFORE) & F.col("current").isNotNull() & (F.col("value") != F.col("current"))))
    base = clashes.groupBy("id", "attr").agg(F.min_by(F.struct(F.col("current").alias("value"), F.col("owner").alias("source")), "seq").alias("base"),
                                             F.min("seq").alias("seq"))
    first = clashes.groupBy("id", "attr", "value").agg(F.min_by(F.struct("source", "seen_at"), "seq").alias("by"), F.min("seq").alias("seq"))
    new = first.join(base.select("id", "attr", F.col("base.value").alias("base_value")), ["id", "attr"]).filter("value <> base_value")
    new = new.select("id", "attr", "value", F.col("by.source").alias("source"), F.col("by.seen_at").alias("seen_at"), "seq")
    opening = base.select("id", "attr", F.col("base.value").alias("value"), F.col("base.source").alias("source"),
                          F.lit(None).cast("timestamp").alias("seen_at"), (F.col("seq") - F.lit(0.5)).alias("at"))
    if held is not None:
        started = held.select("id", "attr").distinct()
        everything = clashes.groupBy("id", "attr", "value").agg(F.min_by(F.struct("source", "seen_at"), "seq").alias("by"), F.min("seq").alias("seq"))
        again = (everything.join(started, ["id", "attr"], "left_semi").join(held.select("id", "attr", "value"), ["id", "attr", "value"], "left_anti")
                 .select("id", "attr", "value", F.col("by.source").alias("source"), F.col("by.seen_at").alias("seen_at"), "seq"))
        new = new.join(started, ["id", "attr"], "left_anti").unionByName(again)
        opening = opening.join(started, ["id", "attr"], "left_anti")
    # `place` orders the list: the clashed-with value stands just before the first clash.
    conflicts = new.withColumn("place", F.col("seq") * 2).drop("seq").unionByName(
        opening.withColumn("place", (F.col("at") * 2).cast("bigint")).drop("at"))
    return values, conflicts.withColumnRenamed("place", "seq")


def upsert_nodes(nodes: DataFrame, records: DataFrame, conflicts: DataFrame | None = None) -> Folded:
    """Fold ``records`` (seq, type, name, attrs, aliases, source, confidence, valid_from, valid_to, seen_at)
    into ``nodes``. The source, validity and name of an existing node stay; confidence only rises to high."""
    linked = materialize(link_records(records, nodes), "linked-records")
    founding = F.struct("name", "source", "confidence", "valid_from", "valid_to", "aliases")
    per_id = linked.groupBy("id").agg(
        F.first("type").alias("type"), F.min_by(founding, "seq").alias("f"), F.min("seq").alias("first_seq"),
        F.bool_or(F.col("confidence") == "high").alias("raised"), F.max("seen_at").alias("seen_at"))
    old = nodes.select("id", *[F.col(c).alias(f"o_{c}") for c in nodes.columns if c != "id"])
    j = old.join(per_id, "id", "full_outer")
    is_old = F.col("o_type").isNotNull()
    pick = lambda c: F.when(is_old, F.col(f"o_{c}")).otherwise(F.col(f"f.{c}"))
    head = j.select(
        "id", F.coalesce("o_type", "type").alias("type"), pick("name").alias("name"), pick("source").alias("source"),
        F.when(F.col("raised"), "high").otherwise(pick("confidence")).alias("confidence"),
        F.coalesce("seen_at", "o_extracted_at").alias("extracted_at"), pick("valid_from").alias("valid_from"),
        pick("valid_to").alias("valid_to"),
        F.coalesce("o_merged_from", F.array().cast("array<struct<id:string,name:string,source:string>>")).alias("merged_from"),
        F.when(is_old, F.lit(BEFORE)).otherwise(F.col("first_seq")).alias("_founded"))
    head = materialize(head, "node-heads")

    owners = head.select("id", F.col("source").alias("owner"))
    before = long_attrs(nodes).join(nodes.select("id", "source"), "id").select(
        "id", "attr", "value", "source", F.lit(BEFORE).cast("bigint").alias("seq"), F.lit(None).cast("timestamp").alias("seen_at"))
    writes = linked.select("id", F.explode("attrs").alias("attr", "value"), "source", "seq", "seen_at")
    values, clashes = fold_attrs(before.unionByName(writes.select(before.columns)), owners, conflicts)

    # A founding record's aliases stay as given; later ones drop the canonical name and add other spellings.
    given = nodes.select("id", F.explode("aliases").alias("alias"))
    spoken = linked.select("id", "seq", "name", F.explode("aliases").alias("alias"))
    names = head.select("id", F.col("name").alias("_canonical"), "_founded")
    listed = spoken.join(names, "id").filter((F.col("seq") == F.col("_founded")) | (F.col("alias") != F.col("_canonical")))
    spelled = linked.select("id", "seq", F.col("name").alias("alias")).join(names, "id").filter(
        (F.col("seq") != F.col("_founded")) & (norm_key("alias") != norm_key("_canonical")))
    aliases = given.unionByName(listed.select("id", "alias")).unionByName(spelled.select("id", "alias")).distinct()
    if conflicts is not None:
        clashes = conflicts.select(clashes.columns).unionByName(clashes)
    return Folded(head.drop("_founded"), values, aliases, clashes)


def assemble(folded: Folded) -> DataFrame:
    """Node rows with their attribute map and alias array (both bounded by what one entity is called and has)."""
    attrs = folded.attrs.groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("attr", "value"))).alias("attrs"))
    aliases = folded.aliases.groupBy("id").agg(F.array_sort(F.collect_set("alias")).alias("aliases"))
    out = folded.nodes.join(attrs, "id", "left").join(aliases, "id", "left")
    if folded.merged is not None:
        was = folded.merged.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "was"))), lambda m: m["was"]).alias("_was"))
        out = out.join(was, "id", "left").withColumn("merged_from", F.when(F.col("_was").isNull(), F.col("merged_from"))
                                                     .otherwise(F.concat("merged_from", "_was"))).drop("_was")
    return as_nodes(out)


def upsert_edges(edges: DataFrame, incoming: DataFrame) -> DataFrame:
    """Last writer wins per (src, rel, dst); evidence and valid_from keep the last value that is not null.

    ``incoming`` has edge columns and ``seq`` and, inside it, ``pos`` (without them all its rows count as equally late). One aggregation, combined before the shuffle.
    """
    with_seq = EDGE_SCHEMA + ", seq bigint, pos bigint"
    zero = {c: F.lit(0) for c in ("seq", "pos") if c not in incoming.columns}
    old = conform(edges.withColumns({"seq": F.lit(BEFORE), "pos": F.lit(0)}), with_seq)
    rows = old.unionByName(conform(incoming.withColumns(zero) if zero else incoming, with_seq))
    turn = F.struct("seq", "pos")
    latest = F.max_by(F.struct("attrs", "source", "confidence", "extracted_at", "valid_to"), turn).alias("l")
    kept = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), turn)).alias(c)
    g = rows.groupBy("src", "rel", "dst").agg(latest, kept("evidence"), kept("valid_from"))
    return as_edges(g.select("src", "rel", "dst", "l.*", "evidence", "valid_from"))


def link_edges(wanted: DataFrame, nodes: DataFrame, ontology: Ontology) -> DataFrame:
    """Resolve both ends of wanted edges (src_type, src_name, rel, dst_type_ref, dst_name, ...) and judge them.

    Adds src, dst and ``error``: target_not_found, unknown_relation, domain or range. Ends are never created.
    """
    r = resolve(wanted, nodes, "src_type_ref", "src_name", "src")
    r = resolve(r, nodes, "dst_type_ref", "dst_name", "dst")
    judged = edge_fault(r.withColumns({"src_type": F.split("src", ":")[0], "dst_type": F.split("dst", ":")[0]}), ontology)
    missing = F.col("src").isNull() | F.col("dst").isNull()
    return judged.withColumn("error", F.when(missing, "target_not_found").otherwise(F.col("fault"))).drop("fault", "src_type", "dst_type")


@dataclass
class Ingested:
    folded: Folded
    nodes: DataFrame
    edges: DataFrame
    errors: DataFrame     # source, item, rel, target, error
    committed: bool


def ingest(records: DataFrame, nodes: DataFrame, edges: DataFrame, ontology: Ontology, strict: bool = True,
           conflicts: DataFrame | None = None) -> Ingested:
    """Two passes over records (see ``sources.records``): all nodes, then edges between nodes that exist.

    In strict mode any error leaves the given graph untouched (``committed`` is False).
    """
    known = F.coalesce(F.col("type").isin(*ontology.types), F.lit(False))  # a null type is unknown
    text = lambda c: c.cast("string")
    bad_type = records.filter(~known).select(
        "source", text(F.lit(None)).alias("item"), text(F.lit(None)).alias("rel"), F.col("type").alias("target"),
        F.lit("unknown_type").alias("error")).distinct()
    good = records.filter(known)
    folded = upsert_nodes(nodes, good.drop("edges"), conflicts)
    merged = materialize(assemble(folded), "nodes")
    e = good.select("seq", "type", "name", "source", "confidence", "seen_at", F.posexplode("edges").alias("_pos", "e"))
    wanted = e.select(
        "seq", F.col("_pos").alias("pos"), F.col("type").alias("src_type_ref"), F.col("name").alias("src_name"),
        F.col("e.rel").alias("rel"), F.col("e.to").alias("to"), ref_type("e.to").alias("dst_type_ref"), ref_name("e.to").alias("dst_name"),
        F.col("e.attrs").alias("attrs"), F.coalesce("e.source", "source").alias("source"),
        F.coalesce("e.confidence", "confidence").alias("confidence"), F.col("e.evidence").alias("evidence"),
        F.col("e.valid_from").alias("valid_from"), F.col("e.valid_to").alias("valid_to"), F.col("seen_at").alias("extracted_at"))
    judged = materialize(link_edges(wanted, merged, ontology), "linked-edges")
    faults = judged.filter(F.col("error").isNotNull()).select(
        "source", F.col("src_name").alias("item"), "rel", F.col("to").alias("target"), "error")
    errors = materialize(bad_type.unionByName(faults), "ingest-errors")
    if strict and not errors.isEmpty():
        return Ingested(folded, nodes, edges, errors, False)
    return Ingested(folded, merged, upsert_edges(edges, judged.filter(F.col("error").isNull())), errors, True)


def add_edges(wanted: DataFrame, nodes: DataFrame, edges: DataFrame, ontology: Ontology) -> tuple[DataFrame, DataFrame]:
    """Validated append of edges given as references (src_ref, rel, dst_ref, optional attrs, source, confidence).

    References may be bare names. Returns the new edges table and the rejected rows with their ``error``: an endpoint that is not found, one that several nodes
    answer to, or the relation's fault.
    """
    from stockweave.operators.resolve import resolve_any
    have = set(wanted.columns)
    w = wanted.withColumns({
        "attrs": F.coalesce("attrs", F.create_map().cast("map<string,string>")) if "attrs" in have else F.create_map().cast("map<string,string>"),
        "source": F.coalesce("source", F.lit("manual")) if "source" in have else F.lit("manual"),
        "confidence": F.coalesce("confidence", F.lit("high")) if "confidence" in have else F.lit("high")})
    w = resolve_any(w, nodes, "src_ref").withColumnsRenamed({"node_id": "src", "status": "_src_found"}).drop("n_matches")
    w = resolve_any(w, nodes, "dst_ref").withColumnsRenamed({"node_id": "dst", "status": "_dst_found"}).drop("n_matches")
    judged = edge_fault(w.withColumns({"src_type": F.split("src", ":")[0], "dst_type": F.split("dst", ":")[0]}), ontology)
    either = lambda word: (F.col("_src_found") == word) | (F.col("_dst_found") == word)
    error = F.when(either("not_found"), "endpoint_not_found").when(either("ambiguous"), "endpoint_ambiguous").otherwise(F.col("fault"))
    judged = judged.withColumn("error", error).drop("fault", "src_type", "dst_type", "_src_found", "_dst_found")
    return upsert_edges(edges, judged.filter(F.col("error").isNull())), judged.filter(F.col("error").isNotNull())
