"""The given tables as a property graph with its ontology, record writes, extractions and references."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from stockweave.functions.keys import node_id
from stockweave.functions.values import quoted
from stockweave.operators.graph import as_edges, as_nodes
from stockweave.operators.ontology import Attr, Ontology, Recipe, Relation, Step
from stockweave.plans.views import table

ONTOLOGY = Ontology(
    types={
        "Region": {},
        "Nation": {"region_key": Attr("number")},
        "Customer": {"segment": Attr(enum=("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")),
                     "balance": Attr("number", internal=True)},
        "Supplier": {"balance": Attr("number", internal=True)},
        "Part": {"brand": Attr(), "class": Attr(enum=("ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD")),
                 "size": Attr("number"), "scope": Attr("list"), "checked": Attr("boolean")},
        "Order": {"status": Attr(enum=("F", "O", "P")), "ordered_on": Attr("date"), "priority": Attr()},
    },
    relations={
        "IN_REGION": Relation(("Nation",), ("Region",)),
        "IN_NATION": Relation(("Customer", "Supplier"), ("Nation",)),
        "PLACED_BY": Relation(("Order",), ("Customer",)),
        "CONTAINS": Relation(("Order",), ("Part",)),
        "SUPPLIED_BY": Relation(("Part",), ("Supplier",), internal=True),
    },
    recipes={
        "part_reach": Recipe(("Part",), (
            Step("CONTAINS", "in", ("Part",), ("Order",)), Step("PLACED_BY", "out", ("Order",)),
            Step("IN_NATION", "out"), Step("IN_REGION", "out", ("Nation",)),
            Step("SUPPLIED_BY", "out", ("Part",), ("Supplier",))), include_internal=True),
        "order_brief": Recipe(("Order",), (Step("CONTAINS", "out", ("Order",)), Step("PLACED_BY", "out", ("Order",)),
                                           Step("SUPPLIED_BY", "out", ("Part",)))),
    },
)


def _id(type_: str, key) -> Column:
    return F.concat(F.lit(f"{type_}:"), key)


def part_id(key) -> Column:
    return _id("Part", F.concat(F.lit("part"), F.col(key).cast("string")))


def order_id(key) -> Column:
    return _id("Order", F.concat(F.lit("order"), F.col(key).cast("string")))


def numbered_id(type_: str, key) -> Column:
    return _id(type_, F.concat(F.lit(type_.lower()), F.format_string("%09d", F.col(key).cast("bigint"))))


def nodes(spark: SparkSession, sf: str) -> DataFrame:
    """Every row of six tables as a node. Each seventh key is of high confidence, each 17th part is superseded."""
    t = lambda name: table(spark, sf, name)
    whole = lambda c: F.floor(c).cast("bigint").cast("string")

    def make(df, type_, key, name, attrs, aliases=None, valid_to=None):
        entries = [x for k, v in attrs.items() for x in (F.lit(k), v)]
        return df.select(
            node_id(F.lit(type_), name).alias("id"), F.lit(type_).alias("type"), name.alias("name"),
            (F.create_map(*entries) if entries else F.create_map().cast("map<string,string>")).alias("attrs"),
            (F.array(aliases) if aliases is not None else F.array().cast("array<string>")).alias("aliases"),
            F.lit(f"{type_.lower()} table").alias("source"), F.when(F.col(key) % 7 == 0, "high").otherwise("medium").alias("confidence"),
            (valid_to if valid_to is not None else F.lit(None).cast("string")).alias("valid_to"))

    third = F.col("p_size") % 3
    scope = F.when(third == 0, '["product_page","faq"]').when(third == 1, '["all"]').otherwise('["faq"]')
    parts = [
        make(t("region"), "Region", "r_regionkey", F.col("r_name"), {}),
        make(t("nation"), "Nation", "n_nationkey", F.col("n_name"), {"region_key": F.col("n_regionkey").cast("string")}),
        make(t("customer"), "Customer", "c_custkey", F.col("c_name"), {"segment": quoted("c_mktsegment"), "balance": whole("c_acctbal")}),
        make(t("supplier"), "Supplier", "s_suppkey", F.col("s_name"), {"balance": whole("s_acctbal")}),
        make(t("part"), "Part", "p_partkey", F.concat(F.lit("part "), F.col("p_partkey").cast("string")),
             {"brand": quoted("p_brand"), "class": quoted("p_type"), "size": F.col("p_size").cast("string"), "scope": scope},
             F.col("p_name"), F.when(F.col("p_partkey") % 17 == 0, "1999-01-01")),
        make(t("orders"), "Order", "o_orderkey", F.concat(F.lit("order "), F.col("o_orderkey").cast("string")),
             {"status": quoted("o_orderstatus"), "ordered_on": quoted(F.date_format("o_orderdate", "yyyy-MM-dd")),
              "priority": quoted("o_orderpriority")}),
    ]
    return as_nodes(reduce(DataFrame.unionByName, parts))


def edges(spark: SparkSession, sf: str) -> DataFrame:
    """Five relations between them; CONTAINS carries the units."""
    t = lambda name: table(spark, sf, name)
    none = F.create_map().cast("map<string,string>")
    make = lambda df, src, rel, dst, attrs=none: df.select(
        src.alias("src"), F.lit(rel).alias("rel"), dst.alias("dst"), attrs.alias("attrs"), F.lit("tables").alias("source"), F.lit("medium").alias("confidence"))
    nation = lambda key: _id("Nation", F.concat(F.lit("nation"), F.col(key).cast("string")))
    regions = t("region").select("r_regionkey", "r_name")
    line = t("lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_quantity")
    held = line.groupBy("l_orderkey", "l_partkey").agg(F.sum("l_quantity").cast("bigint").cast("string").alias("units"))
    parts = [
        make(t("nation").join(regions, F.col("n_regionkey") == F.col("r_regionkey")), node_id(F.lit("Nation"), "n_name"), "IN_REGION", node_id(F.lit("Region"), "r_name")),
        make(t("customer"), node_id(F.lit("Customer"), "c_name"), "IN_NATION", nation("c_nationkey")),
        make(t("supplier"), node_id(F.lit("Supplier"), "s_name"), "IN_NATION", nation("s_nationkey")),
        make(t("orders"), order_id("o_orderkey"), "PLACED_BY", numbered_id("Customer", "o_custkey")),
        make(held, order_id("l_orderkey"), "CONTAINS", part_id("l_partkey"), F.create_map(F.lit("units"), F.col("units"))),
        make(line.select("l_partkey", "l_suppkey").distinct(), part_id("l_partkey"), "SUPPLIED_BY", numbered_id("Supplier", "l_suppkey")),
    ]
    return as_edges(reduce(DataFrame.unionByName, parts))


def flawed_nodes(spark: SparkSession, sf: str) -> DataFrame:
    """The nodes plus faults at fixed places: wrong types, foreign attributes, values of the wrong kind, no source."""
    n = nodes(spark, sf)
    part, k = F.col("type") == "Part", F.regexp_extract("id", "([0-9]+)$", 1)
    size = F.when(k != "", k.cast("bigint")).otherwise(-1)
    extra = (F.when(part & (size % 11 == 0), F.create_map(F.lit("colour"), F.lit('"red"')))
             .when(part & (size % 11 == 1), F.create_map(F.lit("checked"), F.lit('"yes"')))
             .when(part & (size % 11 == 2), F.create_map(F.lit("checked"), F.lit("true")))
             .when((F.col("type") == "Nation") & (size % 3 == 0), F.create_map(F.lit("wealth"), F.lit("null")))
             .otherwise(F.create_map().cast("map<string,string>")))
    kept = F.map_filter("attrs", lambda a, v: ~(part & (size % 13 == 0) & (a == "size")))
    worse = F.when(part & (size % 13 == 0), F.create_map(F.lit("size"), F.lit('"big"'))).otherwise(F.create_map().cast("map<string,string>"))
    order_fault = F.when((F.col("type") == "Order") & (size % 19 == 0), True).otherwise(False)
    attrs = F.transform_values(F.map_concat(kept, worse, extra), lambda a, v: F.when(order_fault & (a == "ordered_on"), '"soon"')
                               .when(order_fault & (a == "status"), '"X"').otherwise(v))
    return n.withColumns({"attrs": attrs, "type": F.when((F.col("type") == "Supplier") & (size % 5 == 0), "Vendor").otherwise(F.col("type")),
                          "source": F.when((F.col("type") == "Customer") & (size % 23 == 0), "").otherwise(F.col("source"))})


def flawed_edges(spark: SparkSession, sf: str) -> DataFrame:
    """The edges plus, for every order: a reversed, an unknown, a mistyped and a dangling one at fixed places."""
    o = table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    make = lambda rest, src, rel, dst: o.filter(F.col("o_orderkey") % 10 == rest).select(src.alias("src"), F.lit(rel).alias("rel"), dst.alias("dst"))
    order, customer = order_id("o_orderkey"), numbered_id("Customer", "o_custkey")
    bad = (make(1, customer, "PLACED_BY", order).unionByName(make(2, order, "SHIPPED_TO", customer))
           .unionByName(make(3, order, "CONTAINS", customer))
           .unionByName(make(4, order, "CONTAINS", _id("Part", F.concat(F.lit("lost"), F.col("o_orderkey").cast("string"))))))
    return edges(spark, sf).unionByName(as_edges(bad))


def attribute_writes(spark: SparkSession, sf: str) -> DataFrame:
    """Every event writes one attribute of its user from one of three sources; event ids follow time."""
    return table(spark, sf, "events").select(
        F.col("event_id").alias("seq"), F.lit("User").alias("type"), F.concat(F.lit("user "), F.col("user_id").cast("string")).alias("name"),
        F.create_map(F.col("event_type"), F.get_json_object("props", "$.k")).alias("attrs"), F.array().cast("array<string>").alias("aliases"),
        F.concat(F.lit("feed "), (F.col("event_id") % 3).cast("string")).alias("source"),
        F.when(F.col("event_id") % 101 == 0, "high").otherwise("medium").alias("confidence"),
        F.lit(None).cast("string").alias("valid_from"), F.lit(None).cast("string").alias("valid_to"),
        F.col("ts").cast("timestamp").alias("seen_at"))


def extractions(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Line items as extracted entities and relations, one order per text chunk, faults by line number."""
    t = table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("chunk_id"), F.col("l_partkey").alias("k"), F.col("l_linenumber").alias("n")).distinct()
    s = lambda c: F.col(c).cast("string")
    word = lambda text: F.lit(text).alias
    said = lambda df, type_, canonical, surface, attrs: df.select(
        "chunk_id", type_.alias("type"), canonical.alias("canonical"), surface.alias("surface")).distinct().select(
        "*", attrs.alias("attrs"), word("seen")("evidence"), word("medium")("confidence"))
    parts = said(t, F.when(F.col("n") == 7, "Gadget").otherwise("Part"), F.concat(F.lit("PART-"), s("k")), F.concat(F.lit("No. "), s("k")),
                 F.create_map(F.lit("checked"), F.lit("true"), F.lit("colour"), F.lit('"red"')))
    orders = said(t, F.lit("Order"), F.concat(F.lit("order "), s("chunk_id")), F.concat(F.lit("order "), s("chunk_id")), F.create_map().cast("map<string,string>"))
    order, part = F.concat(F.lit("Order:order "), s("chunk_id")), F.concat(F.lit("Part:part "), s("k"))
    other = F.concat(F.lit("Part:part "), (F.col("k") + 1_000_000).cast("string"))
    n = F.col("n")
    relations = t.select(
        "chunk_id", F.when(n == 5, part).otherwise(order).alias("src"), F.when(n == 6, "SHIPS").otherwise("CONTAINS").alias("rel"),
        F.when(n == 5, order).when(n == 4, other).otherwise(part).alias("dst")).distinct().select(
        "*", F.create_map().cast("map<string,string>").alias("attrs"), word("seen")("evidence"), word("medium")("confidence"))
    return parts.unionByName(orders), relations


def references(spark: SparkSession, sf: str) -> DataFrame:
    """One reference per order: typed, typed by alias, bare, bare and shared, unknown."""
    o = table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    p = table(spark, sf, "part").select("p_partkey", "p_name")
    shape, k = F.col("o_orderkey") % 5, F.col("o_orderkey").cast("string")
    ref = (F.when(shape == 0, F.concat(F.lit("Order: ORDER-"), k)).when(shape == 1, F.concat(F.lit("Part:"), F.initcap("p_name")))
           .when(shape == 2, F.concat(F.lit("customer#"), F.format_string("%09d", "o_custkey")))
           .when(shape == 3, F.col("p_name")).otherwise(F.concat(F.lit("nothing "), k)))
    return o.join(p, F.col("o_orderkey") == F.col("p_partkey"), "left").select(
        F.col("o_orderkey").alias("ref_id"), F.coalesce(ref, F.concat(F.lit("Order:order "), k)).alias("ref"))
