"""The given tables seen as the library's inputs: products, lots, ledger, shop orders, graph, documents.

The rules are fixed so that queries and their SQL checks read the same data.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from stockweave.functions.columns import cents


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def stream(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """The same files as a stream; the pattern lets the table be one file or a folder."""
    return spark.readStream.schema(table(spark, sf, name).schema).parquet(f"{sf}/{name}.parque[t]")


def products(spark, sf) -> DataFrame:
    """Every part is a product; its size decides status and fulfilment."""
    tenth = F.col("p_size") % 10
    return table(spark, sf, "part").select(
        F.col("p_partkey").cast("string").alias("product_id"), F.col("p_partkey").cast("string").alias("sku"),
        F.col("p_name").alias("name"), F.lower("p_type").alias("class"), F.col("p_brand").alias("brand"),
        F.col("p_size").alias("size"), F.col("p_retailprice").alias("price_usd"),
        F.when(tenth < 7, "active").when(tenth < 9, "coming_soon").otherwise("draft").alias("status"),
        F.when(F.col("p_size") % 4 == 0, "just_in_time").otherwise("stocked").alias("fulfilment"))


def lot_key() -> Column:
    return F.concat_ws("-", "l_partkey", "l_suppkey")


def lots(spark, sf) -> DataFrame:
    """One lot per (part, supplier) pair seen in the line items."""
    none = F.lit(None).cast("date")
    pairs = table(spark, sf, "lineitem").groupBy("l_partkey", "l_suppkey").agg(F.max("l_shipdate").alias("last"))
    third = F.col("l_suppkey") % 3
    return pairs.select(
        lot_key().alias("lot_id"), F.col("l_partkey").cast("string").alias("product_id"),
        F.col("l_partkey").cast("string").alias("sku"),
        F.when(F.col("l_suppkey") % 5 == 0, none).otherwise(F.date_add(F.to_date("last"), 365)).alias("expires_on"),
        F.when(third == 0, "pending").when(third == 1, "received").otherwise("published").alias("coa_status"),
        F.when(F.col("l_suppkey") % 4 != 0, F.lit(99.1)).alias("purity_measured"),
        F.when(F.col("l_suppkey") % 2 == 0, "lab-us").otherwise("lab-eu").alias("coa_lab"))


def ledger(spark, sf) -> DataFrame:
    return ledger_rows(table(spark, sf, "lineitem"))


def ledger_rows(line_items: DataFrame) -> DataFrame:
    """Each line item is one ledger event."""
    line, flag = F.col("l_linenumber"), F.col("l_returnflag")
    kind = (F.when((flag == "R") & (line >= 6), "damaged").when(flag == "R", "sold").when(flag == "A", "adjusted")
            .when(line == 7, "transfer").otherwise("received"))
    return line_items.select(
        lot_key().alias("lot_id"), kind.alias("kind"), F.col("l_quantity").alias("quantity"),
        F.to_date("l_shipdate").alias("occurred_on"), F.col("l_orderkey").cast("string").alias("reference"))


def order_status() -> Column:
    s = F.col("o_orderstatus")
    return F.when(s == "F", "paid").when(s == "P", "pending").otherwise("refunded")


def shop_orders(spark, sf) -> DataFrame:
    return table(spark, sf, "orders").select(
        F.col("o_orderkey").cast("string").alias("order_id"), order_status().alias("status"),
        F.col("o_orderdate").cast("timestamp").alias("created_at"),
        F.concat(F.lit(" C"), F.col("o_custkey").cast("string"), F.lit("@Example.org ")).alias("email"),
        cents("o_totalprice").alias("subtotal_cents"),
        F.when(F.col("o_orderkey") % 4 == 0, F.lit(500)).cast("bigint").alias("discount_cents"),
        F.when(F.col("o_orderkey") % 3 == 0, F.col("o_orderdate").cast("timestamp")).alias("ledger_synced_at"))


def order_lines(spark, sf) -> DataFrame:
    """Units per (order, part)."""
    return (table(spark, sf, "lineitem").groupBy("l_orderkey", "l_partkey").agg(F.sum("l_quantity").alias("q"))
            .select(F.col("l_orderkey").cast("string").alias("order_id"), F.col("l_partkey").cast("string").alias("sku"),
                    F.col("q").cast("bigint").alias("quantity")))


def sale_references(spark, sf) -> DataFrame:
    """References of sales already on the ledger: every fifth order's lines on even parts, some split by lot."""
    pairs = table(spark, sf, "lineitem").filter((F.col("l_orderkey") % 5 == 0) & (F.col("l_partkey") % 2 == 0))
    ref = F.concat_ws(" ", F.lit("order"), F.col("l_orderkey").cast("string"), F.col("l_partkey").cast("string"))
    split = F.when(F.col("l_suppkey") % 2 == 0, F.concat(F.lit(" lot "), lot_key())).otherwise("")
    return pairs.select(F.concat(ref, split).alias("reference")).distinct()


def member_orders(spark, sf) -> DataFrame:
    return table(spark, sf, "orders").filter(F.col("o_orderstatus") == "F").select(
        F.col("o_custkey").cast("string").alias("customer"), F.col("o_orderkey").cast("string").alias("order_id"),
        F.col("o_orderdate").alias("at"), cents("o_totalprice").alias("cents"))


def carts(spark, sf) -> DataFrame:
    """Pending orders as carts."""
    pending = table(spark, sf, "orders").filter(F.col("o_orderstatus") == "P").select(F.col("o_orderkey").cast("string").alias("order_id"))
    return order_lines(spark, sf).join(pending, "order_id").select(
        F.col("order_id").alias("cart_id"), F.col("sku").cast("bigint").alias("line_no"), "sku", "quantity")
