"""Gap reports over stock, pages, keywords and studies as of 2001-12-31."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from stockweave.operators import gaps
from stockweave.plans import views as v
from stockweave.plans.graph_queries import WRITES, user_conflicts
from stockweave.plans.registry import query
from stockweave.plans.stock_queries import LOTS, PRODUCTS, STOCK, product_stock

TODAY = dt.date(2001, 12, 31)


def pages(spark, sf):
    """Orders as pages: open ones are live; the order date is the last update."""
    return v.table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("page_id"), F.when(F.col("o_orderstatus") == "O", "live").otherwise("draft").alias("status"),
        F.to_date("o_orderdate").alias("last_updated"))


def features(spark, sf):
    """A page features the part of its first line."""
    return v.table(spark, sf, "lineitem").filter("l_linenumber = 1").select(F.col("l_orderkey").alias("page_id"), F.col("l_partkey").cast("string").alias("product_id"))


def studies(spark, sf):
    """Every third document is a study; it is verified when labelled as not toxic."""
    d, t = v.table(spark, sf, "documents").select("doc_id"), v.table(spark, sf, "labels").select("doc_id", "toxic")
    return d.filter("doc_id % 3 = 2").join(t, "doc_id", "left").select(F.col("doc_id").alias("study_id"), (F.col("toxic") == 0).alias("verified"))


STUDIES = "studies AS (SELECT doc_id AS study_id, toxic = 0 AS verified FROM documents LEFT JOIN labels USING (doc_id) WHERE doc_id % 3 = 2)"


@query("expiring_lots", f"WITH {LOTS} SELECT lot_id, expires_on, CAST(expires_on - DATE '2001-12-31' AS INTEGER) AS days_left FROM lots WHERE expires_on - DATE '2001-12-31' <= 90")
def _expiring(spark, sf):
    return gaps.expiring_lots(v.lots(spark, sf), F.lit(TODAY)).select("lot_id", "expires_on", "days_left")


@query("low_stock", f"WITH {STOCK} SELECT sku, on_hand FROM stock WHERE status = 'active' AND on_hand <= 3 AND NOT (fulfilment = 'just_in_time' AND on_hand = 0)")
def _low(spark, sf):
    return gaps.low_stock(product_stock(spark, sf)).select("sku", "on_hand")


@query("without_photo", f"WITH {PRODUCTS} SELECT sku, name FROM products WHERE status IN ('active', 'coming_soon') AND p_partkey % 3 = 0")
def _no_photo(spark, sf):
    photos = v.table(spark, sf, "part").filter("p_partkey % 3 <> 0").select(F.col("p_partkey").cast("string").alias("product_id"))
    return gaps.without_photo(v.products(spark, sf), photos).select("sku", "name")


@query("without_live_page", f"WITH {PRODUCTS} SELECT sku, name FROM products WHERE status = 'active' AND p_partkey NOT IN (SELECT l_partkey FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE o_orderstatus = 'O' AND l_linenumber = 1)")
def _no_page(spark, sf):
    return gaps.without_live_page(v.products(spark, sf), features(spark, sf), pages(spark, sf)).select("sku", "name")


@query("untargeted_keywords", "SELECT c_custkey AS keyword_id FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'O')")
def _keywords(spark, sf):
    """Customers as keywords, open orders as the pages that target them."""
    keywords = v.table(spark, sf, "customer").select(F.col("c_custkey").alias("keyword_id"))
    targets = v.table(spark, sf, "orders").filter("o_orderstatus = 'O'").select(F.col("o_custkey").alias("keyword_id"))
    return gaps.untargeted_keywords(keywords, targets)


@query("uncited_studies", f"WITH {STUDIES} SELECT study_id FROM studies WHERE verified AND NOT ((study_id - 1) % 2 = 0)")
def _uncited(spark, sf):
    cites = v.table(spark, sf, "documents").filter("doc_id % 3 = 1 AND doc_id % 2 = 0").select((F.col("doc_id") + 1).alias("study_id"))
    return gaps.uncited_studies(studies(spark, sf), cites).select("study_id")


@query("unverified_studies", f"WITH {STUDIES} SELECT study_id FROM studies WHERE verified IS DISTINCT FROM true")
def _unverified(spark, sf):
    return gaps.unverified_studies(studies(spark, sf)).select("study_id")


@query("stale_pages", """WITH changed AS (SELECT l_partkey, CAST(max(l_shipdate) AS DATE) AS changed_on FROM lineitem GROUP BY l_partkey)
  SELECT o_orderkey AS page_id, CAST(o_orderdate AS DATE) AS last_updated, CAST(c.l_partkey AS VARCHAR) AS other, changed_on
  FROM orders JOIN lineitem l ON l_orderkey = o_orderkey JOIN changed c ON c.l_partkey = l.l_partkey
  WHERE o_orderstatus = 'O' AND l_linenumber = 1 AND changed_on > CAST(o_orderdate AS DATE)
  QUALIFY row_number() OVER (PARTITION BY o_orderkey ORDER BY CAST(c.l_partkey AS VARCHAR)) = 1""")
def _stale(spark, sf):
    changes = v.table(spark, sf, "lineitem").groupBy(F.col("l_partkey").cast("string").alias("other")).agg(F.to_date(F.max("l_shipdate")).alias("changed_on"))
    return gaps.stale_pages(pages(spark, sf), features(spark, sf).withColumnRenamed("product_id", "other"), changes)


@query("conflicted_nodes", f"WITH {WRITES} SELECT id, count(*) AS n_attrs FROM base GROUP BY id")
def _conflicted(spark, sf):
    return gaps.conflicted_nodes(user_conflicts(spark, sf))
