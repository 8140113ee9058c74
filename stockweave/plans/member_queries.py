"""Member levels over the paid orders."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from stockweave.functions.runtime import materialize
from stockweave.operators import members as m
from stockweave.plans import views as v
from stockweave.plans.registry import query

LEVELS = [m.Level("Base", 0), m.Level("Middle", 200_000, 10, True), m.Level("Top", 600_000, 15, True)]
AS_OF = [dt.datetime(1998, 1, 1), dt.datetime(2001, 8, 1)]
Y = "INTERVAL 365 DAY"
LEVEL = "CASE WHEN {0} >= 60000000 THEN 2 WHEN {0} >= 20000000 THEN 1 ELSE 0 END"
PAID = """paid AS (SELECT CAST(o_custkey AS VARCHAR) AS customer, CAST(o_orderkey AS VARCHAR) AS order_id, o_orderdate AS t,
  CAST(round(o_totalprice * 100) AS BIGINT) AS cents FROM orders WHERE o_orderstatus='F')"""
EARNED = f"""{PAID}, earned AS (SELECT *, {LEVEL.format('rolling_cents')} AS level FROM (
  SELECT a.customer, a.order_id, a.t, a.cents, CAST(sum(b.cents) AS BIGINT) AS rolling_cents FROM paid a JOIN paid b
    ON a.customer = b.customer AND b.t > a.t - {Y} AND b.t <= a.t GROUP BY ALL))"""


def status_sql(n: str) -> str:
    return f"""SELECT customer, level, level_name, spend12,
    strftime(CASE level WHEN 1 THEN greatest(h1, CASE WHEN soft = 1 THEN s1 END)
      WHEN 2 THEN greatest(h2, CASE WHEN soft = 2 THEN s2 END) END, '%Y-%m-%d') AS holds_until,
    CASE level WHEN 0 THEN 'Middle' WHEN 1 THEN 'Top' END AS next_name,
    CASE level WHEN 0 THEN greatest(20000000 - spend12, 0) WHEN 1 THEN greatest(60000000 - spend12, 0) END AS to_go
  FROM (SELECT *, greatest(held, soft) AS level, CASE greatest(held, soft) WHEN 0 THEN 'Base' WHEN 1 THEN 'Middle' ELSE 'Top' END AS level_name
    FROM (SELECT *, greatest(prior - 1, 0) AS soft FROM (SELECT customer,
      coalesce(max(level) FILTER (is_held), 0) AS held, coalesce(max(level) FILTER (is_prior), 0) AS prior,
      max(t + {Y}) FILTER (is_held AND level >= 1) AS h1, max(t + {Y}) FILTER (is_held AND level >= 2) AS h2,
      max(t + {Y} + {Y}) FILTER (is_prior AND level >= 2) AS s1, CAST(NULL AS TIMESTAMP) AS s2,
      CAST(coalesce(sum(cents) FILTER (is_held), 0) AS BIGINT) AS spend12
      FROM (SELECT *, t > {n} - {Y} AND t <= {n} AS is_held, t > {n} - {Y} - {Y} AND t <= {n} - {Y} AS is_prior FROM earned)
      GROUP BY customer)))"""


BOTH = " UNION ALL ".join(f"SELECT '{d:%Y-%m-%d}' AS as_of, * FROM ({status_sql(f'TIMESTAMP {chr(39)}{d}{chr(39)}')})" for d in AS_OF)
BEFORE = f"""SELECT c.customer, c.order_id, c.t,
    greatest(coalesce(max(e.level) FILTER (e.t > c.t - {Y}), 0),
             coalesce(max(e.level) FILTER (e.t <= c.t - {Y}), 0) - 1, 0) AS level_before
  FROM (SELECT a.customer, a.order_id, a.t FROM paid a) c LEFT JOIN (
    SELECT x.customer, x.order_id AS skip, x.t AS at_t, e.t, {LEVEL.format('(e.rolling_cents - CASE WHEN e.t = x.t THEN x.cents ELSE 0 END)')} AS level
    FROM paid x JOIN earned e ON e.customer = x.customer AND e.order_id <> x.order_id AND e.t <= x.t AND e.t > x.t - {Y} - {Y}) e
    ON e.customer = c.customer AND e.skip = c.order_id GROUP BY ALL"""
AFTER = f"""SELECT c.customer, c.order_id,
    greatest(max(e.level) FILTER (e.t > c.t - {Y}), coalesce(max(e.level) FILTER (e.t <= c.t - {Y}), 0) - 1, 0) AS level_after
  FROM paid c JOIN earned e ON e.customer = c.customer AND e.t <= c.t AND e.t > c.t - {Y} - {Y} GROUP BY ALL"""


def earned(spark, sf):
    return m.earned_levels(v.member_orders(spark, sf), LEVELS)


def status(spark, sf, when):
    return m.status_at(earned(spark, sf), LEVELS, F.lit(when))


@query("paid_history", """SELECT 'c' || o_custkey || '@example.org' AS customer, CAST(o_orderkey AS VARCHAR) AS order_id, o_orderdate AS placed_at,
  CAST(round(o_totalprice * 100) AS BIGINT) - CASE WHEN o_orderkey % 4 = 0 THEN 500 ELSE 0 END AS cents FROM orders WHERE o_orderstatus='F'""")
def _history(spark, sf):
    return m.paid_history(v.shop_orders(spark, sf)).select(
        "customer", "order_id", F.col("at").cast("timestamp_ntz").alias("placed_at"), "cents")


@query("level_for_spend", f"WITH {PAID} SELECT customer, CAST(sum(cents) AS BIGINT) AS spent, {LEVEL.format('sum(cents)')} AS level FROM paid GROUP BY customer")
def _levels(spark, sf):
    spent = v.member_orders(spark, sf).groupBy("customer").agg(F.sum("cents").alias("spent"))
    return spent.withColumn("level", m.level_for_spend(LEVELS, "spent"))


@query("earned_levels", f"WITH {EARNED} SELECT customer, order_id, cents, rolling_cents, level FROM earned")
def _earned(spark, sf):
    return earned(spark, sf).select("customer", "order_id", "cents", "rolling_cents", "level")


@query("member_status", f"WITH {EARNED} {BOTH}")
def _status(spark, sf):
    e = materialize(earned(spark, sf), "earned")
    one, two = (m.status_at(e, LEVELS, F.lit(d)).select(F.lit(f"{d:%Y-%m-%d}").alias("as_of"), "*") for d in AS_OF)
    return one.unionByName(two)


PRICED = f"""priced AS (SELECT o.o_orderkey, s.*, c.sub, CAST(floor(c.sub * CASE level WHEN 0 THEN 0 WHEN 1 THEN 10 ELSE 15 END / 100 + 0.5) AS BIGINT) AS discount_cents
  FROM orders o JOIN (SELECT o_orderkey, CAST(round(o_totalprice) AS BIGINT) AS sub FROM orders) c USING (o_orderkey)
  JOIN status s ON s.customer = CAST(o.o_custkey AS VARCHAR) WHERE o.o_orderstatus='P')"""
LAST = f"WITH {EARNED}, status AS ({status_sql(f'TIMESTAMP {chr(39)}{AS_OF[1]}{chr(39)}')}), {PRICED}"


def priced(spark, sf):
    """Pending orders, a hundredth of their price as the cart, at the customer's level."""
    pending = v.table(spark, sf, "orders").filter(F.col("o_orderstatus") == "P").select(
        F.col("o_orderkey").alias("order_key"), F.col("o_custkey").cast("string").alias("customer"),
        F.round("o_totalprice").cast("bigint").alias("subtotal_cents"))
    return m.member_price(pending.join(status(spark, sf, AS_OF[1]), "customer"), LEVELS)


@query("member_price", f"""{LAST} SELECT o_orderkey AS order_key, level, sub AS subtotal_cents, discount_cents, sub - discount_cents AS net_cents,
  CAST(CASE WHEN level > 0 THEN 0 WHEN sub - discount_cents >= 15000 THEN 0 ELSE 2495 END AS BIGINT) AS shipping_cents,
  sub - discount_cents + CASE WHEN level > 0 OR sub - discount_cents >= 15000 THEN 0 ELSE 2495 END AS total_cents FROM priced""")
def _price(spark, sf):
    return priced(spark, sf).select("order_key", "level", "subtotal_cents", "discount_cents", "net_cents",
                                    F.col("shipping_cents").cast("bigint").alias("shipping_cents"), "total_cents")


@query("shipping_cents", "SELECT CAST(o_orderkey AS VARCHAR) AS order_id, CASE WHEN round(o_totalprice) >= 15000 THEN 0 ELSE 2495 END AS shipping FROM orders")
def _shipping(spark, sf):
    return v.table(spark, sf, "orders").select(F.col("o_orderkey").cast("string").alias("order_id"),
                                               m.shipping_cents(F.round("o_totalprice")).alias("shipping"))


DOLLARS = "'$' || format('{{:,}}', CAST(ceil({0} / 100.0) AS BIGINT))"
@query("member_progress", f"""{LAST}, net AS (SELECT *, sub - discount_cents AS cart_net,
    CASE WHEN level > 0 AND holds_until IS NOT NULL THEN level_name || ' status through ' || strftime(CAST(holds_until AS DATE), '%B %Y') || '. ' ELSE '' END AS have FROM priced),
  k AS (SELECT *, CASE WHEN next_name IS NULL THEN 'top' WHEN cart_net >= to_go THEN 'lifts'
    WHEN to_go <= CASE level WHEN 0 THEN 20000000 ELSE 60000000 END * 0.25 THEN 'near' ELSE 'far' END AS progress FROM net)
  SELECT o_orderkey AS order_key, progress, CASE progress
    WHEN 'top' THEN level_name || ' status' || coalesce(' through ' || strftime(CAST(holds_until AS DATE), '%B %Y'), '') || '.'
    WHEN 'lifts' THEN have || 'This order takes you to ' || next_name || '.'
    WHEN 'near' THEN have || {DOLLARS.format('to_go')} || ' from ' || next_name || ': ' || CASE level WHEN 0 THEN '10' ELSE '15' END || '% off and free shipping on every order.'
    ELSE have || next_name || ' status at ' || CASE level WHEN 0 THEN '$200,000' ELSE '$600,000' END || ' in 12 months. You''re at ' || {DOLLARS.format('spend12')} || '.' END AS progress_text
  FROM k""")
def _progress(spark, sf):
    return m.progress(priced(spark, sf), LEVELS, "net_cents").select("order_key", "progress", "progress_text")


@query("tier_ups", f"""WITH {EARNED}, b AS ({BEFORE}), a AS ({AFTER})
  SELECT b.customer, b.order_id, b.level_before, a.level_after, a.level_after > b.level_before AS tier_up FROM b JOIN a USING (customer, order_id)""")
def _tier_ups(spark, sf):
    return m.tier_ups(earned(spark, sf), LEVELS)


@query("tier_ups_as_of", f"""WITH {EARNED}, b AS ({BEFORE}), s AS ({status_sql(f'TIMESTAMP {chr(39)}{AS_OF[1]}{chr(39)}')})
  SELECT b.customer, b.order_id, b.level_before, s.level AS level_after, s.level > b.level_before AS tier_up FROM b JOIN s USING (customer)""")
def _tier_ups_as_of(spark, sf):
    return m.tier_ups(earned(spark, sf), LEVELS, status(spark, sf, AS_OF[1]))
