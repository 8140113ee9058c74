"""Stock, allocation, availability and quotes."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from stockweave.operators import allocate, ledger as lg, orders as od
from stockweave.plans import views as v
from stockweave.plans.registry import query

BUILT = "2001-01-01"

PRODUCTS = """products AS (SELECT p_partkey, CAST(p_partkey AS VARCHAR) AS sku, p_name AS name, p_retailprice AS price_usd,
  CASE WHEN p_size % 10 < 7 THEN 'active' WHEN p_size % 10 < 9 THEN 'coming_soon' ELSE 'draft' END AS status,
  CASE WHEN p_size % 4 = 0 THEN 'just_in_time' ELSE 'stocked' END AS fulfilment, lower(p_type) AS class, p_brand AS brand,
  p_size AS size FROM part)"""
LEDGER = """ledger AS (SELECT l_partkey, concat_ws('-', l_partkey, l_suppkey) AS lot_id, kind, l_quantity AS quantity,
  CAST(l_shipdate AS DATE) AS occurred_on, CAST(l_orderkey AS VARCHAR) AS reference,
  CASE WHEN kind IN ('received','released','adjusted') THEN l_quantity
       WHEN kind IN ('sold','reserved','damaged','expired') THEN -l_quantity ELSE 0 END AS delta
  FROM (SELECT *, CASE WHEN l_returnflag='R' AND l_linenumber>=6 THEN 'damaged' WHEN l_returnflag='R' THEN 'sold'
    WHEN l_returnflag='A' THEN 'adjusted' WHEN l_linenumber=7 THEN 'transfer' ELSE 'received' END AS kind FROM lineitem))"""
LOTS = """lots AS (SELECT l_partkey, CAST(l_partkey AS VARCHAR) AS sku, concat_ws('-', l_partkey, l_suppkey) AS lot_id,
  CASE WHEN l_suppkey % 5 = 0 THEN NULL ELSE CAST(max(l_shipdate) AS DATE) + 365 END AS expires_on,
  CASE l_suppkey % 3 WHEN 0 THEN 'pending' WHEN 1 THEN 'received' ELSE 'published' END AS coa_status,
  CASE WHEN l_suppkey % 4 <> 0 THEN 99.1 END AS purity_measured,
  CASE WHEN l_suppkey % 2 = 0 THEN 'lab-us' ELSE 'lab-eu' END AS coa_lab, l_suppkey
  FROM lineitem GROUP BY l_partkey, l_suppkey)"""
LOT_STOCK = f"""{LEDGER}, {LOTS}, lot_stock AS (SELECT l.*, coalesce(m.on_hand, 0) AS on_hand FROM lots l
  LEFT JOIN (SELECT lot_id, sum(delta) AS on_hand FROM ledger GROUP BY lot_id) m USING (lot_id))"""
STOCK = f"""{PRODUCTS}, {LOT_STOCK}, stock AS (SELECT p.*, coalesce(s.on_hand, 0) AS on_hand, coalesce(s.n_lots, 0) AS n_lots
  FROM products p LEFT JOIN (SELECT sku, sum(on_hand) AS on_hand, count(*) AS n_lots FROM lot_stock GROUP BY sku) s USING (sku))"""
SHOP = """shop_orders AS (SELECT CAST(o_orderkey AS VARCHAR) AS order_id, o_orderdate AS created_at,
    CASE o_orderstatus WHEN 'F' THEN 'paid' WHEN 'P' THEN 'pending' ELSE 'refunded' END AS status,
    o_orderkey % 3 = 0 AS synced FROM orders),
  lines AS (SELECT CAST(l_orderkey AS VARCHAR) AS order_id, CAST(l_partkey AS VARCHAR) AS sku,
    CAST(sum(l_quantity) AS BIGINT) AS quantity FROM lineitem GROUP BY l_orderkey, l_partkey)"""
REFS = """refs AS (SELECT DISTINCT concat_ws(' ', 'order', l_orderkey, l_partkey)
    || CASE WHEN l_suppkey % 2 = 0 THEN ' lot ' || concat_ws('-', l_partkey, l_suppkey) ELSE '' END AS reference
  FROM lineitem WHERE l_orderkey % 5 = 0 AND l_partkey % 2 = 0),
  on_ledger AS (SELECT DISTINCT regexp_extract(reference, '^order [0-9]+ [0-9]+') AS ref FROM refs)"""
SOLD = f"""sold AS (SELECT sku, CAST(sum(quantity) AS BIGINT) AS sold FROM lines JOIN shop_orders USING (order_id)
  WHERE status IN ('pending','requires_action','paid') AND (created_at >= TIMESTAMP '{BUILT}' OR (status='paid' AND NOT synced))
  GROUP BY sku)"""
AVAILABLE = f"""{STOCK}, {SHOP}, {SOLD}, available AS (SELECT s.*, coalesce(d.sold, 0) AS sold,
  CASE WHEN fulfilment='just_in_time' THEN greatest(on_hand, 10) ELSE on_hand END - coalesce(d.sold, 0) AS available
  FROM stock s LEFT JOIN sold d USING (sku))"""
FEFO = """fefo AS (SELECT sku, lot_id, CAST(floor(on_hand) AS BIGINT) AS units, expires_on,
  row_number() OVER w AS fefo_rank, CAST(sum(floor(on_hand)) OVER w AS BIGINT) AS unit_to
  FROM lot_stock WHERE on_hand > 0 WINDOW w AS (PARTITION BY sku ORDER BY expires_on NULLS LAST, lot_id))"""
DECIDE = f"""WITH RECURSIVE {LOT_STOCK}, {SHOP}, {REFS}, {FEFO},
  caps AS (SELECT sku, max(unit_to) AS cap FROM fefo GROUP BY sku),
  due AS (SELECT order_id, sku, quantity, status, created_at FROM lines JOIN shop_orders USING (order_id)
    WHERE status IN ('paid','refunded') AND NOT synced),
  judged AS (SELECT d.*, r.ref IS NOT NULL AS seen FROM due d LEFT JOIN on_ledger r ON r.ref = concat_ws(' ', 'order', order_id, sku)),
  turn AS (SELECT j.*, coalesce(cap, 0) AS cap, row_number() OVER (PARTITION BY j.sku ORDER BY created_at, order_id) AS rn
    FROM judged j LEFT JOIN caps USING (sku) WHERE status='paid' AND NOT seen),
  walk AS (SELECT sku, CAST(0 AS BIGINT) AS rn, CAST(NULL AS VARCHAR) AS order_id, CAST(cap AS BIGINT) AS left_after,
      CAST(NULL AS BIGINT) AS unit_start FROM (SELECT DISTINCT sku, cap FROM turn)
    UNION ALL SELECT t.sku, t.rn, t.order_id, CAST(CASE WHEN t.quantity <= w.left_after THEN w.left_after - t.quantity ELSE w.left_after END AS BIGINT),
      CAST(CASE WHEN t.quantity <= w.left_after THEN t.cap - w.left_after END AS BIGINT)
    FROM walk w JOIN turn t ON t.sku = w.sku AND t.rn = w.rn + 1),
  decided AS (SELECT j.order_id, j.sku, j.quantity, j.created_at, w.unit_start,
    CASE WHEN status='refunded' THEN 'refunded' WHEN seen THEN 'recorded' WHEN w.unit_start IS NOT NULL THEN 'sold' ELSE 'waits' END AS outcome
    FROM judged j LEFT JOIN (SELECT * FROM walk WHERE rn > 0) w USING (sku, order_id)),
  parts AS (SELECT d.order_id, d.sku, f.lot_id, f.fefo_rank, d.created_at,
      least(d.unit_start + d.quantity, f.unit_to) - greatest(d.unit_start, f.unit_to - f.units) AS taken,
      concat_ws(' ', 'order', order_id, d.sku)
        || CASE WHEN d.unit_start >= f.unit_to - f.units THEN '' ELSE ' lot ' || f.lot_id END AS reference
    FROM decided d JOIN fefo f ON f.sku = d.sku AND d.unit_start < f.unit_to AND f.unit_to - f.units < d.unit_start + d.quantity
    WHERE outcome = 'sold')"""


def lot_stock(spark, sf):
    return lg.lot_on_hand(v.lots(spark, sf), v.ledger(spark, sf))


def product_stock(spark, sf):
    return lg.product_on_hand(v.products(spark, sf), lot_stock(spark, sf))


def due_lines(spark, sf):
    return od.read_paid_lines(v.shop_orders(spark, sf), v.order_lines(spark, sf))


def sold(spark, sf):
    return od.sold_since(v.shop_orders(spark, sf), v.order_lines(spark, sf), F.lit(dt.datetime(2001, 1, 1)))


def available(spark, sf):
    return od.available_to_promise(product_stock(spark, sf), sold(spark, sf))


def decisions(spark, sf):
    from stockweave.functions.runtime import materialize
    lots = materialize(allocate.fefo_lots(lot_stock(spark, sf)), "fefo")
    return allocate.decide_lines(due_lines(spark, sf), lots, v.sale_references(spark, sf)), lots


@query("stock_on_hand", f"WITH {STOCK} SELECT sku, name, status, on_hand, n_lots FROM stock")
def _stock(spark, sf):
    return product_stock(spark, sf).select("sku", "name", "status", "on_hand", "n_lots")


@query("lot_on_hand", f"WITH {LOT_STOCK} SELECT lot_id, sku, expires_on, coa_status, on_hand FROM lot_stock")
def _lots(spark, sf):
    return lot_stock(spark, sf).select("lot_id", "sku", "expires_on", "coa_status", "on_hand")


@query("stock_lines", f"""WITH {STOCK} SELECT sku AS product_id, '- ' || name || ' (sku ' || sku || ', ' || status || '): on_hand=' || CAST(on_hand AS BIGINT) AS stock_line FROM stock
  UNION ALL SELECT sku, '    batch ' || lot_id || ': on_hand=' || CAST(on_hand AS BIGINT) || ' expires=' || coalesce(CAST(expires_on AS VARCHAR), 'None') || ' purity='
    || CASE WHEN purity_measured IS NULL THEN 'None' ELSE '99.1' END || ' coa=' || coa_status FROM lot_stock""")
def _stock_lines(spark, sf):
    return lg.stock_lines(product_stock(spark, sf), lot_stock(spark, sf)).select("product_id", "stock_line")


@query("movement_history", f"WITH {LEDGER} SELECT lot_id, occurred_on, kind, quantity, reference, delta FROM ledger")
def _history(spark, sf):
    return lg.movement_history(v.lots(spark, sf), v.ledger(spark, sf)).select(
        "lot_id", "occurred_on", "kind", "quantity", "reference", "delta")


@query("fefo_lots", f"WITH {LOT_STOCK}, {FEFO} SELECT sku, lot_id, units, fefo_rank, unit_to FROM fefo")
def _fefo(spark, sf):
    return allocate.fefo_lots(lot_stock(spark, sf)).select("sku", "lot_id", "units", "fefo_rank", "unit_to")


@query("paid_lines", f"""WITH {SHOP} SELECT order_id, sku, quantity, status FROM lines JOIN shop_orders USING (order_id)
  WHERE status IN ('paid','refunded') AND NOT synced""")
def _paid_lines(spark, sf):
    return due_lines(spark, sf).select("order_id", "sku", "quantity", "status")


@query("allocate_orders", f"{DECIDE} SELECT order_id, sku, quantity, unit_start, outcome FROM decided")
def _allocate(spark, sf):
    return decisions(spark, sf)[0].select("order_id", "sku", "quantity", "unit_start", "outcome")


@query("sale_events", f"""{DECIDE} SELECT printf('IE-%04d', 1 + row_number() OVER (ORDER BY created_at, order_id, sku, fefo_rank)) AS event_id,
  lot_id, 'sold' AS kind, CAST(taken AS DOUBLE) AS quantity, CAST(created_at AS DATE) AS occurred_on, reference FROM parts""")
def _sale_events(spark, sf):
    d, lots = decisions(spark, sf)
    return allocate.sale_events(allocate.sale_parts(d, lots), start=2)


@query("order_outcomes", f"""{DECIDE} SELECT order_id, CASE WHEN bool_or(outcome='waits') THEN 'blocked'
  WHEN bool_or(outcome IN ('sold','recorded')) THEN 'recorded' ELSE 'refunded' END AS outcome FROM decided GROUP BY order_id""")
def _outcomes(spark, sf):
    return allocate.order_outcomes(decisions(spark, sf)[0])


@query("next_event_number", f"""{DECIDE}, numbered AS (SELECT printf('IE-%04d', row_number() OVER (ORDER BY created_at, order_id, sku, fefo_rank)) AS event_id FROM parts)
  SELECT CAST(coalesce(max(CAST(regexp_extract(event_id, 'IE-([0-9]+)', 1) AS BIGINT)), 0) + 1 AS BIGINT) AS next_number FROM numbered""")
def _next_number(spark, sf):
    d, lots = decisions(spark, sf)
    events = allocate.sale_events(allocate.sale_parts(d, lots))
    return lg.next_event_numbers(events)


MARK = f"""WITH {SHOP}, {REFS}, f AS (SELECT order_id, bool_and(status='paid') AS p, bool_and(status='refunded') AS rf,
    bool_or(status='refunded') AS anyrf, bool_and(r.ref IS NOT NULL) AS allon, bool_or(r.ref IS NOT NULL) AS anyon
  FROM lines JOIN shop_orders USING (order_id) LEFT JOIN on_ledger r ON r.ref = concat_ws(' ', 'order', order_id, sku)
  WHERE status IN ('paid','refunded') AND NOT synced GROUP BY order_id)"""


@query("orders_to_mark", f"{MARK} SELECT order_id FROM f WHERE (p AND allon) OR (rf AND NOT anyon)")
def _mark(spark, sf):
    return allocate.orders_to_mark(due_lines(spark, sf), v.sale_references(spark, sf))


@query("refunded_after_sale", f"{MARK} SELECT order_id FROM f WHERE anyrf AND anyon")
def _refunded(spark, sf):
    return allocate.refunded_after_sale(due_lines(spark, sf), v.sale_references(spark, sf))


@query("sold_since", f"WITH {SHOP}, {SOLD} SELECT sku, sold FROM sold")
def _sold(spark, sf):
    return sold(spark, sf)


@query("available_to_promise", f"WITH {AVAILABLE} SELECT sku, fulfilment, on_hand, CAST(sold AS BIGINT) AS sold, CAST(available AS DOUBLE) AS available FROM available")
def _available(spark, sf):
    return available(spark, sf).select("sku", "fulfilment", "on_hand", F.col("sold").cast("bigint").alias("sold"), "available")


@query("quote_carts", f"""WITH {AVAILABLE}, cart AS (SELECT l.order_id AS cart_id, l.sku, CAST(l.sku AS BIGINT) AS line_no, l.quantity
    FROM lines l JOIN shop_orders o USING (order_id) WHERE o.status='pending'),
  judged AS (SELECT c.*, a.name, a.price_usd, greatest(a.available, 0) AS avail,
    CASE WHEN a.name IS NULL OR c.quantity < 1 OR c.quantity > 20 THEN 'invalid'
         WHEN NOT (a.status='active' AND (a.on_hand > 0 OR a.fulfilment='just_in_time')) THEN 'unavailable'
         WHEN a.available < c.quantity THEN 'short' END AS rule FROM cart c LEFT JOIN available a USING (sku)),
  fault AS (SELECT cart_id, sku, rule, CASE rule WHEN 'invalid' THEN 'A cart line is invalid.' WHEN 'unavailable' THEN name || ' is not available.'
      ELSE 'Only ' || CAST(CAST(avail AS BIGINT) AS VARCHAR) || ' of ' || name || ' remain.' END AS message
    FROM judged WHERE rule IS NOT NULL QUALIFY row_number() OVER (PARTITION BY cart_id ORDER BY line_no) = 1)
  SELECT t.cart_id, coalesce(f.rule, 'ok') AS outcome, f.sku AS failed_sku, f.message,
    CASE WHEN f.cart_id IS NULL THEN t.total END AS subtotal_cents
  FROM (SELECT cart_id, CAST(sum(CAST(round(price_usd * 100) AS BIGINT) * quantity) AS BIGINT) AS total FROM judged GROUP BY cart_id) t
  LEFT JOIN fault f USING (cart_id)""")
def _quotes(spark, sf):
    return od.quote_carts(v.carts(spark, sf), available(spark, sf))


@query("pickup_lines", f"""WITH {AVAILABLE} SELECT l.order_id, l.sku, l.quantity,
  CAST(CASE WHEN a.fulfilment='just_in_time' THEN greatest(a.sold - a.on_hand, 0) ELSE 0 END AS DOUBLE) AS shortfall,
  coalesce(a.fulfilment='just_in_time' AND a.sold - a.on_hand > 0, false) AS pickup
  FROM lines l JOIN shop_orders o USING (order_id) LEFT JOIN available a USING (sku) WHERE o.status='paid'""")
def _pickups(spark, sf):
    paid = v.shop_orders(spark, sf).filter("status = 'paid'").select("order_id")
    return od.pickup_lines(v.order_lines(spark, sf).join(paid, "order_id"), product_stock(spark, sf), sold(spark, sf))
