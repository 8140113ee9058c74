"""Payment events and ledger streams over the event, order and line-item tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from stockweave.functions.runtime import materialize, new_path
from stockweave.operators import members, orders as od
from stockweave.plans import views as v
from stockweave.plans.member_queries import AFTER, BEFORE, EARNED, LEVELS
from stockweave.plans.registry import query
from stockweave.plans.stock_queries import AVAILABLE, LEDGER, LOT_STOCK, SHOP, due_lines, lot_stock, product_stock, sold
from stockweave.streaming import payments, pull

LATER = 1_000_000_000_000


def _payload(e, type_):
    """Five shapes of the same facts, by event id; the fifth names only the payment, some of the first name a customer and an error too."""
    shape, q = e % 5, lambda c: F.concat(F.lit('"'), c, F.lit('"'))
    order, pay = F.col("user_id").cast("string"), F.concat(F.lit("pay_"), ((F.col("user_id") + e % 2) % 50).cast("string"))
    customer = F.when(e % 10 == 0, F.concat(F.lit(',"customerId":"cus_'), (F.col("user_id") % 97).cast("string"), F.lit('"'))).otherwise("")
    error = F.when(e % 15 == 0, F.concat(F.lit(',"error":"declined '), (e % 7).cast("string"), F.lit('"'))).otherwise("")
    body = (F.when(shape == 0, F.concat(F.lit('{"object":{"paymentId":'), q(pay), F.lit(',"orderId":'), q(order), customer, error, F.lit("}}")))
            .when(shape == 1, F.concat(F.lit('{"object":{"payment_id":'), q(pay), F.lit(',"order_id":'), q(order), F.lit("}}")))
            .when(shape == 2, F.concat(F.lit('{"id":'), q(pay), F.lit(',"metadata":{"orderId":'), q(order), F.lit("}}")))
            .when(shape == 3, F.concat(F.lit('{"object":{"id":'), q(pay), F.lit(',"metadata":{"cartCustomAttributes":{"orderId":'), q(order), F.lit("}}}}")))
            .otherwise(F.concat(F.lit('{"object":{"paymentId":'), q(pay), F.lit("}}"))))
    return F.concat(F.lit('{"id":"evt_'), e.cast("string"), F.lit('","type":"'), type_, F.lit('","data":'), body, F.lit("}"))


def deliveries(events):
    """Events as (payload, arrival, ts); every seventh is delivered again later, then claiming failure."""
    e, kind = F.col("event_id"), F.col("event_type")
    type_ = (F.when(kind == "purchase", "payment/succeeded").when(kind == "error", "payment.failed").when(kind == "signup", "order/refunded")
             .when(kind == "click", "cart/updated").otherwise("page/view/extra"))
    once = events.select(_payload(e, type_).alias("payload"), e.alias("arrival"), "ts")
    again = events.filter(e % 7 == 0).select(_payload(e, F.lit("payment.failed")).alias("payload"), (e + LATER).alias("arrival"), "ts")
    return once.unionByName(again)


def shop(spark, sf):
    return v.table(spark, sf, "orders").select(F.col("o_orderkey").cast("string").alias("order_id"), F.lit("pending").alias("status"),
                                               F.lit(None).cast("string").alias("payment_id"))


def fresh(spark, sf):
    return payments.first_deliveries(payments.normalize(deliveries(v.table(spark, sf, "events"))))


EVENTS = """ev AS (SELECT event_id AS seq, 'evt_' || event_id AS event_id, CASE event_type WHEN 'purchase' THEN 'payment.succeeded' WHEN 'error' THEN 'payment.failed' WHEN 'signup' THEN 'order.refunded'
      WHEN 'click' THEN 'cart.updated' ELSE 'page.view/extra' END AS event_type, CASE WHEN event_id % 5 <> 4 THEN CAST(user_id AS VARCHAR) END AS order_id,
    CASE WHEN event_id % 5 IN (0, 1, 4) OR event_type IN ('purchase', 'error') THEN 'pay_' || (user_id + event_id % 2) % 50 END AS payment_id,
    CASE event_type WHEN 'purchase' THEN 'paid' WHEN 'error' THEN 'failed' WHEN 'signup' THEN 'refunded' END AS status,
    CASE WHEN event_id % 10 = 0 THEN 'cus_' || user_id % 97 END AS customer_id, CASE WHEN event_id % 15 = 0 THEN 'declined ' || event_id % 7 END AS error FROM events)"""
MOVED = f"""{EVENTS}, direct AS (SELECT * FROM ev WHERE status IS NOT NULL AND order_id IN (SELECT CAST(o_orderkey AS VARCHAR) FROM orders)),
  fallback AS (SELECT * FROM ev WHERE status IS NOT NULL AND order_id IS NULL),
  held AS (SELECT order_id, payment_id, seq AS since, lead(seq) OVER (PARTITION BY order_id ORDER BY seq) AS until FROM direct WHERE payment_id IS NOT NULL),
  moved AS (SELECT order_id, seq, status FROM direct UNION ALL SELECT h.order_id, f.seq, f.status FROM held h JOIN fallback f ON f.payment_id = h.payment_id AND f.seq > h.since AND (h.until IS NULL OR f.seq < h.until)),
  state AS (SELECT CAST(o_orderkey AS VARCHAR) AS order_id, coalesce(s.status, 'pending') AS status, p.payment_id FROM orders
    LEFT JOIN (SELECT order_id, arg_max(status, seq) AS status FROM moved GROUP BY order_id) s ON s.order_id = CAST(o_orderkey AS VARCHAR)
    LEFT JOIN (SELECT order_id, arg_max(payment_id, seq) AS payment_id FROM direct WHERE payment_id IS NOT NULL GROUP BY order_id) p ON p.order_id = CAST(o_orderkey AS VARCHAR)),
  alerts AS (SELECT order_id, 'paid' AS kind, min(seq) AS arrival FROM moved WHERE status = 'paid' GROUP BY order_id)"""


@query("normalize_events", f"""WITH {EVENTS} SELECT event_id, seq AS arrival, event_type, order_id, payment_id FROM ev UNION ALL
  SELECT event_id, seq + {LATER}, 'payment.failed', order_id, 'pay_' || ((SELECT user_id FROM events e WHERE e.event_id = seq) + seq % 2) % 50 FROM ev WHERE seq % 7 = 0""")
def _normalize(spark, sf):
    return payments.normalize(deliveries(v.table(spark, sf, "events"))).select("event_id", "arrival", "event_type", "order_id", "payment_id")


@query("first_deliveries", f"WITH {EVENTS} SELECT event_id, seq AS arrival, event_type FROM ev")
def _first(spark, sf):
    return fresh(spark, sf).select("event_id", "arrival", "event_type")


@query("event_status", f"WITH {EVENTS} SELECT event_type, status, count(*) AS n FROM ev GROUP BY ALL")
def _map(spark, sf):
    return fresh(spark, sf).groupBy("event_type", payments.status_of().alias("status")).agg(F.count("*").alias("n"))


@query("order_status", f"WITH {MOVED} SELECT * FROM state")
def _status(spark, sf):
    o = shop(spark, sf)
    moved, paid_by = payments.status_changes(o, fresh(spark, sf))
    return payments.current_orders(o, moved, paid_by)


@query("paid_alerts", f"WITH {MOVED} SELECT * FROM alerts")
def _alerts(spark, sf):
    return payments.new_alerts(payments.status_changes(shop(spark, sf), fresh(spark, sf))[0])


LINES = f"""priced AS (SELECT l.order_id, l.sku, l.quantity, a.name, CASE WHEN a.fulfilment = 'just_in_time' THEN greatest(a.sold - a.on_hand, 0) ELSE 0 END AS short FROM lines l JOIN available a USING (sku)),
  per AS (SELECT order_id, CAST(sum(quantity) AS BIGINT) AS units, count(*) FILTER (short > 0) AS pickup_lines, count(*) FILTER (NOT short > 0) AS ship_lines, CAST(sum(short) AS DOUBLE) AS shortfall,
      string_agg(name, ', ' ORDER BY name, sku, quantity) FILTER (short > 0) AS names,
      string_agg('PICKUP (just-in-time, ' || CAST(short AS BIGINT) || ' short): ' || name || ' ×' || quantity || chr(10), '' ORDER BY name, sku, quantity) FILTER (short > 0) AS pick,
      string_agg('Ship from stock: ' || name || ' ×' || quantity || chr(10), '' ORDER BY name, sku, quantity) FILTER (NOT short > 0) AS ship FROM priced GROUP BY order_id)"""
FACTS = f"""{AVAILABLE}, {EARNED}, before AS ({BEFORE}), after AS ({AFTER}), tier AS (SELECT order_id, level_after, level_after > level_before AS tier_up FROM before JOIN after USING (customer, order_id)),
  {LINES}, told AS (SELECT CAST(o_orderkey AS VARCHAR) AS order_id, CAST(round(o_totalprice * 100) AS BIGINT) AS total_cents, o_orderdate AS t, n_name AS place,
      CASE o_orderkey % 3 WHEN 0 THEN 'Base' WHEN 1 THEN 'Middle' END AS priced_at, coalesce(units, 0) AS units, pickup_lines, ship_lines, shortfall, names, pick, ship, level_after,
      coalesce(tier_up, false) AS tier_up, CASE level_after WHEN 2 THEN 'Top' WHEN 1 THEN 'Middle' ELSE 'Base' END AS level_name
    FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey LEFT JOIN per ON order_id = CAST(o_orderkey AS VARCHAR) LEFT JOIN tier USING (order_id)),
  facts AS (SELECT order_id, total_cents, units, pickup_lines, ship_lines, shortfall, level_after, level_name, tier_up,
    CASE WHEN tier_up THEN 'Tier up: ' || level_name || ' · ' ELSE '' END || CASE WHEN pickup_lines > 0 THEN 'Pickup needed: ' || names || ' · order ' || order_id
      ELSE 'Order ' || order_id || ' paid · ship ' || units || CASE WHEN units = 1 THEN ' vial' ELSE ' vials' END END AS title,
    'Order ' || order_id || ' · $' || total_cents // 100 || '.' || lpad(CAST(total_cents % 100 AS VARCHAR), 2, '0') || ' · ' || strftime(t, '%Y-%m-%d %H:%M') || ' UTC' || chr(10)
      || coalesce(pick, '') || coalesce(ship, '') || 'Ship to: ' || place || chr(10) || 'Status: ' || level_name || CASE WHEN priced_at <> 'Base' THEN ' (priced at ' || priced_at || ')' ELSE '' END
      || ' · pack ' || lower(level_name) || ' labels' || CASE WHEN tier_up THEN ' · ADD THE ' || upper(level_name) || ' CARD' ELSE '' END AS message FROM told)"""


def facts(spark, sf):
    """What alerts about any of the orders say."""
    o, k = v.table(spark, sf, "orders"), F.col("o_orderkey") % 3
    c = v.table(spark, sf, "customer").join(v.table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", F.col("n_name").alias("place"))
    o = o.join(c, F.col("o_custkey") == F.col("c_custkey")).select(
        F.col("o_orderkey").cast("string").alias("order_id"), v.cents("o_totalprice").alias("total_cents"), F.col("o_orderdate").alias("created_at"), "place",
        F.when(k == 0, "Base").when(k == 1, "Middle").alias("priced_at"))
    lines = v.order_lines(spark, sf).join(v.products(spark, sf).select("sku", "name"), "sku")
    pickups = od.pickup_lines(lines, product_stock(spark, sf), sold(spark, sf))
    tiers = members.tier_ups(members.earned_levels(v.member_orders(spark, sf), LEVELS), LEVELS)
    return payments.order_facts(o, pickups, tiers, LEVELS)


def message(df):
    return df.withColumn("message", F.array_join("lines", "\n")).drop("lines")


@query("alert_payload", f"WITH {MOVED}, {FACTS} SELECT facts.* FROM alerts JOIN facts USING (order_id)")
def _payload_of(spark, sf):
    alerts = payments.new_alerts(payments.status_changes(shop(spark, sf), fresh(spark, sf))[0])
    return message(facts(spark, sf).join(alerts.select("order_id"), "order_id"))


def fed(spark, rows, order: str, folder: str, start, parts: int = 5) -> None:
    """Append ``rows`` in parts along ``order`` to the files of a stream, and run what ``start`` makes of it after each part."""
    edges = rows.approxQuantile(order, [i / parts for i in range(1, parts)], 0.001)
    part = sum((F.when(F.col(order) > e, 1).otherwise(0) for e in edges), F.lit(0))
    for b in range(parts):
        rows.filter(part == b).write.mode("append").parquet(folder)
        start(spark.readStream.schema(rows.schema).parquet(folder)).awaitTermination()


def streamed_payments(spark, sf, said=None):
    """Five runs of the payment stream, one for each part of the deliveries, in order of arrival."""
    folder, o = new_path(spark, "payments"), materialize(shop(spark, sf), "shop")
    fed(spark, materialize(deliveries(v.table(spark, sf, "events")), "deliveries"), "arrival", f"{folder}/in", lambda s: payments.start_payments(s, o, folder, facts=said))
    return folder, o


@query("stream_order_status", f"""WITH {MOVED}, named AS (SELECT order_id, arg_max(customer_id, seq) FILTER (customer_id IS NOT NULL) AS customer_id, max(seq) AS last FROM direct GROUP BY order_id)
  SELECT state.*, n.customer_id, e.error AS last_error FROM state LEFT JOIN named n USING (order_id) LEFT JOIN direct e ON e.seq = n.last""")
def _stream_status(spark, sf):
    """Order status with customer and last error through five micro-batches over the events."""
    folder, o = streamed_payments(spark, sf)
    return payments.read_orders(spark, o, folder)


@query("stream_paid_alerts", f"WITH {MOVED}, {FACTS} SELECT order_id, kind, arrival, title, message FROM alerts JOIN facts USING (order_id)")
def _stream_alerts(spark, sf):
    """Alerts with their finished messages, written by the micro-batch that first confirms the order."""
    folder, _ = streamed_payments(spark, sf, materialize(facts(spark, sf), "facts"))
    return message(payments.read_alerts(spark, folder)).select("order_id", "kind", "arrival", "title", "message")


@query("stream_on_hand", f"WITH {LEDGER} SELECT lot_id, sum(delta) AS on_hand FROM ledger GROUP BY lot_id")
def _stream_on_hand(spark, sf):
    folder = new_path(spark, "on-hand")
    rows = v.stream(spark, sf, "lineitem")
    pull.start_running_on_hand(v.ledger_rows(rows), folder).awaitTermination()
    return pull.read_on_hand(spark, folder)


def _walk(name: str, turn: str, caps: str) -> str:
    """Lines of ``turn`` (sku, order_id, quantity, created_at) decided in their order on stock ``caps`` (sku, cap): table ``name``, and ``name``_left with what is left."""
    return f"""{name}_turn AS (SELECT t.*, coalesce(cap, 0) AS cap, row_number() OVER (PARTITION BY t.sku ORDER BY created_at, order_id) AS rn FROM {turn} t LEFT JOIN {caps} USING (sku)),
  {name} AS (SELECT sku, CAST(0 AS BIGINT) AS rn, CAST(NULL AS VARCHAR) AS order_id, CAST(cap AS BIGINT) AS left_after, false AS served FROM (SELECT DISTINCT sku, cap FROM {name}_turn)
    UNION ALL SELECT t.sku, t.rn, t.order_id, CAST(CASE WHEN t.quantity <= w.left_after THEN w.left_after - t.quantity ELSE w.left_after END AS BIGINT), t.quantity <= w.left_after
    FROM {name} w JOIN {name}_turn t ON t.sku = w.sku AND t.rn = w.rn + 1),
  {name}_left AS (SELECT sku, coalesce(arg_max(left_after, rn), any_value(c.cap)) AS cap FROM {caps} c LEFT JOIN {name} USING (sku) GROUP BY sku)"""


PULL = f"""WITH RECURSIVE {LOT_STOCK}, {SHOP}, units AS (SELECT sku, l_suppkey % 2 AS wave, floor(on_hand)::BIGINT AS n FROM lot_stock WHERE on_hand >= 1),
  opening AS (SELECT sku, coalesce(sum(n) FILTER (wave = 0), 0)::BIGINT AS cap FROM (SELECT DISTINCT sku FROM lots) LEFT JOIN units USING (sku) GROUP BY sku),
  due AS (SELECT order_id, sku, quantity, status, created_at, CAST(order_id AS BIGINT) AS k FROM lines JOIN shop_orders USING (order_id)
    WHERE status IN ('paid', 'refunded') AND NOT synced AND NOT (CAST(order_id AS BIGINT) % 5 = 0 AND CAST(sku AS BIGINT) % 2 = 0)),
  at_once AS (SELECT * FROM due WHERE (status = 'paid' AND k % 7 <> 0) OR (status = 'refunded' AND k % 2 = 0)),
  {_walk('first', 'at_once', 'opening')}, by_word AS (SELECT * FROM due WHERE status = 'paid' AND k % 7 = 0), {_walk('second', 'by_word', 'first_left')},
  open AS (SELECT * FROM due WHERE status = 'paid' AND (sku, order_id) NOT IN (SELECT (sku, order_id) FROM first WHERE served UNION ALL SELECT (sku, order_id) FROM second WHERE served)),
  more AS (SELECT l.sku, l.cap + coalesce(sum(n), 0)::BIGINT AS cap FROM second_left l LEFT JOIN units u ON u.sku = l.sku AND wave = 1 GROUP BY l.sku, l.cap), {_walk('third', 'open', 'more')},
  done AS (SELECT sku, order_id FROM first WHERE served UNION ALL SELECT sku, order_id FROM second WHERE served UNION ALL SELECT sku, order_id FROM third WHERE served)
  SELECT order_id, sku, 'sold' AS outcome, quantity AS units FROM due JOIN done USING (sku, order_id)
  UNION ALL SELECT order_id, sku, 'waits', 0 FROM open WHERE (sku, order_id) NOT IN (SELECT (sku, order_id) FROM done)"""


@query("stream_order_pull", PULL)
def _stream_pull(spark, sf):
    """Lines stream in by their time on half of the stock; then some orders are paid and some refunded; then the other half of the lots arrives."""
    folder, k = new_path(spark, "pull"), F.col("order_id").cast("bigint")
    due = materialize(due_lines(spark, sf), "due")
    late = F.when((F.col("status") == "paid") & (k % 7 == 0), "pending").when((F.col("status") == "refunded") & (k % 2 == 0), "paid")
    lines = materialize(due.select("order_id", "sku", "quantity", F.coalesce(late, "status").alias("status"), "created_at", F.unix_micros("created_at").alias("t")), "lines")
    words = due.filter(late.isNotNull()).select("order_id", "status", F.lit("2030-01-01").cast("timestamp").alias("at")).distinct()
    stock = materialize(lot_stock(spark, sf).select("lot_id", "sku", F.col("on_hand").alias("units"), "expires_on", (F.split("lot_id", "-")[1].cast("bigint") % 2).alias("wave")), "stock")
    opening, later = (stock.filter(F.col("wave") == w).drop("wave") for w in (0, 1))
    recorded = v.sale_references(spark, sf).select(F.split("reference", " ").alias("r")).select(F.col("r")[1].alias("order_id"), F.col("r")[2].alias("sku")).distinct()
    for name, rows in (("words", words), ("lots", later)):
        rows.limit(0).write.parquet(f"{folder}/{name}")
    read = lambda rows, name: spark.readStream.schema(rows.schema).parquet(f"{folder}/{name}")
    start = lambda stream: pull.start_pull(stream, folder, read(later, "lots"), read(words, "words"), opening, recorded)
    fed(spark, lines, "t", f"{folder}/lines", start, 3)
    for name, rows in (("words", words), ("lots", later)):
        rows.write.mode("append").parquet(f"{folder}/{name}")
        start(read(lines, "lines")).awaitTermination()
    sales = spark.read.parquet(f"{folder}/sales").groupBy("order_id", "sku").agg(F.lit("sold").alias("outcome"), F.sum("quantity").alias("units"))
    return sales.unionByName(pull.read_waiting(spark, folder).select("order_id", "sku", F.lit("waits").alias("outcome"), F.lit(0).cast("bigint").alias("units")))
