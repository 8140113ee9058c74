"""Availability, cart quotes and pick-up needs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from stockweave.functions.columns import cents, trim_number

# Statuses that hold stock, the units one just-in-time kit brings, the largest cart line.
HOLDING = ("pending", "requires_action", "paid")
KIT_UNITS = 10
MAX_LINE = 20


def read_paid_lines(orders: DataFrame, lines: DataFrame) -> DataFrame:
    """Lines of paid or refunded orders not yet on the ledger, in time order."""
    waiting = orders.filter(F.col("status").isin("paid", "refunded") & F.col("ledger_synced_at").isNull())
    return (waiting.select("order_id", "created_at", "status").join(lines.select("order_id", "sku", "quantity"), "order_id")
            .orderBy("created_at", "order_id", "sku"))


def sold_since(orders: DataFrame, lines: DataFrame, since) -> DataFrame:
    """Units per sku the stock figures of time ``since`` do not reflect yet."""
    newer = F.col("created_at") >= since
    unsynced = (F.col("status") == "paid") & F.col("ledger_synced_at").isNull()
    open_ = orders.filter(F.col("status").isin(*HOLDING) & (newer | unsynced)).select("order_id")
    return lines.join(open_, "order_id").groupBy("sku").agg(F.sum("quantity").cast("bigint").alias("sold"))


def just_in_time() -> Column:
    return F.col("fulfilment").eqNullSafe(F.lit("just_in_time"))


def available_to_promise(products: DataFrame, sold: DataFrame) -> DataFrame:
    """``available`` per product: on hand (at least one kit when just in time) less the units sold since."""
    base = F.when(just_in_time(), F.greatest("on_hand", F.lit(float(KIT_UNITS)))).otherwise(F.col("on_hand"))
    return (products.join(sold, "sku", "left").withColumn("sold", F.coalesce("sold", F.lit(0)))
            .withColumn("available", base - F.col("sold")))


def in_stock() -> Column:
    return (F.col("status") == "active") & ((F.col("on_hand") > 0) | just_in_time())


def quote_carts(cart_lines: DataFrame, available: DataFrame) -> DataFrame:
    """One row per cart: its subtotal from catalogue prices, or the first line that fails and why.

    ``cart_lines`` has cart_id, line_no, sku, quantity; ``available`` comes from :func:`available_to_promise`.
    """
    p = available.select("sku", F.col("name").alias("product_name"), "price_usd", "status", "on_hand", "fulfilment", "available")
    j = cart_lines.join(p, "sku", "left")
    qty = F.col("quantity")
    whole = qty == F.floor(qty)
    bad = F.col("product_name").isNull() | qty.isNull() | ~whole | (qty < 1) | (qty > MAX_LINE)
    rule = F.when(bad, "invalid").when(~in_stock(), "unavailable").when(F.col("available") < qty, "short")
    said = (F.when(F.col("rule") == "invalid", F.lit("A cart line is invalid."))
            .when(F.col("rule") == "unavailable", F.concat("product_name", F.lit(" is not available.")))
            .when(F.col("rule") == "short", F.concat(F.lit("Only "), trim_number(F.greatest("available", F.lit(0.0))),
                                                     F.lit(" of "), F.col("product_name"), F.lit(" remain."))))
    j = j.withColumn("rule", rule)
    j = j.withColumn("fault", F.when(F.col("rule").isNotNull(), F.struct("line_no", "sku", "rule", said.alias("message"))))
    g = j.groupBy("cart_id").agg(F.min("fault").alias("fault"),
                                 F.sum((cents("price_usd") * qty).cast("bigint")).alias("subtotal_cents"))
    return g.select("cart_id", F.coalesce("fault.rule", F.lit("ok")).alias("outcome"), F.col("fault.sku").alias("failed_sku"),
                    F.col("fault.message").alias("message"),
                    F.when(F.col("fault").isNull(), F.col("subtotal_cents")).alias("subtotal_cents"))


def pickup_lines(order_lines: DataFrame, products: DataFrame, sold: DataFrame) -> DataFrame:
    """Order lines with ``shortfall`` and ``pickup``: only just-in-time skus can be short."""
    p = (products.select("sku", "fulfilment", "on_hand").join(sold, "sku", "left"))
    gap = F.greatest(F.coalesce("sold", F.lit(0)) - F.coalesce("on_hand", F.lit(0.0)), F.lit(0.0))
    j = order_lines.join(p, "sku", "left").withColumn("shortfall", F.when(just_in_time(), gap).otherwise(F.lit(0.0)))
    return j.withColumn("pickup", F.col("shortfall") > 0).drop("fulfilment", "on_hand", "sold")
