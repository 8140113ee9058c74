"""Stock from an append-only ledger, and the movement history behind it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from stockweave.functions.columns import col, trim_number
from stockweave.functions.ordered import number_rows

# Direction of each ledger event kind; any other kind moves nothing.
EVENT_SIGN = {"received": 1, "sold": -1, "reserved": -1, "released": 1, "adjusted": 1, "damaged": -1, "expired": -1}


def delta(kind="kind", quantity="quantity") -> Column:
    """Signed movement of one ledger event."""
    plus = [k for k, s in EVENT_SIGN.items() if s > 0]
    minus = [k for k, s in EVENT_SIGN.items() if s < 0]
    qty = F.coalesce(col(quantity).cast("double"), F.lit(0.0))
    return F.when(col(kind).isin(plus), qty).when(col(kind).isin(minus), -qty).otherwise(F.lit(0.0))


def lot_on_hand(lots: DataFrame, ledger: DataFrame) -> DataFrame:
    """``lots`` with ``on_hand``; lots without events hold 0. Sums are combined before the shuffle."""
    moved = ledger.groupBy("lot_id").agg(F.sum(delta()).alias("on_hand"))
    return lots.join(moved, "lot_id", "left").withColumn("on_hand", F.coalesce("on_hand", F.lit(0.0)))


def product_on_hand(products: DataFrame, lot_stock: DataFrame) -> DataFrame:
    """``products`` with ``on_hand`` and ``n_lots``; products without lots hold 0 and totals may be negative."""
    per_product = lot_stock.groupBy("product_id").agg(F.sum("on_hand").alias("on_hand"), F.count("*").alias("n_lots"))
    return products.join(per_product, "product_id", "left").withColumns(
        {"on_hand": F.coalesce("on_hand", F.lit(0.0)), "n_lots": F.coalesce("n_lots", F.lit(0))})


def stock(products: DataFrame, lots: DataFrame, ledger: DataFrame) -> DataFrame:
    return product_on_hand(products, lot_on_hand(lots, ledger))


def movement_history(lots: DataFrame, ledger: DataFrame) -> DataFrame:
    """Every movement of every lot with its signed quantity, by lot then date, undated first.

    The order is a range sort over the full key, so one busy lot is spread over tasks.
    """
    rows = ledger.withColumn("delta", delta()).join(lots.select("lot_id", "product_id"), "lot_id")
    return rows.orderBy("lot_id", F.col("occurred_on").asc_nulls_first(), "reference", "kind", "quantity")


def stock_lines(product_stock: DataFrame, lot_stock: DataFrame) -> DataFrame:
    """Summary lines (product_id, place, stock_line): the product first, then each of its lots."""
    show = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("None"))
    head = product_stock.select("product_id", F.lit(0).cast("bigint").alias("place"), F.concat(
        F.lit("- "), "name", F.lit(" (sku "), show("sku"), F.lit(", "), show("status"), F.lit("): on_hand="), trim_number("on_hand")).alias("stock_line"))
    lots = number_rows(lot_stock, ["product_id", "lot_id"], "place").select("product_id", "place", F.concat(
        F.lit("    batch "), "lot_id", F.lit(": on_hand="), trim_number("on_hand"), F.lit(" expires="), show("expires_on"),
        F.lit(" purity="), show("purity_measured"), F.lit(" coa="), show("coa_status")).alias("stock_line"))
    return head.unionByName(lots)


def next_event_numbers(ledger: DataFrame, prefix: str = "IE-") -> DataFrame:
    """One row, next_number: one more than the largest number among ids like ``IE-0042``; 1 for an empty ledger."""
    digits = F.regexp_extract("event_id", f"^{prefix}(\\d+)", 1)
    return ledger.agg((F.coalesce(F.max(F.when(digits != "", digits.cast("bigint"))), F.lit(0)) + 1).alias("next_number"))


def next_event_number(ledger: DataFrame, prefix: str = "IE-") -> int:
    return next_event_numbers(ledger, prefix).first()["next_number"]
