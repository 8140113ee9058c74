"""First-expiry-first allocation of paid order lines to lots.

Within one sku the rule is sequential: a line is served whole or not at all, and a skipped line leaves the
stock for later, smaller lines. All skus are decided together in rounds of distributed running sums (see ``_decide``), so a sku
with any number of lines is spread over tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from stockweave.functions.ordered import SLICE_ROWS, Running, number_rows, running
from stockweave.functions.runtime import materialize

SLICE_UNITS = 1 << 20  # stock units of a sku whose lines and lots one task meets


def fefo_lots(lot_stock: DataFrame) -> DataFrame:
    """Lots with stock in order of expiry (undated last) within each sku.

    Adds ``fefo_rank`` and the half-open run of whole units ``[unit_from, unit_to)`` the lot covers on its sku.
    Lots at or below zero are never chosen. A part unit cannot be sold, so counts are rounded down.
    """
    stocked = lot_stock.filter(F.col("on_hand") > 0).withColumn("units", F.floor("on_hand"))
    placed = number_rows(stocked, ["sku", F.col("expires_on").asc_nulls_last(), "lot_id"], "_pos")
    summed = running(placed, ["sku"], "_pos", F.floor(F.col("_pos") / SLICE_ROWS),
                     [Running("unit_to", "sum", F.col("units")), Running("fefo_rank", "sum", F.lit(1))])
    return summed.withColumn("unit_from", F.col("unit_to") - F.col("units")).drop("_pos")


def line_ref(order_id="order_id", sku="sku"):
    return F.concat_ws(" ", F.lit("order"), order_id, sku)


def recorded_refs(references: DataFrame) -> DataFrame:
    """Every text a ledger reference answers to: itself and each prefix that ends before a space."""
    words = F.split("reference", " ")
    prefixes = F.transform(F.sequence(F.lit(1), F.size(words)), lambda n: F.array_join(F.slice(words, 1, n), " "))
    return (references.filter(F.col("reference").isNotNull())
            .select(F.explode(prefixes).alias("ref")).distinct())


def _decide(lines: DataFrame, capacity: DataFrame) -> DataFrame:
    """The sequential rule as O(log stock) rounds over all skus at once.

    With r units left, a line above r can never be served, and at most one line above r/2 can be served before
    the rest falls below r/2. Every line of at most r/2 is served until then. So each round finds, by one
    running sum of the small lines, the first row where either a large line fits or the small ones have taken
    more than half; everything up to that row is decided and r at least halves.
    """
    open_ = number_rows(lines, ["sku", "created_at", "order_id", "quantity"], "_pos")
    left = materialize(capacity.select("sku", F.col("capacity").alias("r"), "capacity"), "stock-left")
    decided = None
    while True:
        live = open_.join(left, "sku").withColumn("small", F.col("quantity") * 2 <= F.col("r"))
        live = live.withColumn("fits", F.col("quantity") <= F.col("r"))
        lost = live.filter(~F.col("fits")).withColumn("unit_start", F.lit(-1).cast("bigint"))
        small = F.when(F.col("small"), F.greatest("quantity", F.lit(0))).otherwise(0)
        run = running(live.filter("fits"), ["sku"], "_pos", F.floor(F.col("_pos") / SLICE_ROWS),
                      [Running("taken", "sum", small)])
        before = F.col("taken") - small
        stops = ((~F.col("small") & (F.col("quantity") <= F.col("r") - before))
                 | (F.col("small") & (F.col("taken") * 2 > F.col("r"))))
        run = materialize(run.withColumn("before", before).withColumn("stops", stops), "allocation-round")
        ends = run.groupBy("sku").agg(F.min(F.when(F.col("stops"), F.col("_pos"))).alias("_end"))
        marked = run.join(ends, "sku")
        done = F.col("_end").isNull() | (F.col("_pos") <= F.col("_end"))
        served = F.col("small") | (F.col("_pos") == F.col("_end"))
        now = marked.filter(done).withColumn(
            "unit_start", F.when(served, F.col("capacity") - F.col("r") + F.col("before")).otherwise(F.lit(-1)))
        keep = [*lines.columns, "unit_start"]
        part = now.select(keep).unionByName(lost.select(keep))
        decided = part if decided is None else decided.unionByName(part)
        used = (now.filter(F.col("unit_start") >= 0).groupBy("sku")
                .agg(F.sum(F.greatest("quantity", F.lit(0))).alias("_used")))
        left = materialize(left.join(used, "sku", "left").select(
            "sku", (F.col("r") - F.coalesce("_used", F.lit(0))).alias("r"), "capacity"), "stock-left")
        open_ = materialize(marked.filter(~done).select(*lines.columns, "_pos"), "allocation-open")
        if open_.isEmpty():
            return decided


def decide_lines(lines: DataFrame, lots: DataFrame, references: DataFrame) -> DataFrame:
    """Outcome of every line: ``refunded``, ``recorded`` (already in the ledger), ``sold``, ``waits``, or ``unknown`` (its status is null).

    ``lines`` has order_id, sku, quantity, status, created_at; ``lots`` comes from :func:`fefo_lots`;
    ``references`` holds the ledger's references. ``unit_start`` places a sold line on its sku's stock.
    """
    base = ["order_id", "sku", "quantity", "status", "created_at"]
    lines = lines.select(*base[:2], F.col("quantity").cast("bigint").alias("quantity"), *base[3:])
    tagged = lines.withColumn("ref", line_ref())
    unknown = tagged.filter("status is null")
    refunded = tagged.filter(F.col("status") == "refunded")
    paid = tagged.filter(F.col("status") != "refunded")
    recorded = recorded_refs(references)
    seen = paid.join(recorded, "ref", "left_semi")
    fresh = materialize(paid.join(recorded, "ref", "left_anti").select(base), "fresh-lines")

    capacity = lots.groupBy("sku").agg(F.max("unit_to").alias("capacity"))
    with_stock = lambda rows: rows.join(capacity, "sku", "left").withColumn(
        "capacity", F.coalesce("capacity", F.lit(0)).cast("bigint"))
    rows = fresh.withColumn("created_at", F.col("created_at").cast("timestamp"))
    decided = _decide(rows, with_stock(fresh.select("sku").distinct()))
    outcome = F.when(F.col("unit_start") >= 0, "sold").otherwise("waits")
    none = F.lit(None).cast("bigint")
    plain = lambda rows, word: rows.select(
        *base[:4], F.col("created_at").cast("timestamp").alias("created_at"), none.alias("unit_start"),
        F.lit(word).alias("outcome"))
    return (decided.withColumn("outcome", outcome)
            .withColumn("unit_start", F.when(F.col("unit_start") >= 0, F.col("unit_start")))
            .unionByName(plain(refunded, "refunded")).unionByName(plain(seen, "recorded")).unionByName(plain(unknown, "unknown")))


def sale_parts(decisions: DataFrame, lots: DataFrame) -> DataFrame:
    """Split each sold line over the lots its units fall on: one row per (line, lot).

    Lines and lots are both gapless runs of units on one axis per sku. Every part begins where a line or a lot begins, in the last line and the last
    lot that began by then; one running pass over those points finds both. The work follows the lines and lots, not the units.
    Stock beyond what is sold is left out first.
    """
    sold = (decisions.filter((F.col("outcome") == "sold") & (F.col("quantity") > 0))
            .withColumn("unit_end", F.col("unit_start") + F.col("quantity")))
    demand = sold.groupBy("sku").agg(F.max("unit_end").alias("_sold"))
    stocked = (lots.select("sku", "lot_id", "fefo_rank", "unit_from", "unit_to").join(demand, "sku")
               .withColumn("unit_to", F.least("unit_to", "_sold")).filter("unit_to > unit_from").drop("_sold"))
    line = F.struct("order_id", "created_at", "unit_start", "unit_end").alias("line")
    lot = F.struct("lot_id", "fefo_rank", "unit_from", "unit_to").alias("lot")
    points = sold.select("sku", F.col("unit_start").cast("bigint").alias("_at"), line).unionByName(
        stocked.select("sku", F.col("unit_from").cast("bigint").alias("_at"), lot), allowMissingColumns=True)
    points = materialize(points, "unit-points")
    met = running(points, ["sku"], "_at", F.floor(F.col("_at") / SLICE_UNITS), [Running("on", "last", F.col("line")), Running("of", "last", F.col("lot"))])
    met = met.select("sku", "_at", "on.*", "of.*").filter("order_id IS NOT NULL AND lot_id IS NOT NULL").dropDuplicates(["sku", "_at"])
    end = F.least("unit_end", "unit_to")
    return (met.filter(end > F.col("_at"))
            .select("order_id", "sku", "lot_id", "fefo_rank", "created_at", (end - F.col("_at")).alias("taken"),
                    F.when(F.col("_at") == F.col("unit_start"), line_ref())
                    .otherwise(F.concat(line_ref(), F.lit(" lot "), "lot_id")).alias("reference")))


def sale_events(parts: DataFrame, start: int = 1, prefix: str = "IE-") -> DataFrame:
    """Ledger rows for the parts, numbered in line order from ``start``."""
    numbered = number_rows(parts, ["created_at", "order_id", "sku", "fefo_rank"], "n", start)
    return numbered.select(F.format_string(f"{prefix}%04d", "n").alias("event_id"), "lot_id", F.lit("sold").alias("kind"),
                           F.col("taken").cast("double").alias("quantity"),
                           F.to_date("created_at").alias("occurred_on"), "reference")


def order_outcomes(decisions: DataFrame) -> DataFrame:
    """Per order: ``blocked`` if any line waits or has no status, else ``recorded`` if any line is on the ledger, else ``refunded``."""
    any_of = lambda *words: F.bool_or(F.col("outcome").isin(*words))
    flags = decisions.groupBy("order_id").agg(any_of("waits", "unknown").alias("w"), any_of("sold", "recorded").alias("s"))
    return flags.select("order_id", F.when(F.col("w"), "blocked").when(F.col("s"), "recorded")
                        .otherwise("refunded").alias("outcome"))


def orders_to_mark(lines: DataFrame, references: DataFrame) -> DataFrame:
    """Orders safe to mark as synced, judged from the committed ledger alone.

    All lines paid and on the ledger, or all refunded and none on it. Orders refunded after a recorded sale
    are in neither class; see :func:`refunded_after_sale`.
    """
    f = _line_flags(lines, references)
    return f.filter((F.col("all_paid") & F.col("all_on")) | (F.col("all_refunded") & ~F.col("any_on"))).select("order_id")


def refunded_after_sale(lines: DataFrame, references: DataFrame) -> DataFrame:
    """Orders with a refunded line whose order already has a sale on the ledger (no counter-event exists)."""
    f = _line_flags(lines, references)
    return f.filter(F.col("any_refunded") & F.col("any_on")).select("order_id")


def _line_flags(lines: DataFrame, references: DataFrame) -> DataFrame:
    on = recorded_refs(references).withColumn("on_ledger", F.lit(True))
    joined = lines.withColumn("ref", line_ref()).join(on, "ref", "left")
    hit = F.coalesce("on_ledger", F.lit(False))
    paid, refunded = (F.coalesce(F.col("status") == word, F.lit(False)) for word in ("paid", "refunded"))
    return joined.groupBy("order_id").agg(
        F.bool_and(paid).alias("all_paid"), F.bool_and(refunded).alias("all_refunded"),
        F.bool_or(refunded).alias("any_refunded"), F.bool_and(hit).alias("all_on"), F.bool_or(hit).alias("any_on"))
