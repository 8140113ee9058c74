"""Member levels from rolling twelve-month spend: history, status, prices, progress, tier-ups.

A year is 365 fixed days. Times are compared in microseconds since the epoch.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from stockweave.functions.columns import col, micros
from stockweave.functions.ordered import Running, running
from stockweave.functions.runtime import materialize

DAY = 86_400_000_000
YEAR = 365 * DAY
SLICE = DAY  # one task orders at most a customer's rows of one such stretch


@dataclass(frozen=True)
class Level:
    name: str
    min_usd: float
    discount_pct: float = 0.0
    free_shipping: bool = False

    @property
    def min_cents(self) -> int:
        return int(self.min_usd * 100 + 0.5)


def paid_history(orders: DataFrame) -> DataFrame:
    """Paid orders as (customer, order_id, at, cents): product total after discount, e-mail folded."""
    return orders.filter(F.col("status") == "paid").select(
        F.lower(F.trim("email")).alias("customer"), "order_id", F.col("created_at").alias("at"),
        (F.col("subtotal_cents") - F.coalesce("discount_cents", F.lit(0))).alias("cents"))


def level_for_spend(levels: list[Level], cents) -> Column:
    """Index of the last level whose threshold the spend reaches; 0 below all of them."""
    reached = [F.when(col(cents) >= lv.min_cents, F.lit(i)) for i, lv in enumerate(levels)]
    return F.greatest(F.lit(0), *reached)


def _pick(levels: list[Level], index, attr: str) -> Column:
    return F.get(F.array(*[F.lit(getattr(lv, attr)) for lv in levels]), col(index))


def earned_levels(orders: DataFrame, levels: list[Level]) -> DataFrame:
    """Per order: spend in (t - 1 year, t], rows of equal time included, and the level it earns.

    Each order adds its cents at t and takes them back at t + 1 year, so the rolling spend is a plain running
    sum. That is linear in the rows (a sliding frame re-reads a year of rows for each row) and is cut into
    slices of time, so a customer with a large share of all orders is spread over tasks.
    """
    timed = orders.withColumn("t", micros("at")).filter(F.col("t").isNotNull())
    stays = timed.select(timed.columns + [F.lit(True).alias("own")])
    leaves = timed.select("customer", (F.col("t") + YEAR).alias("t"), (-F.col("cents")).alias("cents"), F.lit(False).alias("own"))
    flow = stays.unionByName(leaves, allowMissingColumns=True)
    rolled = running(flow, ["customer"], "t", F.floor(F.col("t") / SLICE), [Running("rolling_cents", "sum", F.col("cents"))])
    return rolled.filter("own").drop("own").withColumn("level", level_for_spend(levels, "rolling_cents"))


def _year(c) -> Column:
    return F.date_format(F.timestamp_micros(c), "yyyy-MM-dd")


def status_at(earned: DataFrame, levels: list[Level], as_of) -> DataFrame:
    """Member status of every customer with history, at ``as_of`` (a timestamp column or literal).

    Held: best level earned in (n - 1y, n]. Otherwise one level below the best of the year before that. The hold
    ends at the latest order that still supports the level. One grouped aggregation, combined before the shuffle.
    """
    n = micros(as_of)
    held = (F.col("t") > n - YEAR) & (F.col("t") <= n)
    prior = (F.col("t") > n - 2 * YEAR) & (F.col("t") <= n - YEAR)
    until = []
    for i in range(1, len(levels)):
        until.append(F.max(F.when(held & (F.col("level") >= i), F.col("t") + YEAR)).alias(f"_held{i}"))
        until.append(F.max(F.when(prior & (F.col("level") >= i + 1), F.col("t") + 2 * YEAR)).alias(f"_soft{i}"))
    g = earned.groupBy("customer").agg(
        F.max(F.when(held, F.col("level"))).alias("held"), F.max(F.when(prior, F.col("level"))).alias("prior"),
        F.coalesce(F.sum(F.when(held, F.col("cents"))), F.lit(0)).alias("spend12"), *until)
    soft = F.greatest(F.coalesce("prior", F.lit(0)) - 1, F.lit(0))
    g = g.withColumn("soft", soft).withColumn("level", F.greatest(F.coalesce("held", F.lit(0)), F.col("soft")))
    holds = F.lit(None).cast("bigint")
    for i in range(1, len(levels)):
        own = F.greatest(f"_held{i}", F.when(F.col("soft") == i, F.col(f"_soft{i}")))
        holds = F.when(F.col("level") == i, own).otherwise(holds)
    top = len(levels) - 1
    nxt = F.when(F.col("level") < top, F.col("level") + 1)
    return g.select(
        "customer", "level", _pick(levels, "level", "name").alias("level_name"), "spend12",
        _year(holds).alias("holds_until"),
        F.when(nxt.isNotNull(), _pick(levels, nxt, "name")).alias("next_name"),
        F.when(nxt.isNotNull(), F.greatest(_pick(levels, nxt, "min_cents") - F.col("spend12"), F.lit(0))).alias("to_go"))


def base_status(customers: DataFrame, status: DataFrame, levels: list[Level]) -> DataFrame:
    """Status for every listed customer; those without paid history sit at the base level."""
    j = customers.select("customer").join(status, "customer", "left")
    nxt = levels[1] if len(levels) > 1 else None
    fill = {"level": F.lit(0), "level_name": F.lit(levels[0].name), "spend12": F.lit(0).cast("bigint")}
    missing = F.col("level").isNull()
    out = {c: F.coalesce(c, v) for c, v in fill.items()}
    if nxt:
        out["next_name"] = F.when(missing, F.lit(nxt.name)).otherwise(F.col("next_name"))
        out["to_go"] = F.when(missing, F.lit(nxt.min_cents)).otherwise(F.col("to_go"))
    return j.withColumns(out)


def shipping_cents(net, free_over: int = 15_000, flat: int = 2_495) -> Column:
    """Store rule: free at or above ``free_over`` cents net, else the flat rate."""
    return F.when(col(net) >= free_over, F.lit(0)).otherwise(F.lit(flat))


def member_price(df: DataFrame, levels: list[Level], level="level", subtotal="subtotal_cents") -> DataFrame:
    """Discount (halves up), net, shipping on the net, total."""
    pct = _pick(levels, level, "discount_pct")
    free = _pick(levels, level, "free_shipping")
    df = df.withColumn("discount_cents", F.floor(col(subtotal) * pct / 100 + 0.5).cast("bigint"))
    df = df.withColumn("net_cents", col(subtotal) - F.col("discount_cents"))
    df = df.withColumn("shipping_cents", F.when(free, F.lit(0)).otherwise(shipping_cents("net_cents")))
    return df.withColumn("total_cents", F.col("net_cents") + F.col("shipping_cents"))


def progress(status: DataFrame, levels: list[Level], cart_net="cart_net") -> DataFrame:
    """Progress class (``top``, ``lifts``, ``near``, ``far``) and the sentence shown for it."""
    dollars = lambda c: F.concat(F.lit("$"), F.format_number(F.ceil(c / 100), 0))
    through = F.date_format(F.to_date("holds_until"), "MMMM yyyy")
    nxt = F.col("level") + 1
    need, pct = _pick(levels, nxt, "min_cents"), _pick(levels, nxt, "discount_pct")
    ships = F.when(_pick(levels, nxt, "free_shipping"), " and free shipping on every order").otherwise("")
    perk = F.concat(F.regexp_replace(pct.cast("string"), "\\.0$", ""), F.lit("% off"), ships)
    have = F.when((F.col("level") > 0) & F.col("holds_until").isNotNull(),
                  F.concat("level_name", F.lit(" status through "), through, F.lit(". "))).otherwise("")
    kind = (F.when(F.col("next_name").isNull(), "top").when(col(cart_net) >= F.col("to_go"), "lifts")
            .when(F.col("to_go") <= need * 0.25, "near").otherwise("far"))
    top = F.concat(F.col("level_name"), F.lit(" status"),
                   F.coalesce(F.concat(F.lit(" through "), through), F.lit("")), F.lit("."))
    text = (F.when(F.col("progress") == "top", top)
            .when(F.col("progress") == "lifts", F.concat(have, F.lit("This order takes you to "), "next_name", F.lit(".")))
            .when(F.col("progress") == "near",
                  F.concat(have, dollars(F.col("to_go")), F.lit(" from "), "next_name", F.lit(": "), perk, F.lit(".")))
            .otherwise(F.concat(have, F.col("next_name"), F.lit(" status at "), dollars(need),
                                F.lit(" in 12 months. You're at "), dollars(F.col("spend12")), F.lit("."))))
    return status.withColumn("progress", kind).withColumn("progress_text", text)


def tier_ups(earned: DataFrame, levels: list[Level], after: DataFrame | None = None) -> DataFrame:
    """Per order: level before it (the order left out, at its own time), level after it, and whether it rose.

    ``after`` is a status table for one as-of time; without it the level after is taken at the order's time.
    A level stands at time n if it was earned within the last year, or one above it within the year before;
    so the last time each level was earned, and the last time seen a year ago, are enough. Both are running
    maxima over the orders and over the orders moved on by a year, cut into slices of time.
    """
    top = len(levels) - 1
    earned = materialize(earned.select("customer", "order_id", "t", "cents", "rolling_cents", "level"), "earned")  # read four times below
    own = earned.select("customer", "order_id", "t", "cents", "rolling_cents", "level", F.lit(0).alias("age"))
    aged = earned.select("customer", (F.col("t") + YEAR).alias("t"), "level", F.lit(1).alias("age"))
    flow = own.unionByName(aged, allowMissingColumns=True)
    measures = [Running("_n_through", "sum", F.when(F.col("age") == 0, 1).otherwise(0)),
                Running("_n_before", "sum", F.when(F.col("age") == 0, 1).otherwise(0), through=False)]
    for i in range(1, top + 1):
        at = lambda age: F.when((F.col("age") == age) & (F.col("level") >= i), F.col("t"))
        measures += [Running(f"_at{i}", "max", at(0)), Running(f"_before{i}", "max", at(0), through=False),
                     Running(f"_aged{i}", "max", at(1))]
    rows = running(flow, ["customer"], "t", F.floor(F.col("t") / SLICE), measures).filter(F.col("age") == 0)

    def level_from(seen: str) -> list[Column]:
        out = []
        for i in range(1, top + 1):
            out.append(F.when(F.col(f"{seen}{i}") > F.col("t") - YEAR, F.lit(i)))
            out.append(F.when(F.col(f"_aged{i}") > F.col("t") - YEAR, F.lit(i - 1)))
        return out

    tied = F.col("_n_through") - F.col("_n_before") > 1
    tie_level = F.when(tied, level_for_spend(levels, F.col("rolling_cents") - F.col("cents")))
    rows = rows.withColumn("level_before", F.greatest(F.lit(0), tie_level, *level_from("_before")))
    if after is None:
        rows = rows.withColumn("level_after", F.greatest(F.lit(0), *level_from("_at")))
    else:
        rows = rows.join(after.select("customer", F.col("level").alias("level_after")), "customer")
    return rows.select("customer", "order_id", "level_before", "level_after",
                       (F.col("level_after") > F.col("level_before")).alias("tier_up"))
