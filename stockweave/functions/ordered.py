"""Ordered computations that stay parallel when one group holds most of the rows.

A plain window sends a whole group through one task. Here a group is cut into slices along its order; the
window runs inside (group, slice) and one summary row per slice carries what came before it. Only the
summaries meet in one place, so a group of any size is spread over many tasks.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from stockweave.functions.runtime import materialize

SLICE_ROWS = 1_000_000  # rows of one group that one task may order


@dataclass(frozen=True)
class Running:
    """One running measure: ``kind`` is sum, max, first or last (non-null); ``through`` takes in rows of equal order."""

    out: str
    kind: str
    value: Column
    through: bool = True


_OVER = {"sum": F.sum, "max": F.max, "first": lambda c: F.first(c, ignorenulls=True), "last": lambda c: F.last(c, ignorenulls=True)}


def running(df: DataFrame, keys: list[str], order: str, slice_by: Column, measures: list[Running]) -> DataFrame:
    """Add running measures along ``order`` (one integral column) inside ``keys`` (never null).

    ``slice_by`` must not decrease as ``order`` grows. The rows are shuffled once, by (keys, slice).
    """
    named = [f"_v{i}" for i in range(len(measures))]
    cut = df.withColumns({"_slice": slice_by, **{v: m.value for v, m in zip(named, measures)}})

    totals = []
    for v, m in zip(named, measures):
        if m.kind in ("first", "last"):
            edge = F.min_by if m.kind == "first" else F.max_by
            totals.append(edge(v, F.when(F.col(v).isNotNull(), F.col(order))).alias(f"_t{v}"))
        else:
            totals.append(_OVER[m.kind](F.col(v)).alias(f"_t{v}"))
    before = W.partitionBy(*keys).orderBy("_slice").rowsBetween(W.unboundedPreceding, -1)
    carry = cut.groupBy(*keys, "_slice").agg(*totals).select(
        *keys, "_slice", *[_OVER[m.kind](F.col(f"_t{v}")).over(before).alias(f"_c{v}") for v, m in zip(named, measures)])

    inside = W.partitionBy(*keys, "_slice").orderBy(order)
    seen = {True: inside.rangeBetween(W.unboundedPreceding, W.currentRow),
            False: inside.rangeBetween(W.unboundedPreceding, -1)}
    out = cut.withColumns({m.out: _OVER[m.kind](F.col(v)).over(seen[m.through]) for v, m in zip(named, measures)})
    out = out.join(carry, [*keys, "_slice"], "left")
    joined = {}
    for v, m in zip(named, measures):
        here, prior = F.col(m.out), F.col(f"_c{v}")
        if m.kind == "sum":
            joined[m.out] = F.coalesce(here, F.lit(0)) + F.coalesce(prior, F.lit(0))
        elif m.kind == "max":
            joined[m.out] = F.greatest(here, prior)
        elif m.kind == "first":
            joined[m.out] = F.coalesce(prior, here)
        else:
            joined[m.out] = F.coalesce(here, prior)
    return out.withColumns(joined).drop("_slice", *named, *[f"_c{v}" for v in named])


def number_rows(df: DataFrame, order: list, out: str, start: int = 1) -> DataFrame:
    """Consecutive numbers over the whole table in ``order``, with no single-task sort.

    A range sort spreads the rows, each task numbers its own, and the per-task counts (one row per task) give
    the offsets. The sorted rows are written once so the numbers cannot change on a retry.
    """
    tagged = materialize(df.orderBy(*order).withColumn("_m", F.monotonically_increasing_id()), "numbered")
    tagged = tagged.withColumn("_task", F.shiftright("_m", 33)).withColumn("_at", F.col("_m").bitwiseAND((1 << 33) - 1))
    counts = tagged.groupBy("_task").agg((F.max("_at") + 1).alias("_n"))
    first = W.orderBy("_task").rowsBetween(W.unboundedPreceding, -1)
    offsets = counts.select("_task", F.coalesce(F.sum("_n").over(first), F.lit(0)).alias("_base"))
    return (tagged.join(F.broadcast(offsets), "_task")
            .withColumn(out, F.col("_base") + F.col("_at") + start)
            .drop("_task", "_at", "_m", "_base"))
