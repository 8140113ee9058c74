"""Mixing sources to target weights by weighted fair queueing.

Every source gets a target number of words. Its documents are shuffled by a hash; a document's virtual finish time is
the source's words up to and with it, divided by the target, so that every source that is served at its rate passes
virtual time 1 as it reaches its target. The mix is the sequence of all sources' documents in order of finish time, cut
off where the words reach the total budget. A source that needs more words than it has is read again from its start.

Only slim columns (key, position, size) are shuffled. Running sums are cut into slices along the shuffled order, so a source
with most of the rows is spread over all tasks, and the result of the queue is one row for each source: up to which position each pass
takes its documents. The texts meet that table and are never sorted.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from stockweave.functions.ordered import Running, number_rows, running
from stockweave.functions.runtime import materialize
from stockweave.llm.common import key_of, n_words

SLICES_LOG2 = 11  # slices of a source's shuffled order
TICKS = 1 << 50  # virtual time 1


def _digits(text: Column) -> Column:
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("bigint")


def position(doc_id="doc_id", text="text", seed: str = "mix") -> Column:
    """Place of a document in its source's shuffle, 60 bits, by its id and text."""
    return _digits(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(doc_id).cast("string"), F.lit("")), F.lit(":"), F.md5(F.coalesce(F.col(text), F.lit("")))))


def apart(rows: DataFrame, seed: str = "mix") -> DataFrame:
    """``rows`` (_key, _at, ...) with a place of its own for each row: rows of a source that stand at one place are numbered, and all but the first move to
    the place of their number. Only such rows are sorted, and by the whole table's order, so any number of them is spread over tasks."""
    same = materialize(rows.groupBy("_key", "_at").agg(F.count("*").alias("_n")).filter("_n > 1").select("_key", "_at"), "same-place")
    if same.isEmpty():
        return rows
    shared = rows.join(same, ["_key", "_at"], "left_semi").withColumnRenamed("_at", "_place")
    numbered = materialize(number_rows(shared, ["_key", "_place"], "_number", start=0), "numbered-places")
    first = numbered.groupBy("_key", "_place").agg(F.min("_number").alias("_first"))
    turn = F.col("_number") - F.col("_first")
    moved = _digits(F.concat_ws(":", F.lit(seed), F.col("_place").cast("string"), turn.cast("string")))
    numbered = numbered.join(first, ["_key", "_place"]).withColumn("_at", F.when(turn > 0, moved).otherwise(F.col("_place")))
    return rows.join(same, ["_key", "_at"], "left_anti").select(rows.columns).unionByName(numbered.select(rows.columns))


def targets(sizes: DataFrame, weights: Sequence[float], budget: float, passes: int) -> DataFrame:
    """(_key, source, source_size, target) of ``sizes`` (source, source_size): sources in code point order, null last, take the weights in turn
    and share ``budget`` times all words; no target is above ``passes`` times its source's size, and what is above goes to
    the others by weight until none is."""
    ranked = number_rows(sizes, [F.col("source").asc_nulls_last()], "_rank", start=0)
    turn = F.array(*[F.lit(float(w)) for w in weights])
    ranked = materialize(ranked.select(
        key_of("source").alias("_key"), "source", "source_size",
        F.element_at(turn, (F.col("_rank") % len(weights) + 1).cast("int")).alias("_w"),
        (F.col("source_size") * passes).alias("_most")), "sources")
    total, weight = ranked.agg(F.sum("source_size"), F.sum("_w")).first()
    words = budget * (total or 0)
    level = words / weight if weight else 0.0
    while True:  # each turn stops one more source at least; one row comes to the driver
        stopped = F.col("_most") <= level * F.col("_w")
        full, free = ranked.agg(F.sum(F.when(stopped, F.col("_most"))), F.sum(F.when(~stopped, F.col("_w")))).first()
        if not free or (words - (full or 0)) / free <= level:
            break
        level = (words - (full or 0)) / free
    return ranked.withColumn("target", F.least(F.col("_most").cast("double"), level * F.col("_w"))).drop("_w", "_most")


def queue(slim: DataFrame, weights: Sequence[float] = (3, 1, 2), budget: float = 1.5, passes: int = 2) -> DataFrame:
    """Sources with what the mix takes: (_key, source, source_size, target, _upto array), where pass i takes the
    documents at positions up to ``_upto[i]`` (-1: none). ``slim`` holds source, _at (position) and size, and should be a written table."""
    goals = materialize(targets(slim.groupBy("source").agg(F.sum("size").alias("source_size")), weights, budget, passes), "targets")
    rows = slim.select(key_of("source").alias("_key"), "_at", "size").filter("size > 0")
    through = running(rows, ["_key"], "_at", F.shiftright("_at", 60 - SLICES_LOG2), [Running("_cum", "sum", F.col("size"))])
    served = (through.join(goals.select("_key", "source_size", "target"), "_key").filter("target > 0")
              .withColumn("_pass", F.explode(F.sequence(F.lit(0), F.lit(passes - 1))))
              .withColumn("_words", F.col("_pass") * F.col("source_size") + F.col("_cum"))
              .filter(F.col("_words") - F.col("size") < F.col("target"))  # a source at its target is served no more
              .select("_key", "_at", "_pass", "size", (F.col("_words") / F.col("target") * TICKS).cast("bigint").alias("_finish"), F.lit(0).alias("_all")))
    served = materialize(served, "queue")
    # up to time 1 the words are spread evenly over the slices; after it there is at most one place of each source
    timed = running(served, ["_all"], "_finish", F.least(F.shiftright("_finish", 38), F.lit(1 << 12)), [Running("_total", "sum", F.col("size"))])
    words = budget * (goals.agg(F.sum("source_size")).first()[0] or 0)
    last = timed.filter(F.col("_total") <= words).agg(F.max("_finish")).first()[0]
    taken = served.filter(F.col("_finish") <= (-1 if last is None else last)).groupBy("_key").agg(
        *[F.max(F.when(F.col("_pass") == i, F.col("_at"))).alias(f"_p{i}") for i in range(passes)])
    upto = F.array(*[F.coalesce(F.col(f"_p{i}"), F.lit(-1).cast("bigint")) for i in range(passes)])
    return materialize(goals.join(taken, "_key", "left").select("_key", "source", "source_size", "target", upto.alias("_upto")), "sources")


def copies(upto="_upto", at="_at") -> Column:
    """How often the mix takes a document."""
    return F.size(F.filter(F.col(upto), lambda p: p >= F.col(at)))


def plan(docs: DataFrame, weights: Sequence[float] = (3, 1, 2), budget: float = 1.5, passes: int = 2, seed: str = "mix") -> DataFrame:
    """What the mix takes of each row of ``docs`` (doc_id, text, source; other columns are ignored): doc_id, size (words), source_size,
    target, taken (words, repeats counted).

    A null or empty text has size 0 and takes nothing. A null source is a source of its own, null ids are ids.
    Rows of the same id and text are documents of their own, each at its own place; which of them is taken is arbitrary, how many are is not. An empty table gives no rows.
    """
    rows = docs.select("doc_id", "source", key_of("source").alias("_key"), n_words("text").alias("size"), position(seed=seed).alias("_at"))
    slim = materialize(apart(materialize(rows, "sizes"), seed), "places")
    sources = queue(slim, weights, budget, passes).drop("source")
    return slim.join(sources, "_key").select("doc_id", "size", "source_size", "target", (F.col("size") * copies()).cast("bigint").alias("taken"))


def mix(docs: DataFrame, weights: Sequence[float] = (3, 1, 2), budget: float = 1.5, passes: int = 2, seed: str = "mix") -> DataFrame:
    """The mix itself: the rows of ``docs`` that are taken, each as often as it is taken, with the same columns.

    Rows without a word have nothing to mix and are left out; null ids and sources, ties and repeated rows are as in :func:`plan`. An empty table gives no rows. The
    texts are read twice and joined with one row for each source.
    """
    rows = docs.filter(n_words("text") > 0).select(key_of("source").alias("_key"), position(seed=seed).alias("_at"), "source", n_words("text").alias("size"))
    slim = materialize(apart(materialize(rows, "sizes"), seed), "places")
    sources = queue(slim, weights, budget, passes).select("_key", "_upto")
    placed = docs.filter(n_words("text") > 0).select(F.struct("*").alias("_row"), key_of("source").alias("_key"), position(seed=seed).alias("_at"))
    return apart(placed, seed).join(sources, "_key").withColumn("_copy", F.explode(F.array_repeat(F.lit(0), copies()))).select("_row.*")
