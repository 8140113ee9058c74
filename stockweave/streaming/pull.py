"""Incremental pull of paid orders into the ledger, and running stock over a ledger stream.

The pull is one query with two keyed states. Of an order: its lines and its status in one element, so that a line that waits for its payment is sold when the payment comes, and
a refund takes back what still waits. Of a sku: the lots with what is left of them, the lines that wait for a lot, and the orders already served. A batch reads
the buckets (:func:`state.bucket`) of its own rows; waiting lines are looked at when a lot of their sku arrives, since no line that waits fits before that.
"""

from __future__ import annotations

import datetime as dt
import heapq
import json

from pyspark.sql import DataFrame, Row, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor

from stockweave.functions.ordered import number_rows
from stockweave.functions.runtime import materialize
from stockweave.operators import allocate, ledger as lg
from stockweave.streaming import state

LEDGER = ["event_id", "lot_id", "kind", "quantity", "occurred_on", "reference"]
STOCK_ROW = "kind string, sku string, order_id string, quantity bigint, created bigint, lot_id string, expires_on date"
SALE_ROW = "order_id string, sku string, lot_id string, part int, quantity bigint, created bigint, reference string"
LOTS = "array<struct<sku:string,lot_id:string,units:bigint,expires_day:int>>"
PAIRS = "array<struct<sku:string,order_id:string>>"
STOCKED = Row("kind", "sku", "order_id", "quantity", "created", "lot_id", "expires_on")
SALE = Row("order_id", "sku", "lot_id", "part", "quantity", "created", "reference")


def _apart(rows, name: str, key) -> dict:
    """The rows of a bucket by their ``name``; rows that don't carry it are those of the key itself."""
    rows, out = list(rows), {}
    named = bool(rows) and name in rows[0]
    for r in rows:
        out.setdefault(r[name] if named else key[0], []).append(r)
    return out


class OrderLines(StatefulProcessor):
    """By bucket of orders: an order's status by the latest word, and its lines, one element of a list that a batch reads and writes once. Lines go to their sku while
    the order is paid, and are called back when it no longer is. Lines are kept as JSON text, [[sku, quantity, created], ...].

    A line brings the status it was written with; a row without a sku is a later word about the order. Among rows of equal ``at`` words come after lines."""

    def init(self, handle) -> None:
        self.order = handle.getListState("order", "order_id string, status string, at bigint, lines string")

    def handleInputRows(self, key, rows, timer):
        held, changed, new = {x[0]: tuple(x) for x in self.order.get()}, False, []
        for order, told_now in _apart(rows, "order_id", key).items():
            known = held.get(order)
            _, status, at, lines = known or (order, None, None, "[]")
            kept = [tuple(x) for x in json.loads(lines)]
            skus, was, before, fresh = {x[0] for x in kept}, status, at, []
            for r in sorted(told_now, key=lambda r: (r.at, r.sku is None)):
                if r.sku is not None and r.sku not in skus:
                    skus.add(r.sku)
                    fresh.append((r.sku, r.quantity, r.created))
                if r.status is not None and (at is None or r.at >= at):
                    status, at = r.status, r.at
            if known is None:
                new.append((order, status, at, json.dumps(fresh)))
            elif fresh or (status, at) != (was, before):
                held[order], changed = (order, status, at, json.dumps(kept + fresh)), True
            if status == "paid":
                told = fresh if was == "paid" else kept + fresh
            else:  # lines of this batch were never told
                told = kept if was == "paid" else []
            kind = "line" if status == "paid" else "cancel"
            for sku, quantity, created in told:
                yield STOCKED(kind, sku, order, quantity, created, None, None)
        if changed:
            self.order.put([*held.values(), *new])
        elif new:
            self.order.appendList(new)

    def close(self) -> None:
        pass


class SkuStock(StatefulProcessor):
    """By bucket of skus: first-expiry-first sale of whole lines of each sku, in order of (created_at, order) among the lines that can be decided in a batch.

    A line is served whole or waits, and a waiting line takes nothing from later, smaller ones. A line that was sold is never sold again, and a cancelled one that was
    sold stays so: ``sold`` holds the lines recorded before the stream and, since a line comes again only after it was cancelled, those cancelled after their sale.
    Lots that arrive are appended, one element for a sku with its lots as JSON text, [[lot, units, day], ...]; the lots are read, and written back, only in a batch that
    has lines to decide and that sells."""

    def init(self, handle) -> None:
        self.lots = handle.getListState("lots", "sku string, lots string")
        self.waiting = handle.getListState("waiting", "sku string, order_id string, quantity bigint, created bigint")
        self.sold = handle.getListState("sold", "sku string, order_id string")

    def handleInitialState(self, key, known, timer) -> None:
        if known.sold:
            self.sold.appendList([(x["sku"], x["order_id"]) for x in known.sold])
        by_sku = {}
        for x in known.lots or ():
            by_sku.setdefault(x["sku"], []).append((x["lot_id"], x["units"], x["expires_day"]))
        if by_sku:
            self.lots.appendList([(sku, json.dumps(lots)) for sku, lots in by_sku.items()])

    def _waits(self) -> dict:
        waits = {}
        for sku, order, quantity, created in self.waiting.get():
            waits.setdefault(sku, {})[order] = (quantity, created)
        return waits

    def handleInputRows(self, key, rows, timer):
        lines, cancelled, received = {}, {}, {}
        for sku, told in _apart(rows, "sku", key).items():
            for r in told:
                if r.kind == "lot":
                    if r.quantity and r.quantity > 0:
                        received.setdefault(sku, []).append((r.lot_id, r.quantity, r.expires_on.toordinal() if r.expires_on else None))
                elif r.kind == "cancel":
                    cancelled.setdefault(sku, set()).add(r.order_id)
                else:
                    lines.setdefault(sku, {})[r.order_id] = (r.quantity, r.created)
        waits = self._waits() if received or cancelled else None  # None: not read
        taken_back = False
        sold = set(self.sold.get()) if lines else set()
        marks = []
        for sku, orders in cancelled.items():
            for order in orders:
                if waits.get(sku, {}).pop(order, None) is not None:
                    taken_back = True
                elif (sku, order) not in sold:
                    marks.append((sku, order))
        if marks:
            self.sold.appendList(marks)
            sold.update(marks)
        open_ = {sku: left for sku, orders in lines.items() if (left := {o: v for o, v in orders.items() if (sku, o) not in sold})}
        for sku in received:
            if waits.get(sku):
                open_[sku] = {**open_.get(sku, {}), **waits[sku]}
        held, sells, later = {}, False, []
        if open_:
            for sku, text in self.lots.get():
                held.setdefault(sku, []).append(text)
        for sku, orders in open_.items():
            lots = {}
            for lot, n, day in [*(x for text in held.get(sku, ()) for x in json.loads(text)), *received.get(sku, ())]:  # a lot that comes again adds its units, and its last date holds
                lots[lot] = (n + lots[lot][0] if lot in lots else n, day)
            left, was_waiting = sum(n for n, _ in lots.values()), (waits or {}).get(sku, {})
            lots, sells_here = [(day is None, day or 0, lot, n) for lot, (n, day) in lots.items()], False
            heapq.heapify(lots)
            for order, (quantity, created) in sorted(orders.items(), key=lambda x: (x[1][1] is not None, x[1][1] or 0, x[0])):
                if quantity is None or quantity > left:
                    if order not in was_waiting:
                        later.append((sku, order, quantity, created))
                    continue
                need, part = quantity, 0
                while need > 0:
                    missing, day, lot, n = heapq.heappop(lots)
                    take = min(need, n)
                    reference = f"order {order} {sku}" + (f" lot {lot}" if part else "")
                    yield SALE(order, sku, lot, part, take, created, reference)
                    need, part, sells_here = need - take, part + 1, True
                    if take < n:
                        heapq.heappush(lots, (missing, day, lot, n - take))
                left -= max(quantity, 0)
                if was_waiting.pop(order, None) is not None:
                    taken_back = True
            if sells_here:
                sells = True
                received.pop(sku, None)
                held[sku] = [json.dumps([(lot, n, None if missing else day) for missing, day, lot, n in lots])] if lots else []
        arrived = [(sku, json.dumps(lots)) for sku, lots in received.items()]
        if sells:
            self._write(self.lots, [(sku, text) for sku, texts in held.items() for text in texts] + arrived)
        elif arrived:
            self.lots.appendList(arrived)
        if taken_back:
            self._write(self.waiting, [(sku, order, *v) for sku, orders in waits.items() for order, v in orders.items()] + later)
        elif later:
            self.waiting.appendList(later)

    @staticmethod
    def _write(state, rows) -> None:
        if rows:
            state.put(rows)
        else:
            state.clear()

    def close(self) -> None:
        pass


def start_pull(lines: DataFrame, folder: str, lots: DataFrame | None = None, words: DataFrame | None = None, opening: DataFrame | None = None,
               recorded: DataFrame | None = None, trigger: dict | None = None):
    """Turn a stream of order lines (order_id, sku, quantity, status, created_at) into sales, appended to ``folder``/sales, each once.

    ``lots``: a stream of arrivals (lot_id, sku, units, expires_on). ``words``: a stream of later words about orders (order_id, status, at), where the latest ``at``, a
    timestamp, rules; a line's own status counts from its created_at. ``opening`` (lot_id, sku, units, expires_on) is the stock and ``recorded`` (order_id, sku) the sales
    before the stream; the first batch alone reads them. Units are whole. An order has one line for each sku; a line that comes again changes nothing. A line of null
    status waits for a word; a line without a quantity waits for ever. A batch takes the decided lines of a sku in order of (created_at, order).
    """
    spark = lines.sparkSession
    state.use_rocks(spark)
    none = lambda kind: F.lit(None).cast(kind)
    rows = lines.select("order_id", "sku", F.col("quantity").cast("bigint").alias("quantity"), "status", F.unix_micros(F.col("created_at").cast("timestamp")).alias("created"),
                        F.coalesce(F.unix_micros(F.col("created_at").cast("timestamp")), F.lit(0)).alias("at"))
    if words is not None:
        rows = rows.unionByName(words.select("order_id", none("string").alias("sku"), none("bigint").alias("quantity"), "status", none("bigint").alias("created"),
                                             F.unix_micros(F.col("at").cast("timestamp")).alias("at")))
    stock = rows.withColumn("bucket", state.bucket("order_id")).groupBy("bucket").transformWithState(OrderLines(), STOCK_ROW, "append", "none")
    as_lot = lambda df: df.select(F.lit("lot").alias("kind"), "sku", none("string").alias("order_id"), F.floor("units").cast("bigint").alias("quantity"),
                                  none("bigint").alias("created"), "lot_id", F.col("expires_on").cast("date").alias("expires_on"))
    known = spark.createDataFrame([], f"bucket int, lots {LOTS}, sold {PAIRS}")
    if opening is not None:  # a sale holds all lots of its bucket, too
        day = (F.datediff(F.col("expires_on").cast("date"), F.lit("1970-01-01").cast("date")) + dt.date(1970, 1, 1).toordinal()).alias("expires_day")
        lot = F.struct("sku", "lot_id", F.floor("units").cast("bigint").alias("units"), day)
        known = known.unionByName(opening.filter("units >= 1").groupBy(state.bucket("sku").alias("bucket")).agg(F.collect_list(lot).cast(LOTS).alias("lots")).withColumn("sold", none(PAIRS)))
    if recorded is not None:
        pairs = recorded.groupBy(state.bucket("sku").alias("bucket")).agg(F.collect_list(F.struct("sku", "order_id")).cast(PAIRS).alias("sold"))
        known = known.unionByName(pairs.select("bucket", none(LOTS).alias("lots"), "sold"))
    if lots is not None:
        stock = stock.unionByName(as_lot(lots))
    stock = stock.withColumn("bucket", state.bucket("sku"))
    sales = stock.groupBy("bucket").transformWithState(SkuStock(), SALE_ROW, "append", "none", known.groupBy("bucket"))
    sales = sales.withColumn("created_at", F.timestamp_micros("created")).drop("created")
    return state.start(sales.withColumn("pulled_at", F.current_timestamp()), f"{folder}/sales", f"{folder}/_progress", trigger)


def read_sales(spark: SparkSession, folder: str, ledger: DataFrame | None = None) -> DataFrame:
    """The sales as ledger rows, numbered on from ``ledger`` in order of batch, line and part; ``pulled_at`` is one time for each batch, so numbers stay as they are
    when batches are added."""
    sales = materialize(spark.read.parquet(f"{folder}/sales"), "sales")
    first = 1 if ledger is None else lg.next_event_number(ledger)
    numbered = number_rows(sales, ["pulled_at", "created_at", "order_id", "sku", "part"], "n", first)
    return numbered.select(F.format_string("IE-%04d", "n").alias("event_id"), "lot_id", F.lit("sold").alias("kind"), F.col("quantity").cast("double").alias("quantity"),
                           F.to_date("created_at").alias("occurred_on"), "reference")


def read_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Every line of the stream with its order's status after the last batch."""
    orders = state.read_variable(spark, f"{folder}/_progress", 1, "order").select("list_element.*")
    orders = orders.select("order_id", "status", F.explode(F.from_json("lines", "array<array<string>>")).alias("l"))
    return orders.select("order_id", F.col("l")[0].alias("sku"), F.col("l")[1].cast("bigint").alias("quantity"), F.timestamp_micros(F.col("l")[2].cast("bigint")).alias("created_at"), "status")


def read_waiting(spark: SparkSession, folder: str) -> DataFrame:
    """Lines that wait for a lot: sku, order_id, quantity, created_at."""
    return state.read_variable(spark, f"{folder}/_progress", 0, "waiting").select("list_element.sku", "list_element.order_id", "list_element.quantity", F.timestamp_micros("list_element.created").alias("created_at"))


def read_marked(spark: SparkSession, folder: str, recorded: DataFrame | None = None) -> DataFrame:
    """Orders safe to mark as synced, judged from the written sales alone (and ``recorded`` references, if given)."""
    references = spark.read.parquet(f"{folder}/sales").select("reference")
    return allocate.orders_to_mark(read_lines(spark, folder), references if recorded is None else references.unionByName(recorded.select("reference")))


def running_on_hand(ledger_stream: DataFrame) -> DataFrame:
    """On hand per lot over a ledger stream. A sum does not depend on order, so late rows do no harm."""
    return ledger_stream.groupBy("lot_id").agg(F.sum(lg.delta()).alias("on_hand"))


def start_running_on_hand(ledger_stream: DataFrame, folder: str, trigger: dict | None = None):
    """Keep the stock of every lot in the query's own state; read with :func:`read_on_hand`. Nothing else is written."""
    return (running_on_hand(ledger_stream).writeStream.format("noop").outputMode("update").option("checkpointLocation", f"{folder}/_progress")
            .trigger(**(trigger or {"availableNow": True})).start())


def read_on_hand(spark: SparkSession, folder: str) -> DataFrame:
    """The figure of every lot after the last batch, one row for each lot whatever the number of batches."""
    held = spark.read.format("statestore").load(f"{folder}/_progress")
    total = held.schema["value"].dataType.fieldNames()[0]
    return held.select("key.lot_id", F.col("value").getField(total).alias("on_hand"))
