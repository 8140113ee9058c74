"""State of the streams by bucket: few calls of the state for many entities, and the same results as one key for each."""

import pyarrow as pa
from pyspark.sql import Row

from stockweave.streaming import payments as pm, pull


class State:
    """A list state that counts its calls."""

    def __init__(self, calls):
        self.calls, self.held = calls, []

    def get(self):
        self.calls.append("get")
        return iter(self.held)

    def appendList(self, rows):
        self.calls.append("appendList")
        self.held = self.held + rows

    def put(self, rows):
        self.calls.append("put")
        self.held = list(rows)

    def clear(self):
        self.calls.append("clear")
        self.held = []


class Handle:
    def __init__(self):
        self.calls, self.states = [], {}

    def getListState(self, name, schema):
        return self.states.setdefault(name, State(self.calls))


def test_many_orders_of_a_bucket_cost_two_calls():
    handle, orders = Handle(), pm.OrderState()
    orders.init(handle)
    move = lambda i, at, status="paid": Row(order_id=f"o{i}", payment_id=None, customer_id=None, error=None, status=status, arrival=at, direct=True,
                                            was_status="pending", was_payment_id=None, was_customer_id=None, was_last_error=None)
    first = list(orders.handleInputRows((7,), iter([move(i, 10 + i) for i in range(50)]), None))
    assert sorted(r.order_id for r in first) == sorted(f"o{i}" for i in range(50)) and handle.calls == ["get", "appendList"]
    handle.calls.clear()
    assert list(orders.handleInputRows((7,), iter([move(3, 100, "failed"), move(50, 101)]), None)) == [Row(order_id="o50", kind="paid", arrival=101)]
    assert handle.calls == ["get", "put"]
    held = {x[0]: x[1] for x in handle.states["order"].held}
    assert len(held) == 51 and held["o3"] == "failed" and held["o4"] == "paid"


def test_many_payments_of_a_bucket_cost_two_calls_and_stay_apart():
    handle, orders = Handle(), pm.OrdersOfPayment()
    orders.init(handle)
    said = lambda p, o, at, status: Row(order_id=o, payment_id=p, customer_id=None, error=None, status=status, arrival=at)
    rows = [said(f"p{i}", f"o{i}", i, "failed") for i in range(50)] + [said("p3", None, 60, "paid"), said("p3", None, 61, "paid"), said("p3", None, 62, "failed")]
    out = list(orders.handleInputRows((7,), iter(rows), None))
    assert [(r.order_id, r.arrival, r.status) for r in out if not r.direct] == [("o3", 60, "paid"), ("o3", 62, "failed")]
    assert handle.calls == ["get", "appendList"]
    handle.calls.clear()
    out = list(orders.handleInputRows((7,), iter([said("p4", "x", 70, "failed"), said("p4", None, 71, "failed")]), None))
    assert sorted(r.order_id for r in out if not r.direct) == ["o4", "x"] and handle.calls == ["get", "appendList"]


def test_the_earliest_row_of_a_batch_stands_for_its_event():
    batch = lambda rows: pa.RecordBatch.from_pylist(rows, pa.schema([("event_id", pa.string()), ("arrival", pa.int64())]))
    parts = [batch([{"event_id": "b", "arrival": 4}, {"event_id": "a", "arrival": 9}]), batch([]), batch([{"event_id": "a", "arrival": 2}, {"event_id": "a", "arrival": None}])]
    assert [r for b in pm._earliest(iter(parts)) for r in b.to_pylist()] == [{"event_id": "a", "arrival": 2}, {"event_id": "b", "arrival": 4}]
    assert [r for b in pm._earliest(iter([])) for r in b.to_pylist()] == []


def test_many_lines_of_a_bucket_cost_few_calls_and_stay_apart():
    handle, orders = Handle(), pull.OrderLines()
    orders.init(handle)
    line = lambda i, sku, status, at=0: Row(order_id=f"o{i}", sku=sku, quantity=1, created=at, status=status, at=at)
    out = list(orders.handleInputRows((7,), iter([line(i, sku, "pending" if i == 3 else "paid") for i in range(50) for sku in "ab"]), None))
    assert len(out) == 98 and {r.kind for r in out} == {"line"} and handle.calls == ["get", "appendList"]
    handle.calls.clear()
    out = list(orders.handleInputRows((7,), iter([line(3, None, "paid", 5), line(4, None, "refunded", 5), line(5, "c", "paid")]), None))
    assert sorted((r.kind, r.order_id, r.sku) for r in out) == [("cancel", "o4", "a"), ("cancel", "o4", "b"), ("line", "o3", "a"), ("line", "o3", "b"), ("line", "o5", "c")]
    assert handle.calls == ["get", "put"] and len(handle.states["order"].held) == 50


def test_many_skus_of_a_bucket_cost_few_calls_and_stay_apart():
    handle, stock = Handle(), pull.SkuStock()
    stock.init(handle)
    row = lambda kind, sku, order=None, n=1, lot=None: Row(kind=kind, sku=sku, order_id=order, quantity=n, created=0, lot_id=lot, expires_on=None)
    out = list(stock.handleInputRows((7,), iter([row("lot", f"s{i}", n=2, lot=f"l{i}") for i in range(50)] + [row("line", f"s{i}", "A", 1 + i % 3) for i in range(50)]), None))
    assert sorted(r.sku for r in out) == sorted(f"s{i}" for i in range(50) if i % 3 < 2) and all(r.lot_id == "l" + r.sku[1:] for r in out) and len(handle.calls) <= 5
    handle.calls.clear()
    out = list(stock.handleInputRows((7,), iter([row("lot", "s2", n=1, lot="more"), row("cancel", "s5", "A"), row("cancel", "s0", "A")]), None))
    assert [(r.sku, r.lot_id, r.part, r.quantity) for r in out] == [("s2", "l2", 0, 2), ("s2", "more", 1, 1)] and len(handle.calls) <= 5
    assert handle.states["sold"].held == [("s0", "A")] and not {"s2", "s5"} & {x[0] for x in handle.states["waiting"].held}
    assert list(stock.handleInputRows((7,), iter([row("line", "s0", "A"), row("line", "s5", "A", 3)]), None)) == []  # sold before; too many
