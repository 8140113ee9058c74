import datetime as dt
import random

import pytest
from conftest import rows

from stockweave.operators import allocate as al, ledger as lg, orders as od

DAY = dt.datetime(2026, 10, 10, 12)


def lots_of(spark, spec):
    """spec: (sku, lot, on_hand[, expires_on])"""
    data = [(s[0], s[1], float(s[2]), s[3] if len(s) > 3 else None) for s in spec]
    return al.fefo_lots(spark.createDataFrame(data, "sku string, lot_id string, on_hand double, expires_on date"))


def lines_of(spark, spec):
    data = [(o, s, q, st, at) for o, s, q, st, at in spec]
    return spark.createDataFrame(data, "order_id string, sku string, quantity int, status string, created_at timestamp")


def refs_of(spark, refs=()):
    return spark.createDataFrame([(r,) for r in refs], "reference string")


def events_of(spark, lines, lots, refs=(), start=1):
    d = al.decide_lines(lines_of(spark, lines), lots, refs_of(spark, refs))
    ev = al.sale_events(al.sale_parts(d, lots), start)
    return rows(ev, "event_id", "quantity", "lot_id", "reference"), dict(rows(al.order_outcomes(d)))


def test_stock_signs_unknown_kinds_and_empty_lots(spark):
    products = spark.createDataFrame([("p",), ("q",)], "product_id string")
    lots = spark.createDataFrame([("l1", "p"), ("l2", "p")], "lot_id string, product_id string")
    moves = [("received", 10), ("sold", 3), ("reserved", 1), ("released", 1), ("adjusted", 2), ("damaged", 4), ("expired", 7), ("moved", 50)]
    ledger = spark.createDataFrame([("l1", k, float(q)) for k, q in moves], "lot_id string, kind string, quantity double")
    assert rows(lg.lot_on_hand(lots, ledger), "lot_id", "on_hand") == [("l1", -2.0), ("l2", 0.0)]
    assert rows(lg.stock(products, lots, ledger), "product_id", "on_hand", "n_lots") == [("p", -2.0, 2), ("q", 0.0, 0)]


def test_next_event_number(spark):
    of = lambda *ids: lg.next_event_number(spark.createDataFrame([(i,) for i in ids], "event_id string"))
    assert of() == 1 and of("IE-0009", "IE-0041", "other") == 42


def test_lots_follow_expiry_and_empty_ones_are_left_out(spark):
    lots = lots_of(spark, [("x", "late", 5, dt.date(2027, 1, 1)), ("x", "none", 2), ("x", "soon", 1, dt.date(2026, 1, 1)), ("x", "zero", 0), ("y", "b", -3)])
    assert rows(lots, "lot_id", "fefo_rank", "unit_from", "unit_to") == [("late", 2, 1, 6), ("none", 3, 6, 8), ("soon", 1, 0, 1)]


def test_lines_share_the_running_count_and_split_across_lots(spark):
    lots = lots_of(spark, [("R", "lot", 5), ("X", "L1", 1, dt.date(2026, 1, 1)), ("X", "L2", 10, dt.date(2027, 1, 1))])
    lines = [("C", "R", 4, "paid", DAY), ("D", "R", 2, "paid", DAY), ("E", "X", 3, "paid", DAY), ("F", "X", 1, "refunded", DAY), ("J", "none", 1, "paid", DAY)]
    events, orders = events_of(spark, lines, lots, start=100)
    assert events == [("IE-0100", 4.0, "lot", "order C R"), ("IE-0101", 1.0, "L1", "order E X"), ("IE-0102", 2.0, "L2", "order E X lot L2")]
    assert orders == {"C": "recorded", "D": "blocked", "E": "recorded", "F": "refunded", "J": "blocked"}


def test_a_blocked_order_is_retried_without_selling_twice(spark):
    lines = [("G", "X", 1, "paid", DAY), ("G", "Y", 1, "paid", DAY)]
    events, orders = events_of(spark, lines, lots_of(spark, [("X", "L1", 5)]))
    assert [e[3] for e in events] == ["order G X"] and orders == {"G": "blocked"}
    events, orders = events_of(spark, lines, lots_of(spark, [("X", "L1", 4), ("Y", "L9", 10)]), ["order G X"], 2)
    assert [e[3] for e in events] == ["order G Y"] and orders == {"G": "recorded"}


def test_orders_to_mark_come_from_the_ledger_alone(spark):
    lines = lines_of(spark, [("P", "X", 1, "paid", DAY), ("P", "Y", 1, "paid", DAY), ("Q", "X", 1, "paid", DAY), ("R", "X", 1, "refunded", DAY), ("S", "X", 1, "refunded", DAY)])
    mark = lambda *refs: [r[0] for r in rows(al.orders_to_mark(lines, refs_of(spark, refs)))]
    assert mark("order P X", "order P Y lot L2", "order S X") == ["P", "R"]
    assert mark() == ["R", "S"]
    assert rows(al.refunded_after_sale(lines, refs_of(spark, ["order S X"]))) == [("S",)]


@pytest.mark.parametrize("seed", [200_000, 3, 0])
def test_allocation_equals_a_plain_walk(spark, seed):
    rng = random.Random(seed)
    spec = [(f"s{i % 6}", f"lot{i:03}", rng.randrange(0, 90), rng.choice([None, dt.date(2026, 1, 1) + dt.timedelta(rng.randrange(9))])) for i in range(24)]
    lines = [(f"o{i:04}", f"s{min(rng.randrange(12), 6)}", rng.choice([1, 2, 3, 20, 40, 70]), "paid", DAY + dt.timedelta(hours=rng.randrange(40))) for i in range(240)]
    free = {}
    for sku, lot, units, _ in sorted(spec, key=lambda s: (s[0], s[3] or dt.date.max, s[1])):
        free.setdefault(sku, []).append([lot, units])
    want = {}
    for order, sku, qty, _, _ in sorted(lines, key=lambda x: (x[4], x[0])):
        if sum(u for _, u in free.get(sku, [])) >= qty:
            need = qty
            for lot in free[sku]:
                part = min(need, lot[1])
                if part:
                    want[order, lot[0]] = part
                    lot[1] -= part
                    need -= part
    lots = lots_of(spark, spec)
    d = al.decide_lines(lines_of(spark, lines), lots, refs_of(spark))
    got = {(r["order_id"], r["lot_id"]): r["taken"] for r in al.sale_parts(d, lots).collect()}
    assert got == want


def test_carts_report_the_first_fault_and_price_from_the_catalogue(spark):
    products = spark.createDataFrame([("a", "A", 10.0, "active", 5.0, "stocked"), ("j", "J", 3.5, "active", 0.0, "just_in_time"), ("d", "D", 1.0, "draft", 9.0, "stocked")],
                                     "sku string, name string, price_usd double, status string, on_hand double, fulfilment string")
    sold = spark.createDataFrame([("a", 2)], "sku string, sold bigint")
    carts = [("ok", 1, "a", 3.0), ("ok", 2, "j", 10.0), ("few", 1, "a", 4.0), ("bad", 2, "d", 1.0), ("bad", 1, "a", 21.0), ("half", 1, "a", 1.5), ("off", 1, "d", 1.0), ("what", 1, "zz", 1.0)]
    c = spark.createDataFrame(carts, "cart_id string, line_no int, sku string, quantity double")
    got = {r["cart_id"]: (r["outcome"], r["failed_sku"], r["message"], r["subtotal_cents"]) for r in od.quote_carts(c, od.available_to_promise(products, sold)).collect()}
    assert got == {"ok": ("ok", None, None, 6500), "few": ("short", "a", "Only 3 of A remain.", None), "bad": ("invalid", "a", "A cart line is invalid.", None),
                   "half": ("invalid", "a", "A cart line is invalid.", None), "off": ("unavailable", "d", "D is not available.", None), "what": ("invalid", "zz", "A cart line is invalid.", None)}
