import datetime as dt
import json

import pytest
from conftest import rows
from pyspark.sql import Row, functions as F

from stockweave.operators import allocate as al
from stockweave.sources.chunks import chunk_text
from stockweave.sources.ontology_file import load_ontology
from stockweave.sources.records import read_records
from stockweave.streaming import payments as pm, pull


def test_records_from_json_and_yaml(spark, tmp_path):
    doc = {"type": "Pep", "items": [{"name": "A", "attrs": {"mw": 1.5, "ok": True, "tags": ["x"], "none": None, "t": "5"}, "confidence": "high"},
                                    {"name": "B", "source": "own", "edges": [{"rel": "R", "to": "Sup:S", "attrs": {"n": 1}}]}]}
    (tmp_path / "json").mkdir(), (tmp_path / "yaml").mkdir(), (tmp_path / "bad").mkdir()
    (tmp_path / "json" / "b.json").write_text(json.dumps(doc) + "\n" + json.dumps({**doc, "source": "late", "confidence": "low"}))
    (tmp_path / "json" / "a.json").write_text(json.dumps({"type": "Sup", "source": "first", "items": [{"name": "S"}]}))
    (tmp_path / "yaml" / "x.yaml").write_text("type: Pep\nitems:\n  - name: A\n    attrs: {mw: 1.5, day: 2024-01-02}\n    aliases: [aa]\n")
    (tmp_path / "bad" / "x.json").write_text('{"type": "Pep"}')
    got = rows(read_records(spark, str(tmp_path / "json")), "seq", "type", "name", "source", "confidence")
    assert got == [(0, "Sup", "S", "first", "medium"), (1, "Pep", "A", "b.json", "high"), (2, "Pep", "B", "own", "medium"), (3, "Pep", "A", "late", "high"), (4, "Pep", "B", "own", "low")]
    r = read_records(spark, str(tmp_path / "json")).filter("seq in (1, 2)").orderBy("seq").collect()
    assert r[0]["attrs"] == {"mw": "1.5", "ok": "true", "tags": '["x"]', "none": "null", "t": '"5"'} and r[1]["edges"][0]["attrs"] == {"n": "1"}
    y = read_records(spark, str(tmp_path / "yaml"), "yaml").first()
    assert y["attrs"] == {"mw": "1.5", "day": '"2024-01-02"'} and y["aliases"] == ["aa"]
    with pytest.raises(ValueError):
        read_records(spark, str(tmp_path / "bad"))


def test_ontology_file(tmp_path):
    (tmp_path / "o.yaml").write_text("entities:\n  A:\n    attrs: {x: {type: number, internal: true}}\nevents:\n  E: {}\nrelations:\n  R: {domain: [A], range: [E], internal: true}\n"
                                     "recipes:\n  r:\n    seed_types: [A]\n    expand:\n      - {rel: R, dir: out, from: A}\n    global:\n      - {type: E, scope: s}\n    summaries: [stock]\n")
    o = load_ontology(str(tmp_path / "o.yaml"))
    assert list(o.types) == ["A", "E"] and o.internal_attrs()["A"] == ["x"] and o.internal_rels() == ["R"]
    assert o.recipes["r"].steps[0].from_types == ("A",) and o.recipes["r"].stock_summary and o.recipes["r"].rules == (("E", "s"),)


def test_chunks_cover_the_text_and_the_last_may_be_overlap(spark):
    docs = spark.createDataFrame([("a", "x" * 6000), ("b", "é" * 10_600), ("c", "")], "source string, text string")
    got = rows(chunk_text(docs), "chunk_id", F.length("text"))
    assert got == [("a#chunk0", 6000), ("b#chunk0", 6000), ("b#chunk1", 5320), ("b#chunk2", 40), ("c#chunk0", 0)]


def event(id_, type_, **obj):
    return json.dumps({"id": id_, "type": type_, "data": {"object": obj}})


def test_payloads_are_normalised(spark):
    texts = [event("1", "payment/a/b", id="p1", order_id="o1"), event("2", "order.paid", id="x", metadata={"orderId": "o2"}), json.dumps({"id": "3", "type": "payment.failed", "data": {"id": "p3", "metadata": {"cartCustomAttributes": {"orderId": "o3"}}}}),
             "not json", json.dumps({"type": "no id"}), event("4", "x", paymentId="p4", payment_id="no", orderId="o4", order_id="no")]
    df = spark.createDataFrame([(t, i) for i, t in enumerate(texts)], "payload string, arrival bigint")
    assert rows(pm.normalize(df), "event_id", "event_type", "payment_id", "order_id") == [
        ("1", "payment.a/b", "p1", "o1"), ("2", "order.paid", None, "o2"), ("3", "payment.failed", "p3", "o3"), ("4", "x", "p4", "o4")]


def plain_orders(orders, events):
    """Replay in arrival order: latest wins, payment ids stick, an event without an order hits all orders of its payment."""
    state, seen, alerts = {o: ["pending", p] for o, p in orders}, set(), {}
    for arrival, id_, status, order, pay in sorted(events):
        if id_ in seen:
            continue
        seen.add(id_)
        hit = [order] if order else [o for o, s in state.items() if pay and s[1] == pay]
        for o in hit:
            if o in state:
                state[o] = [status, (pay or state[o][1]) if order else state[o][1]]
                if status == "paid":
                    alerts.setdefault(o, arrival)
    return {o: tuple(s) for o, s in state.items()}, alerts


@pytest.mark.parametrize("files", [1, 4])
def test_streamed_order_status_equals_a_plain_replay(spark, tmp_path, files):
    import random
    rng = random.Random(files)
    orders = [(f"o{i}", rng.choice([None, "p0", "p1"])) for i in range(8)]
    kinds = {"paid": "payment.succeeded", "failed": "order.failed", "refunded": "order/refunded"}
    events = [(i, f"e{rng.randrange(90)}", rng.choice(list(kinds)), rng.choice([None, f"o{rng.randrange(9)}"]), rng.choice([None, f"p{rng.randrange(4)}"]),
               rng.choice([None, f"c{rng.randrange(3)}"]), rng.choice([None, "declined"])) for i in range(160)]
    obj = lambda **k: {n: x for n, x in k.items() if x}
    data = [(event(id_, kinds[status], **obj(orderId=order, paymentId=pay, customerId=who, error=why)), i) for i, id_, status, order, pay, who, why in events]
    source, folder = tmp_path / "in", str(tmp_path / "out")
    state = spark.createDataFrame([(o, "pending", p) for o, p in orders], "order_id string, status string, payment_id string")
    facts = spark.createDataFrame([(o, f"about {o}") for o, _ in orders], "order_id string, title string")
    assert rows(pm.read_orders(spark, state, folder), "order_id", "status") == [(o, "pending") for o, _ in orders]
    for f in range(files):
        part = data[f * len(data) // files:(f + 1) * len(data) // files]
        spark.createDataFrame(part, "payload string, arrival bigint").coalesce(1).write.mode("append").parquet(str(source))
        pm.start_payments(spark.readStream.schema("payload string, arrival bigint").parquet(str(source)), state, folder, facts=facts).awaitTermination()
    pm.start_payments(spark.readStream.schema("payload string, arrival bigint").parquet(str(source)), state, folder, facts=facts).awaitTermination()  # finds nothing new
    want, alerts, more, seen = *plain_orders(orders, [e[:5] for e in events]), {o: [None, None] for o, _ in orders}, set()
    for _, id_, _, order, _, who, why in events:
        if id_ not in seen and order in more:
            more[order] = [who or more[order][0], why]
        seen.add(id_)
    assert {r[0]: tuple(r[1:]) for r in rows(pm.read_orders(spark, state, folder))} == {o: (*want[o], *more[o]) for o in want}
    assert rows(pm.read_alerts(spark, folder), "order_id", "kind", "arrival", "title") == sorted((o, "paid", at, f"about {o}") for o, at in alerts.items())


def test_a_late_batch_reads_and_touches_its_own_events_only(spark, tmp_path):
    source, folder = str(tmp_path / "in"), str(tmp_path / "out")
    state = spark.createDataFrame([(f"o{i}", "pending", None) for i in range(20)], "order_id string, status string, payment_id string")
    for b in range(12):
        part = [(event(f"e{b}-{i}", "order.paid", orderId=f"o{i}", paymentId=f"p{i}"), b * 10 + i) for i in range(10)]
        spark.createDataFrame(part, "payload string, arrival bigint").coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema("payload string, arrival bigint").option("maxFilesPerTrigger", 1).parquet(source)
    query = pm.start_payments(stream, state, folder)
    query.awaitTermination()
    said = [json.loads(p.json) if hasattr(p, "json") else p for p in query.recentProgress]
    said = [p for p in said if p["numInputRows"]]
    assert len(said) == 12 and len({p["numInputRows"] for p in said}) == 1
    touched = [[op["numRowsUpdated"] for op in p["stateOperators"]] for p in said]
    assert touched[1] == touched[-1]
    assert pm.read_alerts(spark, folder).count() == 10


def test_orders_without_an_event_are_not_kept_as_state(spark, tmp_path):
    source, folder = str(tmp_path / "in"), str(tmp_path / "out")
    known = spark.createDataFrame([(f"o{i}", "pending", "p9" if i == 7 else None, "c" if i == 3 else None) for i in range(50)], "order_id string, status string, payment_id string, customer_id string")
    data = [(event("e1", "order.paid", orderId="o3"), 1), (event("e2", "order.paid", orderId="none"), 2), (event("e3", "payment.failed", paymentId="p9"), 3)]
    spark.createDataFrame(data, "payload string, arrival bigint").coalesce(1).write.parquet(source)
    pm.start_payments(spark.readStream.schema("payload string, arrival bigint").parquet(source), known, folder).awaitTermination()
    assert pm.state.read_variable(spark, f"{folder}/_progress", 0, "order").count() == 2
    want = [(f"o{i}", {3: "paid", 7: "failed"}.get(i, "pending"), "p9" if i == 7 else None, "c" if i == 3 else None, None) for i in range(50)]
    assert rows(pm.read_orders(spark, known, folder)) == sorted(want, key=repr)
    assert rows(pm.read_alerts(spark, folder), "order_id", "arrival") == [("o3", 1)]


AT = dt.datetime(2026, 1, 1)
LINE = "order_id string, sku string, quantity bigint, status string, created_at timestamp"
LOT = "lot_id string, sku string, units double, expires_on date"
WORD = "order_id string, status string, at timestamp"


class Pull:
    """A pull fed by hand: lines, lots and words of each batch."""

    def __init__(self, spark, folder, opening=(), recorded=()):
        self.spark, self.folder = spark, str(folder)
        self.opening = spark.createDataFrame(list(opening), LOT)
        self.recorded = spark.createDataFrame(list(recorded), "order_id string, sku string")
        for name, schema in (("lines", LINE), ("lots", LOT), ("words", WORD)):
            spark.createDataFrame([], schema).write.parquet(f"{self.folder}/{name}")

    def batch(self, lines=(), lots=(), words=()):
        for name, schema, new in (("lines", LINE, lines), ("lots", LOT, lots), ("words", WORD, words)):
            if new:
                self.spark.createDataFrame(list(new), schema).coalesce(1).write.mode("append").parquet(f"{self.folder}/{name}")
        read = lambda name, schema: self.spark.readStream.schema(schema).parquet(f"{self.folder}/{name}")
        pull.start_pull(read("lines", LINE), self.folder, read("lots", LOT), read("words", WORD), self.opening, self.recorded).awaitTermination()

    def sales(self):
        return rows(pull.read_sales(self.spark, self.folder), "event_id", "lot_id", "quantity", "reference")

    def marked(self):
        return [r[0] for r in rows(pull.read_marked(self.spark, self.folder))]


def test_pull_sells_once_waits_and_takes_back(spark, tmp_path):
    p = Pull(spark, tmp_path, opening=[("lx", "X", 5.9, None)], recorded=[("Z", "X")])
    p.batch(lines=[("A", "X", 3, "paid", AT), ("A", "Y", 1, "paid", AT), ("B", "X", 4, "paid", AT), ("C", "X", 1, "refunded", AT), ("Z", "X", 1, "paid", AT), ("N", "X", 1, None, AT)])
    assert p.sales() == [("IE-0001", "lx", 3.0, "order A X")] and p.marked() == ["C"]
    p.batch(lines=[("D", "X", 2, "paid", AT), ("D", "X", 2, "paid", AT), ("A", "X", 3, "paid", AT), ("F", "Y", 2, "paid", AT)])
    assert p.sales()[1:] == [("IE-0002", "lx", 2.0, "order D X")] and p.marked() == ["C", "D"]
    assert rows(pull.read_waiting(spark, p.folder), "sku", "order_id") == [("X", "B"), ("Y", "A"), ("Y", "F")]
    later = AT + dt.timedelta(1)
    p.batch(words=[("F", "refunded", later), ("N", "paid", later), ("D", "refunded", later)])
    assert rows(pull.read_waiting(spark, p.folder), "sku", "order_id") == [("X", "B"), ("X", "N"), ("Y", "A")]
    p.batch(lots=[("ly", "Y", 9.0, None), ("l2", "X", 2.0, dt.date(2027, 1, 1)), ("l1", "X", 3.0, dt.date(2026, 6, 1))])
    assert p.sales()[2:] == [("IE-0003", "ly", 1.0, "order A Y"), ("IE-0004", "l1", 3.0, "order B X"), ("IE-0005", "l2", 1.0, "order B X lot l2"), ("IE-0006", "l2", 1.0, "order N X")]
    assert p.marked() == ["A", "B", "C", "F", "N"]
    p.batch()
    assert len(p.sales()) == 6


def test_a_stock_that_waits_is_not_read_again(spark, tmp_path):
    """Every batch touches the keys of its own rows, however many lines wait."""
    p = Pull(spark, tmp_path, opening=[("lx", "X", 1.0, None)])
    for b in range(3):
        p.batch(lines=[(f"{b}-{i}", "X", 2, "paid", AT) for i in range(5)] + [(f"{b}-{i}", f"S{b}", 1, "paid", AT) for i in range(5)])
    assert p.spark.read.parquet(f"{p.folder}/sales").count() == 0 and pull.read_waiting(spark, p.folder).count() == 30


def test_pull_reads_and_writes_state_once_for_a_key():
    """An order of many lines, and a sku of many lots and lines, cost a few calls of the state, not some for each."""
    calls = []

    class State:
        def __init__(self, held=None):
            self.held = held

        def __getattr__(self, name):
            def call(*args):
                calls.append(name)
                return {"containsKey": False, "iterator": iter([])}.get(name, self.held)
            return call

    class Handle:
        def getValueState(self, *_):
            return State()

        def getMapState(self, *_):
            return State()

        def getListState(self, *_):
            return State([])

    order, sku = pull.OrderLines(), pull.SkuStock()
    order.init(Handle()), sku.init(Handle())
    row = lambda **more: Row(**{"at": 0, "status": "paid", "created": 0, "created_at": AT, **more})
    told = list(order.handleInputRows(("A",), iter([row(sku=f"s{i}", quantity=1) for i in range(50)]), None))
    assert len(told) == 50 and len(calls) <= 4
    calls.clear()
    lots = [row(kind="lot", lot_id=f"l{i}", quantity=1, expires_on=None, order_id=None) for i in range(50)]
    sales = list(sku.handleInputRows(("s",), iter([*lots, *[row(kind="line", order_id=f"o{i}", quantity=1) for i in range(50)]]), None))
    assert len(sales) == 50 and len(calls) <= 8


def test_a_line_cancelled_after_its_sale_is_not_sold_again(spark, tmp_path):
    p = Pull(spark, tmp_path, opening=[("lx", "X", 9.0, None)])
    p.batch(lines=[("A", "X", 3, "paid", AT), ("B", "X", 1, "paid", AT)], words=[("B", "refunded", AT + dt.timedelta(1))])
    p.batch(words=[("A", "refunded", AT + dt.timedelta(1))])
    p.batch(words=[("A", "paid", AT + dt.timedelta(2)), ("B", "paid", AT + dt.timedelta(2))])
    assert p.sales() == [("IE-0001", "lx", 3.0, "order A X"), ("IE-0002", "lx", 1.0, "order B X")]


def test_running_stock_over_several_batches(spark, tmp_path):
    source = str(tmp_path / "in")
    for b in ([("l", "received", 5.0), ("m", "sold", 1.0)], [("l", "sold", 2.0)]):
        spark.createDataFrame(b, "lot_id string, kind string, quantity double").coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema("lot_id string, kind string, quantity double").option("maxFilesPerTrigger", 1).parquet(source)
    pull.start_running_on_hand(stream, str(tmp_path / "out")).awaitTermination()
    assert rows(pull.read_on_hand(spark, str(tmp_path / "out"))) == [("l", 3.0), ("m", -1.0)]


def test_every_check_names_a_query():
    import __spark_entry__ as entry
    assert set(entry.oracle_sql()) <= set(entry.queries()) and len(entry.queries()) > 100
