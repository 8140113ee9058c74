import datetime as dt
import random

from pyspark.sql import functions as F

from stockweave.operators import members as m

LEVELS = [m.Level("Base", 0), m.Level("Mid", 500, 10, True), m.Level("Top", 1500, 15, True)]
YEAR = dt.timedelta(365)


def noon(day):
    return dt.datetime.fromisoformat(day + "T12:00:00")


def status(spark, orders, as_of):
    data = [("c", f"o{i}", noon(d), usd * 100) for i, (d, usd) in enumerate(orders)]
    df = spark.createDataFrame(data, "customer string, order_id string, at timestamp, cents bigint")
    s = m.status_at(m.earned_levels(df, LEVELS), LEVELS, F.lit(noon(as_of)))
    return m.base_status(spark.createDataFrame([("c",)], "customer string"), s, LEVELS)


def test_thresholds(spark):
    df = spark.createDataFrame([(49_999,), (50_000,), (150_000,), (-5,)], "c bigint")
    assert [r[0] for r in df.select(m.level_for_spend(LEVELS, "c")).collect()] == [0, 1, 2, 0]


def test_level_holds_a_year_and_drops_one_step(spark):
    get = lambda orders, at: tuple(status(spark, orders, at).select("level_name", "spend12", "holds_until", "next_name", "to_go").first())
    assert get([], "2027-03-01") == ("Base", 0, None, "Mid", 50_000)
    two = [("2027-01-10", 300), ("2027-03-15", 250)]
    assert get(two, "2027-03-16")[:3] == ("Mid", 55_000, "2028-03-14")
    assert get(two, "2028-03-01")[0] == "Mid" and get(two, "2028-03-20")[0] == "Base"
    big = [("2027-02-01", 1600)]
    assert get(big, "2027-12-01")[0] == "Top"
    assert get(big, "2028-02-10")[0::2] == ("Mid", "2029-01-31", 150_000)
    assert get(big, "2029-02-10")[0] == "Base"


def test_member_prices(spark):
    df = spark.createDataFrame([(0, 10_000), (1, 10_000), (2, 19_900), (0, 15_000)], "level int, subtotal_cents bigint")
    got = [tuple(r) for r in m.member_price(df, LEVELS).select("discount_cents", "net_cents", "shipping_cents", "total_cents").collect()]
    assert got == [(0, 10_000, 2495, 12_495), (1000, 9000, 0, 9000), (2985, 16_915, 0, 16_915), (0, 15_000, 0, 15_000)]


def test_progress_sentences(spark):
    def say(orders, cart):
        s = status(spark, orders, "2027-04-02").withColumn("cart_net", F.lit(cart))
        return m.progress(s, LEVELS).first()["progress_text"]
    assert say([("2027-04-01", 180)], 5900) == "Mid status at $500 in 12 months. You're at $180."
    assert say([("2027-04-01", 436)], 0) == "$64 from Mid: 10% off and free shipping on every order."
    assert say([("2027-04-01", 436)], 6400) == "This order takes you to Mid."
    assert say([("2027-03-10", 570)], 0) == "Mid status through March 2028. Top status at $1,500 in 12 months. You're at $570."
    assert say([("2027-03-10", 1500)], 0) == "Top status through March 2028."


def plain_level(cents):
    return 2 if cents >= 150_000 else 1 if cents >= 50_000 else 0


def plain_status(orders, n):
    best = []
    for t, _ in orders:
        if t <= n:
            best.append((t, plain_level(sum(c for u, c in orders if t - YEAR < u <= t))))
    held = max([l for t, l in best if t > n - YEAR], default=0)
    soft = max([l for t, l in best if n - 2 * YEAR < t <= n - YEAR], default=0) - 1
    return max(held, soft, 0)


def test_levels_and_tier_ups_equal_a_plain_replay(spark):
    rng = random.Random(11)
    start = dt.datetime(2024, 1, 1)
    data = [(f"c{rng.randrange(3)}", f"o{i:03}", start + dt.timedelta(days=rng.choice([rng.randrange(1400), 365, 730]), seconds=rng.choice([0, 0, 1])), rng.choice([9000, 20_000, 48_000, 120_000]))
            for i in range(150)]
    df = spark.createDataFrame(data, "customer string, order_id string, at timestamp, cents bigint")
    earned = m.earned_levels(df, LEVELS)
    of = lambda c: [(t, x) for cc, _, t, x in data if cc == c]
    for r in earned.collect():
        assert r["rolling_cents"] == sum(x for t, x in of(r["customer"]) if r["at"] - YEAR < t <= r["at"])
    got = {r["order_id"]: (r["level_before"], r["level_after"], r["tier_up"]) for r in m.tier_ups(earned, LEVELS).collect()}
    for c, order, at, _ in data:
        rest = [(t, x) for cc, o, t, x in data if cc == c and o != order]
        before, after = plain_status(rest, at), plain_status(of(c), at)
        assert got[order] == (before, after, after > before)
    as_of = dt.datetime(2026, 6, 1)
    assert {r["customer"]: r["level"] for r in m.status_at(earned, LEVELS, F.lit(as_of)).collect()} == {c: plain_status(of(c), as_of) for c in ("c0", "c1", "c2")}
