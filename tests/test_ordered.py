import random

from pyspark.sql import functions as F

from stockweave.functions.ordered import Running, number_rows, running


def test_running_measures_match_a_plain_loop_across_slices(spark):
    rng = random.Random(3)
    data = [(rng.choice("aab"), rng.randrange(40), i, rng.choice([None, rng.randrange(9)])) for i in range(300)]
    df = spark.createDataFrame(data, "k string, t bigint, i int, v int")
    measures = [Running(f"{kind}_{int(through)}", kind, F.col("v"), through) for kind in ("sum", "max") for through in (True, False)]
    out = running(df, ["k"], "t", F.floor(F.col("t") / 7), measures).collect()
    assert len(out) == len(data)
    for r in out:
        for through in (True, False):
            seen = [v for k, t, _, v in data if k == r["k"] and v is not None and (t <= r["t"] if through else t < r["t"])]
            assert r[f"sum_{int(through)}"] == sum(seen)
            assert r[f"max_{int(through)}"] == max(seen, default=None)


def test_first_and_last_skip_nulls_and_cross_slices(spark):
    data = [("a", 1, None), ("a", 2, "x"), ("a", 15, None), ("a", 16, "y"), ("a", 40, None)]
    df = spark.createDataFrame(data, "k string, t bigint, v string")
    out = running(df, ["k"], "t", F.floor(F.col("t") / 10), [Running("f", "first", F.col("v"), False), Running("l", "last", F.col("v"), False)])
    got = {r["t"]: (r["f"], r["l"]) for r in out.collect()}
    assert got == {1: (None, None), 2: (None, None), 15: ("x", "x"), 16: ("x", "x"), 40: ("x", "y")}


def test_number_rows_is_dense_and_ordered(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("x")).repartition(6)
    got = sorted((r["n"], r["x"]) for r in number_rows(df, ["x"], "n", 5).collect())
    assert got == [(i + 5, i) for i in range(1000)]
