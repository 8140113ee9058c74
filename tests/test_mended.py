"""Order of re-pointed edges, rows with nulls, long keys and texts, large counts of units."""

import datetime as dt
import random

from conftest import rows
from pyspark.sql import functions as F
from test_graph import node, nodes_of
from test_ledger_and_allocation import DAY, events_of, lines_of, lots_of, refs_of

from stockweave.functions.columns import first_upper
from stockweave.operators import allocate as al, fusion as fu, graph as g, resolve, serve, upsert, validate

from stockweave.plans import graph_views as gv

EDGE = "src string, rel string, dst string, source string, evidence string, valid_from string, attrs map<string,string>"


def replay(edges, merges):
    """Edges after the merges, one after the other: those of the dropped node are written again at the kept one."""
    now = {(s, d): list(v) for s, d, *v in edges}
    for keep, drop in merges:
        for (s, d), v in [(k, v) for k, v in now.items() if drop in k]:
            del now[(s, d)]
            to = (keep if s == drop else s, keep if d == drop else d)
            if to[0] != to[1]:
                old = now.get(to, [None, None, None])
                now[to] = [v[0], v[1] or old[1], v[2] or old[2]]
    return now


def test_re_pointed_edges_equal_a_replay_of_the_merges(spark):
    types = ["Sup", "Pep"]  # not the order of their names
    rng, nodes, edges, merges, want = random.Random(11), [], [], [], {}
    for case in range(200):
        ids = [f"{t}:c{case}n{i}" for t in types for i in range(5)]
        nodes += [node(i.split(":")[0], i.split(":")[1]) for i in ids]
        mine = [(s, d, f"s{k}", rng.choice([None, f"e{k}"]), rng.choice([None, f"v{k}"])) for k, (s, d) in
                enumerate(sorted({(rng.choice(ids), rng.choice(ids)) for _ in range(14)})) if s != d]
        gone, steps = set(), []
        for t in types:
            same = [i for i in ids if i.startswith(t)]
            for a, b in sorted({tuple(sorted(rng.sample(same, 2))) for _ in range(4)}):
                if a not in gone and b not in gone:
                    keep, drop = rng.choice([(a, b), (b, a)])
                    gone.add(drop)
                    steps.append((keep, drop))
                    merges.append((a, b, keep, drop))
        edges += [(s, "R", d, *v, {}) for s, d, *v in mine]
        want.update(replay(mine, steps))
    _, moved = fu.merge_nodes(nodes_of(spark, *nodes), g.as_edges(spark.createDataFrame(edges, EDGE)), spark.createDataFrame(merges, "a string, b string, keep string, drop string"), types=types)
    assert {(r["src"], r["dst"]): [r["source"], r["evidence"], r["valid_from"]] for r in moved.collect()} == want


def test_the_later_of_both_ends_wins(spark):
    names = ["K", "L", "S", "T", "R"]
    e = spark.createDataFrame([("Pep:l", "R", "Pep:s", "X", None, None, {}), ("Pep:k", "R", "Pep:t", "Y", None, None, {})], EDGE)
    e = g.as_edges(e)
    merges = spark.createDataFrame([("Pep:k", "Pep:l", "Pep:k", "Pep:l"), ("Pep:r", "Pep:s", "Pep:r", "Pep:s"), ("Pep:r", "Pep:t", "Pep:r", "Pep:t")], "a string, b string, keep string, drop string")
    _, moved = fu.merge_nodes(nodes_of(spark, *[node("Pep", n) for n in names]), e, merges)
    assert rows(moved, "src", "dst", "source") == [("Pep:k", "Pep:r", "Y")]


def test_blocks_that_are_too_large_are_listed(spark):
    n = nodes_of(spark, *[node("Pep", f"common u{i}") for i in range(6)])
    assert rows(fu.skipped_blocks(n, 5)) == [("Pep", "common", 6)] and fu.block_pairs(n, 5).count() == 0


def test_edges_of_one_item_stay_in_order_past_a_million(spark):
    e = spark.createDataFrame([("a", "R", "b", "late", 1, 0), ("a", "R", "b", "early", 0, 2_000_000)], "src string, rel string, dst string, source string, seq bigint, pos bigint")
    assert rows(upsert.upsert_edges(g.as_edges(e.limit(0)), e), "source") == [("late",)]



def test_null_references_and_statuses_are_reported(spark):
    n = nodes_of(spark, node("Pep", "A"))
    refs = spark.createDataFrame([(None,), ("A",), ("Pep:A",), ("Pep:zz",)], "ref string")
    assert rows(resolve.resolve_any(refs, n)) == [("A", "Pep:a", 1, "found"), ("Pep:A", "Pep:a", 1, "found"), ("Pep:zz", None, 0, "not_found"), (None, None, 0, "not_found")]
    d = al.decide_lines(lines_of(spark, [("A", "x", 1, None, DAY), ("B", "x", 1, "paid", DAY)]), lots_of(spark, [("x", "l", 5)]), refs_of(spark))
    assert rows(d, "order_id", "outcome") == [("A", "unknown"), ("B", "sold")]
    assert rows(al.order_outcomes(d)) == [("A", "blocked"), ("B", "recorded")]
    mixed = lines_of(spark, [("A", "x", 1, None, DAY), ("A", "y", 1, "paid", DAY)])
    assert al.orders_to_mark(mixed, refs_of(spark, ["order A x", "order A y"])).count() == 0


def test_null_types_and_unknown_seeds_are_reported(spark):
    n = nodes_of(spark, node("Customer", "A"))
    lost = n.withColumns({"id": F.lit("x"), "type": F.lit(None).cast("string")})
    assert ("x", None, "unknown_type") in rows(validate.check_nodes(n.unionByName(lost), gv.ONTOLOGY), "id", "attr", "issue")
    recipe = next(iter(gv.ONTOLOGY.recipes.values()))
    seeds = spark.createDataFrame([("nobody",)], "id string")
    none = spark.createDataFrame([], "src string, rel string, dst string")
    assert rows(serve.context(seeds, n, none, gv.ONTOLOGY, recipe).refused, "seed", "type") == [("nobody", None)]


def test_long_keys_and_texts_stay_whole(spark):
    ids = spark.createDataFrame([(12_345_678_901,), (123,)], "k bigint").select(gv.numbered_id("Customer", "k").alias("id"))
    assert rows(ids) == [("Customer:customer000000123",), ("Customer:customer12345678901",)]
    text = "x" * 1_500_000
    assert spark.createDataFrame([(text,)], "t string").select(F.length(first_upper("t"))).first()[0] == len(text)


def test_a_billion_units_are_sold_without_a_row_for_each(spark):
    big = 1_000_000_000
    lots = lots_of(spark, [("x", "a", big, dt.date(2026, 1, 1)), ("x", "b", big, dt.date(2027, 1, 1))])
    events, _ = events_of(spark, [("A", "x", big + 5, "paid", DAY), ("B", "x", 7, "paid", DAY + dt.timedelta(1))], lots)
    assert events == [("IE-0001", float(big), "a", "order A x"), ("IE-0002", 5.0, "b", "order A x lot b"), ("IE-0003", 7.0, "b", "order B x")]
