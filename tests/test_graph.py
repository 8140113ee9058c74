import random

import pytest
from conftest import rows
from pyspark.sql import functions as F

from stockweave.functions import keys
from stockweave.functions.values import plain
from stockweave.operators import gate, graph as g, paths, resolve as rs, serve, upsert, validate
from stockweave.operators.ontology import Attr, Ontology, Recipe, Relation, Step

ONTO = Ontology(
    types={"Pep": {"mw": Attr("number"), "class": Attr(), "pub": Attr("boolean"), "kinds": Attr("list"), "day": Attr("date"), "grade": Attr("string", ("a", "b")), "cost": Attr("number", internal=True)},
           "Prod": {"scope": Attr("list")}, "Sup": {}, "Rule": {"scope": Attr("list"), "text": Attr(), "severity": Attr()}},
    relations={"CONTAINS": Relation(("Prod",), ("Pep",)), "LINKS": Relation(("Pep",), ("Pep",)), "BOUGHT_FROM": Relation(("Prod",), ("Sup",), internal=True)},
    recipes={"page": Recipe(("Prod",), (Step("CONTAINS", "out", ("Prod",)), Step("CONTAINS", "in", ("Pep",)), Step("BOUGHT_FROM", "out"), Step("LINKS", "out", (), ("Pep",))), (("Rule", "page"),))})
NODE = "id string, type string, name string, attrs map<string,string>, aliases array<string>, source string, confidence string, valid_to string"


def node(type_, name, attrs=None, aliases=(), source="s", confidence="medium", valid_to=None):
    key = "".join(ch for ch in name.lower() if ch.isascii() and ch.isalnum())
    return (f"{type_}:{key}", type_, name, attrs or {}, list(aliases), source, confidence, valid_to)


def nodes_of(spark, *specs):
    return g.as_nodes(spark.createDataFrame(list(specs), NODE))


def edges_of(spark, *specs):
    return g.as_edges(spark.createDataFrame(list(specs), "src string, rel string, dst string"))


def records_of(spark, *specs):
    data = [(i, t, n, a, al, s, c) for i, (t, n, a, al, s, c) in enumerate(specs)]
    df = spark.createDataFrame(data, "seq bigint, type string, name string, attrs map<string,string>, aliases array<string>, source string, confidence string")
    return df.select("*", F.lit(None).cast("string").alias("valid_from"), F.lit(None).cast("string").alias("valid_to"), F.lit(None).cast("timestamp").alias("seen_at"))


def test_keys_drop_other_letters_and_refs_split_at_the_first_colon(spark):
    df = spark.createDataFrame([("Monārch NAD+",), ("A: b:c ",), ("++",)], "x string")
    got = [tuple(r) for r in df.select(keys.norm_key("x"), keys.ref_type("x"), keys.ref_name("x"), keys.tokens("x")).collect()]
    assert got == [("monrchnad", None, None, ["mon", "rch", "nad"]), ("abc", "A", "b:c", ["a", "b", "c"]), ("", None, None, [])]


def test_resolution_prefers_canonical_then_alias_of_the_type(spark):
    n = nodes_of(spark, node("Pep", "X 1", aliases=["Y2"]), node("Pep", "Y2"), node("Prod", "Z", aliases=["X1", "only"]))
    refs = spark.createDataFrame([("Pep:y-2",), ("Prod:x 1",), ("Sup:x1",), ("x1",), ("ONLY",), ("none",)], "ref string")
    got = {r["ref"]: (r["node_id"], r["status"]) for r in rs.resolve_any(refs, n).collect()}
    assert got == {"Pep:y-2": ("Pep:y2", "found"), "Prod:x 1": ("Prod:z", "found"), "Sup:x1": (None, "not_found"), "x1": (None, "ambiguous"),
                   "ONLY": ("Prod:z", "found"), "none": (None, "not_found")}
    assert rows(rs.candidates_of(refs, n)) == [("ONLY", "Prod:z"), ("x1", "Pep:x1"), ("x1", "Prod:z")]


def test_records_land_on_aliases_established_earlier_in_the_run(spark):
    none = g.as_nodes(spark.createDataFrame([], "id string"))
    r = records_of(spark, ("Pep", "Early", {}, [], "a", "low"), ("Pep", "Main", {}, ["Early", "Second"], "a", "low"), ("Pep", "second", {}, ["Third"], "b", "high"),
                   ("Pep", "THIRD", {"k": '"v"'}, [], "c", "low"), ("Sup", "Second", {}, [], "a", "low"))
    f = upsert.upsert_nodes(none, r)
    assert rows(f.nodes, "id", "name", "source", "confidence") == [("Pep:early", "Early", "a", "low"), ("Pep:main", "Main", "a", "high"), ("Sup:second", "Second", "a", "low")]
    assert rows(f.attrs) == [("Pep:main", "k", '"v"')]
    assert rows(f.aliases) == [("Pep:main", "Early"), ("Pep:main", "Second"), ("Pep:main", "THIRD"), ("Pep:main", "Third"), ("Pep:main", "second")]


def plain_fold(writes, held):
    """writes: (source, attrs) in order; returns values and conflict value lists per attribute."""
    owner, values, lists = None, {}, {k: list(v) for k, v in held.items()}
    for source, attrs in writes:
        owner = owner or source
        for k, v in attrs.items():
            if k not in values or values[k] == v or source == owner:
                values[k] = v
            else:
                seen = lists.setdefault(k, [values[k]])
                if v not in seen:
                    seen.append(v)
    return values, lists


def test_attribute_fold_equals_a_plain_replay(spark):
    rng = random.Random(5)
    specs, per = [], {}
    for i in range(400):
        name, source = f"n{rng.randrange(25)}", rng.choice("abc")
        attrs = {k: rng.choice(["1", "1.0", "2", "null", '"x"']) for k in rng.sample("pq", rng.randrange(0, 3))}
        specs.append(("Pep", name, attrs, [], source, "low"))
        per.setdefault(f"Pep:{name}", []).append((source, {k: {"1": "1.0", "2": "2.0"}.get(v, v) for k, v in attrs.items()}))
    none = g.as_nodes(spark.createDataFrame([], "id string"))
    first, rest = specs[:250], specs[250:]
    f = upsert.upsert_nodes(none, records_of(spark, *specs))
    assert {(r["id"], r["attr"]): r["value"] for r in f.attrs.collect()} == {(i, k): v for i, w in per.items() for k, v in plain_fold(w, {})[0].items()}
    want = {(i, k): v for i, w in per.items() for k, v in plain_fold(w, {})[1].items()}
    listed = lambda c: {(r["id"], r["attr"]): list(r["l"]) for r in c.groupBy("id", "attr").agg(F.transform(F.array_sort(F.collect_list(F.struct("seq", "value"))), lambda s: s["value"]).alias("l")).collect()}
    assert listed(f.conflicts) == want
    # The same in two runs: the second folds into what the first left.
    one = upsert.upsert_nodes(none, records_of(spark, *first))
    two = upsert.upsert_nodes(upsert.assemble(one), records_of(spark, *rest), one.conflicts)
    assert rows(two.attrs) == rows(f.attrs)
    assert {k: sorted(v) for k, v in listed(two.conflicts).items()} == {k: sorted(v) for k, v in want.items()}


def test_edges_keep_old_evidence_and_take_the_last_writer(spark):
    e = spark.createDataFrame([("a", "R", "b", "s1", "why", "2024")], "src string, rel string, dst string, source string, evidence string, valid_from string")
    new = spark.createDataFrame([("a", "R", "b", 1, "s2", None, "2025"), ("a", "R", "b", 2, "s3", None, None)], "src string, rel string, dst string, seq bigint, source string, evidence string, valid_from string")
    assert rows(upsert.upsert_edges(e, new), "source", "evidence", "valid_from") == [("s3", "why", "2025")]


def test_strict_ingest_commits_nothing_on_error(spark):
    n, e = nodes_of(spark, node("Pep", "Old")), edges_of(spark)
    edge = "array<struct<rel:string,to:string,attrs:map<string,string>,source:string,confidence:string,evidence:string,valid_from:string,valid_to:string>>"
    r = records_of(spark, ("Prod", "P", {}, [], "f", "low"), ("Pep", "Q", {}, [], "f", "low")).withColumn(
        "edges", F.when(F.col("name") == "P", F.array(*[F.struct(F.lit("CONTAINS").alias("rel"), F.lit(t).alias("to"), *[F.lit(None).alias(c) for c in ("attrs", "source", "confidence", "evidence", "valid_from", "valid_to")])
                                                        for t in ("Pep:q", "Pep:zz")])).cast(edge))
    r = r.withColumn("edges", F.coalesce("edges", F.array().cast(edge)))
    strict = upsert.ingest(r, n, e, ONTO)
    assert not strict.committed and rows(strict.nodes, "id") == [("Pep:old",)] and rows(strict.edges, "src") == []
    assert rows(strict.errors, "item", "target", "error") == [("P", "Pep:zz", "target_not_found")]
    loose = upsert.ingest(r, n, e, ONTO, strict=False)
    assert loose.committed and rows(loose.edges, "src", "dst") == [("Prod:p", "Pep:q")]


def test_value_checks(spark):
    attrs = {"mw": "true", "pub": '"true"', "kinds": '"a"', "day": '"2024-02-30"', "grade": '"c"', "colour": "1", "cost": "null"}
    n = nodes_of(spark, node("Pep", "A", attrs), node("Pep", "B", {"mw": '"5"', "pub": "false", "kinds": "[]", "day": '"2024-02-29"', "grade": '"a"'}), node("Odd", "C", {"x": "1"}))
    assert rows(validate.check_nodes(n, ONTO)) == [("Odd:c", None, "unknown_type"), ("Pep:a", "colour", "unknown_attr"), ("Pep:a", "cost", "number"), ("Pep:a", "day", "date"),
                                                   ("Pep:a", "grade", "enum"), ("Pep:a", "kinds", "list"), ("Pep:a", "pub", "boolean"), ("Pep:b", "mw", "number")]


def test_edge_checks_report_the_first_fault(spark):
    n = nodes_of(spark, node("Prod", "P"), node("Pep", "Q"))
    e = edges_of(spark, ("Prod:p", "CONTAINS", "Pep:q"), ("Pep:q", "CONTAINS", "Prod:p"), ("Prod:p", "CONTAINS", "Prod:p"), ("Pep:q", "OWNS", "Prod:p"), ("Pep:q", "OWNS", "Pep:zz"))
    assert rows(validate.check_edges(e, n, ONTO), "src", "rel", "dst", "issue") == [
        ("Pep:q", "CONTAINS", "Prod:p", "domain"), ("Pep:q", "OWNS", "Pep:zz", "dangling"), ("Pep:q", "OWNS", "Prod:p", "unknown_relation"), ("Prod:p", "CONTAINS", "Prod:p", "range")]


def catalogue(spark):
    n = nodes_of(spark, node("Prod", "A", {"scope": '["x"]'}), node("Prod", "B"), node("Prod", "Gone", valid_to="2999-01-01"), node("Pep", "Q", {"cost": "5", "class": '"c"'}), node("Pep", "R"), node("Sup", "S"),
                 node("Rule", "r1", {"scope": '["page"]', "text": '"Be plain."', "severity": '"hard"'}), node("Rule", "r2", {"scope": '["all"]'}), node("Rule", "r3", {"scope": '["faq"]'}))
    e = edges_of(spark, ("Prod:a", "CONTAINS", "Pep:q"), ("Prod:b", "CONTAINS", "Pep:q"), ("Prod:gone", "CONTAINS", "Pep:q"), ("Prod:a", "BOUGHT_FROM", "Sup:s"), ("Pep:q", "LINKS", "Pep:r"), ("Pep:r", "LINKS", "Pep:r"))
    return n, e


def test_recipe_expands_everything_collected_and_skips_internal_and_superseded(spark):
    n, e = catalogue(spark)
    c = serve.context(n.filter("id IN ('Prod:a', 'Prod:gone', 'Sup:s')"), n, e, ONTO, ONTO.recipes["page"])
    assert rows(c.nodes, "seed", "id") == [("Prod:a", "Pep:q"), ("Prod:a", "Pep:r"), ("Prod:a", "Prod:a"), ("Prod:a", "Prod:b"),
                                           ("Prod:gone", "Pep:q"), ("Prod:gone", "Pep:r"), ("Prod:gone", "Prod:a"), ("Prod:gone", "Prod:b"), ("Prod:gone", "Prod:gone")]
    assert rows(c.edges.filter("seed = 'Prod:a'"), "src", "rel", "dst") == [("Pep:q", "LINKS", "Pep:r"), ("Prod:a", "CONTAINS", "Pep:q"), ("Prod:b", "CONTAINS", "Pep:q")]
    assert rows(c.refused, "seed") == [("Sup:s",)]
    lines = serve.context_lines(c, n, e, ONTO, ONTO.recipes["page"], "page").filter("seed = 'Prod:a'").orderBy("line_no").collect()
    text = [r["text"] for r in lines]
    assert text[0] == "# CONTEXT recipe=page seed=Prod:a (4 nodes, 3 edges, 2 rules)" and text[2].startswith("## Prod: A") and text[-3:] == ["## Rules in scope", "- Rule r1 [hard]: Be plain.", "- Rule r2 []: "]
    assert "  class=c" in text and not any("cost" in t for t in text)
    stock = spark.createDataFrame([("Prod:b", 1, "- B: 3"), ("Prod:b", 0, "- B")], "id string, place bigint, stock_line string")
    summed = Ontology(ONTO.types, ONTO.relations, {"page": Recipe(("Prod",), ONTO.recipes["page"].steps, stock_summary=True)})
    more = serve.context_lines(c, n, e, summed, summed.recipes["page"], "page", stock=stock).filter("seed = 'Prod:a'").orderBy("line_no").collect()
    assert [r["text"] for r in more][-3:] == ["## Stock summary (derived from the stock ledger)", "- B", "- B: 3"]
    short = serve.context_lines(c, n, e, ONTO, ONTO.recipes["page"], "page", max_lines=4).filter("seed = 'Prod:a'").orderBy("line_no").collect()
    assert [r["text"] for r in short] == text[:4] + [f"# {len(text) - 4} lines omitted"]


def test_attribute_queries_and_cards(spark):
    n, e = catalogue(spark)
    ids = lambda where, t="Rule": [r[0] for r in rows(serve.query(n, t, where), "name")]
    assert ids({"scope": "page"}) == ["r1", "r2"] and ids({"severity": "HARD"}) == ["r1"] and ids({"severity": "none"}) == ["r2", "r3"]
    assert ids({"class": "C"}, "Pep") == ["Q"]
    card = serve.cards(spark.createDataFrame([("Pep:r",), ("zz",)], "ref string"), n, e)
    assert rows(card, "ref", "section", "other_name") == [("Pep:r", "head", None), ("Pep:r", "in", "Q"), ("Pep:r", "in", "R"), ("Pep:r", "out", "R"), ("zz", "not_found", None)]
    assert rows(serve.siblings(n.filter("id = 'Prod:a'"), e, "CONTAINS", n.filter("valid_to IS NULL"))) == [("Prod:a", "Prod:b")]


@pytest.mark.parametrize("max_hops", [3, 4, 6])
def test_paths_equal_breadth_first_search(spark, max_hops):
    rng = random.Random(max_hops)
    names = [f"n{i:02}" for i in range(40)]
    links = {(rng.choice(names), rng.choice("RS"), rng.choice(names)) for _ in range(38)} | {("n00", "H", x) for x in names[25:]}
    near = {x: set() for x in names}
    for a, _, b in links:
        near[a].add(b), near[b].add(a)

    def hops(a, b):
        ring, seen, d = {a}, {a}, 0
        while ring and b not in ring and d < max_hops:
            ring = {y for x in ring for y in near[x]} - seen
            seen |= ring
            d += 1
        return d if b in ring else None

    pairs = [(rng.choice(names), rng.choice(names)) for _ in range(80)] + [("n00", "n00"), ("n01", "missing")]
    near["missing"] = set()
    out = paths.path_text(paths.shortest_paths(spark.createDataFrame(pairs, "a string, b string"), edges_of(spark, *links), max_hops)).collect()
    assert {(r["a"], r["b"]): r["hops"] for r in out} == {p: hops(*p) for p in set(pairs)}
    for r in out:
        if r["path"] is None:
            assert r["text"] == "no path"
            continue
        at = r["a"]
        for s in r["path"]:
            assert ((at, s["rel"], s["node"]) if s["dir"] == "out" else (s["node"], s["rel"], at)) in links
            at = s["node"]
        assert at == r["b"] and len(r["path"]) == r["hops"]


def test_gate_refuses_until_precise_and_scored(spark):
    n, e = nodes_of(spark, node("Pep", "Held", aliases=["Alias"])), edges_of(spark)
    ents = spark.createDataFrame([(1, "Pep", "alias", "ALIAS!", {"mw": "1", "zz": "2"}), (1, "Prod", "New", "New", {}), (1, "Odd", "X", "X", {}), (2, "Pep", "Held", "Held", {})],
                                 "chunk_id int, type string, canonical string, surface string, attrs map<string,string>").withColumns({"evidence": F.lit("e"), "confidence": F.lit(None).cast("string")})
    rels = spark.createDataFrame([(1, "Prod:New", "CONTAINS", "Pep:Held"), (2, "Prod:New", "CONTAINS", "Pep:Held"), (1, "Pep:Held", "CONTAINS", "Prod:New"), (1, "New", "CONTAINS", "Pep:Held")],
                                 "chunk_id int, src string, rel string, dst string").withColumns({"attrs": F.create_map().cast("map<string,string>"), "evidence": F.lit("e"), "confidence": F.lit("low")})
    adm = gate.admit_extractions(ents, rels, n, ONTO)
    assert tuple(gate.admission_counts(adm).first()) == (3, 1, 4)
    assert rows(adm.staged.filter("kind = 'node' AND chunk_id = 1"), "canonical", "resolved_to", F.map_keys("attrs")) == [("Held", "Pep:held", ["mw"]), ("New", None, [])]
    pending = gate.number_staged(adm.staged)
    scored = spark.createDataFrame([(1000 + i, "node", "accepted" if i < 18 else "rejected") for i in range(20)], "id bigint, kind string, status string")
    staging = pending.unionByName(scored, allowMissingColumns=True)
    few = pending.unionByName(scored.limit(19), allowMissingColumns=True)
    assert not gate.accept(few, n, e, ONTO).opened
    done = gate.accept(staging, n, e, ONTO)
    assert done.opened and rows(done.loaded.edges, "src", "rel", "dst") == [("Prod:new", "CONTAINS", "Pep:held")]
    assert done.staging.filter("status = 'pending'").isEmpty()
    some = gate.accept(few, n, e, ONTO, ids=pending.filter("kind = 'edge'"))
    assert some.opened and rows(some.loaded.errors, "error") == [("target_not_found",)] and some.staging.filter("status = 'pending'").count() == 3
    assert gate.sample_pending(staging, 2, 7).collect() == gate.sample_pending(staging, 2, 7).collect()


def test_a_table_of_conditions_gives_what_single_queries_give(spark):
    n = nodes_of(spark, node("Pep", "A", {"class": '"Small"', "scope": '["x"]', "size": "5"}), node("Pep", "B", {"class": '"small"', "scope": '["all"]'}),
                 node("Pep", "C", {"class": "null", "scope": '["y","None"]', "size": '"5"'}), node("Pep", "D", {"scope": '"x"'}), node("Sup", "E", {"class": '"small"'}))
    asked = {"q1": ("Pep", {"class": "SMALL"}), "q2": ("Pep", {"class": "small", "scope": "x"}), "q3": ("Pep", {"class": "none"}), "q4": ("Pep", {"size": "5", "scope": "y"}),
             "q5": ("Pep", {"size": "None", "class": "small"}), "q6": ("Sup", {"class": "small", "size": "none"}), "q7": ("Pep", {"size": "6"}), "q8": ("Pep", {"scope": "None"}), "q9": ("Pep", {"scope": "x"})}
    table = spark.createDataFrame([(q, t, a, w) for q, (t, where) in asked.items() for a, w in where.items()] * 2, "query string, type string, attr string, want string")
    want = sorted((q, r["id"]) for q, (t, where) in asked.items() for r in serve.query(n, t, where).collect())
    assert rows(serve.query_all(n, table)) == want
