"""How much a query reads and makes when its input grows: rows of its steps."""

from conftest import rows
from test_graph import ONTO, catalogue, edges_of, node, nodes_of

from stockweave.operators import catalog as c, fusion as fu, serve



def most_rows(df):
    """The most rows that one step of a finished query gave."""
    def walk(plan):
        name, metrics = plan.getClass().getSimpleName(), plan.metrics()
        inner = "executedPlan" if name == "AdaptiveSparkPlanExec" else "plan" if name.endswith("QueryStageExec") else None
        kids = [getattr(plan, inner)()] if inner else [plan.children().apply(i) for i in range(plan.children().size())]
        own = metrics.apply("numOutputRows").value() if metrics.contains("numOutputRows") else 0
        return max([own, *map(walk, kids)])

    return walk(df._jdf.queryExecution().executedPlan())


def test_terms_that_begin_alike_are_not_met_with_every_text(spark):
    """Terms and texts that share all their three-letter pieces with hundreds of others."""
    names = [f"x-{n * 2654435761 % 2**24:024b}" for n in range(1500)]
    docs = spark.createDataFrame([(n, str(i), *[None] * 4) for i, n in enumerate(names)], "name string, sku string, family_name string, size_label string, composition_class string, composition_line string")
    long = names[5] * 4
    docs = docs.unionByName(docs.limit(0).union(spark.createDataFrame([(long, "long", *[None] * 4)], docs.schema)))
    asked = [*names, long, long[:-1] + "2", "01", "c", "zz", "-", None]
    found = c.search_terms(docs, spark.createDataFrame([(t,) for t in asked], "term string"))
    got = rows(found)
    texts = {r[0]: r[1] for r in docs.select("sku", c.fold(c.searched_text())).collect()}
    fold = {t: t.replace("-", "") for t in asked if t}
    assert got == sorted(((t, s) for t, w in fold.items() for s, x in texts.items() if w and w in x), key=repr)
    assert most_rows(found) < 200_000  # places of all texts; pairs that share their rarest pieces are over a million


def test_scores_gather_only_the_neighbours_of_the_pairs(spark, monkeypatch):
    """Edges of nodes without a pair are left out before anything is met."""
    written, write = {}, fu.materialize

    def told(df, label="step"):
        out = write(df, label)
        written[label] = out.count()
        return out

    monkeypatch.setattr(fu, "materialize", told)
    n = nodes_of(spark, node("Pep", "x y"), node("Pep", "x z"))
    e = edges_of(spark, ("Pep:xy", "R", "t1"), ("Pep:xz", "R", "t1"), *[(f"Pep:u{i}", "R", "t1") for i in range(200)])
    got = fu.score_pairs(spark.createDataFrame([("Pep:xy", "Pep:xz")], "a string, b string"), n, e).first()
    assert got["reasons"] == ["token overlap", "shared neighbours"] and written["neighbours"] == 2


def test_lines_of_bundles_are_made_once_and_large_bundles_are_cut_into_slices(spark, monkeypatch):
    n, e = catalogue(spark)
    n, e = n.unionByName(nodes_of(spark, *[node("Pep", f"n{i}") for i in range(30)])), e.unionByName(edges_of(spark, *[("Prod:a", "CONTAINS", f"Pep:n{i}") for i in range(30)] * 2))
    recipe = ONTO.recipes["page"]
    ctx = serve.context(n.filter("id IN ('Prod:a', 'Prod:gone')"), n, e, ONTO, recipe, lines=True)
    told = lambda c, most: serve.context_lines(c, n, e, ONTO, recipe, "page", max_lines=most)
    whole = told(ctx, 300)
    assert whole._jdf.queryExecution().optimizedPlan().toString().count("RepartitionByExpression [seed") == 1
    plain = rows(whole)
    assert rows(told(serve.Context(ctx.nodes, ctx.edges, ctx.refused), 300)) == plain and len(plain) == len(set(plain))
    monkeypatch.setattr(serve, "SLICE_ROWS", 7)
    assert rows(told(ctx, 300)) == plain
    for most in (5, 40):
        full = [r for r in plain if r[1] <= most]
        omitted = {seed: sum(r[0] == seed for r in plain) - most for seed in ("Prod:a", "Prod:gone")}
        assert rows(told(ctx, most)) == sorted(full + [(s, most + 1, f"# {m} lines omitted") for s, m in omitted.items() if m > 0], key=repr)


def test_paths_pair_only_kinds_that_are_linked(spark, monkeypatch):
    """Twenty orders of a customer never touch twenty suppliers of a part; only the nation's side is probed."""
    from stockweave.operators import paths
    links = [("N:1", "HAS", "C:1"), ("N:1", "HAS", "S:0")]
    links += [(f"O:{i}", "BY", "C:1") for i in range(20)] + [("P:1", "FROM", f"S:{i}") for i in range(20)]
    links += [(f"O:{i}", "HOLDS", f"L:{i} {j}") for i in range(20) for j in range(30)]
    sizes, write = [], paths.materialize

    def counted(df, label="step"):
        out = write(df, label)
        if label == "path-ends":
            sizes.append(out.count())
        return out

    monkeypatch.setattr(paths, "materialize", counted)
    found = paths.shortest_paths(spark.createDataFrame([("C:1", "P:1")], "a string, b string"), spark.createDataFrame(links, "src string, rel string, dst string")).collect()
    assert [(r["hops"], [s["node"] for s in r["path"]]) for r in found] == [(3, ["N:1", "S:0", "P:1"])]
    assert max(sizes) <= 40, sizes
