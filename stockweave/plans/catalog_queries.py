"""Catalogue build, diff, platform sync, product facts and search over parts seen as made-up products."""

from __future__ import annotations

from pyspark.sql import functions as F

from stockweave.functions.runtime import materialize
from stockweave.functions.text import fold
from stockweave.operators import catalog as c
from stockweave.plans import views as v
from stockweave.plans.gap_queries import features
from stockweave.plans.registry import query
from stockweave.plans.stock_queries import STOCK, lot_stock, product_stock
from stockweave.sources import exports

US_LABS, FORMATS = ["lab-us"], ["square", "portrait"]


def K():
    return F.col("p_partkey")


def T():
    return K().cast("string")


def _cmp(number):
    return F.concat(F.lit("cmp"), number.cast("bigint").cast("string"))


def products(spark, sf):
    """Parts with the facts of a catalogue product; keys decide which facts are present."""
    tenth, size = F.col("p_size") % 10, F.col("p_size").cast("double")
    none = F.lit(None).cast("string")
    return v.table(spark, sf, "part").select(
        T().alias("product_id"), T().alias("sku"),
        F.concat("p_name", F.lit(" "), _cmp(F.floor(K() / 4)), F.lit(" "), F.col("p_size").cast("string"), F.lit("mg")).alias("name"),
        F.when(tenth < 7, "active").when(tenth < 9, "coming_soon").otherwise("draft").alias("status"),
        F.when(F.col("p_size") % 4 == 0, "just_in_time").otherwise("stocked").alias("fulfilment"),
        F.when(K() % 10 != 0, F.lower("p_type")).alias("form"), F.when(K() % 5 != 0, size).alias("size_mg"), F.when(K() % 5 == 0, size).alias("size_ml"),
        F.col("p_retailprice").alias("price_usd"), F.when(K() % 4 == 0, ">=99%").alias("purity_spec"), F.concat(F.lit("p-"), T()).alias("slug"),
        F.when(K() % 9 == 0, F.concat(F.lit("Kit "), T())).alias("display_name"), F.when(K() % 8 == 0, F.concat(F.lit("x"), T())).otherwise(none).alias("external_id"),
        F.when(K() % 13 == 0, "accessory").otherwise("peptide").alias("category"), F.when(K() % 6 != 0, F.col("p_brand")).alias("research_area"),
        F.when(K() % 2 == 0, F.lit(3.0)).alias("vial_ml"), F.when(K() % 4 == 0, "amber").otherwise("clear").alias("vial_glass"))


def contains(spark, sf):
    """Four neighbouring parts share a component; every third part is a blend with the next one."""
    size = F.col("p_size").cast("double")
    part = v.table(spark, sf, "part")
    first = part.select(T().alias("product_id"), _cmp(F.floor(K() / 4)).alias("component_id"), F.lit(0).alias("pos"), F.when(K() % 2 == 0, size).alias("amount_mg"))
    second = part.filter(K() % 3 == 0).select(T().alias("product_id"), _cmp(F.floor(K() / 4) + 1).alias("component_id"), F.lit(1).alias("pos"), (size * 2).alias("amount_mg"))
    return first.unionByName(second)


def components(spark, sf):
    n = F.floor(K() / 4)
    ids = v.table(spark, sf, "part").select(F.explode(F.array(n, n + 1)).alias("n")).distinct()
    n, text = F.col("n"), F.col("n").cast("string")
    return ids.select(
        _cmp(n).alias("component_id"), _cmp(n).alias("component_name"), F.when(n % 2 == 0, F.concat(F.lit("Summary of cmp"), text, F.lit("."))).alias("summary"),
        F.when(n % 3 == 0, "small peptide").alias("class"), F.when(n % 3 == 1, "solvent").alias("kind"), F.when(n % 4 == 0, "AAA").alias("sequence"),
        F.when(n % 5 == 0, "C2H6").alias("molecular_formula"), (n % 7 + 0.5).cast("double").alias("molecular_weight"),
        F.when(n % 6 == 0, F.concat(F.lit("CAS-"), text)).alias("cas_number"), F.when(n % 2 == 0, "white powder").otherwise("clear liquid").alias("appearance"))


def photos(spark, sf):
    shape = F.when(K() % 2 == 0, "square").otherwise("portrait")
    one = v.table(spark, sf, "part").filter(K() % 3 != 0).select(T().alias("product_id"), K().alias("photo_id"), shape.alias("format"), F.concat(F.lit("/img/"), T()).alias("url"))
    again = one.filter(F.col("photo_id") % 5 == 0).withColumns({"photo_id": F.col("photo_id") + 1_000_000_000, "url": F.concat("url", F.lit("-new"))})
    return one.unionByName(again)


def subject(spark, sf):
    """What a document is about: a product when its id is even, else a component."""
    n = v.table(spark, sf, "part").count()
    k = F.col("doc_id") % n
    return F.when(F.col("doc_id") % 2 == 0, k.cast("string")).otherwise(_cmp(F.floor(k / 4)))


def documents(spark, sf, third):
    d = v.table(spark, sf, "documents").select("doc_id", "lang").filter(F.col("doc_id") % 3 == third)
    j = d.join(v.table(spark, sf, "labels"), "doc_id", "left")
    status = F.when(F.col("quality") == 1, "approved").when(F.col("quality") == 0, "prohibited").otherwise("pending")
    scope = F.when(F.col("lang") == "en", F.array(F.lit("product_page"))).when(F.col("lang") == "de", F.array(F.lit("all"))).otherwise(F.array(F.lit("faq")))
    return j.select("doc_id", status.alias("status"), scope.alias("scope"), (F.col("toxic") == 0).alias("verified"), subject(spark, sf).alias("subject"))


def items(spark, sf):
    return c.catalog_snapshot(products(spark, sf), contains(spark, sf), components(spark, sf), product_stock(spark, sf))


def remote(old):
    """The catalogue ``old`` as a platform holds it: some items missing, some changed, some left over, one key twice."""
    k = F.col("sku").cast("bigint")
    kept = old.filter(k % 10 != 0).withColumns({
        "price_usd": F.when(k % 7 == 0, F.col("price_usd") + 1).otherwise(F.col("price_usd")), "name": F.when(k % 11 != 0, F.col("name")),
        "external_id": F.concat(F.lit("r"), "sku"), "seq": F.lit(2)})
    left = old.filter(k % 100 == 0).withColumns({"sku": F.concat(F.lit("old-"), "sku"), "seq": F.lit(1)})
    stale = old.filter(k % 17 == 3).filter(k % 10 != 0).withColumns({"name": F.lit("stale"), "seq": F.lit(1)})
    return kept.unionByName(left).unionByName(stale)


PROD = f"""{STOCK}, prod AS (SELECT p_partkey AS k, CAST(p_partkey AS VARCHAR) AS sku, p_name, p_size AS s, CAST(p_size AS VARCHAR) AS st, p_retailprice AS price_usd,
    p_name || ' cmp' || p_partkey // 4 || ' ' || p_size || 'mg' AS name, p_partkey // 4 AS n1, p_partkey // 4 + 1 AS n2, 'cmp' || p_partkey // 4 AS c1, 'cmp' || (p_partkey // 4 + 1) AS c2,
    p_partkey % 3 = 0 AS blend, CASE WHEN p_partkey % 10 <> 0 THEN lower(p_type) END AS form, p_size || CASE WHEN p_partkey % 5 <> 0 THEN 'mg' ELSE 'ml' END AS tag,
    p_size || CASE WHEN p_partkey % 5 <> 0 THEN ' mg' ELSE ' ml' END AS size, CASE WHEN p_partkey % 9 = 0 THEN 'Kit ' || p_partkey END AS display_name,
    CASE WHEN p_partkey % 13 = 0 THEN 'accessory' ELSE 'peptide' END AS category, p_brand, t.status, t.fulfilment, t.on_hand
  FROM part JOIN stock t USING (p_partkey))"""
ITEMS = f"""{PROD}, items AS (SELECT sku, k, name, CASE WHEN blend THEN c1 || ' / ' || c2 ELSE c1 END AS family, CASE WHEN blend THEN tag ELSE trim(replace(name, c1, '')) END AS variant,
    price_usd, status, on_hand AS quantity, coalesce(form, '') AS form, CAST(s AS DOUBLE) AS size_mg, 'p-' || sku AS slug,
    concat_ws(' ', CASE WHEN blend THEN 'Composition per vial: ' || c2 || ' ' || s * 2 || ' mg, ' || c1 || CASE WHEN k % 2 = 0 THEN ' ' || st || ' mg' ELSE '' END || '.' END,
      CASE WHEN n1 % 2 = 0 THEN 'Summary of cmp' || n1 || '.' END, CASE WHEN blend AND n2 % 2 = 0 THEN 'Summary of cmp' || n2 || '.' END,
      'Supplied as ' || coalesce(form, '{c.DEFAULT_FORM}') || ', ' || size || ' per vial' || CASE WHEN k % 4 = 0 THEN ', tested to a purity specification of ≥99%' ELSE '' END || '.', '{c.CLOSING_LINE}') AS description,
    CASE WHEN k % 8 = 0 THEN 'x' || sku END AS external_id, fulfilment, display_name FROM prod WHERE status IN ('active', 'coming_soon'))"""
DIFF = f"""{ITEMS}, diff AS (SELECT sku, CASE WHEN k % 10 = 0 THEN 'create' WHEN k % 7 = 0 OR k % 11 = 0 THEN 'update' ELSE 'unchanged' END AS action FROM items
  UNION ALL SELECT 'old-' || sku, 'orphan' FROM items WHERE k % 100 = 0)"""


@query("catalog_snapshot", f"WITH {ITEMS} SELECT * EXCLUDE (k) FROM items")
def _snapshot(spark, sf):
    return items(spark, sf)


@query("catalog_diff", f"WITH {DIFF} SELECT * FROM diff")
def _diff(spark, sf):
    local = materialize(items(spark, sf), "items")
    return c.catalog_diff(local, remote(local)).select("sku", "action")


@query("catalog_changes", f"WITH {DIFF} SELECT * FROM diff WHERE action <> 'unchanged'")
def _digest_diff(spark, sf):
    """The diff by digests, of one catalogue against the platform's; the rows that stayed are not listed."""
    local = materialize(items(spark, sf), "items")
    held = materialize(remote(local), "remote")
    return c.catalog_changes(local, held, c.catalog_digests(local), c.catalog_digests(held)).select("sku", "action")


@query("plan_changes", f"""WITH {DIFF} SELECT sku, 'price_usd' AS field, round(price_usd + 1, 2) AS old_value, round(price_usd, 2) AS new_value FROM items WHERE k % 10 <> 0 AND k % 7 = 0
  UNION ALL SELECT sku, 'name', NULL, NULL FROM items WHERE k % 10 <> 0 AND k % 11 = 0""")
def _changes(spark, sf):
    local = materialize(items(spark, sf), "items")
    rows = c.plan_changes(c.catalog_diff(local, remote(local)))
    number = lambda x: F.round(F.when(F.col("field") == "price_usd", F.col(x).cast("double")), 2)
    return rows.select("sku", "field", number("old").alias("old_value"), number("new").alias("new_value"))


PLATFORM = f"""{ITEMS}, projected AS (SELECT sku, CASE WHEN display_name IS NULL THEN name WHEN contains(family, ' / ') THEN display_name || ' ' || variant || ' (' || family || ')'
    ELSE display_name || ' ' || variant END AS name, CASE WHEN status = 'active' AND (quantity > 0 OR fulfilment = 'just_in_time') THEN 'active' ELSE 'inactive' END AS status FROM items)"""


@query("project_for_platform", f"WITH {PLATFORM} SELECT * FROM projected")
def _project(spark, sf):
    return c.project_for_platform(items(spark, sf)).select("sku", "name", "status")


APPLY = f"""WITH {DIFF} SELECT sku, {{0}} AS external_id, price_usd, name FROM items
  UNION ALL SELECT 'old-' || sku, external_id, price_usd, name FROM items WHERE k % 100 = 0"""


def applied(spark, sf, **how):
    local = materialize(items(spark, sf), "items")
    r = remote(local)
    r = r.groupBy("sku").agg(F.max_by(F.struct(*[x for x in r.columns if x not in ("sku", "seq")]), "seq").alias("r")).select("sku", "r.*")
    return c.apply_plan(r, local, c.catalog_diff(local, r), **how).select("sku", "external_id", "price_usd", "name")


@query("apply_plan", APPLY.format("CASE WHEN k % 10 <> 0 THEN 'r' || sku ELSE coalesce(external_id, 'file_' || sku) END"))
def _apply(spark, sf):
    return applied(spark, sf)


@query("apply_plan_recreate", APPLY.format("CASE WHEN k % 10 = 0 THEN 'p_' || sku WHEN k % 7 = 0 THEN 'p_' || sku || '_2' ELSE 'r' || sku END"))
def _apply_recreate(spark, sf):
    return applied(spark, sf, new_id=lambda s: F.concat(F.lit("p_"), s), recreate_on_price=True)


@query("catalog_csv", f"""WITH {ITEMS} SELECT sku, name, family, variant, CAST(CAST(round(price_usd * 100) AS BIGINT) AS DOUBLE) / 100 AS price, CAST(CAST(quantity AS BIGINT) AS VARCHAR) AS quantity, status, form,
  CAST(CAST(size_mg AS BIGINT) AS VARCHAR) AS size_mg, slug, description FROM items""")
def _csv(spark, sf):
    """The export written as CSV with a header and read back."""
    from stockweave.functions.runtime import new_path
    path = new_path(spark, "catalog-csv")
    exports.write_catalog_csv(items(spark, sf), path)
    back = exports.read_csv(spark, path, c.CSV_COLUMNS)
    return back.withColumn("price", F.col("price_usd").cast("double")).drop("price_usd").withColumn("form", F.coalesce("form", F.lit("")))


@query("merge_platform_ids", """SELECT 'product ' || p_partkey AS name, CASE WHEN p_partkey % 3 = 0 AND p_partkey % 9 <> 0 THEN 'new' || p_partkey ELSE 'old' || p_partkey END AS external_id,
  CASE WHEN p_partkey % 3 = 0 AND p_partkey % 9 <> 0 THEN 'file' ELSE 'shop' END AS platform FROM part WHERE p_partkey % 2 = 0 OR (p_partkey % 3 = 0 AND p_partkey % 9 <> 0)""")
def _ids(spark, sf):
    part = v.table(spark, sf, "part")
    name = F.concat(F.lit("product "), T())
    existing = part.filter(K() % 2 == 0).select(name.alias("name"), F.concat(F.lit("old"), T()).alias("external_id"), F.lit("shop").alias("platform"))
    ids = part.filter(K() % 3 == 0).select(T().alias("sku"), F.when(K() % 9 != 0, F.concat(F.lit("new"), T())).alias("external_id"))
    unknown = ids.withColumn("sku", F.concat(F.lit("zz"), "sku"))
    return c.merge_platform_ids(existing, ids.unionByName(unknown), part.select(T().alias("sku"), name.alias("name")), "file")


MADE = """made AS (SELECT CAST(p_partkey AS VARCHAR) AS product_id, 'cmp' || p_partkey // 4 AS component_id, p_partkey // 4 AS n, 0 AS pos, CASE WHEN p_partkey % 2 = 0 THEN p_size END AS amount FROM part
  UNION ALL SELECT CAST(p_partkey AS VARCHAR), 'cmp' || (p_partkey // 4 + 1), p_partkey // 4 + 1, 1, p_size * 2 FROM part WHERE p_partkey % 3 = 0)"""


@query("product_components", f"WITH {PROD}, {MADE} SELECT product_id, component_id, CASE WHEN instr(name, component_id) > 0 THEN instr(name, component_id) - 1 END AS place FROM made JOIN prod ON sku = product_id")
def _components(spark, sf):
    return c.product_components(products(spark, sf), contains(spark, sf), components(spark, sf)).select("product_id", "component_id", F.col("place").cast("bigint").alias("place"))


DOCS = f"""{MADE}, subjects AS (SELECT DISTINCT CAST(p_partkey AS VARCHAR) AS product_id, CAST(p_partkey AS VARCHAR) AS subject FROM part UNION SELECT product_id, component_id FROM made),
  docs AS (SELECT doc_id, CASE quality WHEN 1 THEN 'approved' WHEN 0 THEN 'prohibited' ELSE 'pending' END AS status, lang, toxic = 0 AS verified,
    CASE WHEN doc_id % 2 = 0 THEN CAST(doc_id % n AS VARCHAR) ELSE 'cmp' || (doc_id % n) // 4 END AS subject FROM documents LEFT JOIN labels USING (doc_id), (SELECT count(*) AS n FROM part))"""


@query("product_claims", f"""WITH {DOCS} SELECT product_id, c.subject, c.doc_id AS claim_id, s.doc_id AS study_id FROM docs c JOIN subjects USING (subject)
  LEFT JOIN docs s ON s.doc_id = c.doc_id + 2 AND s.verified WHERE c.doc_id % 3 = 0 AND c.status = 'approved' AND c.lang = 'en'""")
def _claims(spark, sf):
    d, s = documents(spark, sf, 0), documents(spark, sf, 2)
    claims, about = d.select(F.col("doc_id").alias("claim_id"), "status", "scope"), d.select(F.col("doc_id").alias("claim_id"), "subject")
    supported = d.select(F.col("doc_id").alias("claim_id"), (F.col("doc_id") + 2).alias("study_id"))
    return c.product_claims(products(spark, sf), contains(spark, sf), claims, about, supported, s.select(F.col("doc_id").alias("study_id"), "verified"))


@query("product_studies", f"WITH {DOCS} SELECT product_id, subject, doc_id AS study_id FROM docs JOIN subjects USING (subject) WHERE doc_id % 3 = 2 AND verified")
def _studies(spark, sf):
    s = documents(spark, sf, 2).withColumnRenamed("doc_id", "study_id")
    return c.product_studies(products(spark, sf), contains(spark, sf), s.select("study_id", "verified"), s.select("study_id", "subject"))


@query("product_faqs", f"""WITH {DOCS}, page AS (SELECT CAST(l_partkey AS VARCHAR) AS product_id, max(l_orderkey) AS page_id FROM lineitem WHERE l_linenumber = 1 GROUP BY l_partkey),
  f AS (SELECT * FROM docs WHERE doc_id % 3 = 1 AND status = 'approved')
  SELECT product_id, doc_id AS faq_id FROM f JOIN subjects USING (subject) UNION SELECT product_id, doc_id FROM page JOIN f ON doc_id = page_id % (SELECT count(*) FROM documents)""")
def _faqs(spark, sf):
    d = documents(spark, sf, 1).withColumnRenamed("doc_id", "faq_id")
    n = v.table(spark, sf, "documents").count()
    includes = v.table(spark, sf, "orders").select(F.col("o_orderkey").alias("page_id"), (F.col("o_orderkey") % n).alias("faq_id"))
    return c.product_faqs(products(spark, sf), contains(spark, sf), d.select("faq_id", "status"), d.select("faq_id", "subject"), features(spark, sf), includes)


TESTED = f"""{PROD}, lot_flags AS (SELECT sku, bool_and(coa_status IN ('received', 'published')) FILTER (on_hand > 0) AS tested, bool_and(purity_measured IS NOT NULL) FILTER (on_hand > 0) AS pure,
    bool_and(coa_lab = 'lab-us') FILTER (on_hand > 0) AS us, max(lot_id) FILTER (coa_status = 'published') AS coa_lot FROM lot_stock GROUP BY sku),
  tested AS (SELECT p.*, coalesce(f.tested, false) AND category <> 'accessory' AS lot_tested, coalesce(f.tested AND f.pure, false) AND category <> 'accessory' AS lot_purity_tested,
    coalesce(f.tested AND f.us, false) AND category <> 'accessory' AS lot_tested_us, f.coa_lot FROM prod p LEFT JOIN lot_flags f USING (sku))"""


@query("testing_flags", f"WITH {TESTED} SELECT sku, lot_tested, lot_purity_tested, lot_tested_us, coa_lot FROM tested")
def _testing(spark, sf):
    return c.testing_flags(products(spark, sf), lot_stock(spark, sf), US_LABS).select("sku", "lot_tested", "lot_purity_tested", "lot_tested_us", "coa_lot")


@query("images_by_format", """SELECT CAST(p_partkey AS VARCHAR) AS product_id, CASE WHEN p_partkey % 2 = 0 THEN url END AS square, CASE WHEN p_partkey % 2 = 1 THEN url END AS portrait
  FROM (SELECT p_partkey, '/img/' || p_partkey || CASE WHEN p_partkey % 5 = 0 THEN '-new' ELSE '' END AS url FROM part WHERE p_partkey % 3 <> 0)""")
def _images(spark, sf):
    return c.images_by_format(photos(spark, sf), FORMATS)


DOCUMENTS = f"""{TESTED}, document AS (SELECT *, status = 'active' AND (on_hand > 0 OR fulfilment = 'just_in_time') AS in_stock, fulfilment = 'just_in_time' AND on_hand = 0 AS jit_backorder,
    CASE WHEN k % 3 <> 0 AND k % 2 = 0 THEN '/img/' || k || CASE WHEN k % 5 = 0 THEN '-new' ELSE '' END END AS square, CASE WHEN blend THEN 2 ELSE 1 END AS n_components,
    CASE WHEN category = 'accessory' THEN 'Laboratory supply' WHEN blend THEN 'Peptide blend' WHEN n1 % 3 = 0 THEN 'Small peptide' WHEN n1 % 3 = 1 THEN 'Solvent' ELSE 'Research compound' END AS composition_class,
    coalesce(display_name, CASE WHEN blend THEN c1 || ' / ' || c2 ELSE c1 END) AS family_name, coalesce(display_name, CASE WHEN blend THEN c1 || ' + ' || c2 ELSE c1 END) AS label_name,
    CASE WHEN blend THEN c2 || ' ' || s * 2 || ' mg · ' || c1 || CASE WHEN k % 2 = 0 THEN ' ' || st || ' mg' ELSE '' END ELSE '' END AS composition_line,
    size || CASE WHEN blend AND display_name IS NULL AND k % 2 = 0 THEN ' (' || st || '+' || s * 2 || ')' ELSE '' END AS label_amount, CASE WHEN k % 6 <> 0 THEN p_brand END AS research_area
    FROM tested WHERE status IN ('active', 'coming_soon'))"""


def product_docs(spark, sf):
    return c.product_documents(products(spark, sf), contains(spark, sf), components(spark, sf), product_stock(spark, sf), lot_stock(spark, sf),
                               photos(spark, sf), US_LABS, FORMATS)


@query("product_documents", f"WITH {DOCUMENTS} SELECT sku, name, category, on_hand, in_stock, jit_backorder, lot_tested, square, n_components, composition_class, trim(regexp_replace(lower(composition_class), '[^a-z0-9]+', '-', 'g'), '-') AS composition_slug FROM document")
def _documents(spark, sf):
    return product_docs(spark, sf).select("sku", "name", "category", "on_hand", "in_stock", "jit_backorder", "lot_tested", "square", "n_components", "composition_class", "composition_slug")


@query("product_component_facts", f"""WITH {PROD}, c AS (SELECT sku, name, c1 AS c, n1 AS n, 0 AS pos, CASE WHEN k % 2 = 0 THEN s::DOUBLE END AS amount_mg FROM prod WHERE status IN ('active', 'coming_soon')
    UNION ALL SELECT sku, name, c2, n2, 1, s * 2.0 FROM prod WHERE blend AND status IN ('active', 'coming_soon')),
  placed AS (SELECT *, row_number() OVER (PARTITION BY sku ORDER BY CASE WHEN instr(name, c) > 0 THEN instr(name, c) ELSE 1000000 END, pos, c)::INT AS place FROM c)
  SELECT sku AS product_id, place, c AS component_id, c AS component_name, amount_mg, CASE WHEN n % 2 = 0 THEN 'Summary of cmp' || n || '.' END AS summary, CASE WHEN n % 3 = 0 THEN 'small peptide' END AS class,
    CASE WHEN n % 3 = 1 THEN 'solvent' END AS kind, CASE WHEN n % 4 = 0 THEN 'AAA' END AS sequence, CASE WHEN n % 5 = 0 THEN 'C2H6' END AS molecular_formula, n % 7 + 0.5::DOUBLE AS molecular_weight,
    CASE WHEN n % 6 = 0 THEN 'CAS-' || n END AS cas_number, CASE WHEN n % 2 = 0 THEN 'white powder' ELSE 'clear liquid' END AS appearance FROM placed""")
def _component_facts(spark, sf):
    return c.component_facts(products(spark, sf), contains(spark, sf), components(spark, sf))


@query("document_extras", f"""WITH {PROD}, sold AS (SELECT sku, k, p_name, p_brand FROM prod WHERE status IN ('active', 'coming_soon')),
  seen AS (SELECT CAST(l_partkey AS VARCHAR) AS sku, max(l_orderkey) AS o FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE o_orderstatus = 'O' GROUP BY l_partkey),
  told AS (SELECT sku, o, o_orderpriority AS meta FROM seen JOIN orders ON o_orderkey = o)
  SELECT sku AS product_id, 'alias' AS section, item, CAST(NULL AS VARCHAR) AS value FROM (SELECT DISTINCT sku, unnest([p_name, p_brand, 'p' || k]) AS item FROM sold) WHERE length(item) > 4
  UNION ALL SELECT sku, 'alt', CASE WHEN k % 2 = 0 THEN 'square' ELSE 'portrait' END, CASE WHEN k % 5 = 0 THEN '' WHEN k % 4 < 2 THEN 'photo of ' || k ELSE '' END FROM sold WHERE k % 3 <> 0
  UNION ALL SELECT sku, 'page', 'title', 'order ' || o FROM told JOIN sold USING (sku) UNION ALL SELECT sku, 'page', 'meta_description', meta FROM told JOIN sold USING (sku)
  UNION ALL SELECT DISTINCT sku, 'asset', 'asset-' || l_suppkey, '{{"asset_type":"' || CASE WHEN l_suppkey % 2 = 0 THEN 'image' ELSE 'sheet' END || '"' || CASE WHEN l_suppkey % 3 = 0 THEN ',"url":"/a/' || l_suppkey || '"' ELSE '' END || '}}'
    FROM lineitem JOIN sold ON sku = CAST(l_partkey AS VARCHAR)""")
def _document_extras(spark, sf):
    """Aliases, alternative texts, page titles and assets of products; open orders stand for pages, suppliers for assets."""
    named = v.table(spark, sf, "part").select(T().alias("product_id"), F.array("p_name", "p_brand", F.concat(F.lit("p"), T())).alias("aliases"))
    p = products(spark, sf).join(named, "product_id")
    pics = photos(spark, sf).withColumn("alt_text", F.when((F.col("photo_id") < 1_000_000_000) & (F.col("photo_id") % 4 < 2), F.concat(F.lit("photo of "), "product_id")))
    lines = v.table(spark, sf, "lineitem").select(F.col("l_partkey").cast("string").alias("product_id"), "l_orderkey", "l_suppkey")
    live = v.table(spark, sf, "orders").filter("o_orderstatus = 'O'")
    pages = lines.join(live, F.col("l_orderkey") == F.col("o_orderkey")).select(
        "product_id", F.col("o_orderkey").alias("page_id"), F.concat(F.lit("order "), F.col("o_orderkey").cast("string")).alias("title"), F.col("o_orderpriority").alias("meta_description"))
    n = F.col("l_suppkey")
    assets = lines.select("product_id", F.concat(F.lit("asset-"), n.cast("string")).alias("path"), F.when(n % 2 == 0, "image").otherwise("sheet").alias("asset_type"),
                          F.lit(None).cast("string").alias("alt_text"), F.when(n % 3 == 0, F.concat(F.lit("/a/"), n.cast("string"))).alias("url"))
    return c.document_extras(p, pics, pages, assets)


@query("stock_flags", f"WITH {PROD} SELECT sku, status = 'active' AND (on_hand > 0 OR fulfilment = 'just_in_time') AS in_stock, fulfilment = 'just_in_time' AND on_hand = 0 AS jit_backorder FROM prod")
def _flags(spark, sf):
    return c.stock_flags(product_stock(spark, sf)).select("sku", "in_stock", "jit_backorder")


@query("area_products", f"WITH {DOCUMENTS} SELECT research_area, 'p-' || sku AS slug, row_number() OVER (PARTITION BY research_area ORDER BY name, sku) AS position FROM document WHERE research_area IS NOT NULL")
def _areas(spark, sf):
    return c.area_products(product_docs(spark, sf))


@query("product_lots", f"WITH {STOCK} SELECT sku AS product_id, lot_id, expires_on, CASE WHEN purity_measured IS NULL THEN NULL ELSE 99.1e0 END AS purity_measured, coa_status FROM lot_stock JOIN stock USING (sku) WHERE status IN ('active', 'coming_soon')")
def _lot_list(spark, sf):
    return c.product_lots(products(spark, sf), v.lots(spark, sf))


@query("product_certificates", f"""WITH {STOCK}, held AS (SELECT sku, lot_id, purity_measured IS NOT NULL AS pure FROM lot_stock JOIN stock USING (sku) WHERE status IN ('active', 'coming_soon') AND coa_status = 'published' AND length(lot_id) % 3 <> 0)
  SELECT sku AS product_id, max(lot_id) AS lot_id, 'coa/' || max(lot_id) || '.pdf' AS path, CASE WHEN arg_max(pure, lot_id) THEN 99.1e0 END AS purity FROM held GROUP BY sku""")
def _certificates(spark, sf):
    lots = v.lots(spark, sf)
    links = lots.filter(F.length("lot_id") % 3 != 0).select("lot_id", F.concat(F.lit("coa/"), "lot_id", F.lit(".pdf")).alias("path"))
    return c.product_certificates(products(spark, sf), lots, links)


@query("related_products", f"""WITH {PROD}, {MADE} SELECT DISTINCT a.product_id, 'p-' || b.product_id AS slug FROM made a JOIN made b USING (component_id) JOIN prod p ON p.sku = a.product_id JOIN prod o ON o.sku = b.product_id
  WHERE a.product_id <> b.product_id AND o.status = 'active' AND p.status IN ('active', 'coming_soon')""")
def _related(spark, sf):
    p = products(spark, sf)
    return c.related_products(p.filter(F.col("status").isin(*c.SELLABLE)), p, contains(spark, sf))


@query("composition_groups", f"""WITH {DOCUMENTS} SELECT trim(regexp_replace(lower(composition_class), '[^a-z0-9]+', '-', 'g'), '-') AS composition_slug, composition_class, composition_class = 'Laboratory supply' AS supplies,
  count(*) FILTER (category <> 'accessory') AS n_products FROM document GROUP BY composition_class""")
def _groups(spark, sf):
    return c.composition_groups(product_docs(spark, sf))


@query("product_labels", f"WITH {DOCUMENTS} SELECT sku, family_name, label_name, size AS size_label, composition_line, label_amount FROM document")
def _labels(spark, sf):
    sellable = products(spark, sf).filter(F.col("status").isin(*c.SELLABLE))
    return c.labels(sellable, contains(spark, sf), components(spark, sf)).select("sku", "family_name", "label_name", "size_label", "composition_line", "label_amount")


FOLDED = "regexp_replace(lower(concat_ws(' ', name, family_name, size, sku, composition_class, composition_line)), '[^a-z0-9]', '', 'g')"


def found(spark, sf, text, in_stock_only):
    return c.search(c.labels(product_docs(spark, sf), contains(spark, sf), components(spark, sf)), text, in_stock_only)


@query("catalog_search", f"WITH {DOCUMENTS} SELECT sku, name FROM document WHERE contains({FOLDED}, 'cmp12') AND in_stock AND status = 'active'")
def _search(spark, sf):
    return found(spark, sf, "Çmp-12", True).select("sku", "name")


@query("catalog_search_terms", f"""WITH {DOCUMENTS}, folded AS (SELECT sku, {FOLDED} AS t FROM document), words AS (SELECT DISTINCT unnest(string_split(p_name, ' ')) AS term FROM part
    UNION SELECT DISTINCT p_brand FROM part UNION SELECT DISTINCT 'CMP-' || p_partkey // 4 FROM part UNION SELECT DISTINCT CAST(p_size AS VARCHAR) FROM part UNION SELECT unnest(['k', 'Kit', '#!'])),
  terms AS (SELECT term, regexp_replace(lower(term), '[^a-z0-9]', '', 'g') AS want FROM words) SELECT term, sku FROM terms JOIN folded ON contains(t, want) WHERE want <> ''""")
def _search_terms(spark, sf):
    """Every brand, product word, component, size and two short terms as search terms in one job."""
    part, one = v.table(spark, sf, "part"), lambda c: c.alias("term")
    terms = (part.select(one(F.explode(F.split("p_name", " ")))).unionByName(part.select(one(F.col("p_brand"))))
             .unionByName(part.select(one(F.concat(F.lit("CMP-"), F.floor(F.col("p_partkey") / 4).cast("string"))))).unionByName(part.select(one(F.col("p_size").cast("string"))))
             .unionByName(spark.createDataFrame([("k",), ("Kit",), ("#!",)], "term string")))
    return c.search_terms(c.labels(product_docs(spark, sf), contains(spark, sf), components(spark, sf)), terms)


@query("search_groups", f"WITH {DOCUMENTS} SELECT trim(regexp_replace(lower(composition_class), '[^a-z0-9]+', '-', 'g'), '-') AS composition_slug, count(*) AS n_visible FROM document WHERE contains({FOLDED}, 'kit') GROUP BY 1")
def _search_groups(spark, sf):
    return c.search_groups(found(spark, sf, "KIT!", False))


@query("fold_text", "SELECT doc_id, md5(regexp_replace(strip_accents(lower(text)), '[^a-z0-9]', '', 'g')) AS folded FROM documents")
def _fold(spark, sf):
    return v.table(spark, sf, "documents").select("doc_id", F.md5(fold("text")).alias("folded"))


@query("spec_rows", f"""WITH {TESTED}, {MADE}, c AS (SELECT m.*, p.category, CASE WHEN p.blend THEN component_id || ' · ' ELSE '' END AS pre FROM made m JOIN prod p ON p.sku = m.product_id),
  x AS (SELECT product_id, 0 AS block, pos, 0 AS line, pre || 'Amount per vial' AS label, amount || ' mg' AS value FROM c WHERE amount IS NOT NULL
    UNION ALL SELECT product_id, 0, pos, 1, pre || 'Sequence', 'AAA' FROM c WHERE n % 4 = 0
    UNION ALL SELECT product_id, 0, pos, 2, pre || 'Molecular formula', 'C2H6' FROM c WHERE n % 5 = 0
    UNION ALL SELECT product_id, 0, pos, 3, pre || 'Molecular weight', n % 7 || '.5 g/mol' FROM c
    UNION ALL SELECT product_id, 0, pos, 4, pre || 'CAS number', 'CAS-' || n FROM c WHERE n % 6 = 0
    UNION ALL SELECT product_id, 0, pos, 5, pre || 'Composition class', CASE WHEN n % 3 = 0 THEN 'small peptide' ELSE 'solvent' END FROM c WHERE n % 3 = 0 OR (n % 3 = 1 AND category <> 'accessory')
    UNION ALL SELECT sku, 1, 0, 0, 'Volume', st || ' ml' FROM prod WHERE k % 5 = 0
    UNION ALL SELECT sku, 1, 0, 1, 'Form', coalesce(form, '') FROM prod
    UNION ALL SELECT sku, 1, 0, 2, 'Appearance', CASE WHEN n1 % 2 = 0 THEN 'white powder' ELSE 'clear liquid' END || CASE WHEN NOT blend THEN '' WHEN n1 % 2 = 0 THEN '; clear liquid' ELSE '; white powder' END FROM prod
    UNION ALL SELECT sku, 1, 0, 3, 'Vial', '3 mL ' || CASE WHEN k % 4 = 0 THEN 'amber' ELSE 'clear' END || ' glass' FROM prod WHERE k % 2 = 0
    UNION ALL SELECT sku, 1, 0, 4, 'Purity specification', '≥99%' FROM tested WHERE k % 4 = 0 AND lot_purity_tested
    UNION ALL SELECT sku, 1, 0, 5, 'SKU', sku FROM prod) SELECT * FROM x""")
def _spec(spark, sf):
    tested = c.testing_flags(products(spark, sf), lot_stock(spark, sf), US_LABS)
    return c.spec_rows(tested, contains(spark, sf), components(spark, sf))
