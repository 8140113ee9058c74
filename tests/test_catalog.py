from conftest import rows
from pyspark.sql import functions as F

from stockweave.functions.text import fold_text
from stockweave.operators import catalog as c
from stockweave.sources import exports
from stockweave.sources.batches import SnapshotTable

PRODUCT = ("product_id string, sku string, name string, status string, form string, size_mg double, size_ml double, price_usd double, purity_spec string, slug string, "
           "display_name string, external_id string, fulfilment string, category string")
ITEM = ("sku string, name string, family string, variant string, price_usd double, status string, quantity double, form string, size_mg double, slug string, description string, "
        "external_id string, fulfilment string, display_name string")


def shop(spark):
    products = spark.createDataFrame([
        ("1", "S1", "Alpha 5mg", "active", None, 5.0, None, 59.0, ">=99%", "a", None, None, "stocked", "peptide"),
        ("2", "S2", "Shine 80mg", "active", "powder", 80.0, None, 120.0, None, "g", "SHINE", "x9", "just_in_time", "peptide"),
        ("3", "S3", "Water 10ml", "coming_soon", "liquid", None, 10.0, 9.5, None, "w", None, None, "stocked", "accessory"),
        ("4", "S4", "Draft 1mg", "draft", None, 1.0, None, 1.0, None, "d", None, None, "stocked", "peptide"),
        ("5", None, "No sku", "active", None, 1.0, None, 1.0, None, "n", None, None, "stocked", "peptide")], PRODUCT)
    contains = spark.createDataFrame([("1", "a", 0, None), ("2", "a", 0, 10.0), ("2", "b", 1, 50.0), ("2", "c", 2, None)], "product_id string, component_id string, pos int, amount_mg double")
    components = spark.createDataFrame([("a", "Alpha", "Sum A.", "small", None), ("b", "Beta", None, None, "solvent"), ("c", "Gamma", "Sum C.", None, None)],
                                       "component_id string, component_name string, summary string, class string, kind string")
    return products, contains, components, spark.createDataFrame([("1", 10.0)], "product_id string, on_hand double")


def test_snapshot_texts(spark):
    items = {r["sku"]: r for r in c.catalog_snapshot(*shop(spark)).collect()}
    assert sorted(items) == ["S1", "S2", "S3"]
    assert (items["S1"]["family"], items["S1"]["variant"], items["S1"]["quantity"]) == ("Alpha", "5mg", 10.0)
    assert items["S1"]["description"] == f"Sum A. Supplied as lyophilized powder, 5 mg per vial, tested to a purity specification of ≥99%. {c.CLOSING_LINE}"
    assert (items["S2"]["family"], items["S2"]["variant"]) == ("Alpha / Beta / Gamma", "80mg")
    assert items["S2"]["description"].startswith("Composition per vial: Beta 50 mg, Alpha 10 mg, Gamma. Sum A. Sum C. Supplied as powder, 80 mg per vial.")
    assert (items["S3"]["family"], items["S3"]["variant"], items["S3"]["size_mg"]) == ("Water 10ml", "10ml", 10.0)


def test_platform_titles_and_availability(spark):
    got = rows(c.project_for_platform(c.catalog_snapshot(*shop(spark))), "sku", "name", "status")
    assert got == [("S1", "Alpha 5mg", "active"), ("S2", "SHINE 80mg (Alpha / Beta / Gamma)", "active"), ("S3", "Water 10ml", "inactive")]


def test_apply_then_diff_is_empty_and_a_price_change_is_one_update(spark, tmp_path):
    local = c.catalog_snapshot(*shop(spark))
    store = SnapshotTable(spark, str(tmp_path / "remote"))
    assert store.fetch() is None
    empty = spark.createDataFrame([], ITEM)
    plan = c.catalog_diff(local, empty)
    assert rows(plan, "action") == [("create",)] * 3
    store.replace(c.apply_plan(empty, local, plan))
    assert rows(store.fetch(), "sku", "external_id") == [("S1", "file_s1"), ("S2", "x9"), ("S3", "file_s3")]
    assert rows(c.catalog_diff(local, store.fetch()), "action") == [("unchanged",)] * 3
    dearer = local.withColumn("price_usd", F.when(F.col("sku") == "S1", 64.0).otherwise(F.col("price_usd")))
    plan = c.catalog_diff(dearer, store.fetch())
    assert rows(c.plan_changes(plan)) == [("S1", "price_usd", "59", "64")]
    new = c.apply_plan(store.fetch(), dearer, plan, lambda s: F.concat(F.lit("p_"), s), recreate_on_price=True)
    assert rows(new, "sku", "external_id", "price_usd") == [("S1", "p_S1_2", 64.0), ("S2", "x9", 120.0), ("S3", "file_s3", 9.5)]


def test_diff_treats_missing_empty_and_zero_alike_and_keeps_orphans(spark):
    item = lambda sku, name, size, price, seq: (sku, name, size, price, seq)
    local = spark.createDataFrame([item("a", None, None, 1.0, 0), item("b", "n", 5.0, 1.0 + 1e-12, 0), item("c", "x", None, 2.0, 0)], "sku string, name string, size_mg double, price_usd double, seq int")
    remote = spark.createDataFrame([item("a", "", 0.0, 1.0, 0), item("b", "n", 5.0, 1.0, 0), item("c", "x", None, 2.0, 1), item("c", "old", 9.0, 2.0, 0), item("z", "z", None, 0.0, 0)],
                                   "sku string, name string, size_mg double, price_usd double, seq int")
    assert rows(c.catalog_diff(local, remote, ("name", "size_mg", "price_usd")), "sku", "action") == [("a", "unchanged"), ("b", "unchanged"), ("c", "unchanged"), ("z", "orphan")]


def test_labels_search_and_csv(spark, tmp_path):
    products, contains, components, _ = shop(spark)
    got = {r["product_id"]: r for r in c.labels(products, contains, components).collect()}
    assert (got["2"]["label_name"], got["2"]["composition_line"], got["2"]["label_amount"]) == ("SHINE", "Beta 50 mg · Alpha 10 mg · Gamma", "80 mg")
    assert (got["3"]["family_name"], got["3"]["size_label"]) == ("Water 10ml", "10 ml")
    both = contains.filter("product_id = '2' AND pos < 2")
    plain = products.filter("product_id = '2'").withColumn("display_name", F.lit(None).cast("string"))
    assert c.labels(plain, both, components).first()["label_amount"] == "80 mg (10+50)"
    assert fold_text("Crème NAD⁺ ﬁne-1") == "cremenadfine1"
    docs = c.labels(products, contains, components).withColumns({"composition_class": F.lit("Peptide blend"), "in_stock": F.col("product_id") == "2"})
    assert rows(c.search(docs, "bétà 50"), "product_id") == [("2",)] and rows(c.search(docs, "ALPHA", True), "product_id") == [("2",)]
    items = c.catalog_snapshot(*shop(spark)).withColumn("quantity", F.when(F.col("sku") == "S1", 12.5).otherwise(F.col("quantity")))
    exports.write_catalog_csv(items, str(tmp_path / "csv"))
    back = exports.read_csv(spark, str(tmp_path / "csv"), c.CSV_COLUMNS)
    assert rows(back, "sku", "price_usd", "quantity", "size_mg") == [("S1", "59.00", "12.5", "5"), ("S2", "120.00", "0", "80"), ("S3", "9.50", "0", "10")]


def test_testing_is_claimed_only_when_every_stocked_lot_has_its_certificate(spark):
    products = spark.createDataFrame([(p, "accessory" if p == "acc" else "peptide") for p in ("all", "some", "none", "acc")], "product_id string, category string")
    lots = [("all", "l1", 1.0, "received", 99.0, "us"), ("all", "l2", 0.0, "pending", None, "eu"), ("some", "l3", 1.0, "published", 99.0, "us"), ("some", "l4", 2.0, "pending", 99.0, "us"),
            ("none", "l5", 0.0, "published", 99.0, "us"), ("acc", "l6", 5.0, "published", 99.0, "us")]
    df = spark.createDataFrame(lots, "product_id string, lot_id string, on_hand double, coa_status string, purity_measured double, coa_lab string")
    got = rows(c.testing_flags(products, df, ["us"]), "product_id", "lot_tested", "lot_tested_us", "coa_lot")
    assert got == [("acc", False, False, "l6"), ("all", True, True, None), ("none", False, False, "l5"), ("some", False, False, "l3")]


def test_terms_find_what_a_substring_scan_finds(spark):
    import random
    rng = random.Random(3)
    texts = ["".join(rng.choices("abcÄ -1", k=rng.randrange(0, 14))) for _ in range(60)] + ["", "a", "ab", None]
    docs = spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "sku string, name string").selectExpr(
        "sku", "name", *[f"CAST(NULL AS STRING) AS {c}" for c in ("family_name", "size_label", "composition_class", "composition_line")])
    docs = docs.withColumn("sku", F.concat(F.lit("9"), "sku"))
    terms = ["a", "1", "ab", "ba", "abc", "a-b", "AB", "aaab", "Äb c", "-", "", "zzz", "9", None, "ab", *["".join(rng.choices("abc1", k=rng.randrange(1, 6))) for _ in range(40)]]
    folded = {r[0]: r[1] for r in docs.select("sku", c.fold(c.searched_text())).collect()}
    want = sorted({(t, sku) for t in terms if t is not None and fold_text(t) for sku, x in folded.items() if fold_text(t) in x})
    assert rows(c.search_terms(docs, spark.createDataFrame([(t,) for t in terms], "term string"))) == want
    assert c.search_terms(docs.limit(0), spark.createDataFrame([("a",)], "term string")).count() == 0


def test_digests_lead_to_the_changed_items_and_spare_equal_catalogues(spark):
    items = spark.range(400).select(F.col("id").cast("string").alias("sku"), *[F.lit("t").alias(f) for f in c.COMPARED if f not in c.NUMERIC],
                                    *[F.lit(1.0).alias(f) for f in c.NUMERIC])
    same = items.withColumns({"slug": F.col("slug")}).orderBy(F.rand(3))
    poisoned = items.withColumn("name", F.raise_error(F.lit("read")).cast("string"))
    assert c.catalog_changes(poisoned, poisoned, c.catalog_digests(items), c.catalog_digests(same)).count() == 0
    k = F.col("sku").cast("int")
    other = (items.filter(k != 7).withColumn("price_usd", F.when(k == 11, 2.0).otherwise(F.col("price_usd"))).withColumn("slug", F.when(k == 12, None).otherwise(F.col("slug")))
             .unionByName(items.filter(k == 5).withColumn("sku", F.lit("new"))))
    ours, theirs = c.catalog_digests(items), c.catalog_digests(other)
    assert c.changed_buckets(ours, theirs).count() <= 4
    want = rows(c.catalog_diff(items, other).filter("action <> 'unchanged'"))
    assert rows(c.catalog_changes(items, other, ours, theirs)) == want and len(want) == 4
    empty = items.limit(0)
    assert c.catalog_changes(items, empty, ours, c.catalog_digests(empty)).count() == 400
