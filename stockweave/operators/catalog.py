"""The product catalogue: snapshot, diff, platform projection, product facts, search and labels.

Inputs are plain tables: ``products`` (product_id, sku, name, status, form, size_mg, size_ml, price_usd, ...),
``contains`` (product_id, component_id, pos, amount_mg) and ``components`` (component_id, component_name, ...).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from stockweave.functions.columns import first_upper, trim_number, truthy
from stockweave.functions.ordered import number_rows
from stockweave.functions.runtime import materialize
from stockweave.functions.text import fold, fold_text
from stockweave.operators.orders import in_stock, just_in_time

# Texts and field lists the catalogue is known by.
SELLABLE = ("active", "coming_soon")
CLOSING_LINE = "For Research Use Only — Not for Human Consumption."
DEFAULT_FORM = "lyophilized powder"
COMPARED = ("name", "family", "variant", "price_usd", "status", "quantity", "form", "size_mg", "slug", "description")
PLATFORM_COMPARED = ("name", "price_usd", "status", "description")
NUMERIC = ("price_usd", "quantity", "size_mg")
CSV_COLUMNS = ("sku", "name", "family", "variant", "price_usd", "quantity", "status", "form", "size_mg", "slug", "description")
SUPPLY_CLASS, BLEND_CLASS, OTHER_CLASS = "Laboratory supply", "Peptide blend", "Research compound"
FIRST_CATEGORY, SUPPLY_CATEGORY = "peptide", "accessory"


def _parts(contains: DataFrame, components: DataFrame) -> DataFrame:
    """Each product's components in listed order, as one array (a product's own bill of materials)."""
    rows = contains.join(components, "component_id")
    part = F.struct("pos", F.col("component_name").alias("name"), "amount_mg", "summary")
    return rows.groupBy("product_id").agg(F.array_sort(F.collect_list(part)).alias("parts"))


def _by_amount(parts) -> Column:
    """Largest amount first, missing amounts as 0, ties in listed order."""
    keyed = F.transform(parts, lambda p: F.struct((-F.coalesce(p["amount_mg"], F.lit(0.0))).alias("k"), p["pos"].alias("pos"), p["name"].alias("name"),
                                                  p["amount_mg"].alias("amount_mg")))
    return F.array_sort(keyed)


def _with_amount(p) -> Column:
    has = F.coalesce(p["amount_mg"], F.lit(0.0)) != 0
    return F.when(has, F.concat(p["name"], F.lit(" "), trim_number(p["amount_mg"]), F.lit(" mg"))).otherwise(p["name"])


def _has(c: str) -> Column:
    return F.coalesce(F.col(c), F.lit(0)) != 0


def catalog_snapshot(products: DataFrame, contains: DataFrame, components: DataFrame, stock: DataFrame) -> DataFrame:
    """Every sellable product with a sku as a flat catalogue item, stock from the ledger."""
    sellable = products.filter(F.col("status").isin(*SELLABLE) & truthy("sku"))
    p = sellable.join(_parts(contains, components), "product_id", "left").join(stock.select("product_id", "on_hand"), "product_id", "left")
    none = F.array().cast("array<struct<pos:int,name:string,amount_mg:double,summary:string>>")
    p = p.withColumn("parts", F.coalesce("parts", none))
    family = F.when(F.size("parts") > 0, F.array_join(F.transform("parts", lambda x: x["name"]), " / ")).otherwise(F.col("name"))
    p = p.withColumn("family", family)
    tag = F.when(_has("size_mg"), F.concat(trim_number("size_mg"), F.lit("mg"))).otherwise(F.concat(trim_number("size_ml"), F.lit("ml")))
    rest = F.trim(F.replace("name", F.col("family"), F.lit("")))
    variant = F.when(F.contains("name", "family") & (rest != ""), rest).otherwise(tag)
    size = F.when(_has("size_mg"), F.concat(trim_number("size_mg"), F.lit(" mg"))).otherwise(F.concat(trim_number("size_ml"), F.lit(" ml")))
    purity = F.when(truthy("purity_spec"), F.concat(F.lit(", tested to a purity specification of "), F.replace("purity_spec", F.lit(">="), F.lit("≥")))).otherwise("")
    composition = F.when(F.size("parts") > 1, F.concat(F.lit("Composition per vial: "), F.array_join(F.transform(_by_amount(F.col("parts")), _with_amount), ", "), F.lit(".")))
    summaries = F.filter(F.transform("parts", lambda x: x["summary"]), lambda s: s.isNotNull() & (s != ""))
    supplied = F.concat(F.lit("Supplied as "), F.coalesce("form", F.lit(DEFAULT_FORM)), F.lit(", "), size, F.lit(" per vial"), purity, F.lit("."))
    description = F.array_join(F.array_compact(F.concat(F.array(composition), summaries, F.array(supplied, F.lit(CLOSING_LINE)))), " ")
    return p.select(
        "sku", "name", "family", variant.alias("variant"), F.coalesce("price_usd", F.lit(0.0)).alias("price_usd"), "status",
        F.coalesce("on_hand", F.lit(0.0)).alias("quantity"), F.coalesce("form", F.lit("")).alias("form"),
        F.when(_has("size_mg"), F.col("size_mg")).otherwise(F.col("size_ml")).alias("size_mg"), F.coalesce("slug", F.lit("")).alias("slug"),
        description.alias("description"), "external_id", F.coalesce("fulfilment", F.lit("stocked")).alias("fulfilment"), "display_name")


def _differs(field: str, old: str, new: str) -> Column:
    a, b = F.col(f"{old}_{field}"), F.col(f"{new}_{field}")
    if field in NUMERIC:
        return F.when(a.isNotNull() & b.isNotNull(), F.abs(a - b) > 1e-9).otherwise(F.coalesce(a, F.lit(0.0)) != F.coalesce(b, F.lit(0.0)))
    return F.coalesce(a, F.lit("")) != F.coalesce(b, F.lit(""))


def catalog_diff(local: DataFrame, remote: DataFrame, compared: tuple[str, ...] = COMPARED) -> DataFrame:
    """Rows (sku, action, changes): create, update, orphan or unchanged; changes lists (field, old, new).

    Null, empty text and 0 count as equal; numbers may differ by 1e-9. Of duplicate remote keys the last (by
    ``seq`` if present) counts. Orphans are reported, never removed.
    """
    fields = [f for f in compared]
    if "seq" in remote.columns:
        remote = remote.groupBy("sku").agg(F.max_by(F.struct(*fields), "seq").alias("r")).select("sku", "r.*")
    side = lambda df, s: df.select("sku", F.lit(True).alias(f"{s}_here"), *[F.col(f).cast("double" if f in NUMERIC else "string").alias(f"{s}_{f}") for f in fields])
    j = side(local, "new").join(side(remote, "old"), "sku", "full_outer")
    text = lambda s, f: trim_number(f"{s}_{f}") if f in NUMERIC else F.col(f"{s}_{f}")
    changes = F.array_compact(F.array(*[F.when(_differs(f, "old", "new"), F.struct(F.lit(f).alias("field"), text("old", f).alias("old"), text("new", f).alias("new")))
                                        for f in fields]))
    both = F.col("old_here").isNotNull() & F.col("new_here").isNotNull()
    j = j.withColumn("changes", F.when(both, changes).otherwise(F.array().cast("array<struct<field:string,old:string,new:string>>")))
    action = (F.when(F.col("old_here").isNull(), "create").when(F.col("new_here").isNull(), "orphan")
              .when(F.size("changes") > 0, "update").otherwise("unchanged"))
    return j.select("sku", action.alias("action"), "changes")


BUCKETS, BUCKET_GROUPS = 4096, 64


def _bucket() -> Column:
    return F.pmod(F.xxhash64("sku"), F.lit(BUCKETS)).cast("int")


def catalog_digests(items: DataFrame, compared: tuple[str, ...] = COMPARED) -> DataFrame:
    """A two-level digest of a catalogue: (level, place, n, total, mixed) for each group of buckets (level 0) and each bucket of skus (level 1) that has items.

    An item's digest covers its sku and the compared fields, with null, empty text and 0 alike; a bucket adds its items' digests up and mixes them, so their order doesn't matter.
    Both sides keep this small table beside their items: at most 4,160 rows, whatever the catalogue.
    """
    said = [F.coalesce(F.col(f).cast("double"), F.lit(0.0)).cast("string") if f in NUMERIC else F.coalesce(F.col(f).cast("string"), F.lit("")) for f in compared]
    code = F.xxhash64("sku", *said)
    leaves = items.select(_bucket().alias("place"), code.alias("code")).groupBy("place").agg(
        F.count("*").alias("n"), F.sum(F.col("code").cast("decimal(38,0)")).alias("total"), F.bit_xor(F.xxhash64("code")).alias("mixed"))
    leaves = materialize(leaves, "digests")
    groups = leaves.groupBy((F.col("place") % BUCKET_GROUPS).alias("place")).agg(
        F.sum("n").alias("n"), F.sum(F.xxhash64("place", "n", "total", "mixed").cast("decimal(38,0)")).alias("total"), F.bit_xor(F.xxhash64("place", "mixed", "n")).alias("mixed"))
    return groups.select(F.lit(0).alias("level"), "place", "n", "total", "mixed").unionByName(leaves.select(F.lit(1).alias("level"), "place", "n", "total", "mixed"))


def changed_buckets(ours: DataFrame, theirs: DataFrame) -> DataFrame:
    """(place) of the buckets whose digests differ; only groups that differ are looked into."""
    def differing(level: int, within: DataFrame | None) -> DataFrame:
        rows = [d.filter(F.col("level") == level).select("place", F.struct("n", "total", "mixed").alias(side)) for d, side in ((ours, "ours"), (theirs, "theirs"))]
        if within is not None:
            rows = [r.join(within, F.col("place") % BUCKET_GROUPS == F.col("_group"), "left_semi") for r in rows]
        return rows[0].join(rows[1], "place", "full_outer").filter(~F.col("ours").eqNullSafe(F.col("theirs"))).select("place")

    return differing(1, differing(0, None).select(F.col("place").alias("_group")))


def catalog_changes(local: DataFrame, remote: DataFrame, ours: DataFrame, theirs: DataFrame, compared: tuple[str, ...] = COMPARED) -> DataFrame:
    """:func:`catalog_diff` without the unchanged rows, comparing only the buckets whose digests (see :func:`catalog_digests`) differ. Where none does, neither
    catalogue is read."""
    buckets = materialize(changed_buckets(ours, theirs), "changed-buckets")
    if buckets.isEmpty():
        return catalog_diff(local.limit(0), remote.limit(0), compared)
    of = lambda df: df.join(buckets, _bucket() == F.col("place"), "left_semi")
    return catalog_diff(of(local), of(remote), compared).filter("action <> 'unchanged'")


def plan_changes(plan: DataFrame) -> DataFrame:
    """One row per changed field."""
    return plan.select("sku", F.explode("changes").alias("c")).select("sku", "c.field", "c.old", "c.new")


def project_for_platform(items: DataFrame) -> DataFrame:
    """Items as a platform without stock counts holds them: its title, and active only if it can be bought."""
    titled = F.concat("display_name", F.lit(" "), "variant")
    title = (F.when(~truthy("display_name"), F.col("name")).when(F.contains("family", F.lit(" / ")), F.concat(titled, F.lit(" ("), "family", F.lit(")")))
             .otherwise(titled))
    buyable = (F.col("status") == "active") & ((F.col("quantity") > 0) | just_in_time())
    return items.withColumns({"name": title, "status": F.when(buyable, "active").otherwise("inactive")})


def apply_plan(remote: DataFrame, local: DataFrame, plan: DataFrame, new_id=None, recreate_on_price: bool = False) -> DataFrame:
    """The remote table after the plan: created and updated items take the local values, the rest stays.

    An update keeps the remote id (else the local one); with ``recreate_on_price`` a price change takes a new id,
    as platforms do that cannot edit prices.
    """
    new_id = new_id or (lambda sku: F.concat(F.lit("file_"), F.lower(sku)))
    acted = plan.filter(F.col("action").isin("create", "update")).select("sku", "action", F.exists("changes", lambda c: c["field"] == "price_usd").alias("_price"))
    old = remote.select("sku", F.col("external_id").alias("_old_id"))
    fresh = new_id(F.col("sku"))
    kept = F.coalesce("_old_id", "external_id")
    again = F.col("_price") if recreate_on_price else F.lit(False)
    given = F.lit(None).cast("string") if recreate_on_price else F.col("external_id")
    id_ = F.when(F.col("action") == "create", F.coalesce(given, fresh)).when(again, F.concat(fresh, F.lit("_2"))).otherwise(kept)
    changed = local.join(acted, "sku").join(old, "sku", "left").withColumn("external_id", id_)
    columns = [c for c in remote.columns if c != "seq"]
    return remote.select(columns).join(acted.select("sku"), "sku", "left_anti").unionByName(changed.select(columns))


def merge_platform_ids(existing: DataFrame, ids: DataFrame, products: DataFrame, platform: str) -> DataFrame:
    """Platform ids per product name, the newest id winning; unknown skus and null ids are left out; sorted.

    Of several new ids of one name the one with the largest ``seq`` wins, without that column the largest id.
    """
    turn = F.col("seq") if "seq" in ids.columns else F.col("external_id").cast("string")
    named = (ids.filter(truthy("external_id")).join(products.select("sku", "name"), "sku").groupBy("name")
             .agg(F.max_by(F.col("external_id").cast("string"), turn).alias("new_id")))
    j = existing.join(named, "name", "full_outer")
    return j.select("name", F.coalesce("new_id", "external_id").alias("external_id"),
                    F.when(F.col("new_id").isNotNull(), platform).otherwise(F.col("platform")).alias("platform")).orderBy("name")


def csv_rows(items: DataFrame) -> DataFrame:
    """The bulk-import columns as text; cost is never among them."""
    as_text = {"price_usd": F.format_string("%.2f", "price_usd"), "quantity": trim_number("quantity"),
               "size_mg": F.when(_has("size_mg"), trim_number("size_mg")).otherwise("")}
    return items.select(*[as_text.get(c, F.col(c)).alias(c) for c in CSV_COLUMNS])


def product_components(products: DataFrame, contains: DataFrame, components: DataFrame) -> DataFrame:
    """Components per product with ``place``: where the component's name stands in the product's name, null where it doesn't (those come last)."""
    j = contains.join(components, "component_id").join(products.select("product_id", F.col("name").alias("product_name")), "product_id")
    at = F.instr("product_name", F.col("component_name"))
    return j.withColumn("place", F.when(at > 0, at - 1)).drop("product_name")


def _subjects(products: DataFrame, contains: DataFrame) -> DataFrame:
    """(product_id, subject): the product itself and each of its components."""
    return products.select("product_id", F.col("product_id").alias("subject")).unionByName(
        contains.select("product_id", F.col("component_id").alias("subject"))).distinct()


def product_claims(products: DataFrame, contains: DataFrame, claims: DataFrame, about: DataFrame, supported_by: DataFrame,
                   studies: DataFrame, scope: str = "product_page") -> DataFrame:
    """(product_id, subject, claim_id, study_id): approved claims about a product or its components whose scope names
    the page literally, each with its verified citations (null when it has none). Kept as rows, so a subject with a
    large share of all claims is never one cell."""
    usable = claims.filter((F.col("status") == "approved") & F.array_contains("scope", scope)).select("claim_id")
    cited = supported_by.join(studies.filter(F.col("verified").eqNullSafe(True)).select("study_id"), "study_id")
    return (_subjects(products, contains).join(about.join(usable, "claim_id"), "subject")
            .join(cited, "claim_id", "left").select("product_id", "subject", "claim_id", "study_id"))


def product_studies(products: DataFrame, contains: DataFrame, studies: DataFrame, investigates: DataFrame) -> DataFrame:
    """(product_id, subject, study_id) of verified studies; a study may come through several subjects."""
    verified = studies.filter(F.col("verified").eqNullSafe(True)).select("study_id")
    return _subjects(products, contains).join(investigates.join(verified, "study_id"), "subject").select("product_id", "subject", "study_id")


def product_page(features: DataFrame) -> DataFrame:
    """The page that stands for each product: the last one that features it."""
    return features.groupBy("product_id").agg(F.max("page_id").alias("page_id"))


def product_faqs(products: DataFrame, contains: DataFrame, faqs: DataFrame, about: DataFrame, features: DataFrame, includes: DataFrame) -> DataFrame:
    """Distinct (product_id, faq_id): approved, about the product or a component, or included by its page."""
    approved = faqs.filter("status = 'approved'").select("faq_id")
    direct = _subjects(products, contains).join(about, "subject").select("product_id", "faq_id")
    paged = product_page(features).join(products.select("product_id"), "product_id", "left_semi").join(includes, "page_id").select("product_id", "faq_id")
    return direct.unionByName(paged).join(approved, "faq_id", "left_semi").distinct()


def testing_flags(products: DataFrame, lot_stock: DataFrame, us_labs: list[str]) -> DataFrame:
    """lot_tested, lot_purity_tested, lot_tested_us and the certificate lot per product.

    Tested means there is a lot with stock and every such lot has its certificate; accessories never claim it.
    """
    stocked = F.col("on_hand") > 0
    certified = F.coalesce(F.col("coa_status").isin("received", "published"), F.lit(False))
    every = lambda ok: F.coalesce(F.bool_and(F.when(stocked, ok)), F.lit(False))
    g = lot_stock.groupBy("product_id").agg(
        every(certified).alias("tested"), every(F.col("purity_measured").isNotNull()).alias("pure"),
        every(F.coalesce(F.col("coa_lab").isin(*us_labs), F.lit(False))).alias("us"),
        F.max(F.when(F.col("coa_status") == "published", F.col("lot_id"))).alias("coa_lot"))
    j = products.join(g, "product_id", "left")
    tested = F.coalesce("tested", F.lit(False)) & ~F.col("category").eqNullSafe(SUPPLY_CATEGORY)
    return j.withColumn("lot_tested", tested).withColumns({
        "lot_purity_tested": F.col("lot_tested") & F.coalesce("pure", F.lit(False)),
        "lot_tested_us": F.col("lot_tested") & F.coalesce("us", F.lit(False))}).drop("tested", "pure", "us")


def stock_flags(products: DataFrame) -> DataFrame:
    return products.withColumns({"in_stock": in_stock(), "jit_backorder": just_in_time() & (F.col("on_hand") == 0)})


def images_by_format(photos: DataFrame, formats: list[str]) -> DataFrame:
    """One url per product and format, the last one, as a column per format."""
    return photos.filter(truthy("format") & truthy("url")).groupBy("product_id").pivot("format", formats).agg(F.max_by("url", "photo_id"))


def composition_class(n_components, class_, category) -> Column:
    plain = F.trim(F.coalesce(class_, F.lit("")))
    return (F.when(category.eqNullSafe(SUPPLY_CATEGORY), SUPPLY_CLASS).when(n_components > 1, BLEND_CLASS)
            .when(plain != "", first_upper(plain)).otherwise(OTHER_CLASS))


def slug(text) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), F.lit("-"))


def product_documents(products: DataFrame, contains: DataFrame, components: DataFrame, stock: DataFrame, lot_stock: DataFrame,
                      photos: DataFrame, us_labs: list[str], formats: list[str]) -> DataFrame:
    """One row of public facts per sellable product; claims, studies and questions are separate tables of rows."""
    p = products.filter(F.col("status").isin(*SELLABLE)).join(stock.select("product_id", "on_hand"), "product_id", "left")
    p = stock_flags(p.withColumn("on_hand", F.coalesce("on_hand", F.lit(0.0))))
    p = testing_flags(p, lot_stock, us_labs).join(images_by_format(photos, formats), "product_id", "left")
    made = contains.join(components, "component_id").groupBy("product_id").agg(
        F.count("*").alias("n_components"), F.min_by(F.coalesce("class", "kind"), "pos").alias("_class"))
    p = p.join(made, "product_id", "left").withColumn("n_components", F.coalesce("n_components", F.lit(0)))
    p = p.withColumn("composition_class", composition_class(F.col("n_components"), F.col("_class"), F.col("category"))).drop("_class")
    p = p.withColumn("composition_slug", slug(F.col("composition_class")))
    return p.orderBy(F.col("category") != FIRST_CATEGORY, "name", "product_id")


# Fixed: the facts of a component that a product's document shows.
COMPONENT_FACTS = ("summary", "class", "kind", "sequence", "molecular_formula", "molecular_weight", "cas_number", "appearance")


def component_facts(products: DataFrame, contains: DataFrame, components: DataFrame) -> DataFrame:
    """One row for each component of a sellable product with its amount and public facts; ``place`` orders them by where the component's name stands in the product's
    name, those that don't appear last, then as listed."""
    p = products.filter(F.col("status").isin(*SELLABLE)).select("product_id", F.col("name").alias("_name"))
    c = components.select("component_id", "component_name", *COMPONENT_FACTS)
    at = F.position(F.col("component_name"), F.col("_name"))
    rows = p.join(contains.select("product_id", "component_id", "pos", "amount_mg"), "product_id").join(c, "component_id")
    rows = rows.withColumn("_at", F.when(at > 0, at).otherwise(F.lit(1_000_000)))
    own = F.struct("_at", "pos", "component_id")
    order = rows.groupBy("product_id").agg(F.sort_array(F.collect_list(own)).alias("_order"))  # a product's own parts list
    placed = rows.join(order, "product_id").withColumn("place", F.array_position("_order", own).cast("int"))
    return placed.select("product_id", "place", "component_id", "component_name", "amount_mg", *COMPONENT_FACTS)


LEAST_ALIAS = 5  # fixed: shorter aliases are not shown


def document_extras(products: DataFrame, photos: DataFrame, pages: DataFrame, assets: DataFrame) -> DataFrame:
    """(product_id, section, item, value): what a product's document holds besides its facts, as rows.

    ``alias``: names of LEAST_ALIAS letters or more of ``products`` (aliases array). ``alt``: for each format the text of the last of ``photos`` (photo_id, format, alt_text), empty
    where it has none. ``page``: title and meta_description of the last of ``pages`` (page_id, product_id) that feature the product. ``asset``: path, and as value the
    JSON of what is known of asset_type, alt_text and url of ``assets`` (product_id, path). Sellable products only.
    """
    p = products.filter(F.col("status").isin(*SELLABLE)).select("product_id", "aliases")
    of = lambda df, section, item, value: df.select("product_id", F.lit(section).alias("section"), item.alias("item"), value.alias("value"))
    named = p.select("product_id", F.explode(F.array_distinct("aliases")).alias("a")).filter(F.length("a") >= LEAST_ALIAS)
    last = photos.filter(truthy("format")).groupBy("product_id", "format").agg(F.max_by(F.coalesce("alt_text", F.lit("")), "photo_id").alias("alt"))
    page = pages.groupBy("product_id").agg(F.max_by(F.struct("title", "meta_description"), "page_id").alias("page"))
    told = page.select("product_id", F.explode(F.array(F.struct(F.lit("title").alias("k"), F.col("page.title").alias("v")),
                                                       F.struct(F.lit("meta_description").alias("k"), F.col("page.meta_description").alias("v")))).alias("e"))
    parts = [of(named, "alias", F.col("a"), F.lit(None).cast("string")), of(last, "alt", F.col("format"), F.col("alt")), of(told, "page", F.col("e.k"), F.col("e.v")),
             of(assets.distinct(), "asset", F.col("path"), F.to_json(F.struct("asset_type", "alt_text", "url")))]
    rows = parts[0]
    for more in parts[1:]:
        rows = rows.unionByName(more)
    return rows.join(p.select("product_id"), "product_id", "left_semi")


def area_products(documents: DataFrame) -> DataFrame:
    """(research_area, slug, position): the products of each area, numbered from 1 by name. Numbered over the whole table, so an area of any size is
    spread over tasks."""
    rows = documents.filter(F.col("research_area").isNotNull()).select("research_area", "name", "product_id", "slug")
    placed = number_rows(rows, ["research_area", "name", "product_id"], "_n")
    first = placed.groupBy("research_area").agg(F.min("_n").alias("_first"))
    return placed.join(first, "research_area").select("research_area", "slug", (F.col("_n") - F.col("_first") + 1).alias("position"))


def product_lots(products: DataFrame, lots: DataFrame) -> DataFrame:
    """The lots of each sellable product: product_id, lot_id, expires_on, purity_measured, coa_status."""
    sellable = products.filter(F.col("status").isin(*SELLABLE)).select("product_id")
    return lots.join(sellable, "product_id", "left_semi").select("product_id", "lot_id", "expires_on", "purity_measured", "coa_status")


def product_certificates(products: DataFrame, lots: DataFrame, links: DataFrame) -> DataFrame:
    """(product_id, lot_id, path, purity) of each sellable product that has one: the certificate that ``links`` (lot_id, path) ties to its last
    published lot with a certificate."""
    held = product_lots(products, lots).filter("coa_status = 'published'").join(links.select("lot_id", "path"), "lot_id")
    last = held.groupBy("product_id").agg(F.max_by(F.struct("lot_id", "path", F.col("purity_measured").alias("purity")), F.struct("lot_id", "path")).alias("c"))
    return last.select("product_id", "c.*")


def related_products(seeds: DataFrame, products: DataFrame, contains: DataFrame) -> DataFrame:
    """Distinct (product_id, slug): the active products that share a component with each of the seeds (product_id).

    Only the seeds' components are looked up; for the members of a component as they are, join ``contains`` with the products.
    """
    mine = seeds.select("product_id").distinct().join(contains.select("product_id", "component_id"), "product_id")
    active = products.filter("status = 'active' AND slug IS NOT NULL").select(F.col("product_id").alias("other"), "slug")
    other = contains.select(F.col("product_id").alias("other"), "component_id").join(active, "other")
    return mine.join(other, "component_id").filter("other <> product_id").select("product_id", "slug").distinct()


def composition_groups(documents: DataFrame) -> DataFrame:
    """Groups to browse by: class, slug, how many products are no supplies; supply groups last, then by name."""
    g = documents.groupBy("composition_slug").agg(
        F.min_by("composition_class", F.struct(F.col("category") != FIRST_CATEGORY, "name", "product_id")).alias("composition_class"),
        F.min_by(F.col("category").eqNullSafe(SUPPLY_CATEGORY), F.struct(F.col("category") != FIRST_CATEGORY, "name", "product_id")).alias("supplies"),
        F.count_if(~F.col("category").eqNullSafe(SUPPLY_CATEGORY)).alias("n_products"))
    return g.orderBy("supplies", "composition_class")


def labels(products: DataFrame, contains: DataFrame, components: DataFrame) -> DataFrame:
    """Adds family_name, label_name, size_label, composition_line and label_amount."""
    p = products.join(_parts(contains, components), "product_id", "left")
    none = F.array().cast("array<struct<pos:int,name:string,amount_mg:double,summary:string>>")
    p = p.withColumn("parts", F.coalesce("parts", none))
    names = F.transform("parts", lambda x: x["name"])
    own = F.when(truthy("display_name"), F.col("display_name"))
    joined = lambda sep: F.coalesce(own, F.when(F.size("parts") > 0, F.array_join(names, sep)), F.col("name"))
    size = (F.when(_has("size_mg"), F.concat(trim_number("size_mg"), F.lit(" mg"))).when(_has("size_ml"), F.concat(trim_number("size_ml"), F.lit(" ml"))).otherwise(""))
    blend = F.size("parts") > 1
    all_known = F.forall("parts", lambda x: F.coalesce(x["amount_mg"], F.lit(0.0)) != 0)
    amounts = F.array_join(F.transform("parts", lambda x: trim_number(x["amount_mg"])), "+")
    p = p.withColumns({"family_name": joined(" / "), "label_name": joined(" + "), "size_label": size,
                       "composition_line": F.when(blend, F.array_join(F.transform(_by_amount(F.col("parts")), _with_amount), " · ")).otherwise("")})
    amount = F.when(blend & own.isNull() & all_known, F.concat("size_label", F.lit(" ("), amounts, F.lit(")"))).otherwise(F.col("size_label"))
    return p.withColumn("label_amount", amount).drop("parts")


def search(documents: DataFrame, text: str, in_stock_only: bool = False) -> DataFrame:
    """Products whose name, family, size, sku, class or composition holds the text, accents and punctuation ignored."""
    hit = documents.filter(F.contains(fold(searched_text()), F.lit(fold_text(text))))
    return hit.filter(F.col("in_stock") & (F.col("status") == "active")) if in_stock_only else hit


def searched_text() -> Column:
    return F.concat_ws(" ", "name", "family_name", "size_label", "sku", "composition_class", "composition_line")


HEAD, WIDTH = 3, 32  # fixed: letters of a term that pick the places of a text; letters that are looked up as one key


def search_terms(documents: DataFrame, terms: DataFrame) -> DataFrame:
    """(term, sku) for a table of ``terms`` (term): the products of ``documents`` whose folded text (see :func:`search`) holds the folded term.

    A place of a text counts if the one to three letters there are those that some term begins with. There the text's pieces are taken in the lengths that these terms have, and
    looked up whole among the terms; so the work follows the places and the hits, however many terms begin alike. Of a term of over 32 letters the first 32 are looked
    up, and what is left is compared whole. A term that folds to nothing names no product; null terms and texts match nothing; repeated terms count once. ``sku`` is a product's key.
    """
    texts = materialize(documents.select("sku", fold(searched_text()).alias("text")).filter("text <> ''"), "folded-texts")
    asked = terms.select("term").filter("term IS NOT NULL").distinct().withColumn("want", fold("term")).filter("want <> ''")
    asked = materialize(asked.withColumn("key", F.substring("want", 1, WIDTH)), "terms")
    heads = materialize(asked.select(F.substring("key", 1, HEAD).alias("head"), F.length("key").alias("k")).groupBy("head").agg(F.collect_set("k").alias("ks")), "term-heads")  # at most WIDTH lengths each
    places = texts.select("sku", "text", F.explode(F.sequence(F.lit(1), F.length("text"))).alias("i"))
    begins = places.select("sku", "text", "i", F.explode(F.array(*[F.substr("text", "i", F.lit(n)) for n in range(1, HEAD + 1)])).alias("head"))
    pieces = begins.join(heads, "head").select("sku", F.explode(F.transform("ks", lambda k: F.substr("text", "i", k))).alias("key"))
    hits = pieces.join(asked, "key").select("term", "want", "sku").distinct()
    whole = hits.filter(F.length("want") <= WIDTH).select("term", "sku")
    long = hits.filter(F.length("want") > WIDTH).join(texts, "sku").filter(F.contains("text", F.col("want"))).select("term", "sku")
    return whole.unionByName(long)


def search_groups(hits: DataFrame) -> DataFrame:
    """Visible groups with their counts; groups without a hit do not appear."""
    return hits.groupBy("composition_slug").agg(F.count("*").alias("n_visible"))


def spec_rows(products: DataFrame, contains: DataFrame, components: DataFrame) -> DataFrame:
    """(product_id, block, pos, line, label, value): one row per present fact, in display order.

    The purity specification shows only where ``lot_purity_tested`` (see :func:`testing_flags`) allows the claim.
    """
    c = contains.join(components, "component_id").join(products.select("product_id", "category"), "product_id")
    n = contains.groupBy("product_id").agg(F.count("*").alias("n"))
    c = c.join(n, "product_id")
    prefix = F.when(F.col("n") > 1, F.concat("component_name", F.lit(" · "))).otherwise("")
    kind = F.when(~F.col("category").eqNullSafe(SUPPLY_CATEGORY), F.col("kind"))
    fact = lambda line, label, has, value: F.when(has, F.struct(F.lit(line).alias("line"), label.alias("label"), value.alias("value")))
    of = lambda text: F.concat(prefix, F.lit(text))
    parts = F.array_compact(F.array(
        fact(0, of("Amount per vial"), _has("amount_mg"), F.concat(trim_number("amount_mg"), F.lit(" mg"))),
        fact(1, of("Sequence"), truthy("sequence"), F.col("sequence")),
        fact(2, of("Molecular formula"), truthy("molecular_formula"), F.col("molecular_formula")),
        fact(3, of("Molecular weight"), _has("molecular_weight"), F.concat(trim_number("molecular_weight"), F.lit(" g/mol"))),
        fact(4, of("CAS number"), truthy("cas_number"), F.col("cas_number")),
        fact(5, of("Composition class"), truthy("class") | truthy(kind), F.coalesce("class", kind))))
    by_component = c.select("product_id", F.lit(0).alias("block"), "pos", F.explode(parts).alias("f"))
    # One entry per distinct appearance of the product's own components.
    looks = contains.join(components.filter(truthy("appearance")), "component_id").groupBy("product_id", "appearance").agg(F.min("pos").alias("pos"))
    look = looks.groupBy("product_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "appearance"))), lambda s: s["appearance"]), "; ").alias("look"))
    p = products.join(look, "product_id", "left")
    glass = F.when(F.col("vial_glass").eqNullSafe("amber"), " mL amber glass").otherwise(" mL clear glass")
    whole = F.array_compact(F.array(
        fact(0, F.lit("Volume"), _has("size_ml"), F.concat(trim_number("size_ml"), F.lit(" ml"))),
        fact(1, F.lit("Form"), F.lit(True), F.coalesce("form", F.lit(""))),
        fact(2, F.lit("Appearance"), truthy("look"), F.col("look")),
        fact(3, F.lit("Vial"), _has("vial_ml"), F.concat(trim_number("vial_ml"), glass)),
        fact(4, F.lit("Purity specification"), truthy("purity_spec") & F.col("lot_purity_tested"), F.replace("purity_spec", F.lit(">="), F.lit("≥"))),
        fact(5, F.lit("SKU"), F.lit(True), F.col("sku"))))
    of_product = p.select("product_id", F.lit(1).alias("block"), F.lit(0).alias("pos"), F.explode(whole).alias("f"))
    return by_component.unionByName(of_product).select("product_id", "block", "pos", "f.line", "f.label", "f.value")
