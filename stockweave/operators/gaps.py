"""Gap reports: what is expiring, low, missing, unused, unverified or stale."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from stockweave.operators.orders import just_in_time


def expiring_lots(lots: DataFrame, today, days: int = 90) -> DataFrame:
    """Lots that expire within ``days`` of ``today``, the expired ones included."""
    left = F.datediff("expires_on", today)
    return lots.withColumn("days_left", left).filter(F.col("days_left") <= days)


def low_stock(stock: DataFrame, at_most: float = 3) -> DataFrame:
    """Active products at or below the limit; just-in-time products at exactly zero are in order."""
    return stock.filter((F.col("status") == "active") & (F.col("on_hand") <= at_most)
                        & ~(just_in_time() & (F.col("on_hand") == 0)))


def without_photo(products: DataFrame, photos: DataFrame) -> DataFrame:
    """Sellable products no photo depicts."""
    return products.filter(F.col("status").isin("active", "coming_soon")).join(photos, "product_id", "left_anti")


def without_live_page(products: DataFrame, features: DataFrame, pages: DataFrame) -> DataFrame:
    """Active products no live page features; a draft page does not count."""
    live = features.join(pages.filter("status = 'live'").select("page_id"), "page_id", "left_semi").select("product_id")
    return products.filter("status = 'active'").join(live, "product_id", "left_anti")


def untargeted_keywords(keywords: DataFrame, targets: DataFrame) -> DataFrame:
    return keywords.join(targets, "keyword_id", "left_anti")


def uncited_studies(studies: DataFrame, cites: DataFrame) -> DataFrame:
    """Verified studies no page cites."""
    return studies.filter(F.col("verified").eqNullSafe(True)).join(cites, "study_id", "left_anti")


def unverified_studies(studies: DataFrame) -> DataFrame:
    """Studies not marked verified; null is not verified."""
    return studies.filter(~F.col("verified").eqNullSafe(True))


def stale_pages(pages: DataFrame, links: DataFrame, changes: DataFrame) -> DataFrame:
    """Live pages linked to something that changed after their last update; one row per page, its first such link.

    ``links`` has page_id and other; ``changes`` has other and changed_on.
    """
    live = pages.filter("status = 'live' AND last_updated IS NOT NULL").select("page_id", "last_updated")
    late = live.join(links, "page_id").join(changes, "other").filter("changed_on > last_updated")
    return late.groupBy("page_id", "last_updated").agg(F.min(F.struct("other", "changed_on")).alias("f")).select(
        "page_id", "last_updated", "f.other", "f.changed_on")


def conflicted_nodes(conflicts: DataFrame) -> DataFrame:
    """Nodes with unresolved conflicts and the number of attributes concerned."""
    return conflicts.select("id", "attr").distinct().groupBy("id").agg(F.count("*").alias("n_attrs"))
