"""Linking references to nodes: canonical key first, then aliases."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from stockweave.functions.keys import has_type_prefix, norm_key, ref_name, ref_type
from stockweave.functions.runtime import materialize


def _spoken(nodes: DataFrame) -> DataFrame:
    surfaces = F.array_union(F.array("name"), F.coalesce("aliases", F.array().cast("array<string>")))
    rows = nodes.select("id", "type", F.explode(surfaces).alias("surface")).filter(F.col("surface") != "")
    return rows.select(norm_key("surface").alias("alias_key"), "type", "id")


def alias_index(nodes: DataFrame) -> DataFrame:
    """Unique (alias_key, type, id) rows from every node's name and aliases; empty surfaces are skipped."""
    return _spoken(nodes).distinct()


def resolve(refs: DataFrame, nodes: DataFrame, type_col: str = "type", name_col: str = "name", out: str = "node_id") -> DataFrame:
    """Add the node id of each typed reference, null when nothing matches.

    A canonical hit wins; otherwise an alias of a node of the same type, the smallest id when several match. Both
    are one lookup table by (type, key), so the references are joined, and shuffled, once.
    """
    canonical = nodes.select(F.split("id", ":", 2)[1].alias("alias_key"), F.split("id", ":", 2)[0].alias("type"), "id", F.lit(0).alias("rank"))
    ranked = canonical.unionByName(_spoken(nodes).withColumn("rank", F.lit(1)))
    lookup = ranked.groupBy(F.col("type").alias("_type"), "alias_key").agg(F.min(F.struct("rank", "id"))["id"].alias(out))
    keyed = refs.withColumn("_key", norm_key(name_col))
    hit = keyed.join(lookup, (F.col("_key") == F.col("alias_key")) & (F.col(type_col) == F.col("_type")), "left")
    return hit.drop("_key", "alias_key", "_type")


def _names(nodes: DataFrame) -> DataFrame:
    """(id, type, key, rank) of everything a node answers to, in one pass over the nodes: rank 0 for its canonical key, with the type its id
    begins with, 1 for its name and aliases."""
    surfaces = F.array_union(F.array("name"), F.coalesce("aliases", F.array().cast("array<string>")))
    one = lambda type_, key, rank: F.struct(type_.alias("type"), key.alias("key"), F.lit(rank).alias("rank"))
    canonical = one(F.split("id", ":", 2)[0], F.split("id", ":", 2)[1], 0)
    spoken = F.transform(F.filter(surfaces, lambda x: x != ""), lambda x: one(F.col("type"), norm_key(x), 1))
    return nodes.select("id", F.explode(F.concat(F.array(canonical), spoken)).alias("n")).select("id", "n.*")


def resolve_any(refs: DataFrame, nodes: DataFrame, ref_col: str = "ref") -> DataFrame:
    """Resolve ``Type:Name`` or bare names; adds node_id, n_matches and status (found, not_found, ambiguous).

    A bare name is looked up over all types and must match one node. All matches of a key are one row of a lookup table, typed and
    bare alike, so a name shared by many nodes costs one row, the nodes are read once and the references are joined once; :func:`candidates_of`
    lists the nodes of an ambiguous name. A null reference is not found.
    """
    names = materialize(_names(nodes), "names")
    typed = names.groupBy(F.col("type").alias("_type"), F.col("key").alias("_key")).agg(F.min(F.struct("rank", "id"))["id"].alias("node_id"))
    bare = (names.filter("rank = 1").select(F.col("key").alias("_key"), "type", "id").distinct().groupBy("_key")
            .agg(F.count("*").alias("n_matches"), F.min("id").alias("_id")))
    lookup = typed.withColumn("n_matches", F.lit(1).cast("bigint")).unionByName(
        bare.select(F.lit("").alias("_type"), "_key", F.when(F.col("n_matches") == 1, F.col("_id")).alias("node_id"), "n_matches"))
    has_type = F.coalesce(has_type_prefix(ref_col), F.lit(False))
    keyed = refs.withColumns({"_type": F.when(has_type, ref_type(ref_col)).otherwise(""),
                              "_key": norm_key(F.when(has_type, ref_name(ref_col)).otherwise(F.col(ref_col)))})
    hit = keyed.join(lookup, ["_type", "_key"], "left").withColumn("n_matches", F.coalesce("n_matches", F.lit(0)))
    status = F.when(F.col("n_matches") == 0, "not_found").when(F.col("n_matches") == 1, "found").otherwise("ambiguous")
    return hit.withColumn("status", status).select(*refs.columns, "node_id", "n_matches", "status")


def candidates_of(refs: DataFrame, nodes: DataFrame, ref_col: str = "ref") -> DataFrame:
    """Every (ref, node id) match of the bare names in ``refs``."""
    bare = refs.filter(~has_type_prefix(ref_col)).select(ref_col, norm_key(ref_col).alias("alias_key")).distinct()
    return bare.join(alias_index(nodes), "alias_key").select(ref_col, "id")
