"""Taxonomy reports over taxa with a path of ancestor ids (``path array<bigint>``)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from biorec.functions.tables import settled


def with_paths(taxa: DataFrame) -> DataFrame:
    """``taxa(id, parent_taxon_id)`` with ``path``: the ids from the topmost ancestor down to the taxon itself.

    Pointer doubling: each round, a taxon takes over the ancestors of the topmost one that it knows,
    so that as many rounds are enough as the logarithm of the greatest depth. A parent that is no taxon
    ends a path; on a cycle, each ancestor is named once, and the taxon itself last. An id has one path:
    if several rows have it, that of their largest parent. Otherwise each way through them would be a row.
    """
    once = taxa.groupBy("id").agg(F.max("parent_taxon_id").alias("p"))
    known = once.select(F.col("id").alias("_parent"))
    linked = once.join(known, F.col("p") == F.col("_parent"), "left")
    found = settled(linked.select("id", F.filter(F.array("_parent"), lambda x: x.isNotNull() & (x != F.col("id"))).alias("above")).withColumn("top", F.get("above", F.lit(0))))
    while found.where("top is not null").limit(1).count():
        further = found.select(F.col("id").alias("top"), F.col("above").alias("more"), F.col("top").alias("next"))
        joined = found.join(further, "top", "left").withColumn("walk", F.concat("above", F.coalesce("more", F.array().cast("array<bigint>"))))
        # A walk that comes back to where it has been is complete.
        once = F.filter(F.array_distinct("walk"), lambda x: x != F.col("id"))
        found = settled(joined.select("id", once.alias("above"), F.when(F.size(once) == F.size("walk"), F.col("next")).alias("top")))
    return taxa.join(found.select("id", F.concat(F.reverse("above"), F.array("id")).alias("path")), "id")


def ancestors(taxa: DataFrame) -> DataFrame:
    """id, ancestor: a row for each element of a taxon's path."""
    return taxa.select("id", F.explode(F.array_distinct("path")).alias("ancestor"))


def taxa_report(taxa: DataFrame, groups: list[str]) -> DataFrame:
    """Taxa of these groups and all their ancestors."""
    chosen = taxa.where(F.col("taxon_group").isin(groups))
    wanted = chosen.select("id").unionByName(ancestors(chosen).select(F.col("ancestor").alias("id"))).distinct()
    return taxa.join(wanted, "id", "left_semi")


def taxa_with_scheme(taxa: DataFrame, groups: list[str], schemes: DataFrame, designations: DataFrame) -> DataFrame:
    """``taxa_report`` with each taxon's recording scheme, of its own or any ancestor, and its Red List designation.

    ``designations(taxon_id, abbreviation)``: of several the last in alphabetical order.
    """
    status = designations.groupBy(F.col("taxon_id").alias("id")).agg(F.max("abbreviation").alias("conservation_status"))
    report = taxa_report(taxa, groups)
    return report.join(schemes_by_ancestor(report, schemes), "id", "left").join(status, "id", "left")


def schemes_by_ancestor(taxa: DataFrame, schemes: DataFrame) -> DataFrame:
    """id, recording_scheme_id by any taxon of the path, of ``schemes(taxon_id, recording_scheme_id)``; of several the largest id."""
    return ancestors(taxa).join(schemes, F.col("ancestor") == F.col("taxon_id")).groupBy("id").agg(F.max("recording_scheme_id").alias("recording_scheme_id"))


def nearest_parent(taxa: DataFrame) -> DataFrame:
    """id, parent_id: the ancestor with the largest rank order below the taxon's own; ties to the larger id."""
    above = taxa.select(F.col("id").alias("ancestor"), F.col("sort_order").alias("order"))
    own = taxa.select("id", "sort_order", F.explode(F.array_distinct("path")).alias("ancestor"))
    found = own.join(above, "ancestor").where("order < sort_order and ancestor != id")
    return found.groupBy("id").agg(F.max_by("ancestor", F.struct("order", "ancestor")).alias("parent_id"))


def higher_taxa(taxa: DataFrame) -> DataFrame:
    """id, higher_taxa: JSON of the path's taxa at reporting ranks, by rank order and id. Rows that share an id name a taxon of their paths once."""
    above = taxa.where("is_reporting = 1").select(F.col("id").alias("ancestor"), F.struct(F.col("sort_order"), F.col("id"), F.col("organism_key"), F.col("taxon"), F.col("taxon_rank")).alias("h"))
    lists = ancestors(taxa).distinct().join(above, "ancestor").groupBy("id").agg(F.array_sort(F.collect_list("h")).alias("hs"))
    return lists.select("id", F.to_json(F.transform("hs", lambda h: F.struct(h["organism_key"].alias("organism_key"), h["taxon"].alias("taxon"), h["taxon_rank"].alias("taxon_rank")))).alias("higher_taxa"))


def groups_report(taxa: DataFrame, groups: DataFrame, titles: list[str]) -> DataFrame:
    """Groups of the chosen taxa and their ancestors; ``implied`` if the title was not chosen."""
    used = taxa_report(taxa, titles).select(F.col("taxon_group").alias("title")).distinct()
    return groups.join(used, "title", "left_semi").withColumn("implied", F.when(F.col("title").isin(titles), 0).otherwise(1))


def names_report(names: DataFrame, taxa: DataFrame) -> DataFrame:
    """All names of these taxa; Latin names are scientific."""
    return names.join(taxa.select(F.col("id").alias("taxon_id")), "taxon_id", "left_semi").withColumn("scientific", F.when(F.col("language") == "lat", 1).otherwise(0))


def ranks_report(ranks: DataFrame, taxa: DataFrame) -> DataFrame:
    return ranks.join(taxa.select(F.col("taxon_rank").alias("rank")), "rank", "left_semi")


def schemes_report(schemes: DataFrame) -> DataFrame:
    """Recording schemes that are not deleted."""
    return schemes.where("deleted_at is null")


def regions_report(locations: DataFrame, names: list[str], location_type: str) -> DataFrame:
    return locations.where(F.col("name").isin(names) & (F.col("type") == location_type) & F.col("deleted_at").isNull())
