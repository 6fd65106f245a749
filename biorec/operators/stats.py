"""Derived statistics: squares, taxa, years, rarity, counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from biorec.functions.columns import RANKS, category_for_position, format_score, is_active, rank_column, record_date, square_key, stable_uuid
from biorec.functions.tables import as_files, settled, small_broadcasts

RARITY_MOST = 100


def _active_records(occ: DataFrame, taxa: DataFrame, *columns: str) -> DataFrame:
    """Active records of active taxa that have a square: occurrence_id, square, species_id (the taxon's)."""
    o = occ.where(is_active()).select(F.col("id").alias("occurrence_id"), "taxon_id", square_key(F.col("grid_ref_2km")).alias("square"), *columns).where("square is not null")
    return o.join(taxa.where(is_active()).select(F.col("id").alias("taxon_id"), "species_id"), "taxon_id")


def _dealt(df: DataFrame, key: str) -> DataFrame:
    """``df`` dealt out by a key to as many tasks as the session's shuffles have at most.

    Named by number they are not put together into few tasks, each of which may hold as much as adaptive execution thinks fit.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), key)


def _per_species(rows: DataFrame, bridge: DataFrame) -> DataFrame:
    """Records per square, region and species: what counts and scores are both made of.

    A task holds its share of both tables, sorted, and of the groups at the same time; so it gets a small share.
    """
    return _dealt(rows, "occurrence_id").join(_dealt(bridge, "occurrence_id"), "occurrence_id").groupBy("square", "geographic_region_id", "species_id").agg(F.count(F.lit(1)).alias("n"))


def _totals(rows: DataFrame, most: int) -> DataFrame:
    """Species with at most ``most`` records in all, regions apart."""
    return rows.where("species_id is not null").groupBy("species_id").agg(F.count(F.lit(1)).alias("total")).where(F.col("total") <= most)


def grid_square_counts(occ: DataFrame, bridge: DataFrame, taxa: DataFrame) -> DataFrame:
    """square, geographic_region_id, occurrences_count, species_count.

    Counted first per species, so that the distinct count needs no second expansion and a square
    or region of very many records is summed on the map side.
    """
    per = _per_species(_active_records(occ, taxa), bridge)
    return per.groupBy("square", "geographic_region_id").agg(F.sum("n").alias("occurrences_count"), F.count("species_id").alias("species_count"))


def _score() -> Column:
    return F.round(F.sum(F.lit(100.0) / F.col("total") * F.col("n")), 4)


def rarity_scores(occ: DataFrame, bridge: DataFrame, taxa: DataFrame, most: int = RARITY_MOST) -> DataFrame:
    """Sum of 100 / total over a square's records of species with at most ``most`` records in all (regions apart)."""
    rows = _active_records(occ, taxa)
    return _per_species(rows, bridge).join(_totals(rows, most), "species_id").groupBy("square", "geographic_region_id").agg(_score().alias("rarity_score"))


def grid_square_stats(occ: DataFrame, bridge: DataFrame, taxa: DataFrame, most: int = RARITY_MOST) -> DataFrame:
    """Counts and score of each square and region, from one table of records per species."""
    rows = _active_records(occ, taxa)
    per = _per_species(rows, bridge).join(_totals(rows, most), "species_id", "left")
    return per.groupBy("square", "geographic_region_id").agg(F.sum("n").alias("occurrences_count"), F.count("species_id").alias("species_count"), F.coalesce(_score(), F.lit(0.0)).alias("rarity_score"))


def reset_then_update(grid: DataFrame, counted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``grid`` with fresh counters (0 where nothing was counted), and the counted keys it lacks."""
    keys = ["square", "geographic_region_id"]
    counters = ["occurrences_count", "species_count", "rarity_score"]
    base = grid.withColumn("_square", F.upper(F.trim("square")))
    c = counted.select(F.col("square").alias("_square"), "geographic_region_id", *[F.col(x).alias("_" + x) for x in counters])
    new = base.join(c, ["_square", "geographic_region_id"], "left")
    values = {x: F.coalesce(F.col("_" + x), F.lit(0)).cast(grid.schema[x].dataType) for x in counters[:2]} | {"rarity_score": format_score(F.col("_rarity_score"))}
    return new.withColumns(values).select(*grid.columns), counted.join(base.select(F.col("_square").alias("square"), "geographic_region_id"), keys, "left_anti")


def _scopes(bridge: DataFrame) -> DataFrame:
    """occurrence_id, regions: the regions of each record, each once."""
    return bridge.select("occurrence_id", "geographic_region_id").repartition("occurrence_id").groupBy("occurrence_id").agg(F.collect_set("geographic_region_id").alias("regions"))


def _reported(occ: DataFrame, taxa: DataFrame, ranks: DataFrame, links: DataFrame, rank_names: tuple) -> DataFrame:
    """Active records of active taxa with their reporting taxa, each once, as the array ``taxa``, and their scopes (regions of ``_scopes``, and null for all) as ``scopes``."""
    ids = [rank_column(r) for r in rank_names]
    t = taxa.where(is_active()).select(F.col("id").alias("taxon_id"), "taxon_rank_id").join(ranks.select(F.col("id").alias("taxon_rank_id"), "is_reporting"), "taxon_rank_id")
    o = occ.where(is_active()).select(
        F.col("id").alias("occurrence_id"), "taxon_id", *ids, record_date().alias("record_date"), square_key(F.col("grid_ref_2km")).alias("square"),
        F.substring(F.coalesce(F.trim("recorded_by"), F.lit("")), 1, 255).alias("recorder"), F.upper(F.col("identification_verification_status")).startswith("V").alias("verified"),
    ).where("record_date is not null")
    exact = F.when(F.col("is_reporting") == 0, F.col("taxon_id"))
    taxon = F.array_distinct(F.filter(F.array(exact, *[F.col(i) for i in ids]), lambda x: x.isNotNull())).alias("taxa")
    everywhere = F.array(F.lit(None).cast("long"))
    # Links are dealt out as the records are for the join, so that one exchange serves both.
    # Taxa grow with the input, and their files tell little of how many they are: no broadcast, which would pass through the driver.
    rows = o.join(t.hint("merge"), "taxon_id").join(links, "occurrence_id", "left").withColumn("scopes", F.concat(everywhere, F.coalesce("regions", F.array().cast("array<bigint>"))))
    return rows.select("occurrence_id", "record_date", "square", "recorder", "verified", "scopes", taxon)


def _by_taxon(reported: DataFrame) -> DataFrame:
    """A row for each record and reporting taxon."""
    return reported.withColumn("taxon_id", F.explode("taxa")).drop("taxa")


#: So many taxa above others are told apart by a broadcast.
MOST_HIGHER = 200_000


def _spread(rows: DataFrame, taxa: DataFrame, rank_names: tuple) -> DataFrame:
    """``rows`` dealt out by taxon, those of taxa above others by square too; ``_part`` tells the square's part, and depends on taxon and square alone.

    Most taxa have few records, which meet in one task. A higher one gathers nearly all of them: its records
    are dealt out by square, and those without a square, which are no square to count, at random.
    """
    # Taxa without columns of ranks: any taxon may be a higher one.
    above = [F.col(c).cast("long") for c in map(rank_column, rank_names[:-1]) if c in taxa.columns]
    higher = taxa.select(F.explode(F.array(*above)).alias("taxon_id")).where("taxon_id is not null").distinct() if above else None
    part = F.coalesce("square", F.pmod(F.xxhash64("occurrence_id"), F.lit(1024)).cast("string"))
    if higher is not None and higher.count() <= MOST_HIGHER:
        marked = rows.join(F.broadcast(higher.withColumn("_higher", F.lit(True))), "taxon_id", "left")
        rows = marked.withColumn("_part", F.when(F.col("_higher"), part)).drop("_higher")
    else:
        rows = rows.withColumn("_part", part)
    return rows.repartition("taxon_id", "_part")


def taxon_stats(occ: DataFrame, taxa: DataFrame, ranks: DataFrame, bridge: DataFrame, rank_names: tuple = RANKS) -> DataFrame:
    """First and last records, counts and squares per taxon and scope.

    Two steps: partial results per square (which also makes squares distinct), then their merge. Records go to
    the first one unexpanded, once for each taxon, and get their scopes there; it needs no other exchange.
    The second one merges what a few tasks have of a higher taxon, and of others one row each.

    Links and records are laid down before: the exchanges that make them would stay on disk until all is done.
    """
    with small_broadcasts(occ.sparkSession):
        links = as_files(_scopes(bridge))
        reported = as_files(_reported(occ, taxa, ranks, links, rank_names))
    rows = _spread(_by_taxon(reported), taxa, rank_names)
    rows = rows.withColumn("geographic_region_id", F.explode("scopes"))
    at = F.struct("record_date", "occurrence_id", "recorder")
    sure = F.when(F.col("verified"), at)
    keys = ["taxon_id", "geographic_region_id"]
    per = rows.groupBy(*keys, "square", "_part").agg(F.count(F.lit(1)).alias("n"), F.min(at).alias("first"), F.max(at).alias("last"), F.min(sure).alias("vfirst"), F.max(sure).alias("vlast"))
    out = per.groupBy(*keys).agg(
        F.sum("n").alias("occurrences_count"), F.count("square").alias("grid_square_count"), F.min("first").alias("first"), F.max("last").alias("last"), F.min("vfirst").alias("vfirst"), F.max("vlast").alias("vlast")
    )
    known = lambda a, b, f: F.when(F.col(a).isNotNull(), F.col(f"{a}.{f}")).otherwise(F.col(f"{b}.{f}"))
    return out.select(
        stable_uuid(F.concat(F.col("taxon_id").cast("string"), F.lit("|"), F.coalesce(F.col("geographic_region_id").cast("string"), F.lit("global")))).alias("uuid"),
        *keys, "occurrences_count", "grid_square_count",
        F.col("first.record_date").alias("first_record_date"), F.col("last.record_date").alias("last_record_date"), F.col("first.recorder").alias("first_recorder"), F.col("last.recorder").alias("last_recorder"),
        known("vfirst", "first", "record_date").alias("first_verified_record_date"), known("vlast", "last", "record_date").alias("last_verified_record_date"),
        known("vfirst", "first", "recorder").alias("first_verified_recorder"), known("vlast", "last", "recorder").alias("last_verified_recorder"),
    )


def taxon_year_stats(occ: DataFrame, taxa: DataFrame, ranks: DataFrame, bridge: DataFrame, as_of: int, rank_names: tuple = RANKS) -> DataFrame:
    """Records and squares per taxon, scope and year, for the ten years up to ``as_of``."""
    # The window is tested before records are multiplied by their taxa.
    recent = occ.where((record_date() >= F.lit(f"{as_of - 9}-01-01").cast("date")) & (record_date() < F.lit(f"{as_of + 1}-01-01").cast("date")))
    rows = _by_taxon(_reported(recent, taxa, ranks, _scopes(bridge), rank_names)).withColumns({"year": F.year("record_date"), "geographic_region_id": F.explode("scopes")})
    keys = ["taxon_id", "geographic_region_id", "year"]
    per = rows.groupBy(*keys, "square").agg(F.count(F.lit(1)).alias("n"))
    out = per.groupBy(*keys).agg(F.sum("n").alias("occurrences_count"), F.count("square").alias("grid_square_count"))
    seed = F.concat_ws("|", F.col("taxon_id").cast("string"), F.coalesce(F.col("geographic_region_id").cast("string"), F.lit("global")), F.col("year").cast("string"))
    return out.select(stable_uuid(seed).alias("uuid"), *keys, "occurrences_count", "grid_square_count")


#: Up to so many rows of a group are ranked by one task.
MOST_IN_TASK = 1_000_000


def positions(rows: DataFrame, group: str, order: list[str], name: str) -> DataFrame:
    """``rows`` with their place from 1 in their group, in this order, which must have no ties.

    Rows are sorted by group and order in parts; each part counts its rows of each group, and a
    group goes on in a part where the parts before it end. No task holds a whole group.
    """
    sorted_rows = settled(rows.orderBy(group, *order).withColumn("_part", F.spark_partition_id()))
    parts = sorted_rows.groupBy(group, "_part").agg(F.count(F.lit(1)).alias("_n"))
    # At most as many rows for a group as there are parts.
    before = Window.partitionBy(group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    bases = parts.select(group, "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    at = F.row_number().over(Window.partitionBy(group, "_part").orderBy(*order))
    return sorted_rows.withColumn("_at", at).join(bases, [group, "_part"]).withColumn(name, F.col("_at") + F.col("_base")).drop("_part", "_at", "_base")


def dense_ranks(rows: DataFrame, group: str, column: str, name: str) -> DataFrame:
    """``rows`` with the dense rank of a column in their group: the place of its value among the group's distinct values."""
    places = positions(rows.select(group, column).distinct(), group, [column], name)
    return rows.join(places, [group, column])


def taxon_rarity(taxa: DataFrame, occ: DataFrame, square_weight: float = 1.0, occurrence_weight: float = 1.0, most_in_task: int = MOST_IN_TASK) -> DataFrame:
    """id, group_name, category of active taxa that are their own species, ranked within their group: 1 is the rarest.

    Groups of more than ``most_in_task`` taxa are ranked in parts.
    """
    group = F.trim("rarity_group_name")
    own = taxa.where(is_active() & (F.col("species_id") == F.col("id")) & (group != "")).select("id", "taxon_identifier", group.alias("group_name"))
    per = occ.where(is_active() & F.col("species_id").isNotNull()).groupBy(F.col("species_id").alias("id"), square_key(F.col("grid_ref_2km")).alias("square")).agg(F.count(F.lit(1)).alias("n"))
    counts = per.groupBy("id").agg(F.sum("n").alias("records"), F.count("square").alias("squares"))
    rows = own.join(counts, "id", "left").na.fill(0, ["records", "squares"])
    sizes = own.groupBy("group_name").agg(F.count(F.lit(1)).alias("size"))
    score = F.col("rs") * F.lit(float(square_weight)) + F.col("ro") * F.lit(float(occurrence_weight))
    order = ["score", "rs", "ro", "taxon_identifier"]
    if (sizes.agg(F.max("size")).first()[0] or 0) > most_in_task:
        rows = dense_ranks(dense_ranks(settled(rows), "group_name", "squares", "rs"), "group_name", "records", "ro").withColumn("score", score)
        rows = positions(rows, "group_name", order, "place").join(sizes, "group_name")
    else:
        by = lambda c: F.dense_rank().over(Window.partitionBy("group_name").orderBy(c))
        rows = rows.withColumns({"rs": by("squares"), "ro": by("records")}).withColumn("score", score)
        rows = rows.withColumns({"place": F.row_number().over(Window.partitionBy("group_name").orderBy(*order)), "size": F.count(F.lit(1)).over(Window.partitionBy("group_name"))})
    return rows.select("id", "group_name", category_for_position(F.col("place") - 1, F.col("size")).alias("category"))


def apply_rarity(taxa: DataFrame, rarity: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``taxa`` with new categories, and how many rows changed or not. Taxa that are no species lose theirs; a null species_id keeps it."""
    given = taxa.join(rarity.select("id", F.col("category").alias("_new")), "id", "left")
    if not rarity.limit(1).count():
        fresh = F.lit(None)
    else:
        fresh = F.when(F.col("_new").isNotNull(), F.col("_new")).when(F.col("species_id") != F.col("id"), F.lit(None)).otherwise(F.col("rarity_category"))
    marked = given.withColumn("_to", fresh.cast("int"))
    counts = marked.where("_new is not null").groupBy(F.when(F.col("_to").eqNullSafe(F.col("rarity_category")), "unchanged").otherwise("changed").alias("action")).agg(F.count(F.lit(1)).alias("n"))
    return marked.withColumn("rarity_category", F.col("_to")).select(*taxa.columns), counts


def home_counts(occ: DataFrame, taxa: DataFrame, ranks: DataFrame, regions: DataFrame) -> DataFrame:
    """One row: active occurrences, active taxa of reporting ranks, regions that are not deleted."""
    reporting = ranks.where("is_reporting = 1").select(F.col("id").alias("taxon_rank_id"))
    parts = (occ.where(is_active()), taxa.where(is_active()).join(reporting, "taxon_rank_id", "left_semi"), regions.where("deleted_at is null"))
    kinds = ("occurrences", "taxa", "regions")
    rows = [p.select(F.lit(k).alias("kind")) for p, k in zip(parts, kinds)]
    every = rows[0].unionByName(rows[1]).unionByName(rows[2])
    return every.agg(*[F.count_if(F.col("kind") == k).alias(k) for k in kinds])


def count_by(base: DataFrame, rows: DataFrame, fk: str, name: str) -> DataFrame:
    """``base`` with the number of ``rows`` that refer to it, 0 included."""
    counts = rows.groupBy(F.col(fk).alias("id")).agg(F.count(F.lit(1)).alias(name))
    return base.join(counts, "id", "left").na.fill(0, [name])


def regions_text(bridge: DataFrame, regions: DataFrame) -> DataFrame:
    """Distinct region identifiers of each occurrence, sorted, joined by ``;``."""
    named = bridge.join(regions.where("deleted_at is null").select(F.col("id").alias("geographic_region_id"), "higher_geography_identifier"), "geographic_region_id")
    return named.groupBy("occurrence_id").agg(F.array_join(F.array_sort(F.collect_set("higher_geography_identifier")), ";").alias("regions"))


def run_summary(merged: DataFrame, action: Column | str = "action") -> DataFrame:
    return merged.groupBy(action).agg(F.count(F.lit(1)).alias("n"))


def audit_counts(grid: DataFrame, occ: DataFrame, bridge: DataFrame, taxa: DataFrame) -> DataFrame:
    """Stored squares whose counts differ from recomputed ones."""
    fresh = grid_square_counts(occ, bridge, taxa).select("square", "geographic_region_id", F.col("occurrences_count").alias("o"), F.col("species_count").alias("s"))
    j = grid.select("square", "geographic_region_id", "occurrences_count", "species_count").join(fresh, ["square", "geographic_region_id"], "left").na.fill(0, ["o", "s"])
    return j.where("occurrences_count != o or species_count != s").select("square", "geographic_region_id", "occurrences_count", F.col("o").alias("recomputed_occurrences"), "species_count", F.col("s").alias("recomputed_species"))


def audit_rarity(grid: DataFrame, occ: DataFrame, bridge: DataFrame, taxa: DataFrame, most: int = RARITY_MOST) -> DataFrame:
    """Stored scores that differ from recomputed ones by more than 0.0001."""
    fresh = rarity_scores(occ, bridge, taxa, most).withColumnRenamed("rarity_score", "recomputed")
    j = grid.select("square", "geographic_region_id", F.col("rarity_score").cast("double").alias("rarity_score")).join(fresh, ["square", "geographic_region_id"], "left").na.fill(0.0, ["recomputed"])
    return j.where(F.abs(F.col("rarity_score") - F.col("recomputed")) > 0.0001)
