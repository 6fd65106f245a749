"""Reject, resolve and merge incoming rows.

An upsert of an entity takes the stored table and normalised rows with an order of arrival (column
``order``); it gives the merged table with an ``action`` for each row, and the rejected rows with
their ``reason``. Of rows with one key the last one counts.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from biorec.functions.columns import RANKS, is_irecord_origin, needs_regeneration, nullable_date, nullable_float, nullable_int, nullable_string, rank_column, stable_uuid, to_flag, unique_key
from biorec.functions.tables import as_files, settled
from biorec.operators.geo import assign_grid_refs


def dedupe_last(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The last row for each key by ``order``; rows with a blank key go. Partial aggregates keep hot keys small."""
    full = df
    for k in keys:
        full = full.where(F.trim(F.col(k).cast("string")) != "")
    rest = [c for c in df.columns if c not in keys]
    best = full.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("_r"))
    return best.select(*[F.col(c) if c in keys else F.col(f"_r.{c}").alias(c) for c in df.columns])


def split_rejects(df: DataFrame, rules: list[tuple[str, Column]], settle: bool = True) -> tuple[DataFrame, DataFrame]:
    """Good rows, and rejected ones with the first reason that holds. Rows are settled once for both, unless they are cheap to read twice."""
    reason = F.lit(None).cast("string")
    for text, test in reversed(rules):
        reason = F.when(F.coalesce(test, F.lit(False)), F.lit(text)).otherwise(reason)
    marked = df.withColumn("reason", reason)
    marked = settled(marked) if settle else marked
    return marked.where("reason is null").drop("reason"), marked.where("reason is not null")


#: Characters of a rank's name and of its abbreviation.
ABBR = 50


def blank(name: str) -> Column:
    return F.coalesce(F.trim(F.col(name).cast("string")), F.lit("")) == ""


# Rules for each entity in the order of their reasons.
REJECTS: dict[str, Callable[[], list[tuple[str, Column]]]] = {
    "taxon_groups": lambda: [("blank key or title", blank("external_key") | blank("title")), ("no source id", F.coalesce(F.col("indicia_taxon_group_id"), F.lit(0)) == 0)],
    "recording_schemes": lambda: [("blank key or title", blank("external_key") | blank("title"))],
    "taxon_ranks": lambda: [("blank rank", blank("rank"))],
    "geographic_regions": lambda: [("no identifier", blank("higher_geography_identifier") | (F.coalesce(F.col("higher_geography_identifier").try_cast("double"), F.lit(1.0)) <= 0)), ("blank name or type", blank("higher_geography") | blank("location_type")), ("unknown data source", F.col("data_source_id").isNull())],
    "grid_square_stats": lambda: [("incomplete square", blank("square") | F.col("easting").isNull() | F.col("northing").isNull() | F.col("lat").isNull() | F.col("lon").isNull()), ("unknown region", F.col("geographic_region_id").isNull())],
    "taxa": lambda: [("blank id or name", blank("taxon_identifier") | blank("scientific_name_identifier") | blank("scientific_name")), ("unknown group", F.col("taxon_group_id").isNull())],
    "taxon_names": lambda: [("blank id or name", blank("taxon_identifier") | blank("given_name_identifier") | blank("name")), ("unknown taxon", F.col("taxon_id").isNull())],
    "occurrences": lambda: [
        ("missing ids", blank("remote_id") | blank("scientific_name_identifier") | blank("given_name_identifier")), ("unknown taxon or name", F.col("taxon_id").isNull() | F.col("taxon_name_id").isNull()),
        ("no position for a reference", F.col("_regenerate") & F.col("grid_ref").isNull()), ("blank reference", blank("grid_ref")), ("owned by iRecord", F.col("_owned")),
    ],
}


def merge(existing: DataFrame, incoming: DataFrame, keys: list[str], keep: tuple[str, ...] = (), insert_only: dict[str, Column] | None = None, resets: dict[str, Column] | None = None, top: int | None = None, blanks: bool = True) -> DataFrame:
    """Upsert on the business keys; one row for each key with ``action`` (inserted, updated, unchanged, kept).

    ``keep`` columns are never overwritten, ``insert_only`` gives values for new rows only, and
    ``resets`` sets columns of matched rows. New rows get ids after the largest one, numbered over
    the new keys only, unless incoming rows bring an ``id``. ``top`` is that largest id, where
    ``existing`` is only a part of the table. Incoming must be unique on the keys; where it has no
    null in them (not ``blanks``), rows that are dealt out by their keys are not dealt out again.
    """
    insert_only, resets = insert_only or {}, resets or {}
    e = existing.withColumn("_e", F.lit(True)).alias("e")
    i = incoming.withColumn("_i", F.lit(True)).alias("i")
    on = [F.col(f"e.{k}").eqNullSafe(F.col(f"i.{k}")) if blanks else F.col(f"e.{k}") == F.col(f"i.{k}") for k in keys]
    joined = e.join(i, on, "full_outer")
    both, new = F.col("e._e") & F.col("i._i"), F.col("e._e").isNull()
    given = set(incoming.columns)
    columns = []
    for c in existing.columns:
        old = F.col(f"e.{c}")
        fresh = F.col(f"i.{c}").cast(existing.schema[c].dataType) if c in given else F.lit(None).cast(existing.schema[c].dataType)
        if c == "id":
            columns.append((F.coalesce(old, fresh) if c in given else old).alias(c))
        elif c in keys:
            columns.append(F.coalesce(old, fresh).alias(c))
        else:
            value = F.when(new, insert_only[c] if c in insert_only else fresh)
            changed = resets[c] if c in resets else fresh if c in given and c not in keep and c not in insert_only else old
            columns.append(value.when(both, changed).otherwise(old).cast(existing.schema[c].dataType).alias(c))
    data = [c for c in existing.columns if c != "id"]
    same = F.lit(True)
    for c, value in zip(existing.columns, columns):
        if c in data:
            same = same & F.col(f"e.{c}").eqNullSafe(value)
    action = F.when(new, "inserted").when(both & ~same, "updated").when(both, "unchanged").otherwise("kept")
    out = joined.select(*columns, action.alias("action"))
    if "id" not in existing.columns or "id" in given:
        return out
    # Laid down, as it is used twice; and a filter on ``action``, which names every column, would be carried through all of them.
    out = as_files(out)
    if top is None:
        # Every stored row is there with its id.
        top = largest_id(out)
    fresh = out.where("action = 'inserted'")
    return out.where("action != 'inserted'").unionByName(numbered(fresh, keys, top))


def largest_id(df: DataFrame) -> int:
    return df.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]


def numbered(new: DataFrame, keys: list[str], top: int) -> DataFrame:
    """Ids from ``top`` + 1 by key: sorted in parts, each part offset by the rows before it.

    The sorted rows are laid down first, so that parts and offsets are of one execution.
    """
    ordered = as_files(new.drop("id").orderBy(*keys).withColumns({"_p": F.spark_partition_id(), "_at": F.monotonically_increasing_id()}))
    counts = sorted((r["_p"], r["first"], r["n"]) for r in ordered.groupBy("_p").agg(F.min("_at").alias("first"), F.count(F.lit(1)).alias("n")).collect())
    shifts, base = [], top + 1
    for part, first, n in counts:  # one row for each partition of the sort
        shifts.append((part, base - first))
        base += n
    offsets = new.sparkSession.createDataFrame(shifts, "_p int, _shift long")
    return ordered.join(F.broadcast(offsets), "_p").withColumn("id", (F.col("_at") + F.col("_shift")).cast(new.schema["id"].dataType)).select(*new.columns)


def resolve_taxon(df: DataFrame, taxa: DataFrame) -> DataFrame:
    """Add taxon_id and the rank columns by ``scientific_name_identifier``; of several taxa the largest id.

    Taxa and names are met in merge joins: a file's size tells little of how many there are, and a
    broadcast of a large table would pass through the driver.
    """
    ids = [rank_column(r) for r in RANKS if rank_column(r) in taxa.columns]
    by = taxa.groupBy("scientific_name_identifier").agg(F.max_by(F.struct(F.col("id").alias("taxon_id"), *ids), "id").alias("_t"))
    return df.join(by.hint("merge"), "scientific_name_identifier", "left").withColumns({c: F.col(f"_t.{c}") for c in ("taxon_id", *ids)}).drop("_t")


def resolve_taxon_name(df: DataFrame, names: DataFrame) -> DataFrame:
    """Add taxon_name_id by the given name's identifier, or else by the accepted name's; of several names the largest id."""
    by = names.groupBy("given_name_identifier").agg(F.max("id").alias("_n"))
    # The accepted name first: rows that come from ``resolve_taxon`` are dealt out for it already.
    accepted = df.join(by.toDF("scientific_name_identifier", "_n2").hint("merge"), "scientific_name_identifier", "left")
    return accepted.join(by.withColumnRenamed("_n", "_n1").hint("merge"), "given_name_identifier", "left").withColumn("taxon_name_id", F.coalesce("_n1", "_n2")).drop("_n1", "_n2")


Upserted = tuple[DataFrame, DataFrame]


def _live(df: DataFrame) -> DataFrame:
    return df.where("deleted_at is null")


def _lookup(df: DataFrame, other: DataFrame, on: dict[str, str], gives: dict[str, str]) -> DataFrame:
    """``df`` with columns ``gives`` of the live row of ``other`` that matches; of several the one with the largest id."""
    best = _live(other).groupBy(*[F.col(v).alias(f"_{k}") for k, v in on.items()]).agg(F.max_by(F.struct(*[F.col(v).alias(k) for k, v in gives.items()]), "id").alias("_found"))
    test = [F.trim(F.col(k)) == F.col(f"_{k}") for k in on]
    return df.join(best, test, "left").withColumns({k: F.col(f"_found.{k}") for k in gives}).drop("_found", *[f"_{k}" for k in on])


def _upserted(existing: DataFrame, rows: DataFrame, entity: str, keys: list[str], order: str, **how) -> Upserted:
    """Split off the rejects, take the last row of each key and merge the columns that the table has."""
    good, bad = split_rejects(rows, REJECTS[entity]())
    kept = [c for c in good.columns if c in existing.columns and c not in ("deleted_at", "blocked")]
    last = dedupe_last(good.select(*kept, F.col(order).alias("_order")), keys, "_order").drop("_order")
    gone = {"deleted_at": F.lit(None).cast("timestamp")} if "deleted_at" in existing.columns else {}
    return merge(existing, last, keys, resets=gone | how.pop("resets", {}), **how), bad


def upsert_taxon_groups(existing: DataFrame, incoming: DataFrame, order: str = "order") -> Upserted:
    """By external_key. ``friendly`` is never overwritten; a deleted group comes back."""
    rows = incoming.withColumns({"title": nullable_string(F.col("title"), 200), "external_key": nullable_string(F.col("external_key"), 100), "implied": to_flag(F.col("implied"))}).drop("friendly")
    return _upserted(existing, rows, "taxon_groups", ["external_key"], order)


def upsert_recording_schemes(existing: DataFrame, incoming: DataFrame, order: str = "order") -> Upserted:
    """By external_key, which has 16 characters at most."""
    rows = incoming.withColumns({"external_key": nullable_string(F.col("external_key"), 16), "title": nullable_string(F.col("title"), 100), "description": F.coalesce(nullable_string(F.col("description"), 255), F.lit(""))})
    return _upserted(existing, rows, "recording_schemes", ["external_key"], order)


def upsert_taxon_ranks(existing: DataFrame, incoming: DataFrame, reporting: tuple[str, ...] = RANKS, order: str = "order") -> Upserted:
    """By rank. ``is_reporting`` says whether the rank is configured, whatever its case; abbreviations are made unique."""
    good, bad = split_rejects(incoming, REJECTS["taxon_ranks"]())
    rest = [c for c in good.columns if c != "rank"]
    # The last row of a rank counts, at the place of its first.
    last = good.withColumn("rank", F.trim("rank")).groupBy("rank").agg(F.max_by(F.struct(*rest), order).alias("_r"), F.min(order).alias("_first")).select("rank", "_r.*", "_first")
    named = unique_abbr(last, existing, "_first").withColumns({"rank": F.substring("rank", 1, ABBR), "is_reporting": F.lower("rank").isin([r.strip().lower() for r in reporting]).cast("int"), "sort_order": F.greatest(F.lit(0), F.coalesce("sort_order", F.lit(0)))})
    kept = [c for c in named.columns if c in existing.columns and c != "deleted_at"]
    return merge(existing, named.select(*kept), ["rank"]), bad


def upsert_regions(existing: DataFrame, incoming: DataFrame, sources: DataFrame, order: str = "order") -> Upserted:
    """By higher_geography_identifier. The data source is looked up by its abbreviation, IREC where none is given."""
    by = sources.select(F.upper(F.trim("abbr")).alias("_abbr"), F.col("id").alias("data_source_id"))
    rows = incoming.withColumn("_abbr", F.upper(F.coalesce(nullable_string(F.col("data_source_abbr")), F.lit("IREC")))).join(by, "_abbr", "left").drop("_abbr")
    rows = rows.withColumns({"higher_geography": nullable_string(F.col("higher_geography"), 100), "location_type": nullable_string(F.col("location_type"), 100), "footprint_geometry": nullable_string(F.col("footprint_geometry"))})
    return _upserted(existing, rows, "geographic_regions", ["higher_geography_identifier"], order)


def upsert_grid_squares(existing: DataFrame, incoming: DataFrame, regions: DataFrame, order: str = "order") -> Upserted:
    """By square and region. Counters are never touched, and 0 in new rows."""
    rows = _lookup(incoming, regions, {"higher_geography_identifier": "higher_geography_identifier"}, {"geographic_region_id": "id"})
    square = F.upper(F.trim("square"))
    rows = rows.withColumns({
        "uuid": stable_uuid(F.concat_ws("|", F.trim("higher_geography_identifier"), square)), "square": nullable_string(square, 12), "easting": nullable_int(F.col("centre_easting")), "northing": nullable_int(F.col("centre_northing")),
        "lat": nullable_float(F.col("centre_lat")), "lon": nullable_float(F.col("centre_lon")), "partial": to_flag(F.col("partial")),
    })
    counters = {c: F.lit(0) for c in ("occurrences_count", "species_count", "rarity_score") if c in existing.columns}
    return _upserted(existing, rows, "grid_square_stats", ["square", "geographic_region_id"], order, insert_only=counters)


def upsert_taxon_names(existing: DataFrame, incoming: DataFrame, taxa: DataFrame, order: str = "order") -> Upserted:
    """By taxon and given name."""
    rows = _lookup(incoming, taxa, {"taxon_identifier": "taxon_identifier"}, {"taxon_id": "id"})
    rows = rows.withColumns({
        "uuid": stable_uuid(F.concat_ws("|", F.trim("taxon_identifier"), F.trim("given_name_identifier"))), "name": nullable_string(F.col("name"), 200), "given_name_identifier": nullable_string(F.col("given_name_identifier"), 100),
        "accepted": to_flag(F.col("accepted")), "scientific": to_flag(F.col("scientific")),
    })
    return _upserted(existing, rows, "taxon_names", ["taxon_id", "given_name_identifier"], order)


def _unresolved(rows: DataFrame, refs: DataFrame, stored: DataFrame) -> DataFrame:
    """Keys of rows that refer to a taxon which is neither stored nor among the rows that resolve; one pass for each level of such references."""
    keys = rows.select("taxon_identifier")
    bad, n = keys.limit(0), 0
    while True:
        usable = stored.select("taxon_identifier").unionByName(keys.join(bad, "taxon_identifier", "left_anti")).distinct()
        bad = settled(refs.join(usable.withColumnRenamed("taxon_identifier", "ref"), "ref", "left_anti").select("taxon_identifier").distinct())
        if (got := bad.count()) == n:
            return bad
        n = got


def upsert_taxa(
    existing: DataFrame, incoming: DataFrame, groups: DataFrame, schemes: DataFrame, ranks: DataFrame, rank_names: tuple[str, ...] = RANKS, mappings: dict[str, str] | None = None, order: str = "order", keep_moderation: bool = False
) -> Upserted:
    """By taxon_identifier, with parents and rank columns resolved among stored taxa and the batch itself.

    New taxa are grouped for rarity by their scheme's title, else ``Unassigned``; later batches leave
    that alone. A taxon that comes again is no longer blocked, unless ``keep_moderation``. A row with an
    unknown parent or higher taxon is rejected, as are those below it.
    """
    mappings = {"Species aggregate": "Species"} if mappings is None else mappings
    rows = _lookup(incoming, groups, {"taxon_group_external_key": "external_key"}, {"taxon_group_id": "id"})
    rows = _lookup(rows, schemes, {"recording_scheme_external_key": "external_key"}, {"recording_scheme_id": "id", "_scheme": "title"})
    rows = _lookup(rows.withColumn("_rank", F.lower(F.trim("taxon_rank"))), ranks.withColumn("_lower", F.lower("rank")), {"_rank": "_lower"}, {"taxon_rank_id": "id"})
    good, bad = split_rejects(rows, REJECTS["taxa"]())
    last = settled(dedupe_last(good.withColumn("taxon_identifier", F.trim("taxon_identifier")), ["taxon_identifier"], order))

    names = [r.lower() for r in rank_names]
    higher = F.expr("transform(coalesce(higher_taxa, array()), h -> struct(trim(h.organism_key) as organism_key, lower(trim(h.taxon_rank)) as rank))")
    wanted = F.transform(F.filter(higher, lambda h: h["rank"].isin(names) & (h["rank"] != F.coalesce("_rank", F.lit("")))), lambda h: h["organism_key"])
    parent = nullable_string(F.col("parent_taxon_identifier"))
    refs = settled(last.select("taxon_identifier", F.explode(F.array_distinct(F.concat(wanted, F.filter(F.array(parent), lambda p: p.isNotNull())))).alias("ref")))
    unknown = _unresolved(last, refs, _live(existing))
    bad = bad.unionByName(last.join(unknown, "taxon_identifier", "left_semi").withColumn("reason", F.lit("error: unknown parent or higher taxon")), allowMissingColumns=True)
    last = last.join(unknown, "taxon_identifier", "left_anti")

    # Ids first: the rank columns refer to rows of the same batch.
    stored = existing.select("taxon_identifier", "id")
    top = largest_id(existing)
    fresh = last.join(stored, "taxon_identifier", "left_anti").select("taxon_identifier", F.lit(None).cast(existing.schema["id"].dataType).alias("id"))
    ids = settled(stored.unionByName(numbered(fresh, ["taxon_identifier"], top)))
    placed = project_ranks(last, ids, rank_names, mappings).join(ids, "taxon_identifier").join(ids.select(F.col("taxon_identifier").alias("_parent"), F.col("id").alias("parent_taxon_id")), parent == F.col("_parent"), "left")
    placed = placed.withColumns({
        "taxon_identifier": F.substring("taxon_identifier", 1, 100), "scientific_name_identifier": nullable_string(F.col("scientific_name_identifier"), 100), "scientific_name": nullable_string(F.col("scientific_name"), 200),
        "scientific_name_authorship": nullable_string(F.col("scientific_name_authorship"), 100), "vernacular_name": F.coalesce(nullable_string(F.col("vernacular_name"), 200), F.lit("")), "conservation_status": nullable_string(F.col("conservation_status"), 10),
        "rarity_group_name": F.coalesce(nullable_string(F.col("_scheme"), 100), F.lit("Unassigned")),
    })
    kept = [c for c in placed.columns if c in existing.columns and c not in ("deleted_at", "blocked", "blocked_reason")]
    resets = {"deleted_at": F.lit(None).cast("timestamp")} | ({} if keep_moderation else {"blocked": F.lit(0), "blocked_reason": F.lit(None).cast("string")})
    insert_only = {"blocked": F.lit(0), "rarity_group_name": F.col("i.rarity_group_name")}
    resets = {k: v for k, v in resets.items() if k in existing.columns}
    return merge(existing, placed.select(*kept), ["taxon_identifier"], insert_only={k: v for k, v in insert_only.items() if k in existing.columns}, resets=resets), bad


def keyed_occurrences(incoming: DataFrame, taxa: DataFrame, names: DataFrame, abbr: str) -> DataFrame:
    """Records with their taxon, name, grid references and unique_key. A copy of an iRecord record gets its IREC key."""
    rows = resolve_taxon_name(resolve_taxon(incoming, taxa), names)
    rows = assign_grid_refs(rows, uncertainty="coordinate_uncertainty_in_meters").withColumn("_regenerate", needs_regeneration(F.col("grid_ref_system")))
    irecord = is_irecord_origin(F.col("occurrence_id"), F.col("data_provider_name"), F.col("source_name")) if abbr.upper() == "NBN" else F.lit(False)
    return rows.withColumns({"unique_key": unique_key(F.lit(abbr), F.col("remote_id"), irecord, F.col("occurrence_id")), "_irecord": irecord})


def merge_occurrences(existing: DataFrame, keyed: DataFrame, data_source_id: int, irec_source_id: int = 2, order: str = "tracking", top: int | None = None) -> Upserted:
    """Merge ``keyed_occurrences``, which are read several times, by unique_key. A copy of an iRecord record is rejected if iRecord owns the stored row."""
    # Keys, so that no record comes twice. Copies alone are looked for among them.
    owned = existing.where(F.col("data_source_id") == irec_source_id).select("unique_key").distinct().withColumn("_of_irec", F.lit(True))
    copies = keyed.where("_irecord").join(owned, "unique_key", "left").withColumn("_owned", F.coalesce("_of_irec", F.lit(False))).drop("_of_irec")
    rows = keyed.where("not _irecord").withColumn("_owned", F.lit(False)).unionByName(copies)
    good, bad = split_rejects(rows, REJECTS["occurrences"](), settle=False)
    short = {"locality": 255, "identified_by": 255, "sex": 20, "life_stage": 20, "organism_quantity": 20}
    good = good.withColumns({
        "from_date": nullable_date(F.col("from_date")), "to_date": nullable_date(F.col("to_date")), "grid_ref": F.substring("grid_ref", 1, 20), "grid_ref_2km": F.upper(F.substring(F.coalesce("grid_ref_2km", F.lit("")), 1, 5)),
        "recorded_by": F.coalesce(nullable_string(F.col("recorded_by"), 255), F.lit("Unknown")), "identification_verification_status": F.coalesce(F.substring("identification_verification_status", 1, 2), F.lit("UN")),
        "data_source_id": F.lit(data_source_id).cast("long"), "latitude": nullable_float(F.col("latitude")), "longitude": nullable_float(F.col("longitude")),
        **{c: nullable_string(F.col(c), n) for c, n in short.items() if c in good.columns},
    })
    wanted = [c for c in existing.columns if c in good.columns and c not in ("id", "blocked", "deleted_at")]
    last = dedupe_last(good.select(*wanted, F.col(order).alias("_order")), ["unique_key"], "_order").drop("_order")
    return merge(existing, last, ["unique_key"], insert_only={"blocked": F.lit(0)}, top=top, blanks=False), bad


def upsert_occurrences(existing: DataFrame, incoming: DataFrame, taxa: DataFrame, names: DataFrame, abbr: str, data_source_id: int, irec_source_id: int = 2, order: str = "tracking") -> Upserted:
    """By unique_key."""
    return merge_occurrences(existing, as_files(keyed_occurrences(incoming, taxa, names, abbr)), data_source_id, irec_source_id, order)


def unique_abbr(ranks: DataFrame, stored: DataFrame, order: str = "rank") -> DataFrame:
    """Give each rank of ``ranks(rank, abbr)`` an abbreviation that no other rank has: its own, else the slug of its name, else that with _2, _3 and so on.

    Ranks choose in their order. A stored abbreviation is its rank's until that rank, if it is among
    ``ranks``, has its turn. Nobody's choice depends on a later one's, so all propose at once: of
    those who may have a name the first keeps it, the others propose their next one, until none has to.
    """
    own = F.substring(F.trim(F.coalesce("abbr", F.lit(""))), 1, ABBR)
    slug = F.regexp_replace(F.lower("rank"), "[^a-z0-9]+", "_")
    turn = F.struct(F.col(order).alias("at"), F.col("rank").alias("rank"))
    asking = settled(ranks.select("rank", own.alias("own"), slug.alias("slug"), turn.alias("turn"), F.lit(0).alias("n")))
    held = stored.select(F.col("abbr").alias("name"), F.col("rank").alias("holder"))
    held = settled(held.join(asking.select(F.col("rank").alias("holder"), F.col("turn").alias("freed")), "holder", "left"))
    suffix = F.concat(F.lit("_"), F.col("n").cast("string"))
    numbered_slug = F.concat(F.expr(f"substring(slug, 1, {ABBR} - length(concat('_', n)))"), suffix)
    name = F.when((F.col("n") == 0) & (F.col("own") != ""), F.col("own")).when(F.col("n") <= 1, F.substring("slug", 1, ABBR)).otherwise(numbered_slug)
    while True:
        wanted = asking.withColumn("name", name)
        barred = wanted.join(held, "name").where((F.col("holder") != F.col("rank")) & (F.col("freed").isNull() | (F.col("turn") < F.col("freed")))).select("rank").distinct().withColumn("barred", F.lit(True))
        wanted = wanted.join(barred, "rank", "left")
        first = wanted.where("barred is null").groupBy("name").agg(F.min("turn").alias("first"))
        settled_now = settled(wanted.join(first, "name", "left").withColumn("lost", F.coalesce("barred", F.lit(False)) | (F.col("turn") != F.col("first"))))
        if not settled_now.where("lost").limit(1).count():
            return ranks.drop("abbr").join(settled_now.select("rank", F.col("name").alias("abbr")), "rank").select(*ranks.columns)
        asking = settled_now.select("rank", "own", "slug", "turn", (F.col("n") + F.col("lost").cast("int")).alias("n"))


def project_ranks(taxa: DataFrame, ids: DataFrame, ranks: tuple = RANKS, mappings: dict[str, str] | None = None) -> DataFrame:
    """Rank columns of ``taxa(taxon_identifier, taxon_rank, higher_taxa)``: ids of its higher taxa, its own id at its own rank.

    ``ids(taxon_identifier, id)`` has the batch's and the stored taxa. ``mappings`` names ranks that
    stand for another rank unless the taxon has that rank above it. Of several higher taxa at one
    rank the last one counts.
    """
    higher = taxa.select("taxon_identifier", F.posexplode("higher_taxa").alias("_at", "h")).select("taxon_identifier", "_at", F.trim("h.organism_key").alias("key"), F.lower(F.trim("h.taxon_rank")).alias("rank"))
    found = higher.join(ids.select(F.col("taxon_identifier").alias("key"), F.col("id").alias("higher_id")), "key")
    # Names of their own: a rank may be called like another column.
    wide = found.groupBy("taxon_identifier").pivot("rank", [r.lower() for r in ranks]).agg(F.max_by("higher_id", "_at")).toDF("taxon_identifier", *[f"_higher{i}" for i in range(len(ranks))])
    out = taxa.join(wide, "taxon_identifier", "left").join(ids.select("taxon_identifier", F.col("id").alias("_id")), "taxon_identifier", "left")
    own = F.lower(F.trim("taxon_rank"))
    for i, r in enumerate(ranks):
        mapped = [k.lower() for k, v in (mappings or {}).items() if v.lower() == r.lower()]
        value = F.when(own == r.lower(), F.col("_id")).otherwise(F.col(f"_higher{i}"))
        if mapped:
            value = F.coalesce(value, F.when(own.isin(mapped), F.col("_id")))
        out = out.withColumn(rank_column(r), value)
    return out.drop("_id", *[f"_higher{i}" for i in range(len(ranks))])


def moderate(df: DataFrame, decisions: DataFrame, key: str = "id", needs_reason: bool = True) -> tuple[DataFrame, DataFrame]:
    """Set or clear ``blocked`` by ``decisions(key, blocked, reason)``; (rows, decisions without the reason they need).

    Of several decisions on a key one that blocks counts, of those the last reason in alphabetical order.
    """
    given = decisions.withColumnRenamed("reason", "given_reason")
    good, bad = split_rejects(given, [("a reason is needed", (F.col("blocked") == 1) & blank("given_reason"))] if needs_reason else [])
    d = good.groupBy(key).agg(F.max(F.struct(F.col("blocked").alias("_b"), F.col("given_reason").alias("_r"))).alias("_d")).select(key, "_d.*")
    out = df.join(d, key, "left").withColumns({"blocked_reason": F.when(F.col("_b") == 1, F.col("_r")).when(F.col("_b") == 0, F.lit(None)).otherwise(F.col("blocked_reason")), "blocked": F.coalesce("_b", "blocked")})
    return out.select(*df.columns), bad


def replace_by_key(existing: DataFrame, fresh: DataFrame, ids: DataFrame | None, key: str) -> DataFrame:
    """``existing`` without the rows of ``ids`` (None: all rows), and ``fresh``; an empty ``ids`` removes nothing."""
    return fresh if ids is None else existing.join(ids, key, "left_anti").select(*existing.columns).unionByName(fresh)
