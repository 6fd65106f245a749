"""The query surface: filter, sort, page and expand the domain tables.

``query`` builds a DataFrame; arguments are checked before any job runs. Joins are made only for
the includes that are asked for.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from biorec.functions.columns import RANKS, is_active, rank_column
from biorec.functions.tables import settled
from biorec.operators.stats import count_by

OPERATORS = ("eq", "in", "contains", "gte", "lte")
DEFAULT_LIMIT, MOST_LIMIT = 1000, 10_000
Tables = dict[str, DataFrame]


@dataclass(frozen=True)
class Resource:
    table: str
    key: str
    sort: str
    active: str = "none"  # none, deleted (rows not deleted), active (nor blocked)
    taxon: str | None = None  # foreign key to active taxa, or "self"
    region: bool = False
    reporting: bool = False
    includes: tuple[str, ...] = field(default=())


RESOURCES = {
    "occurrences": Resource("occurrences", "unique_key", "from_date", "active", "taxon_id", includes=("data-source", "geographic-region", "grid-square-stats", "taxon", "taxon-name", "taxon-media", "taxon-rank", "taxon-group", "parent-taxon", "parent-taxa")),
    "taxa": Resource("taxa", "taxon_identifier", "scientific_name", "active", "self", reporting=True, includes=("taxon-rank", "taxon-group", "recording-scheme", "parent-taxon", "parent-taxa", "taxon-media")),
    "taxon_names": Resource("taxon_names", "uuid", "name", "none", "taxon_id", reporting=True),
    "taxon_stats": Resource("taxon_stats", "uuid", "uuid", "none", "taxon_id", True, True),
    "taxon_year_stats": Resource("taxon_year_stats", "uuid", "year", "none", "taxon_id", True, True),
    "grid_square_stats": Resource("grid_square_stats", "uuid", "square", region=True),
    "geographic_regions": Resource("geographic_regions", "higher_geography_identifier", "higher_geography", "deleted", includes=("data-source",)),
    "taxon_ranks": Resource("taxon_ranks", "abbr", "sort_order", "deleted", reporting=True),
    "taxon_groups": Resource("taxon_groups", "external_key", "title", "deleted"),
    "data_sources": Resource("data_sources", "abbr", "abbr"),
    "recording_schemes": Resource("recording_schemes", "external_key", "title", "deleted"),
}


def prefixed(df: DataFrame, prefix: str) -> DataFrame:
    return df.select(*[F.col(c).alias(f"{prefix}__{c}") for c in df.columns])


def left(df: DataFrame, other: DataFrame, prefix: str, fk: str, key: str = "id") -> DataFrame:
    return df.join(prefixed(other, prefix), F.col(fk) == F.col(f"{prefix}__{key}"), "left")


def left_large(df: DataFrame, other: DataFrame, prefix: str, fk: str) -> DataFrame:
    """``left`` with a table that grows with the input.

    Its compressed files may look small enough for a broadcast, which would take its rows whole through the driver; they meet in a merge join.
    """
    return left(df, other.hint("merge"), prefix, fk)


def condition(c: Column, operator: str, value: str) -> Column:
    if operator == "eq":
        return c.isNull() if value == "null" else c == value
    if operator == "in":
        values = [x.strip() for x in value.split(",") if x.strip()]
        return c.isin(values or [""])
    if operator == "contains":
        return F.lower(c.cast("string")).like(f"%{str(value).lower()}%")
    if operator == "gte":
        return c >= value
    if operator == "lte":
        return c <= value
    raise ValueError(f"unknown operator {operator}")


def _base(t: Tables, r: Resource, reporting: bool) -> DataFrame:
    df = t[r.table]
    if r.active == "active":
        df = df.where(is_active())
    elif r.active == "deleted" and "deleted_at" in df.columns:
        df = df.where("deleted_at is null")
    if r.taxon == "self":
        if reporting:
            df = df.join(t["taxon_ranks"].where("is_reporting = 1").select(F.col("id").alias("taxon_rank_id")), "taxon_rank_id", "left_semi").select(*df.columns)
    elif r.taxon:
        taxa = t["taxa"].where(is_active())
        if r.reporting and reporting:
            taxa = taxa.join(t["taxon_ranks"].where("is_reporting = 1").select(F.col("id").alias("taxon_rank_id")), "taxon_rank_id", "left_semi")
        ids = taxa.select(F.col("id").alias(r.taxon))
        # Statistics and names are of as many taxa as there are: a merge join, as in ``left_large``.
        df = df.join(ids.hint("merge") if r.reporting else ids, r.taxon, "left_semi").select(*df.columns)
    elif r.reporting and reporting:
        df = df.where("is_reporting = 1")
    if r.region:
        regions = t["geographic_regions"].where("deleted_at is null").select(F.col("id").alias("_region"), "higher_geography_identifier")
        df = df.join(regions, F.col("geographic_region_id") == F.col("_region"), "left").drop("_region")
    return df


def region_filter(df: DataFrame, t: Tables, operator: str, value: str) -> DataFrame:
    """Occurrences in a region that fits: a semi-join, so rows never multiply."""
    regions = t["geographic_regions"].where("deleted_at is null").where(condition(F.col("higher_geography_identifier"), operator, value))
    links = t["geographic_regions_occurrences"].join(regions.select(F.col("id").alias("geographic_region_id")), "geographic_region_id", "left_semi")
    return df.join(links.select(F.col("occurrence_id").alias("id")), "id", "left_semi").select(*df.columns)


def include_regions(df: DataFrame, t: Tables) -> DataFrame:
    """An array of (identifier, name, type) by identifier; empty if there is none."""
    named = t["geographic_regions"].where("deleted_at is null").select(F.col("id").alias("geographic_region_id"), F.struct(F.col("higher_geography_identifier").alias("identifier"), F.col("higher_geography").alias("name"), F.col("location_type").alias("type")).alias("r"))
    links = t["geographic_regions_occurrences"].join(df.select(F.col("id").alias("occurrence_id")), "occurrence_id", "left_semi")
    lists = links.join(named, "geographic_region_id").groupBy(F.col("occurrence_id").alias("id")).agg(F.array_sort(F.collect_set("r")).alias("geographic_regions"))
    return df.join(lists, "id", "left").withColumn("geographic_regions", F.coalesce("geographic_regions", F.array().cast(lists.schema["geographic_regions"].dataType)))


def include_media(df: DataFrame, t: Tables, fk: str) -> DataFrame:
    """Media of the taxon: primary first, then sort_order and id, each with its variants by key."""
    variants = t["taxon_media_variants"].groupBy("taxon_media_id").agg(F.map_from_entries(F.collect_list(F.struct("variant_key", F.struct("mime_type", "bytes", "width", "height")))).alias("variants"))
    media = t["taxon_media"].where("deleted_at is null").join(variants, F.col("id") == F.col("taxon_media_id"), "left")
    entry = F.struct((-F.col("is_primary")).alias("o1"), F.col("sort_order").alias("o2"), F.col("id").alias("o3"), F.struct("uuid", "original_filename", "mime_type", "bytes", "width", "height", "alt_text", "caption", "attribution", "license", "sort_order", "is_primary", "variants").alias("m"))
    # Maps have no order: sort on the leading fields only.
    lists = media.groupBy(F.col("taxon_id").alias("_taxon")).agg(F.collect_list(entry).alias("ms"))
    by = lambda a, b: F.when(a["o1"] < b["o1"], -1).when(a["o1"] > b["o1"], 1).when(a["o2"] < b["o2"], -1).when(a["o2"] > b["o2"], 1).when(a["o3"] < b["o3"], -1).otherwise(1)
    lists = lists.select("_taxon", F.transform(F.array_sort("ms", by), lambda x: x["m"]).alias("taxon_media"))
    return df.join(lists, F.col(fk) == F.col("_taxon"), "left").drop("_taxon")


def rank_taxa(df: DataFrame, taxa: DataFrame, columns: tuple[str, ...], ranks: tuple = RANKS) -> DataFrame:
    """``df`` with ``_at_<rank column>`` for each rank: these columns of the taxon that its rank column names; deleted and blocked ones included.

    The distinct combinations of rank ids, no more than there are taxa, are exploded and meet the taxa in one join, a merge join as in ``left_large``.
    Where several taxa have the id, a row comes for each, as in a left join.
    """
    ids = [rank_column(r) for r in ranks]
    key = F.concat_ws("|", *[F.coalesce(F.col(i).cast("string"), F.lit("")) for i in ids])
    entries = F.explode(F.array(*[F.struct(F.lit(r).alias("rank"), F.col(i).cast("long").alias("id")) for r, i in zip(ranks, ids)]))
    found = df.select(*ids).distinct().select(key.alias("_key"), entries.alias("e")).where("e.id is not null")
    found = found.join(taxa.select(F.col("id").alias("_id"), F.struct(*columns).alias("_taxon")).hint("merge"), F.col("e.id") == F.col("_id"))
    lists = found.groupBy("_key").agg(F.collect_list(F.struct("e.rank", "_taxon")).alias("_ranks"))
    out = df.withColumn("_key", key).join(lists.hint("merge"), "_key", "left").drop("_key")
    at = lambda r: F.transform(F.filter("_ranks", lambda x: x["rank"] == r), lambda x: x["_taxon"])
    for r, i in zip(ranks, ids):
        out = out.select("*", F.explode_outer(at(r)).alias(f"_at_{i}"))
    return out.drop("_ranks")


def include_parents(df: DataFrame, t: Tables, ranks: tuple = RANKS) -> DataFrame:
    """The taxon of each configured rank, by one join with the taxa."""
    slim = ("id", "taxon_identifier", "scientific_name")
    out = rank_taxa(df, t["taxa"], slim, ranks)
    return out.select(*df.columns, *[F.col(f"_at_{rank_column(r)}")[c].alias(f"{rank_column(r).removesuffix('_id')}__{c}") for r in ranks for c in slim])


def include(df: DataFrame, t: Tables, resource: str, names: tuple[str, ...]) -> DataFrame:
    occ = resource == "occurrences"
    needs_taxon = occ and {"taxon", "taxon-rank", "taxon-group", "parent-taxon"} & set(names)
    if needs_taxon:
        df = left_large(df, t["taxa"].where(is_active()), "taxon", "taxon_id")
    own = "taxon__" if occ else ""
    if "data-source" in names:
        df = left(df, t["data_sources"], "data_source", "data_source_id")
    if "taxon-name" in names:
        df = left_large(df, t["taxon_names"], "taxon_name", "taxon_name_id")
    if "taxon-rank" in names:
        df = left(df, t["taxon_ranks"], "taxon_rank", own + "taxon_rank_id")
    if "taxon-group" in names:
        df = left(df, t["taxon_groups"], "taxon_group", own + "taxon_group_id")
    if "recording-scheme" in names:
        df = left(df, t["recording_schemes"], "recording_scheme", "recording_scheme_id")
    if "parent-taxon" in names:
        df = left_large(df, t["taxa"].where(is_active()), "parent", own + "parent_taxon_id")
        df = left(df, t["taxon_ranks"], "parent_rank", "parent__taxon_rank_id")
    if "parent-taxa" in names:
        df = include_parents(df, t)
    if "grid-square-stats" in names:
        squares = t["grid_square_stats"].groupBy("square").agg(*[F.first(c, ignorenulls=True).alias(c) for c in ("easting", "northing", "lat", "lon")])
        df = df.join(prefixed(squares, "grid_square"), F.upper(F.trim("grid_ref_2km")) == F.col("grid_square__square"), "left")
    if "geographic-region" in names:
        df = include_regions(df, t)
    if "taxon-media" in names:
        df = include_media(df, t, "taxon_id" if occ else "id")
    return df


def _matching(t: Tables, resource: str, filters: list[tuple[str, str, str]], sort: str | None, includes: tuple[str, ...], reporting_only: bool) -> tuple[DataFrame, list[Column]]:
    """The rows that match, without includes, and their order. All arguments are checked here, before any job runs."""
    if resource not in RESOURCES:
        raise ValueError(f"unknown resource {resource}")
    r = RESOURCES[resource]
    if bad := set(includes) - set(r.includes):
        raise ValueError(f"unknown include {sorted(bad)}")
    if not isinstance(reporting_only, bool):
        raise ValueError("reporting_only must be true or false")
    df = _base(t, r, reporting_only)
    own = set(df.columns)
    for name, operator, value in filters:
        if operator not in OPERATORS:
            raise ValueError(f"unknown operator {operator}")
        if resource == "occurrences" and name == "higher_geography_identifier":
            df = region_filter(df, t, operator, value)
        elif name not in own:
            raise ValueError(f"unknown field {name}")
        else:
            df = df.where(condition(F.col(name), operator, value))
    order = []
    for s in (sort or r.sort).split(","):
        name = s.removeprefix("-")
        if name not in own:
            raise ValueError(f"unknown sort {name}")
        order.append(F.desc(name) if s.startswith("-") else F.asc(name))
    return df, [*order, F.asc(r.key)]


def query(t: Tables, resource: str, filters: list[tuple[str, str, str]] = (), sort: str | None = None, includes: tuple[str, ...] = (), reporting_only: bool = True) -> DataFrame:
    """All matching rows in order, the natural key breaking ties. A sort like ``a,-b`` is descending in b."""
    df, order = _matching(t, resource, filters, sort, includes, reporting_only)
    return include(df, t, resource, tuple(includes)).orderBy(*order)


def _checked(limit: int | None, offset: int) -> int:
    limit = DEFAULT_LIMIT if limit is None else limit
    if not 1 <= limit <= MOST_LIMIT or offset < 0:
        raise ValueError("limit is from 1 to 10000, offset from 0")
    return limit


#: A page that ends beyond this row is cut by parts.
MOST_RANKED = 20_000


def page_rows(df: DataFrame, order: list[Column], key: str, limit: int, offset: int, most_ranked: int = MOST_RANKED) -> DataFrame:
    """The rows of ``df`` from ``offset`` on in this order, ``limit`` of them; ``key`` is unique.

    A page near the start is what each task's first rows give. A deep one is found by keys alone: they
    are sorted in parts, the parts are counted, and only the keys of parts that the page touches are
    read again. No task ranks more rows than its part has.
    """
    if offset + limit <= most_ranked:
        return df.orderBy(*order).offset(offset).limit(limit)
    keys = settled(df.orderBy(*order).select(F.col(key).alias("_key"), F.spark_partition_id().alias("_part"), F.monotonically_increasing_id().alias("_at")))
    counts = keys.groupBy("_part").agg(F.min("_at").alias("first"), F.count(F.lit(1)).alias("n")).collect()  # one row for each part
    wanted, base = F.lit(False), 0
    for r in sorted(counts, key=lambda r: r["_part"]):
        low, high = max(offset, base), min(offset + limit, base + r["n"])
        if low < high:
            wanted = wanted | ((F.col("_part") == r["_part"]) & F.col("_at").between(r["first"] + low - base, r["first"] + high - base - 1))
        base += r["n"]
    found = keys.where(wanted).select("_key")  # at most ``limit`` keys
    return df.join(F.broadcast(found), F.col(key) == F.col("_key"), "left_semi")


def query_page(t: Tables, resource: str, limit: int | None = None, offset: int = 0, **how) -> tuple[DataFrame, DataFrame]:
    """One page of a query, and the number of all its rows as a table of one row (total).

    The page is cut before the includes are joined: no include is made for rows outside it.
    """
    limit = _checked(limit, offset)
    includes = tuple(how.get("includes", ()))
    df, order = _matching(t, resource, how.get("filters", ()), how.get("sort"), includes, how.get("reporting_only", True))
    chosen = page_rows(df, order, RESOURCES[resource].key, limit, offset)
    return include(chosen, t, resource, includes).orderBy(*order), df.agg(F.count(F.lit(1)).alias("total"))


def page(df: DataFrame, limit: int | None = None, offset: int = 0) -> tuple[DataFrame, int]:
    """One page of a DataFrame in order and the number of all its rows."""
    limit = _checked(limit, offset)
    return df.offset(offset).limit(limit), df.count()


def show(t: Tables, resource: str, key: str, includes: tuple[str, ...] = ()) -> DataFrame:
    """The row of a natural key, reporting or not."""
    r = RESOURCES[resource]
    return query(t, resource, [(r.key, "eq", key)], includes=includes, reporting_only=False)


def staff_list(df: DataFrame, q: str, columns: tuple[str, ...], sort: str | None, default: str, direction: str = "asc", number: int = 1, size: int = 20) -> DataFrame:
    """A page of rows that are not deleted and hold ``q`` in any of the columns; an unknown sort falls back to the default."""
    rows = df.where("deleted_at is null") if "deleted_at" in df.columns else df
    if q:
        rows = rows.where(reduce(lambda a, b: a | b, (F.lower(F.col(c)).contains(q.lower()) for c in columns)))
    by = sort if sort in df.columns else default
    return rows.orderBy(F.desc(by) if direction == "desc" else F.asc(by), *(["id"] if "id" in df.columns else [])).offset((number - 1) * size).limit(size)


def list_with_counts(base: DataFrame, rows: DataFrame, fk: str, name: str, q: str, columns: tuple[str, ...], sort: str | None, default: str, direction: str = "asc", number: int = 1, size: int = 20) -> DataFrame:
    """A page of a staff list with the number of ``rows`` that refer to each of its own rows; a sort by that number is possible."""
    if sort == name:
        return staff_list(count_by(base, rows, fk, name), q, columns, sort, default, direction, number, size)
    chosen = staff_list(base, q, columns, sort, default, direction, number, size)
    return count_by(chosen, rows.join(chosen.select(F.col("id").alias(fk)), fk, "left_semi"), fk, name)


def taxon_labels(taxa: DataFrame, t: Tables, ranks: tuple = RANKS) -> DataFrame:
    """The labels of a taxon's details: names for its keys, its hierarchy by rank, and its own names, accepted first."""
    out = left(taxa, t["taxon_ranks"].select("id", "rank"), "rank", "taxon_rank_id")
    out = left(out, t["taxon_groups"].select("id", "title"), "group", "taxon_group_id")
    out = left(out, t["recording_schemes"].select("id", "title"), "scheme", "recording_scheme_id")
    out = left_large(out, t["taxa"].select("id", "scientific_name"), "parent", "parent_taxon_id")
    out = rank_taxa(out, t["taxa"], ("scientific_name",), ranks)
    listed = F.array_sort(F.collect_list(F.struct((-F.col("accepted")).alias("later"), "name", "given_name_identifier", "scientific")))
    names = t["taxon_names"].where("deleted_at is null").join(taxa.select(F.col("id").alias("taxon_id")), "taxon_id", "left_semi").groupBy("taxon_id").agg(listed.alias("names"))
    names = names.select(F.col("taxon_id").alias("_taxon"), F.transform("names", lambda n: F.struct(n["name"].alias("name"), n["given_name_identifier"].alias("given_name_identifier"), (-n["later"]).alias("accepted"), n["scientific"].alias("scientific"))).alias("names"))
    hierarchy = F.array(*[F.struct(F.lit(r).alias("rank"), F.col(f"_at_{rank_column(r)}")["scientific_name"].alias("name")) for r in ranks])
    out = out.join(names, F.col("id") == F.col("_taxon"), "left")
    return out.select(
        *taxa.columns, F.col("rank__rank").alias("rank_label"), F.col("group__title").alias("group_label"), F.col("scheme__title").alias("scheme_label"), F.col("parent__scientific_name").alias("parent_label"),
        F.filter(hierarchy, lambda h: h["name"].isNotNull()).alias("hierarchy"), F.coalesce("names", F.array().cast(names.schema["names"].dataType)).alias("names"),
    )


def occurrence_list(df: DataFrame, taxon_id=None, data_source_id=None, blocked=None, date_from=None, date_to=None) -> DataFrame:
    tests = [(taxon_id, F.col("taxon_id") == F.lit(taxon_id)), (blocked, F.col("blocked") == F.lit(blocked)), (date_from, F.col("from_date") >= F.lit(date_from)), (date_to, F.col("from_date") <= F.lit(date_to))]
    if data_source_id is not None:
        tests.append((data_source_id, F.col("data_source_id") == F.lit(data_source_id)))
    for value, test in tests:
        if value is not None:
            df = df.where(test)
    return df.where("deleted_at is null")
