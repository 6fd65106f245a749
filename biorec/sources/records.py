"""Landed JSON to normalised records: readers, source predicates, normalisers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from biorec.functions.columns import first_numeric, list_values, nullable_int, to_flag
from biorec.operators.geo import tetrad_from_ref

_S = "string"
_GEOGRAPHY = T.ArrayType(T.StructType([T.StructField(f, T.StringType()) for f in ("id", "name", "type")]))
_TYPES = {"string": T.StringType(), "bigint": T.LongType(), "int": T.IntegerType(), "boolean": T.BooleanType()}


def _struct(**fields: str) -> T.StructType:
    return T.StructType([T.StructField(k, _TYPES[v]) for k, v in fields.items()])


INDICIA = T.StructType([
    T.StructField("id", T.StringType()), T.StructField("_id", T.StringType()),
    T.StructField("taxon", _struct(accepted_taxon_id=_S, taxon_id=_S, group_id="bigint", taxon_rank_sort_order="int")),
    T.StructField("location", T.StructType([*_struct(output_sref=_S, output_sref_system=_S, coordinate_uncertainty_in_meters=_S, point=_S, verbatim_locality=_S).fields, T.StructField("higher_geography", _GEOGRAPHY)])),
    T.StructField("event", _struct(date_start=_S, date_end=_S, recorded_by=_S)),
    T.StructField("identification", _struct(identified_by=_S, verification_status=_S)),
    T.StructField("occurrence", _struct(sex=_S, life_stage=_S, organism_quantity=_S, individual_count=_S, source_system_key=_S)),
    T.StructField("metadata", _struct(confidential="boolean", private="boolean", trial="boolean", release_status=_S, sensitivity_blur=_S, tracking="bigint")),
])


def pages(spark: SparkSession, path: str) -> DataFrame:
    """Landed payloads, one file each: (value, file)."""
    return spark.read.option("wholetext", True).text(path).select("value", F.col("_metadata.file_path").alias("file"))


def page_rows(landed: DataFrame, keys: tuple[str, ...] = ("occurrences", "records", "data"), nested: tuple[str, str] | None = None) -> DataFrame:
    """The records of ``landed(value, file)`` and what is none: file, at, json, reason.

    Records are the list under the first of these keys that has one, else a nested list, else the
    payload if it is a list itself. They are JSON texts, ``at`` their place in the list from 0, and their
    reason is null. Rejected: payloads that are no JSON, or hold no such list (``at`` is null), and
    entries that are no objects.
    """
    array = lambda c: F.when(F.ltrim(c).startswith("["), F.from_json(c, "array<string>"))
    payload = F.when(F.ltrim("value").startswith("{"), F.from_json("value", "map<string,string>"))
    lists = [array(F.element_at("payload", k)) for k in keys]
    if nested:
        inner = F.from_json(F.element_at("payload", nested[0]), "map<string,string>")
        lists.append(array(F.element_at(inner, nested[1])))
    file = F.col("file") if "file" in landed.columns else F.lit(None).cast("string")
    read = landed.select("value", file.alias("file"), payload.alias("payload")).select("*", F.coalesce(*lists, array(F.col("value"))).alias("found"))
    rows = read.select("file", "value", F.when(F.col("found").isNull(), F.when(F.col("payload").isNull(), "unparsable payload").otherwise("no list of records")).alias("why"), F.posexplode_outer("found").alias("at", "json"))
    rows = rows.where("why is not null or at is not null")
    reason = F.coalesce("why", F.when(~F.coalesce(F.ltrim("json").startswith("{"), F.lit(False)), "record is no object"))
    return rows.select("file", "at", F.when(F.col("why").isNull(), F.col("json")).otherwise(F.col("value")).alias("json"), reason.alias("reason"))


def page_records(landed: DataFrame, keys: tuple[str, ...] = ("occurrences", "records", "data"), nested: tuple[str, str] | None = None) -> DataFrame:
    """The records of ``landed(value)`` as JSON texts."""
    return page_rows(landed, keys, nested).where("reason is null").select("json")


def page_rejects(landed: DataFrame, keys: tuple[str, ...] = ("occurrences", "records", "data"), nested: tuple[str, str] | None = None) -> DataFrame:
    """What ``page_records`` leaves out: file, at, json, reason."""
    return page_rows(landed, keys, nested).where("reason is not null")


def read_nbn(spark: SparkSession, path: str) -> DataFrame:
    """One row for each record of the pages under ``path``: ``record``, a map of all its fields as texts, and ``user_assertions``."""
    return nbn_records(pages(spark, path))


def nbn_records(landed: DataFrame) -> DataFrame:
    # A map, as field names may differ in case alone.
    rows = page_records(landed).select(F.from_json("json", "map<string,string>").alias("record"))
    return rows.withColumn("user_assertions", F.from_json(F.element_at("record", "userAssertions"), "array<int>"))


def read_indicia(spark: SparkSession, path: str) -> DataFrame:
    """As ``read_nbn``, also ``hits.hits``; documents in ``_source`` are unwrapped and carry ``_id``."""
    return indicia_records(pages(spark, path))


def indicia_records(landed: DataFrame) -> DataFrame:
    hit = T.StructType([T.StructField("_source", INDICIA), *INDICIA.fields])
    rows = page_records(landed, nested=("hits", "hits")).select(F.from_json("json", hit).alias("r"))
    wrapped = F.col("r._source").isNotNull()
    names = [f.name for f in INDICIA.fields]
    return rows.select(*[(F.coalesce("r._id", "r._source._id") if n == "_id" else F.when(wrapped, F.col(f"r._source.{n}")).otherwise(F.col(f"r.{n}"))).alias(n) for n in names])


def read_report(spark: SparkSession, path: str, record: T.StructType) -> DataFrame:
    """Rows of a ``{"data": [...]}`` payload with records of this schema."""
    return page_records(pages(spark, path), ("data",)).select(F.from_json("json", record).alias("r")).select("r.*")


# ---------------------------------------------------------------- predicates


def publishable(df: DataFrame) -> DataFrame:
    m = lambda f: F.col(f"metadata.{f}")
    return df.where(~m("confidential") & ~m("private") & ~m("trial") & (m("release_status") == "R") & (m("sensitivity_blur").isNull() | (m("sensitivity_blur") == "B")))


def in_taxon_groups(df: DataFrame, groups: DataFrame, titles: str | list, column: str = "taxon.group_id") -> DataFrame:
    ids = groups.where(F.col("title").isin(list_values(titles)) & (F.coalesce("implied", F.lit(0)) == 0)).select(F.col("indicia_taxon_group_id").alias("_g"))
    return df.join(ids, F.col(column) == F.col("_g"), "left_semi")


def min_rank(df: DataFrame, n: int, column: str = "taxon.taxon_rank_sort_order") -> DataFrame:
    return df.where(F.col(column).cast("int") >= n)


def in_regions(df: DataFrame, names: str | list, location_type: str | None = None, column: str = "location.higher_geography") -> DataFrame:
    """Name and type in the same element of a nested list; with no type, a plain field in the list."""
    values = list_values(names)
    if location_type is None:
        return df.where(F.col(column).isin(values))
    return df.where(F.exists(column, lambda g: g["name"].isin(values) & (g["type"] == location_type)))


def max_uncertainty(df: DataFrame, most: float, column: str) -> DataFrame:
    return df if not most else df.where(F.col(column).try_cast("double") <= most)


def since_checkpoint(df: DataFrame, checkpoint, column: str, inclusive: bool = False) -> DataFrame:
    if checkpoint in (None, ""):
        return df
    value = F.lit(int(checkpoint)) if str(checkpoint).isdigit() and not inclusive else F.lit(str(checkpoint))
    return df.where(F.col(column) >= value if inclusive else F.col(column) > value)


def no_open_assertions(df: DataFrame, column: str = "user_assertions", codes: tuple = (50005, 50006, 50001)) -> DataFrame:
    return df.where(~F.coalesce(F.arrays_overlap(F.col(column), F.array(*map(F.lit, codes))), F.lit(False)))


def extra_clauses(df: DataFrame, clauses: list[str]) -> DataFrame:
    return reduce(lambda d, c: d.where(c), dict.fromkeys(clauses), df)


# ---------------------------------------------------------------- normalisers


def text(*columns: Column | str) -> Column:
    """The first of these that is not null, trimmed; a blank one is null."""
    given = [F.col(c) if isinstance(c, str) else c for c in columns]
    return F.nullif(F.trim(F.coalesce(*[c.cast("string") for c in given])), F.lit(""))


def normalize_nbn(df: DataFrame) -> DataFrame:
    """``df(record)`` to the fields of an occurrence record; blank texts are null."""
    of = lambda *names: text(*[F.element_at("record", n) for n in names])
    concept = F.coalesce(of("taxonConceptID", "taxonConceptId"), of("scientificNameID"))
    ref = of("grid_ref", "gridReference")
    uncertainty = first_numeric(*[F.element_at("record", n) for n in ("coordinate_uncertainty_in_meters", "coordinateUncertaintyInMeters", "uncertaintyInMeters", "coordinateUncertainty")])
    return df.select(
        of("uuid").alias("remote_id"), of("occurrenceID").alias("occurrence_id"), F.coalesce(of("dataResourceName", "source_name"), F.lit("NBN Atlas")).alias("source_name"),
        of("dataProviderName", "data_provider_name").alias("data_provider_name"), concept.alias("scientific_name_identifier"), concept.alias("given_name_identifier"),
        of("from_date", "eventDate").alias("from_date"), of("to_date").alias("to_date"), ref.alias("grid_ref"),
        of("grid_ref_system", "gridReferenceSystem", "spatialReferenceSystem", "coordinateSystem").alias("grid_ref_system"),
        F.coalesce(of("grid_ref_2km", "gridReference2Km"), F.upper(F.substring(F.replace(ref, F.lit(" "), F.lit("")), 1, 5))).alias("grid_ref_2km"),
        *[of(n).alias(n) for n in ("locality", "sex", "life_stage", "organism_quantity")], of("recorded_by", "recordedBy").alias("recorded_by"), of("identified_by", "identifiedBy").alias("identified_by"),
        F.coalesce(of("identification_verification_status", "identificationVerificationStatus"), F.lit("UN")).alias("identification_verification_status"),
        of("decimalLatitude").alias("latitude"), of("decimalLongitude").alias("longitude"), uncertainty.alias("coordinate_uncertainty_in_meters"),
        F.concat(F.lit("occurrenceID:"), of("occurrenceID")).alias("tracking"),
    )


def normalize_indicia(df: DataFrame) -> DataFrame:
    point = F.split(F.col("location.point"), ",")
    ref = text("location.output_sref")
    return df.select(
        text("_id").alias("remote_id"), text("id", "_id").alias("occurrence_id"), F.lit("iRecord").alias("source_name"), F.lit(None).cast("string").alias("data_provider_name"),
        text("taxon.accepted_taxon_id").alias("scientific_name_identifier"), text("taxon.taxon_id").alias("given_name_identifier"),
        text("event.date_start").alias("from_date"), text("event.date_end").alias("to_date"), ref.alias("grid_ref"), text("location.output_sref_system").alias("grid_ref_system"), tetrad_from_ref(ref).alias("grid_ref_2km"),
        text("location.verbatim_locality").alias("locality"), text("occurrence.sex").alias("sex"), text("occurrence.life_stage").alias("life_stage"), text("occurrence.organism_quantity", "occurrence.individual_count").alias("organism_quantity"),
        text("event.recorded_by").alias("recorded_by"), text("identification.identified_by").alias("identified_by"), text("identification.verification_status").alias("identification_verification_status"),
        text(F.get(point, F.lit(0))).alias("latitude"), text(F.get(point, F.lit(1))).alias("longitude"), F.col("location.coordinate_uncertainty_in_meters").try_cast("double").alias("coordinate_uncertainty_in_meters"),
        F.col("metadata.tracking").alias("tracking"),
    )


# The names under which reports give each field, the first choice first.
ALIASES = {
    "taxon_groups": {"external_key": ("taxon_group_external_key", "external_key"), "indicia_taxon_group_id": ("id",), "title": ("taxon_group", "title"), "implied": ("implied",)},
    "recording_schemes": {"external_key": ("recording_scheme_external_key", "external_key"), "title": ("recording_scheme", "title"), "description": ("recording_scheme_description", "description")},
    "taxon_ranks": {"rank": ("rank", "name", "title"), "abbr": ("abbr", "external_key", "slug"), "sort_order": ("sort_order", "sort", "weight")},
    "taxa": {n: (n,) for n in ("taxon_identifier", "scientific_name_identifier", "scientific_name", "scientific_name_authorship", "vernacular_name", "taxon_group", "taxon_group_external_key", "id_difficulty", "recording_scheme", "recording_scheme_external_key", "conservation_status", "taxon_rank", "parent_taxon_identifier", "higher_taxa")},
    "taxon_names": {
        "taxon_identifier": ("taxon_identifier", "organism_key"), "given_name_identifier": ("given_name_identifier", "scientific_name_identifier", "name_identifier"),
        "name": ("name", "taxon_name", "scientific_name", "vernacular_name"), "accepted": ("accepted", "is_accepted"), "scientific": ("scientific", "is_scientific"),
    },
    "geographic_regions": {"higher_geography_identifier": ("higher_geography_identifier", "id"), "higher_geography": ("higher_geography",), "location_type": ("location_type",), "footprint_geometry": ("footprint_geometry",)},
    "grid_square_stats": {n: (n,) for n in ("higher_geography_identifier", "square", "centre_easting", "centre_northing", "centre_lat", "centre_lon", "partial")},
}
_FLAGS = {"taxon_groups": ("implied",), "taxon_names": ("accepted", "scientific"), "grid_square_stats": ("partial",)}
_WHOLE = {"taxon_groups": ("indicia_taxon_group_id",), "taxon_ranks": ("sort_order",), "taxa": ("id_difficulty",)}


def normalize(df: DataFrame, entity: str, location_type: str | None = None, source_abbr: str = "IREC") -> DataFrame:
    """Report rows to the fields of an entity: the first name of a field that the row has, trimmed; blanks are null.

    Flags become 0 or 1, numbers 0 where missing. Columns of other names pass through (an order of arrival, say).
    """
    fields = ALIASES[entity]
    used = {n for names in fields.values() for n in names}
    columns = []
    for name, names in fields.items():
        own = [n for n in names if n in df.columns]
        columns.append((text(*own) if own else F.lit(None).cast("string")).alias(name))
    out = df.select(*columns, *[c for c in df.columns if c not in used])
    out = out.withColumns({c: to_flag(F.col(c)) for c in _FLAGS.get(entity, ())} | {c: F.coalesce(nullable_int(F.col(c)), F.lit(0).cast("long")) for c in _WHOLE.get(entity, ())})
    if entity == "taxa":
        return out.withColumn("higher_taxa", F.from_json(F.coalesce("higher_taxa", F.lit("[]")), "array<struct<organism_key:string,taxon:string,taxon_rank:string>>"))
    if entity == "geographic_regions":
        return out.withColumns({"location_type": F.coalesce("location_type", F.lit(location_type).cast("string")), "data_source_abbr": F.lit(source_abbr.upper())})
    if entity == "grid_square_stats":
        return out.withColumn("square", F.upper("square"))
    return out
