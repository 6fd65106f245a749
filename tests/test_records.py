import json

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from biorec.functions import columns as X
from biorec.sources import records


def frame(spark, *payloads):
    return spark.createDataFrame([(json.dumps(p),) for p in payloads], "value string")


@pytest.mark.parametrize("payload", [{"occurrences": None}, {"occurrences": {}}, {"total": 3}, {"data": []}, [], [None, 3, "x"], "text", 5])
def test_no_records(spark, payload):
    assert records.nbn_records(frame(spark, payload)).count() == 0 and records.indicia_records(frame(spark, payload)).count() == 0


def test_search_order(spark):
    pages = [{"records": [{"uuid": "r"}], "occurrences": [{"uuid": "o"}]}, {"data": [{"uuid": "d"}], "records": None}, [{"uuid": "l"}, None]]
    assert sorted(r["remote_id"] for r in records.normalize_nbn(records.nbn_records(frame(spark, *pages))).collect()) == ["d", "l", "o"]


NBN = [
    ({"uuid": " u1 ", "occurrenceID": "o1", "taxonConceptId": "C1", "gridReference": "su 12 34"}, {"remote_id": "u1", "scientific_name_identifier": "C1", "given_name_identifier": "C1", "grid_ref": "su 12 34", "grid_ref_2km": "SU123", "identification_verification_status": "UN", "source_name": "NBN Atlas", "tracking": "occurrenceID:o1"}),
    ({"taxonConceptID": " ", "scientificNameID": "S1", "gridReference": "SU123456", "gridReference2Km": "SU14L", "occurrenceID": "o2"}, {"remote_id": None, "scientific_name_identifier": "S1", "grid_ref_2km": "SU14L", "occurrence_id": "o2"}),
    ({"coordinate_uncertainty_in_meters": "", "coordinateUncertaintyInMeters": "x", "uncertaintyInMeters": "25", "coordinateUncertainty": "9", "spatialReferenceSystem": "EPSG:4326"}, {"coordinate_uncertainty_in_meters": 25.0, "grid_ref_system": "EPSG:4326"}),
    ({"source_name": "S", "dataResourceName": "D", "data_provider_name": "P", "recorded_by": "A", "recordedBy": "B", "eventDate": "2020-01-02", "to_date": "2020-01-03", "identificationVerificationStatus": "V1"}, {"source_name": "D", "data_provider_name": "P", "recorded_by": "A", "from_date": "2020-01-02", "to_date": "2020-01-03", "identification_verification_status": "V1"}),
]


@pytest.mark.parametrize("record, want", NBN)
def test_normalize_nbn(spark, record, want):
    row = records.normalize_nbn(records.nbn_records(frame(spark, [record]))).first()
    assert {k: row[k] for k in want} == want


def test_normalize_indicia(spark):
    docs = [{"_id": "a", "taxon": {"accepted_taxon_id": "T"}, "location": {"point": "1.5, -2", "output_sref": "SU12"}, "occurrence": {"individual_count": 3}}, {"_source": {"_id": "b", "id": 7, "taxon": {"taxon_id": "G"}, "metadata": {"tracking": 12}}}]
    a, b = sorted(records.normalize_indicia(records.indicia_records(frame(spark, {"hits": {"hits": docs}}))).collect(), key=lambda r: r["remote_id"])
    assert (a["remote_id"], a["given_name_identifier"], a["latitude"], a["longitude"], a["organism_quantity"], a["grid_ref_2km"], a["identification_verification_status"]) == ("a", None, "1.5", "-2", "3", None, None)
    assert (b["remote_id"], b["scientific_name_identifier"], b["given_name_identifier"], b["tracking"]) == ("b", None, "G", 12)


def test_read_report(spark, tmp_path):
    (tmp_path / "p.json").write_text(json.dumps({"data": [{"id": 4, "title": "Moths"}, {"id": "5", "title": None}]}))
    schema = T.StructType([T.StructField("id", T.StringType()), T.StructField("title", T.StringType())])
    assert sorted(map(tuple, records.read_report(spark, str(tmp_path), schema).collect())) == [("4", "Moths"), ("5", None)]


CASES = [
    ("taxon_groups", {"id": "12", "taxon_group": " Moths ", "title": "x", "taxon_group_external_key": "K", "external_key": "y", "implied": "yes"}, {"external_key": "K", "indicia_taxon_group_id": 12, "title": "Moths", "implied": 1}),
    ("taxon_groups", {"id": None, "title": "Moths", "external_key": "K"}, {"external_key": "K", "indicia_taxon_group_id": 0, "title": "Moths", "implied": 0}),
    ("recording_schemes", {"recording_scheme": "S", "recording_scheme_external_key": "K", "recording_scheme_description": " d "}, {"external_key": "K", "title": "S", "description": "d"}),
    ("taxon_ranks", {"name": "Genus", "slug": "gen", "weight": "7"}, {"rank": "Genus", "abbr": "gen", "sort_order": 7}),
    ("taxa", {"taxon_identifier": "T", "higher_taxa": '[{"organism_key":"F","taxon":"Fam","taxon_rank":"Family"}]'}, {"taxon_identifier": "T", "id_difficulty": 0, "scientific_name": None, "higher_taxa": [("F", "Fam", "Family")]}),
    ("taxa", {"taxon_identifier": "T", "id_difficulty": "3"}, {"id_difficulty": 3, "higher_taxa": []}),
    ("taxon_names", {"organism_key": "T", "name_identifier": "N", "vernacular_name": "Moth", "is_accepted": "1", "is_scientific": "t"}, {"taxon_identifier": "T", "given_name_identifier": "N", "name": "Moth", "accepted": 1, "scientific": 1}),
    ("geographic_regions", {"id": "9", "higher_geography": "Dorset"}, {"higher_geography_identifier": "9", "higher_geography": "Dorset", "location_type": "County", "data_source_abbr": "IREC"}),
    ("grid_square_stats", {"higher_geography_identifier": "9", "square": " su14l ", "centre_easting": "1", "centre_northing": "2", "centre_lat": "50", "centre_lon": "-1", "partial": "t"}, {"square": "SU14L", "centre_easting": "1", "centre_lat": "50", "partial": 1}),
]


@pytest.mark.parametrize("entity, row, want", CASES)
def test_normalize(spark, entity, row, want):
    df = spark.createDataFrame([tuple(row.values())], ", ".join(f"{k} string" for k in row))
    got = records.normalize(df, entity, "County").first()
    assert {k: [tuple(h) for h in got[k]] if k == "higher_taxa" else got[k] for k in want} == want


def test_predicates(spark):
    meta = "confidential boolean, private boolean, trial boolean, release_status string, sensitivity_blur string, tracking long"
    rows = [(1, (False, False, False, "R", None, 5)), (2, (False, False, False, "R", "B", 6)), (3, (True, False, False, "R", None, 7)), (4, (False, False, False, "U", None, 8)), (5, (False, False, False, "R", "F", 9))]
    df = spark.createDataFrame(rows, f"id long, metadata struct<{meta.replace(' ', ':').replace(',:', ',')}>")
    ids = lambda d: sorted(r["id"] for r in d.collect())
    assert ids(records.publishable(df)) == [1, 2]
    assert ids(records.since_checkpoint(df, "6", "metadata.tracking")) == [3, 4, 5] and ids(records.since_checkpoint(df, None, "metadata.tracking")) == [1, 2, 3, 4, 5]
    taxon = spark.createDataFrame([(1, (10, 300), "25"), (2, (11, 200), "75.5"), (3, (12, None), None)], "id long, taxon struct<group_id:long,taxon_rank_sort_order:int>, u string")
    groups = spark.createDataFrame([(10, "Moths", 0), (11, "Bees", 1), (12, "Flies", 0)], "indicia_taxon_group_id long, title string, implied int")
    assert ids(records.in_taxon_groups(taxon, groups, "Moths, 'Bees', Flies")) == [1, 3]
    assert ids(records.min_rank(taxon, 250)) == [1]
    assert ids(records.max_uncertainty(taxon, 50, "u")) == [1] and ids(records.max_uncertainty(taxon, 0, "u")) == [1, 2, 3]
    assert ids(records.extra_clauses(taxon, ["u is not null", "u is not null", "id > 1"])) == [2]
    geo = spark.createDataFrame([(1, [("a", "Dorset", "County")], [50005]), (2, [("a", "Dorset", "Town"), ("b", "Kent", "County")], [1]), (3, None, None)], "id long, hg array<struct<id:string,name:string,type:string>>, user_assertions array<int>")
    assert ids(records.in_regions(geo, "Dorset", "County", "hg")) == [1]
    assert ids(records.in_regions(taxon, ["25"], column="u")) == [1]
    assert ids(records.no_open_assertions(geo)) == [2, 3]
    nbn = spark.createDataFrame([(1, "b"), (2, "a"), (3, "c")], "id long, k string")
    assert ids(records.since_checkpoint(nbn, "b", "k", inclusive=True)) == [1, 3]


def test_helpers(spark):
    df = spark.createDataFrame([("  ab  ", "2020-01-02T10:00", "12.7"), ("", "2020", "x"), (None, None, None)], "s string, d string, n string")
    got = df.select(X.nullable_string(F.col("s"), 1), X.nullable_date(F.col("d")).cast("string"), X.nullable_float(F.col("n")), X.nullable_int(F.col("n"))).collect()
    assert [tuple(r) for r in got] == [("a", "2020-01-02", 12.7, 12), (None, None, None, None), (None, None, None, None)]
    flags = spark.createDataFrame([(v,) for v in ("1", "T", "Yes", "y", "true", "3", "0", "no", "-1", None)], "v string").select(X.to_flag(F.col("v")).alias("f")).collect()
    assert [r["f"] for r in flags] == [1] * 6 + [0] * 4
    assert X.rank_column("Sub Genus") == "sub_genus_id" and X.list_values("a, 'b',, a") == ["a", "b"]


def test_rejected_pages(spark, tmp_path):
    """Payloads and entries that are no records, each with its file and place."""
    texts = {"a": '{"occurrences": [{"uuid": "1"}, 5, "x", null, {"uuid": "2"}]}', "b": '{"occurrences": [{"uuid": "3"}', "c": "not json", "d": '{"other": [{"uuid": "4"}]}', "e": '[{"uuid": "5"}, []]', "f": '{"records": []}'}
    for name, text in texts.items():
        (tmp_path / f"{name}.json").write_text(text)
    landed = records.pages(spark, str(tmp_path))
    bad = sorted((r["file"][-6:-5], r["at"] if r["at"] is not None else -1, r["reason"]) for r in records.page_rejects(landed).collect())
    entry = "record is no object"
    assert bad == [("a", 1, entry), ("a", 2, entry), ("a", 3, entry), ("b", -1, "unparsable payload"), ("c", -1, "unparsable payload"), ("d", -1, "no list of records"), ("e", 1, entry)]
    assert sorted(r["record"]["uuid"] for r in records.nbn_records(landed).collect()) == ["1", "2", "5"]
