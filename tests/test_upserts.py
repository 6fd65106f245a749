"""Entity upserts, and ingest that stops half way."""

import json

import pytest
from pyspark.sql import functions as F

from biorec.functions import tables
from biorec.operators import geo, merge
from biorec.sources import records
from biorec.streaming import ingest

TAXA = "id long, taxon_identifier string, scientific_name_identifier string, scientific_name string, taxon_rank_id long, parent_taxon_id long, order_id long, superfamily_id long, family_id long, genus_id long, species_id long, taxon_group_id long, id_difficulty int, recording_scheme_id long, rarity_group_name string, blocked int, blocked_reason string, deleted_at timestamp"
GROUPS = "id long, title string, friendly string, external_key string, indicia_taxon_group_id long, implied int, deleted_at timestamp"
SCHEMES = "id long, external_key string, title string, description string, deleted_at timestamp"
RANKS = "id long, rank string, abbr string, sort_order int, is_reporting int, deleted_at timestamp"
REGIONS = "id long, higher_geography_identifier string, higher_geography string, location_type string, footprint_geometry string, data_source_id long, deleted_at timestamp"
SQUARES = "id long, uuid string, square string, geographic_region_id long, easting int, northing int, lon double, lat double, partial int, occurrences_count int, species_count int, rarity_score double"
NAMES = "id long, uuid string, taxon_id long, name string, given_name_identifier string, accepted int, scientific int, deleted_at timestamp"


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=str)


def test_groups(spark):
    stored = spark.sql("select 5L as id, 'Old' as title, 'Mine' as friendly, 'K1' as external_key, 3L as indicia_taxon_group_id, 0 as implied, timestamp'2020-01-01' as deleted_at")
    new = spark.createDataFrame([(1, "K1", 3, "First", "0"), (2, "K1", 3, "New", "1"), (3, "K2", 4, "x" * 300, "0"), (4, " ", 4, "T", "0"), (5, "K3", 0, "T", "0")], "order int, external_key string, indicia_taxon_group_id long, title string, implied string")
    out, bad = merge.upsert_taxon_groups(stored, new)
    assert rows(out, "id", "external_key", "friendly", "implied", "action", F.length("title"), "deleted_at") == [(5, "K1", "Mine", 1, "updated", 3, None), (6, "K2", None, 0, "inserted", 200, None)]
    assert rows(bad, "order", "reason") == [(4, "blank key or title"), (5, "no source id")]


def test_schemes(spark):
    new = spark.createDataFrame([(1, "k" * 30, "t" * 130, "d" * 300), (2, "a", "", "")], "order int, external_key string, title string, description string")
    out, bad = merge.upsert_recording_schemes(spark.createDataFrame([], SCHEMES), new)
    assert rows(out, "id", F.length("external_key"), F.length("title"), F.length("description")) == [(1, 16, 100, 255)] and bad.count() == 1


def test_ranks(spark):
    stored = spark.createDataFrame([(1, "Subspecies", "subspecies", 40, 0, None)], RANKS)
    new = spark.createDataFrame([(1, "Subspecies hybrid", "subspecies", 45), (2, "genus", "", -3), (3, "", "x", 1), (4, "Subspecies", "subspecies", 41)], "order int, rank string, abbr string, sort_order long")
    out, bad = merge.upsert_taxon_ranks(stored, new)
    assert rows(out, "rank", "abbr", "sort_order", "is_reporting", "action") == [("Subspecies hybrid", "subspecies_hybrid", 45, 0, "inserted"), ("Subspecies", "subspecies", 41, 0, "updated"), ("genus", "genus", 0, 1, "inserted")] and bad.count() == 1


def test_regions(spark):
    sources = spark.createDataFrame([(1, "NBN"), (2, "IREC")], "id long, abbr string")
    new = spark.createDataFrame([(1, "10", "Dorset", "County", "POLYGON((0 0,1 0,1 1,0 0))", None), (2, "11", "Kent", "County", "", "nbn"), (3, "0", "Zero", "County", None, None), (4, "12", "", "County", None, None), (5, "13", "Mars", "County", None, "XX")], "order int, higher_geography_identifier string, higher_geography string, location_type string, footprint_geometry string, data_source_abbr string")
    out, bad = merge.upsert_regions(spark.createDataFrame([], REGIONS), new, sources)
    assert rows(out, "higher_geography_identifier", "data_source_id", F.col("footprint_geometry").isNull()) == [("10", 2, False), ("11", 1, True)]
    assert rows(bad, "order", "reason") == [(3, "no identifier"), (4, "blank name or type"), (5, "unknown data source")]


def test_squares(spark):
    regions = spark.createDataFrame([(7, "10", None), (8, "11", None)], "id long, higher_geography_identifier string, deleted_at timestamp")
    stored = spark.createDataFrame([(1, "u", "SU14L", 7, 0, 0, 0.0, 0.0, 0, 9, 8, 7.5)], SQUARES)
    new = spark.createDataFrame([(1, "10", " su14l ", "1", "2", "50.5", "-1", "1"), (2, "11", "SU14L", "1", "2", "50.5", "-1", "0"), (3, "11", "SU14M", None, "2", "50", "1", "0"), (4, "99", "SU14N", "1", "2", "50", "1", "0")], "order int, higher_geography_identifier string, square string, centre_easting string, centre_northing string, centre_lat string, centre_lon string, partial string")
    out, bad = merge.upsert_grid_squares(stored, new, regions)
    assert rows(out, "id", "square", "geographic_region_id", "easting", "lat", "partial", "occurrences_count", "rarity_score", "action") == [(1, "SU14L", 7, 1, 50.5, 1, 9, 7.5, "updated"), (2, "SU14L", 8, 1, 50.5, 0, 0, 0.0, "inserted")]
    assert rows(bad, "order", "reason") == [(3, "incomplete square"), (4, "unknown region")]


def given_taxa(spark):
    groups = spark.createDataFrame([(1, "Moths", None, "G", 1, 0, None)], GROUPS)
    schemes = spark.createDataFrame([(3, "scheme-a", "Scheme A", "", None)], SCHEMES)
    ranks = spark.createDataFrame([(1, "Family", "fam", 1, 1, None), (2, "Species", "spe", 2, 1, None), (4, "Species aggregate", "agg", 2, 0, None), (5, "Subspecies", "sub", 3, 0, None)], RANKS)
    return groups, schemes, ranks


def incoming_taxa(spark, given):
    fields = ("order", "taxon_identifier", "scientific_name", "taxon_rank", "parent_taxon_identifier", "higher_taxa", "taxon_group_external_key", "recording_scheme_external_key")
    df = spark.createDataFrame([tuple(g.get(f, "G" if f == "taxon_group_external_key" else None) for f in fields) for g in given], "order int, " + ", ".join(f"{f} string" for f in fields[1:]))
    return records.normalize(df.withColumn("scientific_name_identifier", F.concat(F.lit("S"), "taxon_identifier")), "taxa")


def test_taxa(spark):
    family = json.dumps([{"organism_key": "F", "taxon": "Fam", "taxon_rank": "Family"}])
    both = json.dumps([{"organism_key": "F", "taxon": "Fam", "taxon_rank": "family"}, {"organism_key": "SP", "taxon": "Sp", "taxon_rank": "Species"}])
    lost = json.dumps([{"organism_key": "NOWHERE", "taxon": "?", "taxon_rank": "Genus"}])
    stored = spark.createDataFrame([(7, "OLD", "x", "Old", 2, None, None, None, None, None, 7, 1, 0, None, "Kept", 1, "bad", None)], TAXA)
    new = incoming_taxa(spark, [
        dict(order=1, taxon_identifier="F", scientific_name="Fam", taxon_rank="Family"), dict(order=2, taxon_identifier="SP", scientific_name="Sp", taxon_rank="Species", parent_taxon_identifier="F", higher_taxa=family, recording_scheme_external_key="scheme-a"),
        dict(order=3, taxon_identifier="SUB", scientific_name="Sub", taxon_rank="Subspecies", parent_taxon_identifier="SP", higher_taxa=both), dict(order=4, taxon_identifier="AGG", scientific_name="Agg", taxon_rank="species Aggregate", parent_taxon_identifier="F", higher_taxa=family),
        dict(order=5, taxon_identifier="OLD", scientific_name="Old", taxon_rank="Species", recording_scheme_external_key="scheme-a"), dict(order=6, taxon_identifier="X", scientific_name="X", taxon_rank="Species", higher_taxa=lost),
        dict(order=7, taxon_identifier="Y", scientific_name="Y", taxon_rank="Subspecies", parent_taxon_identifier="X"), dict(order=8, taxon_identifier="Z", scientific_name="Z", taxon_rank="Subspecies", parent_taxon_identifier="Y"),
        dict(order=9, taxon_identifier="N", scientific_name="N", taxon_group_external_key="other"), dict(order=10, taxon_identifier="M", scientific_name=" "),
    ])
    out, bad = merge.upsert_taxa(stored, new, *given_taxa(spark))
    by = {r["taxon_identifier"]: r for r in out.collect()}
    ids = {k: r["id"] for k, r in by.items()}
    assert sorted(ids.values()) == [7, 8, 9, 10, 11]
    family_species = lambda k: (by[k]["family_id"], by[k]["species_id"], by[k]["parent_taxon_id"])
    assert family_species("SUB") == (ids["F"], ids["SP"], ids["SP"]) and family_species("AGG") == (ids["F"], ids["AGG"], ids["F"]) and family_species("SP") == (ids["F"], ids["SP"], ids["F"]) and family_species("F") == (ids["F"], None, None)
    assert (by["SP"]["rarity_group_name"], by["F"]["rarity_group_name"], by["OLD"]["rarity_group_name"]) == ("Scheme A", "Unassigned", "Kept")
    assert (by["OLD"]["blocked"], by["OLD"]["blocked_reason"], by["OLD"]["recording_scheme_id"], by["OLD"]["species_id"], by["OLD"]["action"]) == (0, None, 3, 7, "updated")
    error = "error: unknown parent or higher taxon"
    assert rows(bad, "taxon_identifier", "reason") == [("M", "blank id or name"), ("N", "unknown group"), ("X", error), ("Y", error), ("Z", error)]
    again, _ = merge.upsert_taxa(out.drop("action"), new, *given_taxa(spark))
    assert {r["action"] for r in again.collect()} == {"unchanged"} and rows(again, "taxon_identifier", "id") == rows(out, "taxon_identifier", "id")


def test_names(spark):
    taxa = spark.createDataFrame([(4, "T", None)], "id long, taxon_identifier string, deleted_at timestamp")
    new = spark.createDataFrame([(1, "T", "N", "Moth", "1", "no"), (2, "U", "N", "Moth", "1", "0"), (3, "T", "", "Moth", "1", "0")], "order int, taxon_identifier string, given_name_identifier string, name string, accepted string, scientific string")
    out, bad = merge.upsert_taxon_names(spark.createDataFrame([], NAMES), new, taxa)
    assert rows(out, "taxon_id", "name", "accepted", "scientific", F.length("uuid")) == [(4, "Moth", 1, 0, 36)]
    assert rows(bad, "order", "reason") == [(2, "unknown taxon"), (3, "blank id or name")]


OCC = "id long, unique_key string, taxon_id long, taxon_name_id long, order_id long, superfamily_id long, family_id long, genus_id long, species_id long, from_date date, to_date date, grid_ref string, grid_ref_2km string, locality string, recorded_by string, identified_by string, identification_verification_status string, sex string, life_stage string, organism_quantity string, data_source_id long, latitude double, longitude double, blocked int, deleted_at timestamp"


def world(spark):
    taxa = spark.createDataFrame([(4, "C1", 10, 11, 12, 13, 14)], "id long, scientific_name_identifier string, order_id long, superfamily_id long, family_id long, genus_id long, species_id long")
    names = spark.createDataFrame([(9, 4, "C1")], "id long, taxon_id long, given_name_identifier string")
    regions = spark.createDataFrame([(1, "10", "A", "County", "POLYGON((-3 53,-2 53,-2 54,-3 54,-3 53))", 2, None)], REGIONS)
    return {"occurrences": spark.createDataFrame([], OCC), "taxa": taxa, "taxon_names": names, "geographic_regions": regions}


def nbn(i, **more):
    return {"uuid": f"u{i}", "occurrenceID": f"o{i}", "taxonConceptID": "C1", "gridReference": "SU123456", "decimalLatitude": "53.5", "decimalLongitude": "-2.5", "recordedBy": f"R{i}"} | more


REASONS = [
    (nbn(1, uuid=""), "missing ids"), (nbn(1, taxonConceptID="C2"), "unknown taxon or name"), (nbn(1, gridReferenceSystem="WGS84", decimalLatitude=None), "no position for a reference"), (nbn(1, gridReference=" "), "blank reference"),
    (nbn(1, occurrenceID="77", dataProviderName="Biological Records Centre", dataResourceName="iRecord moths"), "owned by iRecord"),
]


@pytest.mark.parametrize("record, reason", REASONS)
def test_reasons(spark, record, reason):
    t = world(spark)
    stored = [(5, "IREC:77", 4, 9, *[None] * 5, None, None, "SU123456", "SU14L", None, "Kept", None, "V", None, None, None, 2, None, None, 0, None)]
    batch = records.normalize_nbn(records.nbn_records(spark.createDataFrame([(json.dumps([record]),)], "value string")))
    out, bad = merge.upsert_occurrences(spark.createDataFrame(stored, OCC), batch, t["taxa"], t["taxon_names"], "NBN", 1)
    assert [r["reason"] for r in bad.collect()] == [reason] and rows(out, "unique_key", "recorded_by", "action") == [("IREC:77", "Kept", "kept")]


def payload(spark, *found):
    return records.normalize_nbn(records.nbn_records(spark.createDataFrame([(json.dumps(list(found)),)], "value string")))


def test_replay(spark, tmp_path, monkeypatch):
    """A batch whose region step fails publishes nothing; run again it gives records and links, as a third run does."""
    root, t = str(tmp_path / "db"), world(spark)
    batch = payload(spark, nbn(1), nbn(2, decimalLatitude="60"), nbn(2, recordedBy="Later", occurrenceID="o3"))
    whole = geo.reassign_regions

    def broken(*args):
        raise RuntimeError("no regions today")

    monkeypatch.setattr(ingest.geo, "reassign_regions", broken)
    with pytest.raises(RuntimeError):
        ingest.ingest_batch(root, batch, t, "NBN", 1)
    assert ingest.stored(spark, root, "occurrences") is None
    monkeypatch.setattr(ingest.geo, "reassign_regions", whole)
    for want in ([("inserted", 2)], [("unchanged", 2)]):
        counts, bad = ingest.ingest_batch(root, batch, t, "NBN", 1)
        assert rows(counts, "action", "n") == want and bad.count() == 0
        assert rows(ingest.stored(spark, root, "occurrences"), "id", "unique_key", "recorded_by", "species_id") == [(1, "NBN:u1", "R1", 14), (2, "NBN:u2", "Later", 14)]
        assert rows(ingest.stored(spark, root, "geographic_regions_occurrences"), "geographic_region_id", "occurrence_id") == [(1, 1), (1, 2)]


@pytest.mark.parametrize("step", ["geographic_regions_occurrences", "occurrences", "ledger"])
def test_staged_batch_takes_effect(spark, tmp_path, monkeypatch, step):
    """A batch that fails while its buckets are replaced is finished by the next call, with the ids that it gave out."""
    root, t = str(tmp_path / "db"), world(spark)
    ingest.ingest_batch(root, payload(spark, nbn(1), nbn(5)), t, "NBN", 1, buckets=4)
    second = payload(spark, nbn(0), nbn(1, recordedBy="Again", decimalLatitude="10"), nbn(3), nbn(9, uuid=""))
    with monkeypatch.context() as m:
        for name, at in (("write_buckets", 1), ("write_version", 1)):
            plain = getattr(ingest, name)
            m.setattr(ingest, name, lambda df, path, *more, plain=plain: 1 / 0 if path == f"{root}/{step}" and ("applied" not in df.columns or df.first()["applied"]) else plain(df, path, *more))
        with pytest.raises(ZeroDivisionError):
            ingest.ingest_batch(root, second, t, "NBN", 1, name="b7")
    counts, bad = ingest.ingest_batch(root, second, t, "NBN", 1, name="b7")
    assert rows(counts, "action", "n") == [("inserted", 2), ("updated", 1)] and rows(bad, "reason") == [("missing ids",)]
    assert rows(ingest.stored(spark, root, "occurrences"), "id", "unique_key", "recorded_by") == [(1, "NBN:u1", "Again"), (2, "NBN:u5", "R5"), (3, "NBN:u0", "R0"), (4, "NBN:u3", "R3")]
    run = ingest.runs(spark, root).collect()[-1]
    assert (run["number"], run["name"], *[run[c] for c in ("fetched", "processed", "inserted", "updated", "unchanged", "skipped", "errors")]) == (1, "b7", 4, 4, 2, 1, 0, 1, 0)
    # The record that moved has lost its region, and with it perhaps the last link of a bucket.
    assert rows(ingest.stored(spark, root, "geographic_regions_occurrences"), "geographic_region_id", "occurrence_id") == [(1, 2), (1, 3), (1, 4)]


def test_a_batch_writes_its_own_buckets_only(spark, tmp_path):
    root, t = str(tmp_path / "db"), world(spark)
    ingest.ingest_batch(root, payload(spark, *map(nbn, range(60))), t, "NBN", 1, buckets=16)
    files = lambda table: {str(p): p.parent.name for p in (tmp_path / "db" / table).glob("_bucket=*/*.parquet")}
    before = {table: files(table) for table in ingest.KEYS}
    assert all(len(set(f.values())) > 8 for f in before.values())
    ingest.ingest_batch(root, payload(spark, nbn(3, recordedBy="New"), nbn(100)), t, "NBN", 1)
    for table in ingest.KEYS:
        now = files(table)
        fresh, gone = ({d for f, d in a.items() if f not in b} for a, b in ((now, before[table]), (before[table], now)))
        assert fresh == gone and 1 <= len(fresh) <= 2
    assert ingest.stored(spark, root, "occurrences").count() == 61 and ingest.stored(spark, root, "geographic_regions_occurrences").count() == 61
    plan = tables.read_buckets(spark, f"{root}/occurrences", "unique_key", [3, 4])._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(_bucket" in plan or "PartitionFilters: [_bucket" in plan


def test_stream(spark, tmp_path):
    landing, root, point = (str(tmp_path / n) for n in ("landing", "db", "checkpoint"))
    (tmp_path / "landing").mkdir()
    normal = lambda df: records.normalize_nbn(records.nbn_records(df))
    for n in (1, 2):
        (tmp_path / "landing" / f"p{n}.json").write_text(json.dumps({"occurrences": [nbn(n), nbn(10 + n, uuid="")]}))
        ingest.ingest_stream(spark, landing, normal, root, world(spark), "NBN", 1, point)
    assert rows(ingest.stored(spark, root, "occurrences"), "unique_key") == [("NBN:u1",), ("NBN:u2",)]
    assert [r["reason"] for r in spark.read.parquet(f"{root}/rejects").collect()] == ["missing ids"] * 2


def test_checkpoints(spark):
    one = spark.createDataFrame([(9,), (10,)], "tracking long")
    first = ingest.checkpoints(one, "irec")
    assert rows(first, "source_key", "checkpoint") == [("irec", "10")]
    assert rows(ingest.checkpoints(one.limit(0), "irec", first), "checkpoint") == [("10",)]
    assert rows(ingest.checkpoints(spark.createDataFrame([(9,), (100,)], "tracking long"), "irec", first), "checkpoint") == [("100",)]
    text = spark.createDataFrame([("occurrenceID:b",), ("occurrenceID:a",)], "tracking string")
    assert rows(ingest.checkpoints(text, "nbn", first), "source_key", "checkpoint") == [("irec", "10"), ("nbn", "occurrenceID:b")]


def test_entities(spark, tmp_path):
    root = str(tmp_path / "db")
    sources = spark.createDataFrame([(1, "NBN"), (2, "IREC")], "id long, abbr string")
    schema = {"taxon_groups": GROUPS, "recording_schemes": SCHEMES, "taxon_ranks": RANKS, "geographic_regions": REGIONS, "grid_square_stats": SQUARES, "taxa": TAXA, "taxon_names": NAMES}
    empty = {n: spark.createDataFrame([], s) for n, s in schema.items()} | {"data_sources": sources}
    report = lambda **r: spark.createDataFrame([(1, *r.values())], "order int, " + ", ".join(f"{k} string" for k in r))
    given = {
        "taxon_names": report(organism_key="T", name_identifier="N", taxon_name="Moth"), "taxa": report(taxon_identifier="T", scientific_name_identifier="S", scientific_name="Sp", taxon_rank="Species", taxon_group_external_key="G"),
        "taxon_groups": report(id="4", taxon_group="Moths", external_key="G"), "taxon_ranks": report(rank="Species", sort_order="3"), "recording_schemes": report(external_key="K", title="S"),
        "geographic_regions": report(id="10", higher_geography="Dorset"), "grid_square_stats": report(higher_geography_identifier="10", square="SU14L", centre_easting="1", centre_northing="2", centre_lat="50", centre_lon="1"),
    }
    with pytest.raises(ValueError):
        ingest.ingest_entities(root, {"taxa": given["taxa"]}, empty)
    counts, bad = ingest.ingest_entities(root, given, empty, "County")
    assert rows(counts, "entity", "action", "n") == sorted((e, "inserted", 1) for e in given) and not any(b.count() for b in bad.values())
    assert rows(tables.read_version(spark, f"{root}/taxa"), "species_id", "taxon_rank_id", "taxon_group_id") == [(1, 1, 1)]
    assert rows(tables.read_version(spark, f"{root}/taxon_names"), "taxon_id", "name") == [(1, "Moth")]
    assert ingest.ordered({"taxon_names", "taxa", "taxon_groups"}) == ["taxon_groups", "taxa", "taxon_names"]


def test_moderate(spark):
    df = spark.createDataFrame([(1, 0, None), (2, 1, "old"), (3, 0, None)], "id long, blocked int, blocked_reason string")
    decisions = spark.createDataFrame([(1, 1, "spam"), (2, 0, None), (3, 1, " ")], "id long, blocked int, reason string")
    out, bad = merge.moderate(df, decisions)
    assert rows(out, "id", "blocked", "blocked_reason") == [(1, 1, "spam"), (2, 0, None), (3, 0, None)] and rows(bad, "id") == [(3,)]
