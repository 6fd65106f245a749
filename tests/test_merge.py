import json

import pytest
from pyspark.sql import functions as F

from biorec.functions import tables
from biorec.operators import merge, query
from biorec.sources import records

OCC = "id long, unique_key string, taxon_id long, taxon_name_id long, order_id long, superfamily_id long, family_id long, genus_id long, species_id long, from_date date, grid_ref string, grid_ref_2km string, recorded_by string, identification_verification_status string, data_source_id long, latitude double, longitude double, blocked int, deleted_at timestamp"


def landed(tmp_path, payload):
    (tmp_path / "a.json").write_text(json.dumps(payload))
    return str(tmp_path)


NBN = {"uuid": "nbn-uuid-1", "occurrenceID": "123", "taxonConceptID": "NHMSYS0001", "eventDate": "2024-05-01", "gridReference": "SU123456", "decimalLatitude": "53.4808", "decimalLongitude": "-2.2426", "gridReferenceSystem": "EPSG:4326", "dataProviderName": "Biological Records Centre", "dataResourceName": "iRecord Bats", "identificationVerificationStatus": "V", "coordinateUncertaintyInMeters": "1500"}


@pytest.mark.parametrize("wrap", [lambda r: {"occurrences": [r]}, lambda r: {"records": [r]}, lambda r: {"data": [r]}, lambda r: [r]])
def test_nbn(spark, tmp_path, wrap):
    row = records.normalize_nbn(records.read_nbn(spark, landed(tmp_path, wrap(NBN)))).first()
    assert (row["remote_id"], row["given_name_identifier"], row["grid_ref_2km"], row["coordinate_uncertainty_in_meters"], row["tracking"]) == ("nbn-uuid-1", "NHMSYS0001", "SU123", 1500.0, "occurrenceID:123")


def test_indicia(spark, tmp_path):
    doc = {"taxon": {"accepted_taxon_id": "TVK-1", "taxon_id": "GIVEN-1"}, "location": {"output_sref": "SU1234", "output_sref_system": "WGS84", "coordinate_uncertainty_in_meters": "1500", "point": "53.4808,-2.2426"}}
    row = records.normalize_indicia(records.read_indicia(spark, landed(tmp_path, {"hits": {"hits": [{"_id": "remote-1", "_source": doc}]}}))).first()
    assert (row["remote_id"], row["latitude"], row["longitude"], row["grid_ref_system"], row["grid_ref_2km"]) == ("remote-1", "53.4808", "-2.2426", "WGS84", "SU13L")


@pytest.mark.parametrize("owner, action", [(None, "inserted"), (1, "updated"), (2, None)])
def test_ownership(spark, tmp_path, owner, action):
    stored = [] if owner is None else [(7, "IREC:123", 1, 1, None, None, None, None, None, None, "SU1234", "SU13L", "Kept", "V", owner, None, None, 0, None)]
    taxa = spark.createDataFrame([(4, "NHMSYS0001", 10, 11, 12, 13, 14)], "id long, scientific_name_identifier string, order_id long, superfamily_id long, family_id long, genus_id long, species_id long")
    names = spark.createDataFrame([(9, 4, "NHMSYS0001")], "id long, taxon_id long, given_name_identifier string")
    incoming = records.normalize_nbn(records.read_nbn(spark, landed(tmp_path, {"occurrences": [NBN]})))
    out, bad = merge.upsert_occurrences(spark.createDataFrame(stored, OCC), incoming, taxa, names, "NBN", 1)
    rows = out.collect()
    if action is None:
        assert [r["recorded_by"] for r in rows] == ["Kept"] and [r["reason"] for r in bad.collect()] == ["owned by iRecord"]
    else:
        assert [(r["unique_key"], r["action"], r["species_id"], r["recorded_by"], r["grid_ref"] == r["grid_ref_2km"]) for r in rows] == [("IREC:123", action, 14, "Unknown", True)]


def serial_abbr(ranks, stored):
    """Ranks (rank, abbr) choose one after another among names that no other rank has."""
    import re

    used, out = {a: r for r, a in stored}, {}
    for rank, abbr in ranks:
        used = {a: r for a, r in used.items() if r != rank}
        slug = re.sub("[^a-z0-9]+", "_", rank.lower())
        name, n = (abbr or "").strip()[:50] or slug[:50], 2
        if name in used:
            name = slug[:50]
        while name in used:
            name, n = slug[: 50 - len(f"_{n}")] + f"_{n}", n + 1
        used[name] = out[rank] = name
        used[name] = rank
    return out


LONG = "a very long name of a rank that goes on and on beyond fifty"


@pytest.mark.parametrize(
    "ranks, stored",
    [
        ([("Subspecies hybrid", "subspecies")], [("Subspecies", "subspecies")]),
        ([("Alpha", "x"), ("Beta", "x"), ("Gamma", "ord")], [("Tribe", "gamma"), ("Order", "ord")]),
        ([("Alpha", "two"), ("Beta", "one")], [("Alpha", "one"), ("Beta", "two")]),
        ([("Beta", "one"), ("Alpha", "two"), ("Gamma", "two")], [("Alpha", "one"), ("Other", "gamma")]),
        ([(LONG + c, "") for c in "abcdefghijkl"], [("Other", LONG.replace(" ", "_")[:50])]),
        ([("A (x)", None), ("a-x-", " "), ("a x", "a_x_")], []),
    ],
)
def test_abbr(spark, ranks, stored):
    given = spark.createDataFrame([(i, *r) for i, r in enumerate(ranks)], "at int, rank string, abbr string")
    got = merge.unique_abbr(given, spark.createDataFrame(stored, "rank string, abbr string"), "at")
    assert got.columns == given.columns and {r["rank"]: r["abbr"] for r in got.collect()} == serial_abbr(ranks, stored)


def test_abbr_of_many(spark):
    import random

    rng = random.Random(5)
    names = [f"{rng.choice('abc')} {rng.choice('abc')}{rng.choice(('', '!', '?', ' 2', ' 3'))}" for _ in range(80)]
    names = list(dict.fromkeys(names))
    stored = [(r, f"{rng.choice('abc')}_{rng.choice('abc')}{rng.choice(('', '_2', '_'))}") for r in [*rng.sample(names, 12), "p", "q"]]
    stored = list({a: (r, a) for r, a in stored}.values())
    ranks = [(r, rng.choice(("", "a", "b_c", "a_a_2", None))) for r in names]
    got = merge.unique_abbr(spark.createDataFrame([(i, *r) for i, r in enumerate(ranks)], "at int, rank string, abbr string"), spark.createDataFrame(stored, "rank string, abbr string"), "at")
    assert {r["rank"]: r["abbr"] for r in got.collect()} == serial_abbr(ranks, stored)


def test_versions(spark, tmp_path):
    root = str(tmp_path / "t")
    for n in range(4):
        before = tables.read_version(spark, root)
        tables.write_version((before if before is not None else spark.range(0)).unionByName(spark.range(n, n + 1)), root)
    assert tables.read_version(spark, root).count() == 4 and len([p for p in (tmp_path / "t").iterdir() if p.name.startswith("v-")]) == 2
    # A version that was not written to the end does not count, and is written again.
    (tmp_path / "t" / "v-000000005").mkdir()
    assert tables.read_version(spark, root).count() == 4
    tables.write_version(spark.range(2), root)
    assert tables.read_version(spark, root).count() == 2


def test_numbered(spark):
    new = spark.range(1000).selectExpr("cast(null as long) as id", "cast(id * 7 % 1000 as string) as k")
    rows = merge.numbered(new, ["k"], 50).collect()
    assert [r["k"] for r in sorted(rows, key=lambda r: r["id"])] == sorted(str(i) for i in range(1000)) and {r["id"] for r in rows} == set(range(51, 1051))


def test_query_rejects(spark):
    t = {"data_sources": spark.createDataFrame([(1, "NBN", "NBN Atlas")], "id long, abbr string, title string")}
    for bad in (dict(filters=[("nope", "eq", "1")]), dict(filters=[("abbr", "like", "1")]), dict(sort="nope"), dict(includes=("taxon",)), dict(reporting_only="x")):
        with pytest.raises(ValueError):
            query.query(t, "data_sources", **bad)
    with pytest.raises(ValueError):
        query.page(t["data_sources"], 10_001)
    assert query.page(query.query(t, "data_sources", [("abbr", "in", "NBN, IREC")]), 1)[1] == 1


@pytest.mark.parametrize("limit, offset", [(7, 0), (50, 480), (100, 950), (10, 2000), (1000, 0)])
def test_deep_pages(spark, limit, offset):
    df = spark.range(1000).selectExpr("id * 7 % 1000 as id", "cast(id % 13 as int) as a", "cast(id as string) as key").repartition(5)
    order = [F.desc("a"), F.asc("key")]
    want = [r["key"] for r in df.orderBy(*order).collect()][offset : offset + limit]
    for most in (10**6, 0):
        assert [r["key"] for r in query.page_rows(df, order, "key", limit, offset, most).orderBy(*order).collect()] == want


def test_paths(spark):
    """Chains, trees, parents that are no taxa, and cycles with what hangs on them."""
    from biorec.operators import taxonomy

    parents = {i: i - 1 for i in range(2, 40)} | {1: None, 100: 7, 101: 100, 200: 999, 300: 301, 301: 302, 302: 300, 303: 300, 304: 303, 400: 400}
    df = spark.createDataFrame(list(parents.items()), "id long, parent_taxon_id long")

    def walk(i):
        out, at = [], parents[i]
        while at in parents and at not in out and at != i:
            out.append(at)
            at = parents[at]
        return [*reversed(out), i]

    assert {r["id"]: r["path"] for r in taxonomy.with_paths(df).collect()} == {i: walk(i) for i in parents}
    assert taxonomy.with_paths(df.limit(0)).count() == 0


def test_one_join_for_all_ranks(spark):
    taxa = spark.createDataFrame([(1, "a", "A"), (2, "b", "B")], "id long, taxon_identifier string, scientific_name string")
    df = spark.createDataFrame([(5, 1, None, 2, None, 9), (6, None, None, None, None, None), (7, 1, None, 2, None, 1)], "key int, order_id long, superfamily_id long, family_id long, genus_id long, species_id long")
    out = query.include_parents(df, {"taxa": taxa})
    assert [(r["key"], r["order__scientific_name"], r["family__id"], r["species__taxon_identifier"]) for r in out.orderBy("key").collect()] == [(5, "A", 2, None), (6, None, None, None), (7, "A", 2, "a")]


def test_names_are_not_broadcast(spark):
    """However small the estimate of a table of taxa or names is, no lookup of them passes through the driver."""
    taxa = spark.createDataFrame([(1, "S1", 7)], "id long, scientific_name_identifier string, species_id long")
    names = spark.createDataFrame([(3, "S1")], "id long, given_name_identifier string")
    rows = spark.createDataFrame([("S1", "G"), ("X", "S1")], "scientific_name_identifier string, given_name_identifier string")
    out = merge.resolve_taxon_name(merge.resolve_taxon(rows, taxa), names)
    assert sorted((r["scientific_name_identifier"], r["taxon_id"], r["species_id"], r["taxon_name_id"]) for r in out.collect() if r["taxon_id"]) == [("S1", 1, 7, 3)]
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan and plan.count("SortMergeJoin") >= 3


def test_stored_rows_are_computed_once(spark):
    """The largest id is that of the merged rows: the stored table, which may be a long query, runs once."""
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    stored = spark.createDataFrame([(i * 3, f"k{i}", "a") for i in range(20)], "id long, key string, v string").mapInArrow(count, "id long, key string, v string")
    incoming = spark.createDataFrame([(f"k{i}", "b") for i in range(15, 25)], "key string, v string")
    out = {r["key"]: (r["id"], r["action"]) for r in merge.merge(stored, incoming, ["key"]).collect()}
    assert out["k19"] == (57, "updated") and [out[f"k{i}"] for i in range(20, 25)] == [(i, "inserted") for i in range(58, 63)]
    assert seen.value == 20
