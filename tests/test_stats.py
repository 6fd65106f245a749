import datetime as dt

from pyspark.sql import functions as F

from biorec.functions import columns as X
from biorec.operators import stats

OCC = "id long, taxon_id long, order_id long, superfamily_id long, family_id long, genus_id long, species_id long, from_date date, to_date date, grid_ref_2km string, recorded_by string, identification_verification_status string, blocked int, deleted_at timestamp"
TAXA = "id long, taxon_identifier string, taxon_rank_id long, species_id long, rarity_group_name string, rarity_category int, blocked int, deleted_at timestamp"
GONE = dt.datetime(2024, 1, 1)
d = dt.date.fromisoformat


def occ(spark, rows):
    """(id, taxon, rank ids or None for the taxon, from, to, square, recorder, status, blocked, deleted)"""
    full = [(i, t, *(r or (t,) * 5), f and d(f), u and d(u), s, w, v, b, GONE if x else None) for i, t, r, f, u, s, w, v, b, x in rows]
    return spark.createDataFrame(full, OCC)


def taxa(spark, rows):
    return spark.createDataFrame([(i, f"T{i}", rank, sp, group, None, blocked, None) for i, rank, sp, group, blocked in rows], TAXA)


def ranks(spark):
    return spark.createDataFrame([(1, 0), (2, 1)], "id long, is_reporting int")


def bridge(spark, rows):
    return spark.createDataFrame(rows, "geographic_region_id long, occurrence_id long")


T1 = [
    (1, 1, None, "2020-01-01", None, "SU01A", "First", "V", 0, 0), (2, 1, None, None, "2020-02-01", "SU01A", "Second", "C", 0, 0), (3, 1, None, "2021-01-01", None, "SU02B", "Third", "V2", 0, 0),
    (4, 2, None, "2022-01-01", None, "SU03C", "Other", "V1", 0, 0), (5, 1, None, "2023-01-01", None, "SU04D", "Blocked", "V", 1, 0), (6, 1, None, "2023-02-01", None, "SU05E", "Deleted", "V", 0, 1), (7, 3, None, "2021-05-01", None, "SU06F", "Taxon blocked", "V", 0, 0),
]


def test_taxon_stats(spark):
    out = stats.taxon_stats(occ(spark, T1), taxa(spark, [(1, 1, 1, None, 0), (2, 1, 2, None, 0), (3, 1, 3, None, 1)]), ranks(spark), bridge(spark, [(11, 1), (11, 2), (22, 3), (11, 4), (11, 5), (11, 6), (11, 7)]))
    rows = {(r["taxon_id"], r["geographic_region_id"]): r for r in out.collect()}
    assert len(rows) == 5
    g = rows[1, None]
    assert (g["occurrences_count"], g["grid_square_count"], g["first_recorder"], g["last_recorder"]) == (3, 2, "First", "Third")
    assert (g["first_verified_record_date"], g["last_verified_record_date"], len(g["uuid"])) == (d("2020-01-01"), d("2021-01-01"), 36)
    local = rows[1, 11]
    assert (local["occurrences_count"], local["grid_square_count"], local["last_record_date"], local["last_verified_record_date"]) == (2, 1, d("2020-02-01"), d("2020-01-01"))
    assert rows[1, 22]["first_verified_recorder"] == "Third"


def test_roll_up(spark):
    o = occ(spark, [(1, 4, (10, 11, 12, 13, 14), "2020-01-01", None, "SU01A", "A", "V", 0, 0)])
    out = stats.taxon_stats(o, taxa(spark, [(4, 1, 14, None, 0)]), ranks(spark), bridge(spark, [(11, 1)]))
    assert sorted((r["taxon_id"], r["geographic_region_id"] or 0, r["occurrences_count"]) for r in out.collect()) == [(t, g, 1) for t in (4, 10, 11, 12, 13, 14) for g in (0, 11)]


def test_year_stats(spark):
    rows = [(1, 1, None, "2018-01-01", None, "SU01A", "", "", 0, 0), (2, 1, None, None, "2018-02-01", "SU01A", "", "", 0, 0), (3, 1, None, "2018-05-01", None, "SU02B", "", "", 0, 0), (4, 2, None, "2018-03-15", None, "SU03C", "", "", 0, 0), (5, 1, None, "2009-01-01", None, "SU01A", "", "", 0, 0)]
    out = stats.taxon_year_stats(occ(spark, rows), taxa(spark, [(1, 1, 1, None, 0), (2, 1, 2, None, 0)]), ranks(spark), bridge(spark, [(11, 1), (11, 2), (22, 3), (11, 4), (11, 5)]), 2020)
    got = {(r["taxon_id"], r["geographic_region_id"]): (r["occurrences_count"], r["grid_square_count"]) for r in out.collect()}
    assert got == {(1, None): (3, 2), (1, 11): (2, 1), (1, 22): (1, 1), (2, None): (1, 1), (2, 11): (1, 1)}


def test_squares_and_scores(spark):
    squares = [("SU99A", 1), ("SU99A", 2), ("SU10B", 3), ("SU10B", 4), ("SU11C", 1)] + [("SU12D", 4)] * 4
    rows = [(i + 1, t, None, "2020-01-01", None, s, "", "", 0, 0) for i, (s, t) in enumerate(squares)]
    out = stats.grid_square_stats(occ(spark, rows), bridge(spark, [(11, i + 1) for i in range(9)]), taxa(spark, [(1, 1, 1, None, 0), (2, 1, 2, None, 0), (3, 1, 1, None, 0), (4, 1, 3, None, 0)]))
    got = {r["square"]: (r["occurrences_count"], r["species_count"], r["rarity_score"]) for r in out.collect()}
    assert got == {"SU99A": (2, 2, 133.3333), "SU10B": (2, 2, 53.3333), "SU11C": (1, 1, 33.3333), "SU12D": (4, 1, 80.0)}


def test_reset_then_update(spark):
    grid = spark.createDataFrame([("SU10B", 22, 9, 7, 77.7), ("SU99A", 11, 0, 0, 0.0)], "square string, geographic_region_id long, occurrences_count int, species_count int, rarity_score double")
    counted = spark.createDataFrame([("SU99A", 11, 3, 2, 1.5), ("SU77C", 33, 1, 1, 2.0)], "square string, geographic_region_id long, occurrences_count long, species_count long, rarity_score double")
    new, missing = stats.reset_then_update(grid, counted)
    assert sorted(map(tuple, new.collect())) == [("SU10B", 22, 0, 0, 0.0), ("SU99A", 11, 3, 2, 1.5)]
    assert [r["square"] for r in missing.collect()] == ["SU77C"]


def test_rarity(spark):
    t = taxa(spark, [(i, 1, i, "Bees" if i < 6 else "Birds", 0) for i in range(1, 11)])
    rows, n = [], 0
    for i in range(1, 11):
        for k in range(i - 1 if i < 6 else i):
            n += 1
            rows.append((n, i, None, "2020-01-01", None, f"SU{n:02}A", "", "", 0, 0))
    got = {r["id"]: r["category"] for r in stats.taxon_rarity(t, occ(spark, rows)).collect()}
    assert [got[i] for i in range(1, 11)] == [1, 2, 3, 4, 5] * 2


def test_rarity_weights(spark):
    """Records count alone, also those without a square; inactive ones do not."""
    t = taxa(spark, [(1, 1, 1, "Odonata", 0), (2, 1, 2, "Odonata", 0)])
    rows = [(1, 1, None, "2020-01-01", None, "SU01A", "", "", 0, 0), (2, 2, None, "2020-01-01", None, " ", "", "", 0, 0), (3, 2, None, "2020-01-01", None, None, "", "", 0, 0), (4, 1, None, "2020-01-01", None, "SU01A", "", "", 1, 0), (5, 1, None, "2020-01-01", None, "SU01A", "", "", 0, 1)]
    got = {r["id"]: r["category"] for r in stats.taxon_rarity(t, occ(spark, rows), 0.0, 1.0).collect()}
    assert got == {1: 1, 2: 5}


def test_rarity_labels(spark):
    df = spark.range(0, 7).select("id", X.rarity_label(F.col("id")).alias("label"))
    assert [r["label"] for r in df.orderBy("id").collect()] == [None, "Extremely rare", "Rare", "Scarce", "Frequent", "Common", None]


def test_apply_rarity(spark):
    t = taxa(spark, [(1, 1, 1, "G", 0), (2, 1, 1, "G", 0), (3, 1, None, "G", 0)]).withColumn("rarity_category", F.lit(4))
    new = spark.createDataFrame([(1, "G", 2)], "id long, group_name string, category int")
    out, counts = stats.apply_rarity(t, new)
    assert {r["id"]: r["rarity_category"] for r in out.collect()} == {1: 2, 2: None, 3: 4} and [tuple(r) for r in counts.collect()] == [("changed", 1)]
    cleared, _ = stats.apply_rarity(t, new.limit(0))
    assert {r["rarity_category"] for r in cleared.collect()} == {None}


def test_run_summary(spark):
    merged = spark.createDataFrame([("inserted",), ("updated",), ("inserted",)], "action string")
    assert sorted(map(tuple, stats.run_summary(merged).collect())) == [("inserted", 2), ("updated", 1)]


def test_home_counts(spark):
    o = occ(spark, [(i, 1, None, "2020-01-01", None, "S", "", "", int(i == 3), int(i == 4)) for i in range(1, 5)])
    regions = spark.createDataFrame([(1, None), (2, None), (3, GONE)], "id long, deleted_at timestamp")
    assert tuple(stats.home_counts(o, taxa(spark, [(1, 2, 1, None, 0), (2, 1, 2, None, 0), (3, 2, 3, None, 1)]), ranks(spark), regions).first()) == (2, 1, 2)


def test_rarity_in_parts(spark):
    """Groups ranked in parts come out as those ranked by one task, ties and groups of one included."""
    import random

    rng = random.Random(4)
    taxa = spark.createDataFrame([(i, f"T{i:04}", i, rng.choice(("Unassigned",) * 8 + ("Moths ", "Bees")) if i else "Alone", 0, None) for i in range(400)], "id long, taxon_identifier string, species_id long, rarity_group_name string, blocked int, deleted_at timestamp")
    occ = spark.createDataFrame([(k, min(399, int(rng.expovariate(0.02))), f"SU{rng.randrange(30)}", 0, None) for k in range(3000)], "id long, species_id long, grid_ref_2km string, blocked int, deleted_at timestamp")
    plain, parts = (sorted(map(tuple, stats.taxon_rarity(taxa, occ, 1.0, 0.5, most_in_task=n).collect())) for n in (10**6, 0))
    assert plain == parts and len(plain) == 400 and {c for *_, c in plain} == {1, 2, 3, 4, 5}


def test_reset_counts_records_once(spark):
    """What is counted is used three times and computed once: the plan of the result reads no records."""
    from biorec.plans import registry

    out = registry.queries()["s7_reset_then_update"](spark, "/root/testdata/sf0.001")
    assert out.count() and not [f for f in out.inputFiles() if "lineitem" in f]


def test_taxon_stats_of_ids_at_several_ranks(spark):
    """A taxon that is a species of some records and a family of others; links that repeat or name no region; records without a square."""
    import datetime

    day = lambda i: datetime.date(2000, 1, 1) + datetime.timedelta(i * 37 % 400)
    taxa = spark.createDataFrame([(i, 3, 7 if i < 9 else 3, i, 0, None) for i in range(1, 13)], "id long, taxon_rank_id int, family_id long, species_id long, blocked int, deleted_at timestamp")
    ranks = spark.createDataFrame([(3, 1)], "id int, is_reporting int")
    rows = [(i, i % 12 + 1, 7 if i % 12 + 1 < 9 else 3, i % 12 + 1, day(i), None, None if i % 7 == 0 else f" su{i % 4} ", f"r{i % 5}", "V" if i % 3 else "C", 0, None) for i in range(120)]
    occ = spark.createDataFrame(rows, "id long, taxon_id long, family_id long, species_id long, from_date date, to_date date, grid_ref_2km string, recorded_by string, identification_verification_status string, blocked int, deleted_at timestamp")
    links = [(i, i % 3 + 1) for i in range(0, 120, 2)] * 2 + [(i, None) for i in range(0, 120, 5)]
    bridge = spark.createDataFrame(links, "occurrence_id long, geographic_region_id long")
    want = {}
    for r in rows:
        for region in {None} | {g for o, g in links if o == r[0]}:
            for taxon in {r[2], r[3]}:
                want.setdefault((taxon, region), []).append(r)
    want = {k: (len(v), len({x[6] for x in v if x[6]}), min((x[4], x[0]) for x in v)[0], max((x[4], x[0], x[7]) for x in v)[2]) for k, v in want.items()}
    got = stats.taxon_stats(occ, taxa, ranks, bridge, ("Family", "Species")).collect()
    assert len(got) == len(want)
    assert {(r["taxon_id"], r["geographic_region_id"]): (r["occurrences_count"], r["grid_square_count"], r["first_record_date"], r["last_recorder"]) for r in got} == want


def test_taxon_stats_shuffle_records_before_their_scopes(spark, capsys):
    """No aggregate with texts, which sorts, runs before the exchange by taxon: records are expanded to their scopes after it."""
    taxa = spark.createDataFrame([(1, 3, 7, 1, 0, None)], "id long, taxon_rank_id int, family_id long, species_id long, blocked int, deleted_at timestamp")
    occ = spark.createDataFrame([], "id long, taxon_id long, family_id long, species_id long, from_date date, to_date date, grid_ref_2km string, recorded_by string, identification_verification_status string, blocked int, deleted_at timestamp")
    stats.taxon_stats(occ, taxa, spark.createDataFrame([(3, 1)], "id int, is_reporting int"), spark.createDataFrame([], "occurrence_id long, geographic_region_id long"), ("Family", "Species")).explain()
    plan = capsys.readouterr().out
    assert 0 < plan.index("explode(scopes") < plan.index("REPARTITION_BY_COL") and "SortAggregate" not in plan[plan.index("REPARTITION_BY_COL"):]


def test_records_and_links_are_dealt_by_number(spark):
    """Tasks that join records with their regions hold small shares: adaptive execution doesn't put them together."""
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = [(i, 1, f"SU{i % 10}", 2) for i in range(50)]
    rows = spark.createDataFrame(rows, "occurrence_id long, taxon_id long, square string, species_id long")
    links = spark.createDataFrame([(7, i) for i in range(50)], "geographic_region_id long, occurrence_id long")
    per = stats._per_species(rows, links)
    plan = per._jdf.queryExecution().executedPlan().toString()
    assert plan.count("hashpartitioning(occurrence_id") == plan.count("REPARTITION_BY_NUM") == 2 and f", {n}), REPARTITION_BY_NUM" in plan
    assert sorted(map(tuple, per.collect())) == [(f"SU{i}", 7, 2, 5) for i in range(10)]
