import re

import pytest
from pyspark.sql import functions as F

from biorec.functions.columns import select_square_size, stable_uuid
from biorec.operators import geo


def test_square_sizes(spark):
    cases = {"1": 1, "9": 10, "11": 100, "900": 1000, "1500": 2000, "2001": 10000, "50000": 100000, None: 2000, "": 2000, "foo": 2000, "0": 2000, "-10": 2000}
    got = spark.createDataFrame([(k,) for k in cases], "u string").select("u", select_square_size(F.col("u")).alias("s")).collect()
    assert {r["u"]: r["s"] for r in got} == cases


def test_published_example(spark):
    df = spark.createDataFrame([(52 + 39 / 60 + 27.2531 / 3600, 1 + 43 / 60 + 4.5177 / 3600)], "a double, b double")
    assert tuple(df.select(*geo.airy_to_grid(F.col("a"), F.col("b"))).first()) == pytest.approx((651409.903, 313177.270), abs=0.001)


def test_references(spark):
    rows = [(1, "53.4808", "-2.2426", "1500", "WGS84", "OLD", "OLD"), (2, "53.4808", "-2.2426", "8000", "EPSG:4326", "OLD", "OLD"), (3, None, None, "1", "WGS84", "OLD", "OLD"), (4, "0", "0", "1", "WGS84", "OLD", "OLD"), (5, "53", "-2", "1", "osgb ", "SU1234", "SU13L"), (6, "foo", "1", "1", "WGS84", "OLD", "OLD")]
    df = spark.createDataFrame(rows, "id int, latitude string, longitude string, coordinate_uncertainty string, grid_ref_system string, grid_ref string, grid_ref_2km string")
    got = {r["id"]: (r["grid_ref"], r["grid_ref_2km"]) for r in geo.assign_grid_refs(df).collect()}
    assert re.fullmatch(r"[A-Z]{2}\d{2}[A-HJ-Z]", got[1][0]) and got[1][0] == got[1][1]
    assert re.fullmatch(r"[A-Z]{2}\d{2}", got[2][0]) and got[2][1] == ""
    assert got[3][0] is None and got[4][0] is None and got[6][0] is None and got[5] == ("SU1234", "SU13L")


def test_tetrads(spark):
    df = spark.createDataFrame([("SU12",), ("SU1234",), ("SU123456",), ("su 13 l",)], "r string")
    assert [r[0] for r in df.select(geo.tetrad_from_ref(F.col("r"))).collect()] == [None, "SU13L", "SU14L", "SU13L"]


REGIONS = [(1, "POLYGON((0 0,2 0,2 2,0 2,0 0))"), (2, "POLYGON((1 1,3 1,3 3,1 3,1 1))"), (3, "POLYGON((10 10,20 10,20 20,10 20,10 10),(12 12,18 12,18 18,12 18,12 12))"), (4, None), (5, " ")]
OCC = "id long, longitude double, latitude double, blocked int, deleted_at timestamp"


def test_regions(spark):
    regions = spark.createDataFrame([(*r, None) for r in REGIONS], "id long, footprint_geometry string, deleted_at timestamp")
    occ = spark.createDataFrame([(11, 1.5, 1.5, 0, None), (12, 4.0, 4.0, 0, None), (13, 1.5, 1.5, 1, None), (14, 0.0, 1.0, 0, None), (15, 15.0, 15.0, 0, None), (16, 11.0, 11.0, 0, None), (17, None, 1.0, 0, None)], OCC)
    links = geo.assign_regions(occ, regions)
    assert sorted(map(tuple, links.collect())) == [(1, 11), (1, 14), (2, 11), (3, 16)]
    assert sorted(map(tuple, geo.assign_regions(occ, regions, most_cells=4).collect())) == [(1, 11), (1, 14), (2, 11), (3, 16)]
    moved = spark.createDataFrame([(11, 4.0, 4.0, 0, None), (12, 1.0, 0.5, 0, None)], OCC)
    old = spark.createDataFrame([(1, 11), (1, 12)], "geographic_region_id long, occurrence_id long")
    changed = spark.createDataFrame([(11,)], "occurrence_id long")
    assert list(map(tuple, geo.reassign_regions(old, moved, regions, changed).collect())) == [(1, 12)]


def test_uuid(spark):
    assert spark.range(1).select(stable_uuid(F.lit("1|global"))).first()[0] == "843979e0-8f7b-4675-a0ff-0ca37f8e0159"


def test_inverse(spark):
    """Grid positions to WGS84 and back, under a millimetre; the published example on the Airy ellipsoid."""
    df = spark.createDataFrame([(651409.903, 313177.270), (400000.0, 100000.0), (250000.0, 800000.0), (530000.0, 180000.0)], "e double, n double")
    back = df.withColumn("p", geo.grid_to_wgs84(F.col("e"), F.col("n"))).withColumn("q", geo.position(F.col("p.la"), F.col("p.lo")))
    assert all(r["q"]["e"] == pytest.approx(r["e"], abs=1e-3) and r["q"]["n"] == pytest.approx(r["n"], abs=1e-3) for r in back.collect())
    airy = df.limit(1).select(*geo.grid_to_airy(F.col("e"), F.col("n"))).first()
    assert tuple(airy) == pytest.approx((52 + 39 / 60 + 27.2531 / 3600, 1 + 43 / 60 + 4.5177 / 3600), abs=1e-8)


def test_fishnet(spark):
    """A box of 3 km by 1 km that ends on a cell's edge: the cell beyond is touched, and partial."""
    ring = "POLYGON((400500 200500,404000 200500,404000 201500,400500 201500,400500 200500))"
    whole = "POLYGON((400000 200000,404000 200000,404000 204000,400000 204000,400000 200000))"
    regions = spark.createDataFrame([(1, ring, None), (2, whole, None)], "id long, footprint_geometry string, deleted_at timestamp")
    rows = geo.fishnet(regions).collect()
    assert sorted((r["centre_easting"], r["centre_northing"], r["partial"]) for r in rows if r["geographic_region_id"] == 1) == [(401000, 201000, 1), (403000, 201000, 1), (405000, 201000, 1)]
    assert sum(r["partial"] == 0 for r in rows if r["geographic_region_id"] == 2) == 4 and sum(r["geographic_region_id"] == 2 for r in rows) == 16
    assert all(49 < r["centre_lat"] < 61 and -3 < r["centre_lon"] < 0 and r["square"].startswith("SP") for r in rows if min(r["centre_easting"] - 200000, r["centre_northing"]) > 200000)


def star(rng, cx, cy, radius, corners):
    """A ring around a point, in and out, with some corners on lattice lines."""
    import math

    out = []
    for k in range(corners):
        r, a = radius * rng.uniform(0.3, 1), 2 * math.pi * (k + rng.uniform(0, 0.8)) / corners
        x, y = cx + r * math.cos(a), cy + r * math.sin(a)
        out.append((float(round(x)), y) if k % 4 == 0 else (x, float(round(y))) if k % 4 == 1 else (x, y))
    return out


def wkt(*rings):
    return "POLYGON(" + ",".join("(" + ",".join(f"{x!r} {y!r}" for x, y in [*r, r[0]]) + ")" for r in rings) + ")"


def within(rings, x, y):
    """Even-odd, a boundary inside."""
    odd = False
    for r in rings:
        for (x1, y1), (x2, y2) in zip(r, r[1:] + r[:1]):
            if abs((y - y1) * (x2 - x1) - (x - x1) * (y2 - y1)) <= 1e-9 and min(x1, x2) <= x <= max(x1, x2) and min(y1, y2) <= y <= max(y1, y2):
                return True
            if (y1 > y) != (y2 > y) and x < (x2 - x1) * (y - y1) / (y2 - y1) + x1:
                odd = not odd
    return odd


def meets(a, b, x, y, size, interior):
    """Does the edge touch the box (or its interior)? By clipping."""
    low, high = 0.0, 1.0
    for p, d, lo in ((a[0], b[0] - a[0], x), (a[1], b[1] - a[1], y)):
        if d == 0:
            if not (lo < p < lo + size if interior else lo <= p <= lo + size):
                return False
            continue
        t = sorted(((lo - p) / d, (lo + size - p) / d))
        low, high = max(low, t[0]), min(high, t[1])
    return low < high if interior else low <= high


def test_regions_of_random_shapes(spark):
    import random

    rng = random.Random(11)
    shapes = [[star(rng, rng.uniform(0, 9), rng.uniform(0, 9), rng.uniform(0.2, 5), rng.randrange(3, 30))] for _ in range(8)]
    shapes += [[star(rng, 5, 5, 4, 12), star(rng, 5, 5, 1, 7)], [[(1.0, 1.0), (3.0, 1.0), (3.0, 3.0), (1.0, 3.0)], [(5.0, 1.0), (7.0, 1.0), (7.0, 3.0), (5.0, 3.0)]]]
    regions = spark.createDataFrame([(k, wkt(*s), None) for k, s in enumerate(shapes)], "id long, footprint_geometry string, deleted_at timestamp")
    places = [(rng.uniform(-1, 11), rng.uniform(-1, 11)) for _ in range(1500)] + [(x / 2, y / 2) for x in range(20) for y in range(20)] + [p for s in shapes for r in s for p in r]
    occ = spark.createDataFrame([(k, *p, 0, None) for k, p in enumerate(places)], OCC)
    want = sorted((r, k) for k, p in enumerate(places) for r, s in enumerate(shapes) if within(s, *p))
    for how in ({"cell": 0.5}, {"cell": 0.5, "most_cells": 30}, {}):
        assert sorted(map(tuple, geo.assign_regions(occ, regions, **how).collect())) == want


def test_whole_cells_need_no_edges(spark):
    """Of a large region most cells are whole; the others are about as many as its boundary is long."""
    ring = [(0.05, 0.05), (9.95, 0.05), (9.95, 9.95), (0.05, 9.95)]
    cells, rows = geo.region_cells(spark.createDataFrame([(1, wkt(ring), None)], "id long, footprint_geometry string, deleted_at timestamp"))
    counts = {r["whole"]: r["count"] for r in cells.groupBy("whole").count().collect()}
    assert counts == {True: 98 * 98, False: 4 * 99} and rows.count() == 100 and cells.distinct().count() == 100 * 100


def test_fishnet_of_random_shapes(spark):
    import random

    rng = random.Random(12)
    scale = lambda s: [[(400000 + 1000 * x, 200000 + 1000 * y) for x, y in r] for r in s]
    shapes = [scale([star(rng, rng.uniform(9, 20), rng.uniform(9, 20), rng.uniform(1, 9), rng.randrange(3, 20))]) for _ in range(6)] + [scale([star(rng, 15, 15, 12, 12), star(rng, 15, 15, 3, 7)])]
    shapes.append([[(400000.0, 200000.0), (406000.0, 200000.0), (406000.0, 204000.0), (400000.0, 204000.0)]])
    regions = spark.createDataFrame([(k, wkt(*s), None) for k, s in enumerate(shapes)], "id long, footprint_geometry string, deleted_at timestamp")
    want = []
    for k, s in enumerate(shapes):
        sides = [(a, b) for r in s for a, b in zip(r, r[1:] + r[:1])]
        for e in range(396000, 450000, 2000):
            for n in range(196000, 250000, 2000):
                touched, cut = (any(meets(a, b, e, n, 2000, i) for a, b in sides) for i in (False, True))
                inside = within(s, e + 1000, n + 1000)
                if touched or inside:
                    want.append((k, e + 1000, n + 1000, int(cut or not inside)))
    got = geo.fishnet(regions).select("geographic_region_id", "centre_easting", "centre_northing", "partial").collect()
    assert sorted(map(tuple, got)) == sorted(want)


def test_changed_records_are_not_broadcast(spark):
    """However small their estimate is, the records that a batch changed do not pass through the driver."""
    box = "POLYGON((0 50,1 50,1 51,0 51,0 50))"
    regions = spark.createDataFrame([(1, box, None)], "id long, footprint_geometry string, deleted_at timestamp")
    occ = spark.createDataFrame([(5, 0.5, 50.5, 0, None), (6, 0.5, 50.5, 0, None)], "id long, longitude double, latitude double, blocked int, deleted_at timestamp")
    bridge = spark.createDataFrame([(9, 5), (9, 6)], "geographic_region_id long, occurrence_id long")
    changed = spark.createDataFrame([(5,), (5,)], "occurrence_id long")
    out = geo.reassign_regions(bridge, occ, regions, changed)
    assert sorted(map(tuple, out.collect())) == [(1, 5), (9, 6)]
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert all("strategy=merge" in line for line in plan.splitlines() if "LeftAnti" in line or "LeftSemi" in line) and "LeftAnti" in plan and "LeftSemi" in plan


def test_refs_are_made_by_compiled_steps(spark, capsys):
    """The steps of a reference are projections of plain columns, not functions of arrays, which are interpreted for each row."""
    rows = [(i, 49.5 + i % 12, -7.5 + i * 0.37 % 10, str(i * 7 % 150), ["WGS84", "OSGB", None, "OSGB36"][i % 4]) for i in range(60)] + [(90, None, 1.0, "5", "WGS84"), (91, 10.0, 1.0, "5", "WGS84")]
    df = spark.createDataFrame(rows, "id int, latitude double, longitude double, coordinate_uncertainty string, grid_ref_system string").withColumns({"grid_ref": F.lit("OLD"), "grid_ref_2km": F.lit("OLD2")})
    out = geo.assign_grid_refs(df)
    assert out.columns == df.columns
    out.explain()
    assert "lambda" not in capsys.readouterr().out
    again = F.coalesce(~F.upper("grid_ref_system").isin("OSGB", "OSGB1936", "EPSG:27700"), F.lit(False))
    made = df.withColumn("r", geo.let(geo.position(F.col("latitude"), F.col("longitude")), lambda p: geo.let(select_square_size(F.col("coordinate_uncertainty")), lambda s: geo.grid_ref(p["e"], p["n"], s))))
    fine = F.when(F.col("r").isNotNull(), F.coalesce(geo.tetrad_from_ref(F.col("r")), F.lit("")))
    want = made.select("id", F.when(again, F.col("r")).otherwise("OLD").alias("r"), F.when(again, fine).otherwise("OLD2").alias("f"))
    assert {tuple(r) for r in out.select("id", "grid_ref", "grid_ref_2km").collect()} == {tuple(r) for r in want.collect()}
