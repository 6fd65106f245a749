"""British grid references, region assignment and fishnets, in native expressions."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from biorec.functions.columns import is_active, needs_regeneration, nullable_float, select_square_size
from biorec.functions.tables import settled

# Ellipsoids WGS84 and Airy 1830, the OSGB36 datum shift, the National Grid projection.
WGS84, AIRY = (6378137.0, 6356752.314245), (6377563.396, 6356256.909)
SHIFT = (-446.448, 125.157, -542.06)  # metres
TURN = (-0.1502, -0.247, -0.8421)  # seconds of arc
SCALE = 20.4894e-6
F0, LAT0, LON0, E0, N0 = 0.9996012717, 49.0, -2.0, 400000.0, -100000.0
LETTERS = "ABCDEFGHJKLMNOPQRSTUVWXYZ"
#: The default 2 km letters; the usual scheme counts south-north first and omits O as well.
TETRADS = "ABCDEFGHIJKLMNPQRSTUVWXYZ"


def airy_to_grid(lat: Column, lon: Column) -> tuple[Column, Column]:
    """Easting and northing of a position (degrees) on the Airy ellipsoid, by the published series."""
    phi, lam = F.radians(lat), F.radians(lon) - math.radians(LON0)
    s = F.sin(phi)
    return _series(phi, lam, s, F.cos(phi), F.tan(phi), *_radii(s))


def _radii(s: Column) -> tuple[Column, Column]:
    """nu and rho at the latitude with this sine."""
    a, b = AIRY
    e2 = 1 - (b * b) / (a * a)
    return a * F0 / F.sqrt(1 - e2 * s * s), a * F0 * (1 - e2) / F.pow(1 - e2 * s * s, 1.5)


def _series(phi: Column, lam: Column, s: Column, c: Column, t: Column, nu: Column, rho: Column) -> tuple[Column, Column]:
    eta2 = nu / rho - 1
    t2 = t * t
    north = N0 + _arc(phi) + nu / 2 * s * c * lam**2 + nu / 24 * s * c**3 * (5 - t2 + 9 * eta2) * lam**4 + nu / 720 * s * c**5 * (61 - 58 * t2 + t2 * t2) * lam**6
    east = E0 + nu * c * lam + nu / 6 * c**3 * (nu / rho - t2) * lam**3 + nu / 120 * c**5 * (5 - 18 * t2 + t2 * t2 + 14 * eta2 - 58 * t2 * eta2) * lam**5
    return east, north


def _on_airy(lat: Column, lon: Column) -> tuple[Column, Column, Column]:
    """Cartesian coordinates after the datum shift, of a position (degrees) in WGS84."""
    a, b = WGS84
    e2 = 1 - (b * b) / (a * a)
    phi, lam = F.radians(lat), F.radians(lon)
    nu = a / F.sqrt(1 - e2 * F.sin(phi) ** 2)
    x, y, z = nu * F.cos(phi) * F.cos(lam), nu * F.cos(phi) * F.sin(lam), nu * (1 - e2) * F.sin(phi)
    rx, ry, rz = (math.radians(v / 3600) for v in TURN)
    k = 1 + SCALE
    return SHIFT[0] + k * x - rz * y + ry * z, SHIFT[1] + rz * x + k * y - rx * z, SHIFT[2] - ry * x + rx * y + k * z


def _turned(f: Column, z: Column, p: Column) -> Column:
    """The next round of the latitude of a point at height z and distance p from the axis of the Airy ellipsoid."""
    a, b = AIRY
    e2 = 1 - (b * b) / (a * a)
    return F.atan2(z + e2 * (a / F.sqrt(1 - e2 * F.sin(f) ** 2)) * F.sin(f), p)


def _first_turn(z: Column, p: Column) -> Column:
    a, b = AIRY
    return F.atan2(z, p * (1 - (1 - (b * b) / (a * a))))


#: Rounds that bring the latitude under a millimetre.
TURNS = 4


def wgs84_to_airy(lat: Column, lon: Column) -> tuple[Column, Column]:
    """The datum shift, through Cartesian coordinates."""
    x, y, z = _on_airy(lat, lon)
    p = F.sqrt(x * x + y * y)
    turned = F.aggregate(F.sequence(F.lit(1), F.lit(TURNS)), _first_turn(z, p), lambda f, _: _turned(f, z, p))
    return F.degrees(turned), F.degrees(F.atan2(y, x))


def _arc(phi: Column) -> Column:
    """The meridional arc of the projection."""
    a, b = AIRY
    n = (a - b) / (a + b)
    dp, sp = phi - math.radians(LAT0), phi + math.radians(LAT0)
    return b * F0 * (
        (1 + n + 1.25 * n**2 + 1.25 * n**3) * dp - (3 * n + 3 * n**2 + 2.625 * n**3) * F.sin(dp) * F.cos(sp)
        + (1.875 * n**2 + 1.875 * n**3) * F.sin(2 * dp) * F.cos(2 * sp) - 35 / 24 * n**3 * F.sin(3 * dp) * F.cos(3 * sp)
    )


def grid_to_airy(east: Column, north: Column) -> tuple[Column, Column]:
    """Latitude and longitude (degrees, Airy) of a grid position, by the published series; eight rounds bring the arc under a millimetre."""
    a, b = AIRY
    e2 = 1 - (b * b) / (a * a)
    phi = F.aggregate(F.sequence(F.lit(1), F.lit(8)), math.radians(LAT0) + (north - N0) / (a * F0), lambda p, _: p + (north - N0 - _arc(p)) / (a * F0))
    s, c, t = F.sin(phi), F.cos(phi), F.tan(phi)
    nu = a * F0 / F.sqrt(1 - e2 * s * s)
    rho = a * F0 * (1 - e2) / F.pow(1 - e2 * s * s, 1.5)
    eta2, t2, de = nu / rho - 1, t * t, east - E0
    lat = phi - t / (2 * rho * nu) * de**2 + t / (24 * rho * nu**3) * (5 + 3 * t2 + eta2 - 9 * t2 * eta2) * de**4 - t / (720 * rho * nu**5) * (61 + 90 * t2 + 45 * t2**2) * de**6
    lam = de / (c * nu) - (nu / rho + 2 * t2) / (6 * c * nu**3) * de**3 + (5 + 28 * t2 + 24 * t2**2) / (120 * c * nu**5) * de**5 - (61 + 662 * t2 + 1320 * t2**2 + 720 * t2**3) / (5040 * c * nu**7) * de**7
    return F.degrees(lat), LON0 + F.degrees(lam)


def airy_to_wgs84(lat: Column, lon: Column) -> tuple[Column, Column]:
    """The datum shift turned round: the shift at a position, taken off it; three rounds."""
    at = F.struct(lat.cast("double").alias("la"), lon.cast("double").alias("lo"))

    def step(p: Column, _: Column) -> Column:
        la, lo = wgs84_to_airy(p["la"], p["lo"])
        return F.struct((p["la"] + lat - la).alias("la"), (p["lo"] + lon - lo).alias("lo"))

    found = F.aggregate(F.sequence(F.lit(1), F.lit(3)), at, step)
    return found["la"], found["lo"]


def grid_to_wgs84(east: Column, north: Column) -> Column:
    """(la, lo) in WGS84 of a grid position."""
    pair = lambda values: F.struct(values[0].alias("la"), values[1].alias("lo"))
    return let(F.struct(east.cast("double").alias("e"), north.cast("double").alias("n")), lambda p: let(pair(grid_to_airy(p["e"], p["n"])), lambda q: pair(airy_to_wgs84(q["la"], q["lo"]))))


def on_grid(east: Column, north: Column) -> Column:
    return (east >= 0) & (east < 700000) & (north >= 0) & (north < 1300000)


def grid_letters(east: Column, north: Column) -> Column:
    e, n = F.floor(east / 100000), F.floor(north / 100000)
    first = (19 - n) - (19 - n) % 5 + F.floor((e + 10) / 5)
    second = (19 - n) * 5 % 25 + e % 5
    letter = lambda i: F.substring(F.lit(LETTERS), (i + 1).cast("int"), F.lit(1))
    return F.when(on_grid(east, north), F.concat(letter(first), letter(second)))


def tetrad(east: Column, north: Column, letters: str = TETRADS, south_north: bool = False) -> Column:
    e, n = F.floor(east) % 100000, F.floor(north) % 100000
    x, y = F.floor(e % 10000 / 2000), F.floor(n % 10000 / 2000)
    at = x * 5 + y if south_north else y * 5 + x
    return F.concat(grid_letters(east, north), F.floor(e / 10000).cast("string"), F.floor(n / 10000).cast("string"), F.substring(F.lit(letters), (at + 1).cast("int"), F.lit(1)))


def grid_ref(east: Column, north: Column, size: Column) -> Column:
    digits = F.when(size == 1, 5).when(size == 10, 4).when(size == 100, 3).when(size == 1000, 2).when(size == 10000, 1)
    part = lambda v: F.lpad(F.floor(F.floor(v) % 100000 / size).cast("string"), digits, F.lit("0"))
    return F.when(size == 2000, tetrad(east, north)).when(size == 100000, grid_letters(east, north)).otherwise(F.concat(grid_letters(east, north), part(east), part(north)))


def tetrad_from_ref(ref: Column, accept_i: bool = True) -> Column:
    """The tetrad of a reference: one is its own tetrad; else two letters with an even number of digits, at least 4."""
    return let(_plain_ref(ref), lambda r: _tetrad_of(r, _ref_digits(r), accept_i))


def _plain_ref(ref: Column) -> Column:
    return F.upper(F.replace(ref, F.lit(" "), F.lit("")))


def _ref_digits(r: Column) -> Column:
    return F.regexp_extract(r, "^[A-HJ-Z]{2}([0-9]+)$", 1)


def _tetrad_of(r: Column, digits: Column, accept_i: bool) -> Column:
    own = r.rlike("^[A-Z]{2}[0-9]{2}[A-Z]$") if accept_i else r.rlike("^[A-Z]{2}[0-9]{2}[A-HJ-Z]$")
    half = (F.length(digits) / 2).cast("int")
    km = lambda at: F.substring(digits, at, F.lit(2))
    e, n = km(F.lit(1)), km(half + 1)
    at = F.floor(F.substring(n, 2, 1).cast("int") / 2) * 5 + F.floor(F.substring(e, 2, 1).cast("int") / 2)
    made = F.concat(F.substring(r, 1, 2), F.substring(e, 1, 1), F.substring(n, 1, 1), F.substring(F.lit(TETRADS), (at + 1).cast("int"), F.lit(1)))
    return F.when(own, r).when((F.length(digits) >= 4) & (F.length(digits) % 2 == 0), made)


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once, however often ``use`` names it and wherever Catalyst moves the expression."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def position(lat: Column, lon: Column) -> Column:
    """(e, n) on the grid of a WGS84 position; null where it is missing or off the grid. For very many rows see ``with_position``."""
    pair = lambda names, values: F.struct(*[v.alias(n) for n, v in zip(names, values)])
    airy = lambda p: pair(("la", "lo"), wgs84_to_airy(p["la"], p["lo"]))
    found = let(pair(("la", "lo"), (lat, lon)), lambda p: let(airy(p), lambda q: pair(("e", "n"), airy_to_grid(q["la"], q["lo"]))))
    return let(found, lambda p: F.when(on_grid(p["e"], p["n"]), p))


def with_position(df: DataFrame, lat: Column, lon: Column) -> DataFrame:
    """``df`` with ``position`` as columns _e and _n.

    Each step that is used more than once is a column: such projections stay apart, and their code is compiled.
    """
    c = F.col
    out = df.withColumns({"_lat": lat, "_lon": lon})
    out = out.withColumns(dict(zip(("_x", "_y", "_z"), _on_airy(c("_lat"), c("_lon")))))
    out = out.withColumn("_p", F.sqrt(c("_x") * c("_x") + c("_y") * c("_y")))
    out = out.withColumn("_f", _first_turn(c("_z"), c("_p")))
    for _ in range(TURNS):
        out = out.withColumn("_f", _turned(c("_f"), c("_z"), c("_p")))
    # Degrees and back, as those who pass positions on have them.
    out = out.withColumns({"_f": F.radians(F.degrees("_f")), "_l": F.radians(F.degrees(F.atan2("_y", "_x"))) - math.radians(LON0)})
    out = out.withColumns({"_s": F.sin("_f"), "_c": F.cos("_f"), "_t": F.tan("_f")})
    out = out.withColumns(dict(zip(("_nu", "_rho"), _radii(c("_s")))))
    out = out.withColumns(dict(zip(("_e", "_n"), _series(c("_f"), c("_l"), c("_s"), c("_c"), c("_t"), c("_nu"), c("_rho")))))
    out = out.drop("_lat", "_lon", "_x", "_y", "_z", "_p", "_f", "_l", "_s", "_c", "_t", "_nu", "_rho")
    on = on_grid(c("_e"), c("_n"))
    return out.withColumns({v: F.when(on, c(v)) for v in ("_e", "_n")})


def assign_grid_refs(occ: DataFrame, system: str = "grid_ref_system", uncertainty: str = "coordinate_uncertainty") -> DataFrame:
    """Give records of other systems a reference of their position and uncertainty; keep the rest. The ref is null if none can be made."""
    c = F.col
    # A double is its own text's number.
    number = lambda name: c(name) if occ.schema[name].dataType == DoubleType() else nullable_float(c(name))
    out = occ.withColumn("_again", needs_regeneration(c(system)))
    out = with_position(out, F.when(c("_again"), number("latitude")), F.when(c("_again"), number("longitude")))
    out = out.withColumn("_u", F.when(c("_again"), nullable_float(c(uncertainty))))
    out = out.withColumn("_size", select_square_size(c("_u"), parsed=True)).withColumn("_ref", grid_ref(c("_e"), c("_n"), c("_size")))
    out = out.withColumn("_r", _plain_ref(c("_ref"))).withColumn("_digits", _ref_digits(c("_r")))
    fine = F.when(c("_ref").isNotNull(), F.coalesce(_tetrad_of(c("_r"), c("_digits"), True), F.lit("")))
    return out.withColumns({"grid_ref_2km": F.when(c("_again"), fine).otherwise(c("grid_ref_2km")), "grid_ref": F.when(c("_again"), c("_ref")).otherwise(c("grid_ref"))}).drop("_again", "_e", "_n", "_u", "_size", "_ref", "_r", "_digits")


# ---------------------------------------------------------------- regions


def parse_wkt_rings(wkt: Column) -> Column:
    """All rings of a polygon or multipolygon as arrays of (x, y)."""
    rings = F.regexp_extract_all(wkt, F.lit(r"\(([^()]+)\)"), 1)

    def point(text: Column) -> Column:
        xy = F.split(F.trim(text), r"\s+")
        return F.struct(F.get(xy, F.lit(0)).try_cast("double").alias("x"), F.get(xy, F.lit(1)).try_cast("double").alias("y"))

    parsed = F.transform(rings, lambda r: F.filter(F.transform(F.split(r, ","), point), lambda p: p["x"].isNotNull() & p["y"].isNotNull()))
    return F.filter(parsed, lambda r: F.size(r) >= 3)


def edges(rings: Column) -> Column:
    """The edges of all rings, (x1, y1, x2, y2), rings closed."""
    one = lambda r: F.zip_with(r, F.concat(F.slice(r, 2, F.size(r) - 1), F.slice(r, 1, 1)), lambda p, q: F.struct(p["x"].alias("x1"), p["y"].alias("y1"), q["x"].alias("x2"), q["y"].alias("y2")))
    return F.flatten(F.transform(rings, one))


def contains(e: Column, x: Column, y: Column) -> Column:
    """Even-odd over all rings, so holes are outside; a boundary is inside."""
    on = F.exists(e, lambda s: (F.abs((y - s["y1"]) * (s["x2"] - s["x1"]) - (x - s["x1"]) * (s["y2"] - s["y1"])) <= 1e-9) & x.between(F.least(s["x1"], s["x2"]), F.greatest(s["x1"], s["x2"])) & y.between(F.least(s["y1"], s["y2"]), F.greatest(s["y1"], s["y2"])))
    crossed = F.size(F.filter(e, lambda s: ((s["y1"] > y) != (s["y2"] > y)) & (x < (s["x2"] - s["x1"]) * (y - s["y1"]) / F.nullif(s["y2"] - s["y1"], F.lit(0.0)) + s["x1"])))
    return on | (crossed % 2 == 1)


#: An edge is looked for this far, in parts of a cell, beyond the cells that it passes through: more than any rounding.
MARGIN = 1e-6


def footprint_sides(regions: DataFrame) -> DataFrame:
    """geographic_region_id and s: an edge of the footprint of a region that is not deleted."""
    shape = regions.where("deleted_at is null and footprint_geometry is not null").select(F.col("id").alias("geographic_region_id"), parse_wkt_rings(F.col("footprint_geometry")).alias("rings"))
    return shape.select("geographic_region_id", F.explode(edges(F.col("rings"))).alias("s"))


def swept_rows(sides: DataFrame, size: Column) -> DataFrame:
    """``sides`` cut into rows of cells of ``size``: each region's row ``cy`` with ``es``, the edges that pass through it.

    Each edge (x1, y1, x2, y2) has its first and last cell in the row, ``c0`` and ``c1``. The columns
    of ``sides`` other than ``s`` tell the regions apart.
    """
    keys = [c for c in sides.columns if c != "s"]
    at = lambda v, more: F.floor(v / size + more).cast("long")
    rows = sides.withColumn("cy", F.explode(F.sequence(at(F.least("s.y1", "s.y2"), -MARGIN), at(F.greatest("s.y1", "s.y2"), MARGIN))))
    dx, dy = F.col("s.x2") - F.col("s.x1"), F.col("s.y2") - F.col("s.y1")
    # Where the edge enters and leaves the row, between 0 and 1 along it.
    t = lambda row: F.least(F.lit(1.0), F.greatest(F.lit(0.0), (row * size - F.col("s.y1")) / F.nullif(dy, F.lit(0.0))))
    level = dy == 0
    t0, t1 = F.when(level, 0.0).otherwise(t(F.col("cy") - MARGIN)), F.when(level, 1.0).otherwise(t(F.col("cy") + 1 + MARGIN))
    xa, xb = F.col("s.x1") + t0 * dx, F.col("s.x1") + t1 * dx
    e = F.struct("s.x1", "s.y1", "s.x2", "s.y2", at(F.least(xa, xb), -MARGIN).alias("c0"), at(F.greatest(xa, xb), MARGIN).alias("c1"))
    return rows.groupBy(*keys, "cy").agg(F.collect_list(e).alias("es"))


def row_cells(es: Column, size: Column, met: Callable[[Column, Column], Column], inside: Callable[[Column], Column]) -> Column:
    """The cells of a swept row: ``met(edges, cx)`` for each cell that an edge passes, ``inside(cx)`` for each other cell within the region.

    All cells of a gap between cells that edges pass lie on one side: one of them is tested.
    """
    y = (F.col("cy") + 0.5) * size

    def cells(e: Column, passed: Column) -> Column:
        own = F.transform(passed, lambda c: met(e, c))
        gaps = F.transform(F.sequence(F.lit(1), F.size(passed) - 1), lambda i: F.struct((F.get(passed, i - 1) + 1).alias("a"), (F.get(passed, i) - 1).alias("b")))
        gaps = F.filter(F.when(F.size(passed) > 1, gaps), lambda g: (g["a"] <= g["b"]) & contains(e, (g["a"] + 0.5) * size, y))
        rest = F.flatten(F.transform(gaps, lambda g: F.transform(F.sequence(g["a"], g["b"]), inside)))
        return F.concat(own, F.coalesce(rest, F.slice(own, 1, 0)))

    of = lambda e: F.array_sort(F.array_distinct(F.flatten(F.transform(e, lambda x: F.sequence(x["c0"], x["c1"])))))
    return let(es, lambda e: let(of(e), lambda passed: cells(e, passed)))


def region_cells(regions: DataFrame, cell: float = 0.1, most_cells: int = 10_000) -> tuple[DataFrame, DataFrame]:
    """(cells, rows): each region's cells (geographic_region_id, level, cx, cy, whole), and the edges ``es`` of each of its rows of cells.

    A ``whole`` cell lies inside the region and no edge passes it; of others an edge does. A region
    whose bounding box has more than ``most_cells`` cells has larger ones, by a power of two, its level.
    """
    sides = footprint_sides(regions)
    box = sides.groupBy("geographic_region_id").agg(F.min(F.least("s.x1", "s.x2")).alias("x0"), F.min(F.least("s.y1", "s.y2")).alias("y0"), F.max(F.greatest("s.x1", "s.x2")).alias("x9"), F.max(F.greatest("s.y1", "s.y2")).alias("y9"))
    span = (F.col("x9") - F.col("x0") + cell) * (F.col("y9") - F.col("y0") + cell)
    levels = box.select("geographic_region_id", F.greatest(F.lit(0), F.ceil(F.log2(span / (cell * cell) / most_cells) / 2)).cast("int").alias("level"))
    size = F.lit(cell) * F.pow(F.lit(2.0), F.col("level"))
    rows = settled(swept_rows(sides.join(levels, "geographic_region_id"), size))
    mark = lambda c, whole: F.struct(c.alias("cx"), F.lit(whole).alias("whole"))
    cells = rows.select("geographic_region_id", "level", "cy", F.explode(row_cells(F.col("es"), size, lambda es, c: mark(c, False), lambda c: mark(c, True))).alias("c"))
    return cells.select("geographic_region_id", "level", "c.cx", "cy", "c.whole"), rows


def assign_regions(occ: DataFrame, regions: DataFrame, cell: float = 0.1, most_cells: int = 10_000) -> DataFrame:
    """(geographic_region_id, occurrence_id) of active records within footprints of regions that are not deleted.

    Records meet the regions' cells in an equi-join that carries ids only. A record in a whole cell is
    inside without a further test; one in a cell that an edge passes is tested against the edges of its
    row of cells: no others can lie to its side. Both joins Spark may broadcast or split.
    """
    cells, rows = region_cells(regions, cell, most_cells)
    # The few levels in use: one row each.
    levels = [r["level"] for r in rows.select("level").distinct().collect()]
    at = lambda v: F.floor(v / (F.lit(cell) * F.pow(F.lit(2.0), F.col("level")))).cast("long")
    points = occ.where(is_active()).select(F.col("id").alias("occurrence_id"), F.col("longitude").cast("double").alias("px"), F.col("latitude").cast("double").alias("py")).where("px is not null and py is not null")
    points = points.withColumn("level", F.explode(F.lit(levels).cast("array<int>"))).withColumns({"cx": at(F.col("px")), "cy": at(F.col("py"))})
    near = points.join(cells, ["level", "cx", "cy"]).select("geographic_region_id", "cy", "occurrence_id", "px", "py", "whole")
    tested = near.where("not whole").join(rows.select("geographic_region_id", "cy", "es"), ["geographic_region_id", "cy"]).where(contains(F.col("es"), F.col("px"), F.col("py")))
    both = near.where("whole").select("geographic_region_id", "occurrence_id").unionByName(tested.select("geographic_region_id", "occurrence_id"))
    return both.distinct()


def reassign_regions(bridge: DataFrame, occ: DataFrame, regions: DataFrame, changed: DataFrame | None) -> DataFrame:
    """The bridge after the records in ``changed(occurrence_id)`` were assigned anew; None means all records."""
    if changed is None:
        return assign_regions(occ, regions)
    # Merge joins: a broadcast of the records of a large batch would pass through the driver.
    ids = changed.where("occurrence_id > 0").select("occurrence_id").distinct().hint("merge")
    fresh = assign_regions(occ.join(ids.withColumnRenamed("occurrence_id", "id"), "id", "left_semi"), regions)
    return bridge.join(ids, "occurrence_id", "left_anti").select("geographic_region_id", "occurrence_id").unionByName(fresh)


def _touches(s: Column, e: Column, n: Column, size: int, interior: bool) -> Column:
    """Does an edge touch the cell with this corner (or pass through its interior)? Its parts within the cell's columns and rows must overlap."""
    dx, dy = s["x2"] - s["x1"], s["y2"] - s["y1"]
    t = lambda p, d, v: (v - p) / F.nullif(d, F.lit(0.0))
    ax, bx = t(s["x1"], dx, e), t(s["x1"], dx, e + size)
    ay, by = t(s["y1"], dy, n), t(s["y1"], dy, n + size)
    inside = lambda p, low: (p > low) & (p < low + size) if interior else (p >= low) & (p <= low + size)
    inside_x = F.when(dx == 0, inside(s["x1"], e)).otherwise(True)
    inside_y = F.when(dy == 0, inside(s["y1"], n)).otherwise(True)
    start = F.greatest(F.lit(0.0), F.when(dx == 0, 0.0).otherwise(F.least(ax, bx)), F.when(dy == 0, 0.0).otherwise(F.least(ay, by)))
    stop = F.least(F.lit(1.0), F.when(dx == 0, 1.0).otherwise(F.greatest(ax, bx)), F.when(dy == 0, 1.0).otherwise(F.greatest(ay, by)))
    return inside_x & inside_y & ((start < stop) if interior else (start <= stop))


def fishnet_cells(regions: DataFrame, size: int = 2000) -> DataFrame:
    """Cells that a footprint meets: geographic_region_id, cx, cy, touched, cut, inside (the centre is).

    Edges are cut into rows of cells, and tested against the cells that they pass there; a cell that
    no edge passes is closed without a test of its own. So the work grows with the length of the
    boundary, and with the cells that are returned.
    """
    rows = swept_rows(footprint_sides(regions), F.lit(size))
    corner = lambda c: (c * size).cast("double")
    n = corner(F.col("cy"))

    def met(es: Column, c: Column) -> Column:
        own = lambda interior: F.exists(es, lambda s: (s["c0"] <= c) & (s["c1"] >= c) & _touches(s, corner(c), n, size, interior))
        return F.struct(c.alias("cx"), own(False).alias("touched"), own(True).alias("cut"), contains(es, corner(c) + size / 2, n + size / 2).alias("inside"))

    closed = lambda c: F.struct(c.alias("cx"), F.lit(False).alias("touched"), F.lit(False).alias("cut"), F.lit(True).alias("inside"))
    cells = rows.select("geographic_region_id", "cy", F.explode(row_cells(F.col("es"), F.lit(size), met, closed)).alias("c"))
    return cells.select("geographic_region_id", "c.cx", "cy", "c.touched", "c.cut", "c.inside").where("touched or inside")


def fishnet(regions: DataFrame, size: int = 2000) -> DataFrame:
    """Squares of this size that meet a region's footprint (in grid metres): region, square, centre on the grid and in WGS84, partial.

    A cell meets the region if an edge touches it or its centre is inside; it is partial unless inside
    with no edge through its interior.
    """
    centre = lambda c: F.col(c) * size + size / 2
    met = fishnet_cells(regions, size).select("geographic_region_id", centre("cx").alias("centre_easting"), centre("cy").alias("centre_northing"), (F.col("cut") | ~F.col("inside")).cast("int").alias("partial"))
    placed = met.withColumn("at", grid_to_wgs84(F.col("centre_easting"), F.col("centre_northing")))
    return placed.select("geographic_region_id", tetrad(F.col("centre_easting"), F.col("centre_northing")).alias("square"), F.col("centre_easting").cast("int").alias("centre_easting"), F.col("centre_northing").cast("int").alias("centre_northing"), F.col("at.la").alias("centre_lat"), F.col("at.lo").alias("centre_lon"), "partial")
