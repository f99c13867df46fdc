"""Geometry, rasterisation, point location and overlay on the stand-in polygons."""

from __future__ import annotations


from pyspark.sql import functions as F

from zonemill.functions import space as S
from zonemill.operators import fragments as FR
from zonemill.operators import geometry as GE
from zonemill.operators import raster as RA
from zonemill.operators import zonal as Z
from zonemill.plans import standins as V
from zonemill.session import spread
from zonemill.plans.pixels import sub, weights_sql
from zonemill.plans.registry import query
from zonemill.plans.standins import r6, sql

LONLAT = "SELECT c_custkey AS id, 2.5E0 + c_custkey % 37 * 0.1E0 AS lon, 49.5E0 + c_acctbal / 10000.0E0 AS lat FROM customer"


def lonlat(spark, d):
    return V.table(spark, d, "customer").select(F.col("c_custkey").alias("id"), (2.5 + F.col("c_custkey") % 37 * 0.1).alias("lon"),
                                                (49.5 + F.col("c_acctbal") / 10000.0).alias("lat"))


@query("g01_mercator", f"""
WITH p AS ({LONLAT}), m AS (SELECT *, 6378137.0E0 * lon * pi() / 180.0E0 AS x, 6378137.0E0 * ln(tan(pi() / 4.0E0 + lat * pi() / 360.0E0)) AS y FROM p)
SELECT id, floor(x * 1000.0E0 + 0.5E0) / 1000.0E0 AS x_m, floor(y * 1000.0E0 + 0.5E0) / 1000.0E0 AS y_m, {r6('lon')} AS lon_back, {r6('lat')} AS lat_back FROM m""")
def g01(spark, d):
    from zonemill.functions.numbers import half_up
    x, y = S.to_mercator(F.col("lon"), F.col("lat"))
    lon, lat = S.from_mercator(x, y)
    return lonlat(spark, d).select("id", half_up(x, 3).alias("x_m"), half_up(y, 3).alias("y_m"), lon.alias("lon_back"), lat.alias("lat_back"))


@query("g02_project_points", f"""
SELECT id, {r6('lon')} AS lon_back, {r6('lat')} AS lat_back, true AS plausible FROM ({LONLAT})""")
def g02(spark, d):
    """UTM there and back; the equal-area and conformal coordinates must lie in their national ranges."""
    x, y = S.utm(F.col("lon"), F.col("lat"), 31)
    ex, ey = S.equal_area_europe(F.col("lon"), F.col("lat"))
    bx, by = S.lambert_belgium(F.col("lon"), F.col("lat"))
    there = lonlat(spark, d).select("id", x.alias("x"), y.alias("y"), ex.alias("ex"), ey.alias("ey"), bx.alias("bx"), by.alias("by"))
    lon, lat = S.from_utm(F.col("x"), F.col("y"), 31)
    ok = (F.col("ex").between(3.7e6, 4.1e6) & F.col("ey").between(2.9e6, 3.2e6)
          & F.col("bx").between(5e5, 8.5e5) & F.col("by").between(5e5, 8e5))
    return there.select("id", lon.alias("lon_back"), lat.alias("lat_back"), ok.alias("plausible"))


def g02_sql() -> str:
    """The closed forward formulas of both national systems in SQL, with the constants worked out here."""
    import math
    e2 = (1 / 298.257222101) * (2 - 1 / 298.257222101)
    e, a, lat0 = math.sqrt(e2), 6378137.0, math.radians(52)
    qn = lambda s: (1 - e2) * (s / (1 - e2 * s * s) - math.log((1 - e * s) / (1 + e * s)) / (2 * e))
    qp = qn(1.0)
    b0, rq = math.asin(qn(math.sin(lat0)) / qp), a * math.sqrt(qp / 2)
    d = a * math.cos(lat0) / math.sqrt(1 - e2 * math.sin(lat0) ** 2) / (rq * math.cos(b0))
    m = lambda p: math.cos(p) / math.sqrt(1 - e2 * math.sin(p) ** 2)
    t = lambda p: math.tan(math.pi / 4 - p / 2) / ((1 - e * math.sin(p)) / (1 + e * math.sin(p))) ** (e / 2)
    p1, p2, p0, l0 = math.radians(49 + 50 / 60), math.radians(51 + 10 / 60), math.radians(50 + 47 / 60 + 52.134 / 3600), 4 + 21 / 60 + 33.177 / 3600
    n = (math.log(m(p1)) - math.log(m(p2))) / (math.log(t(p1)) - math.log(t(p2)))
    f = m(p1) / (n * t(p1) ** n)
    num = lambda v: f"{v!r}::DOUBLE"
    mm = lambda x: f"floor(({x}) * 1000.0E0 + 0.5E0) / 1000.0E0"
    return f"""WITH p AS ({LONLAT}), s AS (SELECT *, sin(radians(lat)) AS s, radians(lon - 10) AS dl, radians(lon - {num(l0)}) AS db FROM p),
q AS (SELECT *, asin({num((1 - e2) / qp)} * (s / (1 - {num(e2)} * s * s) - ln((1 - {num(e)} * s) / (1 + {num(e)} * s)) / {num(2 * e)})) AS be,
  {num(a * f)} * pow(tan(pi() / 4 - radians(lat) / 2) / pow((1 - {num(e)} * s) / (1 + {num(e)} * s), {num(e / 2)}), {num(n)}) AS rho FROM s),
k AS (SELECT *, {num(rq)} * sqrt(2 / (1 + {num(math.sin(b0))} * sin(be) + {num(math.cos(b0))} * cos(be) * cos(dl))) AS b FROM q)
SELECT id, {mm(f"b * {num(d)} * cos(be) * sin(dl) + 4321000")} AS ex, {mm(f"b / {num(d)} * ({num(math.cos(b0))} * sin(be) - {num(math.sin(b0))} * cos(be) * cos(dl)) + 3210000")} AS ey,
  {mm(f"649328 + rho * sin({num(n)} * db)")} AS bx, {mm(f"665262 + {num(a * f * t(p0) ** n)} - rho * cos({num(n)} * db)")} AS by,
  {r6('lon')} AS lon_e, {r6('lat')} AS lat_e, {r6('lon')} AS lon_b, {r6('lat')} AS lat_b FROM k"""


@query("g02_national_systems", g02_sql())
def g02b(spark, d):
    """Equal-area and Belgian coordinates to the millimetre, and back to degrees."""
    from zonemill.functions.numbers import half_up
    ex, ey = S.equal_area_europe(F.col("lon"), F.col("lat"))
    bx, by = S.lambert_belgium(F.col("lon"), F.col("lat"))
    there = lonlat(spark, d).select("id", ex.alias("ex"), ey.alias("ey"), bx.alias("bx"), by.alias("by"))
    (lon_e, lat_e), (lon_b, lat_b) = S.from_equal_area_europe(F.col("ex"), F.col("ey")), S.from_lambert_belgium(F.col("bx"), F.col("by"))
    return there.select("id", *[half_up(F.col(c), 3).alias(c) for c in ("ex", "ey", "bx", "by")], lon_e.alias("lon_e"), lat_e.alias("lat_e"),
                        lon_b.alias("lon_b"), lat_b.alias("lat_b"))


@query("g03_normalise_geom", sql("poly", "SELECT poly_id, 1 AS n_polygons, 5 AS n_vertices, 2.0E0 * r * r AS area FROM poly"))
def g03(spark, d):
    """Diamonds with an open ring, a degenerate hole and a degenerate second polygon come out clean."""
    ring = F.col("geom")[0][0]
    messy = F.array(F.array(F.slice(ring, 1, 4), F.slice(ring, 1, 2)), F.array(F.slice(ring, 1, 2)))
    clean = GE.normalise_geom(messy)
    return V.diamond_polygons(spark, d).select("poly_id", F.size(clean).alias("n_polygons"), GE.count_vertices(clean).alias("n_vertices"),
                                               GE.polygon_area(clean).alias("area"))


SPANS = """SELECT poly_id, sr AS row_i, CAST(greatest(0, cx - r + ceil(abs(sr + 0.5E0 - cy) - 0.5E0)) AS BIGINT) AS c0,
  CAST(least(99, cx + r + floor(-abs(sr + 0.5E0 - cy) - 0.5E0)) AS BIGINT) AS c1
  FROM poly, unnest(generate_series(CAST(greatest(0, cy - r) AS BIGINT), CAST(least(99, cy + r - 1) AS BIGINT))) AS a(sr)"""


@query("g04_rasterize", sql("poly", f"SELECT * FROM ({SPANS}) WHERE c0 <= c1"))
def g04(spark, d):
    return GE.rasterize(V.diamond_polygons(spark, d), ["poly_id"], V.GRID)


@query("g05_fractional_weights", sql("poly", weights_sql(10)))
def g05(spark, d):
    return GE.fractional_weights(V.diamond_polygons(spark, d), ["poly_id"], V.GRID, 10)


def last(scale, value="class_code + 1"):
    return f"SELECT sub_row, sub_col, arg_max({value}, poly_id) AS v FROM ({sub(scale)}) GROUP BY sub_row, sub_col"


def votes(scale, value="class_code + 1"):
    return f"""SELECT CAST(floor(sub_row / {scale}.0E0) AS BIGINT) AS row_i, CAST(floor(sub_col / {scale}.0E0) AS BIGINT) AS col_i, v, count(*) AS votes
  FROM ({last(scale, value)}) WHERE v <> 0 GROUP BY ALL"""


def classed(spark, d):
    return V.diamond_polygons(spark, d).withColumn("v", F.col("class_code") + 1)


def cell_votes(spark, d, scale):
    return GE.subpixel_votes(GE.last_feature(classed(spark, d), V.GRID, scale, "v", "poly_id"), scale, "v")


@query("g06_grid_majority", sql("poly", f"""
WITH t AS (SELECT *, max(votes) OVER (PARTITION BY row_i, col_i) AS top FROM ({votes(6)}))
SELECT row_i, col_i, CASE WHEN max(top) >= 18 AND count(*) FILTER (votes = top) = 1 THEN max(v) FILTER (votes = top) ELSE 0 END AS v FROM t GROUP BY row_i, col_i"""))
def g06(spark, d):
    return GE.grid_majority(classed(spark, d), V.GRID, "v", "poly_id", 6, 18)


@query("g07_polygon_area", sql("poly", f"SELECT poly_id, 2.0E0 * r * r - 1.0E0 AS area, {r6('(2.0E0 * r * r - 1.0E0) / 10000')} AS area_ha FROM poly"))
def g07(spark, d):
    """Diamonds with a unit square cut out of their middle."""
    cx, cy = (F.element_at(F.col("geom")[0][0], 2)["x"], F.element_at(F.col("geom")[0][0], 1)["y"])
    hole = F.array(*[F.struct((cx + a).alias("x"), (cy + b).alias("y")) for a, b in ((-.5, -.5), (.5, -.5), (.5, .5), (-.5, .5), (-.5, -.5))])
    area = GE.polygon_area(F.array(F.array(F.col("geom")[0][0], hole)))
    return V.diamond_polygons(spark, d).select("poly_id", area.alias("area"), (area / 10000.0).alias("area_ha"))


@query("g08_bounds", sql("poly", """
SELECT poly_id, (cx - r) * 1.0E0 AS x0, (cy - r) * 1.0E0 AS y0, (cx + r) * 1.0E0 AS x1, (cy + r) * 1.0E0 AS y1,
  CASE WHEN cx - r <= 50 AND cx + r >= 20 AND cy - r <= 60 AND cy + r >= 10 THEN 1 ELSE 0 END AS kept FROM poly"""))
def g08(spark, d):
    b = GE.geom_bounds(F.col("geom"))
    return V.diamond_polygons(spark, d).select("poly_id", *[b[c].alias(c) for c in ("x0", "y0", "x1", "y1")],
                                               F.size(GE.subset_rings(F.col("geom"), 20.0, 10.0, 50.0, 60.0)).alias("kept"))


@query("g12_circular_kernel", sql("poly", """
WITH k AS (SELECT poly_id, r * 5.0E0 AS radius, i AS dr, j AS dc FROM poly, unnest(generate_series(-CAST(ceil(r / 2.0E0) AS BIGINT), CAST(ceil(r / 2.0E0) AS BIGINT))) a(i),
  unnest(generate_series(-CAST(ceil(r / 2.0E0) AS BIGINT), CAST(ceil(r / 2.0E0) AS BIGINT))) b(j)),
s AS (SELECT poly_id, radius, dr, dc, (dr + (p + 0.5E0) / 4 - 0.5E0) * 10 AS y, (dc + (q + 0.5E0) / 4 - 0.5E0) * 10 AS x FROM k, generate_series(0, 3) c(p), generate_series(0, 3) e(q))
SELECT poly_id, dr, dc, count(*) FILTER (x * x + y * y <= radius * radius) / 16.0E0 AS w FROM s GROUP BY poly_id, dr, dc HAVING w > 0"""))
def g12(spark, d):
    """A kernel per polygon: the circle of half its radius on 10 m cells."""
    circles = V.diamonds(spark, d).select("poly_id", (F.col("r") * 5.0).alias("radius"))
    return RA.kernel_cells(circles, "radius", 10.0, 4).select("poly_id", "dr", "dc", "w")


@query("g13_circle_polygon", f"""
WITH c AS (SELECT id, i, lon + 100.0E0 / 111320.0E0 / cos(radians(lat)) * cos(i * (2 * pi() / 64)) AS x, lat + 100.0E0 / 111320.0E0 * sin(i * (2 * pi() / 64)) AS y
  FROM ({LONLAT}), generate_series(0, 64) t(i))
SELECT id, count(*)::INT AS n_points, {r6('min(x)')} AS west, {r6('max(x)')} AS east, {r6('min(y)')} AS south, {r6('max(y)')} AS north FROM c GROUP BY id""")
def g13(spark, d):
    ring = GE.circle_polygon(F.col("lon"), F.col("lat"), 100.0)
    b = GE.ring_bounds(F.col("ring"))
    return lonlat(spark, d).withColumn("ring", ring).select("id", F.size("ring").alias("n_points"), b["x0"].alias("west"), b["x1"].alias("east"),
                                                            b["y0"].alias("south"), b["y1"].alias("north"))


@query("g14_make_grid", f"""
WITH b AS (SELECT min(lon) AS w, max(lon) AS e, min(lat) AS s, max(lat) AS n FROM ({LONLAT})),
m AS (SELECT 6378137.0E0 * radians(w) AS x0, 6378137.0E0 * radians(e) AS x1, 6378137.0E0 * ln(tan(pi() / 4 + radians(s) / 2)) AS y0,
  6378137.0E0 * ln(tan(pi() / 4 + radians(n) / 2)) AS y1, 30.0E0 / cos(radians((s + n) / 2)) AS step FROM b)
SELECT CAST(ceil((x1 - x0) / step) AS BIGINT) AS width, CAST(ceil((y1 - y0) / step) AS BIGINT) AS height FROM m""")
def g14(spark, d):
    b = lonlat(spark, d).agg(F.min("lon").alias("w"), F.min("lat").alias("s"), F.max("lon").alias("e"), F.max("lat").alias("n"))
    width, height = S.mercator_grid_size(F.col("w"), F.col("s"), F.col("e"), F.col("n"), 30.0)
    return b.select(width.alias("width"), height.alias("height"))


@query("g15_missing_rectangles", sql("poly", """
WITH b AS (SELECT poly_id, (cx - r) * 1.0E0 AS x0, (cy - r) * 1.0E0 AS y0, (cx + r) * 1.0E0 AS x1, (cy + r) * 1.0E0 AS y1 FROM poly),
r AS (SELECT poly_id, 'above' AS side, x0 AS a, greatest(70, y0) AS b, x1 AS c, y1 AS d FROM b
UNION ALL SELECT poly_id, 'below', x0, y0, x1, least(30, y1) FROM b
UNION ALL SELECT poly_id, 'left', x0, greatest(y0, 30), least(30, x1), least(y1, 70) FROM b
UNION ALL SELECT poly_id, 'right', greatest(70, x0), greatest(y0, 30), x1, least(y1, 70) FROM b)
SELECT poly_id, side, a AS x0, b AS y0, c AS x1, d AS y1 FROM r WHERE c > a AND d > b"""))
def g15(spark, d):
    b = GE.geom_bounds(F.col("geom"))
    parts = GE.missing_rectangles([F.lit(30.0), F.lit(30.0), F.lit(70.0), F.lit(70.0)], [b["x0"], b["y0"], b["x1"], b["y1"]])
    return V.diamond_polygons(spark, d).select("poly_id", F.inline(parts))


@query("g17_scope_index", sql("zone", """
SELECT municipality, r AS row_i, count(*) AS n, min(c) AS first_col FROM zone, unnest(generate_series(r0, r1 - 1)) a(r), unnest(generate_series(c0, c1 - 1)) b(c) GROUP BY municipality, r""".replace(
    "r AS row_i", "CAST(r AS BIGINT) AS row_i").replace("min(c)", "CAST(min(c) AS BIGINT)")))
def g17(spark, d):
    index = GE.scope_index(V.zone_polygons(spark, d), V.GRID, ["sector_id", "municipality"])
    return index.groupBy("municipality", "row_i").agg(F.count("*").alias("n"), F.min("col_i").alias("first_col"))


@query("j07_assign_zone", sql("px poly", """
SELECT obs_id, poly_id, count(*) AS n, CAST(sum(code) AS BIGINT) AS code_sum FROM (SELECT obs_id, row_i, col_i, code, max(poly_id) AS poly_id
  FROM px JOIN poly ON abs(col_i + 0.5E0 - cx) + abs(row_i + 0.5E0 - cy) <= r GROUP BY obs_id, row_i, col_i, code) GROUP BY obs_id, poly_id"""))
def j07(spark, d):
    """Overlapping diamonds: a pixel belongs to the last one that covers its centre."""
    spans = GE.rasterize(V.diamond_polygons(spark, d), ["poly_id"], V.GRID)
    located = Z.assign_zone(V.pixels(spark, d).select("obs_id", "row_i", "col_i", "code"), spans)
    return located.groupBy("obs_id", "poly_id").agg(F.count("*").alias("n"), F.sum("code").alias("code_sum"))


@query("j07_shared_borders", sql("px zone", """
SELECT obs_id, sector_id, count(*) AS n FROM (SELECT obs_id, row_i, col_i, max(sector_id) AS sector_id FROM px JOIN zone ON row_i >= r0 AND row_i < r1 AND col_i >= c0 AND col_i <= c1
  GROUP BY obs_id, row_i, col_i) GROUP BY obs_id, sector_id"""))
def j07b(spark, d):
    """Zones of two parts each whose borders run through cell centres: every pixel counts once."""
    def part(left, right):
        ring = F.array(*[F.struct(x.cast("double").alias("x"), F.col(y).cast("double").alias("y")) for x, y in ((left, "r0"), (right, "r0"), (right, "r1"), (left, "r1"), (left, "r0"))])
        return F.array(ring)
    low, middle, high = F.col("c0") + 0.5, F.col("c0") + 10.5, F.col("c1") + 0.5
    zones = V.zones(spark, d).select("sector_id", F.array(part(low, middle), part(middle, high)).alias("geom"))
    located = Z.assign_zone(V.pixels(spark, d).select("obs_id", "row_i", "col_i"), GE.rasterize(zones, ["sector_id"], V.GRID))
    return located.groupBy("obs_id", "sector_id").agg(F.count("*").alias("n"))


POINTS = "SELECT o_orderkey AS id, CAST(floor(o_orderkey / 10000.0E0) AS BIGINT) AS obs_id, o_totalprice / 5000.0E0 AS x, (o_custkey % 1000) / 10.0E0 + 0.03E0 AS y FROM orders"


def points(spark, d):
    return V.table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), (F.col("o_totalprice") / 5000.0).alias("x"),
                                              ((F.col("o_custkey") % 1000) / 10.0 + 0.03).alias("y"))


@query("j08_points_in_polygons", sql("poly", f"""
WITH p AS ({POINTS}), e AS (SELECT poly_id, cx + r AS x1, cy AS y1, cx AS x2, cy + r AS y2 FROM poly UNION ALL SELECT poly_id, cx, cy + r, cx - r, cy FROM poly
  UNION ALL SELECT poly_id, cx - r, cy, cx, cy - r FROM poly UNION ALL SELECT poly_id, cx, cy - r, cx + r, cy FROM poly)
SELECT id, poly_id FROM p JOIN e ON (y1 > y) <> (y2 > y) AND x < CAST(x2 - x1 AS DOUBLE) * (y - y1) / (y2 - y1) + x1 GROUP BY id, poly_id HAVING count(*) % 2 = 1"""))
def j08(spark, d):
    return GE.points_in_polygons(spread(points(spark, d)), V.diamond_polygons(spark, d), "poly_id", 5.0).select("id", "poly_id")


OVERLAY = """e1 AS (SELECT poly_id, cx + r AS x1, cy AS y1, cx AS x2, cy + r AS y2 FROM poly UNION ALL SELECT poly_id, cx, cy + r, cx - r, cy FROM poly
  UNION ALL SELECT poly_id, cx - r, cy, cx, cy - r FROM poly UNION ALL SELECT poly_id, cx, cy - r, cx + r, cy FROM poly),
e2 AS (SELECT sector_id, c0 AS x1, r0 AS y1, c1 AS x2, r0 AS y2 FROM zone UNION ALL SELECT sector_id, c1, r1, c0, r1 FROM zone),
j AS (SELECT poly_id, sector_id, sign(e1.x1 - e1.x2) * sign(e2.x1 - e2.x2) AS s, greatest(least(e1.x1, e1.x2), least(e2.x1, e2.x2)) AS lo,
  least(greatest(e1.x1, e1.x2), greatest(e2.x1, e2.x2)) AS hi, e1.x1 AS ax, e1.y1 AS ay, CAST(e1.y2 - e1.y1 AS DOUBLE) / (e1.x2 - e1.x1) AS am, e2.y1 AS b
  FROM e1 JOIN e2 ON greatest(least(e1.x1, e1.x2), least(e2.x1, e2.x2)) < least(greatest(e1.x1, e1.x2), greatest(e2.x1, e2.x2))),
k AS (SELECT *, ay + (lo - ax) * am - b AS dl, ay + (hi - ax) * am - b AS dh, hi - lo AS w FROM j),
o AS (SELECT poly_id, sector_id, -0.5E0 * sum(s * CASE WHEN dl * dh >= 0 THEN w * (abs(dl) + abs(dh)) / 2 ELSE w * (dl * dl + dh * dh) / (2 * (abs(dl) + abs(dh))) END) AS area
  FROM k GROUP BY poly_id, sector_id HAVING area > 0.001)"""


def overlay(spark, d):
    return GE.overlay_area(V.diamond_polygons(spark, d), V.zone_polygons(spark, d), "poly_id", "sector_id", 16.0, 7.0)


@query("j09_overlay_area", sql("poly zone", f"WITH {OVERLAY} SELECT poly_id, sector_id, {r6('area')} AS area FROM o"))
def j09(spark, d):
    return overlay(spark, d)


@query("j09_overlay_fragments", sql("poly zone", f"WITH {OVERLAY} SELECT poly_id, sector_id, {r6('area')} AS area, 1 AS n_polygons, 0 AS n_holes FROM o"))
def j09c(spark, d):
    """Areas measured on the clipped shapes; parts of convex shapes are one polygon without holes."""
    parts = FR.overlay_fragments(V.diamond_polygons(spark, d), V.zone_polygons(spark, d), "poly_id", "sector_id", 16.0, 7.0)
    holes = F.aggregate("geom", F.lit(0), lambda n, polygon: n + F.size(polygon) - 1)
    return parts.select("poly_id", "sector_id", GE.polygon_area(F.col("geom")).alias("area"), F.size("geom").alias("n_polygons"), holes.alias("n_holes"))


@query("j09_class_overlay", sql("poly zone", f"""WITH {OVERLAY}
SELECT sector_id, class_code, {r6('sum(area)')} AS area_m2, count(*) AS n_fragments FROM o JOIN poly USING (poly_id) GROUP BY sector_id, class_code"""))
def j09b(spark, d):
    classes = V.diamonds(spark, d).select("poly_id", "class_code")
    return (overlay(spark, d).join(classes, "poly_id").groupBy("sector_id", "class_code")
            .agg(F.sum("area").alias("area_m2"), F.count("*").alias("n_fragments")))


@query("j12_sample_points", sql("px", f"""
WITH p AS ({POINTS.replace('5000.0E0', '4000.0E0')}), c AS (SELECT *, CASE WHEN x < 100 AND y < 100 THEN CAST(floor(y) AS BIGINT) END AS row_i,
  CASE WHEN x < 100 AND y < 100 THEN CAST(floor(x) AS BIGINT) END AS col_i FROM p)
SELECT id, CASE WHEN row_i IS NULL THEN 'outside' WHEN status = 1 THEN 'clear' WHEN status = 2 THEN 'cloud' ELSE 'missing' END AS status,
  {r6('CASE WHEN status = 1 THEN temp_c END')} AS value FROM c LEFT JOIN px q USING (obs_id, row_i, col_i)"""))
def j12(spark, d):
    from zonemill.operators.sampling import sample_points
    pts = V.table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.floor(F.col("o_orderkey") / 10000.0).alias("obs_id"), (F.col("o_totalprice") / 4000.0).alias("x"),
                                             ((F.col("o_custkey") % 1000) / 10.0 + 0.03).alias("y"))
    return sample_points(pts, V.pixels(spark, d), V.GRID, "temp_c", keys=("obs_id",)).select("id", "status", "value")


@query("w07_dominant_subpixel", sql("poly", f"""
SELECT row_i, col_i, v, votes FROM (SELECT *, row_number() OVER (PARTITION BY row_i, col_i ORDER BY votes DESC, v) AS rn FROM ({votes(3)})) WHERE rn = 1"""))
def w07(spark, d):
    return GE.dominant_subpixel(cell_votes(spark, d, 3), "v")


@query("w07_subpixel_votes", sql("poly", f"""
SELECT row_i, col_i, string_agg(v::VARCHAR, ',' ORDER BY votes DESC, v) AS ranking, string_agg(votes::VARCHAR, ',' ORDER BY votes DESC, v) AS votes FROM ({votes(3)}) GROUP BY row_i, col_i"""))
def w07b(spark, d):
    ranked = GE.ranked_votes(cell_votes(spark, d, 3), "v")
    return ranked.select("row_i", "col_i", *[F.array_join(F.col(c).cast("array<string>"), ",").alias(c) for c in ("ranking", "votes")])


@query("w08_unique_majority", sql("poly", f"""
WITH t AS (SELECT *, max(votes) OVER (PARTITION BY row_i, col_i) AS top FROM ({votes(3)}))
SELECT row_i, col_i, CASE WHEN max(top) >= 5 AND count(*) FILTER (votes = top) = 1 THEN max(v) FILTER (votes = top) ELSE 0 END AS v FROM t GROUP BY row_i, col_i"""))
def w08(spark, d):
    return GE.unique_majority(cell_votes(spark, d, 3), "v", 5)


@query("t04_last_feature", sql("poly", last(3).replace("GROUP BY", "GROUP BY")))
def t04b(spark, d):
    return GE.last_feature(classed(spark, d), V.GRID, 3, "v", "poly_id")


