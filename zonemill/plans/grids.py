"""Block fractions, resampling, focal density and vegetation on the stand-in grid."""

from __future__ import annotations

from pyspark.sql import functions as F

from zonemill.functions import numbers as N
from zonemill.functions import pixels as P
from zonemill.functions import space as S
from zonemill.model import EARTH_RADIUS_M, Grid
from zonemill.operators import geometry as GE
from zonemill.operators import raster as RA
from zonemill.operators import rollups as R
from zonemill.operators import sampling as SA
from zonemill.operators import tables as TB
from zonemill.operators import zonal as Z
from zonemill.plans import standins as V
from zonemill.plans.geometry import cell_votes, votes
from zonemill.plans.pixels import NDVI, sub, observations
from zonemill.plans.registry import query
from zonemill.plans.standins import r6, sql


@query("s05_explode_tiles", sql("px", "SELECT obs_id, row_i, col_i, code FROM px"))
def s05(spark, d):
    tiles = RA.assemble_tiles(V.pixels(spark, d), 16, "code")
    return RA.explode_tiles(tiles, 16, "code")


@query("s06_assemble_tiles", sql("px", """
SELECT obs_id, CAST(floor(row_i / 32.0E0) AS BIGINT) AS tile_row, CAST(floor(col_i / 32.0E0) AS BIGINT) AS tile_col, count(*)::INT AS n,
  string_agg(code::VARCHAR, '' ORDER BY row_i, col_i) AS codes FROM px GROUP BY ALL"""))
def s06(spark, d):
    tiles = RA.assemble_tiles(V.pixels(spark, d), 32, "code")
    return tiles.select("obs_id", "tile_row", "tile_col", F.size("payload").alias("n"),
                        F.array_join(F.transform("payload", lambda p: p["v"].cast("string")), "").alias("codes"))


FRACTIONS = """SELECT obs_id, CAST(floor(row_i / 2.0E0) AS BIGINT) AS row_i, CAST(floor(col_i / 2.0E0) AS BIGINT) AS col_i,
  count(*) FILTER (code = 1) / 4.0E0 AS f_1, count(*) FILTER (code = 2) / 4.0E0 AS f_2, count(*) FILTER (code IN (1, 2)) / 4.0E0 AS valid FROM px GROUP BY ALL"""


@query("a23_fraction_grid", sql("px", FRACTIONS))
def a23(spark, d):
    return RA.fraction_grid(V.pixels(spark, d), [1, 2], 2)


# Focal density: a circle of 4 cells on the full grid. Every second event type counts as present.
KERNEL = RA.circular_kernel(40.0, 10.0, 8)
PLANE = """SELECT obs_id, row_i, col_i, CASE WHEN code = 1 THEN 1.0E0 ELSE 0 END AS f_1, CASE WHEN code IN (2, 3) THEN 1.0E0 ELSE 0 END AS f_2,
  CASE WHEN data_mask = 1 THEN 1.0E0 ELSE 0.4E0 END AS valid FROM px"""
KERNEL_SQL = """k AS (SELECT i AS dr, j AS dc, (SELECT count(*) FILTER (power(((i + (p + 0.5E0) / 8 - 0.5E0) * 10), 2) + power(((j + (q + 0.5E0) / 8 - 0.5E0) * 10), 2) <= 1600) / 64.0E0
  FROM generate_series(0, 7) c(p), generate_series(0, 7) e(q)) AS w FROM generate_series(-4, 4) a(i), generate_series(-4, 4) b(j))"""
FOCAL = f"""{KERNEL_SQL}, t AS (SELECT sum(w) AS total FROM k), v AS ({PLANE}),
s AS (SELECT v.obs_id, v.row_i - dr AS row_i, v.col_i - dc AS col_i, sum(w * f_1) AS s1, sum(w * f_2) AS s2, sum(w * valid) AS sv FROM v, k WHERE w > 0 GROUP BY ALL),
f AS (SELECT s.obs_id, s.row_i, s.col_i, CASE WHEN sv / total >= 0.9E0 - 1e-12 THEN s1 / total * 100 END AS pct_1,
  CASE WHEN sv / total >= 0.9E0 - 1e-12 THEN s2 / total * 100 END AS pct_2, CASE WHEN sv / total >= 0.9E0 - 1e-12 THEN least(100, sv / total * 100) END AS coverage_pct
  FROM s JOIN v USING (obs_id, row_i, col_i), t)"""


def focal(spark, d):
    code = F.col("code")
    plane = V.pixels(spark, d).select("obs_id", "row_i", "col_i", F.when(code == 1, 1.0).otherwise(0.0).alias("f_1"),
                                      F.when(code.isin(2, 3), 1.0).otherwise(0.0).alias("f_2"), F.when(F.col("data_mask") == 1, 1.0).otherwise(0.4).alias("valid"))
    return RA.focal_density(plane, [1, 2], KERNEL, tile=40, threshold=0.9)


@query("a24_focal_density", sql("px", f"""
WITH {FOCAL} SELECT obs_id, row_i, col_i, {r6('pct_1')} AS pct_1, {r6('pct_2')} AS pct_2, {r6('coverage_pct')} AS coverage_pct FROM f"""))
def a24(spark, d):
    return focal(spark, d)


@query("a24_encoded_bands", sql("px", f"""
WITH {FOCAL} SELECT obs_id, count(*) AS n, count(*) FILTER (pct_1 IS NULL) AS n_no_data,
  sum(CASE WHEN pct_1 IS NULL THEN 0 ELSE CAST(round_even(CAST(pct_1 AS FLOAT) * 100::FLOAT, 0) AS BIGINT) END)::BIGINT AS checksum FROM f GROUP BY obs_id"""))
def a24b(spark, d):
    e = N.encode_percentage(F.col("pct_1"))
    return (focal(spark, d).withColumn("e", e).groupBy("obs_id").agg(
        F.count("*").alias("n"), F.count_if(F.col("e") == 65535).alias("n_no_data"), F.sum(F.when(F.col("e") != 65535, F.col("e")).otherwise(0)).alias("checksum")))


CIRCLE_HA = 3.14159


@query("j13_sample_density", sql("px zone", f"""
WITH {FOCAL}, p AS (SELECT event_id AS id, CAST(floor(event_id / 10000.0E0) AS BIGINT) AS obs_id, (event_id * 7919 % 1200) / 10.0E0 AS x, (event_id * 104729 % 1000) / 10.0E0 AS y FROM events),
pc AS (SELECT id, obs_id, CASE WHEN x < 100 THEN CAST(floor(y) AS BIGINT) END AS row_i, CASE WHEN x < 100 THEN CAST(floor(x) AS BIGINT) END AS col_i FROM p),
ps AS (SELECT pc.*, z.sector_id FROM pc LEFT JOIN zone z ON row_i >= r0 AND row_i < r1 AND col_i >= c0 AND col_i < c1 AND municipality = 'ASIA'),
q AS (SELECT ps.id, ps.sector_id, CASE WHEN pct_1 IS NOT NULL THEN least(100, pct_1 + pct_2) END AS pct, coverage_pct FROM ps LEFT JOIN f USING (obs_id, row_i, col_i))
SELECT id, CASE WHEN sector_id IS NULL THEN 'outside' WHEN pct IS NULL THEN 'unavailable' ELSE 'available' END AS status,
  {r6('CASE WHEN sector_id IS NOT NULL THEN pct END')} AS pct, {r6(f'CASE WHEN sector_id IS NOT NULL THEN pct / 100 * {CIRCLE_HA}E0 END')} AS area_ha,
  {r6('CASE WHEN sector_id IS NOT NULL AND pct IS NOT NULL THEN coverage_pct END')} AS coverage FROM q"""))
def j13(spark, d):
    e = F.col("event_id")
    points = V.table(spark, d, "events").select(e.alias("id"), F.floor(e / 10000.0).alias("obs_id"), (e * 7919 % 1200 / 10.0).alias("x"), (e * 104729 % 1000 / 10.0).alias("y"))
    scope = GE.scope_index(V.zone_polygons(spark, d), V.GRID, ["sector_id", "municipality"])
    out = SA.sample_density(points, focal(spark, d), scope, [1, 2], V.GRID, CIRCLE_HA, "ASIA", ("obs_id",))
    return out.select("id", "status", "pct", "area_ha", "coverage")


# --- Resampling -----------------------------------------------------------------------------------

COARSE = Grid(3.3, -1.7, 3.1, 3.1, 30, 31)
FINE = Grid(-0.85, 0.35, 0.6, 0.6, 150, 160)
# Every target cell with its centre, in SQL.
TARGET = "t AS (SELECT CAST(i AS BIGINT) AS row_i, CAST(j AS BIGINT) AS col_i FROM generate_series(0, {h}) a(i), generate_series(0, {w}) b(j))"


@query("g09_resample_nearest", sql("px", f"""
WITH {TARGET.format(h=159, w=149)}, s AS (SELECT *, CAST(floor(0.35E0 + (row_i + 0.5E0) * 0.6E0) AS BIGINT) AS sr, CAST(floor(-0.85E0 + (col_i + 0.5E0) * 0.6E0) AS BIGINT) AS sc FROM t)
SELECT px.obs_id, s.row_i, s.col_i, code FROM s JOIN px ON px.row_i = sr AND px.col_i = sc"""))
def g09(spark, d):
    return RA.resample_nearest(V.pixels(spark, d).select("obs_id", "row_i", "col_i", "code"), V.GRID, FINE)


@query("g10_resample_average", sql("px", f"""
WITH v AS (SELECT obs_id, row_i AS y, col_i AS x, temp_c FROM px WHERE status = 1),
c AS (SELECT obs_id, CAST(i AS BIGINT) AS row_i, CAST(j AS BIGINT) AS col_i, temp_c,
  (least((y + 1 + 1.7E0) / 3.1E0, i + 1) - greatest((y + 1.7E0) / 3.1E0, i)) * (least((x + 1 - 3.3E0) / 3.1E0, j + 1) - greatest((x - 3.3E0) / 3.1E0, j)) AS w
  FROM v JOIN generate_series(0, 30) a(i) ON (y + 1 + 1.7E0) / 3.1E0 > i AND (y + 1.7E0) / 3.1E0 < i + 1
  JOIN generate_series(0, 29) b(j) ON (x + 1 - 3.3E0) / 3.1E0 > j AND (x - 3.3E0) / 3.1E0 < j + 1)
SELECT obs_id, row_i, col_i, {r6('sum(w * temp_c) / sum(w)')} AS temp_c, {r6('sum(w)')} AS coverage FROM c GROUP BY obs_id, row_i, col_i"""))
def g10(spark, d):
    px = V.pixels(spark, d).where("status = 1")
    return RA.resample_average(px, V.GRID, COARSE, "temp_c", ("obs_id",))


@query("g11_resample_bilinear", sql("px", f"""
WITH v AS (SELECT obs_id, row_i + 0.5E0 AS y, col_i + 0.5E0 AS x, temp_c FROM px WHERE status = 1),
{TARGET.format(h=159, w=149)}, q AS (SELECT *, 0.35E0 + (row_i + 0.5E0) * 0.6E0 AS ty, -0.85E0 + (col_i + 0.5E0) * 0.6E0 AS tx FROM t),
n AS (SELECT q.*, floor(ty - 0.5E0) + dy + 0.5E0 AS y, floor(tx - 0.5E0) + dx + 0.5E0 AS x FROM q, (VALUES (0), (1)) a(dy), (VALUES (0), (1)) b(dx))
SELECT obs_id, row_i, col_i, {r6('sum((1 - abs(ty - n.y)) * (1 - abs(tx - n.x)) * temp_c) / sum((1 - abs(ty - n.y)) * (1 - abs(tx - n.x)))')} AS temp_c
FROM n JOIN v ON v.y = n.y AND v.x = n.x WHERE (1 - abs(ty - n.y)) > 0 AND (1 - abs(tx - n.x)) > 0 GROUP BY obs_id, row_i, col_i"""))
def g11(spark, d):
    px = V.pixels(spark, d).where("status = 1")
    return RA.resample_bilinear(px, V.GRID, FINE, "temp_c", ("obs_id",))


# The stand-in pixels as a grid in degrees, north up, under a spherical Mercator grid.
DEGREES = Grid(3.0, 51.0, 0.012, -0.008, 100, 100, "EPSG:4326")
MERCATOR = S.mercator_grid(2.95, 50.15, 4.25, 51.05, 700.0)
LONLAT = f"""t AS (SELECT CAST(i AS BIGINT) AS row_i, CAST(j AS BIGINT) AS col_i,
  (({MERCATOR.x0!r}::DOUBLE + (j + 0.5E0) * {MERCATOR.dx!r}::DOUBLE) / {EARTH_RADIUS_M}E0 * 180 / pi() - 3.0E0) / 0.012E0 AS fc,
  ((2 * atan(exp(({MERCATOR.y0!r}::DOUBLE + (i + 0.5E0) * {MERCATOR.dy!r}::DOUBLE) / {EARTH_RADIUS_M}E0)) - pi() / 2) * 180 / pi() - 51.0E0) / -0.008E0 AS fr
  FROM generate_series(0, {MERCATOR.height - 1}) a(i), generate_series(0, {MERCATOR.width - 1}) b(j))"""


@query("g09_resample_mercator", sql("px", f"""
WITH {LONLAT} SELECT px.obs_id, t.row_i, t.col_i, code FROM t JOIN px ON px.row_i = floor(fr) AND px.col_i = floor(fc)"""))
def g09b(spark, d):
    return RA.resample_nearest(V.pixels(spark, d).select("obs_id", "row_i", "col_i", "code"), DEGREES, MERCATOR, S.from_mercator)


def r4(expression: str) -> str:
    return f"floor(({expression}) * 10000.0E0 + 0.5E0) / 10000.0E0"


def _four(df, *names):
    """Four decimals: exponentials and logarithms of the two engines differ in their last bits, and cells of a degree grid
    magnify that."""
    return df.withColumns({n: F.floor(F.col(n) * 10000.0 + 0.5) / 10000.0 for n in names})


@query("g10_resample_mercator", sql("px", f"""
WITH v AS (SELECT obs_id, temp_c, (radians(3.0E0 + col_i * 0.012E0) * {EARTH_RADIUS_M}E0 - {MERCATOR.x0!r}::DOUBLE) / {MERCATOR.dx!r}::DOUBLE AS u0,
  (radians(3.0E0 + (col_i + 1) * 0.012E0) * {EARTH_RADIUS_M}E0 - {MERCATOR.x0!r}::DOUBLE) / {MERCATOR.dx!r}::DOUBLE AS u1,
  (ln(tan(pi() / 4 + radians(51.0E0 - row_i * 0.008E0) / 2)) * {EARTH_RADIUS_M}E0 - {MERCATOR.y0!r}::DOUBLE) / {MERCATOR.dy!r}::DOUBLE AS v0,
  (ln(tan(pi() / 4 + radians(51.0E0 - (row_i + 1) * 0.008E0) / 2)) * {EARTH_RADIUS_M}E0 - {MERCATOR.y0!r}::DOUBLE) / {MERCATOR.dy!r}::DOUBLE AS v1 FROM px WHERE status = 1),
c AS (SELECT obs_id, CAST(i AS BIGINT) AS row_i, CAST(j AS BIGINT) AS col_i, temp_c, (least(v1, i + 1) - greatest(v0, i)) * (least(u1, j + 1) - greatest(u0, j)) AS w
  FROM v JOIN generate_series(0, {MERCATOR.height - 1}) a(i) ON v1 > i AND v0 < i + 1 JOIN generate_series(0, {MERCATOR.width - 1}) b(j) ON u1 > j AND u0 < j + 1)
SELECT obs_id, row_i, col_i, {r4('sum(w * temp_c) / sum(w)')} AS temp_c, {r4('sum(w)')} AS coverage FROM c WHERE w > 1e-12 GROUP BY obs_id, row_i, col_i"""))
def g10b(spark, d):
    px = V.pixels(spark, d).where("status = 1")
    return _four(RA.resample_average(px, DEGREES, MERCATOR, "temp_c", ("obs_id",), S.to_mercator), "temp_c", "coverage")


@query("g11_resample_mercator", sql("px", f"""
WITH v AS (SELECT obs_id, row_i AS y, col_i AS x, temp_c FROM px WHERE status = 1), {LONLAT},
n AS (SELECT t.*, floor(fr - 0.5E0) + dy AS y, floor(fc - 0.5E0) + dx AS x FROM t, (VALUES (0), (1)) a(dy), (VALUES (0), (1)) b(dx)),
w AS (SELECT *, (1 - abs(fr - y - 0.5E0)) * (1 - abs(fc - x - 0.5E0)) AS w FROM n)
SELECT obs_id, row_i, col_i, {r4('sum(w * temp_c) / sum(w)')} AS temp_c FROM w JOIN v USING (y, x) WHERE w > 1e-9 GROUP BY obs_id, row_i, col_i"""))
def g11b(spark, d):
    px = V.pixels(spark, d).where("status = 1")
    return _four(RA.resample_bilinear(px, DEGREES, MERCATOR, "temp_c", ("obs_id",), S.from_mercator), "temp_c")


@query("g16_halo", sql("px", """
SELECT obs_id, CAST(tr AS BIGINT) AS tile_row, CAST(tc AS BIGINT) AS tile_col, count(*) AS n, count(*) FILTER (row_i // 25 = tr AND col_i // 25 = tc) AS n_own FROM px
JOIN generate_series(-1, 4) a(tr) ON row_i BETWEEN tr * 25 - 3 AND tr * 25 + 27 JOIN generate_series(-1, 4) b(tc) ON col_i BETWEEN tc * 25 - 3 AND tc * 25 + 27 GROUP BY ALL"""))
def g16(spark, d):
    halo = RA.with_halo(V.pixels(spark, d).select("obs_id", "row_i", "col_i"), 3, 25)
    own = RA.crop_halo(halo, 25).groupBy("obs_id", "tile_row", "tile_col").agg(F.count("*").alias("n_own"))
    total = halo.groupBy("obs_id", "tile_row", "tile_col").agg(F.count("*").alias("n"))
    return total.join(own, ["obs_id", "tile_row", "tile_col"], "left").na.fill(0, ["n_own"])


@query("g18_mask_to_municipality", sql("pz", "SELECT obs_id, municipality, code, count(*) AS n FROM pz WHERE code <> 0 GROUP BY obs_id, municipality, code"))
def g18(spark, d):
    index = GE.scope_index(V.zone_polygons(spark, d), V.GRID, ["municipality", "sector_id"]).drop("sector_id")
    masked = RA.mask_to_municipality(V.pixels(spark, d).where("code <> 0"), index, V.GRID)
    return masked.groupBy("obs_id", "municipality", "code").agg(F.count("*").alias("n"))


# --- Vegetation -----------------------------------------------------------------------------------

# Land use of a diamond by its class; land cover of a pixel by its code.
USES = ["14110", "11100", "21000", "23000", "50000"]
USE_OF = "['14110', '11100', '21000', '23000', '50000'][1 + class_code % 5]"
COVER_OF = "CASE code WHEN 1 THEN 40 WHEN 2 THEN 30 ELSE 10 END"
REASON = "CASE WHEN use = '50000' THEN 'water' WHEN (cover = 40 AND coalesce(use, '') <> '23000') OR (cover = 30 AND use = '21000') THEN 'cropland' END"
VEG_PX = f"vp AS (SELECT *, data_mask = 1 AS valid, {NDVI} AS ndvi, {COVER_OF} AS cover FROM px)"
SUB_USE = f"su AS (SELECT sub_row, sub_col, arg_max({USE_OF}, poly_id) AS use FROM ({sub(3)}) GROUP BY sub_row, sub_col)"
SUB_ZONE = """sz AS (SELECT CAST(i AS BIGINT) AS sub_row, CAST(j AS BIGINT) AS sub_col, sector_id FROM zone, unnest(generate_series(3 * r0, 3 * r1 - 1)) a(i), unnest(generate_series(3 * c0, 3 * c1 - 1)) b(j))"""
COMBOS = f"""{SUB_USE}, {SUB_ZONE}, cb AS (SELECT CAST(floor(sub_row / 3.0E0) AS BIGINT) AS row_i, CAST(floor(sub_col / 3.0E0) AS BIGINT) AS col_i, sector_id, use, count(*) AS n
  FROM sz LEFT JOIN su USING (sub_row, sub_col) GROUP BY ALL)"""
PARTS = ["total", "valid", "likely", "below", "cropland", "water", "missing"]
VEG = f"""{VEG_PX}, {COMBOS}, x AS (SELECT *, {REASON} AS reason, valid AND ndvi IS NOT NULL AS ok FROM vp JOIN cb USING (row_i, col_i)),
h AS (SELECT obs_id, sector_id, CAST(floor((ndvi + 1.0E0) / 0.001E0 + 0.5E0) AS INT) AS b, sum(n) AS n FROM x WHERE ok GROUP BY ALL),
hc AS (SELECT *, sum(n) OVER (PARTITION BY obs_id, sector_id ORDER BY b) AS upto, sum(n) OVER (PARTITION BY obs_id, sector_id) AS total FROM h),
hm AS (SELECT obs_id, sector_id, min(b) AS b50 FROM hc WHERE upto >= ceil(total * 0.5E0) GROUP BY obs_id, sector_id),
s AS (SELECT obs_id, sector_id, sum(n) AS total, coalesce(sum(n) FILTER (ok), 0) AS valid, coalesce(sum(n) FILTER (ok AND reason IS NULL AND ndvi >= 0.1E0), 0) AS likely,
  coalesce(sum(n) FILTER (ok AND reason IS NULL AND ndvi < 0.1E0), 0) AS below, coalesce(sum(n) FILTER (ok AND reason = 'cropland'), 0) AS cropland,
  coalesce(sum(n) FILTER (ok AND reason = 'water'), 0) AS water, coalesce(sum(n) FILTER (NOT ok), 0) AS missing FROM x GROUP BY obs_id, sector_id),
vs AS (SELECT k.obs_id, k.sector_id, {', '.join(f'coalesce({p}, 0) AS {p}' for p in PARTS)}, CASE WHEN total > 0 THEN 39960.0E0 / (total * 11.0E0) END AS factor,
  floor((b50 * 0.001E0 - 1) * 1000.0E0 + 0.5E0) / 1000.0E0 AS median_ndvi FROM (SELECT obs_id, sector_id FROM (SELECT DISTINCT obs_id FROM s) CROSS JOIN zone) k
  LEFT JOIN s USING (obs_id, sector_id) LEFT JOIN hm USING (obs_id, sector_id))"""


def vegetation_px(spark, d):
    code = F.col("code")
    return V.pixels(spark, d).select(
        "obs_id", "row_i", "col_i", "code", (F.col("data_mask") == 1).alias("valid"), P.ndvi(F.col("b04"), F.col("b08")).alias("ndvi"),
        F.when(code == 1, 40).when(code == 2, 30).otherwise(10).alias("cover"))


def used(spark, d):
    use = F.element_at(F.array(*map(F.lit, USES)), (1 + F.col("class_code") % 5).cast("int"))
    return V.diamond_polygons(spark, d).withColumn("use", use)


def vegetation(spark, d):
    zone_cells = GE.span_cells(GE.rasterize(V.zone_polygons(spark, d), ["sector_id"], V.GRID, 3)).select(
        F.col("row_i").alias("sub_row"), F.col("col_i").alias("sub_col"), "sector_id")
    combos = GE.cell_combos(zone_cells, GE.last_feature(used(spark, d), V.GRID, 3, "use", "poly_id"), 3)
    zones = V.zones(spark, d).select("sector_id", F.lit(39960.0).alias("exact_m2"))
    return Z.vegetation_stats(vegetation_px(spark, d), combos, zones, 0.1, 11.0, keys=("obs_id",))


@query("a12_vegetation_stats", sql("px poly zone", f"""
WITH {VEG} SELECT obs_id, sector_id, {r6('factor')} AS factor, {', '.join(f"{r6(f'{p} * 11.0E0 * coalesce(factor, 0) / 10000.0E0')} AS {p}_ha" for p in PARTS)},
  {', '.join(f"{r6(f'CASE WHEN total > 0 THEN {p} / CAST(total AS DOUBLE) * 100 ELSE 0 END')} AS {p}_pct" for p in PARTS[2:6])}, {r6('median_ndvi')} AS median_ndvi FROM vs"""))
def a12(spark, d):
    return vegetation(spark, d)


@query("a10_rollup_vegetation", sql("px poly zone", f"""
WITH {VEG}, a AS (SELECT obs_id, municipality, {', '.join(f'{p} * 11.0E0 * coalesce(factor, 0) / 10000.0E0 AS {p}' for p in PARTS)}, median_ndvi FROM vs JOIN zone USING (sector_id)),
t AS (SELECT obs_id, CASE WHEN GROUPING(municipality) = 1 THEN 'region:all' ELSE 'municipality:' || municipality END AS scope, {', '.join(f'sum({p}) AS {p}' for p in PARTS)},
  sum(coalesce(median_ndvi, 0) * valid) AS mv FROM a GROUP BY obs_id, ROLLUP (municipality))
SELECT obs_id, scope, {', '.join(f"{r6(p)} AS {p}_ha" for p in PARTS)}, {', '.join(f"{r6(f'CASE WHEN total > 0 THEN {p} / total * 100 ELSE 0 END')} AS {p}_pct" for p in PARTS[2:6])}, {r6('CASE WHEN valid > 0 THEN mv / valid END')} AS median_ndvi,
  true AS median_is_approximate FROM t"""))
def a10(spark, d):
    return R.rollup_vegetation(TB.with_municipality(vegetation(spark, d), V.zones(spark, d)), ("obs_id",))


USE_VOTES = f"""{SUB_USE}, uv AS (SELECT CAST(floor(sub_row / 3.0E0) AS BIGINT) AS row_i, CAST(floor(sub_col / 3.0E0) AS BIGINT) AS col_i, use, count(*) AS votes FROM su GROUP BY ALL),
ud AS (SELECT row_i, col_i, use, votes FROM (SELECT *, row_number() OVER (PARTITION BY row_i, col_i ORDER BY votes DESC, use) AS rn FROM uv) WHERE rn = 1)"""


def dominant_use(spark, d):
    return GE.dominant_subpixel(GE.subpixel_votes(GE.last_feature(used(spark, d), V.GRID, 3, "use", "poly_id"), 3, "use"), "use")


@query("a13_overlap_counts", sql("px poly", f"""
WITH {VEG_PX}, {USE_VOTES} SELECT count(*) FILTER (cover = 40 AND use = '23000') AS cropland_pasture, count(*) FILTER (cover = 30 AND use = '21000') AS grassland_arable
FROM vp JOIN ud USING (row_i, col_i)"""))
def a13(spark, d):
    cells = vegetation_px(spark, d).join(dominant_use(spark, d), ["row_i", "col_i"])
    return Z.overlap_counts(cells, {"cropland_pasture": (40, "23000"), "grassland_arable": (30, "21000")})


SAMPLES = f"""{VEG_PX}, {USE_VOTES}, sm AS (SELECT vp.*, CASE WHEN use IN ('14110', '23000') THEN 'positive' WHEN use = '11100' THEN 'negative' END AS sample
  FROM vp JOIN ud USING (row_i, col_i) WHERE votes >= 8 AND valid AND ndvi IS NOT NULL AND use IN ('14110', '23000', '11100'))"""


@query("a27_calibration_samples", sql("px poly", f"WITH {SAMPLES} SELECT obs_id, row_i, col_i, sample, {r6('ndvi')} AS ndvi FROM sm"))
def a27(spark, d):
    return Z.calibration_samples(vegetation_px(spark, d), dominant_use(spark, d)).select("obs_id", "row_i", "col_i", "sample", "ndvi")


@query("g19_vegetation_mask", sql("px poly zone", f"""
WITH {VEG_PX}, {USE_VOTES}, k AS (SELECT obs_id, row_i, col_i, sector_id, {REASON} AS reason FROM vp JOIN zone ON row_i >= r0 AND row_i < r1 AND col_i >= c0 AND col_i < c1
  LEFT JOIN ud USING (row_i, col_i) WHERE valid AND ndvi >= 0.1E0)
SELECT obs_id, row_i, col_i, sector_id FROM k WHERE reason IS NULL"""))
def g19(spark, d):
    zone_votes = GE.fractional_weights(V.zone_polygons(spark, d), ["sector_id"], V.GRID, 3).withColumnRenamed("w", "votes")
    sectors = GE.dominant_subpixel(zone_votes, "sector_id")
    return RA.vegetation_mask(vegetation_px(spark, d), sectors, dominant_use(spark, d), 0.1, V.GRID).select("obs_id", "row_i", "col_i", "sector_id")


# --- Surface comparison: majority class of each pixel against temperature --------------------------


@query("g06_series_by_majority", sql("px poly", f"""
WITH t AS (SELECT *, max(votes) OVER (PARTITION BY row_i, col_i) AS top FROM ({votes(3)})),
m AS (SELECT row_i, col_i, CASE WHEN max(top) >= 5 AND count(*) FILTER (votes = top) = 1 THEN max(v) FILTER (votes = top) ELSE 0 END AS v FROM t GROUP BY row_i, col_i)
SELECT obs_id, CAST(v AS VARCHAR) AS class_code, count(*) AS n, {r6('avg(temp_c)')} AS mean_c FROM px JOIN m USING (row_i, col_i) WHERE v <> 0 AND status = 1 GROUP BY obs_id, v"""))
def g06b(spark, d):
    majority = GE.unique_majority(cell_votes(spark, d, 3), "v", 5).where("v <> 0")
    rows = V.pixels(spark, d).where("status = 1").join(majority, ["row_i", "col_i"])
    return (rows.groupBy("obs_id", F.col("v").cast("string").alias("class_code"))
            .agg(F.count("*").alias("n"), F.avg("temp_c").alias("mean_c")))


@query("p18_soil_by_average", sql("px", f"""
WITH v AS (SELECT obs_id, floor(row_i / 3.0E0) AS r, floor(col_i / 3.0E0) AS c, code FROM px),
a AS (SELECT obs_id, CAST(r AS BIGINT) AS row_i, CAST(c AS BIGINT) AS col_i, count(*) FILTER (code <> 0) / 9.0E0 AS cov, count(*) FILTER (code = 1) / 9.0E0 AS hit FROM v GROUP BY ALL)
SELECT obs_id, row_i, col_i, CASE WHEN cov >= 0.5 AND hit / cov > 0.5 THEN 1 WHEN cov >= 0.5 AND hit / cov < 0.5 THEN 2 ELSE 0 END AS soil FROM a"""))
def p18b(spark, d):
    blocks = (V.pixels(spark, d)
              .groupBy("obs_id", F.floor(F.col("row_i") / 3).alias("row_i"), F.floor(F.col("col_i") / 3).alias("col_i"))
              .agg((F.count_if(F.col("code") != 0) / 9.0).alias("cov"), (F.count_if(F.col("code") == 1) / 9.0).alias("hit")))
    share = F.when(F.col("cov") > 0, F.col("hit") / F.col("cov"))
    return blocks.select("obs_id", "row_i", "col_i", P.classify_soil(F.col("cov"), share).alias("soil"))
