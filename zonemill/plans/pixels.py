"""Zonal statistics, distributions and roll-ups on the stand-in pixels."""

from __future__ import annotations

from pyspark.sql import functions as F

from zonemill import model as M
from zonemill.functions import pixels as P
from zonemill.functions.numbers import half_up
from zonemill.operators import geometry as GE
from zonemill.operators import rollups as R
from zonemill.operators import scenes as SC
from zonemill.operators import tables as TB
from zonemill.operators import zonal as Z
from zonemill.plans import standins as V
from zonemill.session import spread
from zonemill.plans.registry import query
from zonemill.plans.standins import CELL_HA, r6, sql
from zonemill.plans.scalars import MERC_HA, MERCATOR
from zonemill.functions import space as G

HA = f"{CELL_HA}E0"
COMPLETE = f"(400 * {HA} + (sector_id % 5) * 0.5E0)"


def zone_spans(spark, d):
    rows = F.explode(F.sequence("r0", F.col("r1") - 1))
    return V.zones(spark, d).select("sector_id", "municipality", rows.alias("row_i"), F.col("c0").cast("bigint").alias("c0"),
                                    (F.col("c1") - 1).cast("bigint").alias("c1"))


def zones(spark, d):
    """Zones with an area that is a little larger than their pixels, so that there is a coverage gap."""
    return V.zones(spark, d).select("sector_id", "municipality", (400 * CELL_HA + (F.col("sector_id") % 5) * 0.5).alias("complete_ha"))


def observations(spark, d):
    """The inventory of observations, for which every zone has a record."""
    return V.pixels(spark, d).select("obs_id")


def zoned(spark, d, px=None):
    return Z.assign_zone(V.pixels(spark, d) if px is None else px, zone_spans(spark, d))


CAT = f"""SELECT obs_id, sector_id, {COMPLETE} AS complete_ha, k.code, count(*) FILTER (zpx.code = k.code) * {HA} AS area_ha,
  count(*) FILTER (zpx.code IN (1, 2, 3, 4)) * {HA} AS valid_ha FROM zpx, (VALUES (1), (2), (3), (4)) k(code) GROUP BY obs_id, sector_id, k.code"""


@query("a01_categorical_stats", sql("zpx", f"""
SELECT obs_id, sector_id, complete_ha, code, area_ha, valid_ha, {r6('area_ha / complete_ha * 100')} AS pct, {r6('valid_ha / complete_ha * 100')} AS valid_pct,
  greatest(0, complete_ha - valid_ha) AS no_data_ha, {r6('greatest(0, complete_ha - valid_ha) / complete_ha * 100')} AS no_data_pct FROM ({CAT})"""))
def a01(spark, d):
    """The whole chain: zone polygons → spans → pixels in zones → class areas."""
    polygons = V.zone_polygons(spark, d)
    located = Z.assign_zone(V.pixels(spark, d).select("obs_id", "row_i", "col_i", "code"), GE.rasterize(polygons, ["sector_id"], V.GRID))
    return Z.categorical_stats(located, zones(spark, d), [1, 2, 3, 4], CELL_HA, keys=("obs_id",))


@query("a01_scope_rollup", sql("pz", f"""
SELECT obs_id, CASE WHEN GROUPING(municipality) = 1 THEN 'region:all' WHEN GROUPING(sector_id) = 1 THEN 'municipality:' || municipality
  ELSE 'sector:' || sector_id END AS scope, code, count(*) * {HA} AS area_ha FROM pz
GROUP BY obs_id, code, ROLLUP (municipality, sector_id)"""))
def a01b(spark, d):
    per_sector = zoned(spark, d).groupBy("obs_id", "municipality", "sector_id", "code").agg((F.count("*") * CELL_HA).alias("area_ha"))
    return TB.scope_keys(per_sector).groupBy("obs_id", "scope", "code").agg(F.sum("area_ha").alias("area_ha"))


BINARY = f"""SELECT obs_id, sector_id, municipality, {COMPLETE} AS complete_ha, count(*) FILTER (code = 1) * {HA} AS sealed_ha,
  count(*) FILTER (code = 0) * {HA} AS unsealed_ha FROM zpx GROUP BY obs_id, sector_id, municipality"""
BINARY_SUMS = f"""SELECT *, sealed_ha + unsealed_ha AS valid_ha, greatest(0, complete_ha - sealed_ha - unsealed_ha) AS no_data_ha FROM ({BINARY})"""


@query("a02_binary_stats", sql("zpx", f"""
SELECT obs_id, sector_id, complete_ha, sealed_ha, unsealed_ha, valid_ha, no_data_ha, {r6('sealed_ha / complete_ha * 100')} AS sealed_pct,
  {r6('unsealed_ha / complete_ha * 100')} AS unsealed_pct, {r6('valid_ha / complete_ha * 100')} AS valid_pct,
  {r6('no_data_ha / complete_ha * 100')} AS no_data_pct FROM ({BINARY_SUMS})"""))
def a02(spark, d):
    return Z.binary_stats(zoned(spark, d), zones(spark, d), CELL_HA, keys=("obs_id",))


# --- Fractional weights: diamonds as zones, sub-cells counted by the closed form of a diamond ------


def sub(scale, columns="poly_id, class_code"):
    """SQL for the sub-cells of every diamond."""
    return f"""SELECT {columns}, sr AS sub_row, sc AS sub_col FROM poly,
  unnest(generate_series(CAST(greatest(0, {scale} * (cy - r)) AS BIGINT), CAST(least({100 * scale - 1}, {scale} * (cy + r)) AS BIGINT))) AS a(sr),
  unnest(generate_series(CAST(greatest(0, {scale} * (cx - r)) AS BIGINT), CAST(least({100 * scale - 1}, {scale} * (cx + r)) AS BIGINT))) AS b(sc)
  WHERE abs(sc + 0.5E0 - {scale} * cx) + abs(sr + 0.5E0 - {scale} * cy) <= {scale} * r"""


def weights_sql(scale):
    return f"""SELECT poly_id, CAST(floor(sub_row / {scale}.0E0) AS BIGINT) AS row_i, CAST(floor(sub_col / {scale}.0E0) AS BIGINT) AS col_i, count(*) AS w
  FROM ({sub(scale)}) GROUP BY ALL"""


def weighted_pixels(spark, d, scale=10):
    """Pixels, and the weights of the diamonds' cells."""
    return V.pixels(spark, d), GE.fractional_weights(V.diamond_polygons(spark, d), ["poly_id"], V.GRID, scale)


def diamond_zones(spark, d):
    return V.diamonds(spark, d).select("poly_id", (2.0 * F.col("r") * F.col("r") * CELL_HA).alias("complete_ha"))


DENSITY = f"""WITH w AS ({weights_sql(10)}), x AS (SELECT obs_id, poly_id, dn % 128 AS v, w FROM px JOIN w USING (row_i, col_i) WHERE dn % 128 <= 100),
s AS (SELECT obs_id, poly_id, sum(w) AS w, sum(v * w) AS vw, coalesce(sum(w) FILTER (v > 0), 0) AS pw, {', '.join(f"coalesce(sum(w) FILTER (v BETWEEN {a} AND {b}), 0) AS w{a}" for a, b in M.DENSITY_CLASSES)}
  FROM x GROUP BY obs_id, poly_id),
m AS (SELECT obs_id, poly_id, min(v) AS median FROM (SELECT *, sum(w) OVER (PARTITION BY obs_id, poly_id ORDER BY v) AS upto,
  sum(w) OVER (PARTITION BY obs_id, poly_id) AS total FROM x) WHERE upto >= total * 0.5E0 GROUP BY obs_id, poly_id),
k AS (SELECT obs_id, poly_id, r FROM (SELECT DISTINCT obs_id FROM x) CROSS JOIN poly),
a AS (SELECT k.obs_id, k.poly_id, w, coalesce(vw, 0) AS vw, pw, median, 2.0E0 * r * r * {HA} AS whole, coalesce(w, 0) * 0.0025E0 AS valid, coalesce(pw, 0) * 0.0025E0 AS present,
  {', '.join(f"coalesce(w{a}, 0) * 0.0025E0 AS c{a}" for a, _ in M.DENSITY_CLASSES)}
  FROM k LEFT JOIN s USING (obs_id, poly_id) LEFT JOIN m USING (obs_id, poly_id))"""


DENSITY_COLUMNS = ",\n  ".join(
    f"{r6(f'c{a}')} AS class_{a}_{b}_ha, {r6(f'c{a} / whole * 100')} AS class_{a}_{b}_pct, {r6(f'CASE WHEN present > 0 THEN c{a} / present * 100 ELSE 0 END')} AS class_{a}_{b}_present_pct"
    for a, b in M.DENSITY_CLASSES)


@query("a03_density_stats", sql("px poly", f"""{DENSITY}
SELECT obs_id, poly_id, {r6('whole')} AS complete_ha, {r6('valid')} AS valid_ha, {r6('valid / whole * 100')} AS valid_pct, {r6('greatest(0, whole - valid)')} AS no_data_ha,
  {r6('greatest(0, whole - valid) / whole * 100')} AS no_data_pct, {r6('CAST(vw AS DOUBLE) / w')} AS mean_density, CAST(median AS DOUBLE) AS median_density,
  {r6('greatest(0, valid - present)')} AS zero_ha, {r6('greatest(0, valid - present) / whole * 100')} AS zero_pct, {r6('present')} AS presence_ha, {r6('present / whole * 100')} AS presence_pct,
  {r6('CASE WHEN pw > 0 THEN CAST(vw AS DOUBLE) / pw END')} AS mean_present, {r6('CAST(vw AS DOUBLE) / 100 * 0.0025E0')} AS crown_ha, {DENSITY_COLUMNS} FROM a"""))
def a03(spark, d):
    px, weights = weighted_pixels(spark, d)
    return Z.density_stats(px.withColumn("value", F.col("dn") % 128), diamond_zones(spark, d), CELL_HA / 100, zone="poly_id", keys=("obs_id",), weights=weights)


def _wq(value, cond, p, alias):
    return f"""{alias} AS (SELECT obs_id, poly_id, min({value}) AS q FROM (SELECT *, sum(w) OVER (PARTITION BY obs_id, poly_id ORDER BY {value}) AS upto,
  sum(w) OVER (PARTITION BY obs_id, poly_id) AS total FROM x WHERE {cond}) WHERE upto >= total * {p}E0 GROUP BY obs_id, poly_id)"""


@query("a04_temperature_stats", sql("px poly", f"""
WITH w AS ({weights_sql(10)}), x AS (SELECT obs_id, poly_id, status, temp_c AS t, dn * 0.01E0 AS u, w FROM px JOIN w USING (row_i, col_i)),
s AS (SELECT obs_id, poly_id, coalesce(sum(w) FILTER (status = 1), 0) AS cw, coalesce(sum(w) FILTER (status = 2), 0) AS ow, count(*) FILTER (status = 1) AS n,
  sum(t * w) FILTER (status = 1) AS tw, sum(u * w) FILTER (status = 1) AS uw FROM x GROUP BY obs_id, poly_id),
{_wq('t', 'status = 1', 0.1, 'p1')}, {_wq('t', 'status = 1', 0.5, 'p5')}, {_wq('t', 'status = 1', 0.9, 'p9')}, {_wq('u', 'status = 1', 0.5, 'pu')},
k AS (SELECT obs_id, poly_id, r FROM (SELECT DISTINCT obs_id FROM s WHERE cw + ow > 0) CROSS JOIN poly),
a AS (SELECT k.obs_id, k.poly_id, coalesce(n, 0) AS n, tw, uw, cw, 2.0E0 * r * r * {HA} AS whole, coalesce(cw, 0) * 0.0025E0 AS c, coalesce(ow, 0) * 0.0025E0 AS o FROM k LEFT JOIN s USING (obs_id, poly_id))
SELECT a.obs_id, a.poly_id, {r6('whole')} AS complete_ha, {r6('c')} AS clear_ha, {r6('c / whole * 100')} AS clear_pct, {r6('o')} AS cloud_ha, {r6('o / whole * 100')} AS cloud_pct,
  {r6('greatest(0, whole - c - o)')} AS missing_ha, {r6('greatest(0, whole - c - o) / whole * 100')} AS missing_pct, n AS pixel_count, {r6('CASE WHEN cw > 0 THEN tw / cw END')} AS mean_c, {r6('p1.q')} AS p10_c, {r6('p5.q')} AS median_c, {r6('p9.q')} AS p90_c, {r6('CASE WHEN cw > 0 THEN uw / cw END')} AS mean_uncertainty_k,
  {r6('pu.q')} AS median_uncertainty_k FROM a LEFT JOIN p1 USING (obs_id, poly_id) LEFT JOIN p5 USING (obs_id, poly_id) LEFT JOIN p9 USING (obs_id, poly_id)
  LEFT JOIN pu USING (obs_id, poly_id)"""))
def a04(spark, d):
    px, weights = weighted_pixels(spark, d)
    return Z.temperature_stats(px.withColumn("uncertainty", F.col("dn") * 0.01), diamond_zones(spark, d), CELL_HA / 100, zone="poly_id", keys=("obs_id",), weights=weights)


# --- Land cover on the Mercator grid --------------------------------------------------------------

COVER_CODE = "[10, 20, 30, 40, 90, 100, 254, 0][1 + CAST((dn % 8) AS INT)]"
BEFORE_CODE = "[90, 10, 30, 254, 40][1 + CAST(code0 AS INT)]"


def coded(px, column="dn"):
    codes = F.array(*map(F.lit, [10, 20, 30, 40, 90, 100, 254, 0]))
    return px.withColumn("code", F.element_at(codes, (1 + F.col(column) % 8).cast("int")))


def land_cover(spark, d):
    return Z.land_cover_areas(coded(zoned(spark, d)), G.mercator_cell_ha(F.col("row_i"), MERCATOR), ["obs_id", "sector_id"])


LC_AREAS = f"""SELECT obs_id, sector_id, lc AS code, sum(ha) AS area_ha FROM (SELECT *, {COVER_CODE} AS lc, {MERC_HA} AS ha FROM pz) GROUP BY obs_id, sector_id, lc"""
LC_STATS = f"""SELECT obs_id, sector_id, sum(area_ha) AS total_ha, coalesce(sum(area_ha) FILTER (code NOT IN (0, 254)), 0) AS classified_ha,
  coalesce(sum(area_ha) FILTER (code = 254), 0) AS unclassifiable_ha, coalesce(sum(area_ha) FILTER (code IN (10, 30)), 0) AS vegetation_ha,
  coalesce(sum(area_ha) FILTER (code = 90), 0) AS built_up_ha FROM lc GROUP BY obs_id, sector_id"""


def every_zone(columns, rows):
    """SQL: (observation, zone) records with zeros where a zone has no pixel."""
    return f"""SELECT z.obs_id, z.sector_id, {', '.join(f'coalesce({c}, 0) AS {c}' for c in columns)} FROM (SELECT obs_id, sector_id FROM (SELECT DISTINCT obs_id FROM {rows})
  CROSS JOIN zone) z LEFT JOIN {rows} USING (obs_id, sector_id)"""


LC_COLUMNS = ["total_ha", "classified_ha", "unclassifiable_ha", "vegetation_ha", "built_up_ha"]


@query("a05_land_cover_stats", sql("pz zone", f"""
WITH lc AS ({LC_AREAS}), s0 AS ({LC_STATS}), s AS ({every_zone(LC_COLUMNS, 's0')}), k AS (SELECT obs_id, sector_id, code, row_number() OVER (PARTITION BY obs_id, sector_id ORDER BY area_ha DESC, code) AS rn
  FROM lc WHERE code NOT IN (0, 254))
SELECT s.obs_id, s.sector_id, {r6('total_ha')} AS total_ha, {r6('classified_ha')} AS classified_ha, {r6('unclassifiable_ha')} AS unclassifiable_ha,
  {r6('vegetation_ha')} AS vegetation_ha, {r6('built_up_ha')} AS built_up_ha, k.code AS dominant_code,
  {r6('CASE WHEN classified_ha > 0 THEN vegetation_ha / classified_ha * 100 END')} AS vegetation_pct,
  {r6('CASE WHEN classified_ha > 0 THEN built_up_ha / classified_ha * 100 END')} AS built_up_pct FROM s LEFT JOIN k ON k.obs_id = s.obs_id AND k.sector_id = s.sector_id AND rn = 1"""))
def a05(spark, d):
    return Z.land_cover_stats(land_cover(spark, d), ["obs_id", "sector_id"], zones=V.zones(spark, d))


@query("a05_land_cover_classes", sql("pz", f"""
WITH lc AS ({LC_AREAS}) SELECT obs_id, sector_id, code, {r6('area_ha')} AS area_ha, {r6('area_ha / sum(area_ha) OVER (PARTITION BY obs_id, sector_id) * 100')} AS pct
FROM lc WHERE code NOT IN (0, 254)"""))
def a05b(spark, d):
    return Z.land_cover_classes(land_cover(spark, d), ["obs_id", "sector_id"])


PAIRS = f"""SELECT pz.obs_id, sector_id, row_i, {BEFORE_CODE} AS b, {COVER_CODE} AS a, {MERC_HA} AS ha FROM pz JOIN px0 USING (obs_id, row_i, col_i)"""


@query("a06_change_stats", sql("pz px0 zone", f"""
WITH p AS ({PAIRS}), u AS (SELECT *, b <> 254 AND a NOT IN (0, 254) AS ok FROM p),
s0 AS (SELECT obs_id, sector_id, coalesce(sum(ha) FILTER (ok), 0) AS c, coalesce(sum(ha) FILTER (ok AND b NOT IN (10, 30) AND a IN (10, 30)), 0) AS g,
  coalesce(sum(ha) FILTER (ok AND b IN (10, 30) AND a NOT IN (10, 30)), 0) AS l, coalesce(sum(ha) FILTER (ok AND b IN (10, 30) AND a IN (10, 30)), 0) AS k
  FROM u GROUP BY obs_id, sector_id), s AS ({every_zone('cglk', 's0')})
SELECT obs_id, sector_id, {r6('c')} AS compared_ha, {r6('g')} AS gained_ha, {r6('l')} AS lost_ha, {r6('k')} AS unchanged_ha, {r6('CASE WHEN c > 0 THEN g / c * 100 END')} AS gained_pct,
  {r6('CASE WHEN c > 0 THEN l / c * 100 END')} AS lost_pct, {r6('g - l')} AS net_ha FROM s"""))
def a06(spark, d):
    before = F.array(*map(F.lit, [90, 10, 30, 254, 40]))
    then = V.baseline(spark, d).select("obs_id", "row_i", "col_i", F.element_at(before, (1 + F.col("code0")).cast("int")).alias("before"))
    pairs = TB.align(coded(zoned(spark, d)).withColumnRenamed("code", "after"), then, V.GRID, V.GRID, ("obs_id", "row_i", "col_i"))
    return Z.change_stats(pairs, G.mercator_cell_ha(F.col("row_i"), MERCATOR), ["obs_id", "sector_id"], zones=V.zones(spark, d))


# --- Class areas and their roll-ups ---------------------------------------------------------------

GREEN, ARTIFICIAL, HIDDEN = [1, 2], [3, 4], [7]
CLASS_STATS = """SELECT z.sector_id, z.municipality, z.whole, coalesce(sum(area_m2), 0) AS processed, coalesce(sum(area_m2) FILTER (class_code = 7), 0) AS hidden,
  coalesce(sum(area_m2) FILTER (class_code IN (1, 2)), 0) AS green, coalesce(sum(area_m2) FILTER (class_code IN (3, 4)), 0) AS artificial
  FROM (SELECT *, 1000000.0E0 AS whole FROM zone) z LEFT JOIN area_fact f ON f.sector_id = z.sector_id GROUP BY z.sector_id, z.municipality, z.whole"""
BEST = "SELECT sector_id, class_code, row_number() OVER (PARTITION BY sector_id ORDER BY area_m2 DESC, class_code) AS rn FROM area_fact WHERE class_code <> 7"


def zone_m2(spark, d):
    return V.zones(spark, d).select("sector_id", "municipality", F.lit(1_000_000.0).alias("zone_m2"))


def class_stats(spark, d):
    return R.class_area_stats(V.area_facts(spark, d), zone_m2(spark, d), GREEN, ARTIFICIAL, HIDDEN)


@query("a07_class_area_stats", sql("area_fact zone", f"""
WITH s AS (SELECT *, greatest(0, processed - hidden) AS valid FROM ({CLASS_STATS})), b AS ({BEST})
SELECT s.sector_id, whole / 10000 AS zone_ha, {r6('processed / 10000')} AS processed_ha, {r6('valid / 10000')} AS valid_ha,
  {r6('(hidden + greatest(0, whole - processed)) / 10000')} AS no_data_ha, {r6('processed / whole * 100')} AS coverage_pct, b.class_code AS dominant_code,
  {r6('green / 10000')} AS green_ha, {r6('CASE WHEN valid > 0 THEN green / valid * 100 ELSE 0 END')} AS green_pct, {r6('artificial / 10000')} AS artificial_ha,
  {r6('CASE WHEN valid > 0 THEN artificial / valid * 100 ELSE 0 END')} AS artificial_pct FROM s LEFT JOIN b ON b.sector_id = s.sector_id AND rn = 1"""))
def a07(spark, d):
    return class_stats(spark, d)


@query("a07_class_breakdown", sql("area_fact zone", f"""
WITH s AS (SELECT *, greatest(0, processed - hidden) AS valid FROM ({CLASS_STATS})),
r AS (SELECT s.sector_id, c.grp, c.class_code, coalesce(f.area_m2, 0) AS a, CASE c.grp WHEN 'green' THEN green WHEN 'artificial' THEN artificial ELSE 0 END AS g, valid, c.keep
  FROM s, (VALUES ('green', 1, true), ('green', 2, true), ('green', 99, true), ('artificial', 3, false), ('artificial', 4, false), ('artificial', 98, false),
  ('other', 5, false), ('other', 6, false)) c(grp, class_code, keep) LEFT JOIN area_fact f ON f.sector_id = s.sector_id AND f.class_code = c.class_code)
SELECT sector_id, grp, class_code, {r6('a / 10000')} AS area_ha, {r6('CASE WHEN g > 0 THEN a / g * 100 ELSE 0 END')} AS group_pct,
  {r6('CASE WHEN valid > 0 THEN a / valid * 100 ELSE 0 END')} AS pct FROM r WHERE keep OR a > 0"""))
def a07b(spark, d):
    groups = {"green": ([1, 2, 99], True), "artificial": ([3, 4, 98], False)}
    return R.class_breakdown(V.area_facts(spark, d), class_stats(spark, d), groups, no_data=HIDDEN)


@query("a08_rollup_class_stats", sql("area_fact zone", f"""
WITH s AS (SELECT *, greatest(0, processed - hidden) AS valid FROM ({CLASS_STATS})),
t AS (SELECT CASE WHEN GROUPING(municipality) = 1 THEN 'region:all' ELSE 'municipality:' || municipality END AS scope, sum(whole) AS whole, sum(processed) AS processed,
  sum(valid) AS valid, sum(hidden + greatest(0, whole - processed)) AS nd, sum(green) AS green, sum(artificial) AS artificial FROM s GROUP BY ROLLUP (municipality)),
c AS (SELECT CASE WHEN GROUPING(municipality) = 1 THEN 'region:all' ELSE 'municipality:' || municipality END AS scope, class_code, sum(area_m2) AS a
  FROM area_fact JOIN zone USING (sector_id) WHERE class_code <> 7 GROUP BY class_code, ROLLUP (municipality)),
b AS (SELECT *, row_number() OVER (PARTITION BY scope ORDER BY a DESC, class_code) AS rn FROM c)
SELECT t.scope, {r6('whole / 10000')} AS zone_ha, {r6('processed / 10000')} AS processed_ha, {r6('valid / 10000')} AS valid_ha, {r6('nd / 10000')} AS no_data_ha,
  {r6('green / 10000')} AS green_ha, {r6('artificial / 10000')} AS artificial_ha, b.class_code AS dominant_code, {r6('valid / whole * 100')} AS coverage_pct,
  {r6('green / valid * 100')} AS green_pct, {r6('artificial / valid * 100')} AS artificial_pct FROM t LEFT JOIN b ON b.scope = t.scope AND rn = 1"""))
def a08(spark, d):
    return R.rollup_class_stats(class_stats(spark, d), V.area_facts(spark, d), V.zones(spark, d), HIDDEN)


@query("a08_rollup_breakdown", sql("area_fact zone", f"""
WITH s AS (SELECT *, greatest(0, processed - hidden) AS valid FROM ({CLASS_STATS})),
t AS (SELECT CASE WHEN GROUPING(municipality) = 1 THEN 'region:all' ELSE 'municipality:' || municipality END AS scope, sum(valid) AS valid, sum(green) AS green,
  sum(artificial) AS artificial FROM s GROUP BY ROLLUP (municipality)),
f AS (SELECT CASE WHEN GROUPING(municipality) = 1 THEN 'region:all' ELSE 'municipality:' || municipality END AS scope, class_code, sum(area_m2) AS a
  FROM area_fact JOIN zone USING (sector_id) GROUP BY class_code, ROLLUP (municipality)),
r AS (SELECT t.scope, c.grp, c.class_code, coalesce(f.a, 0) AS a, CASE c.grp WHEN 'green' THEN green WHEN 'artificial' THEN artificial ELSE 0 END AS g, valid, c.keep
  FROM t, (VALUES ('green', 1, true), ('green', 2, true), ('green', 99, true), ('artificial', 3, false), ('artificial', 4, false), ('artificial', 98, false),
  ('other', 5, false), ('other', 6, false)) c(grp, class_code, keep) LEFT JOIN f ON f.scope = t.scope AND f.class_code = c.class_code)
SELECT scope, grp, class_code, {r6('a / 10000')} AS area_ha, {r6('CASE WHEN g > 0 THEN a / g * 100 ELSE 0 END')} AS group_pct,
  {r6('CASE WHEN valid > 0 THEN a / valid * 100 ELSE 0 END')} AS pct FROM r WHERE keep OR a > 0"""))
def a08b(spark, d):
    groups = {"green": ([1, 2, 99], True), "artificial": ([3, 4, 98], False)}
    return R.rollup_breakdown(V.area_facts(spark, d), a08(spark, d), V.zones(spark, d), groups, HIDDEN)


LC_SCOPES = f"""SELECT obs_id, CASE WHEN GROUPING(municipality) = 1 THEN 'region:all' ELSE 'municipality:' || municipality END AS scope, code, sum(area_ha) AS area_ha
  FROM ({LC_AREAS}) JOIN zone USING (sector_id) GROUP BY obs_id, code, ROLLUP (municipality)"""


@query("a09_rollup_classes", sql("pz zone", f"""
WITH f AS ({LC_SCOPES}), c AS (SELECT *, row_number() OVER (PARTITION BY obs_id, scope ORDER BY {r6('area_ha')} DESC, code) AS rn FROM f WHERE code NOT IN (0, 254))
SELECT obs_id, scope, code, {r6('area_ha')} AS area_ha, {r6('area_ha / sum(area_ha) OVER (PARTITION BY obs_id, scope) * 100')} AS pct,
  first_value(code) OVER (PARTITION BY obs_id, scope ORDER BY rn) AS dominant_code FROM c"""))
def a09b(spark, d):
    areas = R.scope_areas(TB.with_municipality(land_cover(spark, d), V.zones(spark, d)), ("obs_id",))
    # areas that agree to six decimals are ties, so that the order of summing does not decide
    dominant = Z.land_cover_stats(areas.withColumn("area_ha", half_up(F.col("area_ha"), 6)), ["obs_id", "scope"]).select("obs_id", "scope", "dominant_code")
    return Z.land_cover_classes(areas, ["obs_id", "scope"]).join(dominant, ["obs_id", "scope"])


@query("a09_rollup_land_cover", sql("pz zone", f"""
WITH lc AS ({LC_AREAS}), s AS ({LC_STATS}),
t AS (SELECT obs_id, CASE WHEN GROUPING(municipality) = 1 THEN 'region:all' ELSE 'municipality:' || municipality END AS scope, sum(total_ha) AS a, sum(classified_ha) AS b,
  sum(unclassifiable_ha) AS c, sum(vegetation_ha) AS e, sum(built_up_ha) AS f FROM s JOIN zone USING (sector_id) GROUP BY obs_id, ROLLUP (municipality))
SELECT obs_id, scope, {r6('a')} AS total_ha, {r6('b')} AS classified_ha, {r6('c')} AS unclassifiable_ha, {r6('e')} AS vegetation_ha, {r6('f')} AS built_up_ha,
  {r6('CASE WHEN b > 0 THEN e / b * 100 ELSE 0 END')} AS vegetation_pct, {r6('CASE WHEN b > 0 THEN f / b * 100 ELSE 0 END')} AS built_up_pct FROM t"""))
def a09(spark, d):
    stats = Z.land_cover_stats(land_cover(spark, d), ["obs_id", "sector_id"])
    return R.rollup_land_cover(TB.with_municipality(stats, V.zones(spark, d)), ("obs_id",))


@query("a11_region_surface_stats", sql("zpx", f"""
WITH b AS ({BINARY_SUMS}), t AS (SELECT obs_id, sum(complete_ha) AS c, sum(valid_ha) AS v, sum(no_data_ha) AS n, sum(sealed_ha) AS s, sum(unsealed_ha) AS u FROM b GROUP BY obs_id)
SELECT obs_id, {r6('c')} AS complete_ha, {r6('v')} AS valid_ha, {r6('n')} AS no_data_ha, {r6('s')} AS sealed_ha, {r6('u')} AS unsealed_ha,
  {r6('v / c * 100')} AS valid_pct, {r6('n / c * 100')} AS no_data_pct, {r6('s / c * 100')} AS sealed_pct, {r6('u / c * 100')} AS unsealed_pct FROM t"""))
def a11(spark, d):
    return R.region_surface_stats(Z.binary_stats(zoned(spark, d), zones(spark, d), CELL_HA, keys=("obs_id",)), ("obs_id",))


# --- Distributions --------------------------------------------------------------------------------


BRIDGE = """(VALUES (1, 'family:low'), (2, 'family:low'), (3, 'family:high'), (4, 'family:high'), (1, 'class:1'), (2, 'class:2'), (3, 'class:3'),
  (4, 'class:4')) s(code, series) ON s.code = pz.code"""
SCOPES = "unnest(['region:all', 'municipality:' || municipality, 'sector:' || sector_id]) AS scope"
DIST = f"SELECT obs_id, status, temp_c AS t, series, {SCOPES} FROM pz JOIN {BRIDGE}"


@query("a14_scope_distributions", sql("pz", f"""
SELECT obs_id, scope, series, count(*) FILTER (status = 1) AS clear_n, count(*) FILTER (status = 2) AS cloud_n, count(*) FILTER (status = 0) AS missing_n,
  count(*) FILTER (status = 1 AND t < 15) AS underflow_n, count(*) FILTER (status = 1 AND t > 50) AS overflow_n, {r6('avg(t) FILTER (status = 1)')} AS mean_c,
  {r6('quantile_cont(t, 0.1) FILTER (status = 1)')} AS p10_c, {r6('quantile_cont(t, 0.5) FILTER (status = 1)')} AS median_c,
  {r6('quantile_cont(t, 0.9) FILTER (status = 1)')} AS p90_c FROM ({DIST}) GROUP BY obs_id, scope, series"""))
def a14(spark, d):
    return Z.scope_distributions(zoned(spark, d, spread(V.pixels(spark, d))), ("obs_id",), {"low": ["1", "2"], "high": ["3", "4"]})


@query("a14_scope_bins", sql("pz px zone", f"""
WITH h AS (SELECT obs_id, scope, series, CAST(least(floor((t - 15.0E0) / 0.5E0), 69) AS INT) AS bin, count(*) AS n FROM ({DIST}) WHERE status = 1 AND t BETWEEN 15 AND 50 GROUP BY ALL),
k AS (SELECT o.obs_id, scope, series, CAST(i AS INT) AS bin FROM (SELECT DISTINCT obs_id FROM px) o, (SELECT DISTINCT {SCOPES} FROM zone) z,
  (VALUES ('family:low'), ('family:high'), ('family:none'), ('class:1'), ('class:2'), ('class:3'), ('class:4'), ('class:9')) s(series), generate_series(0, 69) t(i))
SELECT obs_id, scope, series, bin, coalesce(n, 0) AS n FROM k LEFT JOIN h USING (obs_id, scope, series, bin)"""))
def a14c(spark, d):
    """Series and scopes without a pixel have bins too."""
    return Z.scope_bins(zoned(spark, d), V.zones(spark, d), {"low": ["1", "2"], "high": ["3", "4"], "none": ["9"]}, ("obs_id",))


@query("a14_assigned_pixels", sql("pz", f"SELECT obs_id, scope, count(*) AS n FROM (SELECT obs_id, {SCOPES} FROM pz) GROUP BY obs_id, scope"))
def a14b(spark, d):
    counts = zoned(spark, d).groupBy("obs_id", "municipality", "sector_id").agg(F.count("*").alias("n"))
    return TB.scope_keys(counts).groupBy("obs_id", "scope").agg(F.sum("n").alias("n"))


BINNED = """SELECT obs_id, sector_id, CAST(least(floor((temp_c - 15.0E0) / 0.5E0), 69) AS INT) AS bin, count(*) AS n FROM pz
WHERE status = 1 AND temp_c BETWEEN 15 AND 50 GROUP BY ALL"""


@query("a15_histogram", sql("pz", BINNED))
def a15(spark, d):
    return Z.histogram(zoned(spark, d).where("status = 1"), ["obs_id", "sector_id"])


@query("a16_normalise_histogram", sql("pz", f"""
WITH b AS ({BINNED}), t AS (SELECT obs_id, sector_id, count(*) AS clear_n FROM pz WHERE status = 1 GROUP BY obs_id, sector_id HAVING count(*) >= 315),
p AS (SELECT b.*, n / CAST(clear_n AS DOUBLE) * 100.0E0 AS pct FROM b JOIN t USING (obs_id, sector_id))
SELECT obs_id, sector_id, bin, n, {r6('pct')} AS pct, greatest(1, ceil(max(pct) OVER (PARTITION BY obs_id, sector_id) / 5.0E0) * 5.0E0) AS axis_max FROM p"""))
def a16(spark, d):
    clear = zoned(spark, d).where("status = 1")
    totals = clear.groupBy("obs_id", "sector_id").agg(F.count("*").alias("clear_n"))
    return Z.normalise_histogram(Z.histogram(clear, ["obs_id", "sector_id"]), totals, ["obs_id", "sector_id"], minimum=315)


# --- Parcels --------------------------------------------------------------------------------------

FRAGMENTS = """SELECT c_nationkey AS sector_id, o_custkey AS parcel_id, CASE WHEN c_custkey % 4 = 0 THEN '  ' WHEN c_custkey % 4 = 1 THEN NULL ELSE c_mktsegment END AS crop_group,
  CAST(round(o_totalprice * 100) AS BIGINT) AS cents, round(o_totalprice * 100) / 10000000.0E0 AS area_ha FROM orders JOIN customer ON o_custkey = c_custkey"""


def fragments(spark, d):
    """Areas as decimals, whose sums are exact in any order."""
    k = F.col("c_custkey") % 4
    group = F.when(k == 0, "  ").when(k != 1, F.col("c_mktsegment"))
    return (V.table(spark, d, "orders").join(V.table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
            .select(F.col("c_nationkey").alias("sector_id"), F.col("o_custkey").alias("parcel_id"), group.alias("crop_group"),
                    (F.col("o_totalprice").cast("decimal(18,2)") / 100000).cast("decimal(18,7)").alias("area_ha")))


@query("a17_parcel_stats", sql("zone", f"""
WITH f AS ({FRAGMENTS}), s AS (SELECT sector_id, CAST(sum(cents) AS DOUBLE) / 10000000.0E0 AS a, count(DISTINCT parcel_id) AS n FROM f GROUP BY sector_id)
SELECT z.sector_id, {COMPLETE.replace('sector_id', 'z.sector_id')} AS complete_ha, {r6('coalesce(a, 0)')} AS parcel_ha, coalesce(n, 0) AS n_parcels,
  {r6('coalesce(a, 0) / ' + COMPLETE.replace('sector_id', 'z.sector_id') + ' * 100')} AS parcel_pct FROM zone z LEFT JOIN s USING (sector_id)"""))
def a17(spark, d):
    return R.parcel_stats(fragments(spark, d), zones(spark, d))


@query("a17_crop_groups", f"""
WITH f AS ({FRAGMENTS}), s AS (SELECT sector_id, CASE WHEN trim(coalesce(crop_group, '')) = '' THEN 'Overige gewassen' ELSE crop_group END AS crop_group, sum(cents) AS c FROM f GROUP BY ALL),
d AS (SELECT *, CAST(c AS DOUBLE) / 10000000.0E0 AS a, CAST(sum(c) OVER (PARTITION BY sector_id) AS DOUBLE) / 10000000.0E0 AS whole FROM s)
SELECT sector_id, crop_group, {r6('a')} AS area_ha, {r6('a / whole * 100')} AS group_pct FROM d""")
def a17b(spark, d):
    return R.crop_group_stats(fragments(spark, d))


# --- User layers, profiles, series ----------------------------------------------------------------


@query("a18_user_layer_stats", sql("zpx", f"""
SELECT obs_id, sector_id, {COMPLETE} AS zone_ha, {r6('min(v)')} AS minimum, {r6('max(v)')} AS maximum, {r6('avg(v)')} AS mean, {r6('median(v)')} AS median,
  count(v) * {HA} AS valid_ha FROM (SELECT *, CASE WHEN status = 1 THEN temp_c * 2 - b04 END AS v FROM zpx) GROUP BY obs_id, sector_id"""))
def a18(spark, d):
    value = F.when(F.col("status") == 1, F.col("temp_c") * 2 - F.col("b04"))
    return Z.user_layer_stats(zoned(spark, d), value, zones(spark, d), CELL_HA, keys=("obs_id",))


@query("a18_user_class_stats", sql("zpx", f"""
SELECT obs_id, sector_id, k.value, count(*) FILTER (code = k.value) * {HA} AS area_ha,
  {r6('CASE WHEN count(*) FILTER (code <> 0) > 0 THEN count(*) FILTER (code = k.value) / CAST(count(*) FILTER (code <> 0) AS DOUBLE) * 100 ELSE 0 END')} AS pct
FROM zpx, (VALUES (1), (2), (9)) k(value) GROUP BY obs_id, sector_id, k.value"""))
def a18b(spark, d):
    return Z.user_class_stats(zoned(spark, d), F.when(F.col("code") != 0, F.col("code")), [1, 2, 9], CELL_HA, V.zones(spark, d), keys=("obs_id",))


@query("a19_dissolve", sql("zone", """
SELECT municipality, sum((c1 - c0) * (r1 - r0) * 1.0E0) AS area, min(c0) * 1.0E0 AS x0, min(r0) * 1.0E0 AS y0, max(c1) * 1.0E0 AS x1, max(r1) * 1.0E0 AS y1 FROM zone GROUP BY municipality"""))
def a19(spark, d):
    z = V.zone_polygons(spark, d).withColumn("area", GE.polygon_area(F.col("geom")))
    return GE.dissolve(z, "municipality", "area")


@query("a19_collection_bounds", sql("poly", """
SELECT (min(cx - r)) * 1.0E0 AS x0, min(cy - r) * 1.0E0 AS y0, max(cx + r) * 1.0E0 AS x1, max(cy + r) * 1.0E0 AS y1 FROM poly WHERE class_code < 12"""))
def a19b(spark, d):
    return GE.collection_bounds(V.diamond_polygons(spark, d).where("class_code < 12"))


@query("a20_count_checks", """
WITH a AS (SELECT c_nationkey, c_mktsegment, count(*) AS actual FROM customer GROUP BY ALL),
e AS (SELECT s_nationkey AS c_nationkey, 'BUILDING' AS c_mktsegment, count(*) AS expected FROM supplier GROUP BY ALL)
SELECT c_nationkey, c_mktsegment, coalesce(actual, 0) AS actual, coalesce(expected, 0) AS expected FROM a FULL JOIN e USING (c_nationkey, c_mktsegment)
WHERE coalesce(actual, 0) <> coalesce(expected, 0)""")
def a20(spark, d):
    expected = V.table(spark, d, "supplier").groupBy(F.col("s_nationkey").alias("c_nationkey"), F.lit("BUILDING").alias("c_mktsegment")).agg(
        F.count("*").alias("expected"))
    return R.count_checks(V.table(spark, d, "customer"), ["c_nationkey", "c_mktsegment"], expected)


@query("a21_scenes_by_date", sql("scene", f"""
SELECT d, {r6('max(CASE WHEN scene_id % 50 = 0 THEN 100 ELSE cloud_pct END)')} AS max_cloud, count(*) AS n_products, string_agg(DISTINCT tile::VARCHAR, ',' ORDER BY tile::VARCHAR) AS tiles
FROM scene GROUP BY d"""))
def a21(spark, d):
    s = V.scenes(spark, d).withColumn("cloud_pct", F.when(F.col("scene_id") % 50 != 0, F.col("cloud_pct")))
    return SC.scenes_by_date(s).withColumn("tiles", F.array_join(F.col("tiles").cast("array<string>"), ","))


@query("a22_candidate_quality", sql("px", f"""
SELECT obs_id, row_i, {r6('least(1, c / 0.9E0) * 100')} AS coverage_pct, {r6('CASE WHEN c > 0 THEN k / c * 100 ELSE 100 END')} AS cloud_pct FROM
(SELECT obs_id, row_i, avg(CASE WHEN status <> 0 THEN 1.0E0 ELSE 0 END) AS c, avg(CASE WHEN status = 2 THEN 1.0E0 ELSE 0 END) AS k FROM px GROUP BY obs_id, row_i)"""))
def a22(spark, d):
    return SC.candidate_quality(V.pixels(spark, d), ["obs_id", "row_i"], F.col("status") != 0, F.col("status") == 2, 0.9)


NDVI = "CASE WHEN abs(b08 + b04) > 2.220446049250313e-16 THEN (b08 - b04) / (b08 + b04) END"
BIN = "CAST(least(greatest(floor((ndvi + 1.0E0) / 0.001E0 + 0.5E0), 0), 2000) AS INT)"


@query("a25_distribution_summary", sql("px", f"""
WITH h AS (SELECT code, {BIN} AS b, count(*) AS n FROM (SELECT *, {NDVI} AS ndvi FROM px) WHERE ndvi IS NOT NULL GROUP BY ALL),
c AS (SELECT *, sum(n) OVER (PARTITION BY code ORDER BY b) AS upto, sum(n) OVER (PARTITION BY code) AS total FROM h)
SELECT code, CAST(max(total) AS BIGINT) AS n, {', '.join(f"floor((min(CASE WHEN upto >= greatest(1, ceil(total * {p}E0)) THEN b END) * 0.001E0 - 1) * 1000.0E0 + 0.5E0) / 1000.0E0 AS {name}"
  for name, p in (('p05', 0.05), ('p25', 0.25), ('median', 0.5), ('p75', 0.75), ('p95', 0.95)))} FROM c GROUP BY code"""))
def a25(spark, d):
    from zonemill.operators import quantiles as Q
    px = V.pixels(spark, d).withColumn("ndvi", P.ndvi(F.col("b04"), F.col("b08"))).where("ndvi IS NOT NULL")
    hist = px.groupBy("code", P.ndvi_bin(F.col("ndvi")).alias("b")).agg(F.count("*").alias("n"))
    names = {"p05": 0.05, "p25": 0.25, "median": 0.5, "p75": 0.75, "p95": 0.95}
    return Q.histogram_quantiles(hist, ["code"], "b", "n", names).select("code", "n", *[P.bin_value(F.col(c)).alias(c) for c in names])


QUANTILES = ", ".join(f"floor((min(CASE WHEN {k}b + {kind} >= greatest(1, ceil(n{k} * {p}E0)) THEN b END) * 0.001E0 - 1) * 1000.0E0 + 0.5E0) / 1000.0E0 AS {name}_{q}"
                      for name, kind, k in (("positive", "pos", "p"), ("negative", "neg", "n")) for q, p in M.SAMPLE_QUANTILES.items())
QUANTILE_NAMES = ", ".join(f"{name}_{q}" for name in ("positive", "negative") for q in M.SAMPLE_QUANTILES)


@query("a26_calibrate_threshold", sql("px", f"""
WITH h AS (SELECT obs_id, {BIN} AS b, count(*) FILTER (code = 1) AS pos, count(*) FILTER (code = 2) AS neg FROM
  (SELECT *, CASE WHEN code = 1 THEN least(1, n0 + 0.2E0) ELSE n0 END AS ndvi FROM (SELECT *, {NDVI} AS n0 FROM px) WHERE n0 IS NOT NULL) WHERE code IN (1, 2) GROUP BY ALL),
g AS (SELECT obs_id, i AS b, coalesce(pos, 0) AS pos, coalesce(neg, 0) AS neg FROM (SELECT DISTINCT obs_id FROM h), generate_series(0, 2000) t(i) LEFT JOIN h ON h.obs_id = h.obs_id AND h.b = t.i),
r AS (SELECT *, sum(pos) OVER (PARTITION BY obs_id) AS np, sum(neg) OVER (PARTITION BY obs_id) AS nn,
  coalesce(sum(pos) OVER (PARTITION BY obs_id ORDER BY b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pb,
  coalesce(sum(neg) OVER (PARTITION BY obs_id ORDER BY b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS nb FROM g),
j AS (SELECT *, CAST(np - pb AS DOUBLE) / np AS se, CAST(nb AS DOUBLE) / nn AS sp FROM r),
m AS (SELECT *, se + sp - 1.0E0 AS y, max(se + sp - 1.0E0) OVER (PARTITION BY obs_id) AS best FROM j),
t AS (SELECT *, row_number() OVER (PARTITION BY obs_id ORDER BY b) AS rn, count(*) OVER (PARTITION BY obs_id) AS k FROM m WHERE y >= best - 1e-12),
u AS (SELECT obs_id, sum(pos * (nb + neg * 0.5E0)) / (max(np) * max(nn)) AS auc, {QUANTILES} FROM r GROUP BY obs_id)
SELECT obs_id, {QUANTILE_NAMES}, CAST(np AS BIGINT) AS n_pos, CAST(nn AS BIGINT) AS n_neg, floor((b * 0.001E0 - 1) * 1000.0E0 + 0.5E0) / 1000.0E0 AS threshold, {r6('best')} AS youden_j,
  {r6('se')} AS sensitivity, {r6('sp')} AS specificity, {r6('(se + sp) / 2')} AS balanced_accuracy, {r6('1 - sp')} AS false_positive_rate, {r6('auc')} AS auc, auc < 0.7 AS overlap_warning
FROM t JOIN u USING (obs_id) WHERE rn = floor((k - 1) / 2.0E0) + 1""".replace("ON h.obs_id = h.obs_id AND h.b = t.i)", "ON h.b = t.i AND h.obs_id = o.obs_id)").replace(
    "FROM (SELECT DISTINCT obs_id FROM h), generate_series", "FROM (SELECT DISTINCT obs_id FROM h) o CROSS JOIN generate_series").replace("SELECT obs_id, i AS b", "SELECT o.obs_id, i AS b")))
def a26(spark, d):
    index = P.ndvi(F.col("b04"), F.col("b08"))
    px = V.pixels(spark, d).where("code IN (1, 2)").withColumn("ndvi", F.when(F.col("code") == 1, F.least(F.lit(1.0), index + 0.2)).otherwise(index))
    samples = px.where(index.isNotNull()).withColumn("sample", F.when(F.col("code") == 1, "positive").otherwise("negative"))
    # the smallest stand-in tables have less than the usual minimum of samples
    found = Z.calibrate_threshold(samples, ("obs_id",), minimum=100)
    flat = [F.col(f"{name}.{q}").alias(f"{name}_{q}") for name in ("positive", "negative") for q in M.SAMPLE_QUANTILES]
    return found.select("*", *flat).drop("positive", "negative")


@query("a28_profile", sql("px", f"""
SELECT obs_id, code, count(v) AS valid_n, {r6('count(v) / CAST(count(*) AS DOUBLE) * 100')} AS valid_pct, {r6('min(v)')} AS minimum, {r6('max(v)')} AS maximum,
  count(v) / CAST(count(*) AS DOUBLE) * 100 >= 50 AS usable FROM (SELECT *, CASE WHEN status = 1 THEN temp_c END AS v FROM px) GROUP BY obs_id, code"""))
def a28(spark, d):
    px = V.pixels(spark, d).withColumn("v", F.when(F.col("status") == 1, F.col("temp_c")))
    return Z.profile(px, "v", ("obs_id", "code"))


@query("a29_complete_series", sql("px0", """
WITH v AS (SELECT row_i, col_i, obs_id, code0 FROM px0 WHERE code0 <> 2)
SELECT row_i, col_i, string_agg(code0::VARCHAR, ',' ORDER BY obs_id) AS series FROM v GROUP BY row_i, col_i HAVING count(*) = (SELECT max(obs_id) + 1 FROM px0)"""))
def a29(spark, d):
    base = V.baseline(spark, d)
    n_dates = base.agg((F.max("obs_id") + 1).alias("n")).scalar()
    px = base.withColumn("v", F.when(F.col("code0") != 2, F.col("code0")))
    return Z.complete_series(px, n_dates, "v").withColumn("series", F.array_join(F.col("series").cast("array<string>"), ","))


@query("a30_present_classes", sql("area_fact", """
SELECT k.code, k.code IN (SELECT class_code FROM area_fact WHERE area_m2 > 0) AS present FROM (SELECT CAST(i AS INT) AS code FROM generate_series(1, 9) t(i)) k"""))
def a30(spark, d):
    dim = spark.range(1, 10).select(F.col("id").cast("int").alias("code"))
    return Z.present_classes(V.area_facts(spark, d).withColumnRenamed("class_code", "code"), dim, area="area_m2")


@query("a31_observation_profile", sql("px", f"""
WITH v AS (SELECT obs_id, CASE WHEN status = 1 THEN temp_c END AS v FROM px WHERE col_i BETWEEN 10 AND 79),
s AS (SELECT obs_id, avg(CASE WHEN v IS NOT NULL THEN 1.0E0 ELSE 0 END) AS share, min(v) AS lo, max(v) AS hi, count(v) AS total, median(v) AS med FROM v GROUP BY obs_id)
SELECT obs_id, CAST(least(floor((v - lo) / ((hi - lo) / 20)), 19) AS INT) AS bin, count(*) AS n, {r6('max(share)')} AS valid_share, {r6('max(med)')} AS median,
  {r6('count(*) / (max(total) * ((max(hi) - max(lo)) / 20))')} AS density FROM v JOIN s USING (obs_id) WHERE v IS NOT NULL GROUP BY ALL"""))
def a31(spark, d):
    px = V.pixels(spark, d).where("col_i BETWEEN 10 AND 79")
    return Z.observation_profile(px, "temp_c", F.col("status") == 1, 20, ["obs_id"])


@query("a32_composition", sql("area_fact", f"""
WITH t AS (SELECT sector_id, sum(area_m2) * 0.9E0 AS total FROM area_fact GROUP BY sector_id),
r AS (SELECT t.sector_id, k.part, coalesce(f.area_m2, 0) AS a, total FROM t CROSS JOIN (VALUES (1), (5), (99)) k(part) LEFT JOIN area_fact f ON f.sector_id = t.sector_id AND f.class_code = k.part)
SELECT sector_id, part::VARCHAR AS part, {r6('a')} AS area_ha FROM r UNION ALL SELECT sector_id, 'rest', {r6('greatest(0, max(total) - sum(a))')} FROM r GROUP BY sector_id"""))
def a32(spark, d):
    facts = V.area_facts(spark, d)
    totals = facts.groupBy("sector_id").agg((F.sum("area_m2") * 0.9).alias("total"))
    return Z.composition(facts.join(totals, "sector_id"), ["sector_id"], [1, 5, 99], "total", "class_code", "area_m2")


@query("a33_observation_metadata", """
SELECT CAST(o_orderdate AS DATE) AS d, min(o_orderdate) AS acquired_at, string_agg(DISTINCT 'landsat-' || (8 + o_custkey % 2), ',' ORDER BY 'landsat-' || (8 + o_custkey % 2)) AS satellites,
  string_agg(DISTINCT (198 + o_custkey % 3) || '/25', ',' ORDER BY (198 + o_custkey % 3) || '/25') AS path_rows, string_agg(o_orderkey::VARCHAR, ',' ORDER BY o_orderkey) AS scene_ids
FROM orders GROUP BY CAST(o_orderdate AS DATE)""")
def a33(spark, d):
    c = F.col("o_custkey")
    scenes = V.table(spark, d, "orders").select(
        F.to_date("o_orderdate").alias("d"), F.col("o_orderdate").alias("acquired_at"), F.concat(F.lit("landsat-"), (8 + c % 2).cast("string")).alias("platform"),
        F.concat((198 + c % 3).cast("string"), F.lit("/25")).alias("path_row"), F.col("o_orderkey").alias("scene_id"))
    out = SC.observation_metadata(scenes)
    return out.select("d", "acquired_at", *[F.array_join(F.col(n).cast("array<string>"), ",").alias(n) for n in ("satellites", "path_rows", "scene_ids")])
