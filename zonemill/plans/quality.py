"""Data-quality checks on the driver tables; the thresholds are set so that there is something to find."""

from __future__ import annotations

from pyspark.sql import functions as F

from zonemill.functions import scores as S
from zonemill.operators import geometry as GE
from zonemill.operators import quality as QU
from zonemill.operators import zonal as Z
from zonemill.plans import standins as V
from zonemill.plans.pixels import DENSITY, HA, class_stats, CLASS_STATS, diamond_zones, fragments, FRAGMENTS, observations, weighted_pixels, zoned
from zonemill.plans.registry import query
from zonemill.plans.standins import CELL_HA, r6, sql
from zonemill.sources import provenance as PR


def tight_zones(spark, d):
    return V.zones(spark, d).select("sector_id", (30.0 + F.col("sector_id")).alias("complete_ha"))


@query("q01_unreconciled", sql("zpx", f"""
WITH b AS (SELECT obs_id, sector_id, 30.0E0 + sector_id AS complete_ha, count(*) FILTER (code IN (0, 1)) * {HA} AS v FROM zpx GROUP BY obs_id, sector_id),
g AS (SELECT *, v + greatest(0, complete_ha - v) - complete_ha AS gap FROM b)
SELECT obs_id, sector_id, {r6('gap')} AS gap FROM g WHERE abs(gap) > greatest(0.01E0, complete_ha * 0.005E0)"""))
def q01(spark, d):
    stats = Z.binary_stats(zoned(spark, d), tight_zones(spark, d), CELL_HA, keys=("obs_id",), expected=observations(spark, d))
    return QU.unreconciled(stats, ["sealed_ha", "unsealed_ha", "no_data_ha"], "complete_ha").select("obs_id", "sector_id", "gap")


@query("q01_density_rules", sql("px poly", f"""{DENSITY},
t AS (SELECT obs_id, poly_id, whole / 2 AS whole, valid, present, vw FROM a)
SELECT obs_id, poly_id, 'areas' AS rule FROM t WHERE NOT abs(valid + greatest(0, whole - valid) - whole) <= greatest(0.01E0, whole * 0.005E0)
UNION ALL SELECT obs_id, poly_id, 'crown' FROM t WHERE NOT vw / 100.0E0 * 0.0025E0 <= present + 1e-9"""))
def q01b(spark, d):
    px, weights = weighted_pixels(spark, d)
    px = px.withColumn("value", F.col("dn") % 128)
    zones = diamond_zones(spark, d).withColumn("complete_ha", F.col("complete_ha") / 2)
    stats = Z.density_stats(px, zones, CELL_HA / 100, zone="poly_id", keys=("obs_id",), expected=observations(spark, d), weights=weights)
    return QU.density_violations(stats, ["obs_id", "poly_id"])


@query("q02_temperature_areas", sql("zpx", f"""
WITH b AS (SELECT obs_id, sector_id, 60.0E0 + sector_id AS whole, count(*) FILTER (status = 1) * {HA} AS c, count(*) FILTER (status = 2) * {HA} AS o FROM zpx GROUP BY obs_id, sector_id),
g AS (SELECT *, c + o + greatest(0, whole - c - o) - whole AS gap FROM b)
SELECT obs_id, sector_id, {r6('gap')} AS gap FROM g WHERE abs(gap) > greatest(0.01E0, whole * 0.005E0)"""))
def q02(spark, d):
    zones = V.zones(spark, d).select("sector_id", (60.0 + F.col("sector_id")).alias("complete_ha"))
    px = zoned(spark, d).withColumn("w", F.lit(1)).withColumn("uncertainty", F.col("dn") * 0.01)
    stats = Z.temperature_stats(px, zones, CELL_HA, keys=("obs_id",), expected=observations(spark, d))
    return QU.unreconciled(stats, ["clear_ha", "cloud_ha", "missing_ha"], "complete_ha").select("obs_id", "sector_id", "gap")


@query("q03_score_range", """
WITH l AS (SELECT p_partkey, 'final' AS score, CASE WHEN p_size = 50 THEN 9999 ELSE p_size / 4.0E0 END AS value FROM part UNION ALL SELECT p_partkey, 'heat', p_retailprice / 150 FROM part)
SELECT * FROM l WHERE value <> 9999 AND (value < 0 OR value > 10 OR (score = 'final' AND value <> floor(value)))""".replace("SELECT * FROM l", f"SELECT p_partkey, score, {r6('value')} AS value FROM l"))
def q03(spark, d):
    p = V.table(spark, d, "part").select("p_partkey", F.when(F.col("p_size") == 50, 9999.0).otherwise(F.col("p_size") / 4.0).alias("final"),
                                         (F.col("p_retailprice") / 150).alias("heat"))
    return QU.score_range(p, "p_partkey", ["final", "heat"], ("final",))


@query("q04_count_mismatch", """
SELECT c_nationkey, c_mktsegment, count(*) AS actual, CAST(CASE c_mktsegment WHEN 'BUILDING' THEN 12 WHEN 'MACHINERY' THEN 11 ELSE 0 END AS BIGINT) AS expected FROM customer GROUP BY ALL
HAVING count(*) <> CASE c_mktsegment WHEN 'BUILDING' THEN 12 WHEN 'MACHINERY' THEN 11 ELSE 0 END""")
def q04(spark, d):
    return QU.count_mismatch(V.table(spark, d, "customer"), ["c_nationkey"], {"BUILDING": 12, "MACHINERY": 11}, "c_mktsegment")


@query("q05_coverage", sql("area_fact zone", f"""
WITH s AS ({CLASS_STATS}), c AS (SELECT sector_id, processed / whole * 100 AS pct FROM s WHERE processed > 0)
SELECT zone.sector_id, {r6('pct')} AS coverage_pct, CASE WHEN pct IS NULL THEN 'absent' ELSE 'insufficient' END AS problem FROM zone LEFT JOIN c USING (sector_id) WHERE pct IS NULL OR pct < 6.5E0"""))
def q05(spark, d):
    return QU.coverage_violations(class_stats(spark, d).where("processed_ha > 0"), V.zones(spark, d), minimum_pct=6.5)


@query("q05_area_disagreement", sql("poly", """
WITH r AS (SELECT poly_id, r, (SELECT count(*) FROM generate_series(-10, 10) a(i), generate_series(-10, 10) b(j) WHERE abs(i + 0.5E0) + abs(j + 0.5E0) <= r
  AND cx + i BETWEEN 0 AND 99 AND cy + j BETWEEN 0 AND 99) AS n FROM poly)
SELECT poly_id, n * 1.0E0 AS raster, 2.0E0 * r * r AS exact FROM r WHERE n > 0 AND NOT abs(1 - 2.0E0 * r * r / n) <= 0.25"""))
def q05b(spark, d):
    spans = GE.rasterize(V.diamond_polygons(spark, d), ["poly_id"], V.GRID)
    raster = spans.groupBy("poly_id").agg(F.sum(F.col("c1") - F.col("c0") + 1).cast("double").alias("raster"))
    exact = V.diamond_polygons(spark, d).select("poly_id", GE.polygon_area(F.col("geom")).alias("exact"))
    return QU.area_disagreement(raster.join(exact, "poly_id"), "raster", "exact", 0.25)


@query("q06_geometry", """
WITH f AS (SELECT CAST(s_nationkey AS VARCHAR) AS id, s_suppkey % 3 AS k FROM supplier)
SELECT id AS feature_id, 'type' AS rule FROM f WHERE k = 1 UNION ALL SELECT id, 'empty' FROM f WHERE k = 2
UNION ALL SELECT id, 'duplicate' FROM f GROUP BY id HAVING count(*) > 1""")
def q06(spark, d):
    k = F.col("poly_id") % 3
    rows = V.diamond_polygons(spark, d).select(
        F.col("class_code").cast("string").alias("feature_id"), F.when(k == 1, "Point").otherwise("MultiPolygon").alias("kind"),
        F.when(k != 2, F.col("geom")).alias("geom"))
    return QU.geometry_violations(rows)


@query("q07_contract_rules", """
WITH o AS (SELECT o_orderkey, o_orderstatus IN ('F', 'O') AS a, year(o_orderdate) BETWEEN 1996 AND 2000 AS b, o_totalprice > 5000 AS c FROM orders)
SELECT o_orderkey, 'status' AS rule FROM o WHERE NOT a UNION ALL SELECT o_orderkey, 'year' FROM o WHERE NOT b UNION ALL SELECT o_orderkey, 'median' FROM o WHERE NOT c""")
def q07(spark, d):
    return QU.evaluate_rules(V.table(spark, d, "orders"), ["o_orderkey"], {
        "status": F.col("o_orderstatus").isin("F", "O"), "year": F.year("o_orderdate").between(1996, 2000), "median": F.col("o_totalprice") > 5000})


@query("q07_fiscal_contract", sql("fiscal", """
WITH v AS (SELECT sector_id, year, raw_value, CASE WHEN raw_value IN ('', '.', 'C') THEN NULL ELSE TRY_CAST(raw_value AS DOUBLE) END AS v FROM fiscal)
SELECT sector_id, year, raw_value, 'range' AS rule FROM v WHERE NOT coalesce(v >= 0, raw_value IN ('.', 'C')) UNION ALL
SELECT sector_id, year, raw_value, 'known-year' FROM v WHERE year NOT IN (2019, 2020, 2021, 2022)"""))
def q07b(spark, d):
    v = S.official_number(F.col("raw_value"))
    rules = {"range": F.coalesce(v >= 0, F.col("raw_value").isin(".", "C")), "known-year": F.col("year").isin(2019, 2020, 2021, 2022)}
    return QU.evaluate_rules(V.fiscal(spark, d), ["sector_id", "year", "raw_value"], rules)


@query("q08_parcels", f"""
WITH f AS ({FRAGMENTS}) SELECT parcel_id, rule FROM f, (VALUES ('group'), ('share')) r(rule) WHERE (rule = 'group' AND trim(coalesce(crop_group, '')) = '') OR (rule = 'share' AND area_ha * 25 > 100)""")
def q08(spark, d):
    rows = fragments(spark, d).withColumn("parcel_pct", F.col("area_ha") * 25)
    return QU.parcel_violations(rows, "parcel_id")


@query("q09_band_domain", sql("px", """
SELECT obs_id, 'scl' AS band, count(*) AS n_outside FROM px WHERE scl NOT IN (2, 4, 5, 6) GROUP BY obs_id UNION ALL
SELECT obs_id, 'code', count(*) FROM px WHERE code NOT IN (1, 2, 3, 4) GROUP BY obs_id"""))
def q09(spark, d):
    return QU.band_domain(V.pixels(spark, d), ["obs_id"], {"scl": [2, 4, 5, 6], "code": [1, 2, 3, 4], "data_mask": [0, 1]})


@query("q10_dictionary", """
WITH a AS (SELECT DISTINCT p_size + 5 AS code, 'c' || (p_size + 5) % 4 AS color FROM part),
b AS (SELECT DISTINCT CAST(l_quantity AS INT) AS code, 'C' || CAST(l_quantity AS INT) % 4 + CASE WHEN CAST(l_quantity AS INT) = 7 THEN 1 ELSE 0 END AS color FROM lineitem)
SELECT coalesce(a.code, b.code) AS code, CASE WHEN a.code IS NULL THEN 'missing' WHEN b.code IS NULL THEN 'unknown' ELSE 'different' END AS difference
FROM a FULL JOIN b ON a.code = b.code WHERE a.code IS NULL OR b.code IS NULL OR lower(a.color) <> lower(b.color)""".replace(
    "'C' || CAST(l_quantity AS INT) % 4 + CASE", "'C' || (CAST(l_quantity AS INT) % 4 + CASE").replace("ELSE 0 END AS color FROM lineitem", "ELSE 0 END) AS color FROM lineitem"))
def q10(spark, d):
    ours = V.table(spark, d, "part").select(
        (F.col("p_size") + 5).alias("code"), F.concat(F.lit("c"), ((F.col("p_size") + 5) % 4).cast("string")).alias("color")).distinct()
    q = F.col("l_quantity").cast("int")
    official = V.table(spark, d, "lineitem").select(q.alias("code"), F.concat(F.lit("C"), (q % 4 + F.when(q == 7, 1).otherwise(0)).cast("string")).alias("color")).distinct()
    return QU.dictionary_differences(ours, official)


@query("q11_vertices", sql("poly", """
SELECT poly_id, 'count' AS rule FROM poly WHERE poly_id % 10 = 0 UNION ALL SELECT poly_id, 'bounds' FROM poly WHERE cx - r < 0 OR cy - r < 0 OR cx + r > 100 OR cy + r > 100"""))
def q11(spark, d):
    before = V.diamond_polygons(spark, d)
    shorter = F.transform("geom", lambda p: F.transform(p, lambda r: F.slice(r, 1, 4)))
    after = before.withColumn("geom", F.when(F.col("poly_id") % 10 == 0, F.array_union(shorter, shorter)).otherwise(F.col("geom")))
    return QU.vertex_violations(before, after, "poly_id", (0.0, 0.0, 100.0, 100.0))


@query("q12_byte_budgets", """
SELECT source, CAST(sum(octet_length(encode(text))) AS BIGINT) AS n_bytes, CASE WHEN source = 'src3' THEN 5000000 ELSE 100000 END::BIGINT AS budget FROM documents GROUP BY source HAVING n_bytes > budget""")
def q12(spark, d):
    docs = V.table(spark, d, "documents").select("source", F.octet_length("text").alias("length"))
    return PR.over_budget(docs, "source", {"src3": 5_000_000}, 100_000)


@query("w09_timeline", """
WITH o AS (SELECT o_custkey AS obs_id, max(o_totalprice) / 4000.0E0 AS cov FROM orders GROUP BY o_custkey), t AS (SELECT c_custkey AS obs_id FROM customer)
SELECT t.obs_id, 'observation' AS rule FROM t LEFT JOIN o USING (obs_id) WHERE o.obs_id IS NULL
UNION ALL SELECT t.obs_id, 'coverage' FROM t LEFT JOIN o USING (obs_id) WHERE NOT coalesce(cov >= 100, false)
UNION ALL SELECT obs_id, 'expected' FROM t WHERE obs_id NOT IN (1, 2, 3, 77) UNION ALL
SELECT CAST(v AS BIGINT), 'absent' FROM (VALUES (1), (2), (3), (77)) e(v) WHERE v NOT IN (SELECT obs_id FROM t)""")
def w09b(spark, d):
    obs = V.table(spark, d, "orders").groupBy(F.col("o_custkey").alias("obs_id")).agg((F.max("o_totalprice") / 4000.0).alias("coverage_pct"))
    timeline = V.table(spark, d, "customer").select(F.col("c_custkey").alias("obs_id"))
    out = QU.timeline_violations(timeline, obs, [1, 2, 3, 77], 100.0)
    return out.withColumn("obs_id", F.col("obs_id").cast("bigint"))


