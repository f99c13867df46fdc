"""Joins, selections, ordering and set operators on the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from zonemill import model as M
from zonemill.functions import pixels as P
from zonemill.functions import scores as S
from zonemill.operators import quantiles as Q
from zonemill.operators import scenes as SC
from zonemill.operators import tables as TB
from zonemill.plans import standins as V
from zonemill.plans.registry import query
from zonemill.plans.standins import r6, sql

YEARS = [2019, 2020, 2021, 2022, 2023, 2024]


@query("j01_join_complete", """
SELECT o_orderkey, o_totalprice, count(*) AS n_lines, sum(l_quantity) AS quantity FROM orders JOIN lineitem ON o_orderkey = l_orderkey
GROUP BY o_orderkey, o_totalprice""")
def j01(spark, d):
    lines = (V.table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey"))
             .agg(F.count("*").alias("n_lines"), F.sum("l_quantity").alias("quantity")))
    orders = V.table(spark, d, "orders").select("o_orderkey", "o_totalprice")
    return TB.join_complete(orders, lines, "o_orderkey", check=False)


@query("j01_unmatched_keys", """
WITH l AS (SELECT DISTINCT l_orderkey AS k FROM lineitem), e AS (SELECT event_id AS k FROM events)
SELECT k AS key, 'right' AS missing_in FROM l WHERE k NOT IN (SELECT k FROM e)
UNION ALL SELECT k, 'left' FROM e WHERE k NOT IN (SELECT k FROM l)""")
def j01b(spark, d):
    lines = V.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("key"))
    return TB.unmatched_keys(lines, V.table(spark, d, "events").select(F.col("event_id").alias("key")), "key")


@query("j02_name_mismatches", """
SELECT p_partkey, CASE WHEN p_partkey % 50 = 0 THEN upper(p_name) || ' (dup)' ELSE p_name END AS name
FROM part WHERE p_partkey % 50 = 0""")
def j02(spark, d):
    p = V.table(spark, d, "part")
    geo = p.select("p_partkey", F.when(F.col("p_partkey") % 50 == 0, F.concat(F.upper("p_name"), F.lit(" (dup)")))
                   .otherwise(F.col("p_name")).alias("geo_name"))
    joined = TB.join_complete(geo, p.select("p_partkey", F.col("p_name").alias("book_name")), "p_partkey", check=False)
    return TB.name_mismatches(joined, "geo_name", "book_name").select("p_partkey", "name")


FISCAL = """
SELECT sector_id, year, CASE WHEN count(v) = 0 THEN 'not-published' ELSE 'available' END AS source_status, sum(v) AS total
FROM (SELECT sector_id, year, CASE WHEN raw_value IN ('', '.', 'C') THEN NULL ELSE TRY_CAST(raw_value AS DOUBLE) END AS v
      FROM fiscal) GROUP BY sector_id, year"""


def fiscal_facts(spark, d):
    v = S.official_number(F.col("raw_value"))
    return (V.fiscal(spark, d).withColumn("v", v).groupBy("sector_id", "year")
            .agg(F.when(F.count("v") == 0, "not-published").otherwise("available").alias("source_status"), F.sum("v").alias("total")))


@query("j03_densify", sql("fiscal zone", f"""
SELECT z.sector_id, CAST(y.year AS BIGINT) AS year, coalesce(f.source_status, 'sector-unmatched') AS source_status, {r6('f.total')} AS total
FROM zone z CROSS JOIN (VALUES (2019), (2020), (2021), (2022), (2023), (2024)) y(year)
LEFT JOIN ({FISCAL}) f ON f.sector_id = z.sector_id AND f.year = y.year"""))
def j03(spark, d):
    return TB.densify(fiscal_facts(spark, d), V.zones(spark, d), YEARS).withColumn("year", F.col("year").cast("bigint"))


PERIODS = [(str(y), f"{y}-06-05", f"{y}-06-16") for y in range(1995, 2002)]


@query("j04_scenes_in_period", sql("scene period", """
SELECT scene_id, d, period_id, d0, d1 FROM scene JOIN period ON d BETWEEN d0 AND d1"""))
def j04(spark, d):
    return SC.scenes_in_period(V.scenes(spark, d), PERIODS).select("scene_id", "d", "period_id", "d0", "d1")


@query("j05_nearest_edition", """
SELECT o_orderkey, CAST(CASE WHEN y <= 1996 THEN 1995 WHEN y <= 1999 THEN 1998 ELSE 2001 END AS INT) AS edition
FROM (SELECT o_orderkey, year(o_orderdate) AS y FROM orders)""")
def j05(spark, d):
    return TB.nearest_edition(V.table(spark, d, "orders"), F.year("o_orderdate"), [1995, 1998, 2001]).select("o_orderkey", "edition")


@query("j06_align", sql("px px0", """
SELECT obs_id, row_i, col_i, code, code0 FROM px JOIN px0 USING (obs_id, row_i, col_i)"""))
def j06(spark, d):
    now = V.pixels(spark, d).select("obs_id", "row_i", "col_i", "code")
    return TB.align(now, V.baseline(spark, d), V.GRID, V.GRID, ("obs_id", "row_i", "col_i"))


@query("j10_with_municipality", """
SELECT r_name AS municipality, count(*) AS n, sum(c_acctbal) AS balance_raw FROM customer JOIN nation ON c_nationkey = n_nationkey
JOIN region ON n_regionkey = r_regionkey GROUP BY r_name""".replace("sum(c_acctbal) AS balance_raw", "floor(sum(c_acctbal) * 1000000.0E0 + 0.50137E0) / 1000000.0E0 AS balance"))
def j10(spark, d):
    rows = V.table(spark, d, "customer").select(F.col("c_nationkey").alias("sector_id"), "c_acctbal")
    return (TB.with_municipality(rows, V.zones(spark, d)).groupBy("municipality")
            .agg(F.count("*").alias("n"), F.sum("c_acctbal").alias("balance")))


FAMILY = {"low": ["1", "2"], "high": ["3", "4"]}
SERIES_SQL = """SELECT pz.*, s.series FROM pz JOIN (VALUES (1, 'family:low'), (2, 'family:low'), (3, 'family:high'), (4, 'family:high'),
  (1, 'class:1'), (2, 'class:2'), (3, 'class:3'), (4, 'class:4')) s(code, series) ON s.code = pz.code"""


@query("j11_with_series", sql("pz", f"SELECT obs_id, series, count(*) AS n FROM ({SERIES_SQL}) GROUP BY obs_id, series"))
def j11(spark, d):
    return TB.with_series(V.pixels(spark, d), "code", FAMILY).groupBy("obs_id", "series").agg(F.count("*").alias("n"))


@query("j14_with_quality", """
SELECT o.o_orderkey, o.o_orderpriority, l.n_lines, l.worst FROM orders o LEFT JOIN
(SELECT l_orderkey, count(*) AS n_lines, max(l_discount) AS worst FROM lineitem WHERE l_returnflag = 'R' GROUP BY l_orderkey) l
ON o.o_orderkey = l.l_orderkey""")
def j14(spark, d):
    sidecars = (V.table(spark, d, "lineitem").where("l_returnflag = 'R'").groupBy(F.col("l_orderkey").alias("o_orderkey"))
                .agg(F.count("*").alias("n_lines"), F.max("l_discount").alias("worst")))
    return TB.with_quality(V.table(spark, d, "orders").select("o_orderkey", "o_orderpriority"), sidecars, ["o_orderkey"])


@query("j15_find_zone", sql("zone", """
SELECT sector_id, sector_name FROM zone WHERE lower(trim(sector_name)) = 'nation_7' OR CAST(sector_id AS VARCHAR) = 'nation_7'
UNION ALL SELECT sector_id, sector_name FROM zone WHERE CAST(sector_id AS VARCHAR) = '9'"""))
def j15(spark, d):
    z = V.zones(spark, d).select("sector_id", "sector_name")
    return TB.find_zone(z, "  Nation_7 ", "sector_id", "sector_name").unionByName(TB.find_zone(z, "9", "sector_id", "sector_name"))


@query("j16_key_agreement", """
SELECT s_suppkey AS key, 'right' AS missing_in FROM supplier WHERE s_suppkey NOT IN (SELECT l_suppkey + 2 FROM lineitem)
UNION ALL SELECT DISTINCT l_suppkey + 2, 'left' FROM lineitem WHERE l_suppkey + 2 NOT IN (SELECT s_suppkey FROM supplier)""")
def j16(spark, d):
    return TB.unmatched_keys(V.table(spark, d, "supplier").select(F.col("s_suppkey").alias("key")),
                             V.table(spark, d, "lineitem").select((F.col("l_suppkey") + 2).alias("key")), "key")


SCOPED = """SELECT scope, sum(area_m2) AS area_m2 FROM (
  SELECT unnest(['region:all', 'municipality:' || municipality, 'sector:' || z.sector_id]) AS scope, area_m2
  FROM area_fact f JOIN zone z ON z.sector_id = f.sector_id) GROUP BY scope"""


@query("j17_scoped", sql("area_fact zone", f"""
SELECT r.request, r.scope, {r6('s.area_m2')} AS area_m2 FROM (SELECT c_custkey AS request, CASE c_custkey % 3 WHEN 0 THEN 'region:all'
  WHEN 1 THEN 'sector:' || (c_custkey % 30) ELSE 'municipality:ASIA' END AS scope FROM customer) r LEFT JOIN ({SCOPED}) s USING (scope)"""))
def j17(spark, d):
    rows = V.area_facts(spark, d).join(V.zones(spark, d).select("sector_id", "municipality"), "sector_id")
    stats = TB.scope_keys(rows).groupBy("scope").agg(F.sum("area_m2").alias("area_m2"))
    k = F.col("c_custkey")
    scope = (F.when(k % 3 == 0, "region:all").when(k % 3 == 1, F.concat(F.lit("sector:"), (k % 30).cast("string")))
             .otherwise("municipality:ASIA"))
    return TB.scoped(stats, V.table(spark, d, "customer").select(k.alias("request"), scope.alias("scope")))


# --- Sets ---------------------------------------------------------------------------------------


@query("u01_union_by_id", """
SELECT k AS id, arg_max(v, part) AS v, arg_max(src, part) AS src FROM (SELECT o_orderkey AS k, o_totalprice AS v, 'orders' AS src, 0 AS part FROM orders
UNION ALL SELECT event_id, value, 'events', 1 FROM events UNION ALL SELECT p_partkey, p_retailprice, 'part', 2 FROM part) GROUP BY k""")
def u01(spark, d):
    def part(name, key, v):
        return V.table(spark, d, name).select(F.col(key).alias("id"), F.col(v).alias("v"), F.lit(name).alias("src"))
    return TB.union_by_id([part("orders", "o_orderkey", "o_totalprice"), part("events", "event_id", "value"),
                           part("part", "p_partkey", "p_retailprice")], "id")


@query("u02_has_all", sql("scene", "SELECT d FROM scene WHERE tile IN (0, 1) GROUP BY d HAVING count(DISTINCT tile) = 2"))
def u02(spark, d):
    return TB.has_all(V.scenes(spark, d), "d", "tile", [0, 1])


@query("u03_check_domain", sql("px", """
SELECT obs_id, count(*) FILTER (code NOT IN (0, 1, 2, 3)) AS n_outside, bool_or(code IN (1, 2, 3)) AS has_classified FROM px GROUP BY obs_id"""))
def u03(spark, d):
    return TB.check_domain(V.pixels(spark, d).groupBy("obs_id"), "code", [0, 1, 2, 3], [1, 2, 3])


@query("u03_domain_violations", sql("px", "SELECT code AS value, count(*) AS n FROM px WHERE code NOT IN (0, 1, 2) GROUP BY code"))
def u03b(spark, d):
    return TB.domain_violations(V.pixels(spark, d), "code", [0, 1, 2])


@query("u04_missing_keys", """
SELECT c_nationkey, c_mktsegment FROM (SELECT DISTINCT c_nationkey, s.seg AS c_mktsegment FROM customer, (SELECT DISTINCT c_mktsegment AS seg FROM customer) s)
EXCEPT SELECT c_nationkey + 3, c_mktsegment FROM customer""")
def u04(spark, d):
    c = V.table(spark, d, "customer")
    segments = F.array(*map(F.lit, ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]))
    expected = c.select("c_nationkey").distinct().select("c_nationkey", F.explode(segments).alias("c_mktsegment"))
    return TB.missing_keys(expected, c.withColumn("c_nationkey", F.col("c_nationkey") + 3), ["c_nationkey", "c_mktsegment"])


@query("u05_overlapping_codes", """
SELECT p_brand AS code, count(DISTINCT p_size) AS n_groups FROM part GROUP BY p_brand HAVING count(DISTINCT p_size) > 1""")
def u05(spark, d):
    return TB.overlapping_codes(V.table(spark, d, "part").select(F.col("p_brand").alias("code"), F.col("p_size").alias("grp")))


@query("u06_stack", sql("px px0", """
SELECT o, count(*) AS n, CAST(sum(code) AS BIGINT) AS code_sum FROM (SELECT obs_id AS o, row_i, col_i, code FROM px
UNION ALL SELECT -1 - obs_id, row_i, col_i, code0 FROM px0) GROUP BY o"""))
def u06(spark, d):
    now = V.pixels(spark, d).select(F.col("obs_id").alias("o"), "row_i", "col_i", "code")
    then = V.baseline(spark, d).select((-1 - F.col("obs_id")).alias("o"), "row_i", "col_i", F.col("code0").alias("code"))
    return TB.stack([(now, V.GRID), (then, V.GRID)]).groupBy("o").agg(F.count("*").alias("n"), F.sum("code").alias("code_sum"))


# --- Windows and selections ---------------------------------------------------------------------

# A candidate is a scene inside a period; its coverage is derived from the cloud share.
CANDIDATES = """SELECT s.*, p.period_id, p.d0, p.d1, floor(120.0E0 - cloud_pct * 1.2E0) AS coverage_pct
FROM scene s JOIN period p ON d BETWEEN d0 AND d1"""
JUDGED = f"""SELECT *, CASE WHEN barred THEN 'excluded-from-timeline' WHEN rn = 1 AND usable THEN 'selected'
  WHEN coverage_pct < 10 THEN 'insufficient-coverage' ELSE 'not-clearest' END AS reason FROM (
  SELECT *, row_number() OVER (PARTITION BY period_id, usable ORDER BY coverage_pct DESC,
    abs(2 * date_diff('day', d0, d) - date_diff('day', d0, d1)), acquired_at, scene_id) AS rn
  FROM (SELECT *, d IN (DATE '1997-06-10', DATE '2000-06-11') AS barred,
        coverage_pct >= 10 AND d NOT IN (DATE '1997-06-10', DATE '2000-06-11') AS usable FROM ({CANDIDATES})))"""
BARRED = {"1997-06-10": "excluded-from-timeline", "2000-06-11": "excluded-from-timeline"}


def judged(spark, d):
    inside = SC.scenes_in_period(V.scenes(spark, d), PERIODS)
    return SC.select_clearest(inside.withColumn("coverage_pct", F.floor(120.0 - F.col("cloud_pct") * 1.2).cast("double")), BARRED)


@query("w01_select_clearest", sql("scene period", f"SELECT period_id, scene_id, d, coverage_pct, reason FROM ({JUDGED})"))
def w01(spark, d):
    return judged(spark, d).select("period_id", "scene_id", "d", "coverage_pct", "reason")


@query("w01_period_status", sql("scene period", f"""
SELECT p.period_id, coalesce(n, 0) AS n_candidates, selected AS selected_scene, CASE WHEN selected IS NOT NULL THEN 'observed' WHEN n > 0 THEN 'cloud-obscured'
  ELSE 'no-acquisition' END AS status FROM (SELECT period_id FROM period UNION ALL SELECT '2010') p LEFT JOIN
(SELECT period_id, count(*) AS n, max(CASE WHEN reason = 'selected' THEN scene_id END) AS selected FROM ({JUDGED}) GROUP BY period_id) j USING (period_id)"""))
def w01b(spark, d):
    wanted = V.periods(spark).select("period_id").unionByName(spark.sql("SELECT '2010' AS period_id"))
    return SC.period_status(wanted, judged(spark, d))


ANNUAL = """SELECT d, year(d)::INT AS year, least(100, sum(cloud_pct) / 2) AS coverage_pct, min(cloud_pct) AS cloud_pct FROM scene GROUP BY d"""
GAP = "CAST(abs(date_diff('day', make_date(year(d), 7, 15), d)) AS INT)"


@query("w02_select_annual", sql("scene", f"""
SELECT year, d, gap, {r6('coverage_pct')} AS coverage_pct, {r6('cloud_pct')} AS cloud_pct,
  CASE WHEN coverage_pct >= 99.5 AND cloud_pct <= 2 THEN 'good' ELSE 'warning' END AS quality FROM (
  SELECT *, row_number() OVER (PARTITION BY year ORDER BY tier, CASE WHEN tier <= 1 THEN gap ELSE cloud_pct END,
    CASE WHEN tier <= 1 THEN cloud_pct ELSE gap END, d) AS rn FROM (
    SELECT *, {GAP} AS gap, CASE WHEN coverage_pct >= 99.5 AND cloud_pct <= 2 AND {GAP} <= 16 THEN 0
      WHEN coverage_pct >= 99.5 AND cloud_pct <= 2 THEN 1 WHEN coverage_pct >= 99.5 THEN 2 ELSE 3 END AS tier FROM ({ANNUAL}))) WHERE rn = 1"""))
def w02(spark, d):
    rows = V.scenes(spark, d).groupBy("d").agg(F.least(F.lit(100.0), F.sum("cloud_pct") / 2).alias("coverage_pct"),
                                               F.min("cloud_pct").alias("cloud_pct"))
    return SC.select_annual(rows, 7, 15)


@query("t03_shortlist", sql("scene", f"""
WITH r AS (SELECT year(d)::INT AS year, d, max(cloud_pct) AS max_cloud, {GAP} AS gap FROM scene WHERE category = 'T1' GROUP BY d),
k AS (SELECT *, row_number() OVER (PARTITION BY year ORDER BY max_cloud, gap, d) AS rn,
             row_number() OVER (PARTITION BY year ORDER BY gap, max_cloud, d) AS nr FROM r),
t AS (SELECT * FROM k WHERE rn <= 6)
SELECT year, d, {r6('max_cloud')} AS max_cloud, gap FROM t UNION ALL SELECT year, d, {r6('max_cloud')}, gap FROM k
WHERE nr = 1 AND year IN (SELECT year FROM t GROUP BY year HAVING min(gap) > 16)"""))
def t03(spark, d):
    return SC.shortlist(SC.scenes_by_date(V.scenes(spark, d).where("category = 'T1'")), 7, 15)


MOSAIC = """SELECT row_i, col_i, status, temp_c, dn * 0.01E0 AS uncertainty, obs_id AS scene_rank FROM px
UNION ALL SELECT row_i, col_i, code0 % 3 AS status, code0 * 10.0E0 AS temp_c, (row_i * 31 + col_i * 17) % 650 * 1.0E0 AS uncertainty, 1000 + obs_id FROM px0"""


def mosaic_input(spark, d):
    now = V.pixels(spark, d).select("row_i", "col_i", "status", "temp_c", (F.col("dn") * 0.01).alias("uncertainty"), F.col("obs_id").alias("scene_rank"))
    then = V.baseline(spark, d).select(
        "row_i", "col_i", (F.col("code0") % 3).alias("status"), (F.col("code0") * 10.0).alias("temp_c"),
        ((F.col("row_i") * 31 + F.col("col_i") * 17) % 650 * 1.0).alias("uncertainty"), (1000 + F.col("obs_id")).alias("scene_rank"))
    return now.unionByName(then)


@query("w03_mosaic", sql("px px0", f"""
WITH m AS ({MOSAIC}), b AS (SELECT *, row_number() OVER (PARTITION BY row_i, col_i ORDER BY uncertainty, scene_rank) AS rn FROM m WHERE status = 1),
s AS (SELECT row_i, col_i, CAST(CASE WHEN bool_or(status = 1) THEN 1 WHEN bool_or(status = 2) THEN 2 ELSE 0 END AS INT) AS status FROM m GROUP BY row_i, col_i)
SELECT s.row_i, s.col_i, s.status, {r6('b.temp_c')} AS temp_c, {r6('b.uncertainty')} AS uncertainty, b.scene_rank
FROM s LEFT JOIN (SELECT * FROM b WHERE rn = 1) b USING (row_i, col_i)"""))
def w03(spark, d):
    return SC.mosaic(mosaic_input(spark, d), ["row_i", "col_i"])


WEIGHTED = """SELECT l_returnflag AS flag, l_extendedprice AS v, CAST(l_quantity AS BIGINT) AS w FROM lineitem"""


@query("w04_weighted_percentile", f"""
WITH c AS (SELECT flag, v, sum(w) OVER (PARTITION BY flag ORDER BY v) AS upto, sum(w) OVER (PARTITION BY flag) AS total FROM ({WEIGHTED}))
SELECT flag, min(CASE WHEN upto >= total * 0.1E0 THEN v END) AS p10, min(CASE WHEN upto >= total * 0.5E0 THEN v END) AS p50,
  min(CASE WHEN upto >= total * 0.9E0 THEN v END) AS p90 FROM c GROUP BY flag""")
def w04(spark, d):
    rows = V.table(spark, d, "lineitem").withColumn("flag", F.col("l_returnflag"))
    return Q.weighted_quantiles(rows, ["flag"], F.col("l_extendedprice"), F.col("l_quantity").cast("bigint"),
                                {"p10": 0.1, "p50": 0.5, "p90": 0.9})


HIST = "SELECT obs_id, CAST(least(greatest(floor((ndvi + 1.0E0) / 0.001E0 + 0.5E0), 0), 2000) AS INT) AS b, count(*) AS n FROM v GROUP BY ALL"
NDVI_VALUES = "v AS (SELECT *, CASE WHEN abs(b08 + b04) > 2.220446049250313e-16 THEN (b08 - b04) / (b08 + b04) END AS ndvi FROM px)"


@query("w05_histogram_quantile", sql("px", f"""
WITH {NDVI_VALUES}, h AS ({HIST.replace('FROM v', 'FROM v WHERE ndvi IS NOT NULL')}),
c AS (SELECT *, sum(n) OVER (PARTITION BY obs_id ORDER BY b) AS upto, sum(n) OVER (PARTITION BY obs_id) AS total FROM h)
SELECT obs_id, CAST(max(total) AS BIGINT) AS n, min(CASE WHEN upto >= greatest(1, ceil(total * 0.05E0)) THEN b END) AS p05,
  min(CASE WHEN upto >= greatest(1, ceil(total * 0.5E0)) THEN b END) AS median FROM c GROUP BY obs_id"""))
def w05(spark, d):
    px = V.pixels(spark, d).withColumn("ndvi", P.ndvi(F.col("b04"), F.col("b08"))).where("ndvi IS NOT NULL")
    hist = px.groupBy("obs_id", P.ndvi_bin(F.col("ndvi")).alias("b")).agg(F.count("*").alias("n"))
    return Q.histogram_quantiles(hist, ["obs_id"], "b", "n", {"p05": 0.05, "median": 0.5})


@query("w06_dominant", sql("area_fact", f"""
SELECT sector_id, class_code AS dominant_code, {r6('area_m2')} AS area_m2 FROM (SELECT *, row_number() OVER (PARTITION BY sector_id ORDER BY area_m2 DESC, class_code) AS rn
FROM area_fact) WHERE rn = 1"""))
def w06(spark, d):
    return TB.dominant(V.area_facts(spark, d), ["sector_id"], "class_code", "area_m2")


@query("w09_check_timeline", """
WITH o AS (SELECT o_custkey AS series, o_orderkey AS position, o_orderdate AS t, o_totalprice / 4000.0E0 AS cov FROM orders),
l AS (SELECT *, lag(t) OVER (PARTITION BY series ORDER BY position) AS before FROM o)
SELECT series, position, 'out-of-order' AS problem FROM l WHERE before > t UNION ALL SELECT series, position, 'repeated' FROM l WHERE before = t
UNION ALL SELECT series, position, 'insufficient-coverage' FROM l WHERE cov < 10""")
def w09(spark, d):
    obs = V.table(spark, d, "orders").select(F.col("o_custkey").alias("series"), F.col("o_orderkey").alias("position"),
                                             F.col("o_orderdate").alias("acquired_at"), (F.col("o_totalprice") / 4000.0).alias("coverage_pct"))
    return SC.check_timeline(obs, M.MINIMUM_COVERAGE)


@query("w10_default_observation", """
SELECT category, max(scene_id) AS scene_id FROM (SELECT *, max(acquired_at) OVER (PARTITION BY category) AS newest FROM
 (SELECT o_orderstatus AS category, o_orderkey AS scene_id, o_orderdate AS acquired_at FROM orders)) WHERE acquired_at = newest GROUP BY category""")
def w10(spark, d):
    obs = V.table(spark, d, "orders").select(F.col("o_orderstatus").alias("category"), F.col("o_orderkey").alias("scene_id"),
                                             F.struct("o_orderdate", "o_orderkey").alias("t"))
    return TB.latest(obs, "scene_id", "t", ("category",))


@query("w11_spatial_split", """
WITH q AS (SELECT quantile_cont(x, 0.6E0) AS q60, quantile_cont(x, 0.8E0) AS q80 FROM (SELECT o_totalprice AS x FROM orders))
SELECT o_orderkey, CASE WHEN o_totalprice <= q60 THEN 'train' WHEN o_totalprice <= q80 THEN 'validation' ELSE 'test' END AS split FROM orders, q""")
def w11(spark, d):
    rows = V.table(spark, d, "orders").select("o_orderkey", F.col("o_totalprice").alias("x"))
    bounds = Q.interpolated_quantiles(rows, [], F.col("x"), {"q60": 0.6, "q80": 0.8})
    return SC.spatial_split(rows, "x", bounds).select("o_orderkey", "split")


@query("w12_grouped_breakdown", sql("area_fact", """
SELECT sector_id, class_code, grp, row_number() OVER (PARTITION BY sector_id ORDER BY g, area_m2 DESC, class_code)::INT AS position FROM
(SELECT f.*, m.grp, m.g FROM area_fact f JOIN (VALUES (3, 'built', 0), (4, 'built', 0), (1, 'green', 1), (2, 'green', 1), (5, 'green', 1)) m(code, grp, g)
 ON m.code = class_code WHERE area_m2 > 0)"""))
def w12(spark, d):
    return TB.grouped_breakdown(V.area_facts(spark, d), ["sector_id"], "class_code", "area_m2", {"built": [3, 4], "green": [1, 2, 5]}).select(
        "sector_id", "class_code", "grp", "position")


@query("t01_sort_classes", sql("area_fact", """
SELECT sector_id, class_code, row_number() OVER (PARTITION BY sector_id ORDER BY area_m2 DESC, class_code)::INT AS rank FROM area_fact"""))
def t01(spark, d):
    return TB.sort_classes(V.area_facts(spark, d), ["sector_id"], "class_code", "area_m2").select("sector_id", "class_code", "rank")


@query("t02_sort_names", "SELECT c_custkey, c_name FROM customer")
def t02(spark, d):
    return TB.sort_names(V.table(spark, d, "customer").select("c_custkey", "c_name"), "c_name")


@query("t04_last_wins", sql("px px0", """
SELECT row_i, col_i, arg_max(code, seq) AS code FROM (SELECT row_i, col_i, code, obs_id AS seq FROM px
UNION ALL SELECT row_i, col_i, code0, -1 - obs_id FROM px0) GROUP BY row_i, col_i"""))
def t04(spark, d):
    cells = V.pixels(spark, d).select("row_i", "col_i", "code", F.col("obs_id").alias("seq")).unionByName(
        V.baseline(spark, d).select("row_i", "col_i", F.col("code0").alias("code"), (-1 - F.col("obs_id")).alias("seq")))
    return TB.last_wins(cells, ["row_i", "col_i"], "code", "seq")
