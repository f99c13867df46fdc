"""Column functions on whole driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from zonemill import model as M
from zonemill.functions import numbers as N
from zonemill.functions import pixels as P
from zonemill.functions import scores as S
from zonemill.functions import space as G
from zonemill.functions import text as X
from zonemill.operators import scenes as SC
from zonemill.operators import tables as TB
from zonemill.plans import standins as V
from zonemill.plans.registry import query
from zonemill.session import spread
from zonemill.plans.standins import r6, sql

LC = "[10, 20, 30, 40, 90, 254]"


@query("p01_source_value", """
SELECT event_id, CASE WHEN event_type = 'view' THEN value WHEN event_type = 'click' THEN event_id::DOUBLE END AS parsed
FROM events""")
def p01(spark, d):
    e = V.table(spark, d, "events")
    text = (F.when(F.col("event_type") == "view", F.concat(F.lit(" "), F.col("value").cast("string")))
            .when(F.col("event_type") == "click", F.col("event_id").cast("string"))
            .when(F.col("event_type") == "purchase", "").when(F.col("event_type") == "signup", "n/a").otherwise("Infinity"))
    return e.select("event_id", S.source_value(text).alias("parsed"))


@query("p02_official_number", sql("fiscal", f"""
SELECT sector_id, year, count(*) AS n, count(v) AS n_published, {r6('sum(v)')} AS total, {r6('min(v)')} AS lowest
FROM (SELECT sector_id, year, CASE WHEN raw_value IN ('', '.', 'C') THEN NULL ELSE TRY_CAST(raw_value AS DOUBLE) END AS v
      FROM fiscal) GROUP BY sector_id, year"""))
def p02(spark, d):
    v = S.official_number(F.col("raw_value"))
    return (V.fiscal(spark, d).withColumn("v", v).groupBy("sector_id", "year")
            .agg(F.count("*").alias("n"), F.count("v").alias("n_published"), F.sum("v").alias("total"),
                 F.min("v").alias("lowest")))


SCORED = """
SELECT rec_id, final_score, CASE WHEN final_score = 9999 THEN 'institution-present-no-score'
  WHEN final_score IS NULL THEN 'insufficient-data' ELSE 'scored' END AS status FROM score"""


def scored(spark, d):
    return V.scores(spark, d).withColumn("status", S.score_status(F.col("final_score")))


@query("p03_score_status", sql("score", SCORED))
def p03(spark, d):
    return scored(spark, d)


@query("p04_score_class", sql("score", f"""
SELECT rec_id, CASE WHEN status = 'scored' THEN 'score-' || CAST(final_score AS VARCHAR)
  WHEN status = 'insufficient-data' THEN 'no-data' ELSE status END AS render_class FROM ({SCORED})"""))
def p04(spark, d):
    return scored(spark, d).select("rec_id", S.score_class(F.col("final_score"), F.col("status")).alias("render_class"))


@query("p05_metric_value", """
WITH s AS (SELECT p_partkey AS rec_id, p_size AS f, p_retailprice AS h, p_size / 5.0E0 AS v,
  CASE p_partkey % 4 WHEN 0 THEN 'final' WHEN 1 THEN 'heat' WHEN 2 THEN 'vulnerability' ELSE 'unheard-of' END AS metric,
  CASE WHEN p_partkey % 9 = 0 THEN 'institution-present-no-score' ELSE 'scored' END AS st FROM part),
c AS (SELECT rec_id, st, CASE metric WHEN 'heat' THEN h WHEN 'vulnerability' THEN v ELSE CAST(f AS DOUBLE) END AS value FROM s)
SELECT rec_id, value, CASE WHEN st = 'institution-present-no-score' OR value = 9999 THEN 'institution-present-no-score'
  WHEN value < 0 OR value > 10 THEN 'insufficient-data' ELSE 'scored' END AS metric_status FROM c""")
def p05(spark, d):
    k = F.col("p_partkey")
    metric = (F.when(k % 4 == 0, "final").when(k % 4 == 1, "heat").when(k % 4 == 2, "vulnerability").otherwise("unheard-of"))
    value = S.metric_value(metric, F.col("p_size").cast("double"), F.col("p_retailprice"), F.col("p_size") / 5.0)
    status = F.when(k % 9 == 0, S.INSTITUTION).otherwise("scored")
    return V.table(spark, d, "part").select(k.alias("rec_id"), value.alias("value"), S.metric_status(value, status).alias("metric_status"))


@query("p06_interpretation", sql("score", f"""
SELECT rec_id, CASE WHEN status = 'institution-present-no-score' THEN 'institution' WHEN status <> 'scored' THEN 'insufficient'
  WHEN final_score <= 2 THEN 'low' WHEN final_score <= 4 THEN 'rather-low' WHEN final_score <= 6 THEN 'medium'
  WHEN final_score <= 8 THEN 'high' ELSE 'very-high' END AS bucket FROM ({SCORED})"""))
def p06(spark, d):
    return scored(spark, d).select("rec_id", S.interpretation(F.col("final_score"), F.col("status")).alias("bucket"))


@query("p07_score_percentage", sql("score", """
SELECT rec_id, least(greatest(coalesce(final_score, 0) * 10.0E0, 0), 100) AS share FROM score"""))
def p07(spark, d):
    return V.scores(spark, d).select("rec_id", S.score_percentage(F.col("final_score")).alias("share"))


@query("p08_band", f"""
SELECT o_orderkey, CASE WHEN v IS NULL THEN 'no-data' WHEN v <= 19999.999E0 THEN 'under-20000'
  WHEN v BETWEEN 20000 AND 24999.999E0 THEN '20000-24999' WHEN v BETWEEN 25000 AND 29999.999E0 THEN '25000-29999'
  WHEN v BETWEEN 30000 AND 34999.999E0 THEN '30000-34999' WHEN v BETWEEN 35000 AND 39999.999E0 THEN '35000-39999'
  WHEN v BETWEEN 40000 AND 44999.999E0 THEN '40000-44999' WHEN v >= 45000 THEN '45000-plus' ELSE 'no-data' END AS band_id
FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 17 = 0 THEN NULL ELSE o_totalprice / 10 END AS v FROM orders)""")
def p08(spark, d):
    v = F.when(F.col("o_orderkey") % 17 != 0, F.col("o_totalprice") / 10)
    return V.table(spark, d, "orders").select("o_orderkey", N.band(v, M.INCOME_BANDS).alias("band_id"))


@query("p09_asymmetry", """
SELECT c_custkey, CASE WHEN abs(c_acctbal / 1000) < 1 THEN 'balanced' WHEN c_acctbal > 0 THEN 'right' ELSE 'left' END AS label
FROM customer""")
def p09(spark, d):
    return V.table(spark, d, "customer").select("c_custkey", S.asymmetry(F.col("c_acctbal") / 1000).alias("label"))


@query("p10_filter_zone", sql("zone", "SELECT sector_id, sector_name, municipality FROM zone WHERE municipality = 'EUROPE'"))
def p10(spark, d):
    return TB.filter_zone(V.zones(spark, d), "municipality", "EUROPE").select("sector_id", "sector_name", "municipality")


@query("p11_eligible_scenes", """
SELECT o_orderkey AS scene_id FROM orders
WHERE o_custkey % 4 IN (0, 1) AND o_orderstatus = 'F' AND o_custkey % 7 <> 0 AND o_orderkey % 5 <> 0""")
def p11(spark, d):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    assets = F.when(k % 5 == 0, F.array(F.lit("lwir11"), F.lit("qa"))).otherwise(F.array(*map(F.lit, [*M.SCENE_ASSETS, "blue"])))
    catalogue = V.table(spark, d, "orders").select(
        k.alias("scene_id"), F.concat(F.lit("landsat-"), (8 + c % 4).cast("string")).alias("platform"),
        F.when(F.col("o_orderstatus") == "F", "T1").otherwise("T2").alias("category"),
        F.when(c % 7 == 0, "L1TP").otherwise("L2SP").alias("correction"), assets.alias("assets"))
    return SC.eligible_scenes(catalogue).select("scene_id")


QUALITY = """CASE WHEN (qa_pixel & 1) = 0 AND (qa_pixel & 62) <> 0 THEN 2
  WHEN (qa_pixel & 1) = 0 AND dn >= 293 AND (qa_radsat & 383) = 0 THEN 1 ELSE 0 END"""


@query("p12_classify_quality", sql("px", f"SELECT obs_id, row_i, col_i, {QUALITY} AS quality FROM px"))
def p12(spark, d):
    return V.pixels(spark, d).select("obs_id", "row_i", "col_i", P.classify_quality(
        F.col("dn"), F.col("qa_pixel"), F.col("qa_radsat")).alias("quality"))


@query("p13_valid_scene_pixel", sql("px", """
SELECT obs_id, row_i, col_i, data_mask = 1 AND scl NOT IN (0, 1, 3, 7, 8, 9, 10, 11) AS valid FROM px"""))
def p13(spark, d):
    return V.pixels(spark, d).select("obs_id", "row_i", "col_i", P.valid_scene_pixel(F.col("data_mask"), F.col("scl")).alias("valid"))


NDVI = "CASE WHEN abs(b08 + b04) > 2.220446049250313e-16 THEN (b08 - b04) / (b08 + b04) END"


@query("p14_ndvi", sql("px", f"SELECT obs_id, row_i, col_i, {r6(NDVI)} AS ndvi FROM px"))
def p14(spark, d):
    return V.pixels(spark, d).select("obs_id", "row_i", "col_i", P.ndvi(F.col("b04"), F.col("b08")).alias("ndvi"))


@query("p15_surface_temperature", sql("px", f"""
SELECT obs_id, row_i, col_i, {r6('dn * 0.00341802E0 + 149.0E0 - 273.15E0')} AS temp_c, {r6('dn * 0.01E0')} AS uncertainty_k FROM px"""))
def p15(spark, d):
    return V.pixels(spark, d).select("obs_id", "row_i", "col_i", P.surface_temperature(F.col("dn")).alias("temp_c"),
                                     P.temperature_uncertainty(F.col("dn")).alias("uncertainty_k"))


# Land cover and land use of a pixel, derived from the same event row.
COVER = "CASE code WHEN 1 THEN 40 WHEN 2 THEN 30 WHEN 3 THEN 10 ELSE 90 END"
USE = "CASE scl % 4 WHEN 0 THEN '23000' WHEN 1 THEN '21000' WHEN 2 THEN '50000' ELSE '11100' END"
REASON = """CASE WHEN use = '50000' THEN 'water' WHEN (cover = 40 AND use <> '23000') OR (cover = 30 AND use = '21000')
  THEN 'cropland' END"""


def covered(px):
    code, scl = F.col("code"), F.col("scl") % 4
    return (px.withColumn("cover", F.when(code == 1, 40).when(code == 2, 30).when(code == 3, 10).otherwise(90))
            .withColumn("use", F.when(scl == 0, "23000").when(scl == 1, "21000").when(scl == 2, "50000").otherwise("11100")))


@query("p16_exclusion_reason", sql("px", f"""
SELECT obs_id, row_i, col_i, {REASON} AS reason FROM (SELECT *, {COVER} AS cover, {USE} AS use FROM px)"""))
def p16(spark, d):
    return covered(V.pixels(spark, d)).select(
        "obs_id", "row_i", "col_i", P.exclusion_reason(F.col("cover"), F.col("use")).alias("reason"))


@query("p17_classify_vegetation", sql("px", f"""
SELECT obs_id, row_i, col_i, CASE WHEN data_mask <> 1 OR ndvi IS NULL THEN 'no-data' WHEN reason IS NOT NULL THEN 'excluded'
  WHEN ndvi >= 0.4E0 THEN 'likely-vegetated' ELSE 'below-threshold' END AS label
FROM (SELECT *, {REASON} AS reason, {NDVI} AS ndvi FROM (SELECT *, {COVER} AS cover, {USE} AS use FROM px))"""))
def p17(spark, d):
    px = covered(V.pixels(spark, d))
    return px.select("obs_id", "row_i", "col_i", P.classify_vegetation(
        P.ndvi(F.col("b04"), F.col("b08")), F.col("data_mask") == 1,
        P.exclusion_reason(F.col("cover"), F.col("use")), 0.4).alias("label"))


@query("p18_classify_soil", sql("px", """
SELECT obs_id, row_i, col_i, CASE WHEN b04 >= 0.5 AND b08 > 0.5 THEN 1 WHEN b04 >= 0.5 AND b08 < 0.5 THEN 2 ELSE 0 END AS soil
FROM px"""))
def p18(spark, d):
    return V.pixels(spark, d).select("obs_id", "row_i", "col_i", P.classify_soil(F.col("b04"), F.col("b08")).alias("soil"))


@query("p19_change_state", """
WITH c AS (SELECT o_orderkey, [10, 20, 30, 40, 90, 254, 0][1 + CAST(o_custkey % 7 AS INT)] AS b,
                  [10, 20, 30, 40, 90, 254, 0][1 + CAST(o_orderkey % 7 AS INT)] AS a FROM orders)
SELECT o_orderkey, CASE WHEN b IN (0, 254) OR a IN (0, 254) THEN 0 WHEN b NOT IN (10, 30) AND a IN (10, 30) THEN 1
  WHEN b IN (10, 30) AND a NOT IN (10, 30) THEN 2 ELSE 0 END AS state FROM c""")
def p19(spark, d):
    codes = F.array(*map(F.lit, [10, 20, 30, 40, 90, 254, 0]))
    known = [code for code, *_ in M.LAND_COVER]
    before, after = (F.element_at(codes, (1 + F.col(c) % 7).cast("int")) for c in ("o_custkey", "o_orderkey"))
    return V.table(spark, d, "orders").select(
        "o_orderkey", P.change_state(before, after, known, M.LAND_COVER_VEGETATION).alias("state"))


@query("p20_encode_pct", """
WITH e AS (SELECT o_orderkey, CASE WHEN o_orderkey % 13 = 0 THEN 65535 ELSE CAST(round_even(least(greatest(CAST(v AS FLOAT), 0::FLOAT),
  100::FLOAT) * 100::FLOAT, 0) AS INT) END AS encoded FROM (SELECT o_orderkey, o_totalprice / 4000.0E0 - 5 AS v FROM orders))
SELECT o_orderkey, encoded, CASE WHEN encoded <> 65535 THEN floor(encoded / 100.0E0 * 1000000.0E0 + 0.50137E0) / 1000000.0E0 END AS decoded FROM e""")
def p20(spark, d):
    v = F.when(F.col("o_orderkey") % 13 != 0, F.col("o_totalprice") / 4000.0 - 5)
    encoded = N.encode_percentage(v)
    return V.table(spark, d, "orders").select("o_orderkey", encoded.alias("encoded"), N.decode_percentage(encoded).alias("decoded"))


@query("p21_encode_temperature", sql("px", f"""
SELECT obs_id, row_i, col_i, CASE WHEN status = 1 THEN CAST(round_even(least(greatest((temp_c - 15) / 35.0E0, 0), 1) * 255.0E0, 0) AS INT)
  ELSE 0 END AS encoded, {r6('least(greatest((temp_c - 15) / 35.0E0 * 100.0E0, 0), 100)')} AS position FROM px"""))
def p21(spark, d):
    return V.pixels(spark, d).select("obs_id", "row_i", "col_i", P.encode_temperature(F.col("temp_c"), F.col("status")).alias("encoded"),
                                     P.temperature_position(F.col("temp_c")).alias("position"))


@query("p22_bbox_intersects", sql("poly", """
SELECT poly_id, cx - r <= 60 AND cx + r >= 20 AND cy - r <= 80 AND cy + r >= 40 AS touches FROM poly"""))
def p22(spark, d):
    cx, cy, r = F.col("cx"), F.col("cy"), F.col("r")
    return V.diamonds(spark, d).select("poly_id", G.boxes_touch(cx - r, cy - r, cx + r, cy + r, 20, 40, 60, 80).alias("touches"))


@query("p23_aligned_bounds", sql("poly", """
SELECT poly_id, floor((cx - r) / 10.0E0) * 10.0E0 AS x0, floor((cy - r) / 10.0E0) * 10.0E0 AS y0, ceil((cx + r) / 10.0E0) * 10.0E0 AS x1,
  ceil((cy + r) / 10.0E0) * 10.0E0 AS y1, cx - r - 2.5E0 AS pad_x0, cy + r + 2.5E0 AS pad_y1 FROM poly"""))
def p23(spark, d):
    box = [F.col("cx") - F.col("r"), F.col("cy") - F.col("r"), F.col("cx") + F.col("r"), F.col("cy") + F.col("r")]
    grown, padded = G.aligned_box(*box, 10.0), G.padded_box(*box, 2.5)
    return V.diamonds(spark, d).select("poly_id", *[c.alias(n) for c, n in zip(grown, ("x0", "y0", "x1", "y1"))],
                                       padded[0].alias("pad_x0"), padded[3].alias("pad_y1"))


@query("p24_crop", sql("px", """
SELECT obs_id, row_i, col_i, code FROM px WHERE col_i + 0.5E0 BETWEEN 10.5 AND 30 AND row_i + 0.5E0 BETWEEN 20 AND 55.5"""))
def p24(spark, d):
    x, y = G.cell_center(F.col("row_i"), F.col("col_i"), V.GRID)
    return V.pixels(spark, d).where(x.between(10.5, 30) & y.between(20, 55.5)).select("obs_id", "row_i", "col_i", "code")


@query("p25_cell_of", """
SELECT o_orderkey, CASE WHEN ok THEN CAST(floor(y) AS BIGINT) END AS row_i, CASE WHEN ok THEN CAST(floor(x) AS BIGINT) END AS col_i,
  CASE WHEN ok THEN floor(x) + 0.5E0 END AS center_x, CASE WHEN ok THEN floor(y) + 0.5E0 END AS center_y
FROM (SELECT *, x >= 0 AND x < 100 AND y >= 0 AND y < 100 AS ok
      FROM (SELECT o_orderkey, o_totalprice / 4000.0E0 AS x, (o_custkey % 220) / 2.0E0 - 5 AS y FROM orders))""")
def p25(spark, d):
    row, col = G.cell_of(F.col("o_totalprice") / 4000.0, (F.col("o_custkey") % 220) / 2.0 - 5, V.GRID)
    x, y = G.cell_center(row, col, V.GRID)
    return V.table(spark, d, "orders").select("o_orderkey", row.alias("row_i"), col.alias("col_i"), x.alias("center_x"), y.alias("center_y"))


MERCATOR = G.mercator_grid(4.0, 50.0, 4.04, 50.04, 30.0)
MERC_HA = f"""{abs(MERCATOR.dx * MERCATOR.dy)!r}E0 * power(cos(2.0E0 * atan(exp(({MERCATOR.y0!r}E0 + (row_i + 0.5E0) * ({MERCATOR.dy!r}E0))
  / 6378137.0E0)) - pi() / 2), 2) / 10000.0E0"""


@query("p26_mercator_cell_area", sql("px", f"""
SELECT obs_id, row_i, count(*) AS n, {r6(f'max({MERC_HA})')} AS cell_ha FROM px GROUP BY obs_id, row_i"""))
def p26(spark, d):
    px = V.pixels(spark, d).groupBy("obs_id", "row_i").agg(F.count("*").alias("n"))
    return px.withColumn("cell_ha", G.mercator_cell_ha(F.col("row_i"), MERCATOR))


@query("p27_year_status", """
SELECT o_orderkey, 2018 + o_orderkey % 8 AS year, CASE WHEN o_custkey % 2 = 1 THEN 'reference' WHEN o_orderkey % 8 = 6 THEN 'provisional'
  WHEN o_orderkey % 8 >= 5 THEN 'method-change' ELSE 'reference' END AS note FROM orders""")
def p27(spark, d):
    year = 2018 + F.col("o_orderkey") % 8
    dataset = F.when(F.col("o_custkey") % 2 == 1, "groenkaart").otherwise("jaarbak")
    return V.table(spark, d, "orders").select("o_orderkey", year.alias("year"), P.year_status(dataset, year).alias("note"))


COLORS = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in M.SCORE_COLORS.items())


@query("p28_with_color", sql("score", f"""
SELECT rec_id, CASE render_class {COLORS} ELSE '#EAE2DE' END AS color FROM (
SELECT rec_id, CASE WHEN status = 'scored' THEN 'score-' || CAST(final_score AS VARCHAR)
  WHEN status = 'insufficient-data' THEN 'no-data' ELSE status END AS render_class FROM ({SCORED}))"""))
def p28(spark, d):
    classes = scored(spark, d).select("rec_id", S.score_class(F.col("final_score"), F.col("status")).alias("render_class"))
    return TB.with_color(classes, "render_class", M.SCORE_COLORS, "#EAE2DE").select("rec_id", "color")


RAMP3 = [(0.0, "#000000"), (0.5, "#804020"), (1.0, "#ff8000")]


def _ramp_sql(at):
    def ch(i):
        return int(RAMP3[i][1][1 + 2 * at:3 + 2 * at], 16)
    return f"""lpad(lower(printf('%x', CAST(floor(CASE WHEN v < 0.5 THEN {ch(0)} + v / 0.5E0 * {ch(1) - ch(0)}
      ELSE {ch(1)} + (v - 0.5E0) / 0.5E0 * {ch(2) - ch(1)} END + 0.5E0) AS INT))), 2, '0')"""


@query("p29_ramp", sql("px", f"""
SELECT obs_id, row_i, col_i, '#' || {_ramp_sql(0)} || {_ramp_sql(1)} || {_ramp_sql(2)} AS color
FROM (SELECT *, (temp_c - 10.0E0) / 45.0E0 AS v FROM px)"""))
def p29(spark, d):
    return V.pixels(spark, d).select("obs_id", "row_i", "col_i", N.ramp((F.col("temp_c") - 10.0) / 45.0, RAMP3).alias("color"))


@query("p30_in_scope", sql("zone", """
SELECT z.sector_id, s.scope FROM zone z JOIN (VALUES ('all'), ('ASIA'), ('AFRICA')) s(scope) ON s.scope = 'all' OR s.scope = z.municipality"""))
def p30(spark, d):
    return TB.in_scopes(V.zones(spark, d), "municipality", ["all", "ASIA", "AFRICA"]).select("sector_id", "scope")


# Own patterns from the published formats: RFC 6750 and RFC 7519 (three base64url parts whose first encodes a JSON
# object, hence "ey"), file URLs of personal folders, and secrets given in URLs or settings.
SECRETS = {
    "bearer-credentials": r"(?i)authorization: *bearer +[a-z0-9._~+/-]+=*",
    "signed-token": r"\bey[\w-]{10,}\.ey[\w-]{10,}\.[\w-]{8,}",
    "home-folder": r"(?i)(/home/|/users/|[a-z]:.users.)[a-z0-9._-]+",
    "secret-setting": r"(?i)(client|app)[_-]?secret[\"' ]*[:=]",
    "signature-in-url": r"[?&](sig|X-Amz-Signature|Signature)=[A-Za-z0-9%/+=-]{16,}",
}
SCAN = {"mail": r"[A-Za-z0-9._]+@[A-Za-z0-9.]+", "api-key": r"(?i)(api|secret|token)[_ -]?key", "phone": r"\+\d{2}[ \d]{8,}",
        **SECRETS}


@query("p31_scan_forbidden", " UNION ALL ".join(
    "SELECT doc_id, '{0}' AS label FROM documents WHERE regexp_matches(text, '{1}')".format(k, v.replace("'", "''"))
    for k, v in SCAN.items()))
def p31(spark, d):
    return TB.scan_patterns(spread(V.table(spark, d, "documents").select("doc_id", "text")), "text", SCAN).select("doc_id", "label")


@query("x01_slug", """
SELECT p_partkey, trim(regexp_replace(lower(p_name || ' / ' || p_type || '!'), '[^a-z0-9]+', '-', 'g'), '-') AS slug,
  trim(regexp_replace(lower('Éc ' || p_name || ' Maïs'), '[^a-z0-9éï]+', '-', 'g'), '-') AS raw_slug,
  trim(regexp_replace(replace(replace(lower('Éc ' || p_name || ' Maïs'), 'é', 'e'), 'ï', 'i'), '[^a-z0-9]+', '-', 'g'), '-') AS folded
FROM part""")
def x01(spark, d):
    accented = F.concat(F.lit("Éc "), F.col("p_name"), F.lit(" Maïs"))
    return V.table(spark, d, "part").select(
        "p_partkey", X.slug(F.concat_ws(" / ", "p_name", F.concat("p_type", F.lit("!")))).alias("slug"),
        F.trim(F.regexp_replace(F.lower(accented), "[^a-z0-9éï]+", "-"), F.lit("-")).alias("raw_slug"),
        X.folded_slug(accented).alias("folded"))


@query("x02_class_code", "SELECT p_partkey, lpad(CAST(p_size * 100 AS VARCHAR), 5, '0') AS code FROM part")
def x02(spark, d):
    return V.table(spark, d, "part").select("p_partkey", X.class_code(F.col("p_size") * 100).alias("code"))


@query("x03_names", """
SELECT o_orderkey, year(o_orderdate)::INT AS year, CAST(o_orderdate AS DATE) AS day, CASE WHEN o_custkey % 2 = 0 THEN 'T31UFS' ELSE 'T31UES' END AS tile
FROM orders""")
def x03(spark, d):
    tile = F.when(F.col("o_custkey") % 2 == 0, "T31UFS").otherwise("T31UES")
    name = F.concat(F.lit("ndvi_"), F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit("_"), tile, F.lit(".tif"))
    return V.table(spark, d, "orders").select("o_orderkey", X.year_in(name).alias("year"), X.date_in(name).alias("day"),
                                              F.regexp_extract(name, "(T31U(?:FS|ES))", 1).alias("tile"))


@query("x04_property_value", """
SELECT p_partkey, p_brand AS brand, CAST(NULL AS VARCHAR) AS missing FROM part""")
def x04(spark, d):
    props = F.create_map(F.when(F.col("p_partkey") % 2 == 0, "Brand").otherwise("BRAND"), F.col("p_brand"), F.lit("Type"), F.col("p_type"))
    return V.table(spark, d, "part").select("p_partkey", X.property_value(props, "brand").alias("brand"),
                                            X.property_value(props, "absent").alias("missing"))


@query("x05_labels", sql("zone", "SELECT sector_id, trim(lower('  ' || sector_name || ' ')) || ' — ' || municipality AS label FROM zone"))
def x05(spark, d):
    name = F.trim(F.lower(F.concat(F.lit("  "), "sector_name", F.lit(" "))))
    return V.zones(spark, d).select("sector_id", F.concat_ws(" — ", name, "municipality").alias("label"))


@query("x06_dates", """
SELECT o_orderkey, CAST(o_orderdate AS DATE) AS day, CAST(abs(2 * date_diff('day', DATE '1998-06-05', CAST(o_orderdate AS DATE)) - 11) AS INT) AS half_days,
  CAST(abs(date_diff('day', make_date(year(o_orderdate), 7, 15), CAST(o_orderdate AS DATE))) AS INT) AS to_target FROM orders""")
def x06(spark, d):
    day = F.to_date("o_orderdate")
    return V.table(spark, d, "orders").select(
        "o_orderkey", day.alias("day"),
        X.midpoint_distance(day, F.lit("1998-06-05").cast("date"), F.lit("1998-06-16").cast("date")).alias("half_days"),
        X.days_to_target(day, 7, 15).alias("to_target"))


BRUSSELS = """o_orderdate + INTERVAL 1 HOUR * (o_orderkey % 24)"""


@query("x07_brussels_time", f"""
WITH t AS (SELECT o_orderkey, {BRUSSELS} AS u FROM orders),
k AS (SELECT o_orderkey, u, make_date(year(u), 3, 31) AS m, CASE WHEN year(u) < 1996 THEN make_date(year(u), 9, 30) ELSE make_date(year(u), 10, 31) END AS o FROM t),
s AS (SELECT o_orderkey, u, u >= CAST(m - CAST(dayofweek(m) AS INT) AS TIMESTAMP) + INTERVAL 1 HOUR
      AND u < CAST(o - CAST(dayofweek(o) AS INT) AS TIMESTAMP) + INTERVAL 1 HOUR AS summer FROM k)
SELECT o_orderkey, strftime(u + CASE WHEN summer THEN INTERVAL 2 HOUR ELSE INTERVAL 1 HOUR END, '%Y-%m-%d %H:%M')
  || CASE WHEN summer THEN ' CEST' ELSE ' CET' END AS local_text FROM s""")
def x07(spark, d):
    instant = F.col("o_orderdate").cast("timestamp") + F.make_interval(hours=(F.col("o_orderkey") % 24).cast("int"))
    return V.table(spark, d, "orders").select("o_orderkey", X.brussels_time(instant).alias("local_text"))


@query("x08_rounding", f"""
SELECT l_orderkey, l_linenumber, floor(v * 100.0E0 + 0.5E0) / 100.0E0 AS up2, round_even(v * 8, 0) / 8 AS even8, round_even(v, 0) AS nearest
FROM (SELECT l_orderkey, l_linenumber, l_quantity / 8.0E0 AS v FROM lineitem)""")
def x08(spark, d):
    v = F.col("l_quantity") / 8.0
    return V.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", N.half_up(v, 2).alias("up2"),
                                                (F.rint(v * 8) / 8).alias("even8"), N.half_even(v, 0).alias("nearest"))


@query("x09_ratio", f"""
SELECT c_custkey, least(greatest(c_acctbal, 0), 5000) AS limited, CASE WHEN c_acctbal > 0 THEN {r6('c_custkey / c_acctbal * 100')} ELSE 0 END AS pct0,
  CASE WHEN c_acctbal > 0 THEN {r6('c_custkey / c_acctbal')} END AS share FROM customer""")
def x09(spark, d):
    b = F.col("c_acctbal")
    return V.table(spark, d, "customer").select("c_custkey", N.clamp(b, 0.0, 5000.0).alias("limited"),
                                                N.percentage(F.col("c_custkey"), b).alias("pct0"), N.ratio(F.col("c_custkey"), b).alias("share"))


@query("x10_component_scores", """
WITH c AS (SELECT p_partkey, unnest([struct_pack(grp := 'population', w := 1.0E0, s := p_size % 11), struct_pack(grp := 'facilities', w := 0.5E0, s := p_size % 7),
  struct_pack(grp := 'facilities', w := 0.5E0, s := p_size % 5), struct_pack(grp := 'socioeconomic', w := 2.0E0, s := p_size % 3)]) AS x FROM part)
SELECT x.grp AS grp, CAST(sum(x.s) AS DOUBLE) AS total, sum(x.s * x.w) AS weighted, count(*) AS n FROM c GROUP BY x.grp""")
def x10(spark, d):
    size = F.col("p_size")
    scores = S.component_map({"populationDensity": size % 11, "childcare": size % 7, "hospitals": size % 5, "sesIndex": size % 3})
    return TB.component_groups(V.table(spark, d, "part").select("p_partkey", scores.alias("components")), "components", M.SCORE_COMPONENTS)


@query("x11_localised", """
SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN c_name WHEN c_custkey % 3 = 1 THEN c_mktsegment ELSE 'untitled' END AS title FROM customer""")
def x11(spark, d):
    k = F.col("c_custkey") % 3
    titles = (F.when(k == 0, F.create_map(F.lit("en"), "c_name", F.lit("nl"), "c_mktsegment"))
              .when(k == 1, F.create_map(F.lit("nl"), "c_mktsegment")).otherwise(F.create_map(F.lit("fr"), "c_name")))
    return V.table(spark, d, "customer").select("c_custkey", X.localised(titles, "untitled").alias("title"))


@query("x12_strict_json", """
SELECT event_id, CASE WHEN event_id % 3 = 0 THEN '{"id":' || event_id || ',"kind":"' || event_type || '"}'
  ELSE '{"id":' || event_id || ',"kind":"' || event_type || '","n":' || (event_id % 10) || '.5}' END AS json,
  CAST(coalesce(CASE WHEN event_id % 2 = 0 THEN 2 END, 1) AS INT) AS version,
  sha256('{"a":"' || event_type || '","b":"' || user_id || '"}') AS request FROM events""")
def x12(spark, d):
    e = F.col("event_id")
    n = F.when(e % 3 == 0, F.lit(float("nan"))).otherwise((e % 10) + 0.5)
    parts = F.create_map(F.lit("b"), F.col("user_id").cast("string"), F.lit("a"), F.col("event_type"))
    return V.table(spark, d, "events").select(
        "event_id", X.strict_json({"id": e, "kind": F.col("event_type"), "n": n}, {"n"}).alias("json"),
        X.schema_version(F.when(e % 2 == 0, 2)).alias("version"), X.request_hash(parts).alias("request"))


@query("x13_finite", """
SELECT event_id, event_id % 4 = 0 AS usable, CASE WHEN event_id % 4 = 0 THEN value END AS value FROM events""")
def x13(spark, d):
    e = F.col("event_id") % 4
    v = (F.when(e == 0, F.col("value")).when(e == 1, F.lit(float("nan"))).when(e == 2, F.lit(float("-inf"))))
    return V.table(spark, d, "events").select("event_id", N.finite(v).alias("usable"), N.finite_or_null(v).alias("value"))


@query("x14_safe_asset", """
SELECT page_id, page_id % 4 NOT IN (1, 2) AND page_id % 5 <> 0 AS safe, url LIKE 'https://_%' AS secure FROM pages""")
def x14(spark, d):
    k = F.col("page_id")
    path = F.concat(F.when(k % 4 == 1, "../").when(k % 4 == 2, "/srv/").otherwise("data/"), k.cast("string"),
                    F.when(k % 5 == 0, ".exe").otherwise(".JSON"))
    return V.table(spark, d, "pages").select("page_id", X.safe_asset(path, ".json").alias("safe"), X.https_link(F.col("url")).alias("secure"))
