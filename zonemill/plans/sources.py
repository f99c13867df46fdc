"""Sources, sinks and provenance on tables derived from the driver tables."""

from __future__ import annotations


from pyspark.sql import functions as F

from zonemill.operators import geometry as GE
from zonemill.plans import standins as V
from zonemill.plans.pixels import zoned
from zonemill.plans.registry import query
from zonemill.plans.standins import r6, sql
from zonemill.session import scratch
from zonemill.sources import provenance as PR
from zonemill.sources import readers as RD
from zonemill.sources import sinks as SK


def feature_lines(spark, d):
    """The diamonds as the lines of a collection: header and footer lines, trailing commas."""
    features = SK.feature_rows(V.diamond_polygons(spark, d).withColumn("label", F.concat(F.lit("poly-"), F.col("poly_id").cast("string"))),
                               "poly_id", ["poly_id", "class_code", "label"])
    noise = spark.sql("""SELECT explode(array('{"type": "FeatureCollection", "features": [', ']}', '')) AS value""")
    return features.select(F.concat(F.lit("  "), "value", F.lit(",")).alias("value")).unionByName(noise)


@query("s01_read_features", sql("poly", """
SELECT CAST(poly_id AS VARCHAR) AS feature_id, 'MultiPolygon' AS kind, CAST(class_code AS VARCHAR) AS class_code, 5 AS n_vertices, 2.0E0 * r * r AS area FROM poly WHERE class_code < 10"""))
def s01(spark, d):
    wanted = V.diamonds(spark, d).where("class_code < 10").select(F.col("poly_id").cast("string").alias("feature_id"))
    features = RD.parse_feature_lines(feature_lines(spark, d), "POLY_ID").join(wanted, "feature_id", "left_semi")
    return features.select("feature_id", "kind", F.col("properties")["class_code"].alias("class_code"),
                           GE.count_vertices(F.col("geom")).alias("n_vertices"), GE.polygon_area(F.col("geom")).alias("area"))


@query("s04_catalogue_last_wins", """
SELECT CAST(2000 + o_custkey % 30 AS INT) AS catalogue_year, max(o_orderkey) AS row_no, arg_max(o_totalprice, o_orderkey) AS price FROM orders
WHERE o_orderstatus <> 'P' GROUP BY o_custkey % 30""")
def s04(spark, d):
    o = V.table(spark, d, "orders")
    year = (2000 + F.col("o_custkey") % 30).cast("string")
    name = F.when(F.col("o_orderstatus") == "P", F.concat(F.lit("OTHER_"), year)).otherwise(F.concat(F.lit("TREE_S"), year, F.lit("_R10m")))
    rows = o.select(name.alias("name"), F.col("o_orderkey").alias("row_no"), F.col("o_totalprice").alias("price"))
    return RD.last_per_year(rows, F.col("name"), r"TREE_S(20\d{2})_R10m", F.col("row_no")).drop("name")


@query("s08_observation_inventory", """
WITH f AS (SELECT CAST(o_orderdate AS DATE) AS date, count(*) AS n, min(o_totalprice) AS quality FROM orders GROUP BY 1),
s AS (SELECT year(date)::INT AS year, arg_min(date, quality) AS selected_date FROM f GROUP BY 1)
SELECT date, year(date)::INT AS year, date = selected_date AS selected, CASE WHEN n >= 6 THEN n END AS n_products FROM f JOIN s ON s.year = year(date)""")
def s08(spark, d):
    days = V.table(spark, d, "orders").groupBy(F.to_date("o_orderdate").alias("day")).agg(F.count("*").alias("n"), F.min("o_totalprice").alias("quality"))
    path = F.concat(F.lit("/cache/ndvi-"), F.date_format("day", "yyyy-MM-dd"), F.lit("-10m.parquet"))
    files = days.select(path.alias("path"))
    sidecars = days.where("n >= 6").select(path.alias("path"), F.col("n").alias("n_products"))
    selection = days.groupBy(F.year("day").alias("year")).agg(F.min_by("day", "quality").alias("selected_date"))
    return RD.observation_inventory(files, sidecars, selection, selected_only=False).drop("path")


@query("s09_stats_sink", """
SELECT o_orderpriority AS dataset, year(o_orderdate)::INT AS year, o_orderstatus AS sector_id, count(*) AS n, max(o_totalprice) AS highest FROM orders GROUP BY ALL""")
def s09(spark, d):
    """Statistics written by dataset and year, one year replaced by a second write, and read back."""
    path = scratch(spark, "stats")
    stats = V.table(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("dataset"), F.year("o_orderdate").alias("year"),
                                                F.col("o_orderstatus").alias("sector_id")).agg(F.count("*").alias("n"), F.max("o_totalprice").alias("highest"))
    SK.write_stats(stats.withColumn("n", F.when(F.col("year") == 1998, -1).otherwise(F.col("n"))), path)
    SK.write_stats(stats.where("year = 1998"), path)
    schema = "sector_id string, n bigint, highest double, dataset string, year int"
    return spark.read.schema(schema).parquet(path).select("dataset", "year", "sector_id", "n", "highest")


@query("s10_manifest_files", sql("pz", """
SELECT obs_id, municipality, sector_id, count(*) AS n, sum(code)::BIGINT AS code_sum, max(code)::VARCHAR AS best FROM pz GROUP BY ALL"""))
def s10c(spark, d):
    """The same documents written as files by ranges of records, and read back."""
    path = scratch(spark, "manifests")
    stats = zoned(spark, d).groupBy("obs_id", "municipality", "sector_id").agg(
        F.count("*").alias("n"), F.sum("code").alias("code_sum"), F.max("code").cast("string").alias("best"))
    SK.write_manifests(stats, ["obs_id", "municipality"], "sector_id", ["n", "code_sum", "best"], path)
    back = SK.read_manifests(spark, path, "bigint", "struct<n: bigint, code_sum: bigint, best: string>")
    return back.select(F.col("obs_id").cast("bigint").alias("obs_id"), "municipality", F.col("id").alias("sector_id"), "record.*")


@query("s10_manifest", sql("pz", """
SELECT obs_id, municipality, '{' || string_agg('"' || sector_id || '":{"n":' || n || ',"code_sum":' || code_sum || ',"best":"' || best || '"}', ',' ORDER BY CAST(sector_id AS VARCHAR)) || '}' AS manifest
FROM (SELECT obs_id, municipality, sector_id, count(*) AS n, sum(code)::BIGINT AS code_sum, max(code)::VARCHAR AS best FROM pz GROUP BY ALL) GROUP BY obs_id, municipality"""))
def s10(spark, d):
    stats = zoned(spark, d).groupBy("obs_id", "municipality", "sector_id").agg(
        F.count("*").alias("n"), F.sum("code").alias("code_sum"), F.max("code").cast("string").alias("best"))
    return SK.to_manifest(stats, ["obs_id", "municipality"], "sector_id", ["n", "code_sum", "best"])


@query("s10_class_records", sql("pz", """
SELECT obs_id, sector_id, '{"classes":[' || string_agg('{"code":' || code || ',"n":' || n || '}', ',' ORDER BY code) || ']}' AS record
FROM (SELECT obs_id, sector_id, code, count(*) AS n FROM pz GROUP BY ALL) GROUP BY obs_id, sector_id"""))
def s10b(spark, d):
    counts = zoned(spark, d).groupBy("obs_id", "sector_id", "code").agg(F.count("*").alias("n"))
    nested = SK.nest_classes(counts, ["obs_id", "sector_id"], ["code", "n"], "code")
    return nested.select("obs_id", "sector_id", F.to_json(F.struct("classes")).alias("record"))


@query("s11_features", sql("poly", """
SELECT poly_id::VARCHAR AS feature_id, CASE WHEN poly_id % 3 = 0 THEN NULL ELSE 'class ' || class_code END AS label, CASE WHEN poly_id % 4 = 0 THEN NULL ELSE (r / 2.0E0) END AS size, true AS only_allowed FROM poly"""))
def s11(spark, d):
    k = F.col("poly_id")
    rows = V.diamond_polygons(spark, d).join(V.diamonds(spark, d).select("poly_id", "r"), "poly_id").select(
        "poly_id", "geom", F.when(k % 3 == 0, "  ").otherwise(F.concat(F.lit("class "), F.col("class_code").cast("string"))).alias("label"),
        F.when(k % 4 == 0, F.lit(float("nan"))).otherwise(F.col("r") / 2.0).alias("size"), F.lit("private").alias("owner"))
    read = RD.parse_feature_lines(SK.feature_rows(rows, "poly_id", ["poly_id", "label", "size"]), "poly_id")
    p = F.col("properties")
    return read.select("feature_id", F.try_element_at(p, F.lit("label")).alias("label"), F.try_element_at(p, F.lit("size")).cast("double").alias("size"),
                       F.try_element_at(p, F.lit("owner")).isNull().alias("only_allowed"))


@query("s12_dataset_index", """
SELECT 'orders' AS dataset, 'status' AS kind, o_orderstatus AS label, count(*) AS n, CAST(NULL AS VARCHAR) AS density FROM orders GROUP BY o_orderstatus
UNION ALL SELECT 'lines', 'flag', l_returnflag, count(*), 'available' FROM lineitem GROUP BY l_returnflag""")
def s12(spark, d):
    a = V.table(spark, d, "orders").groupBy(F.col("o_orderstatus").alias("label")).agg(F.count("*").alias("n")).select(
        F.lit("orders").alias("dataset"), F.lit("status").alias("kind"), "label", "n")
    b = V.table(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("label")).agg(F.count("*").alias("n")).select(
        F.lit("lines").alias("dataset"), F.lit("flag").alias("kind"), "label", "n", F.lit("available").alias("density"))
    return SK.dataset_index([a, b], ["dataset", "kind", "label", "n", "density"])


@query("s13_publish_observations", """
SELECT o_orderkey AS obs_id, o_totalprice, 'query/' || o_orderkey || '.parquet' AS asset FROM orders
WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R' AND l_linestatus = 'O')""")
def s13(spark, d):
    timeline = V.table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("obs_id"), F.when(F.col("l_returnflag") == "R", "heatwave").otherwise("other").alias("kind"),
        F.when(F.col("l_linestatus") == "O", "available").otherwise("hidden").alias("status"))
    return SK.publish_observations(V.table(spark, d, "orders").select(F.col("o_orderkey").alias("obs_id"), "o_totalprice"), timeline)


@query("s14_content_hash", """
SELECT doc_id, sha256(text) AS sha256, md5(text) AS md5, CAST(octet_length(encode(text)) AS BIGINT) AS n_bytes FROM documents""")
def s14(spark, d):
    return PR.with_content_hash(V.table(spark, d, "documents").select("doc_id", "text"), "text").drop("text")


@query("s14_check_pins", """
SELECT doc_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l JOIN documents e ON e.doc_id = l.doc_id WHERE l.quality = 1 AND sha256(e.text) = sha256(d.text)
AND octet_length(encode(e.text)) = octet_length(encode(d.text)))""")
def s14b(spark, d):
    hashed = PR.with_content_hash(V.table(spark, d, "documents").select("doc_id", "text"), "text").drop("text")
    pins = hashed.join(V.table(spark, d, "labels").where("quality = 1").select("doc_id"), "doc_id", "left_semi")
    return PR.check_pins(hashed, pins).select("doc_id")


@query("s15_pending_partitions", f"""
WITH w AS (SELECT o_orderpriority AS dataset, year(o_orderdate)::INT AS year, sum(o_orderkey)::BIGINT AS source_hash, count(*) AS n_expected FROM orders GROUP BY ALL),
s AS (SELECT o_orderpriority AS dataset, year(o_orderdate)::INT AS year, sum(o_orderkey)::BIGINT AS source_hash, count(*) AS n FROM orders
  WHERE o_orderdate < TIMESTAMP '1999-03-01' GROUP BY ALL)
SELECT w.* FROM w LEFT JOIN s ON s.dataset = w.dataset AND s.year = w.year AND s.source_hash = w.source_hash AND s.n = w.n_expected WHERE s.dataset IS NULL""")
def s15(spark, d):
    def shape(rows):
        return rows.groupBy(F.col("o_orderpriority").alias("dataset"), F.year("o_orderdate").alias("year")).agg(
            F.sum("o_orderkey").alias("source_hash"), F.count("*").alias("n_expected"))
    o = V.table(spark, d, "orders")
    stored = shape(o.where("o_orderdate < TIMESTAMP_NTZ '1999-03-01 00:00:00'")).withColumnRenamed("n_expected", "n_records")
    return PR.pending_partitions(shape(o), stored)


@query("s07_observation_dates", sql("px", f"""
SELECT obs_date, count(*) AS n, {r6('avg(temp_c)')} AS mean_c FROM px GROUP BY obs_date"""))
def s07(spark, d):
    """Observation date out of a file-like name, as the observation reader does it."""
    from zonemill.functions.text import date_in
    name = F.concat(F.lit("bands-"), F.date_format("obs_date", "yyyy-MM-dd"), F.lit(".parquet"))
    px = V.pixels(spark, d).select(name.alias("file_name"), "temp_c")
    return px.groupBy(date_in(F.col("file_name")).alias("obs_date")).agg(F.count("*").alias("n"), F.avg("temp_c").alias("mean_c"))


@query("s03_fiscal_rows", sql("fiscal", """
SELECT sector_id, year, raw_value FROM fiscal WHERE year IN (2019, 2021) AND sector_id IN (SELECT s_nationkey FROM supplier)"""))
def s03(spark, d):
    """Lines of a pipe-delimited file, wanted years and zones kept."""
    lines = V.fiscal(spark, d).select(F.concat_ws("|", F.col("year").cast("string"), F.col("sector_id").cast("string"), "raw_value").alias("value"))
    parsed = lines.select(F.from_csv("value", F.lit("year BIGINT, sector_id INT, raw_value STRING"), {"sep": "|"}).alias("f")).select("f.*")
    wanted = V.table(spark, d, "supplier").select(F.col("s_nationkey").alias("sector_id"))
    return parsed.where(F.col("year").isin(2019, 2021)).join(wanted, "sector_id", "left_semi")


@query("s02_feature_collection", sql("poly", "SELECT CAST(poly_id AS VARCHAR) AS feature_id, 'MultiPolygon' AS kind, 2.0E0 * r * r AS area FROM poly"))
def s02(spark, d):
    """Whole documents of ten features, taken apart into features."""
    from zonemill.model import FEATURE
    rows = V.diamond_polygons(spark, d)
    # Ten features a document, so that a document stays small however many features there are.
    features = SK.feature_rows(rows, "poly_id", ["poly_id"]).withColumn(
        "bucket", F.floor(F.get_json_object("value", "$.id").cast("bigint") / 10))
    documents = features.groupBy("bucket").agg(F.concat(F.lit('{"type":"FeatureCollection","features":['), F.array_join(F.collect_list("value"), ","), F.lit("]}")).alias("doc"))
    parsed = documents.select(F.explode(F.from_json("doc", "struct<features: array<" + FEATURE.simpleString() + ">>")["features"]).alias("f"))
    out = RD._feature_columns(parsed, "poly_id")
    return out.select("feature_id", "kind", GE.polygon_area(F.col("geom")).alias("area"))
