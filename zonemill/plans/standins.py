"""Stand-in views: the driver tables read as pixels, zones, polygons, scenes and facts.

Every view exists twice, as a DataFrame and as SQL, and reads its whole table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from zonemill.model import Grid

SIDE = 100  # columns of the stand-in grid; each 10 000 events are one observation
GRID = Grid(0.0, 0.0, 1.0, 1.0, SIDE, SIDE)
CELL_HA = 0.25

SQL = {
    "px": """
SELECT CAST(floor(event_id / 10000.0) AS BIGINT) AS obs_id,
       CAST(floor((event_id % 10000) / 100.0) AS BIGINT) AS row_i, event_id % 100 AS col_i,
       CASE event_type WHEN 'view' THEN 1 WHEN 'click' THEN 2 WHEN 'purchase' THEN 3
                       WHEN 'signup' THEN 4 ELSE 0 END AS code,
       CASE WHEN user_id % 10 = 0 THEN 0 WHEN user_id % 10 = 1 THEN 2 ELSE 1 END AS status,
       10.0E0 + value - 45.0E0 * floor(value / 45.0E0) AS temp_c,
       (event_id * 7919 % 1000) / 1000.0E0 AS b04, (event_id * 104729 % 1000) / 1000.0E0 AS b08,
       event_id % 12 AS scl, CASE WHEN event_id % 17 = 0 THEN 0 ELSE 1 END AS data_mask,
       event_id * 48271 % 65536 AS dn, event_id * 69621 % 64 AS qa_pixel, event_id * 16807 % 512 AS qa_radsat,
       CAST(ts AS DATE) AS obs_date
FROM events""",
    "px0": """
SELECT CAST(floor(o_orderkey / 10000.0) AS BIGINT) AS obs_id,
       CAST(floor((o_orderkey % 10000) / 100.0) AS BIGINT) AS row_i, o_orderkey % 100 AS col_i,
       CAST(substr(o_orderpriority, 1, 1) AS INT) - 1 AS code0
FROM orders""",
    "zone": """
SELECT n_nationkey AS sector_id, n_name AS sector_name, n_regionkey AS muni_id, r_name AS municipality,
       20 * (n_nationkey % 5) AS c0, 20 * (n_nationkey % 5) + 20 AS c1,
       20 * CAST(floor(n_nationkey / 5.0) AS INT) AS r0, 20 * CAST(floor(n_nationkey / 5.0) AS INT) + 20 AS r1
FROM nation JOIN region ON n_regionkey = r_regionkey""",
    "pz": """
SELECT px.*, sector_id, municipality FROM px JOIN zone
  ON row_i >= r0 AND row_i < r1 AND col_i >= c0 AND col_i < c1""",
    "zpx": """
SELECT o.obs_id, sector_id, municipality, p.* EXCLUDE (obs_id) FROM (SELECT DISTINCT obs_id FROM px) o CROSS JOIN zone
  LEFT JOIN px p ON p.obs_id = o.obs_id AND row_i >= r0 AND row_i < r1 AND col_i >= c0 AND col_i < c1""",
    "poly": """
SELECT s_suppkey AS poly_id, s_nationkey AS class_code,
       (s_suppkey * 37) % 100 AS cx, (s_suppkey * 53) % 100 AS cy, 2 + s_suppkey % 7 AS r
FROM supplier""",
    "area_fact": """
SELECT s_nationkey AS sector_id, l_linenumber AS class_code, sum(l_quantity) AS area_m2
FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY s_nationkey, l_linenumber""",
    "scene": """
SELECT o_orderkey AS scene_id, o_orderdate AS acquired_at, CAST(o_orderdate AS DATE) AS d, o_custkey % 3 AS tile,
       o_totalprice - 100.0E0 * floor(o_totalprice / 100.0E0) AS cloud_pct,
       CASE o_orderstatus WHEN 'F' THEN 'T1' ELSE 'T2' END AS category
FROM orders""",
    "period": "\nSELECT * FROM (VALUES " + ", ".join(
        f"('{y}', DATE '{y}-06-05', DATE '{y}-06-16')" for y in range(1995, 2002)) + ") AS v(period_id, d0, d1)",
    "fiscal": """
SELECT c_nationkey AS sector_id, 2019 + c_custkey % 5 AS year,
       CASE WHEN c_custkey % 11 = 0 THEN '.' WHEN c_custkey % 13 = 0 THEN 'C'
            ELSE CAST(c_acctbal AS VARCHAR) END AS raw_value
FROM customer""",
    "score": """
SELECT p_partkey AS rec_id, CASE WHEN p_size = 50 THEN 9999 WHEN p_size = 49 THEN NULL ELSE p_size % 11 END AS final_score
FROM part""",
}
NEEDS = {"pz": ["px", "zone"], "zpx": ["px", "zone"]}


def sql(views: str, body: str) -> str:
    """SQL text over stand-in views: ``views`` names the ones the body uses."""
    wanted: list[str] = []
    for name in views.split():
        for item in [*NEEDS.get(name, []), name]:
            if item not in wanted:
                wanted.append(item)
    body = body.strip()
    head = ",\n".join(f"{name} AS ({SQL[name].strip()})" for name in wanted)
    if body.upper().startswith("WITH "):
        return f"WITH {head},\n{body[5:]}"
    return f"WITH {head}\n{body}"


def r6(expression: str) -> str:
    """SQL twin of the presentation rounding."""
    return f"floor(({expression}) * 1000000.0E0 + 0.5E0) / 1000000.0E0"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def pixels(spark: SparkSession, folder: str) -> DataFrame:
    e = F.col("event_id")
    user = F.col("user_id") % 10
    kind = F.col("event_type")
    return table(spark, folder, "events").select(
        F.floor(e / 10000.0).alias("obs_id"), F.floor((e % 10000) / 100.0).alias("row_i"), (e % 100).alias("col_i"),
        F.when(kind == "view", 1).when(kind == "click", 2).when(kind == "purchase", 3)
         .when(kind == "signup", 4).otherwise(0).alias("code"),
        F.when(user == 0, 0).when(user == 1, 2).otherwise(1).alias("status"),
        (10.0 + F.col("value") - 45.0 * F.floor(F.col("value") / 45.0)).alias("temp_c"),
        (e * 7919 % 1000 / 1000.0).alias("b04"), (e * 104729 % 1000 / 1000.0).alias("b08"),
        (e % 12).alias("scl"), F.when(e % 17 == 0, 0).otherwise(1).alias("data_mask"),
        (e * 48271 % 65536).alias("dn"), (e * 69621 % 64).alias("qa_pixel"), (e * 16807 % 512).alias("qa_radsat"),
        F.to_date("ts").alias("obs_date"))


def baseline(spark: SparkSession, folder: str) -> DataFrame:
    k = F.col("o_orderkey")
    return table(spark, folder, "orders").select(
        F.floor(k / 10000.0).alias("obs_id"), F.floor((k % 10000) / 100.0).alias("row_i"), (k % 100).alias("col_i"),
        (F.substring("o_orderpriority", 1, 1).cast("int") - 1).alias("code0"))


def zones(spark: SparkSession, folder: str) -> DataFrame:
    k = F.col("n_nationkey")
    region = table(spark, folder, "region")
    return table(spark, folder, "nation").join(region, F.col("n_regionkey") == F.col("r_regionkey")).select(
        k.alias("sector_id"), F.col("n_name").alias("sector_name"), F.col("n_regionkey").alias("muni_id"),
        F.col("r_name").alias("municipality"),
        (20 * (k % 5)).alias("c0"), (20 * (k % 5) + 20).alias("c1"),
        (20 * F.floor(k / 5.0).cast("int")).alias("r0"), (20 * F.floor(k / 5.0).cast("int") + 20).alias("r1"))


def _point(x, y):
    return F.struct(F.lit(x).cast("double").alias("x") if not hasattr(x, "cast") else x.cast("double").alias("x"),
                    F.lit(y).cast("double").alias("y") if not hasattr(y, "cast") else y.cast("double").alias("y"))


def zone_polygons(spark: SparkSession, folder: str) -> DataFrame:
    """The zones as closed counter-clockwise rectangles (x = column axis, y = row axis)."""
    c0, c1, r0, r1 = (F.col(n) for n in ("c0", "c1", "r0", "r1"))
    ring = F.array(_point(c0, r0), _point(c1, r0), _point(c1, r1), _point(c0, r1), _point(c0, r0))
    return zones(spark, folder).select("sector_id", "sector_name", "municipality", F.array(F.array(ring)).alias("geom"))


def diamonds(spark: SparkSession, folder: str) -> DataFrame:
    s = F.col("s_suppkey")
    return table(spark, folder, "supplier").select(
        s.alias("poly_id"), F.col("s_nationkey").alias("class_code"),
        (s * 37 % 100).alias("cx"), (s * 53 % 100).alias("cy"), (2 + s % 7).alias("r"))


def diamond_polygons(spark: SparkSession, folder: str) -> DataFrame:
    cx, cy, r = (F.col(n) for n in ("cx", "cy", "r"))
    ring = F.array(_point(cx + r, cy), _point(cx, cy + r), _point(cx - r, cy), _point(cx, cy - r), _point(cx + r, cy))
    return diamonds(spark, folder).select("poly_id", "class_code", F.array(F.array(ring)).alias("geom"))


def area_facts(spark: SparkSession, folder: str) -> DataFrame:
    items, suppliers = table(spark, folder, "lineitem"), table(spark, folder, "supplier")
    return (items.join(suppliers, F.col("l_suppkey") == F.col("s_suppkey"))
            .groupBy(F.col("s_nationkey").alias("sector_id"), F.col("l_linenumber").alias("class_code"))
            .agg(F.sum("l_quantity").alias("area_m2")))


def scenes(spark: SparkSession, folder: str) -> DataFrame:
    price = F.col("o_totalprice")
    return table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("scene_id"), F.col("o_orderdate").alias("acquired_at"),
        F.to_date("o_orderdate").alias("d"), (F.col("o_custkey") % 3).alias("tile"),
        (price - 100.0 * F.floor(price / 100.0)).alias("cloud_pct"),
        F.when(F.col("o_orderstatus") == "F", "T1").otherwise("T2").alias("category"))


def periods(spark: SparkSession) -> DataFrame:
    rows = ", ".join(f"('{y}', DATE '{y}-06-05', DATE '{y}-06-16')" for y in range(1995, 2002))
    return spark.sql(f"SELECT * FROM VALUES {rows} AS v(period_id, d0, d1)")


def fiscal(spark: SparkSession, folder: str) -> DataFrame:
    k = F.col("c_custkey")
    return table(spark, folder, "customer").select(
        F.col("c_nationkey").alias("sector_id"), (2019 + k % 5).alias("year"),
        F.when(k % 11 == 0, ".").when(k % 13 == 0, "C").otherwise(F.col("c_acctbal").cast("string")).alias("raw_value"))


def scores(spark: SparkSession, folder: str) -> DataFrame:
    size = F.col("p_size")
    return table(spark, folder, "part").select(
        F.col("p_partkey").alias("rec_id"),
        F.when(size == 50, 9999).when(size == 49, F.lit(None)).otherwise(size % 11).cast("int").alias("final_score"))
