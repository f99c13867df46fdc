"""Readers. Every read has an explicit schema; nothing is inferred from the data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from zonemill.functions.text import date_in, property_value, year_in
from zonemill.model import FEATURE
from zonemill.operators.geometry import parse_coordinates


def parse_feature_lines(lines: DataFrame, id_property: str, column: str = "value") -> DataFrame:
    """Lines of a large collection, one feature per line, as feature_id, properties, kind, geom.

    Lines that are no feature are skipped, a trailing comma is dropped.
    """
    trimmed = F.trim(F.col(column))
    feature = F.from_json(F.regexp_replace(trimmed, r",\s*$", ""), FEATURE)
    rows = lines.where(trimmed.rlike(r'^\{\s*"type"\s*:\s*"Feature"')).select(feature.alias("f"))
    return _feature_columns(rows, id_property)


def _feature_columns(rows: DataFrame, id_property: str) -> DataFrame:
    kind = F.col("f.geometry.type")
    return rows.select(property_value(F.col("f.properties"), id_property).alias("feature_id"), F.col("f.properties").alias("properties"),
                       kind.alias("kind"), parse_coordinates(kind, F.col("f.geometry.coordinates")).alias("geom"))


def read_features(spark: SparkSession, path: str, id_property: str, wanted: DataFrame | None = None) -> DataFrame:
    """Line-wise feature reader; splittable, and filtered to the wanted ids (one column, feature_id) while scanning."""
    features = parse_feature_lines(spark.read.text(path), id_property)
    return features if wanted is None else features.join(wanted.select("feature_id"), "feature_id", "left_semi")


def read_feature_collection(spark: SparkSession, path: str, id_property: str) -> DataFrame:
    """Whole documents; each file is one JSON object, so files are the unit of parallelism."""
    schema = T.StructType([T.StructField("features", T.ArrayType(FEATURE))])
    rows = spark.read.schema(schema).json(path, multiLine=True).select(F.explode("features").alias("f"))
    return _feature_columns(rows, id_property)


def read_fiscal(spark: SparkSession, path: str, columns: list[str], years: list[int], zones: DataFrame | None = None,
                year: str = "year", zone: str = "sector_id") -> DataFrame:
    """Pipe-delimited facts as text columns (suppression codes stay visible), wanted years and zones only."""
    schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])
    rows = spark.read.schema(schema).csv(path, sep="|", header=True).withColumn(year, F.col(year).try_cast("int")).where(F.col(year).isin(years))
    return rows if zones is None else rows.join(zones.select(F.col(zone).cast("string").alias(zone)), zone, "left_semi")


def last_per_year(rows: DataFrame, name: Column, pattern: str, order: Column) -> DataFrame:
    """Rows whose name matches, keyed by the year in it; the last row of a year wins."""
    columns = rows.columns
    matched = rows.withColumn("found", F.regexp_extract(name, pattern, 1)).where("found <> ''")
    best = matched.groupBy(F.col("found").cast("int").alias("catalogue_year")).agg(F.max_by(F.struct(*columns), order).alias("r"))
    return best.select("catalogue_year", "r.*")


def read_catalogue(spark: SparkSession, path: str, columns: list[str], pattern: str, name: str = "name") -> DataFrame:
    """Semicolon catalogue (a byte-order mark is allowed); the last matching row per year wins."""
    schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])
    rows = spark.read.schema(schema).csv(path, sep=";", header=True, encoding="UTF-8")
    # Splits are ordered by their start in the file, rows within a split by a running number.
    placed = rows.select("*", F.struct(F.col("_metadata.file_path"), F.col("_metadata.file_block_start"), F.monotonically_increasing_id()).alias("line"))
    return last_per_year(placed, F.col(name), pattern, F.col("line")).drop("line")


def read_observations(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    """Pixel tables with named bands; the observation date comes from the file name."""
    rows = spark.read.schema(schema).parquet(path)
    return rows.select("*", date_in(F.col("_metadata.file_name")).alias("obs_date"), F.col("_metadata.file_name").alias("source_file"))


def list_files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """File listing (path, length); the content column is pruned, files are not opened."""
    return (spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
            .select("path", "length", "modificationTime"))


def observation_inventory(files: DataFrame, sidecars: DataFrame, selection: DataFrame, selected_only: bool = True) -> DataFrame:
    """Observation files with date, year, quality and whether they are the selected one of their year.

    ``files`` (path), ``sidecars`` (path + quality columns), ``selection`` (year, selected_date).
    """
    dated = files.withColumn("date", date_in(F.col("path"))).where("date IS NOT NULL").withColumn("year", year_in(F.date_format("date", "yyyy")))
    rows = (dated.join(sidecars, "path", "left").join(selection, "year", "left")
            .withColumn("selected", F.coalesce(F.col("date") == F.col("selected_date"), F.lit(False))).drop("selected_date"))
    return (rows.where("selected") if selected_only else rows).orderBy("date", "path")
