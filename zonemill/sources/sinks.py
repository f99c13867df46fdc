"""Sinks: partitioned statistics, nested records, features, the catalogue index and publication."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from zonemill.functions.numbers import finite_or_null


def write_stats(df: DataFrame, path: str, partitions: tuple[str, ...] = ("dataset", "year")) -> None:
    """Statistics by dataset and year; only the partitions in ``df`` are replaced."""
    (df.repartition(*partitions).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy(*partitions).parquet(path))


def record_json(df: DataFrame, id_column: str, columns: list[str]) -> DataFrame:
    """One JSON record per row: the form for results of any size (a line per zone)."""
    return df.select(F.col(id_column), F.to_json(F.struct(*finite_columns(df, columns))).alias("record"))


def to_manifest(df: DataFrame, keys: list[str], id_column: str, columns: list[str]) -> DataFrame:
    """One JSON document per key: id → record, ids in order.

    A document holds the records of one key (a dataset, year and municipality); choose the keys so that
    this is bounded, and use ``write_manifests`` or ``record_json`` for open-ended lists.
    """
    entry = F.struct(F.col(id_column).cast("string").alias("key"), F.struct(*finite_columns(df, columns)).alias("value"))
    document = F.map_from_entries(F.array_sort(F.collect_list(entry)))
    return df.groupBy(*keys).agg(F.to_json(document).alias("manifest"))


def write_manifests(df: DataFrame, keys: list[str], id_column: str, columns: list[str], path: str, parts: int | None = None) -> None:
    """The documents of ``to_manifest`` as files, of any size: below ``path``, one folder per key.

    Records are dealt out by ranges of (keys, id), so a large document is written by several tasks at once; its part
    files, in the order of their names, are the document. Ids are unique within a key. No record list is ever collected.
    """
    ident = F.col(id_column).cast("string")
    ends = df.groupBy(*[F.col(k).alias(f"of_{k}") for k in keys]).agg(F.min(ident).alias("first_id"), F.max(ident).alias("last_id"))
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"of_{k}")) for k in keys])
    name = F.regexp_extract(F.to_json(F.struct(ident.alias("k"))), r'^\{"k":(.*)\}$', 1)  # quoted and escaped
    line = F.concat(F.when(ident == F.col("first_id"), "{").otherwise(","), name, F.lit(":"), F.to_json(F.struct(*finite_columns(df, columns))),
                    F.when(ident == F.col("last_id"), "}").otherwise(""))
    rows = df.join(ends, same).select(*keys, ident.alias("ident"), line.alias("value"))
    dealt = rows.repartitionByRange(parts, *keys, "ident") if parts else rows.repartitionByRange(*keys, "ident")
    dealt.sortWithinPartitions(*keys, "ident").drop("ident").write.mode("overwrite").partitionBy(*keys).text(path)


def read_manifests(spark: SparkSession, path: str, id_type: str, record: str) -> DataFrame:
    """The records of ``write_manifests``, a row each: keys, ``id``, ``record`` (a struct of the given type)."""
    lines = spark.read.text(path)
    body = F.regexp_replace(F.col("value"), r"^,", "{")
    closed = F.when(body.endswith("}}"), body).otherwise(F.concat(body, F.lit("}")))
    entry = F.from_json(closed, f"map<string,{record}>")
    return lines.select(*[c for c in lines.columns if c != "value"], F.explode(entry).alias("id", "record")).withColumn("id", F.col("id").cast(id_type))


def nest_classes(df: DataFrame, keys: list[str], columns: list[str], order: str) -> DataFrame:
    """Class rows of a record as one array, ordered; a record has at most as many as there are classes."""
    item = F.struct(F.col(order).alias("_o"), F.struct(*columns).alias("_c"))
    rows = F.transform(F.array_sort(F.collect_list(item)), lambda s: s["_c"])
    return df.groupBy(*keys).agg(rows.alias("classes"))


def finite_columns(df: DataFrame, columns: list[str]) -> list[Column]:
    kinds = dict(zip(df.schema.names, [f.dataType for f in df.schema.fields]))
    return [finite_or_null(F.col(c)).alias(c) if isinstance(kinds[c], (T.DoubleType, T.FloatType)) else F.col(c) for c in columns]


def feature_rows(df: DataFrame, id_column: str, allowed: list[str], geom: str = "geom") -> DataFrame:
    """Features as JSON lines with only the allowed attributes and finite values; blank text becomes null."""
    kinds = {f.name: f.dataType for f in df.schema.fields}
    properties = F.struct(*[
        F.when(F.trim(F.col(c)) != "", F.col(c)).alias(c) if isinstance(kinds[c], T.StringType) else finite_columns(df, [c])[0]
        for c in allowed])
    coordinates = F.transform(F.col(geom), lambda p: F.transform(p, lambda r: F.transform(r, lambda v: F.array(v["x"], v["y"]))))
    feature = F.struct(F.lit("Feature").alias("type"), F.col(id_column).cast("string").alias("id"), properties.alias("properties"),
                       F.struct(F.lit("MultiPolygon").alias("type"), coordinates.alias("coordinates")).alias("geometry"))
    return df.select(F.to_json(feature).alias("value"))


def write_features(df: DataFrame, path: str, id_column: str, allowed: list[str], geom: str = "geom") -> int:
    """Write features and check that as many can be read back. Returns the count."""
    feature_rows(df, id_column, allowed, geom).write.mode("overwrite").text(path)
    written, expected = df.sparkSession.read.text(path).count(), df.count()
    if written != expected:
        raise ValueError(f"{path}: {written} features were written, {expected} expected")
    return written


def dataset_index(manifests: list[DataFrame], columns: list[str]) -> DataFrame:
    """Union of the per-dataset headers; capabilities a dataset lacks are null."""
    everything = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), manifests)
    missing = [F.lit(None).cast("string").alias(c) for c in columns if c not in everything.columns]
    return everything.select("*", *missing).select(*columns)


def publish_observations(obs: DataFrame, timeline: DataFrame, key: str = "obs_id", kind: str = "heatwave", prefix: str = "query/") -> DataFrame:
    """Observations on the approved timeline (kind and status), with the name of their query asset."""
    approved = timeline.where((F.col("kind") == kind) & (F.col("status") == "available")).select(key)
    return obs.join(approved, key, "left_semi").withColumn("asset", F.concat(F.lit(prefix), F.col(key).cast("string"), F.lit(".parquet")))
