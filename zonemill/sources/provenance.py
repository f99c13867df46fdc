"""Provenance: content hashes, pins, incremental refresh and byte budgets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def with_content_hash(df: DataFrame, content: str = "content") -> DataFrame:
    """Adds sha256, md5 and the length in bytes."""
    c = F.col(content).cast("binary")
    return df.withColumn("sha256", F.sha2(c, 256)).withColumn("md5", F.md5(c)).withColumn("n_bytes", F.octet_length(c).cast("bigint"))


def read_hashed(spark: SparkSession, path: str) -> DataFrame:
    """Files below a path with their hashes."""
    return with_content_hash(spark.read.format("binaryFile").load(path)).drop("content")


def check_pins(hashed: DataFrame, pins: DataFrame) -> DataFrame:
    """Rows whose size and digest equal none of the accepted artefacts (n_bytes, sha256)."""
    return hashed.join(pins.select("n_bytes", "sha256"), ["n_bytes", "sha256"], "left_anti")


def pending_partitions(wanted: DataFrame, stored: DataFrame, keys: tuple[str, ...] = ("dataset", "year")) -> DataFrame:
    """(dataset, year) partitions to compute: unknown source hash, or stored statistics that are incomplete.

    ``wanted`` brings the keys, source_hash and n_expected; ``stored`` the keys, source_hash and n_records.
    """
    done = stored.select(*keys, "source_hash", F.col("n_records").alias("n_expected"))
    return wanted.join(done, [*keys, "source_hash", "n_expected"], "left_anti")


def over_budget(files: DataFrame, group: str, budgets: dict[str, int], default: int | None = None) -> DataFrame:
    """Groups of files larger than their budget in bytes; groups without a budget have the default one."""
    limit = F.lit(default)
    for name, size in budgets.items():
        limit = F.when(F.col(group) == name, F.lit(size)).otherwise(limit)
    return files.groupBy(group).agg(F.sum("length").alias("n_bytes")).withColumn("budget", limit.cast("bigint")).where(F.col("n_bytes") > F.col("budget"))
