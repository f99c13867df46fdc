"""Intermediate tables in the shared folder of the cluster, removed when the program ends."""

from __future__ import annotations

import atexit
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from zonemill.session import shared_folder

_PATHS: list[tuple[SparkSession, str]] = []


def place(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    _PATHS.append((spark, path))
    return path


def extended(df: DataFrame, **more: str) -> StructType:
    """The schema of ``df`` with further columns; those replace columns of the same name."""
    return StructType([f for f in df.schema.fields if f.name not in more] + [StructField(n, {"string": StringType(), "double": DoubleType()}[t]) for n, t in more.items()])


def small_batches(df: DataFrame, rows: int = 2000) -> DataFrame:
    """``df`` itself, after lowering the session's Arrow batch size: rows that carry whole texts are large."""
    conf, name = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(conf.get(name)) <= rows:
        conf.set(name, str(rows))
    return df


def stored(df: DataFrame, name: str) -> DataFrame:
    """Written once as Parquet and read back: cuts the lineage, survives lost executors, keeps only compressed columns."""
    path = place(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@atexit.register
def _clear() -> None:
    for spark, path in _PATHS:
        try:
            target = spark._jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
        except Exception:  # noqa: BLE001  the session is gone already
            return
