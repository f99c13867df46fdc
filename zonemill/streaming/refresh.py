"""Incremental refresh: newly arrived source files lead to the recomputation of their (dataset, year) only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from zonemill.sources.sinks import write_stats

PARTITIONS = ("dataset", "year")


def refresh_stats(spark: SparkSession, source: str, schema: str | T.StructType, target: str, checkpoint: str,
                  compute: Callable[[DataFrame], DataFrame]) -> StreamingQuery:
    """Process what has arrived since the last run and stop.

    The stream only tells which partitions are touched; each of them is then read whole (partition pruning)
    and replaced whole (dynamic overwrite). A batch that is repeated after a failure gives the same result.
    ``compute`` maps the pixels of the touched partitions to statistics that keep dataset and year.
    """
    arrivals = spark.readStream.schema(schema).parquet(source)

    def one_batch(batch: DataFrame, _: int) -> None:
        touched = batch.select(*PARTITIONS).distinct()
        rows = batch.sparkSession.read.schema(schema).parquet(source).join(touched, list(PARTITIONS), "left_semi")
        write_stats(compute(rows), target, PARTITIONS)

    return (arrivals.writeStream.foreachBatch(one_batch).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())
