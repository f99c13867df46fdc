"""Session settings and the durable way to cut a lineage."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Adaptive execution decides broadcast or sort-merge, splits skewed join partitions and
# coalesces small ones at run time; nothing below depends on the data volume.
SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
    "spark.sql.parquet.filterPushdown": "true",
    # Checkpoint files go when their plan is no longer referenced.
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    # Call sites of every column expression cost a round trip each while plans are built.
    "spark.python.sql.dataFrameDebugging.enabled": "false",
}


def get_session(master: str | None = None, shuffle_partitions: int | None = None, **conf: str) -> SparkSession:
    """Build (or reuse) a session with the settings the operators are designed for."""
    builder = SparkSession.builder.appName("zonemill")
    if master:
        builder = builder.master(master)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for key, value in {**SETTINGS, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder for checkpoints and intermediate tables, shared by all machines.

    The folder of the session is used as it is. Only a local session, as in tests, gets a temporary one
    where none is configured; a cluster has to name a folder that all machines see.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all machines share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="zonemill-checkpoint-"))
    return context.getCheckpointDir()


_SCRATCH: list[tuple[SparkSession, str]] = []


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, removed when the program ends."""
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    _SCRATCH.append((spark, path))
    return path


@atexit.register
def _clear() -> None:
    for spark, path in _SCRATCH:
        try:
            target = spark._jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
        except Exception:  # noqa: BLE001  the session is gone already
            return


def checkpointed(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the shared folder: computed once, and safe when an executor is lost."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def spread(df: DataFrame) -> DataFrame:
    """Deal rows out evenly over the shuffle partitions ahead of a step that expands them, whatever their number."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
