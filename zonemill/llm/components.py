"""Connected components by alternating star contraction: only grouped minima and joins, no per-component lists."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from zonemill.session import checkpointed


def _digest(edges: DataFrame):
    row = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")).first()
    return row["n"], row["s"]


def components(edges: DataFrame) -> DataFrame:
    """Edges ``a``, ``b`` (any ordered type, a != b, no nulls) → ``a``, ``root`` for every vertex that isn't its own root.

    Each round hangs every vertex under the least vertex near it; the rounds needed grow with the logarithm of the
    longest chain. The loop ends when a round changes nothing.
    """
    edges = checkpointed(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = _digest(edges)
    while before[0]:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.join(least, "a").where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        # vertices that are roots keep their children through the line above; children hang under the least neighbour
        low = large.where("a != b").distinct()
        least = low.groupBy("a").agg(F.min("b").alias("m"))
        small = low.join(least, "a").select(F.explode(F.array(
            F.struct(F.col("a"), F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.a", "e.b")
        edges = checkpointed(small.where("a != b").distinct())
        now = _digest(edges)
        if now == before:
            break
        before = now
    return edges.select("a", F.col("b").alias("root"))
