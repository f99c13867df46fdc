"""Point queries as batch joins: value and status at the cell of a point."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from zonemill.functions import space as S
from zonemill.model import Grid


def sample_points(points: DataFrame, px: DataFrame, grid: Grid, value: str, x: Column | None = None,
                  y: Column | None = None, keys: tuple[str, ...] = ()) -> DataFrame:
    """Points with the status (clear, cloud, missing, outside) and the value of their cell.

    ``keys`` name the observation a point asks for; x and y default to columns and may be a projection.
    """
    row, col = S.cell_of(F.col("x") if x is None else x, F.col("y") if y is None else y, grid)
    placed = points.withColumn("row_i", row).withColumn("col_i", col)
    found = placed.join(px.select(*keys, "row_i", "col_i", F.col("status").alias("code"), F.col(value).alias("v")), [*keys, "row_i", "col_i"], "left")
    status = (F.when(F.col("row_i").isNull(), "outside").when(F.col("code") == 1, "clear").when(F.col("code") == 2, "cloud").otherwise("missing"))
    return found.withColumn("status", status).withColumn("value", F.when(F.col("code") == 1, F.col("v"))).drop("code", "v")


def sample_density(points: DataFrame, density: DataFrame, scope: DataFrame, codes: list[int], grid: Grid, circle_ha: float,
                   municipality: str | None = None, keys: tuple[str, ...] = ()) -> DataFrame:
    """Points with the summed percentage of the chosen classes (at most 100), its area and the coverage.

    A point outside the scope is ``outside``; one without all the bands is ``unavailable``.
    """
    row, col = S.cell_of(F.col("x"), F.col("y"), grid)
    inside = scope if municipality is None else scope.where(F.col("municipality") == municipality)
    bands = [F.col(f"pct_{c}") for c in codes]
    total = F.least(F.lit(100.0), sum(bands[1:], bands[0]))
    found = (points.withColumn("row_i", row).withColumn("col_i", col)
             .join(inside.select("row_i", "col_i", F.lit(True).alias("in_scope")), ["row_i", "col_i"], "left")
             .join(density, [*keys, "row_i", "col_i"], "left"))
    known = F.col("coverage_pct").isNotNull()
    for band in bands:
        known = known & band.isNotNull()
    status = F.when(F.col("in_scope").isNull(), "outside").when(~known, "unavailable").otherwise("available")
    return (found.withColumn("status", status).withColumn("pct", F.when(F.col("status") == "available", total))
            .withColumn("area_ha", F.col("pct") / 100.0 * circle_ha)
            .withColumn("coverage", F.when(F.col("status") == "available", F.col("coverage_pct"))))
