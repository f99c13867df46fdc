"""Data-quality operators. Each returns the violations; an empty result is a pass."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from zonemill import model as M
from zonemill.functions.numbers import finite
from zonemill.model import Grid
from zonemill.operators.geometry import count_vertices, geom_bounds
from zonemill.operators.tables import literal_map


class ContractError(ValueError):
    """Raised by ``require`` when a check reports violations."""


def require(violations: DataFrame, message: str) -> None:
    """Fail with the first few violations. This is the only action in this module."""
    rows = violations.limit(5).collect()
    if rows:
        raise ContractError(f"{message}: {[tuple(r) for r in rows]}")


def evaluate_rules(df: DataFrame, keys: list[str], rules: dict[str, Column]) -> DataFrame:
    """(keys, rule) for every rule a row breaks. A rule that is null counts as broken."""
    broken = F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items()]))
    return df.select(*keys, F.explode(broken).alias("rule"))


def unreconciled(stats: DataFrame, parts: list[str], complete: str) -> DataFrame:
    """Rows whose parts miss the complete area by more than max(0.01, 0.5 %)."""
    gap = sum(F.col(p) for p in parts) - F.col(complete)
    return stats.withColumn("gap", gap).where(F.abs("gap") > F.greatest(F.lit(0.01), F.col(complete) * 0.005))


def density_violations(stats: DataFrame, keys: list[str]) -> DataFrame:
    """Density statistics: the classes add up to the presence area, crowns do not exceed it."""
    classes = sum(F.col(f"class_{a}_{b}_ha") for a, b in M.DENSITY_CLASSES)
    limit = F.greatest(F.lit(0.01), F.col("complete_ha") * 0.005)
    total = F.col("zero_ha") + F.col("presence_ha") + F.col("no_data_ha")
    return evaluate_rules(stats, keys, {
        "areas": F.abs(total - F.col("complete_ha")) <= limit, "classes": F.abs(classes - F.col("presence_ha")) <= limit,
        "crown": F.col("crown_ha") <= F.col("presence_ha") + 1e-9})


def score_range(df: DataFrame, key: str, columns: list[str], integer: tuple[str, ...] = ()) -> DataFrame:
    """Scores outside 0–10 (sentinel and missing excepted) and fractional values where whole ones are due."""
    long = df.unpivot([key], columns, "score", "value")
    known = F.col("value").isNotNull() & (F.col("value") != M.SCORE_SENTINEL)
    whole = F.col("score").isin(list(integer)) & (F.col("value") != F.floor("value"))
    return long.where(known & (~F.col("value").between(0, 10) | whole))


def count_mismatch(df: DataFrame, keys: list[str], expected: dict, column: str) -> DataFrame:
    """Counts per value of a column against expected ones, per key."""
    actual = df.groupBy(*keys, column).agg(F.count("*").alias("actual"))
    return actual.withColumn("expected", F.coalesce(literal_map(expected)[F.col(column)].cast("bigint"), F.lit(0))).where("actual <> expected")


def coverage_violations(stats: DataFrame, zones: DataFrame, zone: str = "sector_id", minimum_pct: float = 99.5) -> DataFrame:
    """Zones without a record or with too little coverage."""
    rows = zones.select(zone).join(stats.select(zone, "coverage_pct"), zone, "left")
    problem = F.when(F.col("coverage_pct").isNull(), "absent").when(F.col("coverage_pct") < minimum_pct, "insufficient")
    return rows.withColumn("problem", problem).where("problem IS NOT NULL")


def area_disagreement(stats: DataFrame, raster: str, exact: str, tolerance: float = 0.005) -> DataFrame:
    """Raster and polygon area further apart than the tolerance."""
    return stats.where(~F.coalesce(F.abs(1.0 - F.col(exact) / F.col(raster)) <= tolerance, F.lit(False)))


def geometry_violations(features: DataFrame, key: str = "feature_id") -> DataFrame:
    """Missing id, duplicate id, wrong geometry type, empty geometry."""
    twice = features.groupBy(key).agg(F.count("*").alias("n")).where((F.col("n") > 1) & F.col(key).isNotNull()).select(key, F.lit("duplicate").alias("rule"))
    rest = evaluate_rules(features, [key], {
        "id": F.col(key).isNotNull() & (F.col(key).cast("string") != ""), "type": F.col("kind") == "MultiPolygon",
        "empty": F.coalesce(F.size("geom") > 0, F.lit(False))})
    return rest.unionByName(twice)


def parcel_violations(parcels: DataFrame, key: str) -> DataFrame:
    return evaluate_rules(parcels, [key], {
        "sector": F.col("sector_id").isNotNull(), "group": F.coalesce(F.trim("crop_group") != "", F.lit(False)),
        "area": finite(F.col("area_ha")) & (F.col("area_ha") >= 0), "share": F.col("parcel_pct").between(0, 100)})


def grid_violations(grid: Grid, expected: Grid, bands: list[str], required: list[str]) -> list[str]:
    """Contract of a grid: reference system, cell size, shape and bands."""
    checks = {"crs": grid.crs == expected.crs, "cell": (grid.dx, grid.dy) == (expected.dx, expected.dy),
              "shape": (grid.width, grid.height) == (expected.width, expected.height),
              "origin": (grid.x0, grid.y0) == (expected.x0, expected.y0), "bands": set(required) <= set(bands)}
    return [name for name, ok in checks.items() if not ok]


def band_domain(px: DataFrame, keys: list[str], bands: dict[str, list]) -> DataFrame:
    """Per key and band: number of values outside the domain, where there are any. One pass for all bands."""
    counts = px.groupBy(*keys).agg(*[F.count_if(~F.coalesce(F.col(b).isin(allowed), F.lit(False))).alias(b) for b, allowed in bands.items()])
    return counts.unpivot(keys, list(bands), "band", "n_outside").where("n_outside > 0")


def dictionary_differences(ours: DataFrame, official: DataFrame, key: str = "code", value: str = "color") -> DataFrame:
    """Class dictionary against the official one: missing, unknown or differing entries."""
    both = ours.select(key, F.col(value).alias("ours")).join(official.select(key, F.col(value).alias("official")), key, "full")
    kind = (F.when(F.col("ours").isNull(), "missing").when(F.col("official").isNull(), "unknown")
            .when(F.lower("ours") != F.lower("official"), "different"))
    return both.withColumn("difference", kind).where("difference IS NOT NULL").select(key, "difference")


def vertex_violations(before: DataFrame, after: DataFrame, key: str, bounds: tuple[float, float, float, float]) -> DataFrame:
    """Features that lost or gained vertices in a projection, or left the plausible box."""
    both = before.select(key, count_vertices(F.col("geom")).alias("n_before")).join(
        after.select(key, count_vertices(F.col("geom")).alias("n_after"), geom_bounds(F.col("geom")).alias("b")), key)
    x0, y0, x1, y1 = bounds
    inside = (F.col("b.x0") >= x0) & (F.col("b.y0") >= y0) & (F.col("b.x1") <= x1) & (F.col("b.y1") <= y1)
    return evaluate_rules(both, [key], {"count": F.col("n_before") == F.col("n_after"), "bounds": inside})


def timeline_violations(timeline: DataFrame, observations: DataFrame, expected: list, minimum: float, key: str = "obs_id") -> DataFrame:
    """Timeline against its observations: an item without observation, low coverage, a missing or surplus id."""
    known = observations.select(key, "coverage_pct", F.lit(True).alias("known"))
    rules = evaluate_rules(timeline.join(known, key, "left"), [key], {
        "observation": F.col("known"), "coverage": F.col("coverage_pct") >= minimum, "expected": F.col(key).isin(expected)})
    listed = F.array(*map(F.lit, expected))
    absent = timeline.agg(F.array_except(listed, F.collect_set(F.when(F.col(key).isin(expected), F.col(key)))).alias("a"))
    return rules.unionByName(absent.select(F.explode("a").alias(key), F.lit("absent").alias("rule")))
