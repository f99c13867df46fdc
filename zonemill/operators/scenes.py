"""Scene catalogues: eligibility, period join, grouping by date, selection of the best candidate.

Selections are aggregates over an ordering struct instead of ranking windows: the winner is found
with map-side combine, so a period that holds most of the catalogue costs no large sort.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from zonemill import model as M
from zonemill.functions.numbers import clamp
from zonemill.functions.text import days_to_target, midpoint_distance


def eligible_scenes(scenes: DataFrame) -> DataFrame:
    required = F.array(*map(F.lit, M.SCENE_ASSETS))
    return scenes.where(F.col("platform").isin(M.SCENE_PLATFORMS) & (F.col("category") == "T1")
                        & (F.col("correction") == "L2SP")
                        & (F.size(F.array_except(required, F.col("assets"))) == 0))


def scenes_in_period(scenes: DataFrame, periods: list[tuple[str, str, str]], day: str = "d") -> DataFrame:
    """Scenes inside an inclusive period. The periods are a published list, hence a constant of the plan."""
    known = F.array(*[F.struct(F.lit(i).alias("period_id"), F.lit(a).cast("date").alias("d0"),
                               F.lit(b).cast("date").alias("d1")) for i, a, b in periods])
    hits = F.filter(known, lambda p: F.col(day).between(p["d0"], p["d1"]))
    return scenes.select("*", F.inline(hits))


def scenes_by_date(scenes: DataFrame) -> DataFrame:
    """Per date: worst cloud percentage over the tiles (unknown counts as 100), products, tiles."""
    return scenes.groupBy("d").agg(F.max(F.coalesce("cloud_pct", F.lit(100.0))).alias("max_cloud"),
                                   F.count("*").alias("n_products"), F.sort_array(F.collect_set("tile")).alias("tiles"))


def observation_metadata(scenes: DataFrame, key: str = "d") -> DataFrame:
    """Earliest instant, sorted distinct satellites and paths, sorted scene ids per observation."""
    return scenes.groupBy(key).agg(
        F.min("acquired_at").alias("acquired_at"), F.sort_array(F.collect_set("platform")).alias("satellites"),
        F.sort_array(F.collect_set("path_row")).alias("path_rows"), F.sort_array(F.collect_list("scene_id")).alias("scene_ids"))


def candidate_quality(px: DataFrame, keys: list[str], covered: Column, cloudy: Column, footprint: float) -> DataFrame:
    """Coverage of the footprint and cloud share of what is covered, both in percent."""
    means = px.groupBy(*keys).agg(F.avg(covered.cast("double")).alias("cov"), F.avg(cloudy.cast("double")).alias("cld"))
    return means.select(*keys, (clamp(F.col("cov") / footprint, 0.0, 1.0) * 100.0).alias("coverage_pct"),
                        F.when(F.col("cov") > 0, F.col("cld") / F.col("cov") * 100.0).otherwise(100.0).alias("cloud_pct"))


def select_clearest(candidates: DataFrame, excluded: dict[str, str] | None = None) -> DataFrame:
    """Mark the clearest candidate per period: coverage, then distance to the middle, then time.

    Needs period_id, d0, d1, d, acquired_at, coverage_pct, scene_id. All rows stay, with a reason:
    selected, excluded date, too little coverage, or not the clearest.
    """
    excluded = excluded or {}
    day = F.date_format("d", "yyyy-MM-dd")
    barred = F.create_map(*[F.lit(x) for kv in excluded.items() for x in kv])[day] if excluded else F.lit(None).cast("string")
    order = F.struct((-F.col("coverage_pct")).alias("c"), midpoint_distance(F.col("d"), F.col("d0"), F.col("d1")).alias("m"),
                     F.col("acquired_at").alias("t"), F.col("scene_id").alias("s"))
    rows = candidates.withColumn("barred", barred)
    usable = F.col("barred").isNull() & (F.col("coverage_pct") >= M.MINIMUM_COVERAGE)
    best = rows.where(usable).groupBy("period_id").agg(F.min(order)["s"].alias("best_scene"))
    reason = (F.when(F.col("barred").isNotNull(), F.col("barred")).when(F.col("scene_id") == F.col("best_scene"), "selected")
              .when(F.col("coverage_pct") < M.MINIMUM_COVERAGE, "insufficient-coverage").otherwise("not-clearest"))
    return rows.join(best, "period_id", "left").withColumn("reason", reason).drop("barred", "best_scene")


def period_status(periods: DataFrame, judged: DataFrame) -> DataFrame:
    """observed, cloud-obscured (candidates but none selected) or no-acquisition."""
    seen = judged.groupBy("period_id").agg(F.count("*").alias("n_candidates"), F.max(
        F.when(F.col("reason") == "selected", F.col("scene_id"))).alias("selected_scene"))
    return (periods.join(seen, "period_id", "left").withColumn("n_candidates", F.coalesce("n_candidates", F.lit(0)))
            .withColumn("status", F.when(F.col("selected_scene").isNotNull(), "observed")
                        .when(F.col("n_candidates") > 0, "cloud-obscured").otherwise("no-acquisition")))


def select_annual(candidates: DataFrame, month: int, day: int) -> DataFrame:
    """One date per year from the best non-empty tier.

    Complete (coverage ≥ 99.5) and ≤ 16 days from the target and cloud ≤ 2; else complete and
    cloud ≤ 2; else complete; else everything. The first two tiers order by distance, the others by cloud.
    """
    gap = days_to_target(F.col("d"), month, day)
    complete, calm = F.col("coverage_pct") >= 99.5, F.col("cloud_pct") <= 2
    tier = F.when(complete & calm & (gap <= 16), 0).when(complete & calm, 1).when(complete, 2).otherwise(3)
    rows = candidates.withColumn("gap", gap).withColumn("tier", tier).withColumn("year", F.year("d"))
    near = F.col("tier") <= 1
    # The tier leads the ordering, so the smallest struct is the best of the best non-empty tier.
    order = F.struct(F.col("tier").alias("a"), F.when(near, F.col("gap").cast("double")).otherwise(F.col("cloud_pct")).alias("b"),
                     F.when(near, F.col("cloud_pct")).otherwise(F.col("gap").cast("double")).alias("c"), F.col("d").alias("d"))
    best = rows.groupBy("year").agg(F.min_by(F.struct("d", "gap", "coverage_pct", "cloud_pct"), order).alias("b"))
    good = (F.col("coverage_pct") >= 99.5) & (F.col("cloud_pct") <= 2)
    return best.select("year", "b.*").withColumn("quality", F.when(good, "good").otherwise("warning"))


def shortlist(by_date: DataFrame, month: int, day: int, size: int = 6, near: int = 16) -> DataFrame:
    """Least cloudy dates of a year, plus the one nearest to the target when none of them is near.

    Input holds one row per date, so a year has at most 366 rows; the rank filter is pushed below the shuffle.
    """
    rows = by_date.withColumn("year", F.year("d")).withColumn("gap", days_to_target(F.col("d"), month, day))
    rank = F.row_number().over(W.partitionBy("year").orderBy("max_cloud", "gap", "d"))
    top = rows.withColumn("rn", rank).where(F.col("rn") <= size)
    has_near = top.groupBy("year").agg(F.min("gap").alias("least_gap"))
    nearest = (rows.groupBy("year").agg(F.min_by(F.struct("d", "max_cloud", "gap"), F.struct("gap", "max_cloud", "d")).alias("b"))
               .join(has_near, "year").where(F.col("least_gap") > near).select("year", "b.*"))
    return top.select("year", "d", "max_cloud", "gap").unionByName(nearest.select("year", "d", "max_cloud", "gap"))


def mosaic(px: DataFrame, keys: list[str]) -> DataFrame:
    """Best pixel among overlapping scenes: the clear one with the least uncertainty, first scene on ties.

    Needs status, temp_c, uncertainty, scene_rank. A cell is cloudy only if nothing is clear.
    """
    clear = F.col("status") == 1
    order = F.struct(F.coalesce("uncertainty", F.lit(float("inf"))).alias("u"), F.col("scene_rank").alias("r"))
    best = F.min(F.when(clear, F.struct(order.alias("o"), F.struct("temp_c", "uncertainty", "scene_rank").alias("v"))))
    return (px.groupBy(*keys)
            .agg(best.alias("best"), F.bool_or(clear).alias("any_clear"), F.bool_or(F.col("status") == 2).alias("any_cloud"))
            .select(*keys, F.when(F.col("any_clear"), 1).when(F.col("any_cloud"), 2).otherwise(0).alias("status"),
                    F.col("best.v.temp_c").alias("temp_c"), F.col("best.v.uncertainty").alias("uncertainty"),
                    F.col("best.v.scene_rank").alias("scene_rank")))


def check_timeline(obs: DataFrame, minimum: float, group: str = "series", block: int = 10_000) -> DataFrame:
    """Violations per observation: out of order, a repeated day, or too little coverage.

    ``position`` is the published order within a series of observations, a number. A series is compared in blocks of
    ``block`` positions side by side; the last observation of each block is carried to the next block that has any.
    """
    rows = obs.withColumn("blk", F.floor(F.col("position") / block))
    inside = W.partitionBy(group, "blk").orderBy("position")
    rows = rows.withColumn("before", F.lag("acquired_at").over(inside)).withColumn("first", F.row_number().over(inside) == 1)
    lasts = obs.groupBy(F.col(group).alias("of_group"), F.floor(F.col("position") / block).alias("of_blk")).agg(F.max_by("acquired_at", "position").alias("last"))
    carried = lasts.withColumn("carried", F.lag("last").over(W.partitionBy("of_group").orderBy("of_blk"))).drop("last")
    same = F.col(group).eqNullSafe(F.col("of_group")) & F.col("blk").eqNullSafe(F.col("of_blk"))
    before = F.when(F.col("first"), F.col("carried")).otherwise(F.col("before"))
    problem = F.array_compact(F.array(
        F.when(before > F.col("acquired_at"), "out-of-order"), F.when(before == F.col("acquired_at"), "repeated"),
        F.when(F.col("coverage_pct") < minimum, "insufficient-coverage")))
    return rows.join(carried, same).withColumn("p", problem).select(group, "position", F.explode("p").alias("problem"))


def spatial_split(df: DataFrame, x: str, bounds: DataFrame) -> DataFrame:
    """train / validation / test by two cut points along x (one row: q60, q80)."""
    part = F.when(F.col(x) <= F.col("q60"), "train").when(F.col(x) <= F.col("q80"), "validation").otherwise("test")
    return df.join(F.broadcast(bounds.select("q60", "q80")), F.lit(True)).withColumn("split", part)
