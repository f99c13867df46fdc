"""Class-area statistics from polygon overlays and their municipality and region roll-ups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from zonemill import model as M
from zonemill.functions.numbers import percentage


def _sum_if(condition: Column, value: Column) -> Column:
    return F.coalesce(F.sum(F.when(condition, value)), F.lit(0.0))


def class_area_stats(facts: DataFrame, zones: DataFrame, green: list, artificial: list, no_data: list,
                     keys: list[str] | None = None, unit: float = 10_000.0) -> DataFrame:
    """Per zone: processed, valid and no-data area, coverage, dominant class, green and artificial groups.

    ``facts`` are (zone, class_code, area_m2), ``zones`` brings zone_m2. Group shares use the valid area.
    """
    keys = keys or ["sector_id"]
    c, a = F.col("class_code"), F.col("area_m2")
    best = F.max(F.when(~c.isin(no_data), F.struct(a.alias("a"), (-c.cast("double")).alias("o"), c.alias("c"))))
    sums = facts.groupBy(*keys).agg(F.sum(a).alias("processed"), _sum_if(c.isin(no_data), a).alias("hidden"),
                                    _sum_if(c.isin(green), a).alias("green"), _sum_if(c.isin(artificial), a).alias("artificial"),
                                    best["c"].alias("dominant_code"))
    rows = zones.select(*keys, "zone_m2").join(sums, keys, "left").na.fill(0.0, ["processed", "hidden", "green", "artificial"])
    valid = F.greatest(F.lit(0.0), F.col("processed") - F.col("hidden"))
    gap = F.greatest(F.lit(0.0), F.col("zone_m2") - F.col("processed"))
    return rows.select(
        *keys, (F.col("zone_m2") / unit).alias("zone_ha"), (F.col("processed") / unit).alias("processed_ha"), (valid / unit).alias("valid_ha"),
        ((F.col("hidden") + gap) / unit).alias("no_data_ha"), percentage(F.col("processed"), F.col("zone_m2")).alias("coverage_pct"),
        "dominant_code", (F.col("green") / unit).alias("green_ha"), percentage(F.col("green"), valid).alias("green_pct"),
        (F.col("artificial") / unit).alias("artificial_ha"), percentage(F.col("artificial"), valid).alias("artificial_pct"))


def class_breakdown(facts: DataFrame, stats: DataFrame, groups: dict[str, tuple[list, bool]], keys: list[str] | None = None,
                    no_data: list | None = None, unit: float = 10_000.0) -> DataFrame:
    """Class rows per group with share of the valid area and of the group.

    ``groups`` maps a name to (codes, keep rows of zero area). Classes in no group are ``other`` and have
    no group share. No-data classes are left out.
    """
    keys = keys or ["sector_id"]
    listed = [c for codes, _ in groups.values() for c in codes]
    areas = facts.groupBy(*keys).agg(*[F.coalesce(F.sum(F.when(F.col("class_code") == c, F.col("area_m2"))), F.lit(0.0)).alias(f"a_{i}")
                                       for i, c in enumerate(listed)])
    based = stats.select(*keys, "valid_ha", *[f"{g}_ha" for g in groups]).join(areas, keys, "left")
    items = []
    for name, (codes, keep_zero) in groups.items():
        for c in codes:
            area = F.coalesce(f"a_{listed.index(c)}", F.lit(0.0)) / unit
            items.append(F.struct(F.lit(name).alias("grp"), F.lit(c).alias("class_code"), area.alias("area_ha"),
                                  percentage(area, F.col(f"{name}_ha")).alias("group_pct"), F.lit(keep_zero).alias("keep")))
    fixed = based.select(*keys, "valid_ha", F.inline(F.array(*items))).where("keep OR area_ha > 0").drop("keep")
    rest = (facts.where(~F.col("class_code").isin([*listed, *(no_data or [])]) & (F.col("area_m2") > 0))
            .groupBy(*keys, "class_code").agg((F.sum("area_m2") / unit).alias("area_ha"))
            .join(stats.select(*keys, "valid_ha"), keys)
            .select(*keys, "valid_ha", F.lit("other").alias("grp"), "class_code", "area_ha", F.lit(0.0).alias("group_pct")))
    return fixed.unionByName(rest).withColumn("pct", percentage(F.col("area_ha"), F.col("valid_ha"))).drop("valid_ha")


def rollup_class_stats(stats: DataFrame, facts: DataFrame, zones: DataFrame, no_data: list) -> DataFrame:
    """Municipality and region rows: areas are summed first, shares come from the sums.

    Coverage of a roll-up is valid over zone area, unlike on sector level. ``zones`` maps sector to municipality.
    """
    sums = ["zone_ha", "processed_ha", "valid_ha", "no_data_ha", "green_ha", "artificial_ha"]
    names = zones.select("sector_id", "municipality")
    region = F.coalesce(F.concat(F.lit("municipality:"), "municipality"), F.lit("region:all")).alias("scope")
    totals = (stats.join(names, "sector_id").rollup("municipality").agg(*[F.sum(c).alias(c) for c in sums]).select(region, *sums))
    per_class = (facts.where(~F.col("class_code").isin(no_data)).join(names, "sector_id")
                 .groupBy("municipality", "class_code").agg(F.sum("area_m2").alias("a")))
    scopes = F.explode(F.array(F.lit("region:all"), F.concat(F.lit("municipality:"), "municipality"))).alias("scope")
    best = F.max(F.struct(F.col("a"), (-F.col("class_code").cast("double")).alias("o"), F.col("class_code").alias("c")))
    dominant = (per_class.select(scopes, "class_code", "a").groupBy("scope", "class_code").agg(F.sum("a").alias("a"))
                .groupBy("scope").agg(best["c"].alias("dominant_code")))
    return (totals.join(dominant, "scope", "left").withColumn("coverage_pct", percentage(F.col("valid_ha"), F.col("zone_ha")))
            .withColumn("green_pct", percentage(F.col("green_ha"), F.col("valid_ha")))
            .withColumn("artificial_pct", percentage(F.col("artificial_ha"), F.col("valid_ha"))))


def _scope(df: DataFrame) -> DataFrame:
    return df.withColumn("scope", F.explode(F.array(F.lit("region:all"), F.concat(F.lit("municipality:"), "municipality"))))


def rollup_land_cover(stats: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """Land-cover totals per municipality and region; shares of the classified area, 0 without any."""
    sums = ["total_ha", "classified_ha", "unclassifiable_ha", "vegetation_ha", "built_up_ha"]
    out = _scope(stats).groupBy(*keys, "scope").agg(*[F.sum(c).alias(c) for c in sums])
    return (out.withColumn("vegetation_pct", percentage(F.col("vegetation_ha"), F.col("classified_ha")))
            .withColumn("built_up_pct", percentage(F.col("built_up_ha"), F.col("classified_ha"))))


def rollup_breakdown(facts: DataFrame, rollup: DataFrame, zones: DataFrame, groups: dict[str, tuple[list, bool]], no_data: list | None = None) -> DataFrame:
    """Green, artificial and other class rows per municipality and region, with the share of group and valid area of the scope.

    ``rollup`` is :func:`rollup_class_stats`; ``facts`` are reduced to municipalities before the scopes are expanded.
    """
    per_class = (facts.join(zones.select("sector_id", "municipality"), "sector_id")
                 .groupBy("municipality", "class_code").agg(F.sum("area_m2").alias("area_m2")))
    return class_breakdown(_scope(per_class), rollup, groups, ["scope"], no_data)


def scope_areas(areas: DataFrame, keys: tuple[str, ...] = (), code: str = "code") -> DataFrame:
    """Land-cover areas (with a municipality) added up to municipalities and the region: input of the land-cover class rows."""
    return _scope(areas).groupBy(*keys, "scope", code).agg(F.sum("area_ha").alias("area_ha"))


def rollup_vegetation(stats: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """Vegetation totals; the median is the valid-area weighted mean of the medians, marked as approximate."""
    parts = ["total_ha", "valid_ha", "likely_ha", "below_ha", "cropland_ha", "water_ha", "missing_ha"]
    weighted = F.sum(F.coalesce("median_ndvi", F.lit(0.0)) * F.col("valid_ha"))
    out = _scope(stats).groupBy(*keys, "scope").agg(*[F.sum(c).alias(c) for c in parts], weighted.alias("mv"))
    shares = [percentage(F.col(c), F.col("total_ha")).alias(c.replace("_ha", "_pct")) for c in parts[2:6]]
    return out.select(*keys, "scope", *parts, *shares, F.when(F.col("valid_ha") > 0, F.col("mv") / F.col("valid_ha")).alias("median_ndvi"),
                      F.lit(True).alias("median_is_approximate"))


def region_surface_stats(stats: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """Binary surface totals over all zones; a zero total counts as 1 in the shares."""
    sums = ["complete_ha", "valid_ha", "no_data_ha", "sealed_ha", "unsealed_ha"]
    out = stats.groupBy(*keys).agg(*[F.sum(F.coalesce(c, F.lit(0.0))).alias(c) for c in sums])
    whole = F.when(F.col("complete_ha") == 0, 1.0).otherwise(F.col("complete_ha"))
    return out.select(*keys, *sums, *[(F.col(c) / whole * 100.0).alias(c.replace("_ha", "_pct")) for c in sums[1:]])


def parcel_stats(fragments: DataFrame, zones: DataFrame, zone: str = "sector_id") -> DataFrame:
    """Parcel area and its share of the complete zone area, number of distinct parcels; zeros without any. Decimal areas sum exactly."""
    sums = fragments.groupBy(zone).agg(F.sum("area_ha").cast("double").alias("parcel_ha"), F.count_distinct("parcel_id").alias("n_parcels"))
    rows = zones.select(zone, "complete_ha").join(sums, zone, "left").na.fill(0.0, ["parcel_ha"]).na.fill(0, ["n_parcels"])
    return rows.withColumn("parcel_pct", percentage(F.col("parcel_ha"), F.col("complete_ha")))


def crop_group_stats(fragments: DataFrame, zone: str = "sector_id") -> DataFrame:
    """Area per crop group and its share of the parcel area; a blank group is the general one."""
    group = F.when(F.trim(F.coalesce("crop_group", F.lit(""))) == "", M.OTHER_CROPS).otherwise(F.trim("crop_group"))
    rows = fragments.groupBy(zone, group.alias("crop_group")).agg(F.sum("area_ha").alias("area_ha"))
    whole = rows.groupBy(zone).agg(F.sum("area_ha").alias("parcel_ha"))
    area, total = F.col("area_ha").cast("double"), F.col("parcel_ha").cast("double")
    return rows.join(whole, zone).select(zone, "crop_group", area.alias("area_ha"), percentage(area, total).alias("group_pct"))


def count_checks(df: DataFrame, keys: list[str], expected: DataFrame) -> DataFrame:
    """Groups whose count differs from the expected one, including groups only one side has."""
    actual = df.groupBy(*keys).agg(F.count("*").alias("actual"))
    both = actual.join(expected, keys, "full").na.fill(0, ["actual", "expected"])
    return both.where("actual <> expected")
