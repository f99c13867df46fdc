"""Zonal statistics: pixels reduced to zones with explicit no-data accounting.

Denominators differ by statistic on purpose (complete, classified, valid or parcel area); every
function says which one it uses. All functions return unrounded doubles.

Physical design: conditional sums in one grouped pass. Spark combines on the map side, so a zone
that holds a third of all pixels sends one row per task, not its pixels.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from zonemill import model as M
from zonemill.functions import pixels as P
from zonemill.functions.numbers import finite, percentage
from zonemill.operators import covered as CO
from zonemill.operators import quantiles as Q
from zonemill.operators.geometry import one_feature
from zonemill.operators.tables import with_series

BLOCK = 64
SALTS = 16  # how often the zones are dealt out to pair them with the keys
Expected = dict[str, list] | DataFrame | None  # key values for which every zone has a record


def cell_key(row: Column, col: Column) -> Column:
    """Row and column in one whole number: joins on it use the compact hash table for long keys."""
    return row.cast("bigint") * (1 << 32) + col


def assign_zone(px: DataFrame, spans: DataFrame, block: int = BLOCK, order: str | None = None) -> DataFrame:
    """Pixels joined to the one zone whose span covers them (cell centre rule; the last by ``order`` where spans overlap).

    Spans (row_i, c0, c1 inclusive, zone columns) are cut into column blocks, so the join is an
    equi-join on (row, block) with a small residual test, and no cell list is ever materialised.
    """
    def start(c: str) -> Column:
        return F.col(c) - F.col(c) % block

    cut = one_feature(spans, order).withColumn("blk", F.explode(F.sequence(start("c0"), start("c1"), F.lit(block).cast("bigint"))))
    cut = cut.withColumn("key", cell_key(F.col("row_i"), F.col("blk"))).drop("row_i", "blk")
    cond = (cell_key(F.col("row_i"), start("col_i")) == F.col("key")) & F.col("col_i").between(F.col("c0"), F.col("c1"))
    return px.join(cut, cond).drop("key", "c0", "c1")


def with_weights(px: DataFrame, weights: DataFrame) -> DataFrame:
    """Pixels × the zones that cover part of them, with the covered sub-cells w."""
    keyed = weights.withColumn("key", cell_key(F.col("row_i"), F.col("col_i"))).drop("row_i", "col_i")
    return px.join(keyed.hint("merge"), cell_key(F.col("row_i"), F.col("col_i")) == F.col("key")).drop("key")


def _sum_if(condition: Column, value: Column | float = 1) -> Column:
    return F.coalesce(F.sum(F.when(condition, value)), F.lit(0.0))


def _for_every(frame: DataFrame, rows: DataFrame, on: list[str], keys: list[str], expected: Expected) -> DataFrame:
    """``rows`` (unique by keys and ``on``) completed to every pair of a key and a row of ``frame`` (unique by ``on``).

    Keys are the ``expected`` ones: a table with the key columns, such as an inventory, or lists of values; without
    them those that occur in ``rows``. One row per key goes through an equi-join on a small salt, which each row of ``frame``
    has in all its values, and all meet in one aggregation: ``rows`` are computed once and no list of keys is ever made.
    """
    values = [c for c in rows.columns if c not in (*keys, *on)]
    bare = [*[F.lit(None).cast(rows.schema[c].dataType).alias(c) for c in (*on, *values)]]
    if expected is None:
        twice = rows.withColumn("is_key", F.explode(F.array(F.lit(False), F.lit(True))))
        both = twice.select(*keys, *[F.when(~F.col("is_key"), F.col(c)).alias(c) for c in (*on, *values)], "is_key")
        both = both.groupBy(*keys, *on, "is_key").agg(*[F.max(c).alias(c) for c in values])
    else:
        if isinstance(expected, DataFrame):
            marks = expected.select(*keys).distinct()
        else:
            marks = frame.sparkSession.range(1).select(*[F.array(*[F.lit(v).cast(rows.schema[k].dataType) for v in expected[k]]).alias(k) for k in keys])
            for key in keys:
                marks = marks.withColumn(key, F.explode(key))
        both = rows.withColumn("is_key", F.lit(False)).unionByName(marks.select(*keys, *bare, F.lit(True).alias("is_key")))
    salted = frame.select(*[F.col(c).alias(f"every_{c}") for c in on], F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    both = both.withColumn("salt", F.when(F.col("is_key"), F.pmod(F.hash(*keys), F.lit(SALTS)))).join(salted, "salt", "left")
    whole = both.select(*keys, *[F.when(F.col("is_key"), F.col(f"every_{c}")).otherwise(F.col(c)).alias(c) for c in on], *values, "is_key")
    # pairs without a key row are those of keys that are not expected
    whole = whole.groupBy(*keys, *on).agg(*[F.max(c).alias(c) for c in values], F.max("is_key").alias("is_key"))
    return whole.where("is_key").drop("is_key")


def _records(zones: DataFrame, columns: list[str], rows: DataFrame, zone: str, keys: tuple[str, ...],
             expected: Expected) -> DataFrame:
    """Zone columns joined to their sums: a record for every zone and key (observation, year …), also without pixels."""
    frame = zones.select(zone, *columns)
    if not keys:
        return frame.join(rows, [zone], "left")
    return frame.join(_for_every(frame, rows, [zone], list(keys), expected), [zone])


def _marks(px: DataFrame, weights: DataFrame, usable: Column, keys: list[str], expected: Expected, spark: SparkSession) -> DataFrame:
    """The distinct keys for which every zone has a record."""
    if isinstance(expected, DataFrame):
        return expected.select(*keys).distinct()
    if expected is None:
        cells = weights.where("w > 0").select(cell_key(F.col("row_i"), F.col("col_i")).alias("cell")).distinct()
        return px.where(usable).withColumn("at", cell_key(F.col("row_i"), F.col("col_i"))).join(cells.hint("merge"), F.col("at") == F.col("cell"), "left_semi").select(*keys).distinct()
    marks = spark.range(1).select(*[F.explode(F.array(*[F.lit(v).cast(px.schema[k].dataType) for v in expected[k]])).alias(k) for k in keys[:1]])
    for k in keys[1:]:
        marks = marks.withColumn(k, F.explode(F.array(*[F.lit(v).cast(px.schema[k].dataType) for v in expected[k]])))
    return marks.distinct()


def _by_size(px: DataFrame, weights: DataFrame, zones: DataFrame, zone: str, keys: tuple[str, ...], expected: Expected, usable: Column):
    """(lists of cells, zones) of zones of few cells or none, (weights, zones) of the others, and the expected keys."""
    few, more = CO.split_zones(weights, zone)
    frame = zones.select(zone, "complete_ha")
    large = more.select(zone).distinct().hint("merge")
    marks = _marks(px, weights, usable, list(keys), expected, zones.sparkSession)
    return (few, frame.join(large, [zone], "left_anti")), (more, frame.join(large, [zone], "left_semi")), marks


def categorical_stats(px: DataFrame, zones: DataFrame, codes: list[int], cell_ha: float, zone: str = "sector_id", code: str = "code",
                      keys: tuple[str, ...] = (), expected: Expected = None) -> DataFrame:
    """Area and share of every listed class per zone, over the complete zone area.

    ``zones`` brings (zone, complete_ha). ``expected`` lists the key values for which every zone gets a record.
    """
    counts = [F.count_if(F.col(code) == c).alias(f"n_{c}") for c in codes]
    wide = px.groupBy(*keys, zone).agg(*counts)
    wide = _records(zones, ["complete_ha"], wide, zone, keys, expected)
    classes = F.array(*[F.struct(F.lit(c).alias("code"), (F.coalesce(f"n_{c}", F.lit(0)) * cell_ha).alias("area_ha")) for c in codes])
    total = sum(F.coalesce(f"n_{c}", F.lit(0)) for c in codes) * cell_ha
    whole = F.col("complete_ha")
    rest = F.greatest(F.lit(0.0), whole - F.col("valid_ha"))
    return (wide.select(*keys, zone, "complete_ha", total.alias("valid_ha"), F.inline(classes))
            .withColumn("pct", percentage(F.col("area_ha"), whole)).withColumn("valid_pct", percentage(F.col("valid_ha"), whole))
            .withColumn("no_data_ha", rest).withColumn("no_data_pct", percentage(rest, whole)))


def binary_stats(px: DataFrame, zones: DataFrame, cell_ha: float, zone: str = "sector_id", code: str = "code",
                 keys: tuple[str, ...] = (), expected: Expected = None) -> DataFrame:
    """Sealed (1) and unsealed (0) areas and shares of the complete zone area, one row per zone."""
    wide = px.groupBy(*keys, zone).agg((F.count_if(F.col(code) == 1) * cell_ha).alias("sealed_ha"),
                                       (F.count_if(F.col(code) == 0) * cell_ha).alias("unsealed_ha"))
    wide = _records(zones, ["complete_ha"], wide, zone, keys, expected).na.fill(0.0, ["sealed_ha", "unsealed_ha"])
    whole = F.col("complete_ha")
    valid = F.col("sealed_ha") + F.col("unsealed_ha")
    rest = F.greatest(F.lit(0.0), whole - valid)
    return wide.select(*keys, zone, "complete_ha", "sealed_ha", "unsealed_ha", valid.alias("valid_ha"), rest.alias("no_data_ha"),
                       percentage(F.col("sealed_ha"), whole).alias("sealed_pct"), percentage(F.col("unsealed_ha"), whole).alias("unsealed_pct"),
                       percentage(valid, whole).alias("valid_pct"), percentage(rest, whole).alias("no_data_pct"))


def density_stats(px: DataFrame, zones: DataFrame, unit_ha: float, zone: str = "sector_id", value: str = "value",
                  weight: str | None = "w", keys: tuple[str, ...] = (), expected: Expected = None, weights: DataFrame | None = None) -> DataFrame:
    """Density (0–100) per zone with whole-number weights of ``unit_ha`` each.

    Shares use the complete zone area, density classes also the area where something is present. Without a weight
    column every pixel counts one and the median lies between the two middle values. With a table of ``weights`` (zone,
    row_i, col_i, w) ``px`` are the bare pixels: zones of few cells meet them without a row per pixel and zone.
    """
    group = [*keys, zone]
    if weights is not None:
        v = F.col(value)
        measure = {"v": F.when(finite(v.cast("double")) & v.between(0, 100), v)}
        bands = {"pw": (5e-324, float("inf")), **{f"w_{a}_{b}": (float(a), float(b)) for a, b in M.DENSITY_CLASSES}}
        near, big, marks = _by_size(px, weights, zones, zone, keys, expected, measure["v"].isNotNull())
        rows = CO.zone_records(px, near[0], near[1], marks, zone, list(keys), measure, {"v": {"median_density": 0.5}}, {"v": bands})
        rows = rows.select(*group, "complete_ha", *[F.col(f"v_{c}").alias(c) for c in ("w", "vw", *bands, "median_density")])
        return _density_columns(rows, group, unit_ha).unionByName(
            density_stats(with_weights(px, big[0]), big[1], unit_ha, zone, value, "w", keys, marks))
    v, w = F.col(value), F.col(weight) if weight else F.lit(1)
    usable = px.where(finite(v.cast("double")) & v.between(0, 100) & (w > 0))
    sums = {"pw": F.when(F.col("v") > 0, F.col("vw_w")).otherwise(0),
            **{f"w_{a}_{b}": F.when(F.col("v").between(a, b), F.col("vw_w")).otherwise(0) for a, b in M.DENSITY_CLASSES}}
    if weight:
        rows = Q.weighted_summary(usable, group, v, w, {"median_density": 0.5}, sums)
    else:
        rows = Q.interpolated_summary(usable, group, v, {"median_density": 0.5}, sums=sums)
    return _density_columns(_records(zones, ["complete_ha"], rows.select(*group, "w", "vw", *sums, "median_density"), zone, keys, expected), group, unit_ha)


def _density_columns(rows: DataFrame, group: list[str], unit_ha: float) -> DataFrame:
    whole = F.col("complete_ha")
    valid, present = (F.coalesce(c, F.lit(0)) * unit_ha for c in (F.col("w"), F.col("pw")))
    empty, rest = F.greatest(F.lit(0.0), valid - present), F.greatest(F.lit(0.0), whole - valid)
    columns = [valid.alias("valid_ha"), percentage(valid, whole).alias("valid_pct"), rest.alias("no_data_ha"),
               percentage(rest, whole).alias("no_data_pct"), F.when(F.col("w") > 0, F.col("vw") / F.col("w")).alias("mean_density"),
               "median_density", empty.alias("zero_ha"), percentage(empty, whole).alias("zero_pct"), present.alias("presence_ha"),
               percentage(present, whole).alias("presence_pct"), F.when(F.col("pw") > 0, F.col("vw") / F.col("pw")).alias("mean_present"),
               (F.coalesce("vw", F.lit(0)) / 100.0 * unit_ha).alias("crown_ha")]
    for a, b in M.DENSITY_CLASSES:
        area = F.coalesce(f"w_{a}_{b}", F.lit(0)) * unit_ha
        columns += [area.alias(f"class_{a}_{b}_ha"), percentage(area, whole).alias(f"class_{a}_{b}_pct"),
                    percentage(area, present).alias(f"class_{a}_{b}_present_pct")]
    return rows.select(*group, "complete_ha", *columns)


def temperature_stats(px: DataFrame, zones: DataFrame, unit_ha: float, zone: str = "sector_id",
                      keys: tuple[str, ...] = (), expected: Expected = None, weights: DataFrame | None = None) -> DataFrame:
    """Clear, cloud and missing areas of the complete zone area; weighted temperature figures of the clear part.

    ``px`` brings status, temp_c, uncertainty and a whole-number weight w, or no weight if there is a table of ``weights``
    (zone, row_i, col_i, w): then zones of few cells meet the pixels without a row per pixel and zone.
    """
    t, u = F.col("temp_c"), F.col("uncertainty")
    group = [*keys, zone]
    clear = (F.col("status") == 1) & finite(t)
    if weights is not None:
        values = {"t": F.when(clear, t), "u": F.when(clear & finite(u), u), "cloud": F.when(F.col("status") == 2, 0.0)}
        near, big, marks = _by_size(px, weights, zones, zone, keys, expected, F.coalesce(*[v.cast("double") for v in values.values()]).isNotNull())
        rows = CO.zone_records(px, near[0], near[1], marks, zone, list(keys), values, {"t": {"p10": 0.1, "p50": 0.5, "p90": 0.9}, "u": {"p50": 0.5}, "cloud": {}}, {})
        rows = rows.select(*group, "complete_ha", F.col("t_w").alias("clear_w"), F.col("cloud_w"), F.col("t_n").cast("long").alias("pixel_count"), F.col("t_vw").alias("tw"),
                           F.col("u_vw").alias("uw"), F.col("u_w").alias("uw_w"), F.col("t_p10").alias("p10_c"), F.col("t_p50").alias("median_c"), F.col("t_p90").alias("p90_c"),
                           F.col("u_p50").alias("median_uncertainty_k"))
        return _temperature_columns(rows, group, unit_ha).unionByName(
            temperature_stats(with_weights(px, big[0]), big[1], unit_ha, zone, keys, marks))
    w = F.col("w")
    # Three measures of a pixel in one summary, so that the input is read and shuffled once.
    measures = F.array(
        F.struct(F.lit("t").alias("m"), F.when(clear, t.cast("double")).alias("v")),
        F.struct(F.lit("u").alias("m"), F.when(clear & finite(u), u.cast("double")).alias("v")),
        F.struct(F.lit("cloud").alias("m"), F.when(F.col("status") == 2, 0.0).alias("v")))
    rows = px.where(w > 0).select(*group, w, F.inline(measures)).where("v IS NOT NULL")
    found = Q.weighted_summary(rows, [*group, "m"], F.col("v"), w, {"p10": 0.1, "p50": 0.5, "p90": 0.9})

    def of(measure: str, column: str) -> Column:
        return F.max(F.when(F.col("m") == measure, F.col(column)))

    joined = found.groupBy(*group).agg(
        of("t", "w").alias("clear_w"), of("cloud", "w").alias("cloud_w"), of("t", "n").alias("pixel_count"), of("t", "vw").alias("tw"),
        of("u", "vw").alias("uw"), of("u", "w").alias("uw_w"), of("t", "p10").alias("p10_c"), of("t", "p50").alias("median_c"),
        of("t", "p90").alias("p90_c"), of("u", "p50").alias("median_uncertainty_k"))
    return _temperature_columns(_records(zones, ["complete_ha"], joined, zone, keys, expected), group, unit_ha)


def _temperature_columns(joined: DataFrame, group: list[str], unit_ha: float) -> DataFrame:
    whole = F.col("complete_ha")
    clear_ha, cloud_ha = (F.coalesce(c, F.lit(0.0)) * unit_ha for c in (F.col("clear_w"), F.col("cloud_w")))
    missing = F.greatest(F.lit(0.0), whole - clear_ha - cloud_ha)
    return joined.select(
        *group, "complete_ha", clear_ha.alias("clear_ha"), percentage(clear_ha, whole).alias("clear_pct"),
        cloud_ha.alias("cloud_ha"), percentage(cloud_ha, whole).alias("cloud_pct"), missing.alias("missing_ha"),
        percentage(missing, whole).alias("missing_pct"), F.coalesce("pixel_count", F.lit(0)).alias("pixel_count"),
        F.when(F.col("clear_w") > 0, F.col("tw") / F.col("clear_w")).alias("mean_c"), "p10_c", "median_c", "p90_c",
        F.when(F.col("uw_w") > 0, F.col("uw") / F.col("uw_w")).alias("mean_uncertainty_k"), "median_uncertainty_k")


# --- Land cover on a grid whose cell area changes by row ------------------------------------------


def land_cover_areas(px: DataFrame, area_ha: Column, keys: list[str], code: str = "code") -> DataFrame:
    """(keys, code) → area. Everything about land cover is derived from this small table."""
    return px.groupBy(*keys, code).agg(F.sum(area_ha).alias("area_ha"))


def unknown_codes(px: DataFrame, code: str = "code") -> DataFrame:
    """Codes outside the dictionary (0 means no observation); must be empty."""
    known = [0, *[c for c, *_ in M.LAND_COVER]]
    return px.where(~F.col(code).isin(known)).groupBy(code).agg(F.count("*").alias("n"))


def land_cover_stats(areas: DataFrame, keys: list[str], code: str = "code", zones: DataFrame | None = None, zone: str = "sector_id",
                     expected: Expected = None) -> DataFrame:
    """Totals per zone; shares of the classified area; the dominant class is the largest, lowest code on ties.

    With ``zones`` every zone has a record for every other key, with zero areas where it has no pixel.
    """
    c, a = F.col(code), F.col("area_ha")
    classified = ~c.isin(0, M.LAND_COVER_UNCLASSIFIABLE)
    best = F.max(F.when(classified, F.struct(a.alias("a"), (-c).alias("o"), c.alias("c"))))
    sums = areas.groupBy(*keys).agg(
        F.sum(a).alias("total_ha"), _sum_if(classified, a).alias("classified_ha"),
        _sum_if(c == M.LAND_COVER_UNCLASSIFIABLE, a).alias("unclassifiable_ha"),
        _sum_if(c.isin(M.LAND_COVER_VEGETATION), a).alias("vegetation_ha"), _sum_if(c.isin(M.LAND_COVER_BUILT_UP), a).alias("built_up_ha"),
        best["c"].alias("dominant_code"))
    if zones is not None:
        sums = _records(zones, [], sums, zone, tuple(k for k in keys if k != zone), expected).na.fill(0.0, [c for c in sums.columns if c.endswith("_ha")])
    return (sums.withColumn("vegetation_pct", percentage(F.col("vegetation_ha"), F.col("classified_ha"), None))
            .withColumn("built_up_pct", percentage(F.col("built_up_ha"), F.col("classified_ha"), None)))


def land_cover_classes(areas: DataFrame, keys: list[str], code: str = "code") -> DataFrame:
    """Classified rows with their share of the classified area."""
    rows = areas.where(~F.col(code).isin(0, M.LAND_COVER_UNCLASSIFIABLE))
    whole = rows.groupBy(*keys).agg(F.sum("area_ha").alias("classified_ha"))
    return rows.join(whole, keys).withColumn("pct", percentage(F.col("area_ha"), F.col("classified_ha"))).drop("classified_ha")


def change_stats(pairs: DataFrame, area_ha: Column, keys: list[str], before: str = "before", after: str = "after",
                 zones: DataFrame | None = None, zone: str = "sector_id", expected: Expected = None) -> DataFrame:
    """Compared, gained, lost and unchanged vegetation area per zone; shares of the compared area.

    With ``zones`` every zone has a record for every other key.
    """
    known = [c for c, *_ in M.LAND_COVER]
    b, a = F.col(before), F.col(after)
    usable = P.comparable(b, a, known)
    state = P.change_state(b, a, known, M.LAND_COVER_VEGETATION)
    kept = usable & b.isin(M.LAND_COVER_VEGETATION) & a.isin(M.LAND_COVER_VEGETATION)
    sums = pairs.groupBy(*keys).agg(_sum_if(usable, area_ha).alias("compared_ha"), _sum_if(state == 1, area_ha).alias("gained_ha"),
                                    _sum_if(state == 2, area_ha).alias("lost_ha"), _sum_if(kept, area_ha).alias("unchanged_ha"))
    if zones is not None:
        sums = _records(zones, [], sums, zone, tuple(k for k in keys if k != zone), expected).na.fill(0.0)
    return (sums.withColumn("gained_pct", percentage(F.col("gained_ha"), F.col("compared_ha"), None))
            .withColumn("lost_pct", percentage(F.col("lost_ha"), F.col("compared_ha"), None))
            .withColumn("net_ha", F.col("gained_ha") - F.col("lost_ha")))


# --- Vegetation on sub-cells ----------------------------------------------------------------------


def vegetation_stats(px: DataFrame, combos: DataFrame, zones: DataFrame, threshold: float, unit_m2: float,
                     zone: str = "sector_id", keys: tuple[str, ...] = (),
                     expected: Expected = None) -> DataFrame:
    """Vegetation areas from pixels × (cell, zone, land use, n sub-cells).

    Raster areas are scaled so that their total is the exact zone area (``zones.exact_m2``); shares use
    the raster total. Zones without pixels have zero areas and no factor. ``combos`` depends on the grid only and is shared by all observations.
    """
    n, valid = F.col("n"), F.coalesce("valid", F.lit(False))
    index = F.col("ndvi")
    reason = P.exclusion_reason(F.col("cover"), F.col("use"))
    group = [*keys, zone]
    rows = px.join(combos, ["row_i", "col_i"]).withColumn("reason", reason)
    counted = valid & finite(index)
    free = counted & F.col("reason").isNull()
    # One pass: sums per index bin (at most 2001 and one without a value), from which the totals and the median follow.
    bins = rows.groupBy(*group, F.when(counted, P.ndvi_bin(index)).alias("b")).agg(
        F.sum(n).alias("total"), _sum_if(counted, n).alias("valid"), _sum_if(free & (index >= threshold), n).alias("likely"),
        _sum_if(free & (index < threshold), n).alias("below"), _sum_if(counted & (F.col("reason") == "cropland"), n).alias("cropland"),
        _sum_if(counted & (F.col("reason") == "water"), n).alias("water"), _sum_if(~counted, n).alias("missing"))
    whole = W.partitionBy(*group)
    upto = F.sum("valid").over(whole.orderBy(F.asc_nulls_last("b")).rowsBetween(W.unboundedPreceding, 0))
    half = F.greatest(F.lit(1.0), F.ceil(F.sum("valid").over(whole) * 0.5))
    marked = bins.withColumn("reached", F.when((upto >= half) & F.col("b").isNotNull(), F.col("b")))
    parts = ["total", "valid", "likely", "below", "cropland", "water", "missing"]
    joined = marked.groupBy(*group).agg(*[F.sum(p).alias(p) for p in parts], F.min("reached").alias("b50"))
    joined = _records(zones, ["exact_m2"], joined, zone, keys, expected).na.fill(0, parts)
    factor = F.when(F.col("total") > 0, F.col("exact_m2") / (F.col("total") * unit_m2))
    return joined.select(*group, factor.alias("factor"), *[(F.col(p) * unit_m2 * F.coalesce(factor, F.lit(0.0)) / 10_000.0).alias(f"{p}_ha") for p in parts],
                         *[percentage(F.col(p), F.col("total")).alias(f"{p}_pct") for p in parts[2:6]],
                         P.bin_value(F.col("b50")).alias("median_ndvi"))


def overlap_counts(cells: DataFrame, pairs: dict[str, tuple[int, str]]) -> DataFrame:
    """Cells per (land cover, land use) pair of interest, in one row."""
    return cells.agg(*[F.count_if((F.col("cover") == c) & (F.col("use") == u)).alias(name) for name, (c, u) in pairs.items()])


def calibration_samples(px: DataFrame, dominant: DataFrame, min_votes: int = 8) -> DataFrame:
    """Valid pixels of cells with a clear land use, labelled positive or negative."""
    sample = (F.when(F.col("use").isin(M.VEGETATION_POSITIVE), "positive").when(F.col("use").isin(M.VEGETATION_NEGATIVE), "negative"))
    cells = dominant.where(F.col("votes") >= min_votes).withColumn("sample", sample).where("sample IS NOT NULL")
    return px.where("valid AND ndvi IS NOT NULL").join(cells.select("row_i", "col_i", "sample"), ["row_i", "col_i"])


def calibrate_threshold(samples: DataFrame, keys: tuple[str, ...] = (), minimum: int = M.MIN_SAMPLES) -> DataFrame:
    """Youden threshold between positive and negative samples on 0.001 bins.

    Fewer than ``minimum`` samples of a label are an error when the result is read.

    Works on the two histograms (at most 2001 bins). The best J is taken with a 1e-12 tolerance; the
    lower middle one of the tied bins wins. AUC counts ties half. ``positive`` and ``negative``
    describe the two samples: count and the first bins whose cumulative count reaches each of ``M.SAMPLE_QUANTILES``.
    """
    key_list = list(keys) or ["all_rows"]
    rows = samples if keys else samples.withColumn("all_rows", F.lit(1))
    counted = rows.groupBy(*key_list, P.ndvi_bin(F.col("ndvi")).alias("b")).agg(
        F.count_if(F.col("sample") == "positive").alias("pos"), F.count_if(F.col("sample") == "negative").alias("neg"))
    # Every bin is a candidate, also empty ones: each key brings the whole axis, 2001 rows.
    axis = counted.select(*key_list).distinct().withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(2000))))
    bins = axis.join(counted, [*key_list, "b"], "left").na.fill(0, ["pos", "neg"])
    whole, below = W.partitionBy(*key_list), W.partitionBy(*key_list).orderBy("b").rowsBetween(W.unboundedPreceding, -1)
    running = (bins.withColumn("n_pos", F.sum("pos").over(whole)).withColumn("n_neg", F.sum("neg").over(whole))
               .withColumn("pos_below", F.coalesce(F.sum("pos").over(below), F.lit(0)))
               .withColumn("neg_below", F.coalesce(F.sum("neg").over(below), F.lit(0))).where("n_pos > 0 AND n_neg > 0"))
    sensitivity = (F.col("n_pos") - F.col("pos_below")) / F.col("n_pos")
    specificity = F.col("neg_below") / F.col("n_neg")
    scored = running.withColumn("sens", sensitivity).withColumn("spec", specificity).withColumn("j", F.col("sens") + F.col("spec") - 1.0)
    top = scored.withColumn("best_j", F.max("j").over(whole))
    tied = F.sort_array(F.collect_list(F.when(F.col("j") >= F.col("best_j") - 1e-12, F.struct("b", "sens", "spec"))))
    def reached(kind: str, p: float) -> Column:
        return F.min(F.when(F.col(f"{kind}_below") + F.col(kind) >= F.greatest(F.lit(1.0), F.ceil(F.col(f"n_{kind}") * F.lit(p))), F.col("b")))

    out = top.groupBy(*key_list).agg(
        *[reached(kind, p).alias(f"{kind}_{name}") for kind in ("pos", "neg") for name, p in M.SAMPLE_QUANTILES.items()],
        F.max("n_pos").alias("n_pos"), F.max("n_neg").alias("n_neg"), F.max("j").alias("youden_j"), tied.alias("tied"),
        F.sum(F.col("pos") * (F.col("neg_below") + F.col("neg") * 0.5)).alias("pairs"))
    best = out.withColumn("pick", F.element_at("tied", (F.floor((F.size("tied") - 1) / 2) + 1).cast("int")))
    auc = F.col("pairs") / (F.col("n_pos") * F.col("n_neg"))
    few = F.raise_error(F.concat(F.lit(f"fewer than {minimum} samples: "), F.col("n_pos").cast("string"), F.lit(" positive, "), F.col("n_neg").cast("string"), F.lit(" negative")))
    n_pos = F.when(F.least("n_pos", "n_neg") < minimum, few.cast("bigint")).otherwise(F.col("n_pos")).alias("n_pos") if minimum else F.col("n_pos")
    return best.select(*keys, n_pos, "n_neg", P.bin_value(F.col("pick.b")).alias("threshold"), "youden_j",
                       F.col("pick.sens").alias("sensitivity"), F.col("pick.spec").alias("specificity"),
                       ((F.col("pick.sens") + F.col("pick.spec")) / 2).alias("balanced_accuracy"),
                       (1 - F.col("pick.spec")).alias("false_positive_rate"), auc.alias("auc"),
                       (auc < M.AUC_WARNING).alias("overlap_warning"), *[F.struct(F.col(f"n_{kind}").alias("count"), *[P.bin_value(F.col(f"{kind}_{q}")).alias(q) for q in M.SAMPLE_QUANTILES]).alias(name)
                         for kind, name in (("pos", "positive"), ("neg", "negative"))])


# --- Distributions by scope -----------------------------------------------------------------------


def scope_distributions(px: DataFrame, keys: tuple[str, ...] = (), families: dict[str, list[str]] | None = None, code: str = "code") -> DataFrame:
    """Temperature distribution per scope (region, municipality, sector) and series.

    ``px`` brings sector_id, municipality, status, temp_c and either a series or, with ``families``, a class
    code. Pixels are first combined per sector, class, status and value; series and scopes are expanded on
    that, not on pixels. Percentiles use all clear values, also those outside the bins.
    """
    clear = (F.col("status") == 1) & finite(F.col("temp_c"))
    combined = (px.withColumn("t", F.when(clear, F.col("temp_c")))
                .withColumn("kind", F.when(clear, "clear").when(F.col("status") == 2, "cloud").when(F.col("status") == 0, "missing"))
                .groupBy(*keys, "sector_id", "municipality", "series" if families is None else code, "kind", "t").agg(F.count("*").alias("n")))
    # Its shuffle is written once and read by the sums and both steps of the quantiles.
    if families is not None:
        combined = with_series(combined, code, families)
    group = [*keys, "scope", "series"]
    rows = combined.withColumn("scope", F.explode(_all_scopes()))
    t, n = F.col("t"), F.col("n")
    sums = rows.groupBy(*group).agg(
        *[_sum_if(condition, n).cast("bigint").alias(name) for name, condition in (
            ("clear_n", F.col("kind") == "clear"), ("cloud_n", F.col("kind") == "cloud"), ("missing_n", F.col("kind") == "missing"),
            ("underflow_n", t < M.TEMPERATURE_MIN), ("overflow_n", t > M.TEMPERATURE_MAX))])
    spread = Q.interpolated_summary(rows, group, t, {"p10_c": 0.1, "median_c": 0.5, "p90_c": 0.9}, n)
    return sums.join(spread.withColumn("mean_c", F.col("vw") / F.col("w")).select(*group, "mean_c", "p10_c", "median_c", "p90_c"), group, "left")


def _all_scopes() -> Column:
    return F.array(F.lit("region:all"), F.concat(F.lit("municipality:"), "municipality"), F.concat(F.lit("sector:"), F.col("sector_id").cast("string")))


def scope_bins(px: DataFrame, zones: DataFrame, families: dict[str, list[str]], keys: tuple[str, ...] = (), code: str = "code") -> DataFrame:
    """Counts of clear pixels in all 0.5 °C bins, zeros included, per scope of ``zones`` and every series, also without a pixel.

    Pixels are counted per sector, class and bin; series and scopes are expanded on that small table. Scopes and keys are paired
    with one list of counts each (at most series × bins entries), series and bins are expanded last.
    """
    on = [*keys, "scope"]
    clear = (F.col("status") == 1) & finite(F.col("temp_c"))
    per_sector = px.groupBy(*keys, "sector_id", "municipality", code, F.when(clear, P.temperature_bin(F.col("temp_c"))).alias("bin")).agg(F.count("*").alias("n"))
    counts = (with_series(per_sector, code, families).withColumn("scope", F.explode(_all_scopes()))
              .groupBy(*on, "series", "bin").agg(F.sum("n").alias("n")))
    listed = counts.groupBy(*on).agg(F.array_sort(F.collect_list(F.when(F.col("bin").isNotNull(), F.struct(F.concat_ws(" ", "series", "bin").alias("at"), "n")))).alias("found"))
    frame = zones.select(F.explode(_all_scopes()).alias("scope")).distinct()
    whole = _for_every(frame, listed, ["scope"], list(keys), None).join(frame, "scope", "left_semi") if keys else frame.join(listed, "scope", "left")
    series = [f"family:{f}" for f in families] + [f"class:{c}" for codes in families.values() for c in codes]
    whole = whole.withColumn("found", F.coalesce(F.map_from_entries("found"), F.create_map().cast("map<string,bigint>")))
    whole = (whole.withColumn("series", F.explode(F.array(*map(F.lit, series))))
             .withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(int((M.TEMPERATURE_MAX - M.TEMPERATURE_MIN) / M.TEMPERATURE_BIN) - 1)))))
    return whole.select(*on, "series", "bin", F.coalesce(F.col("found")[F.concat_ws(" ", "series", "bin")], F.lit(0)).alias("n"))


def histogram(px: DataFrame, keys: list[str], value: str = "temp_c") -> DataFrame:
    """Counts per 0.5 °C bin; values outside 15–50 °C are in no bin, 50 °C is in the last one."""
    b = P.temperature_bin(F.col(value))
    return px.groupBy(*keys, b.alias("bin")).agg(F.count("*").alias("n")).where("bin IS NOT NULL")


def normalise_histogram(bins: DataFrame, totals: DataFrame, keys: list[str], minimum: int = 10) -> DataFrame:
    """Bins in percent of the clear count (``totals.clear_n``); series below the minimum are left out.

    ``axis_max`` is the highest percentage of the key's bins, rounded up to a multiple of 5, at least 1.
    """
    rows = bins.join(totals.where(F.col("clear_n") >= minimum), keys).withColumn("pct", F.col("n") / F.col("clear_n") * 100.0)
    top = rows.groupBy(*keys).agg(F.greatest(F.lit(1.0), F.ceil(F.max("pct") / 5.0) * 5.0).alias("axis_max"))
    return rows.join(top, keys).select(*keys, "bin", "n", "pct", "axis_max")


# --- User layers, profiles, series ----------------------------------------------------------------


def user_layer_stats(px: DataFrame, value: Column, zones: DataFrame, cell_ha: float, zone: str = "sector_id",
                     keys: tuple[str, ...] = (), expected: Expected = None) -> DataFrame:
    """Range, mean and median of any expression over the pixels, valid area and zone area."""
    group = [*keys, zone]
    v = value.cast("double")
    found = Q.interpolated_summary(px, group, F.when(finite(v), v), {"median": 0.5})
    stats = found.select(*group, F.col("lo").alias("minimum"), F.col("hi").alias("maximum"), (F.col("vw") / F.col("w")).alias("mean"), "median",
                         (F.col("w") * cell_ha).alias("valid_ha"))
    out = _records(zones.withColumnRenamed("complete_ha", "zone_ha"), ["zone_ha"], stats, zone, keys, expected)
    return out.withColumn("valid_ha", F.coalesce("valid_ha", F.lit(0.0)))


def user_class_stats(px: DataFrame, value: Column, classes: list[int], cell_ha: float, zones: DataFrame, zone: str = "sector_id",
                     keys: tuple[str, ...] = (), expected: Expected = None) -> DataFrame:
    """Class areas with their share of the **valid** pixels, zeros for zones without any."""
    rows = px.withColumn("v", value).where("v IS NOT NULL")
    counts = rows.groupBy(*keys, zone).agg(F.count("*").alias("n_valid"), *[F.count_if(F.col("v") == c).alias(f"n_{c}") for c in classes])
    counts = _records(zones, [], counts, zone, keys, expected).na.fill(0)
    items = F.array(*[F.struct(F.lit(c).alias("value"), (F.col(f"n_{c}") * cell_ha).alias("area_ha"),
                               percentage(F.col(f"n_{c}"), F.col("n_valid")).alias("pct")) for c in classes])
    return counts.select(*keys, zone, F.inline(items))


def profile(px: DataFrame, value: str, keys: tuple[str, ...] = (), minimum_pct: float = 50.0) -> DataFrame:
    """Valid count and share, range; ``usable`` tells whether enough is valid."""
    v = F.when(finite(F.col(value)), F.col(value))
    out = px.groupBy(*keys).agg(F.count(v).alias("valid_n"), (F.count(v) / F.count("*") * 100.0).alias("valid_pct"),
                                F.min(v).alias("minimum"), F.max(v).alias("maximum"))
    return out.withColumn("usable", F.col("valid_pct") >= minimum_pct)


def complete_series(px: DataFrame, n_dates: int | Column, value: str, time: str = "obs_id") -> DataFrame:
    """Cells valid at every date, with their values in time order (as many as there are dates)."""
    values = F.transform(F.array_sort(F.collect_list(F.struct(F.col(time), F.col(value)))), lambda s: s[value])
    return (px.where(F.col(value).isNotNull()).groupBy("row_i", "col_i").agg(F.count("*").alias("n"), values.alias("series"))
            .where(F.col("n") == n_dates).select("row_i", "col_i", "series"))


def observation_profile(px: DataFrame, value: str, valid: Column, n_bins: int, keys: list[str]) -> DataFrame:
    """Valid share, median of the valid values and their density histogram with equal bins, one row per bin."""
    v = F.when(valid & finite(F.col(value)), F.col(value))
    # pixels are counted by value first; all figures come from these counts
    rows = px.groupBy(*keys, v.alias("v")).agg(F.count("*").alias("c"))
    share = rows.groupBy(*keys).agg((_sum_if(F.col("v").isNotNull(), F.col("c")) / F.sum("c")).alias("valid_share"))
    spread = Q.interpolated_summary(rows, keys, F.col("v"), {"median": 0.5}, F.col("c")).join(share, keys)
    width = (F.col("hi") - F.col("lo")) / n_bins
    b = F.least(F.floor((F.col("v") - F.col("lo")) / width), F.lit(n_bins - 1)).cast("int")
    counts = rows.where("v IS NOT NULL").join(spread.select(*keys, "lo", "hi"), keys).groupBy(*keys, b.alias("bin")).agg(F.sum("c").alias("n"))
    return counts.join(spread, keys).select(*keys, "bin", "n", "valid_share", "median", (F.col("n") / (F.col("w") * width)).alias("density"))


def composition(stats: DataFrame, keys: list[str], classes: list, total: str, code: str = "code", area: str = "area_ha") -> DataFrame:
    """Fixed class list per key, absent classes as 0, plus ``rest`` = total − listed, never negative."""
    sums = stats.groupBy(*keys).agg(F.max(total).alias("total"), *[_sum_if(F.col(code) == c, F.col(area)).alias(f"a_{c}") for c in classes])
    listed = sum(F.col(f"a_{c}") for c in classes)
    items = F.array(*[F.struct(F.lit(str(c)).alias("part"), F.col(f"a_{c}").alias("area_ha")) for c in classes],
                    F.struct(F.lit("rest").alias("part"), F.greatest(F.lit(0.0), F.col("total") - listed).alias("area_ha")))
    return sums.select(*keys, F.inline(items))


def present_classes(stats: DataFrame, dimension: DataFrame, code: str = "code", area: str = "area_ha") -> DataFrame:
    """Dictionary with a flag for the classes that occur anywhere."""
    seen = stats.where(F.col(area) > 0).select(code).distinct().withColumn("seen", F.lit(True))
    return dimension.join(seen, code, "left").withColumn("present", F.coalesce("seen", F.lit(False))).drop("seen")

