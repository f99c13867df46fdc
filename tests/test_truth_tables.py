"""Exact small cases: the published behaviour of every rule, on tens of rows."""

from __future__ import annotations

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from zonemill import model as M
from zonemill.functions import numbers as N
from zonemill.functions import pixels as P
from zonemill.functions import scores as S
from zonemill.functions import text as X
from zonemill.operators import rollups as R
from zonemill.operators import scenes as SC
from zonemill.operators import tables as TB
from zonemill.operators import zonal as Z

NAN = float("nan")


def values(spark, data, schema, expression):
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(data)], "i int, " + schema)
    return [r[0] for r in df.orderBy("i").select(expression).collect()]


def test_binary_statistics(spark, rows):
    px = spark.createDataFrame([("A", 0), ("A", 1), ("A", 255), ("A", None)], "sector_id string, code int")
    zones = spark.createDataFrame([("A", 1.0), ("B", 2.0)], "sector_id string, complete_ha double")
    out = rows(Z.binary_stats(px, zones, 0.25), "sector_id")
    assert (out["A"]["sealed_ha"], out["A"]["unsealed_ha"], out["A"]["no_data_ha"], out["A"]["sealed_pct"]) == (0.25, 0.25, 0.5, 25.0)
    assert (out["B"]["valid_ha"], out["B"]["no_data_ha"], out["B"]["no_data_pct"]) == (0.0, 2.0, 100.0)


def test_categorical_statistics_share_of_the_complete_area(spark, rows):
    px = spark.createDataFrame([("A", c) for c in (1, 2, 3, 4, 0)], "sector_id string, code int")
    zones = spark.createDataFrame([("A", 1.0)], "sector_id string, complete_ha double")
    out = rows(Z.categorical_stats(px, zones, [1, 2, 3, 4], 0.2), "code")
    assert [out[c]["pct"] for c in (1, 2, 3, 4)] == pytest.approx([20.0] * 4)
    assert out[1]["no_data_pct"] == pytest.approx(20.0)


def density(spark, cells, unit, complete):
    px = spark.createDataFrame([("A", float(v), w) for v, w in cells], "sector_id string, value double, w int")
    zones = spark.createDataFrame([("A", complete)], "sector_id string, complete_ha double")
    return Z.density_stats(px, zones, unit).collect()[0]


def test_density_statistics_with_equal_weights(spark):
    out = density(spark, [(0, 1), (25, 1), (50, 1), (100, 1), (255, 1)], 0.2, 1.0)
    assert out["mean_density"] == 43.75 and out["crown_ha"] == pytest.approx(0.35)
    assert out["presence_ha"] == pytest.approx(0.6) and out["presence_pct"] == pytest.approx(60.0)
    assert out["mean_present"] == pytest.approx(58.3333, abs=1e-4) and out["zero_ha"] == pytest.approx(0.2)
    assert out["no_data_pct"] == pytest.approx(20.0)


def test_unweighted_median_interpolates(spark):
    df = spark.createDataFrame([(v,) for v in (0.0, 25.0, 50.0, 100.0)], "v double")
    from zonemill.operators import quantiles as Q
    assert Q.interpolated_quantiles(df, [], F.col("v"), {"m": 0.5}).collect()[0]["m"] == 37.5


def test_density_statistics_with_fractional_weights(spark):
    out = density(spark, [(0, 1), (50, 2), (100, 3), (255, 4)], 0.0025, 0.025)
    assert out["valid_ha"] == pytest.approx(0.015) and out["no_data_ha"] == pytest.approx(0.01)
    assert out["mean_density"] == pytest.approx(66.6667, abs=1e-4) and out["median_density"] == 50
    assert out["crown_ha"] == pytest.approx(0.01) and out["presence_ha"] == pytest.approx(0.0125)
    assert out["mean_present"] == pytest.approx(80) and out["class_81_100_ha"] == pytest.approx(0.0075)


def test_surface_temperature(spark):
    got = values(spark, [(0,), (40000,), (50000,)], "dn int", P.surface_temperature(F.col("dn")))
    assert got == pytest.approx([d * 0.00341802 + 149.0 - 273.15 for d in (0, 40000, 50000)], abs=1e-5)


def test_quality_bits(spark):
    data = [(40000, 0, 0), (40000, 1, 0), *[(40000, 1 << b, 0) for b in range(1, 6)], *[(40000, 0, 1 << b) for b in (0, 1, 2, 3, 4, 5, 6, 8)],
            (0, 2, 0), (0, 0, 0), (40000, 0, 1 << 11), (292, 0, 0), (293, 0, 0)]
    got = values(spark, data, "dn int, qa int, rad int", P.classify_quality(F.col("dn"), F.col("qa"), F.col("rad")))
    assert got == [1, 0, 2, 2, 2, 2, 2, *[0] * 8, 2, 0, 1, 0, 1]


def test_soil_majority(spark):
    data = list(zip([1.0, 1.0, 1.0, .5, .499, 1.0, NAN], [.51, .49, .5, .75, .9, NAN, .8]))
    assert values(spark, data, "c double, f double", P.classify_soil(F.col("c"), F.col("f"))) == [1, 2, 0, 1, 0, 0, 0]


def test_percentage_encoder_is_single_precision(spark):
    got = values(spark, [(0.0,), (12.345,), (100.0,), (NAN,), (None,), (120.0,)], "v double", N.encode_percentage(F.col("v")))
    assert got == [0, 1234, 10000, 65535, 65535, 10000]
    assert values(spark, [(1234,), (65535,)], "v int", N.decode_percentage(F.col("v"))) == [12.34, None]


def test_ndvi(spark):
    data = [(.2, .6), (0.0, 0.0), (-2.0, 1.0), (NAN, .5), (.5, .5)]
    got = values(spark, data, "r double, n double", P.ndvi(F.col("r"), F.col("n")))
    assert got[0] == pytest.approx(0.5) and got[1:4] == [None, None, None] and got[4] == 0.0
    valid = values(spark, [(1, c) for c in range(12)] + [(0, 4)], "m int, c int", P.valid_scene_pixel(F.col("m"), F.col("c")))
    assert [c for c, ok in enumerate(valid) if ok] == [2, 4, 5, 6]


def test_change_states(spark):
    data = list(zip([90, 10, 40, 30, 254, 0], [10, 90, 30, 40, 10, 10]))
    known = [c for c, *_ in M.LAND_COVER]
    assert values(spark, data, "b int, a int", P.change_state(F.col("b"), F.col("a"), known, [10, 30])) == [1, 2, 1, 2, 0, 0]


def test_exclusion_reasons(spark):
    data = [(40, "21000"), (40, "23000"), (30, "21000"), (30, "23000"), (10, "50000"), (40, "50000"), (10, "31000"), (40, None)]
    got = values(spark, data, "lc int, ua string", P.exclusion_reason(F.col("lc"), F.col("ua")))
    assert got == ["cropland", None, "cropland", None, "water", "water", None, "cropland"]


def test_vegetation_labels(spark):
    data = [(.5, True, None), (.5, False, None), (None, True, None), (.5, True, "water"), (.1, True, None)]
    got = values(spark, data, "v double, ok boolean, r string", P.classify_vegetation(F.col("v"), F.col("ok"), F.col("r"), 0.3))
    assert got == ["likely-vegetated", "no-data", "no-data", "excluded", "below-threshold"]


def test_scores(spark):
    data = [(6.0,), (9999.0,), (None,), (11.0,), (2.5,), (8.5,)]
    status = S.score_status(F.col("v"))
    assert values(spark, data, "v double", status) == ["scored", S.INSTITUTION, S.INSUFFICIENT, "scored", "scored", "scored"]
    assert values(spark, data, "v double", S.score_class(F.col("v"), status)) == ["score-6", S.INSTITUTION, "no-data", "score-11", "score-3", "score-9"]
    assert values(spark, data, "v double", S.metric_status(F.col("v"), F.lit("scored")))[3] == S.INSUFFICIENT
    assert values(spark, data, "v double", S.interpretation(F.col("v"), status)) == ["medium", "institution", "insufficient", "very-high", "rather-low", "very-high"]
    assert values(spark, data, "v double", S.score_percentage(F.col("v"))) == [60.0, 100.0, 0.0, 100.0, 25.0, 85.0]


def test_text_parsing(spark):
    data = [("",), (".",), ("C",), ("12.5",), (None,), (" 7 ",), ("x",), ("Infinity",)]
    assert values(spark, data, "t string", S.official_number(F.col("t"))) == [None, None, None, 12.5, None, 7.0, None, None]


def test_income_bands_leave_gaps(spark):
    data = [(19999.999,), (19999.9995,), (20000.0,), (45000.0,), (None,), (NAN,)]
    assert values(spark, data, "v double", N.band(F.col("v"), M.INCOME_BANDS)) == ["under-20000", "no-data", "20000-24999", "45000-plus", "no-data", "no-data"]


def test_finite_and_rounding(spark):
    data = [(NAN,), (math.inf,), (12.5,), (None,)]
    assert values(spark, data, "v double", N.finite_or_null(F.col("v"))) == [None, None, 12.5, None]
    assert values(spark, [(0.125,), (2.5,)], "v double", N.half_up(F.col("v"), 2)) == [0.13, 2.5]
    assert values(spark, [(2.5,), (3.5,)], "v double", N.half_even(F.col("v"))) == [2.0, 4.0]


def test_brussels_time(spark):
    got = values(spark, [("2026-06-22 10:33:40",), ("2026-01-22 10:33:40",)], "t string", X.brussels_time(F.col("t").cast("timestamp")))
    assert got == ["2026-06-22 12:33 CEST", "2026-01-22 11:33 CET"]


def test_slugs_and_paths(spark):
    assert values(spark, [("Sint-Genesius Rode!",), ("Éléonore",)], "t string", X.folded_slug(F.col("t"))) == ["sint-genesius-rode", "eleonore"]
    paths = [("a/b.json",), ("../b.json",), ("/a.json",), ("C:\\a.json",), ("a.png",), (None,)]
    assert values(spark, paths, "t string", X.safe_asset(F.col("t"), ".json")) == [True, False, False, False, False, False]


def test_ramp_ends_and_middle(spark):
    got = values(spark, [(-1.0,), (0.0,), (1.0,), (2.0,), (0.07,), (None,)], "v double", N.ramp(F.col("v"), M.TEMPERATURE_RAMP))
    assert got[0] == got[1] == "#000004" and got[2] == got[3] == "#fcffa4" and got[4] == "#0e0623" and got[5] is None


def test_scenes_by_date(spark, rows):
    scenes = spark.createDataFrame([(1, dt.date(2023, 6, 13), 5.0, "a"), (2, dt.date(2023, 6, 13), None, "b"), (3, dt.date(2023, 6, 14), 7.0, "a")],
                                   "scene_id int, d date, cloud_pct double, tile string")
    out = rows(SC.scenes_by_date(scenes), "d")
    assert out[dt.date(2023, 6, 13)]["n_products"] == 2 and out[dt.date(2023, 6, 13)]["max_cloud"] == 100.0
    assert [r[0] for r in TB.has_all(scenes, "d", "tile", ["a", "b"]).collect()] == [dt.date(2023, 6, 13)]


def test_clearest_candidate(spark, rows):
    data = [(1, "2023-06-14", 97.5), (2, "2023-06-13", 99.8), (3, "2023-09-10", 91.33), (4, "2023-09-09", 99.87), (5, "2020-08-16", 99.0), (6, "2020-08-07", 12.0),
            (7, "2025-06-30", 9.9)]
    scenes = spark.createDataFrame(data, "scene_id int, day string, coverage_pct double").withColumn("d", F.to_date("day")).withColumn(
        "acquired_at", F.to_timestamp("day"))
    judged = SC.select_clearest(SC.scenes_in_period(scenes, M.HEAT_PERIODS), M.EXCLUDED_DATES)
    reasons = {k: v["reason"] for k, v in rows(judged, "scene_id").items()}
    assert reasons == {1: "not-clearest", 2: "selected", 3: "not-clearest", 4: "selected", 5: "excluded-from-timeline", 6: "selected", 7: "insufficient-coverage"}
    periods = spark.createDataFrame([(p,) for p, *_ in M.HEAT_PERIODS], "period_id string")
    status = {k: v["status"] for k, v in rows(SC.period_status(periods, judged), "period_id").items()}
    assert status["2025-06"] == "cloud-obscured" and status["2026-06"] == "no-acquisition" and status["2023-09"] == "observed"


def test_annual_tiers(spark):
    def choose(*cands):
        df = spark.createDataFrame([(dt.date.fromisoformat(d), c, k) for d, c, k in cands], "d date, coverage_pct double, cloud_pct double")
        return SC.select_annual(df, 7, 15).collect()[0]
    assert choose(("2021-07-10", 99.6, 1.9), ("2021-07-15", 99.9, 2.1), ("2021-07-01", 99.9, 0.0))["d"] == dt.date(2021, 7, 10)
    assert choose(("2021-09-01", 99.6, 1.0), ("2021-07-15", 99.9, 9.0))["d"] == dt.date(2021, 9, 1)
    assert choose(("2021-09-01", 99.6, 8.0), ("2021-07-15", 99.9, 9.0))["d"] == dt.date(2021, 9, 1)
    only = choose(("2021-09-01", 50.0, 8.0), ("2021-07-15", 40.0, 8.0))
    assert only["d"] == dt.date(2021, 7, 15) and only["quality"] == "warning"


def test_mosaic_prefers_clear_then_certain_then_first(spark, rows):
    data = [("a", 1, 20.0, .5, 1), ("a", 1, 21.0, .4, 2), ("b", 1, 20.0, .4, 1), ("b", 1, 21.0, .4, 2), ("c", 2, None, None, 1), ("c", 0, None, None, 2),
            ("d", 0, None, None, 1), ("e", 2, None, None, 1), ("e", 1, 9.0, 3.0, 2)]
    px = spark.createDataFrame(data, "cell string, status int, temp_c double, uncertainty double, scene_rank int")
    out = rows(SC.mosaic(px, ["cell"]), "cell")
    assert (out["a"]["temp_c"], out["b"]["temp_c"], out["e"]["temp_c"]) == (21.0, 20.0, 9.0)
    assert [out[k]["status"] for k in "abcde"] == [1, 1, 2, 0, 1] and out["c"]["temp_c"] is None


def test_scope_distributions(spark, rows):
    t = [14.9, 15.0, 15.49, 49.9, 50.0, 50.1, NAN, NAN]
    data = [("S", "M", "class:1", s, v) for v, s in zip(t, [1] * 6 + [2, 0])]
    px = spark.createDataFrame(data, "sector_id string, municipality string, series string, status int, temp_c double")
    out = rows(Z.scope_distributions(px), "scope")
    assert set(out) == {"region:all", "municipality:M", "sector:S"}
    for r in out.values():
        assert (r["clear_n"], r["underflow_n"], r["overflow_n"], r["cloud_n"], r["missing_n"]) == (6, 1, 1, 1, 1)
        assert r["median_c"] == pytest.approx((15.49 + 49.9) / 2)
    bins = rows(Z.histogram(px.where("status = 1"), ["sector_id"]), "bin")
    assert {b: r["n"] for b, r in bins.items()} == {0: 2, 69: 2}


GROUPS = {"green": (M.GREEN_ORDER, True), "artificial": (M.ARTIFICIAL_CODES, False)}


def class_case(spark, areas):
    facts = spark.createDataFrame([("S", c, float(a)) for c, a in areas.items()], "sector_id string, class_code string, area_m2 double")
    zones = spark.createDataFrame([("S", "M", 1_000_000.0)], "sector_id string, municipality string, zone_m2 double")
    stats = R.class_area_stats(facts, zones, M.GREEN_CODES, M.ARTIFICIAL_CODES, M.NO_DATA_CODES)
    return stats.collect()[0], R.class_breakdown(facts, stats, GROUPS, no_data=M.NO_DATA_CODES).collect(), facts, stats, zones


def test_class_area_statistics(spark):
    s, rows_, *_ = class_case(spark, {"32000": 200e3, "31000": 100e3, "14110": 50e3, "23000": 150e3, "21000": 100e3, "14200": 100e3, "11100": 300e3})
    assert s["green_ha"] == 50 and s["green_pct"] == 50 and s["artificial_ha"] == 30 and s["dominant_code"] == "11100" and s["coverage_pct"] == 100
    assert {r["class_code"] for r in rows_ if r["grp"] == "other"} == {"14200", "21000"}
    assert sum(r["grp"] == "green" for r in rows_) == 6 and sum(r["grp"] == "artificial" for r in rows_) == 1


def test_class_area_no_data(spark):
    s, rows_, *_ = class_case(spark, {"91000": 100e3, "11100": 800e3})
    assert s["valid_ha"] == 80 and s["no_data_ha"] == 20 and s["artificial_pct"] == 100
    assert all(r["area_ha"] == 0 for r in rows_ if r["grp"] == "green")


def test_rollup_sums_before_dividing(spark, rows):
    facts = spark.createDataFrame([("A", "31000", 20e3), ("A", "32000", 10e3), ("A", "11100", 50e3), ("A", "21000", 20e3), ("B", "11100", 900e3)],
                                  "sector_id string, class_code string, area_m2 double")
    zones = spark.createDataFrame([("A", "M", 100e3), ("B", "N", 900e3)], "sector_id string, municipality string, zone_m2 double")
    stats = R.class_area_stats(facts, zones, M.GREEN_CODES, M.ARTIFICIAL_CODES, M.NO_DATA_CODES)
    out = rows(R.rollup_class_stats(stats, facts, zones, M.NO_DATA_CODES), "scope")
    assert out["municipality:M"]["green_pct"] == 30 and out["municipality:M"]["artificial_pct"] == 50 and out["municipality:M"]["dominant_code"] == "11100"
    assert out["region:all"]["green_pct"] == pytest.approx(3.0) and out["region:all"]["zone_ha"] == 100


def samples(spark, positive, negative):
    return spark.createDataFrame([("positive", v) for v in positive] + [("negative", v) for v in negative], "sample string, ndvi double")


def test_threshold_calibration(spark):
    out = Z.calibrate_threshold(samples(spark, [.7, .75, .8, .85, .9], [.1, .15, .2, .25, .3]), minimum=0).collect()[0]
    assert (out.positive["count"], out.positive.p05, out.positive.median, out.negative.p25, out.negative.p95) == pytest.approx((5, .7, .8, .15, .3))
    assert 0.3 < out["threshold"] <= 0.7 and out["youden_j"] == out["sensitivity"] == out["specificity"] == out["auc"] == 1.0
    # The tied bins run from 0.301 to 0.700; the lower middle one wins.
    assert out["threshold"] == 0.5 and not out["overlap_warning"]
    same = Z.calibrate_threshold(samples(spark, [.1, .2, .3], [.1, .2, .3]), minimum=0).collect()[0]
    assert same["auc"] == pytest.approx(0.5) and same["overlap_warning"]
    assert Z.calibrate_threshold(samples(spark, [.1], []), minimum=0).collect() == []


def test_densify_and_statuses(spark, rows):
    zones = spark.createDataFrame([("A",), ("B",)], "sector_id string")
    fact = spark.createDataFrame([("A", 2019, "available", 5.0)], "sector_id string, year int, source_status string, median double")
    out = rows(TB.densify(fact, zones, [2019, 2020]), "sector_id", "year")
    assert len(out) == 4 and out[("A", 2019)]["source_status"] == "available" and out[("B", 2020)]["source_status"] == "sector-unmatched"
    assert out[("A", 2020)]["median"] is None


def test_join_complete_reports_missing(spark):
    a, b = spark.createDataFrame([(1,), (2,)], "k int"), spark.createDataFrame([(1,), (3,)], "k int")
    assert {(r["k"], r["missing_in"]) for r in TB.unmatched_keys(a, b, "k").collect()} == {(2, "right"), (3, "left")}
    with pytest.raises(ValueError, match="not complete"):
        TB.join_complete(a, b, "k")
    assert TB.join_complete(a, a, "k").count() == 2


def test_find_zone_and_names(spark):
    z = spark.createDataFrame([("23003A", "Óost"), ("23003B", "Zuid"), ("23003C", "oever")], "sector_id string, sector_name string")
    assert [r["sector_id"] for r in TB.find_zone(z, " zuid ", "sector_id", "sector_name").collect()] == ["23003B"]
    assert [r["sector_id"] for r in TB.find_zone(z, "23003a", "sector_id", "sector_name").collect()] == ["23003A"]
    assert [r["sector_name"] for r in TB.sort_names(z, "sector_name").collect()] == ["oever", "Óost", "Zuid"]


def test_families_are_disjoint(spark):
    groups = spark.createDataFrame([(c, f) for f, codes in M.FAMILIES.items() for c in codes], "code string, grp string")
    assert TB.overlapping_codes(groups).count() == 0
    assert not set(M.GREEN_CODES) & set(M.ARTIFICIAL_CODES)
    with pytest.raises(ValueError):
        TB.with_series(groups, "code", {"a": ["1"], "b": ["1"]})


def test_nearest_edition(spark):
    got = [r["edition"] for r in TB.nearest_edition(spark.createDataFrame([(y,) for y in (2020, 2022, 2023, 2025, 2026)], "y int"), F.col("y"), [2020, 2022, 2023, 2024]).collect()]
    assert got == [2020, 2022, 2023, 2024, 2024]


def test_timeline_problems(spark):
    from zonemill.operators import quality as QU
    obs = spark.createDataFrame([("a", 99.0), ("b", 5.0)], "obs_id string, coverage_pct double")
    timeline = spark.createDataFrame([("a",), ("b",), ("x",)], "obs_id string")
    got = {tuple(r) for r in QU.timeline_violations(timeline, obs, ["a", "b", "c"], 10.0).collect()}
    assert got == {("b", "coverage"), ("x", "observation"), ("x", "coverage"), ("x", "expected"), ("c", "absent")}


def test_parcels(spark, rows):
    frag = spark.createDataFrame([("A", 1, "Maïs", 2.0), ("A", 1, "Maïs", 1.0), ("A", 2, " ", 1.0)], "sector_id string, parcel_id int, crop_group string, area_ha double")
    zones = spark.createDataFrame([("A", 8.0), ("B", 5.0)], "sector_id string, complete_ha double")
    out = rows(R.parcel_stats(frag, zones), "sector_id")
    assert out["A"]["n_parcels"] == 2 and out["A"]["parcel_pct"] == 50 and out["B"]["parcel_ha"] == 0 and out["B"]["n_parcels"] == 0
    groups = rows(R.crop_group_stats(frag), "crop_group")
    assert groups["Maïs"]["group_pct"] == 75 and groups[M.OTHER_CROPS]["area_ha"] == 1.0


def test_region_surface_with_zero_total(spark):
    df = spark.createDataFrame([(0.0, 0.0, 0.0, 0.0, 0.0)], "complete_ha double, valid_ha double, no_data_ha double, sealed_ha double, unsealed_ha double")
    assert R.region_surface_stats(df).collect()[0]["sealed_pct"] == 0.0


def test_user_layer(spark):
    data = [.1, .3, .6, None, .2, .4, .8, .7, 0.0, .5, .9, 1.0]
    px = spark.createDataFrame([("Z", v) for v in data], "sector_id string, v double")
    zones = spark.createDataFrame([("Z", 0.12)], "sector_id string, complete_ha double")
    out = Z.user_layer_stats(px, F.col("v"), zones, 0.01).collect()[0]
    assert out["median"] == 0.5 and out["minimum"] == 0.0 and out["maximum"] == 1.0 and out["valid_ha"] == pytest.approx(0.11)
    classes = Z.user_class_stats(px, (F.col("v") >= 0.5).cast("int"), [0, 1], 0.01, zones).collect()
    assert sum(r["area_ha"] for r in classes) == pytest.approx(0.11) and sum(r["pct"] for r in classes) == pytest.approx(100)


def test_land_cover_statistics(spark, rows):
    codes = [10, 10, 90, 90, 10, 30, 90, 100, 40, 40, 30, 30, 254, 40, 30, 0]
    px = spark.createDataFrame([("LEFT" if i % 4 < 2 else "RIGHT", c) for i, c in enumerate(codes)], "sector_id string, code int")
    areas = Z.land_cover_areas(px, F.lit(1.0), ["sector_id"])
    out = rows(Z.land_cover_stats(areas, ["sector_id"]), "sector_id")
    assert 55 < out["LEFT"]["vegetation_pct"] < 60 and out["RIGHT"]["built_up_pct"] > 40 and out["RIGHT"]["dominant_code"] == 30
    assert out["LEFT"]["unclassifiable_ha"] == 1 and out["RIGHT"]["total_ha"] == 8 and out["RIGHT"]["classified_ha"] == 7
    assert Z.unknown_codes(px.union(spark.createDataFrame([("LEFT", 77)], "s string, c int"))).collect()[0]["code"] == 77


def test_vegetation_statistics_reconcile(spark):
    px = spark.createDataFrame([(0, 0, True, .5, 10), (0, 1, True, .05, 10), (0, 2, False, .5, 10), (0, 3, True, .5, 40)], "row_i int, col_i int, valid boolean, ndvi double, cover int")
    combos = spark.createDataFrame([(0, c, "A", u, n) for c, u, n in ((0, "14110", 9), (1, "50000", 4), (1, None, 5), (2, None, 9), (3, "21000", 9))],
                                   "row_i int, col_i int, sector_id string, use string, n int")
    zones = spark.createDataFrame([("A", 400.0)], "sector_id string, exact_m2 double")
    s = Z.vegetation_stats(px, combos, zones, 0.1, 100 / 9).collect()[0]
    assert s["total_ha"] == pytest.approx(0.04) and s["likely_ha"] == pytest.approx(0.01) and s["cropland_ha"] == pytest.approx(0.01)
    assert s["likely_ha"] + s["below_ha"] + s["cropland_ha"] + s["water_ha"] == pytest.approx(s["valid_ha"]) and s["median_ndvi"] == 0.5


def test_every_expected_record_exists(spark, rows):
    px = spark.createDataFrame([("A", 2019, 1, 1, 20.0, .1, 2)], "sector_id string, year int, code int, status int, temp_c double, uncertainty double, w int")
    zones = spark.createDataFrame([("A", 1.0), ("B", 2.0)], "sector_id string, complete_ha double")
    years = {"year": [2019, 2020]}
    out = rows(Z.binary_stats(px, zones, 0.25, keys=("year",), expected=years), "sector_id", "year")
    assert len(out) == 4 and out[("A", 2019)]["sealed_pct"] == 25 and out[("B", 2020)]["no_data_pct"] == 100
    out = rows(Z.categorical_stats(px, zones, [1, 2], 0.25, keys=("year",), expected=years), "sector_id", "year", "code")
    assert len(out) == 8 and out[("B", 2019, 1)]["area_ha"] == 0
    out = rows(Z.temperature_stats(px, zones, 0.25, keys=("year",), expected=years), "sector_id", "year")
    assert out[("A", 2019)]["median_c"] == 20.0 and out[("A", 2019)]["clear_ha"] == 0.5 and out[("A", 2020)]["missing_pct"] == 100 and out[("B", 2019)]["pixel_count"] == 0
    out = rows(Z.user_layer_stats(px, F.col("temp_c"), zones, 0.25, keys=("year",), expected=years), "sector_id", "year")
    assert out[("A", 2019)]["mean"] == 20.0 and out[("B", 2020)]["valid_ha"] == 0.0 and out[("B", 2020)]["mean"] is None
    assert Z.binary_stats(px, zones, 0.25, keys=("year",)).count() == 2  # every zone, in every year that occurs


def test_unweighted_density_median(spark):
    px = spark.createDataFrame([(1, v) for v in (0, 25, 50, 100, 255)], "sector_id int, value int")
    zones = spark.createDataFrame([(1, 1.0), (2, 1.0)], "sector_id int, complete_ha double")
    got = {r.sector_id: r for r in Z.density_stats(px, zones, 0.2, weight=None).collect()}
    assert got[1].median_density == 37.5 and got[1].mean_density == 43.75 and got[2].valid_ha == 0 and got[2].no_data_pct == 100


def test_rounding_leaves_what_is_not_finite(spark):
    from zonemill.functions.numbers import half_up
    from zonemill.plans.registry import present
    values = [float("nan"), float("inf"), 3e13, 0.123456499, -2.5, None]
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double")
    got = [r.v for r in present(rows).orderBy("i").collect()]
    assert str(got[0]) == "nan" and got[1:] == [float("inf"), 3e13, 0.123456, -2.5, None]
    assert str(rows.where("i = 0").select(half_up(F.col("v"), 2)).first()[0]) == "nan"


def test_too_few_samples_are_an_error(spark):
    rows = spark.createDataFrame([("positive", 0.5)] * 3 + [("negative", 0.1)] * 2, "sample string, ndvi double")
    assert Z.calibrate_threshold(rows, minimum=2).first().n_neg == 2
    with pytest.raises(Exception, match="fewer than 3 samples"):
        Z.calibrate_threshold(rows, minimum=3).collect()
    with pytest.raises(Exception, match="fewer than 1000 samples"):
        Z.calibrate_threshold(rows).collect()


@pytest.mark.parametrize("block", [1, 3, 10, 10_000])
def test_timeline_blocks_carry_the_last_observation(spark, block):
    import random
    rng = random.Random(2)
    rows = [(s, p, rng.randrange(40), 100.0) for s in ("a", "b", None) for p in rng.sample(range(0, 400, 3), 60)]
    df = spark.createDataFrame(rows, "series string, position long, acquired_at long, coverage_pct double").repartition(8, "position")
    want = set()
    for s in ("a", "b", None):
        part = sorted((p, t) for x, p, t, _ in rows if x == s)
        for (_, before), (p, t) in zip(part, part[1:]):
            if before >= t:
                want.add((s, p, "repeated" if before == t else "out-of-order"))
    assert {tuple(r) for r in SC.check_timeline(df, 50.0, block=block).collect()} == want
