"""The same results when no join side is broadcast."""

from __future__ import annotations

import pytest

import __spark_entry__ as entrypoint

FOLDER = "/root/testdata/sf0.001"
NAMES = ["a01_categorical_stats", "a03_density_stats", "a12_vegetation_stats", "a13_overlap_counts", "a18_user_layer_stats", "a27_calibration_samples", "g06_series_by_majority",
         "g18_mask_to_municipality", "g19_vegetation_mask", "j08_points_in_polygons", "w04_weighted_percentile"]


@pytest.mark.parametrize("name", NAMES)
def test_sort_merge_gives_the_same_rows(spark, name):
    usual = sorted(map(str, entrypoint.queries()[name](spark, FOLDER).collect()))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = entrypoint.queries()[name](spark, FOLDER)
        assert sorted(map(str, df.collect())) == usual
        assert "SortMergeJoin" in df._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
