"""Weighted zone figures without a row per pixel and zone."""

from __future__ import annotations

import math
import re

import pytest
from pyspark.sql import functions as F

from zonemill.operators import covered as CO
from zonemill.operators import zonal as Z


@pytest.fixture()
def tables(spark):
    px = [(o, r, c, float(((o or 5) * 31 + r * 17 + c * 7) % 128), (r + c + (o or 5)) % 3, 5.0 + (r * c + (o or 5)) % 11 / 4) for o in (1, 2, None) for r in range(40) for c in range(40) if (r * c + (o or 0)) % 7]
    px += [(1, 3, 3, 50.0, 1, 9.0), (1, 3, 3, 0.0, 1, math.nan), (2, None, 4, 9.0, 1, 1.0), (3, 39, 39, 20.0, 0, 2.0)]
    px = spark.createDataFrame(px, "obs_id long, row_i long, col_i long, value double, status int, temp_c double").withColumn("uncertainty", F.col("value") * 0.5)
    weights = [(z, r, c, 1 + (r * c + z) % 100) for z in range(6) for r in range(3 * z, 3 * z + 2 + z) for c in range(2 * z, 2 * z + 3)]
    weights += [(7, r, c, 40) for r in range(38) for c in range(35)]  # more cells than are kept as a list
    weights = spark.createDataFrame(weights, "poly_id long, row_i long, col_i long, w long")
    zones = spark.createDataFrame([(z, 1.0 + (z or 0)) for z in [*range(9), 2, None]], "poly_id long, complete_ha double")
    return px, weights, zones


def _rows(df):
    return sorted(str(tuple(v if v is None else round(float(v), 9) for v in r)) for r in df.collect())


@pytest.mark.parametrize("name", ["density", "temperature"])
@pytest.mark.parametrize("listed", [False, True])
def test_weights_apart_give_the_rows_of_the_join(spark, tables, name, listed):
    px, weights, zones = tables
    expected = spark.createDataFrame([(1,), (4,), (None,), (1,)], "obs_id long") if listed else None
    stats = Z.density_stats if name == "density" else Z.temperature_stats
    joined = stats(Z.with_weights(px, weights), zones, 0.0025, zone="poly_id", keys=("obs_id",), expected=expected)
    apart = stats(px, zones, 0.0025, zone="poly_id", keys=("obs_id",), expected=expected, weights=weights)
    assert apart.columns == joined.columns and [f.dataType for f in apart.schema] == [f.dataType for f in joined.schema]
    assert _rows(apart) == _rows(joined)


@pytest.mark.parametrize("name", ["a03_density_stats", "a04_temperature_stats", "q01_density_rules"])
def test_no_row_per_pixel_and_zone(spark, name):
    """Before, every pixel met every diamond over it ahead of an exchange: 750 rows per pixel at sixty times the tables."""
    import __spark_entry__ as entrypoint
    df = entrypoint.queries()[name](spark, "/root/testdata/sf0.001")
    assert "FlatMapCoGroupsInArrow" in df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["density", "temperature"])
def test_tables_made_of_weights_are_not_broadcast(tables, name):
    """Before, the size of the zones' table decided, and lists of all cells went through the driver."""
    px, weights, zones = tables
    stats = Z.density_stats if name == "density" else Z.temperature_stats
    df = stats(px, zones, 0.0025, zone="poly_id", keys=("obs_id",), weights=weights)
    df.collect()
    final = re.sub(r"#\d+L?", "", df._jdf.queryExecution().executedPlan().toString()).split("Initial Plan")
    for plan in final:
        joins = re.findall(r"BroadcastHashJoin \[([^]]*)\], \[([^]]*)\], (\w+)", plan)
        assert not {right for _, right, _ in joins} & {"cell", "key"} and not {kind for _, right, kind in joins if right == "poly_id"} & {"LeftOuter", "LeftAnti", "LeftSemi"}
    assert "SortMergeJoin [at], [cell]" in final[0]


def test_zones_of_many_cells_are_not_listed(tables):
    few, more = CO.split_zones(tables[1], "poly_id")
    assert sorted(r.poly_id for r in few.collect()) == list(range(6))
    assert {r.poly_id for r in more.collect()} == {7}
