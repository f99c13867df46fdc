"""Clipped fragments: areas, membership of points, holes and parts."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from test_geometry import SCHEMA, SHAPES, box, inside, star
from zonemill.operators import fragments as FR
from zonemill.operators import geometry as GE

OTHERS = {
    1: [[box(0, 0, 22, 21)], [box(25.5, 10, 40, 30)]],
    2: [[box(2, 2, 38, 38), list(reversed(star(20, 19, [8, 3, 7, 2.5, 9])))]],
    3: [[star(14, 20, [14, 6, 15, 5, 13, 7, 12.5], .4), star(14, 20, [2, 2.4, 1.9], .1)], [box(29.5, 30.1, 38, 38.6)]],
    4: [[box(60, 60, 70, 70)]],
    5: [[box(0, 4.4, 60, 9)]],  # shares a border with shape 4, no area
}


def frame(spark, shapes, key):
    rows = [(i, [[[{"x": float(x), "y": float(y)} for x, y in ring] for ring in poly] for poly in shape]) for i, shape in shapes.items()]
    return spark.createDataFrame(rows, SCHEMA).withColumnRenamed("id", key)


@pytest.mark.parametrize("cell, strip", [(8.0, 3.0), (50.0, None), (2.5, 1.25)])
def test_fragments_are_the_common_parts(spark, cell, strip):
    a, b = frame(spark, SHAPES, "a"), frame(spark, OTHERS, "b")
    got = FR.overlay_fragments(a, b, "a", "b", cell, strip).withColumn("whole", GE.polygon_area(F.col("geom"))).collect()
    areas = {(r.a, r.b): r.area for r in GE.overlay_area(a, b, "a", "b", cell, strip).collect()}
    assert {(r.a, r.b) for r in got} == set(areas)
    rng = random.Random(1)
    for r in got:
        assert r.whole == pytest.approx(areas[(r.a, r.b)], abs=1e-6) == pytest.approx(r.area, abs=1e-6)
        shape = [[[(p.x, p.y) for p in ring] for ring in polygon] for polygon in r.geom]
        assert all(ring[0] == ring[-1] and len(ring) > 3 for polygon in shape for ring in polygon)
        assert all(FR._area(polygon[0]) > 0 and all(FR._area(h) < 0 for h in polygon[1:]) for polygon in shape)
        for _ in range(1500):
            x, y = rng.uniform(-6, 45), rng.uniform(-6, 45)
            want = any(inside(x, y, p) for p in SHAPES[r.a]) and any(inside(x, y, p) for p in OTHERS[r.b])
            assert any(inside(x, y, p) for p in shape) == want, (r.a, r.b, x, y)
    assert max(len(polygon) for r in got for polygon in r.geom) > 1 and max(len(r.geom) for r in got) > 1


def test_vertices_stay_few(spark):
    big, small = {1: [[box(0, 0, 100, 100)]]}, {1: [[box(10, 10, 90, 90), box(40, 40, 60, 60)]]}
    r = FR.overlay_fragments(frame(spark, big, "a"), frame(spark, small, "b"), "a", "b", 30.0, 7.0).collect()
    assert [[len(ring) for ring in polygon] for polygon in r[0].geom] == [[5, 5]] and r[0].area == pytest.approx(6000)


def test_none_meet(spark):
    a, b = frame(spark, {1: OTHERS[4]}, "a"), frame(spark, {1: SHAPES[1]}, "b")
    assert FR.overlay_fragments(a, b, "a", "b", 8.0).count() == 0
