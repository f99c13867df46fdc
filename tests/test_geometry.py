"""Rasterisation, point location and overlay against brute force on irregular polygons."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from zonemill.functions import space as S
from zonemill.model import MULTIPOLYGON, Grid
from zonemill.operators import geometry as GE
from zonemill.operators import zonal as Z

SCHEMA = "id int, geom " + MULTIPOLYGON.simpleString()


def star(cx, cy, radii, turn=0.0):
    n = len(radii)
    ring = [(cx + r * math.cos(2 * math.pi * i / n + turn), cy + r * math.sin(2 * math.pi * i / n + turn)) for i, r in enumerate(radii)]
    return ring + ring[:1]


def box(x0, y0, x1, y1):
    return [(x0, y0), (x1, y0), (x1, y1), (x0, y1), (x0, y0)]


def inside(x, y, polygon):
    hit = False
    for ring in polygon:
        for (x1, y1), (x2, y2) in zip(ring, ring[1:]):
            if (y1 > y) != (y2 > y) and x < (x2 - x1) * (y - y1) / (y2 - y1) + x1:
                hit = not hit
    return hit


SHAPES = {
    1: [[star(20.3, 18.7, [12, 5, 11.2, 4.4, 13, 6.1, 10]), star(20.1, 18.2, [2.2, 1.7, 2.4, 1.9])]],
    2: [[box(3.25, 30.1, 9.75, 38.6)], [star(30, 33, [5, 2, 6, 2.5, 5.5], .3)]],
    3: [[list(reversed(star(12, 12, [9, 8, 7, 9, 6])))]],
    4: [[box(-5, -5, 60, 4.4)]],
}


@pytest.fixture(scope="module")
def polys(spark):
    return spark.createDataFrame([(i, [[[{"x": float(x), "y": float(y)} for x, y in ring] for ring in poly] for poly in shape])
                                  for i, shape in SHAPES.items()], SCHEMA)


@pytest.mark.parametrize("grid", [Grid(0, 0, 1, 1, 40, 40), Grid(0, 40, 1, -1, 40, 40), Grid(1.3, 39.2, .7, -.9, 50, 41)])
def test_rasterize(polys, grid):
    got = {(r["id"], r["row_i"], r["col_i"]) for r in GE.span_cells(GE.rasterize(polys, ["id"], grid)).collect()}
    want = {(i, r, c) for i, shape in SHAPES.items() for r in range(grid.height) for c in range(grid.width)
            if any(inside(grid.x0 + (c + .5) * grid.dx, grid.y0 + (r + .5) * grid.dy, p) for p in shape)}
    assert got == want


def test_fractional_weights(polys):
    grid, s = Grid(0, 40, 1, -1, 40, 40), 4
    fine = grid.scaled(s)
    got = {(r["id"], r["row_i"], r["col_i"]): r["w"] for r in GE.fractional_weights(polys, ["id"], grid, s).collect()}
    want = {}
    for r in GE.span_cells(GE.rasterize(polys, ["id"], grid, s)).collect():
        key = (r["id"], r["row_i"] // s, r["col_i"] // s)
        want[key] = want.get(key, 0) + 1
    assert got == want and max(got.values()) == s * s and fine.width == 160


def test_two_rectangles_share_a_grid(spark):
    rect = [(1, 4.0, 4.02), (2, 4.02, 4.04)]
    df = spark.createDataFrame([(i, [[[{"x": float(x), "y": float(y)} for x, y in box(a, 50.0, b, 50.04)]]]) for i, a, b in rect], SCHEMA)
    spans = GE.rasterize(df, ["id"], Grid(4.0, 50.04, .01, -.01, 4, 4))
    counts = {r["id"]: r["n"] for r in GE.span_cells(spans).groupBy("id").agg(F.count("*").alias("n")).collect()}
    assert counts == {1: 8, 2: 8}


def test_points_in_polygons(spark, polys):
    rng = np.random.default_rng(3)
    pts = [(i, float(x), float(y)) for i, (x, y) in enumerate(rng.uniform(-2, 42, (3000, 2)))]
    df = spark.createDataFrame(pts, "p int, x double, y double")
    got = {(r["p"], r["id"]) for r in GE.points_in_polygons(df, polys, "id", 3.0).collect()}
    want = {(p, i) for p, x, y in pts for i, shape in SHAPES.items() if any(inside(x, y, poly) for poly in shape)}
    assert got == want


def test_assign_zone_equals_cells(spark, polys):
    grid = Grid(0, 0, 1, 1, 40, 40)
    px = GE.grid_cells(spark, grid)
    spans = GE.rasterize(polys, ["id"], grid)
    got = {tuple(r) for r in Z.assign_zone(px, spans, block=7).select("id", "row_i", "col_i").collect()}
    last = {}
    for r in GE.span_cells(spans).collect():
        last[r.row_i, r.col_i] = max(r.id, last.get((r.row_i, r.col_i), r.id))
    assert got == {(i, *cell) for cell, i in last.items()}


def geoms(spark, shapes, key):
    return spark.createDataFrame([(i, [[[{"x": float(x), "y": float(y)} for x, y in ring] for ring in poly] for poly in shape])
                                  for i, shape in shapes.items()], SCHEMA.replace("id int", f"{key} int"))


def test_overlay_exact_cases(spark):
    a = geoms(spark, {1: [[box(0, 0, 2, 2)]], 2: [[[(1, 0), (2, 1), (1, 2), (0, 1), (1, 0)]]], 3: [[box(0, 0, 4, 4), box(1, 1, 3, 3)]], 4: [[box(50, 50, 51, 51)]]}, "a")
    b = geoms(spark, {1: [[box(1, 1, 3, 3)]], 2: [[box(0, 0, 2, 2)]], 3: [[box(-1, -1, 5, 5)]]}, "b")
    got = {(r["a"], r["b"]): r["area"] for r in GE.overlay_area(a, b, "a", "b", 1.5, 0.75).collect()}
    want = {(1, 1): 1, (1, 2): 4, (1, 3): 4, (2, 1): .5, (2, 2): 2, (2, 3): 2, (3, 2): 3, (3, 3): 12}
    assert set(got) == set(want) and all(got[k] == pytest.approx(v) for k, v in want.items())


def test_overlay_parts_add_up(spark, polys):
    cells = geoms(spark, {k: [[box(10 * (k % 8) - 10, 10 * (k // 8) - 10, 10 * (k % 8), 10 * (k // 8))]] for k in range(64)}, "cell")
    area = {r["id"]: r["a"] for r in polys.select("id", GE.polygon_area(F.col("geom")).alias("a")).collect()}
    parts = GE.overlay_area(polys, cells, "id", "cell", 6.0, 2.5).groupBy("id").agg(F.sum("area").alias("s")).collect()
    assert all(r["s"] == pytest.approx(area[r["id"]], rel=1e-9) for r in parts) and len(parts) == 4
    same = GE.overlay_area(polys, polys.select(F.col("id").alias("other"), "geom"), "id", "other", 6.0).where("id = other").collect()
    assert all(r["area"] == pytest.approx(area[r["id"]], rel=1e-9) for r in same)


def test_normalise_and_subset(spark):
    raw = geoms(spark, {1: [[box(0, 0, 20, 20)[:-1], box(2, 2, 4, 4), box(15, 15, 17, 17), [(1, 1), (2, 2)]], [[(0, 0), (1, 1)]]]}, "id")
    clean = raw.select(GE.normalise_geom(F.col("geom")).alias("g"))
    r = clean.select(F.size("g").alias("n"), F.size(F.col("g")[0]).alias("rings"), GE.count_vertices(F.col("g")).alias("v"), GE.polygon_area(F.col("g")).alias("a"),
                     F.size(GE.subset_rings(F.col("g"), 1.0, 1.0, 5.0, 5.0)[0]).alias("kept")).collect()[0]
    assert (r["n"], r["rings"], r["v"], r["a"], r["kept"]) == (1, 3, 15, 392.0, 2)


def test_votes_and_majority(spark):
    def majority(counts, at_least):
        votes = spark.createDataFrame([(0, 0, v, n) for v, n in counts.items() if v], "row_i int, col_i int, v int, votes int")
        return GE.unique_majority(votes, "v", at_least).collect()[0]["v"]
    assert [majority(c, 18) for c in ({10: 18, 20: 17, 0: 1}, {10: 18, 20: 18}, {10: 17, 20: 10, 0: 9}, {10: 19, 20: 17})] == [10, 0, 0, 10]
    square = geoms(spark, {7: [[box(0, 0, 10, 10)]]}, "id").withColumn("v", F.col("id"))
    votes = GE.subpixel_votes(GE.last_feature(square, Grid(0, 10, 10, -10, 1, 1), 3, "v", "id"), 3, "v")
    assert [tuple(r) for r in votes.collect()] == [(0, 0, 7, 9)]
    ties = spark.createDataFrame([(0, 0, 9, 4), (0, 0, 5, 4), (0, 0, 2, 1)], "row_i int, col_i int, v int, votes int")
    assert GE.dominant_subpixel(ties, "v").collect()[0]["v"] == 5


def test_projections(spark):
    # Independently known coordinates of the projection origins and a point in Brussels.
    df = spark.createDataFrame([(10.0, 52.0), (3.0, 0.0), (4 + 21 / 60 + 33.177 / 3600, 50 + 47 / 60 + 52.134 / 3600), (4.35, 50.85)], "lon double, lat double")
    ex, ey = S.equal_area_europe(F.col("lon"), F.col("lat"))
    ux, uy = S.utm(F.col("lon"), F.col("lat"), 31)
    bx, by = S.lambert_belgium(F.col("lon"), F.col("lat"))
    r = df.select(ex.alias("ex"), ey.alias("ey"), ux.alias("ux"), uy.alias("uy"), bx.alias("bx"), by.alias("by")).collect()
    assert (r[0]["ex"], r[0]["ey"]) == pytest.approx((4321000.0, 3210000.0), abs=1e-3)
    assert (r[1]["ux"], r[1]["uy"]) == pytest.approx((500000.0, 0.0), abs=1e-3)
    assert (r[2]["bx"], r[2]["by"]) == pytest.approx((649328.0, 665262.0), abs=1e-2)
    assert r[3]["ux"] == pytest.approx(595045, abs=200) and r[3]["uy"] == pytest.approx(5634000, abs=500)


def test_project_geom_keeps_vertices(polys):
    moved = polys.withColumn("geom", GE.project_geom(F.col("geom"), lambda x, y: (x / 100 + 4, y / 100 + 50)))
    from zonemill.operators import quality as QU
    assert QU.vertex_violations(polys, moved, "id", (3.0, 49.0, 5.0, 51.0)).count() == 0


def test_missing_rectangles(spark):
    one = spark.range(1)
    lit = lambda *v: [F.lit(float(x)) for x in v]
    got = one.select(F.inline(GE.missing_rectangles(lit(2, 2, 8, 8), lit(0, 0, 10, 10)))).collect()
    assert {tuple(r) for r in got} == {("above", 0, 8, 10, 10), ("below", 0, 0, 10, 2), ("left", 0, 2, 2, 8), ("right", 8, 2, 10, 8)}
    assert one.select(F.inline(GE.missing_rectangles(lit(0, 0, 10, 10), lit(1, 1, 2, 2)))).count() == 0


def test_each_cell_belongs_to_one_feature(spark):
    """Two rectangles that share a border through cell centres cover 16 cells once, as two features and as one of two parts."""
    grid = Grid(0.0, 0.0, 1.0, 1.0, 4, 4)
    def box(a, b):
        return [[(a, 0.0), (b, 0.0), (b, 4.0), (a, 4.0), (a, 0.0)]]
    two = spark.createDataFrame([(1, [box(0.0, 1.5)]), (2, [box(1.5, 4.0)])], "k int, geom array<array<array<struct<x:double,y:double>>>>")
    one = spark.createDataFrame([(1, [box(0.0, 1.5), box(1.5, 4.0)])], two.schema)
    for zones in (two, one):
        spans = GE.rasterize(zones, ["k"], grid)
        cells = GE.scope_index(zones, grid, ["k"]).collect()
        assert len(cells) == 16 and len({(c.row_i, c.col_i) for c in cells}) == 16
        px = spark.range(16).selectExpr("cast(floor(id / 4) as bigint) row_i", "id % 4 col_i")
        assert Z.assign_zone(px, spans).count() == 16
    assert {c.k for c in GE.scope_index(two, grid, ["k"]).where("col_i = 1").collect()} == {2}
    assert GE.span_cells(GE.rasterize(one, ["k"], grid)).count() == 16
    weights = GE.fractional_weights(one, ["k"], grid, 2).collect()
    assert sum(w.w for w in weights) == 64 and max(w.w for w in weights) == 4


def test_cells_hold_their_own_edges_only(spark):
    """A polygon of 4 000 edges over about 1 000 cells: entries grow with edges plus cells, and points on its vertices' heights are right."""
    ring = star(50, 50, [45 + 3 * math.sin(0.37 * i) for i in range(4000)], .01)
    df = geoms(spark, {1: [[ring, list(reversed(star(50, 50, [20 + (i % 7) for i in range(300)])))]]}, "id")
    cells = GE.polygon_cells(df, "id", 3.0)
    n, stored = cells.agg(F.count("*"), F.sum(F.size("cell_edges") + F.size("turns") + 1)).first()
    assert n < 1200 and stored < 3 * (4300 + n)
    rng = np.random.default_rng(3)
    spots = [(float(a), float(b)) for a, b in rng.uniform(0, 100, (1500, 2))] + [(float(a), y) for a, (_, y) in zip(rng.uniform(0, 100, 200), ring[::20])] + ring[::50] + [(3.0 * i, 3.0 * j) for i in range(34) for j in range(34)]
    points = spark.createDataFrame([(i, x, y) for i, (x, y) in enumerate(spots)], "p int, x double, y double")
    got = {r["p"] for r in GE.points_in_polygons(points, df, "id", 3.0).collect()}
    shape = [ring, list(reversed(star(50, 50, [20 + (i % 7) for i in range(300)])))]
    assert got == {i for i, (x, y) in enumerate(spots) if inside(x, y, shape)}


@pytest.mark.parametrize("block", [2, 5, 64])
def test_stretches_vote_like_sub_cells(polys, block):
    grid = Grid(0, 0, 1, 1, 41, 41)
    shapes = polys.withColumn("v", F.col("id") % 3)
    stretches = GE.last_intervals(shapes, grid, 3, "v", "id", block)
    want = {(r["sub_row"], r["sub_col"]): r["v"] for r in GE.last_feature(shapes, grid, 3, "v", "id").collect()}
    got = {}
    for r in stretches.collect():
        for c in range(r["c0"], r["c1"] + 1):
            assert (r["row_i"], c) not in got
            got[(r["row_i"], c)] = r["v"]
    assert got == want
    votes = [{tuple(r) for r in df.select("row_i", "col_i", "v", "votes").collect()} for df in (
        GE.interval_votes(stretches, 3, "v"), GE.subpixel_votes(GE.last_feature(shapes, grid, 3, "v", "id"), 3, "v"))]
    assert votes[0] == votes[1]


def test_points_meet_few_polygons_they_are_not_in(spark):
    """Before, a cell as large as the polygons brought every polygon of the neighbourhood to every point."""
    shapes = [(i, [[[(3.0 * i + x, float(y)) for x, y in ((2, 0), (4, 2), (2, 4), (0, 2), (2, 0))]]]) for i in range(4)]
    polys = spark.createDataFrame(shapes, "id int, geom array<array<array<struct<x:double,y:double>>>>")
    points = spark.createDataFrame([(40 * r + c, c * 0.35 + 0.0137, r * 0.11) for r in range(40) for c in range(40)], "p int, x double, y double")
    got = {(r["p"], r["id"]) for r in GE.points_in_polygons(points, polys, "id", 4.0).collect()}
    assert got == {(p, i) for p, x, y in points.collect() for i in range(4) if abs(x - 3 * i - 2) + abs(y - 2) < 2}

    def met(cell):
        cells = GE.polygon_cells(polys, "id", cell)
        return points.withColumn("cx", F.floor(F.col("x") / cell)).withColumn("cy", F.floor(F.col("y") / cell)).join(cells, ["cx", "cy"]).count()
    assert len(got) < met(4.0 / GE.FINER) < met(4.0) * 3 / 4


def test_points_and_cells_keep_their_partitions(spark):
    polys = spark.createDataFrame([(1, [[[(0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (0.0, 0.0)]]])], "id int, geom array<array<array<struct<x:double,y:double>>>>")
    points = spark.createDataFrame([(1, 3.0, 1.0), (2, None, 1.0), (3, 1.0, 3.0)], "p int, x double, y double")
    found = GE.points_in_polygons(points, polys, "id", 2.0)
    assert [r["p"] for r in found.collect()] == [1]
    assert "REPARTITION_BY_NUM" in found._jdf.queryExecution().executedPlan().toString()


def test_cells_of_polygons_are_broadcast_by_their_real_size(spark):
    """Before, the size of the polygon table decided: sixty times the given tables sent 3 million cells through the driver."""
    i = F.col("id") % 20 * 4.0
    corner = [F.struct((i + x).alias("x"), (F.floor(F.col("id") / 20) * 4.0 + y).alias("y")) for x, y in ((3, 0), (6, 3), (3, 6), (0, 3), (3, 0))]
    polys = spark.range(400).select("id", F.array(F.array(F.array(*corner))).alias("geom"))
    points = spark.range(10000).select(F.col("id").alias("p"), (F.col("id") % 100 * 0.8713 + 0.0137).alias("x"), (F.floor(F.col("id") / 100) * 0.8319 + 0.0071).alias("y"))
    want = {(p, 20 * b + a) for p, x, y in points.collect() for a in range(20) for b in range(20) if abs(x - 4 * a - 3) + abs(y - 4 * b - 3) < 3}
    for limit, joined in (("200000", "SortMergeJoin"), ("100000000", "BroadcastHashJoin")):
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
        try:
            found = GE.points_in_polygons(points, polys, "id", 2.0)
            assert "BroadcastHashJoin" in found._jdf.queryExecution().executedPlan().toString()  # as planned ahead of the run
            assert sorted((r["p"], r["id"]) for r in found.collect()) == sorted(want)
            assert joined in found._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
        finally:
            spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
