"""Focal sums, resampling and tiles against brute force."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from zonemill.functions.space import from_utm, mercator_grid, utm
from zonemill.model import Grid
from zonemill.operators import raster as RA


def plane(spark, arrays):
    names = list(arrays)
    h, w = arrays[names[0]].shape
    data = [(0, r, c, *[float(arrays[n][r, c]) for n in names]) for r in range(h) for c in range(w)]
    return spark.createDataFrame(data, "obs_id long, row_i long, col_i long, " + ", ".join(f"{n} double" for n in names))


def test_kernel_area():
    k = RA.circular_kernel(100, 10, 40)
    assert k.shape == (21, 21) and k.sum() * 100 == pytest.approx(math.pi * 100**2, rel=0.002) and (k == k.T).all()


def test_focal_small_case(spark):
    ones = np.ones((7, 7))
    df = plane(spark, {"f_1": ones * .5, "f_2": ones * .25, "f_3": ones * .25, "valid": ones})
    out = {(r["row_i"], r["col_i"]): r for r in RA.focal_density(df, [1, 2, 3], np.ones((3, 3))).collect()}
    c = out[(3, 3)]
    assert (c["pct_1"], c["pct_2"], c["pct_3"], c["coverage_pct"]) == pytest.approx((50, 25, 25, 100)) and out[(0, 0)]["pct_1"] is None
    low = RA.focal_density(plane(spark, {"f_1": ones * .5, "valid": ones * .94}), [1], np.ones((1, 1))).collect()
    assert all(r["pct_1"] is None and r["coverage_pct"] is None for r in low)


@pytest.mark.parametrize("tile", [5, 8, 64])
def test_focal_is_independent_of_tiles(spark, tile):
    rng = np.random.default_rng(1)
    f, v = rng.random((23, 31)), np.ones((23, 31))
    k = RA.circular_kernel(30, 10, 6)
    padded = np.pad(f, 3)
    want = sum(k[a, b] * padded[a:a + 23, b:b + 31] for a in range(7) for b in range(7)) / k.sum() * 100
    out = RA.focal_density(plane(spark, {"f_1": f, "valid": v}), [1], k, tile=tile, threshold=0.0).collect()
    assert len(out) == 23 * 31
    assert max(abs(r["pct_1"] - want[r["row_i"], r["col_i"]]) for r in out) < 1e-9


def test_nearest_identity_and_shift(spark):
    a = np.arange(16.0).reshape(4, 4)
    df = plane(spark, {"v": a})
    g = Grid(4.0, 50.04, .01, -.01, 4, 4)
    same = {(r["row_i"], r["col_i"]): r["v"] for r in RA.resample_nearest(df, g, g).collect()}
    assert all(same[(r, c)] == a[r, c] for r in range(4) for c in range(4)) and len(same) == 16
    dst = Grid(4.005, 50.035, .004, -.004, 5, 5)
    got = {(r["row_i"], r["col_i"]): r["v"] for r in RA.resample_nearest(df, g, dst).collect()}
    for i in range(5):
        for j in range(5):
            r, c = math.floor((dst.y0 + (i + .5) * dst.dy - g.y0) / g.dy), math.floor((dst.x0 + (j + .5) * dst.dx - g.x0) / g.dx)
            assert got[(i, j)] == a[r, c]


def test_average_conserves_the_total(spark):
    rng = np.random.default_rng(2)
    a = rng.random((12, 9))
    src, dst = Grid(0, 12, 1, -1, 9, 12), Grid(-.5, 12.7, 1.7, -1.7, 7, 9)
    out = RA.resample_average(plane(spark, {"v": a}), src, dst, "v", ("obs_id",)).collect()
    assert sum(r["v"] * r["coverage"] for r in out) * 1.7 * 1.7 == pytest.approx(a.sum())
    block = RA.resample_average(plane(spark, {"v": a}), src, src.coarsened(3), "v", ("obs_id",)).collect()
    assert all(r["v"] == pytest.approx(a[3 * r["row_i"]:3 * r["row_i"] + 3, 3 * r["col_i"]:3 * r["col_i"] + 3].mean()) for r in block)


def test_bilinear_reproduces_a_slope_and_skips_gaps(spark):
    r, c = np.mgrid[0:10, 0:10]
    df = plane(spark, {"v": 3 * (c + .5) - 2 * (r + .5)})
    src, dst = Grid(0, 0, 1, 1, 10, 10), Grid(1, 1, .4, .4, 20, 20)
    out = RA.resample_bilinear(df, src, dst, "v", ("obs_id",)).collect()
    assert len(out) == 400
    assert all(x["v"] == pytest.approx(3 * (1 + (x["col_i"] + .5) * .4) - 2 * (1 + (x["row_i"] + .5) * .4)) for x in out)
    lone = RA.resample_bilinear(df.where("row_i = 5 AND col_i = 5"), src, dst, "v", ("obs_id",)).collect()
    assert {round(x["v"], 9) for x in lone} == {5.5}


def test_tiles_round_trip(spark):
    a = np.arange(7 * 11.0).reshape(7, 11)
    df = plane(spark, {"v": a})
    tiles = RA.assemble_tiles(df, 4, "v")
    assert tiles.count() == 6
    back = {(r["row_i"], r["col_i"]): r["v"] for r in RA.explode_tiles(tiles, 4, "v").collect()}
    assert all(back[(r, c)] == a[r, c] for r in range(7) for c in range(11))
    dense = spark.createDataFrame([(0, 0, 1, [1, 2, 3, 4])], "obs_id int, tile_row int, tile_col int, payload array<int>")
    cells = {(r["row_i"], r["col_i"]): r["v"] for r in RA.explode_dense_tiles(dense, 2, 3, 5).collect()}
    assert cells == {(0, 2): 1, (1, 2): 3}


def test_fraction_grid(spark):
    df = plane(spark, {"v": np.array([[1, 1, 2, 0], [1, 0, 2, 2]])}).withColumn("code", F.col("v").cast("int"))
    out = {r["col_i"]: r for r in RA.fraction_grid(df, [1, 2], 2).collect()}
    assert (out[0]["f_1"], out[0]["f_2"], out[0]["valid"]) == (.75, 0, .75) and (out[1]["f_2"], out[1]["valid"]) == (.75, .75)


def test_mercator_grid():
    g = mercator_grid(4.0, 50.0, 4.04, 50.04, 10.0)
    assert abs(g.dx * math.cos(math.radians(50.02)) - 10) < 0.05 and g.width == 287 and g.height > 400


def utm_number(lon, lat):
    """Transverse Mercator by the series in the third flattening, in plain numbers."""
    f = 1 / 298.257222101
    n = f / (2 - f)
    a = 6378137.0 / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    alpha = [n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16, 13 * n**2 / 48 - 3 * n**3 / 5, 61 * n**3 / 240]
    e = math.sqrt(f * (2 - f))
    phi, lam = math.radians(lat), math.radians(lon - 3)
    t = math.sinh(math.atanh(math.sin(phi)) - e * math.atanh(e * math.sin(phi)))
    xi, eta = math.atan2(t, math.cos(lam)), math.atanh(math.sin(lam) / math.sqrt(1 + t * t))
    x = eta + sum(c * math.cos(2 * (j + 1) * xi) * math.sinh(2 * (j + 1) * eta) for j, c in enumerate(alpha))
    y = xi + sum(c * math.sin(2 * (j + 1) * xi) * math.cosh(2 * (j + 1) * eta) for j, c in enumerate(alpha))
    return 500000 + 0.9996 * a * x, 0.9996 * a * y


DEGREES = Grid(4.2, 50.9, 0.004, -0.003, 12, 10, "EPSG:4326")
CORNER = utm_number(4.21, 50.885)
METRES = Grid(CORNER[0] - 1000, CORNER[1] + 1500, 310.0, -290.0, 14, 13, "EPSG:32631")


def clipped_area(quad, x0, y0):
    """Part of a convex quadrilateral inside a unit cell, half-plane by half-plane."""
    for axis, limit, sign in ((0, x0, 1), (0, x0 + 1, -1), (1, y0, 1), (1, y0 + 1, -1)):
        out = []
        for p, q in zip(quad, [*quad[1:], *quad[:1]]):
            a, b = sign * (p[axis] - limit), sign * (q[axis] - limit)
            if a >= 0:
                out.append(p)
            if a * b < 0:
                t = a / (a - b)
                out.append((p[0] + t * (q[0] - p[0]), p[1] + t * (q[1] - p[1])))
        quad = out
        if not quad:
            return 0.0
    return abs(sum(p[0] * q[1] - q[0] * p[1] for p, q in zip(quad, [*quad[1:], *quad[:1]]))) / 2


@pytest.fixture(scope="module")
def degrees(spark):
    rng = np.random.default_rng(9)
    values = rng.uniform(0, 10, (10, 12))
    values[2, 3:6] = np.nan
    df = plane(spark, {"v": values}).withColumn("v", F.nanvl("v", F.lit(None).cast("double")))
    return values, df


def test_average_through_a_projection(degrees):
    values, df = degrees
    got = {(r["row_i"], r["col_i"]): r for r in RA.resample_average(df, DEGREES, METRES, "v", ("obs_id",), lambda x, y: utm(x, y, 31)).collect()}
    weight, total = np.zeros((13, 14)), np.zeros((13, 14))
    for r in range(10):
        for c in range(12):
            quad = []
            for dr, dc in ((0, 0), (0, 1), (1, 1), (1, 0)):
                x, y = utm_number(4.2 + (c + dc) * 0.004, 50.9 - (r + dr) * 0.003)
                quad.append(((x - METRES.x0) / METRES.dx, (y - METRES.y0) / METRES.dy))
            for i in range(13):
                for j in range(14):
                    if not np.isnan(values[r, c]) and (w := clipped_area(quad, j, i)) > 0:
                        weight[i, j] += w
                        total[i, j] += w * values[r, c]
    assert set(got) == {(i, j) for i, j in zip(*np.nonzero(weight > 1e-9))}
    for (i, j), r in got.items():
        assert r["coverage"] == pytest.approx(weight[i, j], abs=1e-5) and r["coverage"] <= 1 + 1e-9
        assert r["v"] == pytest.approx(total[i, j] / weight[i, j], abs=1e-4 / weight[i, j])
    assert max(r["coverage"] for r in got.values()) == pytest.approx(1.0)  # inside, the shares of a target cell add up


def test_nearest_and_bilinear_through_a_projection(degrees):
    values, df = degrees
    back = lambda x, y: from_utm(x, y, 31)
    near = {(r["row_i"], r["col_i"]): r["v"] for r in RA.resample_nearest(df.drop("obs_id"), DEGREES, METRES, back).collect()}
    smooth = {(r["row_i"], r["col_i"]): r["v"] for r in RA.resample_bilinear(df, DEGREES, METRES, "v", ("obs_id",), back).collect()}

    def inverse(x, y):
        """Cell coordinates by Newton steps on the plain projection."""
        lon, lat = 4.22, 50.885
        for _ in range(20):
            px, py = utm_number(lon, lat)
            dx, dy = (np.array(utm_number(lon + 1e-6, lat)) - (px, py)) / 1e-6, (np.array(utm_number(lon, lat + 1e-6)) - (px, py)) / 1e-6
            step = np.linalg.solve(np.array([dx, dy]).T, [x - px, y - py])
            lon, lat = lon + step[0], lat + step[1]
        return (lat - 50.9) / -0.003, (lon - 4.2) / 0.004
    for i in range(13):
        for j in range(14):
            fr, fc = inverse(METRES.x0 + (j + 0.5) * 310, METRES.y0 - (i + 0.5) * 290)
            if 0 <= fr < 10 and 0 <= fc < 12:
                want = values[int(fr), int(fc)]
                assert near[(i, j)] == (None if np.isnan(want) else want)
            else:
                assert (i, j) not in near
            parts = [(max(0, 1 - abs(fr - r - 0.5)) * max(0, 1 - abs(fc - c - 0.5)), values[r, c]) for r in range(10) for c in range(12) if not np.isnan(values[r, c])]
            w = sum(p for p, _ in parts)
            assert ((i, j) in smooth) == (w > 0) and (w == 0 or smooth[(i, j)] == pytest.approx(sum(p * v for p, v in parts) / w, abs=1e-4))


def test_unlike_systems_need_a_projection(degrees):
    _, df = degrees
    for call in (lambda: RA.resample_nearest(df, DEGREES, METRES), lambda: RA.resample_average(df, DEGREES, METRES, "v"), lambda: RA.resample_bilinear(df, DEGREES, METRES, "v")):
        with pytest.raises(ValueError, match="projection"):
            call()


def test_identity_projection_changes_nothing(degrees):
    values, df = degrees
    same = lambda x, y: (x, y)
    for rows in (RA.resample_nearest(df, DEGREES, DEGREES, same), RA.resample_bilinear(df.where("v is not null"), DEGREES, DEGREES, "v", ("obs_id",), same),
                 RA.resample_average(df, DEGREES, DEGREES, "v", ("obs_id",), same)):
        for r in rows.where("v is not null").collect():
            assert r["v"] == pytest.approx(values[r["row_i"], r["col_i"]], abs=1e-9)
