"""Coordinates: cells, boxes, spherical Mercator and closed-form map projections."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from zonemill.functions.numbers import clamp
from zonemill.model import EARTH_RADIUS_M, MAX_MERCATOR_LATITUDE, Grid


def cell_center(row: Column, col: Column, grid: Grid) -> tuple[Column, Column]:
    return grid.x0 + (col + 0.5) * grid.dx, grid.y0 + (row + 0.5) * grid.dy


def cell_of(x: Column, y: Column, grid: Grid) -> tuple[Column, Column]:
    """Row and column of a point; null outside (the far edges are outside)."""
    row = F.floor((y - grid.y0) / grid.dy)
    col = F.floor((x - grid.x0) / grid.dx)
    inside = row.between(0, grid.height - 1) & col.between(0, grid.width - 1)
    return F.when(inside, row), F.when(inside, col)


def boxes_touch(ax0, ay0, ax1, ay1, bx0, by0, bx1, by1) -> Column:
    """Do two boxes share at least a point?"""
    return (ax0 <= bx1) & (ax1 >= bx0) & (ay0 <= by1) & (ay1 >= by0)


def aligned_box(x0: Column, y0: Column, x1: Column, y1: Column, res: float) -> list[Column]:
    """The box grown to whole cells."""
    return [F.floor(x0 / res) * res, F.floor(y0 / res) * res, F.ceil(x1 / res) * res, F.ceil(y1 / res) * res]


def padded_box(x0: Column, y0: Column, x1: Column, y1: Column, margin: float) -> list[Column]:
    return [x0 - margin, y0 - margin, x1 + margin, y1 + margin]


def to_mercator(lon: Column, lat: Column) -> tuple[Column, Column]:
    lat = clamp(lat, -MAX_MERCATOR_LATITUDE, MAX_MERCATOR_LATITUDE)
    return (EARTH_RADIUS_M * lon * math.pi / 180.0,
            EARTH_RADIUS_M * F.log(F.tan(math.pi / 4.0 + lat * math.pi / 360.0)))


def from_mercator(x: Column, y: Column) -> tuple[Column, Column]:
    return (x / EARTH_RADIUS_M * 180.0 / math.pi,
            (2.0 * F.atan(F.exp(y / EARTH_RADIUS_M)) - math.pi / 2.0) * 180.0 / math.pi)


def mercator_cell_ha(row: Column, grid: Grid) -> Column:
    """Ground area of a cell on a Mercator grid: projected area · cos²(latitude)."""
    latitude = from_mercator(F.lit(0.0), grid.y0 + (row + 0.5) * grid.dy)[1] * math.pi / 180.0
    return abs(grid.dx * grid.dy) * F.cos(latitude) * F.cos(latitude) / 10_000.0


def mercator_grid_size(west: Column, south: Column, east: Column, north: Column, res_m: float) -> tuple[Column, Column]:
    """Width and height of :func:`mercator_grid` for bounds that are columns."""
    (x0, y0), (x1, y1) = to_mercator(west, south), to_mercator(east, north)
    step = res_m / F.cos(F.radians((south + north) / 2))
    return F.ceil((x1 - x0) / step), F.ceil((y1 - y0) / step)


def mercator_grid(west: float, south: float, east: float, north: float, res_m: float) -> Grid:
    """Mercator grid whose cells measure ``res_m`` on the ground at the middle latitude."""
    def forward(lon: float, lat: float) -> tuple[float, float]:
        lat = max(-MAX_MERCATOR_LATITUDE, min(MAX_MERCATOR_LATITUDE, lat))
        return (EARTH_RADIUS_M * math.radians(lon),
                EARTH_RADIUS_M * math.log(math.tan(math.pi / 4 + math.radians(lat) / 2)))

    (x0, y0), (x1, y1) = forward(west, south), forward(east, north)
    step = res_m / math.cos(math.radians((south + north) / 2))
    width, height = math.ceil((x1 - x0) / step), math.ceil((y1 - y0) / step)
    return Grid(x0, y1, (x1 - x0) / width, (y0 - y1) / height, width, height, "EPSG:3857")


# --- Ellipsoidal projections (Snyder, "Map Projections: A Working Manual", GRS 80 / WGS 84). ----

_F = 1.0 / 298.257222101
_E2 = _F * (2.0 - _F)
_E = math.sqrt(_E2)
_A = EARTH_RADIUS_M


def utm(lon: Column, lat: Column, zone: int) -> tuple[Column, Column]:
    """Transverse Mercator, northern UTM zone (sixth-order series)."""
    k0, e2 = 0.9996, _E2
    ep2 = e2 / (1 - e2)
    phi, dlam = F.radians(lat), F.radians(lon - (6.0 * zone - 183.0))
    sin, cos, tan = F.sin(phi), F.cos(phi), F.tan(phi)
    n = _A / F.sqrt(1 - e2 * sin * sin)
    t, c, a = tan * tan, ep2 * cos * cos, dlam * cos
    m = _A * ((1 - e2 / 4 - 3 * e2**2 / 64 - 5 * e2**3 / 256) * phi
              - (3 * e2 / 8 + 3 * e2**2 / 32 + 45 * e2**3 / 1024) * F.sin(2 * phi)
              + (15 * e2**2 / 256 + 45 * e2**3 / 1024) * F.sin(4 * phi)
              - (35 * e2**3 / 3072) * F.sin(6 * phi))
    a2 = a * a
    x = k0 * n * a * (1 + a2 / 6 * (1 - t + c) + a2 * a2 / 120 * (5 - 18 * t + t * t + 72 * c - 58 * ep2)) + 500_000.0
    y = k0 * (m + n * tan * a2 * (0.5 + a2 / 24 * (5 - t + 9 * c + 4 * c * c)
                                  + a2 * a2 / 720 * (61 - 58 * t + t * t + 600 * c - 330 * ep2)))
    return x, y


def from_utm(x: Column, y: Column, zone: int) -> tuple[Column, Column]:
    k0, e2 = 0.9996, _E2
    ep2 = e2 / (1 - e2)
    e1 = (1 - math.sqrt(1 - e2)) / (1 + math.sqrt(1 - e2))
    mu = y / k0 / (_A * (1 - e2 / 4 - 3 * e2**2 / 64 - 5 * e2**3 / 256))
    phi = (mu + (3 * e1 / 2 - 27 * e1**3 / 32) * F.sin(2 * mu) + (21 * e1**2 / 16 - 55 * e1**4 / 32) * F.sin(4 * mu)
           + (151 * e1**3 / 96) * F.sin(6 * mu) + (1097 * e1**4 / 512) * F.sin(8 * mu))
    sin, cos, tan = F.sin(phi), F.cos(phi), F.tan(phi)
    c, t = ep2 * cos * cos, tan * tan
    n = _A / F.sqrt(1 - e2 * sin * sin)
    r = _A * (1 - e2) / F.pow(1 - e2 * sin * sin, 1.5)
    d = (x - 500_000.0) / (n * k0)
    d2 = d * d
    lat = phi - n * tan / r * d2 * (0.5 - d2 / 24 * (5 + 3 * t + 10 * c - 4 * c * c - 9 * ep2)
                                    + d2 * d2 / 720 * (61 + 90 * t + 298 * c + 45 * t * t - 252 * ep2 - 3 * c * c))
    lon = d * (1 - d2 / 6 * (1 + 2 * t + c)
               + d2 * d2 / 120 * (5 - 2 * c + 28 * t - 3 * c * c + 8 * ep2 + 24 * t * t)) / cos
    return F.degrees(lon) + (6.0 * zone - 183.0), F.degrees(lat)


def _q(sin: Column) -> Column:
    es = _E * sin
    return (1 - _E2) * (sin / (1 - es * es) - F.log((1 - es) / (1 + es)) / (2 * _E))


def _q_number(sin: float) -> float:
    es = _E * sin
    return (1 - _E2) * (sin / (1 - es * es) - math.log((1 - es) / (1 + es)) / (2 * _E))


def equal_area_europe(lon: Column, lat: Column) -> tuple[Column, Column]:
    """Lambert azimuthal equal area around 10° E, 52° N (false origin 4 321 000, 3 210 000)."""
    lat0, qp = math.radians(52.0), _q_number(1.0)
    beta0 = math.asin(_q_number(math.sin(lat0)) / qp)
    rq = _A * math.sqrt(qp / 2)
    d = _A * math.cos(lat0) / math.sqrt(1 - _E2 * math.sin(lat0) ** 2) / (rq * math.cos(beta0))
    beta, dlam = F.asin(_q(F.sin(F.radians(lat))) / qp), F.radians(lon - 10.0)
    b = rq * F.sqrt(2 / (1 + math.sin(beta0) * F.sin(beta) + math.cos(beta0) * F.cos(beta) * F.cos(dlam)))
    return (b * d * F.cos(beta) * F.sin(dlam) + 4_321_000.0,
            b / d * (math.cos(beta0) * F.sin(beta) - math.sin(beta0) * F.cos(beta) * F.cos(dlam)) + 3_210_000.0)


def from_equal_area_europe(x: Column, y: Column) -> tuple[Column, Column]:
    """Inverse of :func:`equal_area_europe`: authalic latitude by its series in the eccentricity."""
    lat0, qp = math.radians(52.0), _q_number(1.0)
    beta0 = math.asin(_q_number(math.sin(lat0)) / qp)
    rq = _A * math.sqrt(qp / 2)
    d = _A * math.cos(lat0) / math.sqrt(1 - _E2 * math.sin(lat0) ** 2) / (rq * math.cos(beta0))
    dx, dy = (x - 4_321_000.0) / d, (y - 3_210_000.0) * d
    rho = F.sqrt(dx * dx + dy * dy)
    ce = 2 * F.asin(rho / (2 * rq))
    beta = F.asin(F.when(rho == 0, math.sin(beta0)).otherwise(F.cos(ce) * math.sin(beta0) + dy * F.sin(ce) * math.cos(beta0) / rho))
    dlam = F.atan2(dx * F.sin(ce), rho * math.cos(beta0) * F.cos(ce) - dy * math.sin(beta0) * F.sin(ce))
    e2, e4, e6 = _E2, _E2**2, _E2**3
    lat = (beta + (e2 / 3 + 31 * e4 / 180 + 517 * e6 / 5040) * F.sin(2 * beta) + (23 * e4 / 360 + 251 * e6 / 3780) * F.sin(4 * beta)
           + (761 * e6 / 45360) * F.sin(6 * beta))
    return F.degrees(dlam) + 10.0, F.degrees(lat)


def _belgian_cone() -> tuple[float, float, float, float]:
    """Cone constant, scale, radius of the origin and central meridian of the Belgian 2008 system."""
    phi1, phi2 = math.radians(49 + 50 / 60), math.radians(51 + 10 / 60)
    phi0, lam0 = math.radians(50 + 47 / 60 + 52.134 / 3600), 4 + 21 / 60 + 33.177 / 3600

    def m(p: float) -> float:
        return math.cos(p) / math.sqrt(1 - _E2 * math.sin(p) ** 2)

    def t(p: float) -> float:
        es = _E * math.sin(p)
        return math.tan(math.pi / 4 - p / 2) / ((1 - es) / (1 + es)) ** (_E / 2)

    n = (math.log(m(phi1)) - math.log(m(phi2))) / (math.log(t(phi1)) - math.log(t(phi2)))
    f = m(phi1) / (n * t(phi1) ** n)
    return n, f, _A * f * t(phi0) ** n, lam0


def lambert_belgium(lon: Column, lat: Column) -> tuple[Column, Column]:
    """Lambert conformal conic, Belgian 2008 parameters (false origin 649 328, 665 262)."""
    n, f, rho0, lam0 = _belgian_cone()
    phi = F.radians(lat)
    es = _E * F.sin(phi)
    tc = F.tan(math.pi / 4 - phi / 2) / F.pow((1 - es) / (1 + es), _E / 2)
    rho, theta = _A * f * F.pow(tc, n), n * F.radians(lon - lam0)
    return 649_328.0 + rho * F.sin(theta), 665_262.0 + rho0 - rho * F.cos(theta)


def from_lambert_belgium(x: Column, y: Column) -> tuple[Column, Column]:
    """Inverse of :func:`lambert_belgium`: conformal latitude by its series in the eccentricity."""
    n, f, rho0, lam0 = _belgian_cone()
    dx, dy = x - 649_328.0, rho0 - (y - 665_262.0)
    t = F.pow(F.sqrt(dx * dx + dy * dy) / (_A * f), 1 / n)
    chi = math.pi / 2 - 2 * F.atan(t)
    e2, e4, e6, e8 = _E2, _E2**2, _E2**3, _E2**4
    lat = (chi + (e2 / 2 + 5 * e4 / 24 + e6 / 12 + 13 * e8 / 360) * F.sin(2 * chi) + (7 * e4 / 48 + 29 * e6 / 240 + 811 * e8 / 11520) * F.sin(4 * chi)
           + (7 * e6 / 120 + 81 * e8 / 1120) * F.sin(6 * chi) + (4279 * e8 / 161280) * F.sin(8 * chi))
    return F.degrees(F.atan2(dx, dy)) / n + lam0, F.degrees(lat)
