"""Clipped geometry of overlapping polygons: the fragments whose areas ``overlay_area`` gives.

Pairs meet as for the areas: by coarse cells, then edge by edge within vertical strips of their common x range. Each pair and
strip becomes one small group that is cut into slabs at all vertices and crossings. Within a slab edges do not cross, so the
intersection is a set of trapezoids between neighbouring edges. The trapezoids of a pair are put together by their
borders: what two of them share cancels, the rest is followed around into rings.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from zonemill.model import MULTIPOLYGON
from zonemill.operators.geometry import candidate_pairs, edges

TRAPEZOID = ("x0", "x1", "low0", "low1", "high0", "high1")
POINT = pa.struct([("x", pa.float64()), ("y", pa.float64())])
GEOMETRY = pa.list_(pa.list_(pa.list_(POINT)))


def _at(edge: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Heights of edges (columns x1, y1, x2, y2 with x1 < x2) at x; exact at both ends."""
    x1, y1, x2, y2 = edge
    y = y1 + (x - x1) * ((y2 - y1) / (x2 - x1))
    return np.where(x == x1, y1, np.where(x == x2, y2, y))


def _crossings(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The x at which an edge of ``a`` crosses one of ``b``."""
    a, b = a[:, :, None], b[:, None, :]
    low, high = np.maximum(a[0], b[0]), np.minimum(a[2], b[2])
    with np.errstate(divide="ignore", invalid="ignore"):
        d0, d1 = _at(a, low) - _at(b, low), _at(a, high) - _at(b, high)
        x = low + (high - low) * (d0 / (d0 - d1))
    return x[(low < high) & (d0 * d1 < 0)]


def trapezoids(a: np.ndarray, b: np.ndarray, left: float, right: float) -> np.ndarray:
    """Trapezoids (rows of ``TRAPEZOID``) of the intersection between x = left and right. ``a`` and ``b``: edges as columns,
    x1 < x2, all those of the two polygons that reach into the strip; even-odd within each polygon."""
    both = np.concatenate([a, b], axis=1)
    x = np.concatenate([both[0], both[2], _crossings(a, b), [left, right]])
    x = np.unique(x[(x >= left) & (x <= right)])
    out = []
    step = max(1, (1 << 20) // max(1, both.shape[1]))  # slabs looked at together
    for low in range(0, len(x) - 1, step):
        x0, x1 = x[low:low + step + 1][:-1], x[low + 1:low + step + 1]
        x0 = x0[:len(x1)]
        slab, edge = np.nonzero((both[0] <= x0[:, None]) & (both[2] >= x1[:, None]))
        if not len(slab):
            continue
        y0, y1 = _at(both[:, edge], x0[slab]), _at(both[:, edge], x1[slab])
        order = np.lexsort((y0 + y1, slab))
        slab, y0, y1, of_a = slab[order], y0[order], y1[order], edge[order] < a.shape[1]
        begin = np.searchsorted(slab, slab)
        count_a, count_b = (np.concatenate([[0], np.cumsum(s)]) for s in (of_a, ~of_a))
        within = ((count_a[1:] - count_a[begin]) % 2 == 1) & ((count_b[1:] - count_b[begin]) % 2 == 1)
        i = np.flatnonzero(within[:-1] & (slab[:-1] == slab[1:]))
        i = i[(y0[i + 1] > y0[i]) | (y1[i + 1] > y1[i])]
        out.append(np.stack([x0[slab[i]], x1[slab[i]], y0[i], y1[i], np.maximum(y0[i], y0[i + 1]), np.maximum(y1[i], y1[i + 1])], axis=1))
    return np.concatenate(out) if out else np.zeros((0, 6))


def _sides(parts: np.ndarray) -> list[tuple[float, float, float, float]]:
    """Directed border pieces, interior on the left; what two trapezoids share is left out."""
    pieces: list[tuple[float, float, float, float]] = []
    flat: dict[tuple[float, float, float, float], int] = defaultdict(int)
    walls: dict[float, list[tuple[float, int]]] = defaultdict(list)
    for x0, x1, low0, low1, high0, high1 in parts.tolist():
        flat[(x0, low0, x1, low1)] += 1
        flat[(x0, high0, x1, high1)] -= 1
        if high1 > low1:
            walls[x1] += [(low1, 1), (high1, -1)]
        if high0 > low0:
            walls[x0] += [(low0, -1), (high0, 1)]
    for (xa, ya, xb, yb), n in flat.items():
        pieces += [(xa, ya, xb, yb)] * n + [(xb, yb, xa, ya)] * -n
    for x, marks in walls.items():
        change: dict[float, int] = defaultdict(int)
        for y, n in marks:
            change[y] += n
        heights, net = sorted(change), 0
        for y, up in zip(heights, heights[1:]):
            net += change[y]
            pieces += [(x, y, x, up)] * net + [(x, up, x, y)] * -net
    return pieces


def _rings(pieces: list[tuple[float, float, float, float]]) -> list[list[tuple[float, float]]]:
    """Border pieces followed around, turning left as sharply as possible where several go on."""
    onward: dict[tuple[float, float], list[tuple[float, float]]] = defaultdict(list)
    for xa, ya, xb, yb in pieces:
        onward[(xa, ya)].append((xb, yb))
    rings = []
    for start in list(onward):
        while onward[start]:
            ring, here = [start], onward[start].pop()
            before = start
            while here != start:
                ways = onward[here]
                if len(ways) > 1:
                    back = math.atan2(before[1] - here[1], before[0] - here[0])
                    ways.sort(key=lambda p: (back - math.atan2(p[1] - here[1], p[0] - here[0])) % (2 * math.pi) or 2 * math.pi)
                    ways[0], ways[-1] = ways[-1], ways[0]
                ring.append(here)
                before, here = here, ways.pop()
            rings.append(ring)
    return rings


def _simple(ring: list[tuple[float, float]]) -> list[tuple[float, float]]:
    """Without vertices on a straight line between their neighbours."""
    out: list[tuple[float, float]] = []
    for i, (x, y) in enumerate(ring):
        (xa, ya), (xb, yb) = out[-1] if out else ring[i - 1], ring[(i + 1) % len(ring)]
        reach = math.hypot(x - xa, y - ya) * math.hypot(xb - x, yb - y)
        if abs((x - xa) * (yb - y) - (y - ya) * (xb - x)) > 1e-12 * max(reach, 1e-300) + 1e-15 * reach:
            out.append((x, y))
    return out


def _area(ring: list[tuple[float, float]]) -> float:
    return sum(xa * yb - xb * ya for (xa, ya), (xb, yb) in zip(ring, [*ring[1:], ring[0]])) / 2


def _holds(ring: list[tuple[float, float]], x: float, y: float) -> bool:
    return sum((ya > y) != (yb > y) and x < (xb - xa) * (y - ya) / (yb - ya) + xa for (xa, ya), (xb, yb) in zip(ring, [*ring[1:], ring[0]])) % 2 == 1


def assembled(parts: np.ndarray) -> list[list[list[tuple[float, float]]]]:
    """Trapezoids → polygons: exterior counter-clockwise, then its holes clockwise, all closed."""
    rings = [r for r in map(_simple, _rings(_sides(parts))) if len(r) > 2]
    outer = sorted((r for r in rings if _area(r) > 0), key=_area)
    polygons = [[r] for r in outer]
    for hole in (r for r in rings if _area(r) < 0):
        # a point just beside the middle of the hole's first side, on the side of the interior
        (xa, ya), (xb, yb) = hole[0], hole[1]
        x, y = (xa + xb) / 2 - (yb - ya) * 1e-9, (ya + yb) / 2 + (xb - xa) * 1e-9
        owner = next((p for p in polygons if _holds(p[0], x, y)), None)
        if owner is not None:
            owner.append(hole)
    return [[[*ring, ring[0]] for ring in polygon] for polygon in polygons]


def _strip_edges(polys: DataFrame, key: str, width: float, geom: str) -> DataFrame:
    """Edges from left to right, once for every strip they reach into."""
    e = edges(polys, [key], geom).where("x1 <> x2")
    swap = F.col("x1") > F.col("x2")
    ends = [F.when(swap, F.col(b)).otherwise(F.col(a)).alias(a) for a, b in (("x1", "x2"), ("y1", "y2"), ("x2", "x1"), ("y2", "y1"))]
    return e.select(key, *ends).withColumn("strip", F.explode(F.sequence(F.floor(F.col("x1") / width), F.floor(F.col("x2") / width))))


def overlay_fragments(a: DataFrame, b: DataFrame, a_key: str, b_key: str, cell: float, strip: float | None = None,
                      minimum: float = 0.001, geom: str = "geom") -> DataFrame:
    """Every overlapping pair with its common part: a_key, b_key, geom (multi-polygon, holes as further rings), area.

    Fragments up to ``minimum`` are dropped, as are borders without area. A group holds the edges of one pair within one
    strip; a fragment, like any geometry, is one row.
    """
    width = strip or cell
    first = F.floor(F.col("x0") / width)
    last = F.greatest(first, F.ceil(F.col("x1") / width) - 1)
    pairs = candidate_pairs(a, b, a_key, b_key, cell, geom).select(a_key, b_key, F.explode(F.sequence(first, last)).alias("strip"))
    sides = [pairs.join(_strip_edges(df, key, width, geom).hint("merge"), [key, "strip"]).withColumn("of_a", F.lit(key == a_key))
             for df, key in ((a, a_key), (b, b_key))]
    group = [a_key, b_key, "strip"]
    together = sides[0].unionByName(sides[1])
    types = {k: together.schema[k] for k in (a_key, b_key)}
    slabs = T.StructType([*types.values(), *(T.StructField(n, T.DoubleType()) for n in TRAPEZOID)])
    pieces = T.StructType([*types.values(), T.StructField("geom", MULTIPOLYGON), T.StructField("area", T.DoubleType())])

    def cut(key: tuple, rows: pa.Table) -> pa.Table:
        ends = np.stack([rows.column(c).to_numpy() for c in ("x1", "y1", "x2", "y2")])
        mine = rows.column("of_a").to_numpy(zero_copy_only=False).astype(bool)
        strip_no = key[2].as_py()
        found = trapezoids(ends[:, mine], ends[:, ~mine], strip_no * width, (strip_no + 1) * width)
        return pa.table([*(pa.repeat(k, len(found)) for k in key[:2]), *(pa.array(c) for c in found.T)], names=slabs.names)

    found = together.groupBy(*group).applyInArrow(cut, slabs)
    # a list holds the trapezoids of one fragment, as many as its two geometries make; the rings are followed only where its area counts
    size = (F.col("x1") - F.col("x0")) * (F.col("high0") - F.col("low0") + F.col("high1") - F.col("low1")) / 2
    areas = found.groupBy(a_key, b_key).agg(F.sum(size).alias("area"), F.collect_list(F.struct(*TRAPEZOID)).alias("parts")).where(F.col("area") > minimum)
    return areas.mapInArrow(lambda batches: _fragments(batches, a_key, b_key), pieces)


def _fragments(batches: Iterator[pa.RecordBatch], a_key: str, b_key: str) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        parts = batch.column("parts")
        flat = np.stack([parts.flatten().field(c).to_numpy(zero_copy_only=False) for c in TRAPEZOID], axis=1) if batch.num_rows else np.zeros((0, 6))
        borders = parts.offsets.to_numpy() - (parts.offsets[0].as_py() if len(parts.offsets) else 0)
        shapes = [[[[{"x": x, "y": y} for x, y in ring] for ring in polygon] for polygon in assembled(flat[i:j])] for i, j in zip(borders[:-1], borders[1:])]
        yield pa.RecordBatch.from_arrays([batch.column(a_key), batch.column(b_key), pa.array(shapes, GEOMETRY), batch.column("area")], names=[a_key, b_key, "geom", "area"])
