"""Polygons as relations: edges, rasterisation to spans, votes, point location and exact overlay areas.

A geometry is array(polygon) of array(ring) of array(struct(x, y)); the first ring is the exterior.
Nothing here calls a geometry library: all steps are projections, generators, equi-joins and sums.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from zonemill import model as M
from zonemill.functions import space as S
from zonemill.model import Grid

# --- Geometry columns -----------------------------------------------------------------------------


def parse_coordinates(kind: Column, text: Column) -> Column:
    """GeoJSON coordinates (text) of a Polygon or MultiPolygon as a geometry column."""
    polygon = F.from_json(text, "array<array<array<double>>>")
    multi = F.from_json(text, "array<array<array<array<double>>>>")
    raw = F.when(kind == "Polygon", F.array(polygon)).when(kind == "MultiPolygon", multi)
    return F.transform(raw, lambda poly: F.transform(poly, lambda ring: F.transform(ring, lambda p: F.struct(
        F.element_at(p, 1).alias("x"), F.element_at(p, 2).alias("y")))))


def _closed(ring: Column) -> Column:
    first = F.element_at(ring, 1)
    return F.when(first == F.element_at(ring, -1), ring).otherwise(F.concat(ring, F.array(first)))


def normalise_geom(geom: Column) -> Column:
    """Close open rings, drop rings of fewer than four points, drop polygons that lost their exterior."""
    closed = F.transform(geom, lambda poly: F.transform(F.filter(poly, lambda r: F.size(r) > 0), _closed))
    kept = F.filter(closed, lambda poly: (F.size(poly) > 0) & (F.size(F.get(poly, F.lit(0))) >= 4))
    return F.transform(kept, lambda poly: F.filter(poly, lambda ring: F.size(ring) >= 4))


def count_vertices(geom: Column) -> Column:
    per_polygon = F.transform(geom, lambda poly: F.aggregate(poly, F.lit(0), lambda n, ring: n + F.size(ring)))
    return F.aggregate(per_polygon, F.lit(0), lambda n, m: n + m)


def signed_area(ring: Column) -> Column:
    """Shoelace area of a closed ring, positive when counter-clockwise."""
    steps = F.sequence(F.lit(1), F.size(ring) - 1)
    cross = F.transform(steps, lambda i: F.element_at(ring, i)["x"] * F.element_at(ring, i + 1)["y"]
                        - F.element_at(ring, i + 1)["x"] * F.element_at(ring, i)["y"])
    return F.aggregate(cross, F.lit(0.0), lambda s, c: s + c) / 2.0


def polygon_area(geom: Column) -> Column:
    """Exteriors minus holes, each polygon at least 0."""
    def one(poly: Column) -> Column:
        areas = F.transform(poly, lambda ring: F.abs(signed_area(ring)))
        holes = F.aggregate(F.slice(areas, 2, F.greatest(F.size(areas) - 1, F.lit(0))), F.lit(0.0), lambda s, a: s + a)
        return F.greatest(F.lit(0.0), F.element_at(areas, 1) - holes)
    return F.aggregate(F.transform(geom, one), F.lit(0.0), lambda s, a: s + a)


def ring_bounds(ring: Column) -> Column:
    xs, ys = F.transform(ring, lambda p: p["x"]), F.transform(ring, lambda p: p["y"])
    return F.struct(F.array_min(xs).alias("x0"), F.array_min(ys).alias("y0"), F.array_max(xs).alias("x1"), F.array_max(ys).alias("y1"))


def geom_bounds(geom: Column) -> Column:
    """Box around all rings."""
    return ring_bounds(F.flatten(F.flatten(geom)))


def subset_rings(geom: Column, x0: float, y0: float, x1: float, y1: float) -> Column:
    """Polygons whose exterior box touches the clip box, with only the holes that touch it."""
    def near(ring: Column) -> Column:
        b = ring_bounds(ring)
        return S.boxes_touch(b["x0"], b["y0"], b["x1"], b["y1"], F.lit(x0), F.lit(y0), F.lit(x1), F.lit(y1))
    kept = F.filter(geom, lambda poly: near(F.element_at(poly, 1)))
    return F.transform(kept, lambda poly: F.filter(poly, lambda ring, i: (i == 0) | near(ring)))


def project_geom(geom: Column, projector) -> Column:
    """Apply a (x, y) → (x, y) column function to every vertex; the number of vertices stays."""
    def vertex(p: Column) -> Column:
        x, y = projector(p["x"], p["y"])
        return F.struct(x.alias("x"), y.alias("y"))
    return F.transform(geom, lambda poly: F.transform(poly, lambda ring: F.transform(ring, vertex)))


def circle_polygon(lon: Column, lat: Column, radius_m: float, segments: int = 64) -> Column:
    """Closed ring around a point, with degrees scaled by the latitude."""
    dy = radius_m / M.METRES_PER_DEGREE
    dx = dy / F.cos(F.radians(lat))
    return F.transform(F.sequence(F.lit(0), F.lit(segments)), lambda i: F.struct(
        (lon + dx * F.cos(i * (2 * math.pi / segments))).alias("x"), (lat + dy * F.sin(i * (2 * math.pi / segments))).alias("y")))


def missing_rectangles(source: list[Column], target: list[Column]) -> Column:
    """Parts of the target box the source box does not cover: above, below, left, right."""
    (sx0, sy0, sx1, sy1), (tx0, ty0, tx1, ty1) = source, target
    low, high = F.greatest(ty0, sy0), F.least(ty1, sy1)

    def box(name: str, x0, y0, x1, y1) -> Column:
        return F.struct(F.lit(name).alias("side"), x0.alias("x0"), y0.alias("y0"), x1.alias("x1"), y1.alias("y1"))

    parts = F.array(box("above", tx0, F.greatest(sy1, ty0), tx1, ty1), box("below", tx0, ty0, tx1, F.least(sy0, ty1)),
                    box("left", tx0, low, F.least(sx0, tx1), high), box("right", F.greatest(sx1, tx0), low, tx1, high))
    return F.filter(parts, lambda p: (p["x1"] > p["x0"]) & (p["y1"] > p["y0"]))


def dissolve(zones: DataFrame, key: str, area: str) -> DataFrame:
    """Area and bounds per group of zones that do not overlap."""
    b = geom_bounds(F.col("geom"))
    return (zones.withColumn("b", b).groupBy(key).agg(
        F.sum(area).alias(area), F.min("b.x0").alias("x0"), F.min("b.y0").alias("y0"), F.max("b.x1").alias("x1"), F.max("b.y1").alias("y1")))


def collection_bounds(zones: DataFrame) -> DataFrame:
    b = geom_bounds(F.col("geom"))
    return zones.withColumn("b", b).agg(F.min("b.x0").alias("x0"), F.min("b.y0").alias("y0"), F.max("b.x1").alias("x1"), F.max("b.y1").alias("y1"))


# --- Edges ----------------------------------------------------------------------------------------


def edges(polys: DataFrame, keys: list[str], geom: str = "geom") -> DataFrame:
    """One row per edge: keys, part, is_hole, orient (sign of the ring's area), x1, y1, x2, y2."""
    parts = polys.select(*keys, F.posexplode(geom).alias("part", "rings"))
    rings = parts.select(*keys, "part", F.posexplode("rings").alias("ring_no", "raw"))
    closed = rings.select(*keys, "part", (F.col("ring_no") > 0).alias("is_hole"), _closed(F.col("raw")).alias("ring"))
    pairs = F.arrays_zip(F.slice("ring", 1, F.size("ring") - 1).alias("a"), F.slice("ring", 2, F.size("ring") - 1).alias("b"))
    flat = (closed.where(F.size("ring") >= 4).withColumn("orient", F.signum(signed_area(F.col("ring"))))
            .select(*keys, "part", "is_hole", "orient", F.explode(pairs).alias("e")))
    return flat.select(*keys, "part", "is_hole", "orient", F.col("e.a.x").alias("x1"), F.col("e.a.y").alias("y1"),
                       F.col("e.b.x").alias("x2"), F.col("e.b.y").alias("y2"))


# --- Rasterisation --------------------------------------------------------------------------------


def rasterize(polys: DataFrame, keys: list[str], grid: Grid, scale: int = 1, geom: str = "geom") -> DataFrame:
    """Spans (keys, row_i, c0, c1 inclusive) of the cells whose centre is inside, even-odd over all rings.

    With ``scale`` the spans are on the grid of scale × scale sub-cells. Each scan row of each polygon is
    its own group, so a giant polygon becomes many small groups, not one big one.
    """
    fine = grid.scaled(scale)
    gx1, gx2 = ((F.col(c) - grid.x0) / grid.dx * scale for c in ("x1", "x2"))
    gy1, gy2 = ((F.col(c) - grid.y0) / grid.dy * scale for c in ("y1", "y2"))
    e = edges(polys, keys, geom).select(*keys, "part", gx1.alias("x1"), gy1.alias("y1"), gx2.alias("x2"), gy2.alias("y2"))
    first = F.greatest(F.lit(0), F.ceil(F.least("y1", "y2") - 0.5))
    last = F.least(F.lit(fine.height - 1), F.floor(F.greatest("y1", "y2") - 0.5))
    rows = e.where(first <= last).withColumn("row_i", F.explode(F.sequence(first, last)))
    scan = F.col("row_i") + 0.5
    crossing = rows.where(((F.col("y1") <= scan) & (F.col("y2") > scan)) | ((F.col("y2") <= scan) & (F.col("y1") > scan))).select(
        *keys, "part", "row_i", (F.col("x1") + (scan - F.col("y1")) * (F.col("x2") - F.col("x1")) / (F.col("y2") - F.col("y1"))).alias("x"))
    order = W.partitionBy(*keys, "part", "row_i").orderBy("x")
    # one exchange serves both the pairing and the merging below
    paired = crossing.repartition(*keys, "row_i").withColumn("n", F.row_number().over(order)).withColumn("x_end", F.lead("x").over(order))
    c0 = F.greatest(F.lit(0), F.ceil(F.col("x") - 0.5))
    c1 = F.least(F.lit(fine.width - 1), F.floor(F.col("x_end") - 0.5))
    return merged_spans(paired.where("n % 2 = 1 AND x_end IS NOT NULL").select(*keys, "row_i", c0.alias("c0"), c1.alias("c1")).where("c0 <= c1"), keys)


def merged_spans(spans: DataFrame, keys: list[str]) -> DataFrame:
    """Spans of one feature and row that share cells or touch become one: parts that share a border count a cell once."""
    order = W.partitionBy(*keys, "row_i").orderBy("c0", "c1")
    before = F.max("c1").over(order.rowsBetween(W.unboundedPreceding, -1))
    runs = spans.withColumn("new", (F.coalesce(before, F.lit(-2)) < F.col("c0") - 1).cast("int"))
    runs = runs.withColumn("run", F.sum("new").over(order.rowsBetween(W.unboundedPreceding, 0)))
    return runs.groupBy(*keys, "row_i", "run").agg(F.min("c0").alias("c0"), F.max("c1").alias("c1")).drop("run")


def one_feature(spans: DataFrame, order: str | None = None) -> DataFrame:
    """Spans of several features without a cell twice: the last feature by ``order`` (default: all its columns) keeps a cell.

    Only spans that overlap another one in their row are taken apart into cells.
    """
    columns = [c for c in spans.columns if c not in ("row_i", "c0", "c1")]
    by_start = W.partitionBy("row_i").orderBy("c0", "c1")
    before, after = F.max("c1").over(by_start.rowsBetween(W.unboundedPreceding, -1)), F.lead("c0").over(by_start)
    marked = spans.withColumn("shared", (F.coalesce(before, F.lit(-1)) >= F.col("c0")) | (F.coalesce(after, F.col("c1") + 1) <= F.col("c1")))
    rank = F.struct(*([order] if order else []), *columns)
    cells = marked.where("shared").select(*columns, "row_i", F.explode(F.sequence("c0", "c1")).alias("c0"))
    won = cells.groupBy("row_i", "c0").agg(F.max_by(F.struct(*columns), rank).alias("f")).select("f.*", "row_i", "c0", F.col("c0").alias("c1"))
    return marked.where("not shared").select(*columns, "row_i", "c0", "c1").unionByName(won.select(*columns, "row_i", "c0", "c1"))


def span_cells(spans: DataFrame) -> DataFrame:
    """Spans as single cells."""
    return spans.withColumn("col_i", F.explode(F.sequence("c0", "c1"))).drop("c0", "c1")


def fractional_weights(polys: DataFrame, keys: list[str], grid: Grid, scale: int) -> DataFrame:
    """Sub-cells covered per cell: keys, row_i, col_i, w (1 … scale²).

    A sub-row span adds its overlap with every cell it touches, so only cells are generated, never sub-cells.
    """
    spans = rasterize(polys, keys, grid, scale)
    cells = spans.withColumn("col_i", F.explode(F.sequence(F.floor(F.col("c0") / scale), F.floor(F.col("c1") / scale))))
    inside = F.least(F.col("c1"), F.col("col_i") * scale + (scale - 1)) - F.greatest(F.col("c0"), F.col("col_i") * scale) + 1
    return (cells.select(*keys, F.floor(F.col("row_i") / scale).alias("row_i"), "col_i", inside.alias("w"))
            .groupBy(*keys, "row_i", "col_i").agg(F.sum("w").alias("w")))


def last_feature(polys: DataFrame, grid: Grid, scale: int, value: str, order: str) -> DataFrame:
    """Sub-cells with the value of the last polygon that covers them: sub_row, sub_col, value."""
    keys = [value] if value == order else [value, order]
    cells = span_cells(rasterize(polys, keys, grid, scale))
    return (cells.groupBy(F.col("row_i").alias("sub_row"), F.col("col_i").alias("sub_col"))
            .agg(F.max_by(value, order).alias(value)))


def last_intervals(polys: DataFrame, grid: Grid, scale: int, value: str, order: str, block: int = 64) -> DataFrame:
    """Stretches of sub-cells with the value of the last polygon that covers them: row_i (sub-row), c0, c1, value.

    Spans are cut at borders of ``block`` cells. The spans of one sub-row and block split each other into stretches between
    their ends, and each stretch takes the last span over it; no sub-cell ever becomes a row.
    """
    width = block * scale
    spans = rasterize(polys, list(dict.fromkeys([value, order])), grid, scale)
    cut = spans.withColumn("blk", F.explode(F.sequence(F.floor(F.col("c0") / width), F.floor(F.col("c1") / width))))
    item = F.struct(F.col(order).alias("o"), F.col(value).alias("v"), F.greatest("c0", F.col("blk") * width).alias("c0"), F.least("c1", F.col("blk") * width + width - 1).alias("c1"))
    groups = cut.groupBy("row_i", "blk").agg(F.array_sort(F.collect_list(item)).alias("s"))
    ends = F.array_sort(F.array_distinct(F.flatten(F.transform("s", lambda x: F.array(x["c0"], x["c1"] + 1)))))
    pieces = F.zip_with(F.slice("ends", 1, F.size("ends") - 1), F.slice("ends", 2, F.size("ends") - 1), lambda a, b: F.struct(a.alias("c0"), (b - 1).alias("c1")))
    split = groups.withColumn("ends", ends).select("row_i", "s", F.inline(pieces))
    over = F.filter("s", lambda x: (x["c0"] <= F.col("c0")) & (x["c1"] >= F.col("c1")))
    return split.withColumn("last", F.try_element_at(over, F.lit(-1))).where("last is not null").select("row_i", "c0", "c1", F.col("last.v").alias(value))


def interval_votes(intervals: DataFrame, scale: int, value: str) -> DataFrame:
    """Votes per cell and value from stretches of sub-cells, by the overlap of stretch and cell; 0 and null do not vote."""
    cells = (intervals.where(F.col(value).isNotNull() & (F.col(value).cast("string") != "0"))
             .withColumn("col_i", F.explode(F.sequence(F.floor(F.col("c0") / scale), F.floor(F.col("c1") / scale)))))
    inside = F.least(F.col("c1"), F.col("col_i") * scale + (scale - 1)) - F.greatest(F.col("c0"), F.col("col_i") * scale) + 1
    return cells.groupBy(F.floor(F.col("row_i") / scale).alias("row_i"), "col_i", value).agg(F.sum(inside).alias("votes"))


def subpixel_votes(subcells: DataFrame, scale: int, value: str) -> DataFrame:
    """Votes per cell and value; 0 and null do not vote."""
    return (subcells.where(F.col(value).isNotNull() & (F.col(value).cast("string") != "0"))
            .groupBy(F.floor(F.col("sub_row") / scale).alias("row_i"), F.floor(F.col("sub_col") / scale).alias("col_i"), value)
            .agg(F.count("*").alias("votes")))


def ranked_votes(votes: DataFrame, value: str) -> DataFrame:
    """All votes of a cell in one list: most votes first, lower value first on ties (≤ scale² entries)."""
    entries = F.array_sort(F.collect_list(F.struct((-F.col("votes")).alias("n"), F.col(value).alias("v"))))
    return votes.groupBy("row_i", "col_i").agg(entries.alias("e")).select(
        "row_i", "col_i", F.transform("e", lambda s: s["v"]).alias("ranking"), F.transform("e", lambda s: -s["n"]).alias("votes"))


def dominant_subpixel(votes: DataFrame, value: str) -> DataFrame:
    """Value with the most votes per cell; the lower value wins a tie."""
    best = F.min(F.struct((-F.col("votes")).alias("n"), F.col(value).alias("v")))
    return votes.groupBy("row_i", "col_i").agg(best.alias("b")).select(
        "row_i", "col_i", F.col("b.v").alias(value), (-F.col("b.n")).alias("votes"))


def unique_majority(votes: DataFrame, value: str, min_votes: int) -> DataFrame:
    """Value with at least ``min_votes`` and no equal rival, else 0."""
    # Two aggregates over (votes, value): the best pair, and how far the smallest value with that count lies from it.
    top = F.max(F.struct("votes", value))
    low = F.max(F.struct(F.col("votes"), (-F.col(value)).alias("neg")))
    out = votes.groupBy("row_i", "col_i").agg(top.alias("t"), low.alias("l"))
    clear = (F.col("t.votes") >= min_votes) & (F.col(f"t.{value}") == -F.col("l.neg"))
    return out.select("row_i", "col_i", F.when(clear, F.col(f"t.{value}")).otherwise(0).alias(value))


def grid_majority(polys: DataFrame, grid: Grid, value: str, order: str, scale: int = 6, min_votes: int = 18) -> DataFrame:
    """Value that a clear majority of a cell's sub-cells has, of the last polygon each."""
    return unique_majority(interval_votes(last_intervals(polys, grid, scale, value, order), scale, value), value, min_votes)


def cell_combos(zone_subcells: DataFrame, class_subcells: DataFrame, scale: int) -> DataFrame:
    """Sub-cell counts per cell, zone and class: the grid-level table all observations share."""
    both = zone_subcells.join(class_subcells.hint("merge"), ["sub_row", "sub_col"], "left")
    others = [c for c in both.columns if c not in ("sub_row", "sub_col")]
    return (both.groupBy(F.floor(F.col("sub_row") / scale).alias("row_i"), F.floor(F.col("sub_col") / scale).alias("col_i"), *others)
            .agg(F.count("*").alias("n")))


# --- Points in polygons ---------------------------------------------------------------------------

FINER = 4


def polygon_cells(polys: DataFrame, key: str, cell: float, geom: str = "geom") -> DataFrame:
    """Polygons as square cells (cx, cy): the edges that reach into a cell, and what the edges to its right add up to.

    Whether an edge crosses the line of a point is decided by its two ends, so only the ends of the edges to the right count,
    in pairs: those above the strip as one parity (``odd``), those inside it by their height (``turns``). Equal heights
    cancel, and both edges at a vertex have the same, so turns are left only where an edge of the cell itself begins.
    Cells that no edge reaches and that lie outside have no row.
    """
    margin = 1e-9 * cell
    e = edges(polys, [key], geom).where("y1 <> y2")
    cut = e.withColumn("cy", F.explode(F.sequence(F.floor(F.least("y1", "y2") / cell), F.floor(F.greatest("y1", "y2") / cell))))

    def x_at(y: Column) -> Column:
        return F.col("x1") + (y - F.col("y1")) * (F.col("x2") - F.col("x1")) / (F.col("y2") - F.col("y1"))

    low, high = F.greatest(F.least("y1", "y2"), F.col("cy") * cell), F.least(F.greatest("y1", "y2"), (F.col("cy") + 1) * cell)
    left = F.greatest(F.least(x_at(low), x_at(high)), F.least("x1", "x2")) - margin
    right = F.least(F.greatest(x_at(low), x_at(high)), F.greatest("x1", "x2")) + margin
    item = F.struct("x1", "y1", "x2", "y2", F.floor(left / cell).alias("c0"), F.floor(right / cell).alias("c1"))
    strips = cut.groupBy(key, "cy").agg(F.collect_list(item).alias("strip"))  # the edges of one polygon in one strip
    cells = strips.withColumn("cx", F.explode(F.sequence(F.array_min(F.transform("strip", lambda s: s["c0"])), F.array_max(F.transform("strip", lambda s: s["c1"])))))
    beyond = F.flatten(F.transform(F.filter("strip", lambda s: s["c0"] > F.col("cx")), lambda s: F.array(s["y1"], s["y2"])))
    cells = cells.select(key, "cx", "cy", F.transform(F.filter("strip", lambda s: F.col("cx").between(s["c0"], s["c1"])), lambda s: F.struct(s["x1"].alias("x1"), s["y1"].alias("y1"), s["x2"].alias("x2"), s["y2"].alias("y2"))).alias("cell_edges"),
                         beyond.alias("beyond"))
    top, bottom = (F.col("cy") + 1) * cell + margin, F.col("cy") * cell - margin
    odd = F.size(F.filter("beyond", lambda y: y > top)) % 2
    inside = F.array_sort(F.filter("beyond", lambda y: y.between(bottom, top)))
    turns = F.aggregate(inside, F.array().cast("array<double>"), lambda kept, y: F.when(F.try_element_at(kept, F.lit(-1)) == y, F.slice(kept, 1, F.size(kept) - 1)).otherwise(F.array_append(kept, y)))
    return cells.select(key, "cx", "cy", "cell_edges", odd.alias("odd"), turns.alias("turns")).where("size(cell_edges) > 0 or odd = 1 or size(turns) > 0")


def points_in_polygons(points: DataFrame, polys: DataFrame, key: str, cell: float, x: str = "x", y: str = "y",
                       geom: str = "geom") -> DataFrame:
    """Points joined to every polygon that contains them, even-odd, holes excluded.

    Equi-join on the point's cell (the side of ``cell`` in ``FINER`` parts, so that few points meet polygons they are
    not in), then a parity test on the few edges of that cell. Points are not shuffled again afterwards.
    """
    cell = cell / FINER
    cells = polygon_cells(polys, key, cell, geom)
    px, py = F.col(x), F.col(y)

    def crosses(e: Column) -> Column:
        return ((e["y1"] > py) != (e["y2"] > py)) & (px < (e["x2"] - e["x1"]) * (py - e["y1"]) / (e["y2"] - e["y1"]) + e["x1"])

    # most cells have no edge or one or two: no list is walked for them
    def one(i: int) -> Column:
        return F.when(crosses(F.get("cell_edges", F.lit(i))), 1).otherwise(0)

    few = F.size("cell_edges")
    hits = F.when(few == 0, 0).when(few == 1, one(0)).when(few == 2, one(0) + one(1)).otherwise(F.size(F.filter("cell_edges", crosses)))
    above = F.when(F.size("turns") == 0, 0).otherwise(F.size(F.filter("turns", lambda height: height > py)))
    placed = points.withColumn("cx", F.floor(px / cell)).withColumn("cy", F.floor(py / cell))
    # the inputs are small beside the result: the partitions of this exchange are not put together by their size
    parts = int(points.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = placed.repartition(parts, "cx", "cy")
    # Ahead of the run a polygon counts as one cell. After this exchange the cells' real size decides whether they are broadcast.
    cells = cells.repartition(parts, "cx", "cy")
    return (placed.join(cells, ["cx", "cy"]).where((hits + above + F.col("odd")) % 2 == 1)
            .drop("cx", "cy", "cell_edges", "turns", "odd"))


# --- Exact overlay areas --------------------------------------------------------------------------


def candidate_pairs(a: DataFrame, b: DataFrame, a_key: str, b_key: str, cell: float, geom: str = "geom") -> DataFrame:
    """Pairs whose boxes touch, with their common x range. Each pair is reported by exactly one cell, so no distinct is needed."""
    def boxes(df: DataFrame, key: str, p: str) -> DataFrame:
        box = df.select(F.col(key), geom_bounds(F.col(geom)).alias("g")).select(
            key, *[F.col(f"g.{c}").alias(f"{p}{c}") for c in ("x0", "y0", "x1", "y1")])
        xs = F.sequence(F.floor(F.col(f"{p}x0") / cell), F.floor(F.col(f"{p}x1") / cell))
        ys = F.sequence(F.floor(F.col(f"{p}y0") / cell), F.floor(F.col(f"{p}y1") / cell))
        return box.withColumn("cx", F.explode(xs)).withColumn("cy", F.explode(ys))

    # After the explode the planner cannot tell the sizes: no broadcast, skewed cells are split at run time.
    both = boxes(a, a_key, "a").join(boxes(b, b_key, "b").hint("merge"), ["cx", "cy"])
    touch = S.boxes_touch(*[F.col(f"a{c}") for c in ("x0", "y0", "x1", "y1")], *[F.col(f"b{c}") for c in ("x0", "y0", "x1", "y1")])
    home = ((F.col("cx") == F.floor(F.greatest("ax0", "bx0") / cell)) & (F.col("cy") == F.floor(F.greatest("ay0", "by0") / cell)))
    return both.where(touch & home).select(a_key, b_key, F.greatest("ax0", "bx0").alias("x0"), F.least("ax1", "bx1").alias("x1"))


def _strip_edges(polys: DataFrame, key: str, width: float, p: str, geom: str) -> DataFrame:
    """Edges cut at vertical strip borders: strip, lo, hi, y at lo, slope, sign."""
    e = edges(polys, [key], geom).where("x1 <> x2")
    side = F.signum(F.col("x1") - F.col("x2")) * F.col("orient") * F.when(F.col("is_hole"), -1.0).otherwise(1.0)
    slope = (F.col("y2") - F.col("y1")) / (F.col("x2") - F.col("x1"))
    lo, hi = F.least("x1", "x2"), F.greatest("x1", "x2")
    last = F.greatest(F.floor(lo / width), F.ceil(hi / width) - 1)
    cut = e.withColumn("strip", F.explode(F.sequence(F.floor(lo / width), last)))
    left, right = F.greatest(lo, F.col("strip") * width), F.least(hi, (F.col("strip") + 1) * width)
    return cut.select(key, "strip", left.alias(f"{p}lo"), right.alias(f"{p}hi"), (F.col("y1") + (left - F.col("x1")) * slope).alias(f"{p}y"),
                      slope.alias(f"{p}m"), side.alias(f"{p}s"))


def overlay_area(a: DataFrame, b: DataFrame, a_key: str, b_key: str, cell: float, strip: float | None = None,
                 minimum: float = 0.001, geom: str = "geom") -> DataFrame:
    """Exact intersection area of every overlapping pair: a_key, b_key, area.

    With orientation-normalised edges, area(A∩B) = −½ Σ s_A s_B ∫|y_A − y_B| dx over the common x range of
    each edge pair. Edges are cut at strip borders and joined per pair and strip of the common x range, so a large
    polygon brings only the edges near its partner. The sum combines on the map side. Slivers up to ``minimum`` are dropped.
    """
    strip = strip or cell
    first = F.floor(F.col("x0") / strip)
    pairs = (candidate_pairs(a, b, a_key, b_key, cell, geom)
             .select(a_key, b_key, F.explode(F.sequence(first, F.greatest(first, F.ceil(F.col("x1") / strip) - 1))).alias("strip")))
    ea, eb = _strip_edges(a, a_key, strip, "a_", geom), _strip_edges(b, b_key, strip, "b_", geom)
    joined = pairs.join(ea.hint("merge"), [a_key, "strip"]).join(eb.hint("merge"), [b_key, "strip"])
    lo, hi = F.greatest("a_lo", "b_lo"), F.least("a_hi", "b_hi")
    both = joined.where(lo < hi).withColumn("lo", lo).withColumn("w", hi - lo)
    at_lo = (F.col("a_y") + (F.col("lo") - F.col("a_lo")) * F.col("a_m")) - (F.col("b_y") + (F.col("lo") - F.col("b_lo")) * F.col("b_m"))
    both = both.withColumn("dl", at_lo).withColumn("dh", F.col("dl") + F.col("w") * (F.col("a_m") - F.col("b_m")))
    al, ah = F.abs("dl"), F.abs("dh")
    integral = F.when(F.col("dl") * F.col("dh") >= 0, F.col("w") * (al + ah) / 2).otherwise(
        F.col("w") * (al * al + ah * ah) / (2 * (al + ah)))
    area = F.sum(F.col("a_s") * F.col("b_s") * integral) * -0.5
    return both.groupBy(a_key, b_key).agg(area.alias("area")).where(F.col("area") > minimum)


# --- Scope index ----------------------------------------------------------------------------------


def scope_index(zones: DataFrame, grid: Grid, keys: list[str], order: str | None = None) -> DataFrame:
    """Cell → zone keys, by cell centre, each cell once (the last zone by ``order``); cells outside all zones have no row."""
    return span_cells(one_feature(rasterize(zones, keys, grid), order))


def grid_cells(spark: SparkSession, grid: Grid) -> DataFrame:
    """All cells of a grid, generated in parallel."""
    n = F.col("id")
    return spark.range(grid.width * grid.height).select(F.floor(n / grid.width).alias("row_i"), (n % grid.width).alias("col_i"))
