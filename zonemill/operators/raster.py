"""Grid operators: tiles, block fractions, resampling and focal sums.

Resampling within one coordinate system works from the source side: every source cell knows by arithmetic
which target cells it feeds, so there is no join with a target grid. Nearest needs no shuffle at all, average
and bilinear one aggregation with map-side combine. Between coordinate systems nearest and bilinear start at
the target cells, which Spark generates: their centres are projected back and meet the source cells in an
equi-join. The average projects the corners of the source cells and shares each cell out by exact overlap areas.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from zonemill.functions import pixels as P
from zonemill.model import FOCAL_COVERAGE, Grid

TILE = 256
Projector = Callable[[Column, Column], tuple[Column, Column]]


# --- Tiles ----------------------------------------------------------------------------------------


def assemble_tiles(px: DataFrame, tile: int, value: str, keys: tuple[str, ...] = ("obs_id",)) -> DataFrame:
    """Pixels → tiles: sorted (position, value) arrays; a tile never holds more than tile² entries."""
    pos = (F.col("row_i") % tile) * tile + F.col("col_i") % tile
    return (px.groupBy(*keys, F.floor(F.col("row_i") / tile).alias("tile_row"), F.floor(F.col("col_i") / tile).alias("tile_col"))
            .agg(F.array_sort(F.collect_list(F.struct(pos.cast("int").alias("pos"), F.col(value).alias("v")))).alias("payload")))


def explode_tiles(tiles: DataFrame, tile: int, value: str = "v") -> DataFrame:
    """Tiles → pixels."""
    keys = [c for c in tiles.columns if c not in ("tile_row", "tile_col", "payload")]
    flat = tiles.select(*keys, "tile_row", "tile_col", F.inline("payload"))
    return flat.select(*keys, (F.col("tile_row") * tile + F.floor(F.col("pos") / tile)).alias("row_i"),
                       (F.col("tile_col") * tile + F.col("pos") % tile).alias("col_i"), F.col("v").alias(value))


def explode_dense_tiles(tiles: DataFrame, tile: int, width: int, height: int, value: str = "v") -> DataFrame:
    """Tiles with a plain row-major array; cells beyond the clamped grid edge are left out."""
    keys = [c for c in tiles.columns if c not in ("tile_row", "tile_col", "payload")]
    flat = tiles.select(*keys, "tile_row", "tile_col", F.posexplode("payload").alias("pos", value))
    return flat.select(*keys, (F.col("tile_row") * tile + F.floor(F.col("pos") / tile)).alias("row_i"),
                       (F.col("tile_col") * tile + F.col("pos") % tile).alias("col_i"), value).where(
        (F.col("row_i") < height) & (F.col("col_i") < width))


# --- Block means ----------------------------------------------------------------------------------


def fraction_grid(px: DataFrame, codes: list[int], n: int, keys: tuple[str, ...] = ("obs_id",), code: str = "code") -> DataFrame:
    """n × n block shares of every class (f_<code>) and of all classes together (valid)."""
    whole = float(n * n)
    c = F.col(code)
    return (px.groupBy(*keys, F.floor(F.col("row_i") / n).alias("row_i"), F.floor(F.col("col_i") / n).alias("col_i"))
            .agg(*[(F.count_if(c == k) / whole).alias(f"f_{k}") for k in codes], (F.count_if(c.isin(codes)) / whole).alias("valid")))


# --- Resampling -----------------------------------------------------------------------------------


def _range(a: Column, b: Column, n: int) -> Column:
    """Whole numbers from a to b inside 0 … n − 1; empty when there are none."""
    low, high = F.greatest(F.lit(0), F.floor(F.least(a, b))), F.least(F.lit(n - 1), F.ceil(F.greatest(a, b)))
    return F.when(low <= high, F.sequence(low, F.greatest(low, high)))


def _axes(src: Grid, dst: Grid) -> tuple[tuple, tuple]:
    return ("row_i", src.y0, src.dy, dst.y0, dst.dy, dst.height), ("col_i", src.x0, src.dx, dst.x0, dst.dx, dst.width)


def _check_systems(src: Grid, dst: Grid, project: Projector | None) -> None:
    if src.crs != dst.crs and project is None:
        raise ValueError(f"grids in {src.crs} and {dst.crs}: a projection between them is needed")


def _cell(row: Column, col: Column) -> Column:
    return row.cast("long") * (1 << 32) + col.cast("long")


def _projected_centres(spark: SparkSession, src: Grid, dst: Grid, to_source: Projector) -> DataFrame:
    """Target cells with the place of their centre on the source grid, in cells (fr, fc); those that miss the grid are left out."""
    n = F.col("id")
    cells = spark.range(dst.width * dst.height).select(F.floor(n / dst.width).alias("row_i"), (n % dst.width).alias("col_i"))
    x, y = to_source(dst.x0 + (F.col("col_i") + 0.5) * dst.dx, dst.y0 + (F.col("row_i") + 0.5) * dst.dy)
    placed = cells.select("row_i", "col_i", ((y - src.y0) / src.dy).alias("fr"), ((x - src.x0) / src.dx).alias("fc"))
    return placed.where(F.col("fr").between(-0.5, src.height + 0.5) & F.col("fc").between(-0.5, src.width + 0.5))


def resample_nearest(px: DataFrame, src: Grid, dst: Grid, to_source: Projector | None = None) -> DataFrame:
    """Value of the source cell under each target centre. Within one system a narrow transformation: no shuffle, no join.

    ``to_source`` maps target coordinates to those of the source, where the systems differ.
    """
    _check_systems(src, dst, to_source)
    others = [c for c in px.columns if c not in ("row_i", "col_i")]
    if to_source is not None:
        centres = _projected_centres(px.sparkSession, src, dst, to_source)
        row, col = F.floor("fr"), F.floor("fc")
        under = centres.where(row.between(0, src.height - 1) & col.between(0, src.width - 1)).select("row_i", "col_i", _cell(row, col).alias("cell"))
        return px.select(*others, _cell(F.col("row_i"), F.col("col_i")).alias("cell")).join(under, "cell").select(*others, "row_i", "col_i")
    out = px
    for name, s0, ds, d0, dd, n in _axes(src, dst):
        index = F.col(name)
        around = _range((s0 + index * ds - d0) / dd - 0.5, (s0 + (index + 1) * ds - d0) / dd - 0.5, n)
        out = out.withColumn(f"to_{name}", F.explode(around)).where(F.floor((d0 + (F.col(f"to_{name}") + 0.5) * dd - s0) / ds) == index)
    return out.select(*others, F.col("to_row_i").alias("row_i"), F.col("to_col_i").alias("col_i"))


def _scatter(px: DataFrame, src: Grid, dst: Grid, linear: bool) -> DataFrame:
    """Source cells sent to the target cells they feed, with their weight w.

    Area weights are overlaps in target cells; linear weights fall from the source centre to the next centres.
    Each axis is one generator with plain arithmetic, all of it inside generated code.
    """
    out = px
    for name, s0, ds, d0, dd, n in _axes(src, dst):
        to = F.col(f"to_{name}")
        if linear:
            centre = s0 + (F.col(name) + 0.5) * ds
            around = _range((centre - ds - d0) / dd - 0.5, (centre + ds - d0) / dd - 0.5, n)
            weight = 1.0 - F.abs((d0 + (to + 0.5) * dd - centre) / ds)
        else:
            a, b = (s0 + F.col(name) * ds - d0) / dd, (s0 + (F.col(name) + 1) * ds - d0) / dd
            around = _range(a, b, n)
            weight = F.least(F.greatest(a, b), to + 1) - F.greatest(F.least(a, b), to)
        out = out.withColumn(f"to_{name}", F.explode(around)).withColumn(f"w_{name}", weight).where(F.col(f"w_{name}") > 0)
    others = [c for c in px.columns if c not in ("row_i", "col_i")]
    return out.select(*others, F.col("to_row_i").alias("row_i"), F.col("to_col_i").alias("col_i"), (F.col("w_row_i") * F.col("w_col_i")).alias("w"))


def _filled(t: Column) -> Column:
    """Area under the line y = x, cut to 0 … 1, up to t."""
    return F.when(t <= 0, 0.0).when(t >= 1, t - 0.5).otherwise(t * t / 2)


def _under(x1: Column, y1: Column, x2: Column, y2: Column, col: Column, row: Column) -> Column:
    """Signed area between one side of a cell and the lower border of a target cell, inside that target cell."""
    low, high = F.greatest(F.least(x1, x2), col), F.least(F.greatest(x1, x2), col + 1)
    slope = (y2 - y1) / (x2 - x1)
    a, b = y1 + (low - x1) * slope - row, y1 + (high - x1) * slope - row
    mean = F.when(F.abs(b - a) > 1e-9, (_filled(b) - _filled(a)) / (b - a)).otherwise(F.least(F.greatest((a + b) / 2, F.lit(0.0)), F.lit(1.0)))
    return F.when((high > low) & (x1 != x2), F.signum(x1 - x2) * (high - low) * mean).otherwise(0.0)


def _quadrilaterals(px: DataFrame, src: Grid, dst: Grid, to_target: Projector) -> DataFrame:
    """Source cells sent to the target cells that their projected corners span, with the shared area w (in target cells).

    Cells project to quadrilaterals with straight sides. Their part inside a target cell is a sum over the four sides, in
    generated code; the sums over all source cells of a target cell add up to its covered share.
    """
    out = px
    for k, (dr, dc) in enumerate(((0, 0), (0, 1), (1, 1), (1, 0))):
        x, y = to_target(src.x0 + (F.col("col_i") + dc) * src.dx, src.y0 + (F.col("row_i") + dr) * src.dy)
        out = out.withColumn(f"u{k}", (x - dst.x0) / dst.dx).withColumn(f"v{k}", (y - dst.y0) / dst.dy)
    us, vs = [F.col(f"u{k}") for k in range(4)], [F.col(f"v{k}") for k in range(4)]
    finite = ~F.isnan(sum(us) + sum(vs)) & (F.abs(sum(us) + sum(vs)) < float("inf"))
    for name, corner, n in (("row_i", vs, dst.height), ("col_i", us, dst.width)):
        out = out.withColumn(f"to_{name}", F.explode(F.when(finite, _range(F.least(*corner), F.greatest(*corner) - 1, n))))
    col, row = F.col("to_col_i"), F.col("to_row_i")
    area = F.abs(sum(_under(us[k], vs[k], us[(k + 1) % 4], vs[(k + 1) % 4], col, row) for k in range(4)))
    others = [c for c in px.columns if c not in ("row_i", "col_i")]
    return out.select(*others, row.alias("row_i"), col.alias("col_i"), area.alias("w")).where("w > 1e-12")


def resample_average(px: DataFrame, src: Grid, dst: Grid, value: str, keys: tuple[str, ...] = (), to_target: Projector | None = None) -> DataFrame:
    """Area mean of the valid part and the valid share of each target cell.

    ``to_target`` maps source coordinates to those of the target, where the systems differ.
    """
    _check_systems(src, dst, to_target)
    valid = px.select(*keys, "row_i", "col_i", value).where(F.col(value).isNotNull())
    parts = _scatter(valid, src, dst, linear=False) if to_target is None else _quadrilaterals(valid, src, dst, to_target)
    return parts.groupBy(*keys, "row_i", "col_i").agg((F.sum(F.col("w") * F.col(value)) / F.sum("w")).alias(value), F.sum("w").alias("coverage"))


def resample_bilinear(px: DataFrame, src: Grid, dst: Grid, value: str, keys: tuple[str, ...] = (), to_source: Projector | None = None) -> DataFrame:
    """Linear interpolation between the nearest source centres that have a value.

    ``to_source`` maps target coordinates to those of the source, where the systems differ.
    """
    _check_systems(src, dst, to_source)
    valid = px.select(*keys, "row_i", "col_i", value).where(F.col(value).isNotNull())
    if to_source is None:
        parts = _scatter(valid, src, dst, linear=True)
    else:
        around = _projected_centres(px.sparkSession, src, dst, to_source)
        for c, n in (("fr", src.height), ("fc", src.width)):
            first = F.floor(F.col(c) - 0.5)
            around = around.withColumn(f"at_{c}", F.explode(F.array(first, first + 1))).where(F.col(f"at_{c}").between(0, n - 1))
        weight = (1.0 - F.abs(F.col("fr") - F.col("at_fr") - 0.5)) * (1.0 - F.abs(F.col("fc") - F.col("at_fc") - 0.5))
        gathered = around.select("row_i", "col_i", _cell(F.col("at_fr"), F.col("at_fc")).alias("cell"), weight.alias("w")).where("w > 1e-9")  # less is rounding
        parts = valid.select(*keys, value, _cell(F.col("row_i"), F.col("col_i")).alias("cell")).join(gathered, "cell")
    return parts.groupBy(*keys, "row_i", "col_i").agg((F.sum(F.col("w") * F.col(value)) / F.sum("w")).alias(value))


# --- Focal sums -----------------------------------------------------------------------------------


def circular_kernel(radius: float, res: float, samples: int) -> np.ndarray:
    """Share of each cell inside a circle around the centre cell, by samples × samples points."""
    reach = math.ceil(radius / res)
    points = (np.arange((2 * reach + 1) * samples) + 0.5) / samples - 0.5 - reach
    inside = (points[:, None] ** 2 + points[None, :] ** 2) * res * res <= radius * radius
    side = 2 * reach + 1
    return inside.reshape(side, samples, side, samples).mean(axis=(1, 3))


def kernel_cells(circles: DataFrame, radius: str, res: float, samples: int) -> DataFrame:
    """The same kernel for every radius of a table: its non-zero cells (dr, dc, w), one row per cell."""
    reach = F.ceil(F.col(radius) / res)
    cells = circles.withColumn("dr", F.explode(F.sequence(-reach, reach))).withColumn("dc", F.explode(F.sequence(-reach, reach)))

    def offsets(c: str) -> Column:
        return F.transform(F.sequence(F.lit(0), F.lit(samples - 1)), lambda i: (F.col(c) + (i + 0.5) / samples - 0.5) * res)

    limit = F.col(radius) * F.col(radius)
    hits = F.aggregate(offsets("dr"), F.lit(0), lambda n, y: n + F.size(F.filter(offsets("dc"), lambda x: x * x + y * y <= limit)))
    return cells.withColumn("w", hits / float(samples * samples)).where("w > 0")


def with_halo(px: DataFrame, reach: int, tile: int = TILE) -> DataFrame:
    """Replicate the pixels near tile borders into the neighbouring tiles that need them.

    Adds tile_row, tile_col. A pixel inside a tile is kept once; only the halo is copied.
    """
    def owners(c: str) -> Column:
        return F.sequence(F.floor((F.col(c) - reach) / tile), F.floor((F.col(c) + reach) / tile))
    return px.withColumn("tile_row", F.explode(owners("row_i"))).withColumn("tile_col", F.explode(owners("col_i")))


def crop_halo(px: DataFrame, tile: int = TILE) -> DataFrame:
    """Keep only the pixels that belong to their tile."""
    return px.where((F.floor(F.col("row_i") / tile) == F.col("tile_row")) & (F.floor(F.col("col_i") / tile) == F.col("tile_col")))


def _convolve(band: np.ndarray, kernel: np.ndarray, rows: int, cols: int) -> np.ndarray:
    """Valid part of a correlation. Runs of full cells come from one prefix sum, the rim cell by cell."""
    side = kernel.shape[0]
    prefix = np.zeros((band.shape[0], band.shape[1] + 1))
    np.cumsum(band, axis=1, out=prefix[:, 1:])
    out = np.zeros((rows, cols))
    for dr in range(side):
        weights = kernel[dr]
        full = np.flatnonzero(weights == 1.0)
        if full.size and full[-1] - full[0] + 1 == full.size:
            a, b = full[0], full[-1] + 1
            out += prefix[dr:dr + rows, b:b + cols] - prefix[dr:dr + rows, a:a + cols]
            rim = np.flatnonzero((weights > 0) & (weights < 1.0))
        else:
            rim = np.flatnonzero(weights > 0)
        for dc in rim:
            out += weights[dc] * band[dr:dr + rows, dc:dc + cols]
    return out


def focal_density(fractions: DataFrame, codes: list[int], kernel: np.ndarray, tile: int = TILE,
                  threshold: float = FOCAL_COVERAGE) -> DataFrame:
    """Percent of a complete circle per class, and valid coverage; null where the coverage is too low.

    Input: obs_id, row_i, col_i, f_<code>, valid. Outside the grid counts as empty. Each tile gets its
    pixels plus a halo of the kernel's reach (1 + 2·reach/tile squared times the data), so tasks are
    independent and their memory depends on the tile size only.
    """
    reach = kernel.shape[0] // 2
    total = float(kernel.sum())
    names = [f"f_{c}" for c in codes]
    schema = T.StructType([T.StructField(c, T.LongType()) for c in ("obs_id", "row_i", "col_i")]
                          + [T.StructField(f"pct_{c}", T.DoubleType()) for c in codes] + [T.StructField("coverage_pct", T.DoubleType())])

    def one_tile(key: tuple, group: Iterator[pd.DataFrame] | pd.DataFrame) -> pd.DataFrame:
        obs, tr, tc = (int(k) for k in key)
        r, c = group["row_i"].to_numpy() - tr * tile + reach, group["col_i"].to_numpy() - tc * tile + reach
        side = tile + 2 * reach
        own = (r >= reach) & (r < reach + tile) & (c >= reach) & (c < reach + tile)
        out = {"obs_id": np.full(int(own.sum()), obs), "row_i": group["row_i"].to_numpy()[own], "col_i": group["col_i"].to_numpy()[own]}
        results = {}
        for name in [*names, "valid"]:
            plane = np.zeros((side, side))
            plane[r, c] = group[name].to_numpy()
            results[name] = (_convolve(plane, kernel, tile, tile) / total)[r[own] - reach, c[own] - reach]
        low = results["valid"] < threshold - 1e-12
        for code, name in zip(codes, names):
            out[f"pct_{code}"] = np.where(low, np.nan, results[name] * 100.0)
        out["coverage_pct"] = np.where(low, np.nan, np.clip(results["valid"] * 100.0, 0.0, 100.0))
        return pd.DataFrame(out)

    tiles = with_halo(fractions.select("obs_id", "row_i", "col_i", *names, "valid"), reach, tile)
    out = tiles.groupBy("obs_id", "tile_row", "tile_col").applyInPandas(one_tile, schema)
    return out.select("obs_id", "row_i", "col_i", *[F.nanvl(c, F.lit(None).cast("double")).alias(c) for c in (*[f"pct_{k}" for k in codes], "coverage_pct")])


def mask_to_municipality(px: DataFrame, index: DataFrame, grid: Grid) -> DataFrame:
    """Classified pixels inside a municipality, with its key: the copy that is stored per municipality."""
    return px.join(index, ["row_i", "col_i"])


def vegetation_mask(px: DataFrame, sector_votes: DataFrame, classes: DataFrame, threshold: float, grid: Grid, min_votes: int = 5) -> DataFrame:
    """Display pixels: valid, clearly inside a sector, not excluded by the dominant class, index above the threshold."""
    clear = sector_votes.where(F.col("votes") >= min_votes).select("row_i", "col_i", "sector_id")
    rows = px.where(F.col("valid") & (F.col("ndvi") >= threshold)).join(clear, ["row_i", "col_i"])
    judged = rows.join(classes.select("row_i", "col_i", "use"), ["row_i", "col_i"], "left")
    return judged.where(P.exclusion_reason(F.col("cover"), F.col("use")).isNull())
