"""Raster operators on dense grids.

Stencils work on square tiles: each cell goes to the tiles that read it (its own, and those whose halo it
lies in), which is the one shuffle; window functions along both axes then run within a tile.  So tasks grow
with the area, not with the number of rows or columns.  A neighbour beyond the grid's edge is the edge cell.
Resizing scatters each cell to the targets it takes part in, so it needs no join.  Grids are joined with
grids by sorting: the planner takes cells that were exploded for as many as before, and would broadcast them.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .windows import clamp, floor_div

#: Cells on a side of a tile.
TILE = 128


def halo(grid: DataFrame, rows: tuple[int, int], cols: tuple[int, int], tile: int | None = None) -> DataFrame:
    """Each cell once for every tile (_ti, _tj) whose cells read it, so many cells before and after their own along each axis."""
    tile = tile or TILE
    out = grid
    for name, axis, (before, after) in (("_ti", "i", rows), ("_tj", "j", cols)):
        out = out.withColumn(name, F.explode(F.sequence(floor_div(F.col(axis) - after, tile), floor_div(F.col(axis) + before, tile))))
    return out.repartition("_ti", "_tj")


def inner(tiles: DataFrame, tile: int | None = None) -> DataFrame:
    """The cells of each tile without its halo."""
    tile = tile or TILE
    return tiles.where((floor_div("i", tile) == F.col("_ti")) & (floor_div("j", tile) == F.col("_tj"))).drop("_ti", "_tj")


def line(axis: str):
    """A tile's line along an axis, in order."""
    return Window.partitionBy("_ti", "_tj", "j" if axis == "i" else "i").orderBy(axis)


def neighbour(v: str, axis: str, d: int) -> Column:
    """The value ``d`` cells on along the axis, clamped to the edge; among the cells of tiles with a halo of ``d``."""
    at = line(axis)
    if d < 0:
        return F.coalesce(F.lag(v, -d).over(at), F.first(v).over(at.rowsBetween(Window.unboundedPreceding, 0)))
    if d > 0:
        return F.coalesce(F.lead(v, d).over(at), F.last(v).over(at.rowsBetween(0, Window.unboundedFollowing)))
    return F.col(v)


def kernel_truncated(sigma: float) -> list[float]:
    """Normalised taps of a Gaussian that reaches to two sigma."""
    half = int(2 * sigma) // 2
    taps = [math.exp(-(k * k) / (2 * sigma * sigma)) for k in range(-half, half + 1)]
    return [t / sum(taps) for t in taps]


def kernel_wide(sigma: float) -> list[float]:
    """Taps of a Gaussian that reaches to three sigma; the blur renormalises them."""
    half = max(1, math.ceil(3 * sigma))
    taps = [math.exp(-(k * k) / (2 * sigma * sigma)) for k in range(-half, half + 1)]
    return [t / sum(taps) for t in taps]


def convolve(tiles: DataFrame, axis: str, taps: list[float], v: str = "v") -> DataFrame:
    """Weighted sum along an axis of tiles with a halo; the edge values are looked up once, each other tap is one lag or lead."""
    half, at = len(taps) // 2, line(axis)
    columns = tiles.columns
    edges = {"_lo": F.first(v).over(at.rowsBetween(Window.unboundedPreceding, 0)), "_hi": F.last(v).over(at.rowsBetween(0, Window.unboundedFollowing))}
    shifted = {f"_m{k}": (F.lag(v, half - k) if k < half else F.lead(v, k - half)).over(at) for k in range(len(taps)) if k != half}
    moved = tiles.withColumns(edges | shifted)
    parts = [(F.col(v) if k == half else F.coalesce(f"_m{k}", "_lo" if k < half else "_hi")) * F.lit(t) for k, t in enumerate(taps)]
    total = parts[0]
    for p in parts[1:]:
        total = total + p
    return moved.withColumn(v, total).select(*columns)


def gaussian_blur(grid: DataFrame, sigma: float, wide: bool = False) -> DataFrame:
    """Separable blur with clamped edges: along columns of a row first, then along rows."""
    taps = kernel_wide(sigma) if wide else kernel_truncated(sigma)
    half = len(taps) // 2
    return inner(convolve(convolve(halo(grid, (half, half), (half, half)), "j", taps), "i", taps))


def sobel(grid: DataFrame, pixel: float = 1.0) -> DataFrame:
    """Gradient magnitude by the Sobel kernels over eight, per ``pixel`` of length; edges are clamped."""
    # Each kernel is a difference along one axis of a 1-2-1 sum along the other.
    tiles = halo(grid, (1, 1), (1, 1))
    along = tiles.withColumns({"_d": neighbour("v", "j", 1) - neighbour("v", "j", -1), "_s": neighbour("v", "j", -1) + 2 * F.col("v") + neighbour("v", "j", 1)})
    dx = (neighbour("_d", "i", -1) + 2 * F.col("_d") + neighbour("_d", "i", 1)) / 8.0
    dy = (neighbour("_s", "i", 1) - neighbour("_s", "i", -1)) / 8.0
    found = inner(along.withColumns({"_x": dx, "_y": dy}))
    return found.select("i", "j", (F.sqrt(F.col("_x") * F.col("_x") + F.col("_y") * F.col("_y")) / F.lit(float(pixel))).alias("v"))


def gradient(grid: DataFrame, divisor: float = 1.0) -> DataFrame:
    """Central differences (dy along i, dx along j), one-sided at edges."""

    def along(axis: str) -> Column:
        before, after = F.lag("v").over(line(axis)), F.lead("v").over(line(axis))
        span = F.when(before.isNotNull() & after.isNotNull(), 2.0).otherwise(1.0)
        return (F.coalesce(after, F.col("v")) - F.coalesce(before, F.col("v"))) / span / F.lit(float(divisor))

    return inner(halo(grid, (1, 1), (1, 1)).withColumn("dy", along("i")).withColumn("dx", along("j")))


def hillshade(grid: DataFrame, resolution: float = 90.0, azimuth: float = 315.0, altitude: float = 45.0) -> DataFrame:
    """Shaded relief in [0, 1]."""
    az, alt = math.radians(azimuth), math.radians(altitude)
    slope = F.lit(math.pi / 2) - F.atan(F.hypot("dx", "dy"))
    aspect = F.atan2(F.col("dy"), -F.col("dx"))
    shade = F.lit(math.sin(alt)) * F.sin(slope) + F.lit(math.cos(alt)) * F.cos(slope) * F.cos(F.lit(az) - aspect)
    return gradient(grid, 15.0 * resolution / 90.0).withColumn("shade", clamp(shade, F.lit(0.0), F.lit(1.0)))


def fill_nan(grid: DataFrame) -> DataFrame:
    """NaN becomes the mean of the finite cells; infinities stay."""
    finite = F.when(~F.isnan("v") & (F.abs("v") < F.lit(float("inf"))), F.col("v"))
    mean = grid.agg(F.coalesce(F.avg(finite), F.lit(0.0)).alias("_mean"))
    return grid.crossJoin(F.broadcast(mean)).withColumn("v", F.nanvl("v", "_mean")).drop("_mean")  # one row


def _sources(target: str, n_in: int, n_out: int) -> tuple[Column, Column, Column]:
    """The two clamped source cells of a target cell, and the second one's weight (half-pixel centres)."""
    x = (F.col(target) + 0.5) * F.lit(n_in / n_out) - 0.5
    x = clamp(x, F.lit(0.0), F.lit(float(n_in - 1)))
    low = F.floor(x).cast("long")
    return low, F.least(low + 1, F.lit(n_in - 1)), x - low


def _scatter(grid: DataFrame, axis: str, n_in: int, n_out: int) -> DataFrame:
    """Linear resize along one axis: each cell goes to the targets whose two sources it can be."""
    ratio = n_out / n_in
    first = F.greatest(F.lit(0), F.floor((F.col(axis) - 1 + 0.5) * F.lit(ratio) - 1.5).cast("long"))
    last = F.least(F.lit(n_out - 1), F.ceil((F.col(axis) + 1 + 0.5) * F.lit(ratio) + 0.5).cast("long"))
    other = "j" if axis == "i" else "i"
    near = grid.withColumn("_t", F.explode(F.sequence(first, last)))
    low, high, part = _sources("_t", n_in, n_out)
    weight = F.when(F.col(axis) == low, 1.0 - part).otherwise(0.0) + F.when(F.col(axis) == high, part).otherwise(0.0)
    near = near.withColumn("_w", weight).where((F.col(axis) == low) | (F.col(axis) == high))
    return near.groupBy(F.col("_t").alias(axis), other).agg(F.sum(F.col("v") * F.col("_w")).alias("v"))


def resize_bilinear(grid: DataFrame, shape: tuple[int, int], to: tuple[int, int]) -> DataFrame:
    """A dense grid of ``shape``, counted from 0, at another size; half-pixel centres, clamped edges."""
    return _scatter(_scatter(grid, "j", shape[1], to[1]), "i", shape[0], to[0]).select("i", "j", "v")


def resize_extrapolated(grid: DataFrame, shape: tuple[int, int], to: tuple[int, int]) -> DataFrame:
    """As :func:`resize_bilinear` after the border was continued linearly by one cell on every side."""
    (h, w), (dh, dw) = shape, to

    def border(g: DataFrame, axis: str, n: int) -> DataFrame:
        # Each cell with its shares in the border; the resizing adds shares of one cell up.
        part = lambda at, to, share: F.when(F.col(axis) == at, F.array(F.struct(F.lit(to).cast("long").alias("to"), F.lit(share).alias("share")))).otherwise(none)
        none = F.array().cast("array<struct<to:bigint,share:double>>")
        ends = [(0, -1, 2.0), (min(1, n - 1), -1, -1.0), (n - 1, n, 2.0), (max(0, n - 2), n, -1.0)]
        own = F.array(F.struct(F.col(axis).cast("long").alias("to"), F.lit(1.0).alias("share")))
        near = F.col(axis).isin(0, 1, n - 2, n - 1)
        shares = g.withColumn("_p", F.explode(F.when(near, F.concat(own, *[part(*e) for e in ends])).otherwise(own)))
        return shares.withColumns({axis: F.col("_p.to"), "v": F.col("v") * F.col("_p.share")}).drop("_p")

    wide = border(border(grid.select("i", "j", "v"), "i", h), "j", w).withColumns({"i": F.col("i") + 1, "j": F.col("j") + 1})
    grown = (math.floor(dh + 2 * dh / h + 0.5), math.floor(dw + 2 * dw / w + 0.5))
    up = resize_bilinear(wide, (h + 2, w + 2), grown)
    ci, cj = math.floor(dh / h + 0.5), math.floor(dw / w + 0.5)
    inside = F.col("i").between(ci, ci + dh - 1) & F.col("j").between(cj, cj + dw - 1)
    return up.where(inside).select((F.col("i") - ci).alias("i"), (F.col("j") - cj).alias("j"), "v")


def resize_nearest(grid: DataFrame, shape: tuple[int, int], to: tuple[int, int]) -> DataFrame:
    """Each target cell takes the source at ``t * n_in // n_out``; each source writes its own targets."""
    out = grid
    for axis, n, m in (("i", shape[0], to[0]), ("j", shape[1], to[1])):
        first = floor_div(F.col(axis) * m + (n - 1), n)
        last = floor_div((F.col(axis) + 1) * m + (n - 1), n) - 1
        targets = F.when(first <= last, F.sequence(first, last)).otherwise(F.array().cast("array<bigint>"))
        out = out.withColumn(axis, F.explode(targets))
    return out


def sample_bilinear(points: DataFrame, grid: DataFrame, shape: tuple[int, int]) -> DataFrame:
    """Points (id, y, x) with the interpolated value; coordinates are clamped to the grid."""
    y, x = clamp("y", F.lit(0.0), F.lit(float(shape[0] - 1))), clamp("x", F.lit(0.0), F.lit(float(shape[1] - 1)))
    y0, x0 = F.floor(y).cast("long"), F.floor(x).cast("long")
    corners = F.array(*[
        F.struct(
            F.least(y0 + a, F.lit(shape[0] - 1)).alias("i"), F.least(x0 + b, F.lit(shape[1] - 1)).alias("j"),
            ((y - y0 if a else 1.0 - (y - y0)) * (x - x0 if b else 1.0 - (x - x0))).alias("w"),
        )
        for a in (0, 1) for b in (0, 1)
    ])
    asked = points.withColumn("_c", F.explode(corners)).select("id", "_c.*")
    return asked.join(grid, ["i", "j"]).groupBy("id").agg(F.sum(F.col("v") * F.col("w")).alias("v"))


def quads(grid: DataFrame, names: list[str]) -> DataFrame:
    """Each cell of a dense grid with the values of its 2 x 2 cells to the right and below, as arrays; edge cells are repeated outwards."""
    tiles = halo(grid.select("i", "j", *names), (0, 1), (0, 1))
    right = {f"_r_{n}": F.coalesce(F.lead(n).over(line("j")), F.col(n)) for n in names}
    tiles = tiles.withColumns(right)
    below = {f"_b_{n}": F.coalesce(F.lead(n).over(line("i")), F.col(n)) for n in (*names, *right)}
    found = inner(tiles.withColumns(below))
    return found.select("i", "j", *[F.array(n, f"_r_{n}", f"_b_{n}", f"_b__r_{n}").alias(n) for n in names])


def sample_columns(points: DataFrame, grid: DataFrame, shape: tuple[int, int], names: list[str]) -> DataFrame:
    """Points (y, x and other columns) with the interpolated columns of a dense grid; coordinates are clamped.

    Corners stand together in one row of the grid, so each point meets one row: one join, and no sum over corners.
    """
    y, x = clamp("y", F.lit(0.0), F.lit(float(shape[0] - 1))), clamp("x", F.lit(0.0), F.lit(float(shape[1] - 1)))
    at = points.withColumns({"_y": y - F.floor(y), "_x": x - F.floor(x), "_i": F.floor(y).cast("long"), "_j": F.floor(x).cast("long")})
    near = quads(grid, names).select(F.col("i").alias("_i"), F.col("j").alias("_j"), *[F.col(n).alias(f"_q_{n}") for n in names])
    met = at.join(near.hint("merge"), ["_i", "_j"])
    def value(n: str) -> Column:
        q = F.col(f"_q_{n}")
        return (q[0] * (1 - F.col("_x")) + q[1] * F.col("_x")) * (1 - F.col("_y")) + (q[2] * (1 - F.col("_x")) + q[3] * F.col("_x")) * F.col("_y")

    return met.select(*[c for c in points.columns if c not in ("y", "x")], *[value(n).alias(n) for n in names])


def laplacian_decode(residual: DataFrame, low: DataFrame, low_shape: tuple[int, int], shape: tuple[int, int]) -> DataFrame:
    """Residual plus the enlarged low frequencies."""
    up = resize_bilinear(low, low_shape, shape).withColumnRenamed("v", "_low")
    return residual.join(up.hint("merge"), ["i", "j"]).select("i", "j", (F.col("v") + F.col("_low")).alias("v"))


def laplacian_denoise(residual: DataFrame, low: DataFrame, low_shape: tuple[int, int], shape: tuple[int, int], sigma: float = 5.0) -> DataFrame:
    """New low frequencies: the full signal, reduced and blurred."""
    up = resize_extrapolated(low, low_shape, shape).withColumnRenamed("v", "_low")
    full = residual.join(up.hint("merge"), ["i", "j"]).select("i", "j", (F.col("v") + F.col("_low")).alias("v"))
    return gaussian_blur(resize_bilinear(full, shape, low_shape), sigma)


def relief(grid: DataFrame, resolution: float = 90.0) -> DataFrame:
    """Relief picture (i, j, r, g, b): shaded land colours, and blues by depth below zero."""
    from ..functions.colormaps import terrain

    flat = fill_nan(grid)
    shades = [hillshade(gaussian_blur(flat, s, wide=True), resolution).select("i", "j", F.col("shade").alias(n)) for s, n in ((6.0, "_large"), (1.2, "_small"))]
    top = flat.agg(F.greatest(F.max("v"), F.lit(0.0)).alias("_top"))
    both = flat.join(shades[0], ["i", "j"]).join(shades[1], ["i", "j"]).crossJoin(F.broadcast(top))  # one row
    hs = F.pow(clamp(0.75 * F.col("_large") + 0.25 * F.col("_small"), F.lit(0.0), F.lit(1.0)), F.lit(0.85))
    norm = clamp(F.greatest(F.col("v"), F.lit(0.0)) / (F.col("_top") + 1e-8), F.lit(0.0), F.lit(1.0))
    land = terrain(0.25 + F.pow(norm, F.lit(0.7)) * 0.75)
    t = F.pow(F.least(F.lit(1.0), -F.col("v") / 10000.0), F.lit(0.7))
    coast, deep = (0.68, 0.88, 1.00), (0.00, 0.10, 0.45)
    rgb = {
        n: F.when(F.col("v") < 0, (1.0 - t) * coast[k] + t * deep[k]).otherwise(clamp(land[k] * (0.35 + 0.65 * hs), F.lit(0.0), F.lit(1.0)))
        for k, n in enumerate("rgb")
    }
    return both.withColumns(rgb).select("i", "j", *rgb)


def detail(cells: DataFrame, mode: str = "relief", resolution: float = 90.0) -> DataFrame:
    """Picture (i, j, r, g, b) of cells (i, j, elev, temp): heights ("elevation") or temperatures scaled to their extremes, else the relief."""
    from ..functions import colormaps
    from .stats import minmax

    shown = {"elevation": ("elev", colormaps.terrain), "temperature": ("temp", colormaps.rdbu_r)}.get(mode)
    if shown is None:
        return relief(cells.select("i", "j", F.col("elev").alias("v")), resolution)
    scaled = minmax(cells.select("i", "j", F.col(shown[0]).alias("v")))
    return scaled.select("i", "j", *[c.alias(n) for c, n in zip(shown[1](F.col("t")), "rgb", strict=True)])
