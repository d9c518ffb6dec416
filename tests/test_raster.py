"""Raster operators against numpy."""

import math

import numpy as np
from pyspark.sql import functions as F

from quillgrid.operators import raster, stats
from quillgrid.plans import grids

RNG = np.random.default_rng(3)
GRID = RNG.normal(size=(9, 7)) * 100


def frame(spark, a):
    return spark.createDataFrame([(int(i), int(j), float(a[i, j])) for i in range(a.shape[0]) for j in range(a.shape[1])], "i long, j long, v double")


def array(df, shape, v="v"):
    out = np.full(shape, np.nan)
    for r in df.collect():
        out[r["i"], r["j"]] = r[v]
    return out


def np_resize(a, to):
    def axis(a, n):
        m = a.shape[0]
        x = np.clip((np.arange(n) + 0.5) * m / n - 0.5, 0, m - 1)
        lo = np.floor(x).astype(int)
        hi = np.minimum(lo + 1, m - 1)
        f = (x - lo)[:, None]
        return a[lo] * (1 - f) + a[hi] * f

    return axis(axis(a, to[0]).T, to[1]).T


def np_blur(a, taps):
    half = len(taps) // 2
    pad = np.pad(a, ((0, 0), (half, half)), mode="edge")
    a = sum(t * pad[:, k : k + a.shape[1]] for k, t in enumerate(taps))
    pad = np.pad(a, ((half, half), (0, 0)), mode="edge")
    return sum(t * pad[k : k + a.shape[0]] for k, t in enumerate(taps))


def test_resizes(spark):
    g = frame(spark, GRID)
    for to in ((18, 14), (5, 3), (9, 7), (20, 4), (1, 1)):
        assert np.allclose(array(raster.resize_bilinear(g, GRID.shape, to), to), np_resize(GRID, to))
        i, j = np.arange(to[0]) * 9 // to[0], np.arange(to[1]) * 7 // to[1]
        assert np.allclose(array(raster.resize_nearest(g, GRID.shape, to), to), GRID[i][:, j])


def test_stencils_agree_whatever_the_tile(spark, monkeypatch):
    g = frame(spark, GRID)
    runs = []
    for tile in (128, 4, 3):
        monkeypatch.setattr(raster, "TILE", tile)
        t = frame(spark, np.abs(GRID)).withColumnRenamed("v", "t").join(g.withColumnRenamed("v", "e"), ["i", "j"])
        shade, base = raster.hillshade(g), stats.windowed_baseline(t, 3)
        runs.append([array(raster.gaussian_blur(g, 1.2, wide=True), GRID.shape), array(raster.sobel(g), GRID.shape), array(shade, GRID.shape, "dx"), array(shade, GRID.shape, "dy"),
                     array(base, GRID.shape, "beta"), array(base, GRID.shape, "t_sea")])
        assert shade.count() == GRID.size
    for other in runs[1:]:
        assert all(np.allclose(a, b, equal_nan=True) for a, b in zip(runs[0], other, strict=True))


def test_quantiles_of_many_bins_and_ties(spark):
    rng = np.random.default_rng(6)
    values = np.concatenate([np.round(rng.exponential(100, 3000), 1), np.full(1500, 7.5), [1e12, -1e12]])
    df = spark.createDataFrame([(float(v),) for v in values] + [(None,)], "v double").repartition(5)
    levels = [0.0, 1e-4, 0.1, 0.25, 0.5, 0.9, 0.9999, 1.0]
    for bins in (4, 64, 1024):
        assert np.allclose(stats.exact_quantiles(df, levels, bins=bins), np.quantile(values, levels))
    assert stats.exact_quantiles(df.where("false"), levels) == [] and stats.exact_quantiles(df.where("v = 7.5"), [0.3]) == [7.5]
    knots = [float(k) for k in range(-5, 9)]
    got = spark.createDataFrame([(float(x),) for x in np.arange(-7, 11, 0.5)], "x double").select("x", stats.place(F.col("x"), knots).alias("n")).collect()
    assert all(r["n"] == sum(k <= r["x"] for k in knots) for r in got)


def test_kernels():
    taps = raster.kernel_truncated(5.0)
    assert len(taps) == 11 and [round(t, 6) for t in taps[:6]] == [0.066342, 0.079425, 0.091361, 0.100969, 0.107213, 0.109379]
    assert len(raster.kernel_wide(1.2)) == 9 and abs(sum(raster.kernel_wide(6.0)) - 1) < 1e-12


def test_blurs(spark):
    g = frame(spark, GRID)
    assert np.allclose(array(raster.gaussian_blur(g, 1.9), GRID.shape), np_blur(GRID, raster.kernel_truncated(1.9)))
    assert np.allclose(array(raster.gaussian_blur(g, 1.2, wide=True), GRID.shape), np_blur(GRID, raster.kernel_wide(1.2)))
    assert np.allclose(array(raster.gaussian_blur(g, 6.0, wide=True), GRID.shape), np_blur(GRID, raster.kernel_wide(6.0)))


def np_shade(a, res):
    dy, dx = np.gradient(a)
    dy, dx = dy / (15 * res / 90), dx / (15 * res / 90)
    slope, aspect = math.pi / 2 - np.arctan(np.hypot(dx, dy)), np.arctan2(dy, -dx)
    az, alt = math.radians(315), math.radians(45)
    return np.clip(math.sin(alt) * np.sin(slope) + math.cos(alt) * np.cos(slope) * np.cos(az - aspect), 0, 1)


def test_gradients_and_shade(spark):
    g = frame(spark, GRID)
    dy, dx = np.gradient(GRID)
    got = raster.gradient(g)
    assert np.allclose(array(got, GRID.shape, "dy"), dy) and np.allclose(array(got, GRID.shape, "dx"), dx)
    assert np.allclose(array(raster.hillshade(g, 120.0), GRID.shape, "shade"), np_shade(GRID, 120.0))
    p = np.pad(GRID, 1, mode="edge")
    w = lambda r, c: p[r : r + 9, c : c + 7]
    sx = (w(0, 2) + 2 * w(1, 2) + w(2, 2) - w(0, 0) - 2 * w(1, 0) - w(2, 0)) / 8
    sy = (w(2, 0) + 2 * w(2, 1) + w(2, 2) - w(0, 0) - 2 * w(0, 1) - w(0, 2)) / 8
    assert np.allclose(array(raster.sobel(g, 2.0), GRID.shape), np.hypot(sx, sy) / 2)


def test_laplacian_of_a_plane_is_kept(spark):
    low = np.add.outer(np.arange(6) * 2.0, np.arange(5) * 3.0)
    up = array(raster.resize_extrapolated(frame(spark, low), (6, 5), (12, 10)), (12, 10))
    want = np.add.outer(((np.arange(12) + 0.5) / 2 - 0.5) * 2.0, ((np.arange(10) + 0.5) / 2 - 0.5) * 3.0)
    assert np.allclose(up, want)  # a linear field is continued beyond the edge


def test_point_samples(spark):
    points = spark.createDataFrame([(1, 2.5, 3.25), (2, -4.0, 99.0), (3, 8.0, 6.0), (4, 0.0, 0.0)], "id long, y double, x double")
    got = {r["id"]: r["v"] for r in raster.sample_bilinear(points, frame(spark, GRID), GRID.shape).collect()}
    a = GRID[2:4, 3:5].mean(0)
    assert np.allclose([got[k] for k in (1, 2, 3, 4)], [a[0] * 0.75 + a[1] * 0.25, GRID[0, 6], GRID[8, 6], GRID[0, 0]])


def test_nan_becomes_the_mean(spark):
    a = GRID.copy()
    a[2, 3], a[0, 0] = np.nan, np.inf
    got = array(raster.fill_nan(frame(spark, a)), a.shape)
    assert np.isclose(got[2, 3], a[np.isfinite(a)].mean()) and np.isinf(got[0, 0])


def test_relief_colours(spark):
    got = raster.relief(frame(spark, GRID), 90.0)
    r, b = array(got, GRID.shape, "r"), array(got, GRID.shape, "b")
    t = np.minimum(1, -GRID / 10000) ** 0.7
    sea = GRID < 0
    assert np.allclose(r[sea], ((1 - t) * 0.68)[sea]) and np.allclose(b[sea], ((1 - t) + t * 0.45)[sea])
    assert (r >= 0).all() and (r <= 1).all()


def test_windowed_baseline(spark):
    e, t = RNG.normal(size=(9, 7)) * 50 + 20, RNG.normal(size=(9, 7)) * 5
    df = frame(spark, e).withColumnRenamed("v", "e").join(frame(spark, t).withColumnRenamed("v", "t"), ["i", "j"])
    got = {(r["i"], r["j"]): r for r in stats.windowed_baseline(df, 5).collect()}
    assert len(got) == 5 * 3
    for (i, j), r in got.items():
        x, y = e[i : i + 5, j : j + 5].ravel(), t[i : i + 5, j : j + 5].ravel()
        land = x > 0
        d = land.sum() + 1e-6
        mx, my = x[land].sum() / d, y[land].sum() / d
        beta = ((x * y)[land].sum() / d - mx * my) / ((x * x)[land].sum() / d - mx * mx + 1e-6)
        assert abs(r["beta"] - min(0, max(-0.012, beta))) < 1e-9


def test_quantiles_and_interpolation(spark):
    values = np.sort(RNG.normal(size=500))
    df = spark.createDataFrame([(float(v),) for v in values], "v double")
    xp = stats.quantile_table(df, 16)
    assert np.allclose(xp, np.quantile(values, [1e-4 + k * (1 - 2e-4) / 15 for k in range(16)]))
    tied = stats.quantile_table(spark.createDataFrame([(1.0,)] * 50 + [(2.0,)], "v double"), 8)
    assert all(b > a for a, b in zip(tied, tied[1:], strict=False))
    asked = [-9.0, *xp[:3], 0.1, 0.7, 9.0]
    got = spark.createDataFrame([(float(x),) for x in asked], "x double").select(stats.interp(F.col("x"), xp, [float(k * k) for k in range(16)]).alias("y")).collect()
    assert np.allclose([r["y"] for r in got], np.interp(asked, xp, [k * k for k in range(16)]))


def test_elevation_of_neighbouring_regions_agrees(spark):
    """With a pad of seven low cells a region's heights do not depend on how far the request reaches."""
    from quillgrid.plans.assembly import elevation

    low, residual = RNG.normal(size=(24, 20)), RNG.normal(size=(48, 40))

    def region(i0, i1, j0, j1):
        a, b = low[i0:i1, j0:j1], residual[2 * i0 : 2 * i1, 2 * j0 : 2 * j1]
        out = elevation(frame(spark, b), frame(spark, a), a.shape, 2, 7)
        return array(out, (2 * (i1 - i0 - 14), 2 * (j1 - j0 - 14)))

    big, small = region(0, 24, 0, 20), region(3, 20, 1, 17)
    assert np.allclose(big[6 : 6 + small.shape[0], 2 : 2 + small.shape[1]], small)


def test_grids_are_not_broadcast(spark, sf):
    """Cells that were exploded look small to the planner; joins of grids must not take its word for it."""
    for query in (grids.laplacian_denoise, grids.laplacian_decode):
        plan = query(spark, sf)._jdf.queryExecution().executedPlan().toString()
        inner = [line for line in plan.splitlines() if "Join" in line and "Inner" in line]
        assert inner and all("SortMergeJoin" in line for line in inner), query.__name__


def test_a_frame_is_as_large_as_it_looks_to_the_planner(spark):
    from quillgrid.operators import windows

    cells = spark.createDataFrame([(3, -2, 1.0)], "i long, j long, v double")
    out = windows.dense(cells, -5, 95, -3, 17)
    assert {(r["i"], r["j"]): r["v"] for r in out.collect()} == {(i, j): float((i, j) == (3, -2)) for i in range(-5, 95) for j in range(-3, 17)}
    frame = out.select("i", "j")._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    assert int(str(frame)) >= 100 * 20 * 8
    assert windows.dense(cells, 0, 0, 0, 5).count() == 0
