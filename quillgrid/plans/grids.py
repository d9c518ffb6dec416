"""Window, slice and raster queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import blend, raster, stats, tensor, windows
from ..operators.windows import WindowSpec
from .tables import DENSE, GRID, channel_grid, dense_grid, event_cells, event_grid, table

HOP = WindowSpec(8, 6)
HOP_OFF = WindowSpec(5, 7, -3)  # leaves gaps
_W = "(SELECT unnest(range(-5, CAST((SELECT max(user_id) FROM events) + 10 AS BIGINT))) AS w)"


def _rounded(df: DataFrame, *names: str, digits: int = 6, nudge: float = 0.0) -> DataFrame:
    """Rounded for comparison; the nudge keeps exact halves, which short decimals and binary weights make, off the rounding edge."""
    return df.withColumns({n: F.round(F.col(n) + nudge if nudge else n, digits) for n in names})


def window_assign_overlap(spark, d):
    at = windows.assign(event_cells(spark, d), HOP, HOP_OFF)
    return at.groupBy("wi", "wj").agg(F.count("*").alias("n"), F.countDistinct("i", "j").alias("cells"))


WINDOW_ASSIGN = f"""WITH {GRID}
SELECT a.w AS wi, b.w AS wj, count(*) AS n, count(DISTINCT (i, j)) AS cells FROM ev
JOIN {_W} a ON i >= a.w * 6 AND i < a.w * 6 + 8 JOIN {_W} b ON j >= b.w * 7 - 3 AND j < b.w * 7 + 2 GROUP BY ALL"""


def window_bounds(spark, d):
    at = windows.assign(event_grid(spark, d).select("i", "j"), HOP, HOP_OFF).select("wi", "wj").distinct()
    return at.select("wi", "wj", HOP.start("wi").alias("i0"), HOP.stop("wi").alias("i1"), HOP_OFF.start("wj").alias("j0"), HOP_OFF.stop("wj").alias("j1"))


WINDOW_BOUNDS = f"""WITH {GRID}
SELECT DISTINCT a.w AS wi, b.w AS wj, a.w * 6 AS i0, a.w * 6 + 8 AS i1, b.w * 7 - 3 AS j0, b.w * 7 + 2 AS j1 FROM grid
JOIN {_W} a ON i >= a.w * 6 AND i < a.w * 6 + 8 JOIN {_W} b ON j >= b.w * 7 - 3 AND j < b.w * 7 + 2"""


def window_demand(spark, d):
    """Two levels: the windows that the cells read, and the windows of the level below that those read through a halo of one."""
    top = tensor.Node("top", HOP, HOP, None)
    low = tensor.Node("low", WindowSpec(4, 3), WindowSpec(4, 3), None)
    top.deps, top.dep_rows, top.dep_cols = [low], [WindowSpec(10, 6, -1)], [WindowSpec(10, 6, -1)]
    cells = event_grid(spark, d)
    ranges = cells.select(F.col("i").alias("i0"), (F.col("i") + 3).alias("i1"), F.col("j").alias("j0"), (F.col("j") + 2).alias("j1"))
    first = windows.window_list(ranges, top.rows, top.cols)
    (_, second), = tensor.demand(top, first)
    return first.withColumn("level", F.lit(0)).unionByName(second.withColumn("level", F.lit(1)))


WINDOW_DEMAND = f"""WITH {GRID}, w AS {_W},
a AS (SELECT DISTINCT x.w AS wi, y.w AS wj FROM grid JOIN w x ON x.w * 6 < i + 3 AND x.w * 6 + 8 > i JOIN w y ON y.w * 6 < j + 2 AND y.w * 6 + 8 > j),
b AS (SELECT DISTINCT x.w AS wi, y.w AS wj FROM (SELECT DISTINCT wi FROM a) p JOIN w x ON x.w * 3 < p.wi * 6 + 9 AND x.w * 3 + 4 > p.wi * 6 - 1
      JOIN a ON a.wi = p.wi JOIN w y ON y.w * 3 < a.wj * 6 + 9 AND y.w * 3 + 4 > a.wj * 6 - 1)
SELECT wi, wj, 0 AS level FROM a UNION ALL SELECT wi, wj, 1 FROM b"""


def blend_overlap(spark, d):
    return _rounded(blend.blend_cells(event_grid(spark, d), HOP, HOP).select("i", "j", "v"), "v")


BLEND = f"""WITH {GRID}, w AS {_W},
p AS (SELECT i, j, v, a.w AS wi, b.w AS wj,
  (1e0 - 0.999e0 * least(1e0, abs(i - a.w * 6 - 3.5e0) / 3.5e0)) * (1e0 - 0.999e0 * least(1e0, abs(j - b.w * 6 - 3.5e0) / 3.5e0)) AS wt
  FROM grid JOIN w a ON i >= a.w * 6 AND i < a.w * 6 + 8 JOIN w b ON j >= b.w * 6 AND j < b.w * 6 + 8),
m AS (SELECT wi, wj, avg(v) AS mv FROM p GROUP BY wi, wj)
SELECT i, j, round(CASE WHEN sum(wt) > 1e-6 THEN sum(mv * wt) / sum(wt) ELSE 0e0 END, 6) AS v FROM p JOIN m USING (wi, wj) GROUP BY i, j"""


def coarse_stats(spark, d):
    """The flagship: overlapping windows blended, then extremes and mean per block of 16 rows."""
    cells = blend.blend_cells(event_grid(spark, d), HOP, HOP)
    by = windows.floor_div("i", 16).alias("block")
    return cells.groupBy(by).agg(F.round(F.min("v"), 4).alias("vmin"), F.round(F.max("v"), 4).alias("vmax"), F.round(F.avg("v"), 4).alias("vmean"), F.count("*").alias("n"))


COARSE = BLEND.replace("SELECT i, j, round(CASE", ", bl AS (SELECT i, j, (CASE", 1).replace("END, 6) AS v FROM p JOIN m USING (wi, wj) GROUP BY i, j", """END) AS v FROM p JOIN m USING (wi, wj) GROUP BY i, j)
SELECT CAST(floor(i / 16e0) AS BIGINT) AS block, round(min(v), 4) AS vmin, round(max(v), 4) AS vmax, round(avg(v), 4) AS vmean, count(*) AS n FROM bl GROUP BY 1""")


def slice_region(spark, d):
    return _rounded(blend.slice_sum(event_cells(spark, d).select("i", "j", F.col("x").alias("v")), -2, 12, -1, 40), "v", digits=4)


SLICE = f"""WITH {GRID}, f AS (SELECT a.i, b.j FROM (SELECT unnest(range(-2, 12)) AS i) a, (SELECT unnest(range(-1, 40)) AS j) b)
SELECT f.i, f.j, round(coalesce(sum(x), 0e0), 4) AS v FROM f LEFT JOIN ev ON ev.i = f.i AND ev.j = f.j GROUP BY f.i, f.j"""


def accumulate_shifted(spark, d):
    g = event_grid(spark, d)
    return _rounded(blend.accumulate(g, g, 2, -1), "v")


ACCUMULATE = f"WITH {GRID} SELECT a.i, a.j, round(a.v + coalesce(b.v, 0e0), 6) AS v FROM grid a LEFT JOIN grid b ON a.i = b.i + 2 AND a.j = b.j - 1"


def coordinates(spark, d):
    """Snapping, aligning, clamping and ranges of signed block coordinates."""
    x = event_cells(spark, d).select((F.col("i") - 75).alias("x")).distinct()
    begin, end = windows.align("x", F.col("x") + 37, 8)
    n0, n1 = windows.native_range("x", F.col("x") + 16, 3)
    v0, v1 = windows.viewport("x", 5, 1024)
    return x.select(
        "x", windows.tile_snap("x", 16).alias("tile"), begin.alias("a0"), end.alias("a1"), n0.alias("n0"), n1.alias("n1"), v0.alias("v0"), v1.alias("v1"),
        windows.clamp("x", -10, 20).alias("clamped"),
    )


COORDINATES = f"""WITH {GRID} SELECT DISTINCT i - 75 AS x, CAST(floor((i - 75) / 16e0) * 16 AS BIGINT) AS tile, CAST(floor((i - 75) / 8e0) * 8 AS BIGINT) AS a0,
CAST(ceil((i - 38) / 8e0) * 8 AS BIGINT) AS a1, CAST(floor((i - 75) / 3e0) - 2 AS BIGINT) AS n0, CAST(ceil((i - 59) / 3e0) + 2 AS BIGINT) AS n1,
(i - 75) * 256 + 5 - 512 AS v0, (i - 75) * 256 + 5 + 512 AS v1, greatest(-10, least(20, i - 75)) AS clamped FROM grid"""


def crop_region(spark, d):
    return windows.crop(event_grid(spark, d), 3, 11, 5, 20)


CROP = f"WITH {GRID} SELECT i - 3 AS i, j - 5 AS j, v FROM grid WHERE i BETWEEN 3 AND 10 AND j BETWEEN 5 AND 19"


def crop_clamped(spark, d):
    g, (h, w) = dense_grid(spark, d)
    return windows.crop_clamped(g, -4, 6, w - 3, w + 4, (0, 0), (h - 1, w - 1))


CROP_CLAMPED = f"""WITH {DENSE}, t AS (SELECT a.ti, b.tj FROM (SELECT unnest(range(-4, 6)) AS ti) a, (SELECT unnest(range(28, 35)) AS tj) b)
SELECT ti + 4 AS i, tj - 28 AS j, v FROM t JOIN dense ON i = greatest(0, least((SELECT h - 1 FROM size), ti)) AND j = greatest(0, least(30, tj))"""


def bilinear_resize(spark, d):
    g, (h, w) = dense_grid(spark, d)
    return _rounded(raster.resize_bilinear(g, (h, w), (2 * h, 45)), "v", nudge=1e-9)


def _linear(n_in: str, n_out: str, name: str) -> str:
    """Rows (t, lo, hi, f): sources and second weight of each target."""
    x = f"greatest(0e0, least({n_in} - 1e0, (t + 5e-1) * ({n_in} * 1e0 / {n_out}) - 5e-1))"
    return (f"{name} AS (SELECT t, CAST(floor(x) AS BIGINT) AS lo, least(CAST(floor(x) AS BIGINT) + 1, {n_in} - 1) AS hi, x - floor(x) AS f "
            f"FROM (SELECT t, {x} AS x FROM (SELECT unnest(range(0, {n_out})) AS t)))")


def _resized(source: str, a: str = "ri", b: str = "rj") -> str:
    return (f"SELECT a.t AS i, b.t AS j, (p.v * (1 - b.f) + q.v * b.f) * (1 - a.f) + (r.v * (1 - b.f) + s.v * b.f) * a.f AS v FROM {a} a CROSS JOIN {b} b "
            f"JOIN {source} p ON p.i = a.lo AND p.j = b.lo JOIN {source} q ON q.i = a.lo AND q.j = b.hi JOIN {source} r ON r.i = a.hi AND r.j = b.lo JOIN {source} s ON s.i = a.hi AND s.j = b.hi")


RESIZE = f"WITH {DENSE}, {_linear('(SELECT h FROM size)', '(SELECT 2 * h FROM size)', 'ri')}, {_linear('31', '45', 'rj')} SELECT i, j, round(v + 1e-9, 6) AS v FROM ({_resized('dense')})"


def nearest_upsample(spark, d):
    g, (h, w) = dense_grid(spark, d)
    return raster.resize_nearest(g, (h, w), (2 * h + 1, 70))


NEAREST = f"""WITH {DENSE}, ti AS (SELECT unnest(range(0, (SELECT 2 * h + 1 FROM size))) AS t), tj AS (SELECT unnest(range(0, 70)) AS t)
SELECT ti.t AS i, tj.t AS j, v FROM ti CROSS JOIN tj JOIN dense ON i = (ti.t * (SELECT h FROM size)) // (SELECT 2 * h + 1 FROM size) AND j = (tj.t * 31) // 70"""


def resize_extrapolated(spark, d):
    g, (h, w) = dense_grid(spark, d)
    return _rounded(raster.resize_extrapolated(g, (h, w), (2 * h, 2 * w)), "v", nudge=1e-9)


EXTRAPOLATED = f"""WITH {DENSE},
wide_i AS (SELECT * FROM dense UNION ALL SELECT -1, a.j, 2 * a.v - b.v FROM dense a JOIN dense b ON a.i = 0 AND b.i = 1 AND a.j = b.j
  UNION ALL SELECT h, a.j, 2 * a.v - b.v FROM size, dense a JOIN dense b ON a.j = b.j WHERE a.i = h - 1 AND b.i = h - 2),
wide0 AS (SELECT * FROM wide_i UNION ALL SELECT a.i, -1, 2 * a.v - b.v FROM wide_i a JOIN wide_i b ON a.j = 0 AND b.j = 1 AND a.i = b.i
  UNION ALL SELECT a.i, 31, 2 * a.v - b.v FROM wide_i a JOIN wide_i b ON a.j = 30 AND b.j = 29 AND a.i = b.i),
wide AS (SELECT i + 1 AS i, j + 1 AS j, v FROM wide0),
{_linear('(SELECT h + 2 FROM size)', '(SELECT 2 * h + 4 FROM size)', 'ri')}, {_linear('33', '66', 'rj')}
SELECT i - 2 AS i, j - 2 AS j, round(v + 1e-9, 6) AS v FROM ({_resized('wide')}), size WHERE i BETWEEN 2 AND 2 * h + 1 AND j BETWEEN 2 AND 63"""


def _kernel(taps: list[float]) -> str:
    half = len(taps) // 2
    return "k AS (SELECT * FROM (VALUES " + ", ".join(f"({n - half}, {t!r}::DOUBLE)" for n, t in enumerate(taps)) + ") AS t(o, c))"


def _blur(taps: list[float], source: str = "dense") -> str:
    return (f"{_kernel(taps)}, bj AS (SELECT a.i, a.j, sum(b.v * c) AS v FROM {source} a CROSS JOIN k JOIN {source} b ON b.i = a.i AND b.j = greatest(0, least(30, a.j + o)) GROUP BY a.i, a.j), "
            "bi AS (SELECT a.i, a.j, sum(b.v * c) AS v FROM bj a CROSS JOIN k JOIN bj b ON b.j = a.j AND b.i = greatest(0, least((SELECT h - 1 FROM size), a.i + o)) GROUP BY a.i, a.j)")


def gaussian_blur(spark, d):
    return _rounded(raster.gaussian_blur(dense_grid(spark, d)[0], 5.0), "v")


def gaussian_blur_wide(spark, d):
    return _rounded(raster.gaussian_blur(dense_grid(spark, d)[0], 1.2, wide=True), "v")


BLUR = f"WITH {DENSE}, {_blur(raster.kernel_truncated(5.0))} SELECT i, j, round(v, 6) AS v FROM bi"
BLUR_WIDE = f"WITH {DENSE}, {_blur(raster.kernel_wide(1.2))} SELECT i, j, round(v, 6) AS v FROM bi"


def sobel_slope(spark, d):
    return _rounded(raster.sobel(dense_grid(spark, d)[0], 30.0), "v")


_3x3 = ", ".join(f"({a}, {b}, {[-1, 0, 1][b + 1] * [1, 2, 1][a + 1]}, {[-1, 0, 1][a + 1] * [1, 2, 1][b + 1]})" for a in (-1, 0, 1) for b in (-1, 0, 1))
SOBEL = f"""WITH {DENSE}, k AS (SELECT * FROM (VALUES {_3x3}) AS t(a, b, kx, ky)),
g AS (SELECT x.i, x.j, sum(y.v * kx) / 8e0 AS dx, sum(y.v * ky) / 8e0 AS dy FROM dense x CROSS JOIN k
  JOIN dense y ON y.i = greatest(0, least((SELECT h - 1 FROM size), x.i + a)) AND y.j = greatest(0, least(30, x.j + b)) GROUP BY x.i, x.j)
SELECT i, j, round(sqrt(dx * dx + dy * dy) / 30e0, 6) AS v FROM g"""


def gradient_hillshade(spark, d):
    return _rounded(raster.hillshade(dense_grid(spark, d)[0], 90.0).select("i", "j", "dx", "dy", "shade"), "dx", "dy", "shade")


HILLSHADE = f"""WITH {DENSE}, g AS (SELECT a.i, a.j,
  (coalesce(s.v, a.v) - coalesce(n.v, a.v)) / (CASE WHEN s.v IS NULL OR n.v IS NULL THEN 1e0 ELSE 2e0 END) / 15e0 AS dy,
  (coalesce(e.v, a.v) - coalesce(w.v, a.v)) / (CASE WHEN e.v IS NULL OR w.v IS NULL THEN 1e0 ELSE 2e0 END) / 15e0 AS dx
  FROM dense a LEFT JOIN dense n ON n.i = a.i - 1 AND n.j = a.j LEFT JOIN dense s ON s.i = a.i + 1 AND s.j = a.j
  LEFT JOIN dense w ON w.i = a.i AND w.j = a.j - 1 LEFT JOIN dense e ON e.i = a.i AND e.j = a.j + 1)
SELECT i, j, round(dx, 6) AS dx, round(dy, 6) AS dy, round(greatest(0e0, least(1e0, sin(radians(45e0)) * sin(pi() / 2 - atan(sqrt(dx * dx + dy * dy)))
  + cos(radians(45e0)) * cos(pi() / 2 - atan(sqrt(dx * dx + dy * dy))) * cos(radians(315e0) - atan2(dy, -dx)))), 6) AS shade FROM g"""


def nan_fill(spark, d):
    g = event_grid(spark, d).withColumn("v", F.when(F.col("i") % 17 == 0, F.lit(float("nan"))).otherwise(F.col("v")))
    return _rounded(raster.fill_nan(g), "v")


NAN_FILL = f"""WITH {GRID}, m AS (SELECT avg(v) AS mean FROM grid WHERE i % 17 <> 0)
SELECT i, j, round(CASE WHEN i % 17 = 0 THEN mean ELSE v END, 6) AS v FROM grid, m"""


def bilinear_sample(spark, d):
    g, shape = dense_grid(spark, d)
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), (F.col("o_custkey") % shape[0] + 0.25).cast("double").alias("y"), (F.col("o_orderkey") % 40 - 2.5).cast("double").alias("x"))
    return _rounded(raster.sample_bilinear(o, g, shape), "v", nudge=1e-9)


SAMPLE = f"""WITH {DENSE}, o AS (SELECT o_orderkey AS id, least((SELECT h - 1e0 FROM size), o_custkey % (SELECT h FROM size) + 25e-2) AS y, greatest(0e0, least(30e0, o_orderkey % 40 - 25e-1)) AS x FROM orders),
c AS (SELECT *, CAST(floor(y) AS BIGINT) AS y0, CAST(floor(x) AS BIGINT) AS x0 FROM o)
SELECT id, round((p.v * (1 - (x - x0)) + q.v * (x - x0)) * (1 - (y - y0)) + (r.v * (1 - (x - x0)) + s.v * (x - x0)) * (y - y0) + 1e-9, 6) AS v FROM c
JOIN dense p ON p.i = y0 AND p.j = x0 JOIN dense q ON q.i = y0 AND q.j = least(30, x0 + 1)
JOIN dense r ON r.i = least((SELECT h - 1 FROM size), y0 + 1) AND r.j = x0 JOIN dense s ON s.i = least((SELECT h - 1 FROM size), y0 + 1) AND s.j = least(30, x0 + 1)"""


def laplacian_decode(spark, d):
    g, (h, w) = dense_grid(spark, d)
    big = raster.resize_nearest(g, (h, w), (2 * h, 2 * w)).withColumn("v", F.col("v") - 100.0)
    return _rounded(raster.laplacian_decode(big, g, (h, w), (2 * h, 2 * w)), "v", nudge=1e-9)


DECODE = f"""WITH {DENSE}, {_linear('(SELECT h FROM size)', '(SELECT 2 * h FROM size)', 'ri')}, {_linear('31', '62', 'rj')}, up AS ({_resized('dense')})
SELECT up.i, up.j, round(up.v + dense.v - 100e0 + 1e-9, 6) AS v FROM up JOIN dense ON dense.i = up.i // 2 AND dense.j = up.j // 2"""


def laplacian_denoise(spark, d):
    g, (h, w) = dense_grid(spark, d)
    zero = raster.resize_nearest(g, (h, w), (2 * h, 2 * w)).withColumn("v", F.lit(0.0))
    return _rounded(raster.laplacian_denoise(zero, g, (h, w), (2 * h, 2 * w)), "v")


DENOISE = EXTRAPOLATED.replace("SELECT i - 2 AS i, j - 2 AS j, round(v + 1e-9, 6) AS v FROM (", ", up AS (SELECT i - 2 AS i, j - 2 AS j, v FROM (", 1) + (
    f"), {_linear('(SELECT 2 * h FROM size)', '(SELECT h FROM size)', 'si')}, {_linear('62', '31', 'sj')}, down AS ({_resized('up', 'si', 'sj')}), "
    f"{_blur(raster.kernel_truncated(5.0), 'down')} SELECT i, j, round(v, 6) AS v FROM bi"
)


def tensor_slice(spark, d):
    """A two-node graph: base windows hold the table's cells, the upper node adds up 3 x 3 neighbourhoods through a halo of one."""
    base_spec, top_spec = WindowSpec(16), WindowSpec(8)
    store = tensor.Store(spark)
    base = store.get_or_create(tensor.Node("base", base_spec, base_spec, lambda wi, wj: [[0.0] * 16] * 16))
    cells = event_grid(spark, d)
    store.put(base, tensor.tiles_from(cells, base))

    def box(wi, wj, a):
        return sum(a[r : r + 8, c : c + 8] for r in range(3) for c in range(3))

    top = tensor.Node("top", top_spec, top_spec, box, [base], [WindowSpec(10, 8, -1)], [WindowSpec(10, 8, -1)])
    return _rounded(tensor.slice_node(store, top, 2, 14, 3, 30), "v", digits=4)


TENSOR = f"""WITH {GRID}, f AS (SELECT a.i, b.j FROM (SELECT unnest(range(2, 14)) AS i) a, (SELECT unnest(range(3, 30)) AS j) b)
SELECT f.i, f.j, round(coalesce(sum(v), 0e0), 4) AS v FROM f LEFT JOIN grid g ON g.i BETWEEN f.i - 1 AND f.i + 1 AND g.j BETWEEN f.j - 1 AND f.j + 1 GROUP BY f.i, f.j"""


def stream_window_sums(spark, d):
    """The streaming operator over the whole table at once."""
    from ..streaming.cells import window_sums

    e = table(spark, d, "events").select("ts", F.col("user_id").cast("long").alias("i"), (F.dayofmonth("ts") - 1).cast("long").alias("j"), F.col("value").alias("v"))
    out = window_sums(e, HOP, HOP)
    return out.select(F.date_format("at.start", "yyyy-MM-dd").alias("day"), "wi", "wj", F.round("total", 4).alias("total"), "n")


STREAM = f"""WITH w AS {_W} SELECT strftime(ts, '%Y-%m-%d') AS day, a.w AS wi, b.w AS wj, round(sum(value), 4) AS total, count(*) AS n FROM events
JOIN w a ON user_id >= a.w * 6 AND user_id < a.w * 6 + 8 JOIN w b ON extract('day' FROM ts) - 1 >= b.w * 6 AND extract('day' FROM ts) - 1 < b.w * 6 + 8 GROUP BY ALL"""


def relief_picture(spark, d):
    return _rounded(raster.relief(dense_grid(spark, d)[0].withColumn("v", F.col("v") - 50.0)), "r", "g", "b", digits=4)


def channel_normalise(spark, d):
    g = channel_grid(spark, d)
    s = g.groupBy("ch").agg(F.avg("v").alias("mean"), F.stddev_pop("v").alias("std"))
    return _rounded(stats.normalise(g, s), "v", digits=5)


NORMALISE = (
    "WITH " + GRID + ", cg AS (SELECT ch, i, j, round(avg(x), 6) AS v FROM ev GROUP BY ch, i, j), s AS (SELECT ch, avg(v) AS m, stddev_pop(v) AS sd FROM cg GROUP BY ch) "
    "SELECT ch, i, j, round(CASE WHEN sd <> 0 THEN (v - m) / sd ELSE 0e0 END, 5) AS v FROM cg JOIN s USING (ch)"
)

QUERIES = {
    "window_assign_overlap": (window_assign_overlap, WINDOW_ASSIGN), "window_bounds": (window_bounds, WINDOW_BOUNDS), "window_demand": (window_demand, WINDOW_DEMAND),
    "blend_overlap": (blend_overlap, BLEND), "coarse_stats": (coarse_stats, COARSE), "slice_region": (slice_region, SLICE),
    "accumulate_shifted": (accumulate_shifted, ACCUMULATE), "coordinates": (coordinates, COORDINATES), "crop_region": (crop_region, CROP),
    "crop_clamped": (crop_clamped, CROP_CLAMPED), "bilinear_resize": (bilinear_resize, RESIZE), "nearest_upsample": (nearest_upsample, NEAREST),
    "resize_extrapolated": (resize_extrapolated, EXTRAPOLATED), "gaussian_blur": (gaussian_blur, BLUR), "gaussian_blur_wide": (gaussian_blur_wide, BLUR_WIDE),
    "sobel_slope": (sobel_slope, SOBEL), "gradient_hillshade": (gradient_hillshade, HILLSHADE), "nan_fill": (nan_fill, NAN_FILL),
    "bilinear_sample": (bilinear_sample, SAMPLE), "laplacian_decode": (laplacian_decode, DECODE), "laplacian_denoise": (laplacian_denoise, DENOISE),
    "tensor_slice": (tensor_slice, TENSOR), "stream_window_sums": (stream_window_sums, STREAM), "relief_picture": (relief_picture, None),
    "channel_normalise": (channel_normalise, NORMALISE),
}
