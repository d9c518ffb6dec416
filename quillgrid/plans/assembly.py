"""Region plans: elevation and climate assembled from their parts, and graphs of model stages with a stub."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import rng
from ..operators import blend, diffusion, raster, stats, tensor, windows
from ..operators.windows import WindowSpec
from .tables import DAYS, DENSE, dense_grid, event_grid, height_of, table


def elevation(residual: DataFrame, low: DataFrame, low_shape: tuple[int, int], ratio: int, pad: int, sigma: float = 5.0) -> DataFrame:
    """Heights of the inner region: denoised low frequencies enlarged, plus the residual, cropped by ``pad`` low cells, then signed squares.

    ``low`` covers ``low_shape`` cells, the residual ``ratio`` times as many; a pad of seven cells makes neighbouring regions seamless.
    """
    shape = (low_shape[0] * ratio, low_shape[1] * ratio)
    smooth = raster.laplacian_denoise(residual, low, low_shape, shape, sigma)
    full = raster.laplacian_decode(residual, smooth, low_shape, shape)
    at = pad * ratio
    inner = windows.crop(full, at, shape[0] - at, at, shape[1] - at)
    return inner.withColumn("v", stats.signed_square(F.col("v")))


def climate(coarse: DataFrame, native: DataFrame, shape: tuple[int, int], unit: int, size: int = 15) -> DataFrame:
    """Temperature at native cells (i, j, elev): the sea-level baseline of the coarse grid (i, j, t, e), interpolated, and the lapse by height.

    The baseline windows fit inside the coarse ``shape``, so their grid is smaller by ``size`` - 1; native cells are counted from its first cell.
    """
    base = stats.windowed_baseline(coarse, size)
    inner = (shape[0] - size + 1, shape[1] - size + 1)
    points = native.select("i", "j", "elev", ((F.col("i") + 0.5) / unit - 0.5).alias("y"), ((F.col("j") + 0.5) / unit - 0.5).alias("x"))
    joined = raster.sample_columns(points, base, inner, ["beta", "t_sea"])
    return joined.select("i", "j", (F.col("t_sea") + F.col("beta") * F.greatest("elev", F.lit(0.0))).alias("temp"), "beta")


def climate_channels(coarse: DataFrame, shape: tuple[int, int], native: DataFrame, unit: int, size: int = 15) -> DataFrame:
    """``native`` cells (i, j, elev) with temp, t_season, precip, p_cv and beta, from a coarse grid (i, j, root, t, t_season, precip, p_cv).

    ``root`` is the signed root of the height: the sea counts as 0.  The coarse grid goes ``size`` // 2 + 1 cells beyond the native cells
    on every side and is counted from 0.  The regression windows lie inside; the other channels are taken at their middle cells.
    """
    half = size // 2
    base = stats.windowed_baseline(coarse.select("i", "j", "t", F.pow(F.greatest("root", F.lit(0.0)), 2).alias("e")), size)
    middle = coarse.select((F.col("i") - half).alias("i"), (F.col("j") - half).alias("j"), "t_season", "precip", "p_cv")
    grid = base.join(middle, ["i", "j"])
    inner = (shape[0] - size + 1, shape[1] - size + 1)
    points = native.select("i", "j", "elev", ((F.col("i") + 0.5) / unit + 0.5).alias("y"), ((F.col("j") + 0.5) / unit + 0.5).alias("x"))
    found = raster.sample_columns(points, grid, inner, ["beta", "t_sea", "t_season", "precip", "p_cv"])
    return found.withColumn("temp", F.col("t_sea") + F.col("beta") * F.greatest("elev", F.lit(0.0))).drop("t_sea")


def elevation_assembly(spark, d):
    g, (h, w) = dense_grid(spark, d)
    low = g.withColumn("v", stats.signed_root(F.col("v") - 40.0))
    residual = raster.resize_nearest(g, (h, w), (4 * h, 4 * w)).withColumn("v", F.col("v") / 100.0)
    pad = 2  # the smallest test table has fifteen rows
    return elevation(residual, low, (h, w), 4, pad).select("i", "j", (F.round("v", 5) + 0.0).alias("v"))


def climate_assembly(spark, d):
    cells = table(spark, d, "lineitem").select((F.dayofyear("l_shipdate") % 60).cast("long").alias("i"), (F.col("l_quantity") - 1).cast("long").alias("j"), "l_extendedprice", "l_discount")
    known = cells.groupBy("i", "j").agg(F.round(F.avg("l_extendedprice") / 1000, 6).alias("t"), F.round((F.avg("l_discount") - 0.045) * 5000, 6).alias("e"))
    frame = spark.range(0, 60).select(F.col("id").alias("i"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(49).cast("long"))).alias("j"))
    coarse = frame.join(known, ["i", "j"], "left").select("i", "j", F.coalesce("t", F.lit(0.0)).alias("t"), F.coalesce("e", F.lit(0.0)).alias("e"))
    g, _ = dense_grid(spark, d)  # rows beyond the coarse grid take its last row's baseline
    native = g.select("i", "j", (F.col("v") * 9 - 200).alias("elev"))
    out = climate(coarse, native, (60, 50), 2)
    return out.select("i", "j", F.round(F.col("temp") + 1e-9, 5).alias("temp"), F.round("beta", 7).alias("beta"))


def ramp(size: int) -> np.ndarray:
    """The blend weights of a window of so many cells along one axis."""
    mid = (size - 1) / 2
    return 1 - 0.999 * np.minimum(1, np.abs(np.arange(size) - mid) / mid)


def overlapping(spec: WindowSpec) -> np.ndarray:
    """The weights of all windows along one axis at the cells of one of them, summed: the same for each, as every window's neighbours are computed."""
    at, reach = np.arange(spec.size), -(-spec.size // spec.step)
    inside = [(at - k * spec.step, (at >= k * spec.step) & (at < k * spec.step + spec.size)) for k in range(1 - reach, reach)]
    return sum(np.where(own, ramp(spec.size)[np.where(own, r, 0)], 0.0) for r, own in inside)


def stub(x: np.ndarray, label: float) -> np.ndarray:
    """A linear stand-in for a learned model."""
    return 0.5 * math.cos(label) * x


def _solved(x: np.ndarray, steps: int) -> np.ndarray:
    """Solver steps of second order with the stub as model, on any array."""
    sigma, before = diffusion.schedule(steps), None
    for k in range(steps):
        a, b = sigma[k], sigma[k + 1]
        answer = stub(x / math.hypot(a, 0.5), math.atan(a / 0.5))
        clean = 0.25 / (a * a + 0.25) * x + a * 0.5 / math.hypot(a, 0.5) * answer
        slope = 0.0 if k in (0, steps - 1) else 0.5 * (clean - before) / (math.log(sigma[k - 1] / a) / math.log(a / b))
        x, before = b / a * x - (b / a - 1) * (clean + slope), clean
    return x


def _coarse_tile(steps: int = 20, size: int = 16):
    """A tile function: solver steps with the stub, weighted for blending."""
    weights = np.outer(ramp(size), ramp(size))
    return lambda wi, wj, source: _solved(source * 1.0, steps) * weights


def _flow(x: np.ndarray, t: float) -> np.ndarray:
    """One step of flow matching from a noisy sample, in units of the data's scale; the model's answer is negated."""
    answer = -stub(x / diffusion.DATA, t)
    return (math.cos(t) * x - math.sin(t) * diffusion.DATA * answer) / diffusion.DATA


def _noise(base: int, wi: int, wj: int, rows: WindowSpec, cols: WindowSpec) -> np.ndarray:
    """The noise of a window, which depends on the absolute cell only: tiles of a window's size are cut together."""
    h, w = rows.size, cols.size
    i0, j0 = wi * rows.step + rows.offset, wj * cols.step + cols.offset
    out = np.empty((h, w))
    for ty in range(i0 // h, (i0 + h - 1) // h + 1):
        for tx in range(j0 // w, (j0 + w - 1) // w + 1):
            seed = int(rng.tile_seeds(base, np.array([ty]), np.array([tx]))[0])
            tile = rng.normals(seed, h * w).reshape(h, w)
            r0, c0, r1, c1 = max(i0, ty * h), max(j0, tx * w), min(i0 + h, ty * h + h), min(j0 + w, tx * w + w)
            out[r0 - i0 : r1 - i0, c0 - j0 : c1 - j0] = tile[r0 - ty * h : r1 - ty * h, c0 - tx * w : c1 - tx * w]
    return out


def _latent_batch(rows: WindowSpec, cols: WindowSpec, t: float, base: int):
    """A batched tile function: the previous sample (none for the first stage) and noise on the circle at ``t``, and one flow step."""
    weights = np.outer(ramp(rows.size), ramp(cols.size))

    def compute(at: list[tuple[int, int]], coarse: np.ndarray, *before: np.ndarray) -> np.ndarray:
        noise = np.stack([_noise(base, wi, wj, rows, cols) for wi, wj in at]) * diffusion.DATA
        sample = before[0] / diffusion.DATA if before else np.zeros_like(noise)
        x = math.cos(t) * sample + math.sin(t) * noise
        # The coarse cell under each latent cell stands for the conditioning.
        return (_flow(x, t) + coarse.repeat(2, 1).repeat(2, 2) / 100) * weights

    return compute


def _decoder_tile(rows: WindowSpec, cols: WindowSpec, t: float, base: int, ratio: int):
    """A tile function: latents enlarged to the nearest, noise, and one flow step from it."""
    weights = np.outer(ramp(rows.size), ramp(cols.size))

    def compute(wi: int, wj: int, latents: np.ndarray) -> np.ndarray:
        x = math.sin(t) * diffusion.DATA * _noise(base, wi, wj, rows, cols)
        return (_flow(x, t) + latents.repeat(ratio, 0).repeat(ratio, 1)) * weights

    return compute


#: Noise levels of the two latent stages and the decoder, and what is added to the seed for each (fixed values).
LATENT_TIMES, SEEDS = (math.atan(160), math.atan(0.7)), (5819, 5820, 5819)


def decoder_graph(spark, d):
    """Four stages over the whole table: cells, coarse windows through the solver, two latent stages in batches of four, and the decoder.

    Coarse windows are 8 by 6; latents are twice as fine in windows of 16 by 12, the second stage reads the first; decoded windows
    are four times as fine as latents, 64 by 48.  Every stage is blended by its weights where it is read.
    """
    height = height_of(spark, d)
    store = tensor.Store(spark)
    tiles = WindowSpec(32)
    base = store.get_or_create(tensor.Node("cells", tiles, tiles, lambda wi, wj: np.zeros((32, 32))))
    store.put(base, tensor.tiles_from(event_grid(spark, d), base))
    hop, fine, wide = WindowSpec(8, 6), WindowSpec(16, 12), WindowSpec(64, 48)
    coarse = tensor.Node("coarse", hop, hop, _coarse_tile(20, 8), [base], [hop], [hop])
    below, around = (np.outer(w, w) for w in map(overlapping, (hop, fine)))
    first = _latent_batch(fine, fine, LATENT_TIMES[0], 42 + SEEDS[0])
    second = _latent_batch(fine, fine, LATENT_TIMES[1], 42 + SEEDS[1])
    init = tensor.Node("latent_init", fine, fine, lambda at, c: first(at, c / below), [coarse], [hop], [hop], batch=4)
    step = tensor.Node("latent_step", fine, fine, lambda at, c, n: second(at, c / below, n / around), [coarse, init], [hop, fine], [hop, fine], batch=4)
    decode = _decoder_tile(wide, wide, LATENT_TIMES[0], 42 + SEEDS[2], 4)
    decoder = tensor.Node("decoder", wide, wide, lambda wi, wj, n: decode(wi, wj, n / around), [step], [fine], [fine])
    num = tensor.slice_node(store, decoder, 0, 8 * height, 0, 8 * DAYS, keep=False)
    den = blend.total_weight("i", wide) * blend.total_weight("j", wide)
    return num.select("i", "j", (F.round(F.when(den > 1e-6, F.col("v") / den).otherwise(0.0), 5) + 0.0).alias("v"))


def model_graph(spark, d):
    """Cells to coarse windows (16 by 12) through the stub solver, blended by weight over the whole table: each window reads the cells below it."""
    store = tensor.Store(spark)
    tiles, hop = WindowSpec(32), WindowSpec(16, 12)
    base = store.get_or_create(tensor.Node("cells", tiles, tiles, lambda wi, wj: np.zeros((32, 32))))
    store.put(base, tensor.tiles_from(event_grid(spark, d), base))
    coarse = tensor.Node("coarse", hop, hop, _coarse_tile(), [base], [hop], [hop])
    num = tensor.slice_node(store, coarse, 0, height_of(spark, d), 0, DAYS)
    den = blend.total_weight("i", hop) * blend.total_weight("j", hop)
    return num.select("i", "j", F.round(F.when(den > 1e-6, F.col("v") / den).otherwise(0.0), 6).alias("v"))


MODEL_GRAPH = f"""WITH RECURSIVE {DENSE.replace('dense AS (', 'dense AS MATERIALIZED (')},
ramp AS (SELECT pow(80e0, 1 / 7e0) AS hi, pow(0.002e0, 1 / 7e0) AS lo), s AS (SELECT k, CASE WHEN k < 20 THEN pow(hi + k / 19e0 * (lo - hi), 7) ELSE 0e0 END AS s FROM ramp, (SELECT unnest(range(0, 21)) AS k)),
st AS (SELECT a.k, a.s AS now, b.s AS then_, z.s AS last, sqrt(a.s * a.s + 25e-2) AS n FROM s a JOIN s b ON b.k = a.k + 1 LEFT JOIN s z ON z.k = a.k - 1),
r AS (SELECT i, j, 0 AS k, v AS x, 0e0 AS old FROM dense
  UNION ALL SELECT i, j, k + 1, then_ / now * x - (then_ / now - 1) * (clean + CASE WHEN k IN (0, 19) THEN 0e0 ELSE 5e-1 * (clean - old) / (ln(last / now) / ln(now / then_)) END), clean
  FROM (SELECT i, j, k, x, old, now, then_, last, 25e-2 / (n * n) * x + now * 5e-1 / n * 5e-1 * cos(atan(now / 5e-1)) * x / n AS clean FROM r JOIN st USING (k))),
w AS (SELECT unnest(range(-2, CAST(greatest((SELECT h FROM size) // 12, 3) + 2 AS BIGINT))) AS w),
p AS (SELECT i, j, x, (1e0 - 0.999e0 * least(1e0, abs(i - a.w * 12 - 7.5e0) / 7.5e0)) * (1e0 - 0.999e0 * least(1e0, abs(j - b.w * 12 - 7.5e0) / 7.5e0)) AS wt
  FROM r JOIN w a ON i >= a.w * 12 AND i < a.w * 12 + 16 JOIN w b ON j >= b.w * 12 AND j < b.w * 12 + 16 WHERE k = 20)
SELECT i, j, round(sum(x * wt) / sum(wt), 6) + 0e0 AS v FROM p GROUP BY i, j"""


QUERIES = {"elevation_assembly": (elevation_assembly, None), "climate_assembly": (climate_assembly, None), "model_graph": (model_graph, MODEL_GRAPH), "decoder_graph": (decoder_graph, None)}
