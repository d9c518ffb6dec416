"""Plans over tensor graphs with a channel axis: slices by channel, many requests, many worlds, and a region from end to end."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import rng
from ..operators import classify, diffusion, layers, parts, raster, search, stats
from ..operators.layers import Layer, Read, TileStore
from ..operators.shared import Shared
from ..operators.windows import WindowSpec
from .assembly import climate_channels, elevation
from .tables import CHANNELS, DAYS, EVENTS, channel_grid, height_of, table

#: Event types in order: the value channels of the source grids.
TYPES = ["click", "error", "purchase", "signup", "view"]
HOP = WindowSpec(8, 6)


def type_cells(spark: SparkSession, d: str) -> DataFrame:
    """Cells (seed 0, i, j) with the mean value of each event type, and their number of types."""
    wide = stats.channel_pivot(channel_grid(spark, d), TYPES)
    n = sum((F.when(F.col(t).isNotNull(), 1.0).otherwise(0.0) for t in TYPES), F.lit(0.0))
    return wide.select(F.lit(0).cast("long").alias("seed"), "i", "j", *[F.coalesce(t, F.lit(0.0)).alias(t) for t in TYPES], n.alias("types"))


def _relative(key: layers.Window, cells: np.ndarray) -> np.ndarray:
    """Six channels, each its own multiple, less the window's mean of the first; and the weight."""
    return layers.weighted(cells * np.arange(1, 7)[:, None, None] - cells[0].mean())


def seven_channels(store: TileStore, spark: SparkSession, d: str) -> Layer:
    """A layer of six weighted channels and the weight, over a source of the event types."""
    tile = WindowSpec(16)
    source = store.layer(Layer("types", 6, tile, tile, None))
    store.put(source, layers.from_cells(source, type_cells(spark, d), [*TYPES, "types"]))
    return store.layer(Layer("seven", 7, HOP, HOP, _relative, {"cells": Read(source, HOP, HOP)}))


def _whole(spark: SparkSession, i0: int, i1: int, j0: int, j1: int, seed: int = 0) -> DataFrame:
    """One request."""
    return spark.range(1).select(F.col("id").alias("request"), *[F.lit(v).cast("long").alias(n) for n, v in (("seed", seed), ("i0", i0), ("i1", i1), ("j0", j0), ("j1", j1))])


def channel_slice(spark, d):
    """Channels 2 to 6 of the seven-channel layer over the whole table: weighted sums, and the weight as the last channel."""
    store = TileStore(spark)
    layer = seven_channels(store, spark, d)
    cells = layers.slices(store, layer, _whole(spark, 0, height_of(spark, d), 0, DAYS), 2, 7)
    return cells.select("i", "j", *[(F.round(f"c{k}", 5) + 0.0).alias(f"c{k}") for k in range(2, 7)])


_SPAN = "w AS (SELECT unnest(range(-2, CAST(greatest((SELECT max(user_id) FROM events) // 6, 6) + 2 AS BIGINT))) AS w)"
_SEVEN = (
    f"WITH {CHANNELS}, size AS (SELECT CAST(max(user_id) + 1 AS BIGINT) AS h FROM events), {_SPAN}, "
    "k AS (SELECT unnest(range(0, 5)) AS k, unnest(['click', 'error', 'purchase', 'signup', 'view']) AS ch), "
    "src AS (SELECT k, i, j, v FROM cg JOIN k USING (ch) UNION ALL SELECT 5, i, j, count(*) FROM cg GROUP BY i, j), "
    "fr AS (SELECT k, a.i, b.j FROM (SELECT unnest(range(0, (SELECT h FROM size))) AS i) a, (SELECT unnest(range(0, 31)) AS j) b, (SELECT unnest(range(0, 6)) AS k)), "
    "cells AS (SELECT fr.k, fr.i, fr.j, coalesce(v, 0e0) * (fr.k + 1) AS v FROM fr LEFT JOIN src USING (k, i, j)), "
    "m AS (SELECT a.w AS wi, b.w AS wj, sum(v) / 64e0 AS m FROM src JOIN w a ON i >= a.w * 6 AND i < a.w * 6 + 8 JOIN w b ON j >= b.w * 6 AND j < b.w * 6 + 8 WHERE k = 0 GROUP BY 1, 2), "
    "blend AS (SELECT i, j, sum(wt) AS wt, sum(wt * coalesce(m, 0e0)) AS wm FROM (SELECT i, j, a.w AS wi, b.w AS wj, "
    "(1e0 - 0.999e0 * least(1e0, abs(i - a.w * 6 - 3.5e0) / 3.5e0)) * (1e0 - 0.999e0 * least(1e0, abs(j - b.w * 6 - 3.5e0) / 3.5e0)) AS wt FROM (SELECT DISTINCT i, j FROM fr) "
    "JOIN w a ON i >= a.w * 6 AND i < a.w * 6 + 8 JOIN w b ON j >= b.w * 6 AND j < b.w * 6 + 8) LEFT JOIN m USING (wi, wj) GROUP BY i, j), "
    "seven AS (SELECT k, c.i, c.j, v * wt - wm AS v, wt FROM cells c JOIN blend USING (i, j))"
)
CHANNEL_SLICE = f"{_SEVEN} SELECT i, j, " + ", ".join(f"round(max(v) FILTER (k = {k}), 5) + 0e0 AS c{k}" for k in range(2, 6)) + ", round(max(wt), 5) + 0e0 AS c6 FROM seven GROUP BY i, j"


def order_requests(spark, d, height: int) -> DataFrame:
    """A rectangle for each order: overlapping places of the grid, a few cells wide."""
    o = table(spark, d, "orders")
    i0, j0 = F.col("o_custkey") % height, F.col("o_orderkey") % 29
    ends = {"i0": i0, "i1": F.least(i0 + F.col("o_orderkey") % 7 + 2, F.lit(height)), "j0": j0, "j1": F.least(j0 + F.col("o_custkey") % 5 + 1, F.lit(DAYS))}
    return o.select(F.col("o_orderkey").cast("long").alias("request"), F.lit(0).cast("long").alias("seed"), *[v.cast("long").alias(k) for k, v in ends.items()])


def request_slices(spark, d):
    """A slice for each order in one plan: cells, and the mean of the fourth channel over its weights."""
    store = TileStore(spark)
    layer = seven_channels(store, spark, d)
    cells = layers.slices(store, layer, order_requests(spark, d, height_of(spark, d)), 3, 7)
    return cells.groupBy("request").agg(F.count("*").alias("cells"), F.round(F.sum("c3") / F.sum("c6") + 1e-7, 4).alias("mean"), F.min("i").alias("i0"), F.max("j").alias("j1"))


_REQUESTS = (
    "q0 AS (SELECT o_orderkey AS request, o_custkey % h AS i0, o_orderkey % 29 AS j0, o_orderkey % 7 + 2 AS n, o_custkey % 5 + 1 AS m, h FROM orders, size), "
    "q AS (SELECT request, i0, least(i0 + n, h) AS i1, j0, least(j0 + m, 31) AS j1 FROM q0)"
)
REQUEST_SLICES = (
    f"{_SEVEN}, {_REQUESTS} SELECT request, count(*) AS cells, round(sum(v) / sum(wt) + 1e-7, 4) AS mean, min(i) AS i0, max(j) AS j1 "
    "FROM q JOIN seven ON i >= i0 AND i < i1 AND j >= j0 AND j < j1 WHERE k = 3 GROUP BY request"
)


def request_windows(spark, d):
    """The windows that all orders' requests together made the layer compute."""
    store = TileStore(spark)
    layer = seven_channels(store, spark, d)
    layers.ensure(store, [(layer, layers.windows_of(order_requests(spark, d, height_of(spark, d)), HOP, HOP))])
    return store.tiles(layer).groupBy("wi", "wj").agg(F.count("*").alias("computed"), F.max(F.size("data")).alias("numbers"))


REQUEST_WINDOWS = (
    f"WITH {EVENTS}, size AS (SELECT CAST(max(user_id) + 1 AS BIGINT) AS h FROM events), {_SPAN}, {_REQUESTS} "
    "SELECT DISTINCT a.w AS wi, b.w AS wj, CAST(1 AS BIGINT) AS computed, 448 AS numbers FROM q JOIN w a ON a.w * 6 < i1 AND a.w * 6 + 8 > i0 JOIN w b ON b.w * 6 < j1 AND b.w * 6 + 8 > j0"
)


def _patch_tile(key: layers.Window) -> np.ndarray:
    """Two channels of noise of the window's own world."""
    return rng.patch(key.seed, key.wi * 8, key.wj * 8, 8, 8, 2, (8, 8))


def world_patches(spark, d):
    """A world for each supplier, all in one plan: the supplier is the seed, and asks for noise around its own place."""
    store, tile = TileStore(spark), WindowSpec(8)
    s = table(spark, d, "lineitem").groupBy(F.col("l_suppkey").cast("long").alias("request")).agg(F.count("*").alias("n"))
    i0, j0 = F.col("request") % 23 - 11, F.col("n") % 17 - 8
    asks = s.select("request", F.col("request").alias("seed"), i0.alias("i0"), (i0 + 5).alias("i1"), j0.alias("j0"), (j0 + 6).alias("j1"))
    cells = layers.slices(store, store.layer(Layer("patch", 2, tile, tile, _patch_tile)), asks)
    return cells.select("request", "i", "j", (F.round("c0", 5) + 0.0).alias("c0"), (F.round("c1", 5) + 0.0).alias("c1"))


_STEPS = 400
WORLD_PATCHES = f"""WITH RECURSIVE q AS (SELECT l_suppkey AS request, l_suppkey % 23 - 11 AS i0, count(*) % 17 - 8 AS j0 FROM lineitem GROUP BY 1, 2),
c AS (SELECT request, i0 + a AS i, j0 + b AS j, CAST(floor((i0 + a) / 8e0) AS BIGINT) AS ty, CAST(floor((j0 + b) / 8e0) AS BIGINT) AS tx FROM q, (SELECT unnest(range(0, 5)) AS a), (SELECT unnest(range(0, 6)) AS b)),
t AS (SELECT DISTINCT request, ty, tx, ((request * {rng.GOLDEN} + (ty & 4294967295))::HUGEINT * {rng.GOLDEN} + (tx & 4294967295)) % 18446744073709551616 AS s FROM c),
st AS (SELECT request, ty, tx, 0 AS k, s FROM t UNION ALL SELECT request, ty, tx, k + 1, (s * {rng.STEP}::HUGEINT + {rng.ADD}) % 18446744073709551616 FROM st WHERE k < {_STEPS}),
o AS (SELECT request, ty, tx, k - 1 AS k, (xor(CAST(s AS UBIGINT) >> 18, CAST(s AS UBIGINT)) >> 27) & 4294967295 AS x, CAST(s AS UBIGINT) >> 59 AS r FROM st WHERE k > 0),
u AS (SELECT request, ty, tx, k // 2 AS p, k % 2 AS side, 2e0 * ((((x >> r) | ((x << ((32 - r) & 31)) & 4294967295)) & 4294967295) + 1e0) / 4294967296e0 - 1e0 AS u FROM o),
v AS (SELECT request, ty, tx, p, max(u) FILTER (side = 0) AS a, max(u) FILTER (side = 1) AS b FROM u GROUP BY ALL),
n AS (SELECT request, ty, tx, a, b, sqrt(-2e0 * ln(a * a + b * b) / (a * a + b * b)) AS f, row_number() OVER (PARTITION BY request, ty, tx ORDER BY p) - 1 AS m FROM v WHERE a * a + b * b > 0 AND a * a + b * b < 1),
z AS (SELECT request, ty, tx, 2 * m AS k, a * f AS v FROM n UNION ALL SELECT request, ty, tx, 2 * m + 1, b * f FROM n)
SELECT c.request, c.i, c.j, round(CAST(max(z.v) FILTER (z.k < 64) AS FLOAT)::DOUBLE, 5) + 0e0 AS c0, round(CAST(max(z.v) FILTER (z.k >= 64) AS FLOAT)::DOUBLE, 5) + 0e0 AS c1
FROM c JOIN z ON z.request = c.request AND z.ty = c.ty AND z.tx = c.tx AND z.k % 64 = (c.i - c.ty * 8) * 8 + c.j - c.tx * 8 AND z.k < 128 GROUP BY c.request, c.i, c.j"""


#: Means and deviations of the conditioning image's seven channels, and of the low frequencies (fixed values).
COND_MEANS, COND_STDS = (14.99, 11.65, 15.87, 619.26, 833.12, 69.40, 0.66), (21.72, 21.78, 10.40, 452.29, 738.09, 34.59, 0.47)
LOW_MEAN, LOW_STD = -31.4, 38.6
#: Lengths of the parts of a conditioning vector (fixed values), and the part that stands for a histogram.
PARTS, HISTOGRAM = (16, 16, 4, 16, 5, 1), (0.0, 0.0, 0.0, 0.0, 0.0)
_IMAGE_MEANS, _IMAGE_STDS = np.array(COND_MEANS)[:, None, None], np.array(COND_STDS)[:, None, None]
_SCALE, _LENGTHS = math.sqrt(sum(PARTS) * len(PARTS)) / len(PARTS), np.repeat(np.sqrt(PARTS), PARTS)
#: Signal to noise of the five conditioning channels, and the residual's mean and deviation: parameters of a model.
SNR, RESIDUAL = (0.5, 0.5, 0.5, 0.5, 0.5), (0.0, 1.1678)
#: Noise levels of the latent stages and the decoder, and what is added to the world's seed for each (fixed values).
FIRST, SECOND, LATENT_SEED, STEP_SEED = math.atan(diffusion.HIGH / diffusion.DATA), math.atan(0.35 / diffusion.DATA), 5819, 5820
#: Latent cells a coarse cell and native cells a latent one.
FINE, NATIVE = 4, 2


def stub_coarse(x: np.ndarray, label: float, image: np.ndarray) -> np.ndarray:
    """A linear stand-in for the coarse model: six channels, and five of a conditioning image."""
    return 0.5 * math.cos(label) * x + 0.4 * image[[0, 0, 1, 2, 3, 4]]


def stub_latent(x: np.ndarray, t: float, vectors: np.ndarray) -> np.ndarray:
    """A linear stand-in for the latent model: a batch of five channels, and a vector of 58 for each."""
    parts = ((16, 32), (32, 36), (36, 52), (52, 58), (0, 16))  # the last channel follows the heights
    return 0.5 * math.cos(t) * x + np.stack([vectors[:, a:b].mean(1) for a, b in parts], 1)[:, :, None, None] * np.array([0.3, 0.3, 0.3, 0.3, 3.0])[:, None, None]


def stub_decoder(x: np.ndarray, t: float, latents: np.ndarray) -> np.ndarray:
    """A linear stand-in for the decoder: one channel, and four of latents under it."""
    return 0.5 * math.cos(t) * x + 0.02 * latents.sum(0)


def _over(a: np.ndarray) -> np.ndarray:
    """Channels over their weight, the last channel."""
    v, w = a[..., :-1, :, :], a[..., -1:, :, :]
    return np.divide(v, w, out=np.zeros(v.shape), where=w > 1e-6)


def coarse_tile(model=stub_coarse, steps: int = 20, size: int = 8, step: int = 6):
    """Tile function: a map of five channels becomes a conditioning image, and the solver makes six channels of noise."""
    means, stds = (np.array(x[:6])[:, None, None] for x in (COND_MEANS, COND_STDS))
    near, far = (f(np.arctan(np.array(SNR)))[:, None, None] for f in (np.cos, np.sin))

    def compute(key: layers.Window, image: np.ndarray) -> np.ndarray:
        place = (key.wi * step, key.wj * step, size, size)
        image = image.copy()
        image[1] = np.where(image[1] <= 20, (image[1] - 20) * 1.25 + 20, image[1])
        image = (image - means[[0, 2, 3, 4, 5]]) / stds[[0, 2, 3, 4, 5]]
        image = near * image + far * rng.patch(key.seed, *place, 5, (size, size))
        sample = diffusion.solve_array(rng.patch(key.seed + 1, *place, 6, (size, size)) * diffusion.HIGH, lambda x, label: model(x, label, image), steps)
        out = sample / diffusion.DATA * stds + means
        out[1] = out[0] - out[1]
        return layers.weighted(out)

    return compute


def condition(key: layers.Window, coarse: np.ndarray) -> np.ndarray:
    """Tile function of single cells: the vector of 58 that a latent window is conditioned on, from the 4 x 4 coarse cells around it."""
    image = np.ones((7, 4, 4))
    image[:6] = _over(coarse)
    image = (image - _IMAGE_MEANS) / _IMAGE_STDS
    parts = (image[0].ravel(), image[1].ravel(), image[2:6, 1:3, 1:3].sum((1, 2)) / 4, image[6].ravel(), HISTOGRAM, (-0.5 * math.sqrt(12),))
    return (np.concatenate(parts) * _SCALE / _LENGTHS)[:, None, None]


def latent_batch(t: float, add: int, model=stub_latent, size: int = 2 * FINE):
    """Batched tile function: the sample of the stage before (none for the first) and noise, one flow step, five channels and the weight."""

    def compute(at: list[layers.Window], vector: np.ndarray, before: np.ndarray | None = None) -> np.ndarray:
        sample = 0.0 if before is None else _over(before) * diffusion.DATA
        noise = np.stack([rng.patch(k.seed + add, k.wi * size // 2, k.wj * size // 2, size, size, 5, (size, size)) for k in at])
        x = math.cos(t) * sample + math.sin(t) * noise * diffusion.DATA
        return layers.weighted(diffusion.flow_array(x, model(x / diffusion.DATA, t, vector[:, :, 0, 0]), t))

    return compute


def decoder_tile(t: float, add: int, model=stub_decoder, size: int = 32, step: int = 24):
    """Tile function: latents enlarged to the nearest, noise, one flow step, one channel and the weight."""

    def compute(key: layers.Window, latents: np.ndarray) -> np.ndarray:
        under = _over(latents)[:4].repeat(NATIVE, 1).repeat(NATIVE, 2)
        x = math.sin(t) * diffusion.DATA * rng.patch(key.seed + add, key.wi * step, key.wj * step, size, size, 1, (size, size))
        return layers.weighted(diffusion.flow_array(x, model(x / diffusion.DATA, t, under)[:1], t))

    return compute


def world(store: TileStore) -> dict[str, Layer]:
    """The graph: map, coarse, vectors, two latent stages, decoder.  Vectors and, through them, both latent stages share the coarse layer."""
    tile, coarse_at, fine, wide, one = WindowSpec(16), WindowSpec(8, 6), WindowSpec(2 * FINE, FINE), WindowSpec(32, 24), WindowSpec(1)
    near, under = WindowSpec(4, 1, -1), WindowSpec(32 // NATIVE, 24 // NATIVE)
    source = store.layer(Layer("map", 5, tile, tile, None))
    coarse = store.layer(Layer("coarse", 7, coarse_at, coarse_at, coarse_tile(), {"image": Read(source, coarse_at, coarse_at)}))
    vector = store.layer(Layer("vector", 58, one, one, condition, {"coarse": Read(coarse, near, near)}))
    first = store.layer(Layer("first", 6, fine, fine, latent_batch(FIRST, LATENT_SEED), {"vector": Read(vector, one, one)}, batch=4))
    reads = {"vector": Read(vector, one, one), "before": Read(first, fine, fine)}
    latents = store.layer(Layer("latents", 6, fine, fine, latent_batch(SECOND, STEP_SEED), reads, batch=4))
    decoder = store.layer(Layer("decoder", 2, wide, wide, decoder_tile(FIRST, LATENT_SEED), {"latents": Read(latents, under, under)}))
    return {x.id: x for x in (source, coarse, vector, first, latents, decoder)}


def map_cells(spark: SparkSession, d: str, seed: int) -> DataFrame:
    """The map of a world from event means: the root of heights, temperature, its season, rain, and its spread."""
    c = type_cells(spark, d)
    shaped = {"root": (F.col("click") - 40.0) / 2.0, "temp": F.col("error") / 4.0, "season": F.col("purchase") * 4.0 + 100.0, "rain": F.col("signup") * 9.0, "spread": F.col("view") / 2.0 + 10.0}
    return c.select(F.lit(seed).cast("long").alias("seed"), "i", "j", *[v.alias(k) for k, v in shaped.items()])


def region(store: TileStore, graph: dict[str, Layer], seed: int, h: int, w: int) -> DataFrame:
    """Heights and climate of all native cells (i, j, elev, temp, t_season, precip, p_cv, beta) above ``h`` x ``w`` coarse cells from 0.

    Decoder, latents and coarse windows are asked for together, so what they share is computed once.
    """
    spark, unit, pad, edge = store.spark, FINE * NATIVE, 6, 8
    low_shape = (FINE * h + 2 * pad, FINE * w + 2 * pad)
    ends = {
        "decoder": (-NATIVE * pad, unit * h + NATIVE * pad, -NATIVE * pad, unit * w + NATIVE * pad),
        "latents": (-pad, FINE * h + pad, -pad, FINE * w + pad), "coarse": (-edge, h + edge, -edge, w + edge),
    }
    asks = {k: _whole(spark, *e, seed) for k, e in ends.items()}
    layers.ensure(store, [(graph[k], layers.windows_of(a, graph[k].rows, graph[k].cols)) for k, a in asks.items()])
    at = {k: layers.rectangle(graph[k], store.tiles(graph[k]).where(F.col("seed") == seed), *ends[k], 0, graph[k].channels) for k in asks}
    moved = lambda df, n: df.withColumns({"i": F.col("i") + n, "j": F.col("j") + n})
    residual = moved(at["decoder"], NATIVE * pad).select("i", "j", (layers.unweighted("c0", "c1") * RESIDUAL[1] + RESIDUAL[0]).alias("v"))
    low = moved(at["latents"], pad).select("i", "j", (layers.unweighted("c4", "c5") * LOW_STD + LOW_MEAN).alias("v"))
    heights = store.held(elevation(store.held(residual), low, low_shape, NATIVE, pad).withColumnRenamed("v", "elev"))
    names = {"root": 0, "t": 2, "t_season": 3, "precip": 4, "p_cv": 5}
    coarse = store.held(moved(at["coarse"], edge).select("i", "j", *[layers.unweighted(f"c{k}", "c6").alias(n) for n, k in names.items()]))
    return climate_channels(coarse, (h + 2 * edge, w + 2 * edge), heights, unit)


#: Native cells a coarse cell; latent cells that heights reach beyond the region, and coarse cells that its climate does.
UNIT, PAD, EDGE = FINE * NATIVE, 6, 8
#: Coarse cells on a side of the windows that the climate is fitted in, and of the blocks that a task computes at once.
FIT, SIDE = 15, 64
TAPS = raster.kernel_truncated(5.0)


class _Axis:
    """What a block's native cells of ``n`` coarse cells take along one axis, step by step from slopes back to the layers.

    Heights and slopes are counted from the region's first cell; what is resized (``full``, ``smooth``, ``low``) from ``PAD`` latent cells before it.
    """

    def __init__(self, block: int, n: int, side: int) -> None:
        self.n, self.low_n = n, FINE * n + 2 * PAD
        self.full_n, self.fits = NATIVE * self.low_n, n + 2 * EDGE - FIT + 1
        self.own = UNIT * side * block, min(UNIT * n, UNIT * side * (block + 1))
        self.heights = parts.sobel_reads(self.own, UNIT * n)
        self.full = tuple(k + NATIVE * PAD for k in self.heights)
        self.smooth = parts.resize_reads(self.full, self.low_n, self.full_n)
        self.down = parts.blur_reads(self.smooth, self.low_n, TAPS)
        reads = parts.resize_reads(self.down, self.full_n, self.low_n)
        self.whole = min(reads[0], self.full[0]), max(reads[1], self.full[1])
        self.low = parts.enlarge_reads(self.whole, self.low_n, NATIVE)
        self.points = (np.arange(*self.own) + 0.5) / UNIT + 0.5
        self.base = parts.sample_reads(self.points, self.fits)
        # In the layers' own cells.
        self.decoder = tuple(k - NATIVE * PAD for k in self.whole)
        self.latents = tuple(k - PAD for k in self.low)
        self.coarse = self.base[0] - EDGE, self.base[1] + FIT - 1 - EDGE


def _block_wants(graph: dict[str, Layer], y: _Axis, x: _Axis) -> list[tuple[Layer, layers.Rectangle]]:
    return [(graph[k], (*getattr(y, k), *getattr(x, k))) for k in ("decoder", "latents", "coarse")]


def block_tile(graph: dict[str, Layer], h: int, w: int, side: int, before: int):
    """Function of a block: the map around it becomes its native cells, by the graph's windows and the steps of :func:`region`, and slopes."""

    def heights(residual: np.ndarray, low: np.ndarray, y: _Axis, x: _Axis) -> np.ndarray:
        def along(step, a: np.ndarray, source: str, target: str, *of) -> np.ndarray:
            for axis, at in ((-1, x), (-2, y)):
                a = step(a, axis, getattr(at, source)[0], getattr(at, target), *[getattr(at, n) if isinstance(n, str) else n for n in of])
            return a

        whole = residual + along(parts.enlarge, low, "low", "whole", "low_n", NATIVE)
        smooth = along(parts.blur, along(parts.resize, whole, "whole", "down", "full_n", "low_n"), "down", "smooth", "low_n", TAPS)
        rest = residual[y.full[0] - y.whole[0] : y.full[1] - y.whole[0], x.full[0] - x.whole[0] : x.full[1] - x.whole[0]]
        v = rest + along(parts.resize, smooth, "smooth", "full", "low_n", "full_n")
        return np.sign(v) * v * v

    def compute(key: layers.Window, cells: np.ndarray) -> dict[str, np.ndarray]:
        y, x = _Axis(key.wi, h, side), _Axis(key.wj, w, side)
        given = {"map": (cells, key.wi * side - before, key.wj * side - before)}
        decoded, latents, coarse = layers.within(_block_wants(graph, y, x), key.seed, given)
        elev = heights(_over(decoded)[0] * RESIDUAL[1] + RESIDUAL[0], _over(latents)[4] * LOW_STD + LOW_MEAN, y, x)
        slope = parts.sobel(elev, (y.heights[0], x.heights[0]), y.own, x.own, (UNIT * h, UNIT * w), 30.0)
        elev = elev[y.own[0] - y.heights[0] :, x.own[0] - x.heights[0] :][: slope.shape[0], : slope.shape[1]]
        root, _, t, *rest = _over(coarse)
        beta, sea = parts.windowed_baseline(t, np.maximum(root, 0.0) ** 2, FIT)
        middle = [v[FIT // 2 : FIT // 2 + beta.shape[0], FIT // 2 : FIT // 2 + beta.shape[1]] for v in rest]
        beta, sea, season, precip, cv = (parts.sample(v, (y.base[0], x.base[0]), y.points, x.points, (y.fits, x.fits)) for v in (beta, sea, *middle))
        i, j = np.meshgrid(np.arange(*y.own), np.arange(*x.own), indexing="ij")
        found = {"i": i, "j": j, "elev": elev, "temp": sea + beta * np.maximum(elev, 0.0), "t_season": season, "precip": precip, "p_cv": cv, "beta": beta, "slope": slope}
        return {k: np.ascontiguousarray(v).ravel() for k, v in found.items()}

    return compute


def region_blocks(store: TileStore, graph: dict[str, Layer], seed: int, h: int, w: int, side: int = SIDE) -> DataFrame:
    """As :func:`region`, and slopes, for a region that is asked for once: nothing is kept of what lies between the map and the cells.

    A block of native cells takes the map's cells that its windows reach, which is the one shuffle, and a task computes it
    from end to end.  Layers, overlaps and steps are those of :func:`region`; what neighbouring blocks both reach is computed in both.
    """
    rows, cols = -(-h // side), -(-w // side)
    asked = [(key, layers.reach(_block_wants(graph, _Axis(key[0], h, side), _Axis(key[1], w, side)))[0]["map"]) for key in np.ndindex(rows, cols)]
    before = max(0, *[side * k - first for (wi, wj), (i0, _, j0, _) in asked for k, first in ((wi, i0), (wj, j0))])
    after = max(0, *[last - side * (k + 1) for (wi, wj), (_, i1, _, j1) in asked for k, last in ((wi, i1), (wj, j1))])
    whole, halo = WindowSpec(side), WindowSpec(side + before + after, side, -before)
    block = Layer("block", 1, whole, whole, block_tile(graph, h, w, side, before), {"cells": Read(graph["map"], halo, halo)})
    windows = layers.windows_of(_whole(store.spark, 0, h, 0, w, seed), whole, whole)
    names = ["elev", "temp", "t_season", "precip", "p_cv", "beta", "slope"]
    return layers.rows_of(store, block, windows, "i long, j long, " + ", ".join(f"{n} double" for n in names), min(rows * cols, 1024))


def world_region(spark, d):
    """All rows of the table from end to end: map, coarse windows, vectors, latents, decoder, heights, climate, classes."""
    seed, store, h = 42, TileStore(spark), height_of(spark, d)
    graph = world(store)
    store.put(graph["map"], layers.from_cells(graph["map"], map_cells(spark, d, seed), ["root", "temp", "season", "rain", "spread"]))
    still = {n: F.lit(0.0) for n in ("n_temp", "n_precip", "n_snow")}
    out = classify.classify(region_blocks(store, graph, seed, h, DAYS).withColumns(still))
    return out.select("i", "j", classify.to_int16(F.col("elev")).cast("int").alias("height_m"), F.col("class_id").cast("int").alias("class_id"))


def growing_search(spark, d):
    """The nearest cell to the middle of the table around which all cells have two event types at least, and how many windows it took."""
    store, h = TileStore(spark), height_of(spark, d)
    source = seven_channels(store, spark, d).reads["cells"].layer
    busy = store.layer(Layer("busy", 2, HOP, HOP, lambda key, n: layers.weighted(n - 1.5), {"n": Read(source, HOP, HOP, 5, 6)}))
    found = search.growing(store, busy, 0, h // 2, 15)
    return found.withColumn("windows", F.lit(store.computed(busy)).cast("long"))


GROWING_SEARCH = f"""WITH {CHANNELS}, size AS (SELECT CAST(max(user_id) + 1 AS BIGINT) AS h FROM events), land AS (SELECT i, j FROM cg GROUP BY i, j HAVING count(*) >= 2),
n AS (SELECT i + a AS i, j + b AS j FROM land, (SELECT unnest([-1, 0, 1]) AS a), (SELECT unnest([-1, 0, 1]) AS b)), c AS (SELECT i, j FROM n GROUP BY i, j HAVING count(*) = 9),
x AS (SELECT i, j, i - h // 2 AS di, j - 15 AS dj, h // 2 AS ci FROM c, size),
s AS (SELECT *, greatest(abs(di), abs(dj)) AS dist, greatest(16, 16 + 8 * CAST(ceil((2 * greatest(1 - di, di + 2, 1 - dj, dj + 2) - 16) / 8e0) AS BIGINT)) AS sz FROM x),
b AS (SELECT i, j, dist, sz, ci FROM s WHERE sz <= 128 ORDER BY sz, dist, di, dj LIMIT 1),
f AS (SELECT * FROM b UNION ALL SELECT h // 2, 15, -1, -1, h // 2 FROM size WHERE NOT EXISTS (SELECT 1 FROM b)),
r AS (SELECT *, CASE WHEN sz < 0 THEN 64 ELSE sz // 2 END AS half FROM f)
SELECT i, j, dist, sz AS size, CAST((floor((ci + half - 1) / 6e0) - ceil((ci - half - 7) / 6e0) + 1) * (floor((15 + half - 1) / 6e0) - ceil((15 - half - 7) / 6e0) + 1) AS BIGINT) AS windows FROM r"""

#: Levels of the tables by brand: nine from the least to the greatest.
LEVELS = [k / 8 for k in range(9)]


def _brand_tables(spark, d) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Parts (p_partkey, p_brand, v), and by brand the quantiles of their prices and of the prices they sold at."""
    shared = Shared(spark)
    parts = table(spark, d, "part").select("p_partkey", "p_brand", F.col("p_retailprice").cast("double").alias("v"))
    sold = table(spark, d, "lineitem").select(F.col("l_partkey").alias("p_partkey"), F.col("l_extendedprice").cast("double").alias("v")).join(parts.select("p_partkey", "p_brand"), "p_partkey")
    return parts, *(t.withColumn("q", stats.increasing(F.col("q"))) for t in (stats.quantile_rows(parts, "p_brand", LEVELS, shared), stats.quantile_rows(sold, "p_brand", LEVELS, shared)))


def quantile_by_brand(spark, d):
    """Exact quantile tables of every brand at once."""
    _, own, sold = _brand_tables(spark, d)
    rows = [t.select("p_brand", F.lit(name).alias("of"), "n", F.posexplode("q").alias("k", "q")) for name, t in (("list", own), ("sold", sold))]
    return rows[0].unionByName(rows[1]).withColumn("q", F.round(F.col("q") + 1e-7, 4))


_KNOTS = (
    "part_ AS (SELECT p_partkey, p_brand, CAST(p_retailprice AS DOUBLE) AS v FROM part), sold AS (SELECT p_brand, CAST(l_extendedprice AS DOUBLE) AS v FROM lineitem JOIN part ON p_partkey = l_partkey), "
    "lv AS (SELECT unnest(range(0, 9)) AS k), "
    + ", ".join(f"{t}q AS (SELECT p_brand, count(*) AS n, quantile_cont(v, [{', '.join(map(str, LEVELS))}]) AS q FROM {t} GROUP BY p_brand)" for t in ("part_", "sold"))
)
QUANTILE_BY_BRAND = f"WITH {_KNOTS} " + " UNION ALL ".join(f"SELECT p_brand, '{name}' AS \"of\", n, CAST(k AS INT) AS k, round(q[k + 1] + 1e-7, 4) AS q FROM {t}q, lv" for name, t in (("list", "part_"), ("sold", "sold")))


def match_by_brand(spark, d):
    """Each part's price taken to the same place among the prices that its brand sold at."""
    parts, own, sold = _brand_tables(spark, d)
    out = stats.match_rows(parts, "p_brand", own, sold, len(LEVELS))
    return out.select("p_partkey", F.round(F.col("matched") + 1e-6, 3).alias("matched"))


MATCH_BY_BRAND = f"""WITH {_KNOTS}, g AS (SELECT a.p_brand, k, a.q[k + 1] AS x0, a.q[k + 2] AS x1, b.q[k + 1] AS y0, b.q[k + 2] AS y1, a.q[9] AS xn, b.q[9] AS yn FROM part_q a JOIN soldq b USING (p_brand), lv WHERE k < 8)
SELECT p_partkey, round(max(CASE WHEN v >= xn THEN yn ELSE y0 + (v - x0) / (x1 - x0) * (y1 - y0) END) + 1e-6, 3) AS matched FROM part_ JOIN g USING (p_brand) WHERE (v >= x0 AND v < x1) OR (v >= xn AND k = 7) GROUP BY p_partkey"""


QUERIES = {
    "channel_slice": (channel_slice, CHANNEL_SLICE), "request_slices": (request_slices, REQUEST_SLICES), "request_windows": (request_windows, REQUEST_WINDOWS),
    "world_patches": (world_patches, WORLD_PATCHES), "world_region": (world_region, None),
    "growing_search": (growing_search, GROWING_SEARCH), "quantile_by_brand": (quantile_by_brand, QUANTILE_BY_BRAND), "match_by_brand": (match_by_brand, MATCH_BY_BRAND),
}
