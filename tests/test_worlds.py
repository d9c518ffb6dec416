"""Tensor graphs with a channel axis against whole arrays: channels, many requests, many worlds, and each window once."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillgrid.functions import rng
from quillgrid.operators import layers
from quillgrid.operators.layers import Layer, Read, TileStore, Window
from quillgrid.operators.windows import WindowSpec
from quillgrid.plans import worlds
from quillgrid.plans.assembly import climate_channels

H, W, EDGE = 9, 7, 16


def brute(layer, cut, seed, shape, origin, made=None):
    """Sums of all windows of a layer within an array whose first cell is ``origin``; ``cut(read, key)`` gives a window's inputs."""
    size, out = layer.rows.size, np.zeros((layer.channels, *shape))
    for wi in range(-(-origin // layer.rows.step), (shape[0] + origin - size) // layer.rows.step + 1):
        for wj in range(-(-origin // layer.cols.step), (shape[1] + origin - size) // layer.cols.step + 1):
            key = Window(seed, wi, wj)
            inputs = {n: cut(r, key) for n, r in layer.reads.items()}
            tile = layer.fn(key, **inputs) if layer.batch is None else layer.fn([key], **{n: a[None] for n, a in inputs.items()})[0]
            i, j = wi * layer.rows.step - origin, wj * layer.cols.step - origin
            out[:, i : i + size, j : j + size] += tile
    return out


def under(whole, origin):
    def cut(read, key):
        i, j = key.wi * read.rows.step + read.rows.offset - origin, key.wj * read.cols.step + read.cols.offset - origin
        return whole[read.channels[0] : read.channels[1], i : i + read.rows.size, j : j + read.cols.size]

    return cut


@pytest.fixture(scope="module")
def computed(spark):
    store = TileStore(spark)
    graph, seed = worlds.world(store), 11
    values = np.random.default_rng(2).uniform(-20, 60, (5, H, W)).round(3)
    rows = [(seed, i, j, *values[:, i, j].tolist()) for i, j in np.ndindex(H, W)]
    cells = spark.createDataFrame(rows, "seed long, i long, j long, a double, b double, c double, d double, e double")
    store.put(graph["map"], layers.from_cells(graph["map"], cells, list("abcde")))
    out = worlds.region(store, graph, seed, H, W).toPandas()
    far = np.zeros((5, H + 2 * EDGE * 2, W + 2 * EDGE * 2))
    far[:, 2 * EDGE : 2 * EDGE + H, 2 * EDGE : 2 * EDGE + W] = values
    yield store, graph, seed, far, out
    store.release()


def test_all_stages_match_whole_arrays(spark, computed):
    store, graph, seed, far, _ = computed
    origin, shape = -2 * EDGE, far.shape[1:]
    coarse = brute(graph["coarse"], under(far, origin), seed, shape, origin)
    vector = np.zeros((58, *shape))
    for i, j in np.ndindex(shape[0] - 4, shape[1] - 4):
        vector[:, i + 1, j + 1] = worlds.condition(None, coarse[:, i : i + 4, j : j + 4])[:, 0, 0]
    fine = tuple(worlds.FINE * n for n in shape)
    whole = {"vector": vector}
    for name in ("first", "latents"):
        places = {"vector": under(vector, origin), "before": under(whole.get("first"), worlds.FINE * origin)}
        layer = graph[name]
        names = {id(r): n for n, r in layer.reads.items()}
        # Windows at the rim would read vectors beyond the array.
        whole[name] = brute(layer, lambda r, k, at=places, n=names: at[n[id(r)]](r, k), seed, tuple(n - 4 * worlds.FINE for n in fine), worlds.FINE * origin)
    decoded = brute(graph["decoder"], under(whole["latents"], worlds.FINE * origin), seed, tuple(worlds.NATIVE * (n - 8 * worlds.FINE) for n in fine), worlds.NATIVE * worlds.FINE * origin)
    for name, want, start, r in (("coarse", coarse, origin, (-8, H + 8, -8, W + 8)), ("latents", whole["latents"], worlds.FINE * origin, (-6, 4 * H + 6, -6, 4 * W + 6)),
                                 ("decoder", decoded, 8 * origin, (-12, 8 * H + 12, -12, 8 * W + 12))):
        got = layers.cells_of(store, graph[name], worlds._whole(spark, *r, seed), 0, graph[name].channels).toPandas()
        assert len(got) == (r[1] - r[0]) * (r[3] - r[2])
        mine = got[[f"c{k}" for k in range(graph[name].channels)]].to_numpy().T
        assert np.allclose(mine, want[:, got["i"] - start, got["j"] - start], rtol=1e-9, atol=1e-9), name


def test_each_window_is_computed_once(spark, computed):
    store, graph, seed, _, _ = computed
    calls = {k: store.tiles(graph[k]).count() for k in ("coarse", "vector", "first", "latents", "decoder")}
    assert calls == {k: store.tiles(graph[k]).select("seed", "wi", "wj").distinct().count() for k in calls}
    reach = lambda lo, hi, size, step: set(range(-((size - 1 - lo) // step), (hi - 1) // step + 1))
    axes = []
    for n in (H, W):
        decoder = reach(-12, 8 * n + 12, 32, 24)
        latents = {w for d in decoder for w in reach(12 * d, 12 * d + 16, 8, 4)} | reach(-6, 4 * n + 6, 8, 4)
        first = {w for k in latents for w in reach(4 * k, 4 * k + 8, 8, 4)}
        axes.append({"decoder": decoder, "latents": latents, "first": first, "vector": first | latents,
                     "coarse": {w for k in first | latents for w in reach(k - 1, k + 3, 8, 6)} | reach(-8, n + 8, 8, 6)})
    assert all(calls[k] <= len(axes[0][k]) * len(axes[1][k]) for k in calls) and calls["decoder"] == len(axes[0]["decoder"]) * len(axes[1]["decoder"])
    assert calls["coarse"] == len(axes[0]["coarse"]) * len(axes[1]["coarse"])
    before = dict(calls)
    worlds.region(store, graph, seed, H, W).count()
    assert before == {k: store.tiles(graph[k]).count() for k in calls}  # nothing is computed again


def test_region_covers_every_cell(computed):
    out = computed[4]
    assert len(out) == 64 * H * W and len(out[["i", "j"]].drop_duplicates()) == len(out) and np.isfinite(out.to_numpy(float)).all()


def test_climate_channels_by_hand(spark):
    h, w, unit = 20, 19, 2
    made = np.random.default_rng(4)
    grid = {n: made.uniform(a, b, (h, w)) for n, (a, b) in {"root": (-20, 40), "t": (0, 30), "t_season": (100, 900), "precip": (0, 2000), "p_cv": (10, 90)}.items()}
    coarse = spark.createDataFrame([(i, j, *[float(g[i, j]) for g in grid.values()]) for i, j in np.ndindex(h, w)], "i long, j long, root double, t double, t_season double, precip double, p_cv double")
    cells = [(i, j, float(made.uniform(-300, 2000))) for i, j in np.ndindex(unit * (h - 16), unit * (w - 16))]
    got = climate_channels(coarse, (h, w), spark.createDataFrame(cells, "i long, j long, elev double"), unit).collect()
    beta, sea = np.zeros((h - 14, w - 14)), np.zeros((h - 14, w - 14))
    e = np.maximum(0, grid["root"]) ** 2
    for i, j in np.ndindex(beta.shape):
        at = np.s_[i : i + 15, j : j + 15]
        land = e[at] > 0
        n = land.sum() + 1e-6
        mt, me, mee, met = (x[land].sum() / n for x in (grid["t"][at], e[at], e[at] ** 2, e[at] * grid["t"][at]))
        var = mee - me * me
        b = -0.0065 if var < 1 or land.sum() < 0.02 * 225 else (met - me * mt) / (var + 1e-6)
        beta[i, j] = min(0, max(-0.012, b))
        sea[i, j] = grid["t"][i + 7, j + 7] - beta[i, j] * e[i + 7, j + 7]

    def at(a, i, j):
        y, x = min(max((i + 0.5) / unit + 0.5, 0), a.shape[0] - 1), min(max((j + 0.5) / unit + 0.5, 0), a.shape[1] - 1)
        y0, x0 = int(y), int(x)
        y1, x1 = min(y0 + 1, a.shape[0] - 1), min(x0 + 1, a.shape[1] - 1)
        return (a[y0, x0] * (1 - x + x0) + a[y0, x1] * (x - x0)) * (1 - y + y0) + (a[y1, x0] * (1 - x + x0) + a[y1, x1] * (x - x0)) * (y - y0)

    assert len(got) == len(cells)
    for r in got:
        want = {"beta": at(beta, r["i"], r["j"]), "temp": at(sea, r["i"], r["j"]) + at(beta, r["i"], r["j"]) * max(0, r["elev"])}
        want |= {n: at(grid[n][7:-7, 7:-7], r["i"], r["j"]) for n in ("t_season", "precip", "p_cv")}
        assert all(abs(r[n] - v) < 1e-6 for n, v in want.items())


def test_worlds_and_requests_share_a_plan(spark):
    store, tile = TileStore(spark), WindowSpec(8)
    layer = store.layer(Layer("patch", 2, tile, tile, worlds._patch_tile))
    rows = [(k, k % 3, -5 + k, 4 + k, 2 * k - 9, 2 * k + 1) for k in range(12)]
    asks = spark.createDataFrame(rows, "request long, seed long, i0 long, i1 long, j0 long, j1 long")
    got = {(r["request"], r["i"], r["j"]): r["c1"] for r in layers.slices(store, layer, asks, 1, 2).collect()}
    want = {}
    for request, seed, i0, i1, j0, j1 in rows:
        made = rng.patch(seed, i0, j0, i1 - i0, j1 - j0, 2, (8, 8))
        want |= {(request, i0 + i, j0 + j): made[1, i, j] for i, j in np.ndindex(i1 - i0, j1 - j0)}
    assert got == want
    windows = {(s, a, b) for _, s, i0, i1, j0, j1 in rows for a in range(i0 // 8, (i1 - 1) // 8 + 1) for b in range(j0 // 8, (j1 - 1) // 8 + 1)}
    assert store.computed(layer) == len(windows)
    again = Layer("patch", 2, tile, tile, lambda key: np.ones((2, 8, 8)))
    assert store.layer(again).fn is worlds._patch_tile  # a first definition stays


def test_faults_are_named(spark):
    four, store = WindowSpec(4), TileStore(spark)
    ask = spark.createDataFrame([(0, 0, 0)], "seed long, wi long, wj long")
    with pytest.raises(Exception, match="layer 'bad'"):
        layers.ensure(store, [(Layer("bad", 2, four, four, lambda key: np.zeros((2, 4, 3))), ask)])
    assert store.tiles(Layer("bad", 2, four, four, None)).count() == 0  # a failed job leaves nothing
    source = Layer("source", 3, four, four, None)
    with pytest.raises(ValueError, match="reads channels"):
        Layer("reader", 1, four, four, None, {"x": Read(source, four, four, 2, 5)})
    box = store.layer(Layer("box", 1, four, four, lambda key, x: x[:1] + 1, {"x": Read(source, four, four, 1, 3)}))
    cells = layers.slices(store, box, spark.createDataFrame([(1, 0, 0, 2, 0, 2)], "request long, seed long, i0 long, i1 long, j0 long, j1 long"))
    assert [r["c0"] for r in cells.collect()] == [1.0] * 4  # windows over a source without tiles read zeros
    store.put(source, layers.from_cells(source, spark.range(1).select(F.lit(0).cast("long").alias("seed"), F.lit(0).cast("long").alias("i"), F.lit(1).cast("long").alias("j"), F.lit(9).alias("v")), ["v", "v", "v"]))
    assert store.computed(source) == 1


def test_cells_of_requests_are_not_summed_one_by_one(spark):
    """Overlaps are summed in arrays, once, whoever asks; windows that the store lacks leave their cells out."""
    store, hop = TileStore(spark), WindowSpec(8, 6)
    layer = store.layer(Layer("hop", 2, hop, hop, lambda key: layers.weighted(np.full((1, 8, 8), 1.0 + key.wi + 10 * key.wj))))
    rows = [(k, 0, -9 + 3 * k, 2 + 4 * k, 5 * k - 20, 6 * k - 3) for k in range(8)]
    asks = spark.createDataFrame(rows, "request long, seed long, i0 long, i1 long, j0 long, j1 long")
    out = layers.slices(store, layer, asks)
    assert "Aggregate" not in out._jdf.queryExecution().executedPlan().toString()
    want = brute(layer, None, 0, (100, 100), -50)
    got = {(r["request"], r["i"], r["j"]): (r["c0"], r["c1"]) for r in out.collect()}
    assert set(got) == {(k, i, j) for k, _, i0, i1, j0, j1 in rows for i in range(i0, i1) for j in range(j0, j1)}
    assert all(np.allclose(v, want[:, i + 50, j + 50], rtol=1e-12) for (_, i, j), v in got.items())
    far = spark.createDataFrame([(9, 0, 300, 310, 0, 9)], "request long, seed long, i0 long, i1 long, j0 long, j1 long")
    assert layers.cells_of(store, layer, far, 0, 2).count() == 0
    tiles = store.tiles(layer)
    one = {(r["i"], r["j"]): r["c1"] for r in layers.rectangle(layer, tiles, -3, 11, -7, 8, 1, 2).collect()}
    assert set(one) == {(i, j) for i in range(-3, 11) for j in range(-7, 8)} and all(np.isclose(v, want[1, i + 50, j + 50]) for (i, j), v in one.items() if 0 <= i < 6 and -5 <= j < 3)
