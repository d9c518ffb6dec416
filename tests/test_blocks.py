"""A region computed block by block: the same cells as by the store's tiles, with hardly a byte written on the way."""

import os

import numpy as np
import pytest

from quillgrid.operators import layers, parts, raster, stats
from quillgrid.operators.layers import Layer, Read, TileStore
from quillgrid.operators.windows import WindowSpec
from quillgrid.plans import worlds

H, W = 9, 7


def written(spark):
    executors = spark._jsc.sc().statusStore().executorList(False)
    return sum(executors.apply(k).totalShuffleWrite() for k in range(executors.size()))


def test_blocks_are_the_region(spark):
    store, seed = TileStore(spark), 11
    graph = worlds.world(store)
    values = np.random.default_rng(2).uniform(-20, 60, (5, H, W)).round(3)
    rows = [(seed, i, j, *values[:, i, j].tolist()) for i, j in np.ndindex(H, W)]
    cells = spark.createDataFrame(rows, "seed long, i long, j long, a double, b double, c double, d double, e double")
    store.put(graph["map"], layers.from_cells(graph["map"], cells, list("abcde")))
    got = worlds.region_blocks(store, graph, seed, H, W, side=4).toPandas().sort_values(["i", "j"], ignore_index=True)
    assert not {"coarse", "vector", "first", "latents", "decoder"} & set(store._tables)  # nothing between the map and the cells is kept
    whole = store.held(worlds.region(store, graph, seed, H, W))
    slope = raster.sobel(whole.select("i", "j", whole["elev"].alias("v")), 30.0).withColumnRenamed("v", "slope")
    want = whole.join(slope, ["i", "j"]).toPandas().sort_values(["i", "j"], ignore_index=True)
    assert len(got) == 64 * H * W and set(got.columns) == set(want.columns)
    for name in want.columns:
        assert np.allclose(got[name], want[name], rtol=1e-9, atol=1e-9), name
    store.release()


def test_world_region_writes_little(spark, sf, tmp_path, monkeypatch):
    monkeypatch.setattr(worlds, "TileStore", lambda s: TileStore(s, str(tmp_path)))
    before = written(spark)
    rows = len(worlds.world_region(spark, sf).toPandas())
    kept = sum(os.path.getsize(os.path.join(at, f)) for at, _, files in os.walk(tmp_path) for f in files)
    assert rows == 64 * 15 * 31 and (written(spark) - before + kept) / rows < 40


@pytest.mark.parametrize("n", [2, 3, 7, 40])
def test_parts_of_an_axis_are_those_of_the_whole(n):
    a, taps = np.random.default_rng(n).normal(size=(3, n, 5)), raster.kernel_truncated(5.0)
    whole = (0, n)
    steps = [
        (2 * n, lambda t: parts.enlarge_reads(t, n, 2), lambda b, f, t: parts.enlarge(b, -2, f, t, n, 2)),
        (4 * n, lambda t: parts.resize_reads(t, n, 4 * n), lambda b, f, t: parts.resize(b, -2, f, t, n, 4 * n)),
        (n // 2, lambda t: parts.resize_reads(t, n, n // 2), lambda b, f, t: parts.resize(b, -2, f, t, n, n // 2)),
        (n, lambda t: parts.blur_reads(t, n, taps), lambda b, f, t: parts.blur(b, -2, f, t, n, taps)),
        (n, lambda t: parts.sobel_reads(t, n), lambda b, f, t: parts.sobel(b, (f, 0), t, (0, 5), (n, 5))),
    ]
    for length, reads, step in steps:
        want = step(a, 0, (0, length))
        for first in range(length):
            for stop in range(first + 1, length + 1):
                r = reads((first, stop))
                assert whole[0] <= r[0] < r[1] <= whole[1]
                assert np.array_equal(step(a[:, r[0] : r[1]], r[0], (first, stop)), want[:, first:stop])
    with pytest.raises(IndexError):
        parts.resize(a[:, 1:], -2, 1, (0, 2), n, n)


def test_layers_in_memory_are_those_of_the_store(spark):
    store, tile, hop = TileStore(spark), WindowSpec(4), WindowSpec(8, 6, -3)
    values = np.random.default_rng(5).normal(size=(20, 20))
    rows = [(0, i, j, float(values[i, j])) for i, j in np.ndindex(20, 20)]
    source = store.layer(Layer("source", 1, tile, tile, None))
    store.put(source, layers.from_cells(source, spark.createDataFrame(rows, "seed long, i long, j long, v double"), ["v"]))
    one = store.layer(Layer("one", 2, hop, hop, lambda key, x: layers.weighted(x - x.mean() + key.wi), {"x": Read(source, hop, hop)}))
    two = store.layer(Layer("two", 2, tile, tile, lambda at, x: layers.weighted(x[:, :1] * 2), {"x": Read(one, tile, tile)}, batch=3))
    at = (5, 14, 3, 16)
    asks = spark.createDataFrame([(1, 0, *at)], "request long, seed long, i0 long, i1 long, j0 long, j1 long")
    want = layers.slices(store, two, asks).toPandas()
    cells, windows = layers.reach([(two, at)])
    assert len(windows["two"][0]) * len(windows["two"][1]) == store.computed(two) and len(windows["one"][0]) * len(windows["one"][1]) == store.computed(one)
    i0, i1, j0, j1 = cells["source"]
    far = np.pad(values, 30)[None, i0 + 30 : i1 + 30, j0 + 30 : j1 + 30]
    [got] = layers.within([(two, at)], 0, {"source": (far, i0, j0)})
    assert got.shape == (2, 9, 13) and len(want) == 9 * 13
    for k in range(2):
        assert np.allclose(got[k, want["i"] - at[0], want["j"] - at[2]], want[f"c{k}"], rtol=1e-12)
    with pytest.raises(IndexError):
        layers.within([(two, at)], 0, {"source": (far[:, 1:], i0 + 1, j0)})
    store.release()


def test_baseline_in_memory_is_that_of_columns(spark):
    made = np.random.default_rng(8)
    t, e = made.uniform(0, 30, (9, 8)), np.maximum(made.uniform(-40, 60, (9, 8)), 0.0)
    e[0, 1] = np.nan
    grid = spark.createDataFrame([(i, j, float(t[i, j]), float(e[i, j])) for i, j in np.ndindex(9, 8)], "i long, j long, t double, e double")
    want = stats.windowed_baseline(grid, 5).toPandas()
    beta, sea = parts.windowed_baseline(t, e, 5)
    assert beta.shape == (5, 4) and len(want) == 20 and np.allclose(beta[want["i"], want["j"]], want["beta"]) and np.isfinite(beta).all()
    assert np.allclose(sea[want["i"], want["j"]], want["t_sea"], equal_nan=True)
