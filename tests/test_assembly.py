"""Region plans against brute force on a table with more rows than the smallest one."""

import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillgrid.operators import stats
from quillgrid.plans import assembly
from quillgrid.plans.tables import DAYS, event_grid

USERS = 110


@pytest.fixture(scope="module")
def tall(spark, sf, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("tall"))
    rng = np.random.default_rng(5)
    rows = [(k, datetime.datetime(2024, 1, int(rng.integers(1, 32))), int(u), "a", float(rng.uniform(0, 90)), "{}") for k, u in enumerate(rng.permutation(np.arange(USERS * 6) % USERS))]
    spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, event_type string, value double, props string").write.parquet(f"{d}/events.parquet")
    spark.read.parquet(f"{sf}/lineitem.parquet").write.parquet(f"{d}/lineitem.parquet")
    grid = np.zeros((USERS, DAYS))
    for r in event_grid(spark, d).collect():
        grid[r["i"], r["j"]] = r["v"]
    return d, grid


def test_model_graph_covers_the_table(spark, tall):
    d, grid = tall
    tile, ramp = assembly._coarse_tile(20), 1 - 0.999 * np.minimum(1, np.abs(np.arange(16) - 7.5) / 7.5)
    far = np.pad(grid, 32)
    num, den = np.zeros_like(far), np.zeros_like(far)
    for wi in range(-1, USERS // 12 + 1):
        for wj in range(-1, DAYS // 12 + 1):
            at = np.s_[32 + 12 * wi : 48 + 12 * wi, 32 + 12 * wj : 48 + 12 * wj]
            num[at] += tile(wi, wj, far[at])
            den[at] += np.outer(ramp, ramp)
    want = (num / np.where(den > 1e-6, den, np.inf))[32:-32, 32:-32]
    got = {(r["i"], r["j"]): r["v"] for r in assembly.model_graph(spark, d).collect()}
    assert len(got) == USERS * DAYS and np.allclose([got[k] for k in np.ndindex(grid.shape)], want.ravel(), atol=2e-6)


def test_decoder_graph_matches_a_plain_computation(spark, tall, monkeypatch):
    """All stages on whole arrays, window by window."""
    d, grid = tall
    far = np.pad(grid, 96)  # a margin of windows whose cells are empty
    origin = -96

    def stage(size, step, make, shape, ratio):
        """Numerator and denominator of a stage over cells from ratio * origin on."""
        num, den, w = np.zeros(shape), np.zeros(shape), np.outer(assembly.ramp(size), assembly.ramp(size))
        for wi in range(-(-ratio * origin // step), (shape[0] + ratio * origin - size) // step + 1):
            for wj in range(-(-ratio * origin // step), (shape[1] + ratio * origin - size) // step + 1):
                at = np.s_[wi * step - ratio * origin : wi * step - ratio * origin + size, wj * step - ratio * origin : wj * step - ratio * origin + size]
                num[at] += make(wi, wj)
                den[at] += w
        return num, den

    def cut(a, wi, wj, size, step, ratio):
        i, j = wi * step - ratio * origin, wj * step - ratio * origin
        return a[i : i + size, j : j + size]

    ratio_of = lambda a, b: a / np.where(b > 1e-12, b, 1)
    coarse = ratio_of(*stage(8, 6, lambda wi, wj: assembly._coarse_tile(20, 8)(wi, wj, cut(far, wi, wj, 8, 6, 1)), far.shape, 1))
    fine = assembly.WindowSpec(16, 12)
    init = assembly._latent_batch(fine, fine, assembly.LATENT_TIMES[0], 42 + 5819)
    step = assembly._latent_batch(fine, fine, assembly.LATENT_TIMES[1], 42 + 5820)
    shape = tuple(2 * n for n in far.shape)
    first = ratio_of(*stage(16, 12, lambda wi, wj: init([(wi, wj)], cut(coarse, wi, wj, 8, 6, 1)[None])[0], shape, 2))
    latent = ratio_of(*stage(16, 12, lambda wi, wj: step([(wi, wj)], cut(coarse, wi, wj, 8, 6, 1)[None], cut(first, wi, wj, 16, 12, 2)[None])[0], shape, 2))
    wide = assembly.WindowSpec(64, 48)
    decode = assembly._decoder_tile(wide, wide, assembly.LATENT_TIMES[0], 42 + 5819, 4)
    whole = ratio_of(*stage(64, 48, lambda wi, wj: decode(wi, wj, cut(latent, wi, wj, 16, 12, 2)), tuple(8 * n for n in far.shape), 8))
    want = whole[768 : 768 + 8 * USERS, 768 : 768 + 8 * DAYS]
    got = assembly.decoder_graph(spark, d).toPandas()
    mine = np.full(want.shape, np.nan)
    mine[got["i"], got["j"]] = got["v"]
    assert np.isfinite(mine).all() and np.allclose(mine, want, atol=2e-5)


def test_batches_are_bounded_and_checked(spark):
    from quillgrid.operators import tensor
    from quillgrid.operators.windows import WindowSpec

    four, store = WindowSpec(4), tensor.Store(spark)
    ask = spark.createDataFrame([(k, 0) for k in range(23)], "wi long, wj long")
    sizes = tensor.Node("sizes", four, four, lambda at: np.stack([np.full((4, 4), len(at)) for _ in at]), batch=5)
    found = [r["data"][0] for r in tensor.ensure(store, sizes, ask).collect()]
    assert len(found) == 23 and max(found) <= 5
    for k, bad in enumerate((lambda at: np.zeros((len(at), 4, 3)), lambda at: np.zeros((len(at) + 1, 4, 4)))):
        with pytest.raises(Exception, match="tensor"):
            tensor.ensure(store, tensor.Node(f"bad{k}", four, four, bad, batch=2), ask).collect()


def test_climate_covers_the_table(spark, tall, monkeypatch):
    d, grid = tall
    seen = []
    real = stats.windowed_baseline
    monkeypatch.setattr(stats, "windowed_baseline", lambda *a: seen.append(real(*a)) or seen[-1])
    got = {(r["i"], r["j"]): r for r in assembly.climate_assembly(spark, d).collect()}
    base = {k: np.zeros((46, 36)) for k in ("beta", "t_sea")}
    for r in seen[0].select("i", "j", F.col("beta"), F.col("t_sea")).collect():
        for k, a in base.items():
            a[r["i"], r["j"]] = r[k]
    assert len(got) == USERS * DAYS
    for i, j in np.ndindex(grid.shape):
        y, x = min(max((i + 0.5) / 2 - 0.5, 0), 45), min(max((j + 0.5) / 2 - 0.5, 0), 35)
        y0, x0 = int(y), int(x)
        y1, x1 = min(y0 + 1, 45), min(x0 + 1, 35)
        at = {k: (1 - y + y0) * ((1 - x + x0) * a[y0, x0] + (x - x0) * a[y0, x1]) + (y - y0) * ((1 - x + x0) * a[y1, x0] + (x - x0) * a[y1, x1]) for k, a in base.items()}
        assert abs(got[i, j]["temp"] - (at["t_sea"] + at["beta"] * max(grid[i, j] * 9 - 200, 0))) < 1e-4


def test_a_top_node_is_not_kept_and_cells_are_not_summed_one_by_one(spark):
    from quillgrid.operators import tensor
    from quillgrid.operators.windows import WindowSpec

    four, hop, store = WindowSpec(4), WindowSpec(6, 4, -1), tensor.Store(spark)
    low = tensor.Node("low", four, four, lambda wi, wj: np.arange(16.0).reshape(4, 4) + wi)
    top = tensor.Node("top", hop, hop, lambda wi, wj, a: a + 1, [low], [hop], [hop])
    out = tensor.slice_node(store, top, -3, 9, 1, 10, keep=False)
    assert "Aggregate" not in out._jdf.queryExecution().executedPlan().toString().split("MapInPandas")[0]
    got = {(r["i"], r["j"]): r["v"] for r in out.collect()}
    base = lambda i, j: 4.0 * (i % 4) + j % 4 + i // 4 + 1
    times = lambda i: sum(w * 4 - 1 <= i < w * 4 + 5 for w in range(-9, 9))
    assert got == {(i, j): base(i, j) * times(i) * times(j) for i in range(-3, 9) for j in range(1, 10)}
    assert set(store.tiles) == {"low"}
    for spec in (hop, four, WindowSpec(5, 2)):
        w = assembly.ramp(spec.size)
        want = [sum(w[p - k * spec.step] for k in range(-9, 9) if 0 <= p - k * spec.step < spec.size) for p in range(spec.size)]
        assert np.allclose(assembly.overlapping(spec), want)
