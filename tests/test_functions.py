"""Noise, random numbers, solver, classification, search, text and configuration."""

import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillgrid.functions import noise, rng, text
from quillgrid.operators import classify, diffusion, search, tensor
from quillgrid.operators.windows import WindowSpec
from quillgrid.sources import config, procedural, sinks
from quillgrid.streaming.cells import window_sums


def test_random_golden_vectors():
    seeds = rng.tile_seeds(42, np.array([0, -1]), np.array([0, 3]))
    assert seeds.tolist() == [785323394005271306, 12186038208538446164]
    assert rng.outputs(int(seeds[0]), 4).tolist() == [976489416, 2400186413, 1356641064, 2993332771]
    assert rng.outputs(int(seeds[1]), 4).tolist() == [3320011795, 1492509926, 1322201009, 1984201447]
    assert np.allclose(rng.normals(int(seeds[0]), 4), [-1.4936016, 0.3223220, -1.0734624, 1.1481264])
    assert np.allclose(rng.normals(int(seeds[1]), 4), [1.1962001, -0.6681969, -1.8992898, -0.3757746])


def test_normals_do_not_depend_on_how_many():
    assert np.array_equal(rng.normals(77, 5), rng.normals(77, 5001)[:5])
    x = rng.normals(5, 100_000)
    assert abs(x.mean()) < 0.02 and abs(x.std() - 1) < 0.02


def test_patches_depend_on_the_cell_only(spark):
    cells = spark.range(-20, 20).select(F.col("id").alias("i"), F.explode(F.sequence(F.lit(-9), F.lit(9))).alias("j"))
    whole = {(r["i"], r["j"], r["ch"]): r["v"] for r in rng.gaussian_patch(cells, 42, 2, 16).collect()}
    part = rng.gaussian_patch(cells.where("i between -3 and 2 and j > 4"), 42, 2, 16).collect()
    assert len(part) == 6 * 5 * 2 and all(whole[r["i"], r["j"], r["ch"]] == r["v"] for r in part)


def test_procedural_source_needs_bounds(spark):
    procedural.register(spark)
    field = spark.read.format("noise_field").option("seed", 42).option("tile", 16).load()
    got = field.where("i >= -3 and i < 2 and j > 4 and j <= 9").collect()
    assert len(got) == 25
    cells = spark.createDataFrame([(r["i"], r["j"]) for r in got], "i long, j long")
    want = {(r["i"], r["j"]): r["v"] for r in rng.gaussian_patch(cells, 42, 1, 16).collect()}
    assert all(math.isclose(want[r["i"], r["j"]], r["v"], rel_tol=1e-6) for r in got)
    with pytest.raises(Exception, match="no end"):
        field.where("i >= 0").count()


def perlin(seed, x, y):
    """One octave in plain Python."""
    wrap = lambda v: ((v & 0xFFFFFFFF) ^ 0x80000000) - 0x80000000
    fl = lambda v: int(v) if v >= 0 else int(v) - 1
    x0, y0 = fl(x), fl(y)
    fade = lambda t: t**3 * (t * (t * 6 - 15) + 10)

    def grad(a, b):
        h = wrap(wrap(seed ^ wrap((x0 + a) * 501125321) ^ wrap((y0 + b) * 1136930381)) * 0x27D4EB2D)
        k = ((h ^ (h >> 15)) & 254) >> 1
        turn = math.radians(7.5 + 15 * (k % 24) if k < 120 else 22.5 + 45 * (k - 120))
        return (x - x0 - a) * math.sin(turn) + (y - y0 - b) * math.cos(turn)

    s, t = fade(x - x0), fade(y - y0)
    low, high = grad(0, 0) + s * (grad(1, 0) - grad(0, 0)), grad(0, 1) + s * (grad(1, 1) - grad(0, 1))
    return (low + t * (high - low)) * noise.PERLIN_2D


def test_perlin_octaves(spark):
    points = [(float(x), float(y)) for x in (-300, -100, -1, 0, 3, 77) for y in (-55, 0, 12, 200)]
    n = noise.Noise(seed=11, frequency=0.013, fractal="fbm", octaves=3, gain=0.6, lacunarity=2.1)
    df = noise.add_noise(spark.createDataFrame(points, "x double, y double"), ["x", "y"], n, "v")
    for r in df.collect():
        want, amp, x, y = 0.0, n.bounding, r["x"] * n.frequency, r["y"] * n.frequency
        for k in range(3):
            want += perlin(11 + k, x, y) * amp
            amp, x, y = amp * 0.6, x * 2.1, y * 2.1
        assert abs(r["v"] - want) < 1e-9


@pytest.mark.parametrize("n", [
    noise.Noise(kind="value", fractal="ridged", frequency=0.05), noise.Noise(kind="cubic", frequency=0.05), noise.Noise(kind="simplex", fractal="pingpong", octaves=2, frequency=0.05),
])
def test_noise_is_bounded_smooth_and_repeatable(spark, n):
    points = spark.range(2000).select((F.col("id") * 0.37 - 300).alias("x"), (F.col("id") * 0.11).alias("y"))
    got = [r["v"] for r in noise.add_noise(points, ["x", "y"], n, "v").orderBy("x").collect()]
    assert max(map(abs, got)) < 1.6 and np.std(got) > 0.05
    again = [r["v"] for r in noise.add_noise(points.repartition(3), ["x", "y"], n, "v").orderBy("x").collect()]
    assert got == again
    if n.fractal == "none":
        assert max(abs(np.diff(got))) < 0.3


def test_noise_in_space_and_warps(spark):
    p = spark.range(300).select((F.col("id") * 0.9 - 99).alias("x"), (F.col("id") * 0.3).alias("y"), (F.col("id") * 0.21 - 5).alias("z"))
    v = [r["v"] for r in noise.add_noise(p, ["x", "y", "z"], noise.Noise(frequency=0.07), "v").collect()]
    assert max(map(abs, v)) <= 1.2 and np.std(v) > 0.05
    w = noise.warp(p, ["x", "y"], noise.Noise(octaves=2), 5.0)
    moved = [abs(a["x"] - b["x"]) for a, b in zip(p.collect(), w.collect(), strict=True)]
    assert 0 < max(moved) <= 5.0
    for r in noise.cellular(p, ["x", "y"], frequency=0.1).collect():
        assert 0 <= r["f1"] <= r["f2"] < 4 and -1 <= r["cell"] < 1
    with pytest.raises(ValueError):
        noise.add_noise(p, ["x"], noise.Noise(kind="cubic"), "v")
    for kind in ("simplex", "smooth", "value"):
        for rotation in ("xy", "xz"):
            v = [r["v"] for r in noise.add_noise(p, ["x", "y", "z"], noise.Noise(frequency=0.07, kind=kind, rotation=rotation), "v").collect()]
            assert max(map(abs, v)) <= 1.3 and np.std(v) > 0.05, (kind, rotation)


def test_schedule_and_solver(spark):
    s = diffusion.schedule(20)
    assert [round(s[k], 4) for k in (1, 10)] == [59.6575, 1.9794] and abs(s[0] - 80) < 1e-9 and abs(s[19] - 0.002) < 1e-12 and s[20] == 0
    assert round(diffusion.noise_label(80), 7) == 1.5645464 and round(diffusion.noise_label(0.35), 7) == 0.6107260
    tiles = spark.createDataFrame([([1.0, -2.0, 80.0],)], "x array<double>")
    got = diffusion.solve(tiles, diffusion.linear_stub(), 6).first()["x"]
    x, before, s = np.array([1.0, -2.0, 80.0]), None, diffusion.schedule(6)
    for k in range(6):
        a, b = s[k], s[k + 1]
        answer = x / math.hypot(a, 0.5) * 0.5 * math.cos(math.atan(a / 0.5))
        clean = 0.25 / (a * a + 0.25) * x + a * 0.5 / math.hypot(a, 0.5) * answer
        slope = 0 if k in (0, 5) else 0.5 * (clean - before) / (math.log(s[k - 1] / a) / math.log(a / b))
        x, before = b / a * x - (b / a - 1) * (clean + slope), clean
    assert np.allclose(got, x)


def test_heights(spark):
    at = lambda m, s: spark.range(1).select(classify.block_height(F.lit(float(m)), F.lit(s)).alias("y")).first()["y"]
    assert [at(29, s) for s in (1, 2, 6)] == [63, 64, 68] and [at(30, s) for s in (1, 2, 6)] == [64, 65, 69]
    assert [at(10000, s) for s in (1, 2, 6)] == [396, 729, 2063] and [at(m, 2) for m in (-1, -100, -32768)] == [62, 55, -115]


def test_classes_cover_the_rules(spark):
    base = {"elev": 100.0, "temp": 15.0, "t_season": 800.0, "precip": 900.0, "p_cv": 30.0, "slope": 0.1, "n_temp": 0.0, "n_precip": 0.0, "n_snow": 0.0}
    cases = {
        "ocean": {"elev": -5.0}, "frozen_ocean": {"elev": -5.0, "temp": -9.0}, "warm_ocean": {"elev": -1.0, "temp": 22.0}, "desert": {"temp": 28.0, "precip": 40.0},
        "stony_peaks": {"slope": 3.0}, "jungle": {"temp": 28.0, "precip": 4000.0}, "snowy_slopes": {"elev": 3000.0, "temp": -12.0}, "savanna": {"temp": 22.0, "precip": 500.0, "elev": 600.0},
    }
    for name, change in cases.items():
        row = base | change
        got = classify.with_names(classify.classify(spark.createDataFrame([tuple(row.values())], ", ".join(f"{k} double" for k in row)))).first()
        assert got["class_name"] == name
    unknown = spark.createDataFrame([tuple((base | {"temp": None}).values())], ", ".join(f"{k} double" for k in base))
    assert classify.with_names(classify.classify(unknown)).first()["class_name"] == "plains"


def test_search_ties_and_fallback(spark):
    land = spark.createDataFrame([(i, j, 1.0, 1.0) for i in range(-9, 10) for j in range(-9, 10) if abs(i) > 2 or abs(j) > 2], "i long, j long, v double, w double")
    found = search.all_land(land)
    assert tuple(search.nearest(found, 0, 0).first()) == (-4, -4, 4)
    assert tuple(search.expanding(found, 0, 0).first()) == (-4, -4, 0)
    assert tuple(search.expanding(found.where("i > 100"), 5, 6).first()) == (5, 6, -1)


def test_tensor_graph(spark):
    calls = WindowSpec(4)
    store = tensor.Store(spark)
    base = tensor.Node("base", calls, calls, lambda wi, wj: np.full((4, 4), wi * 10.0 + wj))
    assert store.get_or_create(base) is base and store.get_or_create(tensor.Node("base", WindowSpec(9), WindowSpec(9), None)) is base
    over = WindowSpec(6, 4)
    top = tensor.Node("top", over, over, lambda wi, wj, a: a[1:7, 1:7] * 0 + a.sum(), [base], [WindowSpec(8, 4, -1)], [WindowSpec(8, 4, -1)])
    value = lambda i, j: (i // 4) * 10.0 + j // 4
    tile = lambda wi, wj: sum(value(i, j) for i in range(wi * 4 - 1, wi * 4 + 7) for j in range(wj * 4 - 1, wj * 4 + 7))
    for rect in ((-3, 6, 2, 9), (0, 3, 0, 3)):
        got = {(r["i"], r["j"]): r["v"] for r in tensor.slice_node(store, top, *rect).collect()}
        for i in range(rect[0], rect[1]):
            for j in range(rect[2], rect[3]):
                want = sum(tile(a, b) for a in range(-3, 4) for b in range(-3, 4) if a * 4 <= i < a * 4 + 6 and b * 4 <= j < b * 4 + 6)
                assert abs(got[i, j] - want) < 1e-9
    bad = tensor.Node("bad", calls, calls, lambda wi, wj: np.zeros((3, 4)))
    with pytest.raises(Exception, match="bad"):
        tensor.slice_node(tensor.Store(spark), bad, 0, 2, 0, 2).collect()
    made = store.computed()
    store.clear()
    assert made > 0 and store.computed() == made and store.tiles == {} and tensor.strides((3, 4, 5)) == (20, 5, 1)


def test_text(spark):
    sizes = spark.createDataFrame([(5,), (1536,), (5 << 20,), (3 << 30,)], "n long").select(text.human_bytes(F.col("n")).alias("s")).collect()
    assert [r["s"] for r in sizes] == ["5 B", "1.5 KiB", "5.0 MiB", "3.00 GiB"]
    q = spark.createDataFrame([("a=1&b=x=y&c&a=2",), ("",), (None,)], "q string").select(text.query_map(F.col("q")).alias("m")).collect()
    assert [r["m"] for r in q] == [{"b": "x=y", "c": "", "a": "2"}, {}, {}]


def test_configuration(spark, tmp_path):
    good = {"coarse_means": [0.0] * 6, "coarse_stds": [1.0] * 6, "cond_snr": [1.0] * 5, "frequency_mult": [1.0] * 5, "coarse_pooling": 1, "latent_compression": 8, "native_resolution": 30.0}
    for k, change in enumerate([{}, {"coarse_means": [1.0]}, {"latent_compression": 0}, {"histogram_raw": [1.0]}]):
        (tmp_path / f"{k}.json").write_text(json.dumps(good | change))
    got = sorted(str(r["problem"]) for r in config.read_model_config(spark, str(tmp_path)).collect())
    assert got == sorted(["None", "coarse_means must contain exactly 6 values", "latent_compression must be > 0", "histogram_raw must contain exactly 5 values when provided"])
    s = config.Settings.parse("# note\ntile_size = 512\nspawn_search.max_size=x\nvalidate_model=FALSE\nother=1")
    assert s.tile_size == 512 and s.spawn_largest == 128 and not s.validate_model
    with pytest.raises(ValueError):
        config.Settings.parse("tile_size=100")


def test_pictures_and_raw_tiles(spark):
    import zlib

    cells = spark.createDataFrame([(0, 0, 7.9, 1.5), (1, 3, -40000.0, 2.0)], "i long, j long, elev double, temp double")
    raw = sinks.raw_tiles(cells, 4).first()["data"]
    assert np.frombuffer(raw[:32], "<i2").reshape(4, 4)[0, 0] == 7 and np.frombuffer(raw[:32], "<i2").reshape(4, 4)[1, 3] == -32768
    assert np.frombuffer(raw[32:], "<f4").reshape(4, 4)[1, 3] == 2.0
    picture = sinks.png(np.arange(27).reshape(3, 3, 3))
    body = zlib.decompress(picture[picture.index(b"IDAT") + 4 : picture.index(b"IEND") - 8])
    assert picture[:8] == b"\x89PNG\r\n\x1a\n" and body == b"".join(b"\0" + bytes(range(9 * r, 9 * r + 9)) for r in range(3))


def test_stream_equals_batch(spark, sf, tmp_path):
    src = spark.read.parquet(f"{sf}/events.parquet").select("ts", F.col("user_id").alias("i"), F.dayofmonth("ts").cast("long").alias("j"), F.col("value").alias("v"))
    src = src.withColumn("ts", F.col("ts").cast("timestamp"))
    src.write.parquet(str(tmp_path / "in"))
    spec = WindowSpec(8, 6)
    batch = {(r["at"]["start"], r["wi"], r["wj"]): (round(r["total"], 6), r["n"]) for r in window_sums(src, spec, spec).collect()}
    stream = window_sums(spark.readStream.schema(src.schema).parquet(str(tmp_path / "in")), spec, spec)
    q = stream.writeStream.outputMode("complete").format("memory").queryName("sums").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    got = {(r["at"]["start"], r["wi"], r["wj"]): (round(r["total"], 6), r["n"]) for r in spark.sql("select * from sums").collect()}
    assert got == batch


def test_seeds_are_read_as_the_nearest_double(spark):
    """Also beyond 2^53, where every second whole number is a double, and for negative ones."""
    asked = [-10022 * 1_000_003 * 900_001, -10023 * 1_000_003 * 900_001, 2**53 + 1, -(2**53) - 1, -(2**53) - 2, 10024 * 1_000_003 * 700_001 * 31]
    rows = spark.createDataFrame([(f'{{"seed": {n}}}',) for n in asked], "body string").select(text.seed_of(F.col("body")).alias("s")).collect()
    assert [r["s"] for r in rows] == [int(float(n)) for n in asked]
