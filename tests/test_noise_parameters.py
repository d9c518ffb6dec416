"""Noise whose seed is a column, and whose directions are given."""

import math

import pytest
from pyspark.sql import functions as F

from quillgrid.functions import noise
from quillgrid.functions.noise import Noise


@pytest.fixture(scope="module")
def places(spark):
    rows = [(k, k % 4 - 1, k * 1.7 - 20, (k * 7 % 31) * 0.9, k % 5 * 2.3) for k in range(60)]
    return spark.createDataFrame(rows, "k int, seed int, x double, y double, z double").cache()


@pytest.mark.parametrize("kind, dims", [("perlin", 2), ("value", 3), ("simplex", 3), ("smooth", 3), ("cellular", 2)])
def test_a_seed_for_each_row(places, kind, dims):
    axes, how = list("xyz"[:dims]), {"frequency": 0.07, "kind": kind, "fractal": "fbm", "octaves": 2}
    got = {r["k"]: r["v"] for r in noise.add_noise(places, axes, Noise(seed=F.col("seed"), **how), "v").collect()}
    for seed in (-1, 0, 2):
        for r in noise.add_noise(places.where(F.col("seed") == seed), axes, Noise(seed=seed, **how), "v").collect():
            assert got[r["k"]] == r["v"]
    assert len({round(v, 9) for v in got.values()}) > 40


def signed(x):
    return (x + (1 << 31)) % (1 << 32) - (1 << 31)


def nearest_by_hand(x, y, seed, table, frequency):
    """Least squared distance to the feature points around a place, by the definition."""
    x, y = x * frequency, y * frequency
    cx, cy = (int(v + math.copysign(0.5, v)) for v in (x, y))
    best = []
    for i in range(cx - 1, cx + 2):
        for j in range(cy - 1, cy + 2):
            h = signed((seed ^ signed(i * noise.PRIMES[0]) ^ signed(j * noise.PRIMES[1])) * noise.HASH)
            vx, vy = table[h >> 1 & 255]
            best.append((i - x + vx * noise.JITTER_2D) ** 2 + (j - y + vy * noise.JITTER_2D) ** 2)
    return min(best)


def test_given_directions(places):
    table = tuple((math.cos(k * k), math.sin(k * k)) for k in range(256))
    out = noise.add_noise(places, ["x", "y"], Noise(seed=4, frequency=0.1, kind="cellular", directions=table), "v").collect()
    assert all(abs(r["v"] + 1 - nearest_by_hand(r["x"], r["y"], 4, table, 0.1)) < 1e-9 for r in out)
    ruled = tuple(zip(noise._TABLES["circle_x"], noise._TABLES["circle_y"], strict=True))
    for make in (lambda n: noise.add_noise(places, ["x", "y"], n, "v"), lambda n: noise.warp(places, ["x", "y"], n, 5.0, "grid", "single")):
        same = [sorted(map(tuple, make(Noise(seed=4, frequency=0.1, kind="cellular", directions=t)).collect())) for t in (None, ruled)]
        assert same[0] == same[1]
    with pytest.raises(ValueError, match="256 vectors"):
        noise.add_noise(places, ["x", "y"], Noise(kind="cellular", directions=table[:3]), "v")


def test_nearest_points_are_found_without_sorting(spark):
    """The two nearest of 27 feature points by running minima; missing coordinates stay missing."""
    from quillgrid.functions import noise
    from pyspark.sql import functions as F

    rows = [(0.3, 1.7, -2.2), (5.5, 5.5, 5.5), (None, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "x double, y double, z double")
    out = noise.cellular(df, ["x", "y", "z"], frequency=1.0)
    assert "array_sort" not in out._jdf.queryExecution().optimizedPlan().toString()
    got = out.collect()
    assert all(0 <= r["f1"] <= r["f2"] for r in got[:2]) and got[2]["f1"] is None and got[2]["f2"] is None
    smooth = noise.add_noise(df, ["x", "y", "z"], noise.Noise(kind="smooth", frequency=1.0), "v")
    plan = smooth._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("lambda") >= 8 * 2  # eight loops, two corners each
    assert smooth.select(F.col("v")).collect()[2]["v"] is None
