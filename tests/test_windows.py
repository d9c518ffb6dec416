"""Window algebra and blending against brute force."""

import math

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
import pytest

from quillgrid.operators import blend, windows
from quillgrid.operators.windows import WindowSpec


def test_covering_matches_brute_force(spark):
    specs = [WindowSpec(8, 6), WindowSpec(5, 7, -3), WindowSpec(4), WindowSpec(64, 32), WindowSpec(3, 1, -1), WindowSpec(1, 5, 2)]
    ranges = spark.createDataFrame([(a, a + n) for a in range(-40, 40, 3) for n in (1, 2, 9, 30)], "a long, b long")
    for s in specs:
        for r in ranges.select("a", "b", s.covering("a", "b").alias("w")).collect():
            want = [w for w in range(-200, 200) if w * s.step + s.offset < r["b"] and w * s.step + s.offset + s.size > r["a"]]
            assert r["w"] == want


@settings(max_examples=200, deadline=None)
@given(st.integers(1, 40), st.integers(1, 40), st.integers(-50, 50), st.integers(-500, 500), st.integers(1, 60))
def test_window_formulas(size, stride, offset, begin, length):
    """The closed forms in plain integers."""
    end = begin + length
    lo, hi = -((offset + size - 1 - begin) // stride), (end - 1 - offset) // stride
    hit = [w for w in range(lo - 3, hi + 4) if w * stride + offset < end and w * stride + offset + size > begin]
    assert hit == list(range(lo, hi + 1))


def test_weights():
    def weight(r, size):
        mid = (size - 1) / 2
        return 1 - (1 - 1e-3) * min(1, abs(r - mid) / mid)

    assert [round(weight(r, 64), 6) for r in (0, 1, 31, 32, 63)] == [0.001, 0.032714, 0.984143, 0.984143, 0.001]


def test_weight_column(spark):
    got = spark.range(64).select(F.round(blend.triangle(F.col("id"), 64), 6).alias("w")).collect()
    assert [got[r]["w"] for r in (0, 1, 31, 32, 63)] == [0.001, 0.032714, 0.984143, 0.984143, 0.001]


def test_blend_of_a_constant_is_constant(spark):
    cells = spark.range(30).select(F.col("id").alias("i"), F.explode(F.sequence(F.lit(-5), F.lit(12))).alias("j")).withColumn("v", F.lit(3.5))
    out = blend.blend_cells(cells, WindowSpec(8, 6), WindowSpec(8, 6)).collect()
    assert len(out) == 30 * 18 and all(abs(r["v"] - 3.5) < 1e-12 for r in out)


def test_slices_do_not_depend_on_the_rectangle(spark):
    cells = spark.range(200).select((F.col("id") % 17 - 4).alias("i"), (F.col("id") % 13).alias("j"), F.col("id").cast("double").alias("v"))
    big = {(r["i"], r["j"]): r["v"] for r in blend.slice_sum(cells, -6, 20, -2, 16).collect()}
    small = blend.slice_sum(cells, -3, 5, 2, 9).collect()
    assert len(small) == 8 * 7 and all(big[r["i"], r["j"]] == r["v"] for r in small)


def test_tiles_and_ranges(spark):
    x = spark.range(-70, 70).select(F.col("id").alias("x"), windows.tile_snap("id", 16).alias("t"), *[c.alias(n) for c, n in zip(windows.align("id", F.col("id") + 5, 8), "ab", strict=True)])
    for r in x.collect():
        assert r["t"] == r["x"] // 16 * 16 and r["a"] == r["x"] // 8 * 8 and r["b"] == math.ceil((r["x"] + 5) / 8) * 8
    with pytest.raises(ValueError):
        windows.tile_snap("x", 12)
    with pytest.raises(ValueError):
        WindowSpec(0)
