"""What the query interface shows: seeds of requests, and the modes of a detail picture."""

import pytest
from pyspark.sql import functions as F

from quillgrid.functions import colormaps, text
from quillgrid.operators import raster, tensor
from quillgrid.operators.windows import WindowSpec

SEEDS = {
    '{"seed": 7}': 7, '{"seed": 9007199254740993}': 9007199254740992, '{"seed": 1e300}': (1 << 63) - 1, '{"seed": -1e300}': -(1 << 63), '{"seed": -2.9}': -2,
    '{"x": 7}': None, "seed": None, "": None, '{"seed": null}': None, None: None,
}


@pytest.mark.parametrize("body", SEEDS)
def test_seed_of_a_request(spark, body):
    row = spark.createDataFrame([(body,)], "body string").select(text.seed_of(F.col("body")).alias("s")).first()
    assert row["s"] == SEEDS[body]


def test_unsigned(spark):
    values = [0, 5, -1, -(1 << 63), (1 << 63) - 1, None]
    got = spark.createDataFrame([(v,) for v in values], "v long").select(text.unsigned(F.col("v")).alias("u")).collect()
    assert [r["u"] for r in got] == [None if v is None else str(v % (1 << 64)) for v in values]


def test_modes_of_a_detail_picture(spark):
    cells = spark.createDataFrame([(i, j, 10.0 * i - 20, 30.0 - j) for i in range(5) for j in range(4)], "i long, j long, elev double, temp double")
    land, heat = colormaps.table(colormaps.TERRAIN), colormaps.table(colormaps.RDBU_R)
    for mode, at, colours in (("elevation", lambda i, j: i / 4, land), ("temperature", lambda i, j: 1 - j / 3, heat)):
        for r in raster.detail(cells, mode).collect():
            assert (r["r"], r["g"], r["b"]) == pytest.approx(colours[int(at(r["i"], r["j"]) * 255 + 0.5)])
    flat = cells.withColumn("temp", F.lit(3.0))  # a constant channel counts as one wide
    assert {tuple(r[c] for c in "rgb") for r in raster.detail(flat, "temperature").collect()} == {tuple(heat[0])}
    whole = lambda df: sorted(map(tuple, df.select("i", "j", "r", "g", "b").collect()))
    assert whole(raster.detail(cells)) == whole(raster.relief(cells.withColumnRenamed("elev", "v").drop("temp")))


def test_tiles_of_a_tensor_are_tables_that_a_drop_deletes(spark, tmp_path):
    four, store = WindowSpec(4), tensor.Store(spark, str(tmp_path))
    node = store.get_or_create(tensor.Node("n", four, four, lambda wi, wj: [[wi + wj / 10.0] * 4] * 4))
    ask = lambda *at: spark.createDataFrame(list(at), "wi long, wj long")
    tensor.ensure(store, node, ask((0, 0), (0, 1)))
    tensor.ensure(store, node, ask((0, 1), (2, 2)))
    assert store.known(node).count() == store.computed() == 3 and list((tmp_path / "n").glob("*.parquet"))
    store.drop("n")
    assert store.known(node).count() == 0 and store.computed() == 3 and not (tmp_path / "n").exists()
    assert tensor.ensure(store, node, ask((0, 1))).count() == 1 and store.computed() == 4
