"""The file sink (all or nothing), the procedural source in batches, and nested documents."""

import json
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillgrid.functions import rng
from quillgrid.operators import nested
from quillgrid.operators.shared import Shared
from quillgrid.sources import files, procedural, sinks


def test_tiles_are_written_and_read_again(spark, tmp_path):
    where = str(tmp_path / "tiles")
    rows = [(a, b, bytes([a % 256, b % 256]) * (a + 3)) for a in range(-2, 5) for b in range(-1, 4)]
    tiles = spark.createDataFrame(rows, "ty long, tx long, data binary").withColumn("more", F.lit(1)).repartition(4)
    files.write_tiles(tiles, where, ".raw")
    assert sorted(os.listdir(where)) == sorted(f"{a}_{b}.raw" for a, b, _ in rows)
    assert sorted((r["ty"], r["tx"], bytes(r["data"])) for r in files.read_tiles(spark, where, ".raw").collect()) == sorted(rows)
    files.write_tiles(tiles.where("false"), where, ".none")
    files.write_tiles(tiles.limit(1), "file://" + where, ".png")  # beside the others
    assert len(os.listdir(where)) == len(rows) + 1


def test_a_failed_task_leaves_nothing(spark, tmp_path):
    where = str(tmp_path / "tiles")
    rows = spark.range(40).select(F.col("id").alias("ty"), F.lit(0).cast("long").alias("tx"), F.when(F.col("id") == 31, F.raise_error("broken").cast("binary")).otherwise(F.lit(b"x")).alias("data")).repartition(4)
    with pytest.raises(Exception, match="broken"):
        files.write_tiles(rows, where, ".raw")
    assert not os.path.isdir(where) or os.listdir(where) == []
    twice = spark.createDataFrame([(1, 1, b"a"), (1, 1, b"b")], "ty long, tx long, data binary").repartition(2)
    with pytest.raises(Exception, match="twice"):
        files.write_tiles(twice, where, ".raw")
    assert not os.path.isdir(where) or os.listdir(where) == []


def test_raw_bytes_and_pixels(spark):
    from quillgrid.plans.files import _pixels

    cells = spark.createDataFrame([(i, j, i * 3.7 - 9, j * 0.3) for i in range(4) for j in range(4)], "i long, j long, elev double, temp double")
    data = bytes(sinks.raw_tiles(cells, 4).first()["data"])
    i, j = np.mgrid[0:4, 0:4]
    assert data == np.floor(i * 3.7 - 9).astype("<i2").tobytes() + (j * 0.3).astype("<f4").tobytes()
    rgb = np.random.default_rng(0).integers(0, 256, (5, 7, 3)).astype(np.uint8)
    import pandas as pd

    assert _pixels(pd.Series([sinks.png(rgb)]))[0] == rgb.tobytes()


def test_procedural_source_in_batches(spark):
    procedural.register(spark)
    field = spark.read.format("noise_field").option("seed", 5).option("tile", 16).load()
    got = {(r["i"], r["j"]): r["v"] for r in field.where("i >= -20 AND i < 30 AND j > -3 AND j <= 40").collect()}
    want = rng.patch(5, -20, -2, 50, 43, 1, (16, 16))[0]
    assert len(got) == want.size and all(got[i - 20, j - 2] == want[i, j] for i, j in np.ndindex(want.shape))


def walk(v, path="$"):
    if isinstance(v, dict) and v:
        return [x for k, m in v.items() for x in walk(m, f"{path}.{k}")]
    if isinstance(v, list) and v:
        return [x for k, m in enumerate(v) for x in walk(m, f"{path}[{k}]")]
    return [(path, v)]


def test_nested_documents(spark):
    deep = 1
    for k in range(12):
        deep = {"d": deep} if k % 2 else [k, deep]
    docs = [(1, {"a": [1, {"b": None, "c": "x\"y"}], "e": {}, "f": []}), (2, 5), (3, "text"), (4, []), (5, deep), (6, {"t": True, "n": 1.5})]
    rows = [(i, json.dumps(v)) for i, v in docs] + [(7, None), (8, "{broken"), (9, "")]
    shared = Shared(spark)
    found = nested.leaves(spark.createDataFrame(rows, "k int, doc string"), "k", "doc", shared).collect()
    got = [(r["id"], r["path"], json.loads(r["value"])) for r in found]
    assert sorted(got, key=str) == sorted([(i, *x) for i, v in docs for x in walk(v)], key=str)
    with pytest.raises(ValueError, match="deeper"):
        nested.leaves(spark.createDataFrame(rows, "k int, doc string"), "k", "doc", shared, deepest=3)
    assert nested.leaves(spark.createDataFrame([], "k int, doc string"), "k", "doc", shared).count() == 0
    shared.release()
