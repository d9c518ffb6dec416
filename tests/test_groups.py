"""Quantiles of all groups at once, and a search that asks for rings of windows, against plain computations."""

import numpy as np
from pyspark.sql import functions as F

from quillgrid.operators import layers, search, stats
from quillgrid.operators.layers import Layer, TileStore
from quillgrid.operators.shared import Shared
from quillgrid.operators.windows import WindowSpec

LEVELS = [0.0, 0.1, 0.25, 0.5, 0.9, 1.0]


def test_quantiles_of_groups(spark):
    rng = np.random.default_rng(6)
    groups = {"hot": rng.normal(size=3000).round(1), "ties": np.full(500, 2.5), "few": np.array([4.0, -1.0]), "one": np.array([7.0])}
    rows = [(k, float(v)) for k, g in groups.items() for v in g] + [("hot", None), (None, 1.0), ("none", None)]
    shared = Shared(spark)
    df = spark.createDataFrame(rows, "g string, v double").repartition(5)
    got = {r["g"]: (r["n"], r["q"]) for r in stats.quantile_rows(df, "g", LEVELS, shared).collect()}
    assert set(got) == set(groups)
    for k, g in groups.items():
        assert got[k][0] == len(g) and np.allclose(got[k][1], np.quantile(g, LEVELS))
    assert stats.quantile_rows(df.where("false"), "g", LEVELS, shared).count() == 0
    shared.release()


def test_increasing_quantiles(spark):
    rows = [(1, [1.0, 1.0, 3.0, 3.0, 5.0]), (2, [2.0, 2.0]), (3, [4.0]), (4, [0.0, 1.0])]
    got = {r["k"]: r["q"] for r in spark.createDataFrame(rows, "k int, q array<double>").withColumn("q", stats.increasing(F.col("q"))).collect()}
    assert got[4] == [0.0, 1.0] and got[3] == [4.0] and np.allclose(got[1], [1, 1.2, 3, 3.2, 5]) and got[2][1] > got[2][0]


def test_match_within_groups(spark):
    rng = np.random.default_rng(1)
    xs = {"a": np.sort(rng.normal(size=6)), "b": np.sort(rng.normal(size=6)) * 5}
    ys = {"a": np.sort(rng.normal(size=6)), "b": np.sort(rng.normal(size=6))}
    tables = [spark.createDataFrame([(k, q.tolist()) for k, q in t.items()], "g string, q array<double>") for t in (xs, ys)]
    rows = [(k, float(v)) for k in "ab" for v in rng.normal(size=200) * 4] + [("a", float(xs["a"][2])), ("c", 1.0), ("a", None)]
    out = stats.match_rows(spark.createDataFrame(rows, "g string, v double"), "g", *tables, 6).collect()
    assert len(out) == len(rows)
    for r in out:
        if r["g"] == "c" or r["v"] is None:
            assert r["matched"] is None
        else:
            assert abs(r["matched"] - np.interp(r["v"], xs[r["g"]], ys[r["g"]])) < 1e-9


def test_search_asks_for_rings_only(spark):
    four = WindowSpec(4)

    def island(key):
        i, j = np.mgrid[key.wi * 4 : key.wi * 4 + 4, key.wj * 4 : key.wj * 4 + 4]
        return layers.weighted(np.where((abs(i - 13) <= 1) & (abs(j + 2) <= 1), 1.0, -1.0)[None])

    store = TileStore(spark)
    layer = store.layer(Layer("island", 2, four, four, island))
    found = [tuple(r) for r in search.growing(store, layer, 3, 0, 0, initial=16, largest=64).collect()]
    assert found == [(13, -2, 13, 32)]  # the island ends at 14: offsets go from -n / 2 to n / 2 - 1
    assert store.computed(layer) == 64 < 256 and store.tiles(layer).select("wi", "wj").distinct().count() == 64
    assert len(store._tables["island"]) == 3  # sizes 16, 24 and 32
    assert [tuple(r) for r in search.growing(store, layer, 4, 100, 100, largest=24).collect()] == [(100, 100, -1, -1)]
    store.release()
