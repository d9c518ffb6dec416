"""Exact top-k search against brute force on whole numbers: clusters, hot rows, odd vectors, two lengths, large components."""

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quillgrid.llm import voronoi as V

SCHEMA = "vec_id long, embedding array<float>, cell int, data string, query string"
ODD = [(9001, None), (9002, [float("nan")] + [1.0] * 7), (9003, [None] * 8), (9004, [float("inf")] * 8), (None, [1.0] * 8), (9050, []), (9051, []), (9100, [0.0] * 8)]


def clustered(n, dim=8, seed=0):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(12, dim)) * 3
    return (centres[rng.integers(0, 12, n)] + 0.1 * rng.normal(size=(n, dim))).astype(np.float32)


def brute(rows, k=5, every=50):
    whole = []
    for i, v in rows:
        if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v):
            whole.append((i, [min(max(int(np.floor(256.0 * float(np.float32(x)))), V.LONG.min), V.LONG.max) for x in v]))
    out = []
    for q in sorted({i for i, _ in whole if i % every == 0}):
        best = {}
        for i, a in whole:
            if i == q:
                for j, b in whole:
                    if j != q and len(a) == len(b):
                        s = min(max(sum(x * y for x, y in zip(a, b, strict=True)), V.LONG.min), V.LONG.max)
                        best[j] = max(best.get(j, s), s)
        out += [(q, n + 1, j, s) for n, (s, j) in enumerate(sorted((-s, j) for j, s in best.items())[:k])]
    return sorted((q, n, j, -s) for q, n, j, s in out)


def found(spark, rows, **kw):
    df = spark.createDataFrame([(*r, 1, "x", "y") for r in rows], SCHEMA).repartition(4)
    return sorted(tuple(r) for r in V.top_k(df, F.col("vec_id") % 50 == 0, **kw).collect())


@pytest.mark.parametrize("blocks", [{}, {"query_block": 4, "least_rows": 60}])
def test_top_k_is_exact(spark, blocks):
    x = clustered(1000)
    rows = [(k, x[k].tolist()) for k in range(1000)] + [(2000 + k, x[50].tolist()) for k in range(400)]  # a hot vector
    rows += ODD + [(50, x[51].tolist()), (7, x[7].tolist()), (7, x[8].tolist()), (7, x[7].tolist())]  # ids of several rows
    rows += [(3000 + k, x[k][:3].tolist()) for k in range(0, 120, 3)]  # another length
    assert found(spark, rows, **blocks) == brute(rows)


def test_top_k_of_few_and_of_large(spark):
    assert found(spark, []) == [] and found(spark, [(50, [1.0])]) == []
    rows = [(0, [1.0, 2.0]), (1, [0.5, -1.0]), (2, [0.5, -1.0]), (50, [0.0, 0.0])]
    assert found(spark, rows) == brute(rows)
    rows = [(0, [3e5, -2e7]), (1, [1e30, 1.0]), (2, [4e9, 3e9]), (3, [4e9, 3e9]), (50, [-1e30, 1e30]), (4, [1e-30, -1e-30])]
    assert found(spark, rows) == brute(rows)


def test_only_what_a_group_may_need_is_sent():
    x = clustered(6000, seed=3)
    frame = pd.DataFrame({"vec_id": np.arange(len(x)), "v": list(x)})
    whole = V.whole(frame["v"]).astype(float)
    pivots = V.fit(frame, {8: (len(x), float(np.sqrt((whole**2).sum(1).max())))}, 1)[8]
    cell, d = pivots.of_rows(whole)
    asked = np.arange(0, len(x), 50)
    qcell, qd = pivots.of_queries(whole[asked])
    cells = pd.DataFrame([(c, *map(list, V._least(np.flatnonzero(cell == c), d[cell == c], 6))) for c in np.unique(cell)], columns=["cell", "ids", "ds"])
    low, high = V.reach(pivots, pd.DataFrame([(c, qd[qcell == c].max()) for c in np.unique(qcell)], columns=["cell", "high"]), cells, 5)
    place = {c: n for n, c in enumerate(cells["cell"])}
    at = np.array([place[c] for c in cell])
    sent = (low[:, at] <= d) & (d <= high[:, at])
    assert sent.mean() < 0.5
    score = whole[asked] @ whole.T
    score[np.arange(len(asked)), asked] = -np.inf
    row = {c: n for n, c in enumerate(np.unique(qcell))}
    for n in range(len(asked)):
        assert sent[row[qcell[n]], np.argsort(-score[n])[:5]].all()


def test_top_k_equals_sql(spark, sf):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{sf}/embeddings.parquet'")
    assert sorted(tuple(r) for r in V.op13(spark, sf).select("query_id", "rank", "vec_id", "score").collect()) == sorted(con.sql(V.OP13_SQL).fetchall())
