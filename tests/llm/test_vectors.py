"""Vector operators against brute force, with null, zero, non-finite, odd-length and repeated vectors."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillgrid.llm import ann, embed_dedup

SCHEMA = "vec_id long, embedding array<float>, label int, v string, rep string, list string, links string"


def table(spark, rows):
    return spark.createDataFrame([(*r, "x", "x", "x", "x") for r in rows], SCHEMA).repartition(3)


ODD = [
    (900, None, 1), (901, [0.0] * 16, 1), (902, [float("nan")] + [1.0] * 15, 1), (903, [float("inf")] + [1.0] * 15, 1), (904, [None] + [1.0] * 15, 1),
    (905, [1.0, 2.0], 1), (906, [], 1), (None, [1.0] * 16, 1),
]


def clustered(n=600, seed=0, dim=16):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, dim))
    for k in range(0, n, 3):
        x[k] = x[k // 30 * 30] + 0.08 * rng.normal(size=dim)
    x[40:60] = x[10]  # copies
    x *= rng.uniform(0.5, 2, (n, 1))
    return x.astype(np.float32)


def test_search_recall_and_order(spark):
    x = clustered()
    rows = [(k, x[k].tolist(), 1) for k in range(len(x))] + ODD + [(7, x[7].tolist(), 1)]
    got = ann.nearest(table(spark, rows), F.col("vec_id") % 20 == 0, k=10).collect()
    xd, found, hits = x.astype(float), {}, 0
    for r in got:
        found.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    assert set(found) == {k for k in range(len(x)) if k % 20 == 0}
    for q, mine in found.items():
        mine.sort()
        assert [m[0] for m in mine] == list(range(1, 11)) and len({m[1] for m in mine}) == 10 and q not in {m[1] for m in mine}
        assert [(-s, i) for _, i, s in mine] == sorted((-s, i) for _, i, s in mine)
        assert all(abs(s - xd[q] @ xd[i]) < 1e-9 for _, i, s in mine)
        score = xd @ xd[q]
        score[q] = -np.inf
        hits += len(set(np.lexsort((np.arange(len(x)), -score))[:10]) & {m[1] for m in mine})
    assert hits / (10 * len(found)) >= 0.9


def test_search_meets_each_length(spark):
    x = clustered(200)
    rows = [(k, x[k].tolist(), 1) for k in range(200)] + [(1000 + k, x[k][:3].tolist(), 1) for k in range(0, 60)] + [(2000, [1.0], 1), (2001, [2.0], 1)]
    found = {}
    for r in ann.nearest(table(spark, rows), F.col("vec_id") % 20 == 0, k=5).collect():
        found.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    whole = {i: np.array(v, np.float32).astype(float) for i, v, _ in rows}
    assert set(found) == {i for i in whole if i % 20 == 0}
    for q, mine in found.items():
        best = sorted((-(whole[q] @ v), i) for i, v in whole.items() if i != q and len(v) == len(whole[q]))[:5]
        assert len(mine) == len(best) and len({i for _, i in best} & {i for _, i, _ in mine}) >= len(best) - 1
        assert all(abs(s - whole[q] @ whole[i]) < 1e-9 for _, i, s in mine)


def test_scan_of_a_table_larger_than_its_samples(spark, monkeypatch):
    """Samples of 2,000 and 400 of 20,000 rows: what is found comes from the lists."""
    monkeypatch.setattr(ann, "SAMPLE", 2000)
    monkeypatch.setattr(ann, "BOUND_SAMPLE", 400)
    rng = np.random.default_rng(8)
    x = rng.normal(size=(20_000, 24)) + 2 * rng.normal(size=(60, 24))[rng.integers(0, 60, 20_000)]
    x = (x / np.linalg.norm(x, axis=1, keepdims=True) * rng.uniform(0.8, 1.2, (20_000, 1))).astype(np.float32)
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<float>").repartition(4)
    found = {}
    for r in ann.nearest(df, F.col("vec_id") % 100 == 0).collect():
        found.setdefault(r["query_id"], set()).add(r["vec_id"])
    xd, hits = x.astype(float), 0
    for q in range(0, 20_000, 100):
        assert len(found[q]) == 20
        score = xd @ xd[q]
        score[q] = -np.inf
        hits += len(set(np.argpartition(-score, 20)[:20].tolist()) & found[q])
    print("recall", hits / 4000)
    assert hits / 4000 >= 0.9


def test_search_of_few_rows(spark):
    rows = [(0, [1.0, 0.0], 1), (1, [0.5, 0.5], 1), (2, [0.5, 0.5], 1)]
    got = [(r["query_id"], r["rank"], r["vec_id"]) for r in ann.nearest(table(spark, rows), F.col("vec_id") == 0).collect()]
    assert sorted(got) == [(0, 1, 1), (0, 2, 2)]
    assert ann.nearest(table(spark, rows).where("false"), F.col("vec_id") == 0).count() == 0
    assert ann.nearest(table(spark, rows[:1]), F.col("vec_id") == 0).count() == 0


def test_adaptive_scan_keeps_the_best():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(3000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    ids = np.arange(len(x))
    index = ann.fit(ids, x, len(x), 1.0, 20)
    q = x[:50]
    i, j = ann.scan(q, ids[:50], np.full(50, np.inf), x, ids, index, 20)
    score = q @ x.T
    score[np.arange(50), np.arange(50)] = -np.inf
    best = np.argsort(-score, axis=1)[:, :20]
    kept = set(zip(i.tolist(), j.tolist(), strict=True))
    assert np.mean([(a, b) in kept for a in range(50) for b in best[a]]) > 0.95 and len(kept) < 50 * 40


@pytest.mark.parametrize("block", [1024, 9])
def test_near_copies_match_all_pairs(spark, monkeypatch, block):
    monkeypatch.setattr(embed_dedup, "BLOCK", block)
    x = clustered(300, seed=3)
    rng = np.random.default_rng(5)
    for k in range(0, 300, 3):
        x[k] = x[k // 60 * 60] / np.linalg.norm(x[k // 60 * 60]) + 0.05 * rng.normal(size=16).astype(np.float32)
    labels = [None if k % 29 == 0 else k % 2 for k in range(300)]
    rows = [(k, x[k].tolist(), labels[k]) for k in range(300)] + ODD
    got = {r["vec_id"]: r for r in embed_dedup.embed_dedup(table(spark, rows)).collect()}
    assert len(got) == len(rows)
    u = x.astype(float)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    same = np.array([[a is not None and a == b for b in labels] for a in labels])
    near = (u @ u.T >= embed_dedup.COSINE) & same
    np.fill_diagonal(near, False)
    root = list(range(300))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a, b in zip(*np.nonzero(near), strict=True):
        p, q = find(a), find(b)
        root[max(p, q)] = min(p, q)
    found = sum(got[k]["n_links"] for k in range(300))
    assert all(got[k]["n_links"] <= near[k].sum() for k in range(300)) and found >= 0.95 * near.sum()
    assert np.mean([got[k]["component_id"] == find(k) for k in range(300)]) > 0.97
    assert all(r["kept"] == (i is not None and r["component_id"] == i) for i, r in got.items())
    for i, _, _ in ODD:
        assert got[i]["n_links"] == 0 and got[i]["component_id"] == i


def test_near_copies_of_two_lengths(spark):
    rows = [(k, [1.0, 0.1 * k, 0.0], 1) for k in range(3)] + [(10 + k, [2.0, 1.0], 1) for k in range(2)] + [(20, [2.0, 1.0], 2), (21, [-1.0], 1), (22, [5.0], 1), (23, [9.0], 1)]
    got = sorted((r["vec_id"], r["n_links"], r["component_id"]) for r in embed_dedup.embed_dedup(table(spark, rows)).collect())
    assert got == [(0, 2, 0), (1, 2, 0), (2, 2, 0), (10, 1, 10), (11, 1, 10), (20, 0, 20), (21, 0, 21), (22, 1, 22), (23, 1, 22)]


def test_near_copies_of_repeated_rows_and_none(spark):
    rows = [(1, [1.0, 0.0, 0.0], 1), (1, [1.0, 0.0, 0.0], 1), (2, [1.0, 0.0, 0.0], 1), (3, [1.0, 0.0, 0.0], 2)]
    got = sorted((r["vec_id"], r["n_links"], r["component_id"]) for r in embed_dedup.embed_dedup(table(spark, rows)).collect())
    assert got == [(1, 2, 1), (1, 2, 1), (2, 2, 1), (3, 0, 3)]
    assert embed_dedup.embed_dedup(table(spark, rows).where("false")).count() == 0


def test_collision_formula():
    rng = np.random.default_rng(0)
    for d in (0.2, 0.374, 1.0, 1.4142):
        a = rng.normal(size=200_000) * d
        b = rng.uniform(0, embed_dedup.CELL, 200_000)
        seen = np.mean(np.floor(b / embed_dedup.CELL) == np.floor((a + b) / embed_dedup.CELL))
        assert abs(seen - embed_dedup.collision(d)) < 0.01
