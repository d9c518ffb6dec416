"""Approximate nearest neighbours by inner product: adaptive dimension scan in inverted lists.

Lists come from k-means on a bounded sample; every row is assigned to its list.  Vectors gain
one component that makes all norms equal, so the largest inner product is the smallest distance,
and are then rotated at random.  A list is scanned in blocks of columns: after each block a
hypothesis test compares a candidate's scaled partial distance with the query's best distances so
far and abandons candidates that are very unlikely to belong to them.  Survivors get the exact
inner product of the original vectors in double precision.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import hash_sample, save, table
from .vectors import matrix, usable

#: Rows of the sample that the lists are fitted on (about, and twice so many at most), and of its part that bounds each query's distance.
SAMPLE, BOUND_SAMPLE = 20_000, 4_000
#: Vector lengths (the commonest) that get an index; rows of any other length are one list, compared without one.
LENGTHS = 16
#: Mean rows a list, the most lists, and the recall that probing is set for on the sample.
LIST_ROWS, MAX_LISTS, RECALL, TUNING_QUERIES = 256, 2048, 0.97, 200
#: Columns of a scan block and the significance of the abandoning test.
COLUMNS, EPSILON = 16, 2.1
#: Share of living candidates above which a block is computed for all.
DENSE = 0.05
#: Vectors and queries that one task compares at a time.
VECTOR_BLOCK, QUERY_BLOCK = 4096, 4096


@dataclass
class Index:
    centroids: np.ndarray  # of augmented vectors, unrotated
    rotation: np.ndarray
    radius: float  # the largest norm
    probes: int
    bound: np.ndarray  # sample vectors that give each query's first bound
    bound_ids: np.ndarray
    sizes: np.ndarray | None = None  # rows of each list, once all are dealt

    def augment(self, x: np.ndarray) -> np.ndarray:
        rest = np.sqrt(np.maximum(0.0, self.radius**2 - (x * x).sum(1)))
        return np.hstack([x, rest[:, None]])

    def lists(self, augmented: np.ndarray) -> np.ndarray:
        c = self.centroids
        return np.argmin((c * c).sum(1)[None, :] - 2 * augmented @ c.T, axis=1)

    def probed(self, x: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(query row, list) of the lists nearest to each query: as many as were found to do, and so many that k others are in them."""
        c = self.centroids
        order = np.argsort((c * c).sum(1)[None, :] - 2 * x @ c[:, :-1].T, axis=1, kind="stable")
        enough = (np.cumsum(self.sizes[order], axis=1) < k + 1).sum(1) + 1
        row, place = np.nonzero(np.arange(len(c))[None, :] < np.maximum(self.probes, enough)[:, None])
        return row, order[row, place]

    def first(self, x: np.ndarray, ids: np.ndarray, row: np.ndarray, lists: np.ndarray, k: int) -> np.ndarray:
        """A distance that k candidates in the probed lists are known not to exceed, from the sample's vectors there; infinite for fewer."""
        out = np.full(len(x), np.inf)
        if len(self.bound) >= k:
            met = np.zeros((len(x), len(self.centroids)), bool)
            met[row, lists] = True
            score = x @ self.bound.T
            score[~met[:, self.lists(self.augment(self.bound))] | (ids[:, None] == self.bound_ids[None, :])] = -np.inf
            low = np.partition(score, len(self.bound) - k, axis=1)[:, len(self.bound) - k]
            known = low > -np.inf
            out[known] = (x[known] ** 2).sum(1) + self.radius**2 - 2 * low[known]
        return out


def _kmeans(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 8) -> np.ndarray:
    c = x[rng.choice(len(x), k, replace=False)]
    for _ in range(rounds):
        near = np.argmin((c * c).sum(1)[None, :] - 2 * x @ c.T, axis=1)
        n = np.bincount(near, minlength=k)
        order = np.argsort(near, kind="stable")
        sums = np.zeros_like(c)
        has = np.flatnonzero(n)
        sums[has] = np.add.reduceat(x[order], np.concatenate([[0], np.cumsum(n[has])[:-1]]), axis=0)
        c = np.where(n[:, None] > 0, sums / np.maximum(1, n)[:, None], c)
    return c


def fit(ids: np.ndarray, x: np.ndarray, rows: int, radius: float, k: int, seed: int = 1) -> Index:
    """Lists, rotation and number of probes from the sample (``rows``: rows of the whole table)."""
    rng = np.random.default_rng(seed)
    dim = x.shape[1] + 1
    n_lists = int(max(1, min(MAX_LISTS, rows // LIST_ROWS, len(x) // 8 or 1)))
    rotation = np.linalg.qr(rng.normal(size=(dim, dim)))[0]
    index = Index(np.zeros((1, dim)), rotation, radius, 1, x[:BOUND_SAMPLE], ids[:BOUND_SAMPLE])
    aug = index.augment(x)
    index.centroids = _kmeans(aug, n_lists, rng)
    own = index.lists(aug)
    pick = rng.choice(len(x), min(TUNING_QUERIES, len(x)), replace=False)
    score = x[pick] @ x.T
    score[np.arange(len(pick)), pick] = -np.inf
    # The share of a true neighbour set grows with probing; neighbours in the whole table lie nearer than in the sample, so this errs on the safe side.
    best = np.argpartition(-score, min(k, len(x) - 1), axis=1)[:, :k]
    c = index.centroids
    d = (c * c).sum(1)[None, :] - 2 * x[pick] @ c[:, :-1].T
    place = np.argsort(np.argsort(d, axis=1), axis=1)
    needed = np.sort(place[np.arange(len(pick))[:, None], own[best]].ravel())
    index.probes = int(min(n_lists, needed[min(len(needed) - 1, int(np.ceil(RECALL * len(needed))))] + 1))
    return index


def limits(bound: np.ndarray, seen: int, dim: int) -> np.ndarray:
    """The partial distance over ``seen`` columns beyond which a candidate is abandoned; exact once all are seen."""
    if seen >= dim:
        return bound * (1 + 1e-9) + 1e-12
    return bound * (seen / dim) * (1 + EPSILON / np.sqrt(seen)) ** 2


def scan(q: np.ndarray, q_ids: np.ndarray, first: np.ndarray, x: np.ndarray, x_ids: np.ndarray, index: Index, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(query row, vector row) pairs of candidates that the adaptive scan kept, at most k a query beyond ties.

    ``first``: a distance that k candidates of each query are known not to exceed.
    """
    qr = np.hstack([q, np.zeros((len(q), 1))]) @ index.rotation
    xr = index.augment(x) @ index.rotation
    dim, bound = qr.shape[1], first.copy()
    kept_q, kept_x, kept_d = [], [], []
    for at in range(0, len(x), 512):
        part = xr[at : at + 512]
        dist, alive, seen = np.zeros((len(q), len(part))), q_ids[:, None] != x_ids[None, at : at + 512], 0
        # While many candidates live, a block of columns is one matrix product for all; later it is read for the living only.
        while seen < dim and (not seen or alive.mean() > DENSE):
            more = slice(seen, seen + COLUMNS)
            dist += (qr[:, more] ** 2).sum(1)[:, None] + (part[:, more] ** 2).sum(1)[None, :] - 2 * qr[:, more] @ part[:, more].T
            seen = min(dim, seen + COLUMNS)
            alive &= dist <= limits(bound, seen, dim)[:, None]
        i, j = np.nonzero(alive)
        d = dist[i, j]
        while seen < dim and len(i):
            more = slice(seen, seen + COLUMNS)
            d = d + ((qr[i, more] - part[j, more]) ** 2).sum(1)
            seen = min(dim, seen + COLUMNS)
            stay = d <= limits(bound, seen, dim)[i]
            i, j, d = i[stay], j[stay], d[stay]
        kept_q.append(i)
        kept_x.append(j + at)
        kept_d.append(d)
        # A query that has k candidates in hand gets a tighter bound.
        qi, di = np.concatenate(kept_q), np.concatenate(kept_d)
        order = np.lexsort((di, qi))
        starts = np.searchsorted(qi[order], np.arange(len(q)))
        ends = np.append(starts[1:], len(qi))
        full = np.flatnonzero(ends - starts >= k)
        bound[full] = np.minimum(bound[full], di[order][starts[full] + k - 1])
    qi, xi, di = np.concatenate(kept_q), np.concatenate(kept_x), np.concatenate(kept_d)
    stay = di <= bound[qi] * (1 + 1e-9) + 1e-12
    return qi[stay], xi[stay]


def nearest(
    vectors: DataFrame, is_query: F.Column, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", seed: int = 1
) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` candidates of largest inner product found for each query.

    ``is_query`` is a condition on the column ``vec_id``.  Null ids, and vectors that are null, zero or hold null or non-finite
    components, take no part.  A query meets vectors of its own length; the commonest lengths have an index each, of
    the others all vectors are compared.  Rows of one id count once (the smallest vector).  Ties go to the smaller vec_id; a query with
    fewer than ``k`` candidates gets all; an empty table gives an empty result; other columns are ignored.
    Lists and queries are split into blocks, so a list with a third of all rows is many tasks.  Every result comes out of the scan of
    a list; the sample gives bounds only.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))
    rows = rows.where(usable("v") & F.col("vec_id").isNotNull()).groupBy("vec_id").agg(F.min("v").alias("v"))
    rows, _ = save(rows)
    norm2 = F.aggregate("v", F.lit(0.0), lambda a, b: a + b * b)
    known = rows.groupBy(F.size("v").alias("len")).agg(F.count("*").alias("n"), F.sqrt(F.max(norm2)).alias("radius")).orderBy(F.desc("n"), "len").limit(LENGTHS).collect()
    picked = hash_sample(rows, SAMPLE, str(seed), "vec_id", max(1, sum(r["n"] for r in known))).limit(2 * SAMPLE).toPandas()
    picked = picked.sort_values("vec_id").sample(frac=1, random_state=seed)
    indexes = {}
    for r in known:
        mine = picked[picked["v"].map(len) == r["len"]]
        if len(mine):
            indexes[r["len"]] = fit(mine["vec_id"].to_numpy(np.int64), matrix(mine["v"]), r["n"], r["radius"], k, seed)
    dealt_by = spark.sparkContext.broadcast(indexes)

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in (part for whole in batches for _, part in whole.groupby(whole["v"].map(len))):
            x = matrix(b["v"])
            index = dealt_by.value.get(x.shape[1])
            yield b.assign(len=x.shape[1], list=0 if index is None else index.lists(index.augment(x)))

    listed, _ = save(rows.mapInPandas(assign, "vec_id long, v array<double>, len int, list int"))
    counts, _ = save(listed.groupBy("len", "list").agg(F.count("*").alias("n")))
    for index in indexes.values():
        index.sizes = np.zeros(len(index.centroids), np.int64)
    for r in counts.where(F.col("len").isin(list(indexes))).collect():  # MAX_LISTS a length at most
        indexes[r["len"]].sizes[r["list"]] = r["n"]
    sent = spark.sparkContext.broadcast(indexes)

    def probe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """A query for each list that it probes, with a distance that k candidates are known not to exceed."""
        for b in (part for whole in batches for _, part in whole.groupby(whole["v"].map(len))):
            for at in range(0, len(b), 256):
                part = b.iloc[at : at + 256]
                x, ids = matrix(part["v"]), part["vec_id"].to_numpy(np.int64)
                index = sent.value.get(x.shape[1])
                if index is None:
                    row, lists, first = np.arange(len(x)), np.zeros(len(x), int), np.full(len(x), np.inf)
                else:
                    row, lists = index.probed(x, k)
                    first = index.first(x, ids, row, lists, k)
                yield pd.DataFrame({"query_id": ids[row], "q": part["v"].to_numpy()[row], "first": first[row], "len": x.shape[1], "list": lists})

    probes, _ = save(rows.where(is_query).mapInPandas(probe, "query_id long, q array<double>, first double, len int, list int"))
    # A list goes to as many query blocks as its own queries fill, not to all queries.
    asked = probes.groupBy("len", "list").agg(F.count("*").alias("asked"))
    sizes = counts.join(asked, ["len", "list"])
    sizes, _ = save(sizes.select("len", "list", F.ceil(F.col("n") / VECTOR_BLOCK).cast("int").alias("v_blocks"), F.ceil(F.col("asked") / QUERY_BLOCK).cast("int").alias("q_blocks")))
    block = lambda key, n: F.pmod(F.xxhash64(key), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    keys = ["len", "list", "v_block", "q_block"]
    left = listed.join(sizes, ["len", "list"]).withColumn("v_block", block("vec_id", "v_blocks")).withColumn("q_block", every("q_blocks")).select(*keys, "vec_id", "v")
    right = probes.join(sizes.toDF(*sizes.columns), ["len", "list"]).withColumn("q_block", block("query_id", "q_blocks")).withColumn("v_block", every("v_blocks"))
    right = right.select(*[F.col(c).alias(c) for c in keys], "query_id", "q", "first")

    def compare(key: tuple, vs: pd.DataFrame, qs: pd.DataFrame) -> pd.DataFrame:
        if not len(vs) or not len(qs):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
        x, q, index = matrix(vs["v"]), matrix(qs["q"]), sent.value.get(int(key[0]))
        x_ids, q_ids = vs["vec_id"].to_numpy(np.int64), qs["query_id"].to_numpy(np.int64)
        if index is None:
            index = Index(np.zeros((1, x.shape[1] + 1)), np.eye(x.shape[1] + 1), float(np.sqrt((x * x).sum(1).max())), 1, x[:0], x_ids[:0])
        i, j = scan(q, q_ids, qs["first"].to_numpy(float), x, x_ids, index, k)
        score = np.einsum("ij,ij->i", q[i], x[j])
        return pd.DataFrame({"query_id": q_ids[i], "vec_id": x_ids[j], "score": score})

    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(compare, "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def op1(spark, sf_dir: str) -> DataFrame:
    """The 20 nearest rows of ``embeddings`` by inner product for each whose vec_id is divisible by 20: query_id, rank, vec_id, score."""
    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)
