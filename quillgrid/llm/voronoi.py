"""Exact top-k search by integer inner product: a Voronoi join of queries and data.

Vectors gain one component that makes all norms equal, and queries are scaled to that norm, so the
largest inner product is the smallest distance.  Pivots from a bounded sample cut space into cells;
every row is dealt to the cell of its nearest pivot.  A short summary of each cell (rows, nearest and
farthest distance from the pivot, the few rows nearest to it) bounds how far the k-th neighbour of
any query of a cell can be, and triangle inequalities tell which rows of which cell a group of query
cells may need: only those are sent to it.  Groups are solved in blocks, where the same inequalities
leave out cells for single queries.  Distances only prune, with slack; scores are whole numbers.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ann import _kmeans
from .common import hash_sample, save, table

#: Rows of the sample that pivots come from (about, and twice so many at most), and the most pivots of a vector length.
SAMPLE, MAX_PIVOTS = 20_000, 512
#: Vector lengths (the commonest) that get pivots; rows of any other length are one cell, which is not pruned.
LENGTHS = 16
#: Queries of a block, and the least and most data rows of one.
QUERY_BLOCK, LEAST_ROWS, MOST_ROWS = 16_384, 2048, 65_536
#: Query groups are made as small as keeps what is sent below so many times the rows.
COPIES = 2.0
#: Rows that one matrix product compares, and what floating-point distances may be off, as a share of the largest norm.
STRIPE, SLACK = 512, 1e-6
LONG = np.iinfo(np.int64)


@dataclass
class Pivots:
    points: np.ndarray  # of data, augmented, one a row
    asks: np.ndarray  # of queries, scaled
    radius: float  # the largest norm of a row of this length

    def of_rows(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Cell and distance from its pivot of each row."""
        return self._near(np.hstack([x, np.sqrt(np.maximum(0.0, self.radius**2 - (x * x).sum(1)))[:, None]]), self.points)

    def scaled(self, q: np.ndarray) -> np.ndarray:
        """Queries at the common norm; zero stays."""
        norm = np.sqrt((q * q).sum(1))
        return np.hstack([q * (self.radius / np.where(norm > 0, norm, 1.0))[:, None], np.zeros((len(q), 1))])

    def of_queries(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return self._near(self.scaled(q), self.asks)

    def distances(self, a: np.ndarray, p: np.ndarray | None = None) -> np.ndarray:
        p = self.points if p is None else p
        return np.sqrt(np.maximum(0.0, (a * a).sum(1)[:, None] + (p * p).sum(1)[None, :] - 2 * a @ p.T))

    def _near(self, a: np.ndarray, p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        d = self.distances(a, p)
        cell = d.argmin(1)
        return cell, d[np.arange(len(a)), cell]


def whole(column: pd.Series) -> np.ndarray:
    """floor(256 * x) of vectors of one length, as longs; what is beyond a long takes its end."""
    x = np.floor(256.0 * np.stack(column.to_numpy()).astype(np.float64))
    big = np.abs(x) >= 2.0**63
    return np.where(big, np.where(x > 0, LONG.max, LONG.min), np.where(big, 0, x).astype(np.int64))


def packed(x: np.ndarray) -> list[bytes]:
    """Rows as bytes, in the shortest whole numbers that hold them all."""
    most = max(abs(int(x.max())), abs(int(x.min()))) if x.size else 0
    kind = "<i2" if most < 1 << 15 else "<i4" if most < 1 << 31 else "<i8"
    return [r.tobytes() for r in x.astype(kind)]


def unpacked(blobs: pd.Series, length: int) -> np.ndarray:
    if not length:
        return np.zeros((len(blobs), 0), np.int64)
    widths = blobs.map(len).to_numpy() // length
    out = np.empty((len(blobs), length), np.int64)
    for w in np.unique(widths):
        at = np.flatnonzero(widths == w)
        out[at] = np.frombuffer(b"".join(blobs.iloc[at]), f"<i{w}").reshape(-1, length)
    return out


def products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Exact inner products of whole numbers, as longs (as doubles where all are below 2^53); what is beyond a long takes its end."""
    most = lambda a: max(abs(int(a.max())), abs(int(a.min()))) if a.size else 0
    if most(q) * most(x) * max(1, q.shape[1]) < 1 << 53:
        return q.astype(np.float64) @ x.astype(np.float64).T
    exact = q.astype(object) @ x.astype(object).T
    return np.clip(exact, LONG.min, LONG.max).astype(np.int64)


def fit(sample: pd.DataFrame, sizes: dict[int, tuple[int, float]], seed: int) -> dict[int, Pivots]:
    """Pivots of each length in ``sizes`` (rows, radius): about half the root of the rows, for data and, as any row may ask, for queries."""
    out, rng = {}, np.random.default_rng(seed)
    for length, (n, radius) in sizes.items():
        mine = sample[sample["v"].map(len) == length]
        if length and len(mine):
            x = whole(mine["v"]).astype(np.float64)
            aug = np.hstack([x, np.sqrt(np.maximum(0.0, radius**2 - (x * x).sum(1)))[:, None]])
            k = int(max(1, min(MAX_PIVOTS, n**0.5 / 2, len(mine) / 4)))
            out[length] = Pivots(_kmeans(aug, k, rng), np.empty((0, 0)), radius)
            out[length].asks = _kmeans(out[length].scaled(x), k, rng)
    return out


ASSIGNED = "len int, cell int, d double, vec_id long, data binary, salt long, qcell int, qd double"


def _assign(sent):
    """Rows as whole numbers, with their cell as data and, for queries, as query."""

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        salt = 0
        for b in batches:
            for length, part in b.groupby(b["v"].map(len)):
                x = whole(part["v"]) if length else np.zeros((len(part), 0), np.int64)
                ask = part["q"].to_numpy(bool)
                cell, d, qcell, qd = np.zeros(len(x), int), np.zeros(len(x)), np.where(ask, 0, -1), np.zeros(len(x))
                if length in sent.value:
                    cell, d = sent.value[length].of_rows(x.astype(float))
                    if ask.any():
                        qcell[ask], qd[ask] = sent.value[length].of_queries(x[ask].astype(float))
                yield pd.DataFrame({"len": length, "cell": cell, "d": d, "vec_id": part["vec_id"], "data": packed(x), "salt": salt + np.arange(len(x)), "qcell": qcell, "qd": qd})
                salt += len(x)

    return each


SUMMARY = "len int, cell int, query boolean, n long, low double, high double, ids array<long>, ds array<double>"


def _least(ids: np.ndarray, ds: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k smallest distances of different ids."""
    order = np.lexsort((ids, ds))
    ids, ds = ids[order], ds[order]
    first = np.sort(np.unique(ids, return_index=True)[1])[:k]
    return ids[first], ds[first]


def _summaries(k: int):
    """A row for each cell and side that the task's rows lie in."""

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[tuple, list] = {}
        for b in batches:
            for side, key, far, rows in ((False, "cell", "d", b), (True, "qcell", "qd", b[b["qcell"] >= 0])):
                for (length, cell), part in rows.groupby(["len", key]):
                    ids, ds = (np.empty(0, np.int64), np.empty(0)) if side else (part["vec_id"].to_numpy(np.int64), part[far].to_numpy())
                    n, low, high, old_ids, old_ds = held.get((length, cell, side), (0, np.inf, 0.0, ids[:0], ds[:0]))
                    near = _least(np.concatenate([old_ids, ids]), np.concatenate([old_ds, ds]), k)
                    held[length, cell, side] = (n + len(part), min(low, part[far].min()), max(high, part[far].max()), *near)
        if held:
            yield pd.DataFrame([(*key, *values[:3], *map(list, values[3:])) for key, values in held.items()], columns=["len", "cell", "query", "n", "low", "high", "ids", "ds"])

    return each


def _merged(k: int):
    def each(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        ids, ds = (np.concatenate([np.asarray(a) for a in rows[c]]) for c in ("ids", "ds"))
        ids, ds = _least(ids.astype(np.int64), ds.astype(float), k)
        return pd.DataFrame({"len": [key[0]], "cell": [key[1]], "query": [key[2]], "n": [rows["n"].sum()], "low": [rows["low"].min()], "high": [rows["high"].max()], "ids": [list(ids)], "ds": [list(ds)]})

    return each


#: For data: rows of ``cell`` with a distance in [low, high] go to group ``grp`` (in ``q_blocks`` blocks), in one of ``d_blocks`` data blocks from
#: ``d_block``.  For queries: a cell's group, the blocks of its queries, and the data blocks that meet it.
ROUTE = "len int, query boolean, cell int, grp int, q_blocks int, low double, high double, d_block int, d_blocks int, meets array<int>"


def reach(pivots: Pivots | None, q: pd.DataFrame, c: pd.DataFrame, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(low, high) by query cell and data cell: which distances from its pivot a row that a query may need can have."""
    if pivots is None:
        return np.full((len(q), len(c)), -np.inf), np.full((len(q), len(c)), np.inf)
    between = pivots.distances(pivots.asks[q["cell"].to_numpy(int)])[:, c["cell"].to_numpy(int)]
    wide, ids = q["high"].to_numpy()[:, None], np.concatenate([np.asarray(a, np.int64) for a in c["ids"]])
    owner, ds = np.repeat(np.arange(len(c)), c["ids"].map(len)), np.concatenate([np.asarray(a, float) for a in c["ds"]])
    farthest = np.full(len(q), np.inf)
    for i in range(len(q)):
        upper = wide[i] + between[i][owner] + ds
        # One of the k + 1 may be the query itself.
        near = _least(ids, upper, k + 1)[1]
        if len(near) == k + 1:
            farthest[i] = near[-1]
    slack = SLACK * (pivots.radius + 1)
    gap = wide + farthest[:, None] + slack
    return between - gap, between + gap


def _route(sent, k: int, data_rows: int, query_block: int):
    """The plan of one vector length, from the summaries of its cells."""

    def each(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        pivots = sent.value.get(int(key[0]))
        q, c = rows[rows["query"]], rows[~rows["query"]]
        if not len(q):
            return pd.DataFrame(columns=[x.split()[0] for x in ROUTE.split(", ")])
        if pivots is not None:  # neighbouring cells stand together
            axis = np.linalg.svd(pivots.points - pivots.points.mean(0), full_matrices=False)[2][0]
            q, c = (x.iloc[np.lexsort((x["cell"], (p @ axis)[x["cell"].to_numpy(int)]))] for x, p in ((q, pivots.asks), (c, pivots.points)))
        low, high = reach(pivots, q, c, k)
        n, asked = c["n"].to_numpy(), q["n"].to_numpy()
        near, far = c["low"].to_numpy(), c["high"].to_numpy()
        for size in (query_block // 64, query_block // 16, query_block // 4, query_block):
            group, at, held = np.empty(len(q), int), 0, 0
            for i, m in enumerate(asked):
                at, held = (at + 1, 0) if held and held + m > size else (at, held)
                group[i], held = at, held + m
            blocks = np.maximum(1, -(-np.bincount(group, asked).astype(int) // query_block))
            starts = np.searchsorted(group, np.arange(at + 1))
            g_low, g_high = np.minimum.reduceat(low, starts), np.maximum.reduceat(high, starts)
            meets = (g_low <= far[None, :]) & (g_high >= near[None, :])
            width = np.maximum(far - near, 1e-300)
            share = np.clip((np.minimum(g_high, far) - np.maximum(g_low, near) + 1e-300) / width, 0, 1)
            if (meets * share * n * blocks[:, None]).sum() <= COPIES * n.sum():
                break
        # Data blocks: cells in a row up to the limit; a larger cell has blocks of its own.
        first, many, block, held = np.empty(len(c), int), np.ones(len(c), int), -1, data_rows
        for j, m in enumerate(n):
            if m > data_rows:
                many[j], first[j] = -(-m // data_rows), block + 1
                block, held = block + many[j], data_rows
            else:
                block, held = (block + 1, 0) if held + m > data_rows else (block, held)
                first[j], held = block, held + m
        out, cells = [], c["cell"].to_numpy(int)
        for g in range(at + 1):
            hit = np.flatnonzero(meets[g])
            out += [(key[0], False, cells[j], g, blocks[g], g_low[g, j], g_high[g, j], first[j], many[j], None) for j in hit]
            seen = sorted({b for j in hit for b in range(first[j], first[j] + many[j])})
            out += [(key[0], True, x, g, blocks[g], None, None, None, None, seen) for x in q["cell"].to_numpy(int)[group == g]]
        return pd.DataFrame(out, columns=[x.split()[0] for x in ROUTE.split(", ")]).astype({"d_block": "Int64", "d_blocks": "Int64"})

    return each


def solve(q: np.ndarray, q_ids: np.ndarray, x: np.ndarray, x_ids: np.ndarray, cell: np.ndarray, d: np.ndarray, pivots: Pivots | None, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query row, id, score) of each query's k best of these rows; its own id is left out, rows of one id count once.

    Cells are taken in turn, the nearest to most queries first; a query passes over a cell that triangle inequalities rule out.
    """
    top_q, top_id, top_s = (np.empty(0, np.int64) for _ in range(3))
    kth = np.full(len(q), float(LONG.min))
    norm = np.sqrt((q.astype(float) ** 2).sum(1))
    away = None if pivots is None else pivots.distances(pivots.scaled(q.astype(float)))
    order = np.lexsort((x_ids, d, cell) if away is None else (x_ids, d, cell, away.mean(0)[cell]))
    first_of_id = np.zeros(len(x), bool)
    first_of_id[np.unique(x_ids, return_index=True)[1]] = True
    ends = np.flatnonzero(np.append(cell[order][1:] != cell[order][:-1], True)) + 1
    lo = 0
    for end in ends:
        while lo < end:
            hi = min(end, lo + STRIPE)
            at, lo = order[lo:hi], hi
            active = np.arange(len(q))
            if away is not None:
                r2 = pivots.radius**2
                limit = np.sqrt(np.maximum(0.0, 2 * r2 - 2 * pivots.radius * kth / np.where(norm > 0, norm, 1.0)))
                limit = np.where((norm > 0) & (kth > LONG.min), limit, np.inf) + SLACK * (pivots.radius + 1)
                mine = away[:, cell[at[0]]]
                active = np.flatnonzero((mine - d[at].max() <= limit) & (d[at].min() - mine <= limit))
            if not len(active):
                continue
            score = products(q[active], x[at])
            own = q_ids[active][:, None] == x_ids[at][None, :]
            one = first_of_id[at]
            bound = kth[active]
            if one.sum() > k:  # one of k + 1 may be the query's own
                bound = np.maximum(bound, -np.partition(-score[:, one].astype(float), k, axis=1)[:, k])
            i, j = np.nonzero((score.astype(float) >= bound[:, None]) & ~own)
            top_q, top_id = np.concatenate([top_q, active[i]]), np.concatenate([top_id, x_ids[at[j]]])
            top_s = np.concatenate([top_s, score[i, j].astype(np.int64)])
            if len(i):
                top_q, top_id, top_s = best(top_q, top_id, top_s, k)
                at_k = np.flatnonzero(np.append(top_q[1:] != top_q[:-1], True))
                n = np.diff(np.concatenate([[-1], at_k]))
                kth[top_q[at_k[n == k]]] = top_s[at_k[n == k]]
    return top_q, top_id, top_s


def best(q: np.ndarray, ids: np.ndarray, score: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best of each query, an id once, ties to the smaller id; in order."""
    down = -1 - score  # the complement: it has no overflow
    order = np.lexsort((down, ids, q))
    same = np.zeros(len(q), bool)
    same[1:] = (q[order][1:] == q[order][:-1]) & (ids[order][1:] == ids[order][:-1])
    keep = order[~same]
    keep = keep[np.lexsort((ids[keep], down[keep], q[keep]))]
    starts = np.flatnonzero(np.append(True, q[keep][1:] != q[keep][:-1])) if len(keep) else np.empty(0, int)
    rank = np.arange(len(keep)) - np.repeat(starts, np.diff(np.append(starts, len(keep))))
    keep = keep[rank < k]
    return q[keep], ids[keep], score[keep]


def _solver(sent, k: int):
    def each(key: tuple, data: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        length = int(key[0])
        pivots = sent.value.get(length)
        q_ids, x_ids = asked["vec_id"].to_numpy(np.int64), data["vec_id"].to_numpy(np.int64)
        i, ids, score = solve(unpacked(asked["data"], length), q_ids, unpacked(data["data"], length), x_ids, data["cell"].to_numpy(int), data["d"].to_numpy(), pivots, k)
        return pd.DataFrame({"query_id": q_ids[i], "vec_id": ids, "score": score})

    return each


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", seed: int = 13, query_block: int = QUERY_BLOCK, least_rows: int = LEAST_ROWS) -> DataFrame:
    """query_id, rank, vec_id, score: exactly the ``k`` rows of largest inner product of floor(256 * x) for each query.

    ``is_query`` is a condition on the column ``vec_id``.  Null ids, and vectors that are null or hold null or non-finite components,
    take no part; zero and empty vectors do.  A query meets the vectors of its own length only.  Rows of one id are one candidate with
    its best score and, as queries, one query; none is its own candidate.  Ties go to the smaller id; a query with fewer than ``k``
    candidates gets all; components and scores beyond a long take its end.  An empty table gives an empty result; other columns are
    ignored.  A cell with a third of all rows is dealt to blocks, as are the queries of a group.
    """
    spark = vectors.sparkSession
    finite = F.forall("v", lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < F.lit(float("inf"))))
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))
    rows = rows.where(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & finite).withColumn("q", F.coalesce(is_query, F.lit(False)))
    norm2 = F.aggregate("v", F.lit(0.0), lambda a, e: a + F.pow(F.floor(e * 256.0).cast("double"), 2))
    known = rows.groupBy(F.size("v").alias("n")).agg(F.count("*").alias("rows"), F.sqrt(F.max(norm2)).alias("radius")).orderBy(F.desc("rows"), "n").limit(LENGTHS).collect()
    sizes = {r["n"]: (r["rows"], r["radius"] * (1 + 1e-9)) for r in known}
    total = sum(r["rows"] for r in known)
    sample = hash_sample(rows.select("vec_id", "v"), SAMPLE, str(seed), "vec_id", max(1, total)).limit(2 * SAMPLE).toPandas().sort_values("vec_id")
    sent = spark.sparkContext.broadcast(fit(sample, sizes, seed))
    data_rows = int(min(MOST_ROWS, max(least_rows, total / 64)))
    assigned, path = save(rows.mapInPandas(_assign(sent), ASSIGNED))
    summary = assigned.select("len", "cell", "d", "vec_id", "qcell", "qd").mapInPandas(_summaries(k + 1), SUMMARY)
    summary = summary.groupBy("len", "cell", "query").applyInPandas(_merged(k + 1), SUMMARY)
    # Up to two summaries a pivot in a group: a plan of bounded size for each length.
    routes, plan = save(summary.groupBy("len").applyInPandas(_route(sent, k, data_rows, query_block), ROUTE))
    spread = lambda n, salt: F.pmod(F.xxhash64("vec_id", F.lit(salt), "salt"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    to_data = routes.where("not query").select("len", "cell", "grp", "q_blocks", F.col("low").alias("lo"), F.col("high").alias("hi"), "d_block", "d_blocks")
    left = assigned.join(to_data, ["len", "cell"]).where("d >= lo AND d <= hi").withColumn("d_block", F.col("d_block") + spread("d_blocks", 1)).withColumn("q_block", every("q_blocks"))
    # Read anew: the two sides of a cogroup must not share columns.
    asked, asked_routes = spark.read.schema(assigned.schema).parquet(path).where("qcell >= 0"), spark.read.schema(routes.schema).parquet(plan).where("query")
    to_queries = asked_routes.select("len", F.col("cell").alias("qcell"), "grp", "q_blocks", "meets")
    right = asked.select("len", "qcell", "vec_id", "data", "salt").join(to_queries, ["len", "qcell"]).withColumn("q_block", spread("q_blocks", 2)).withColumn("d_block", F.explode("meets"))
    keys = ["len", "grp", "q_block", "d_block"]
    left, right = left.select(*keys, "vec_id", "data", "cell", "d"), right.select(*keys, "vec_id", "data")
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(_solver(sent, k), "query_id long, vec_id long, score long")
    found = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op13(spark, sf_dir: str) -> DataFrame:
    """The 5 largest inner products of floor(256 * x) among all ``embeddings`` for each whose vec_id is divisible by 50: query_id, rank, vec_id, score."""
    return top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


OP13_SQL = """WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256e0 * CAST(x AS DOUBLE))) AS v FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
    FROM e q JOIN e c ON c.vec_id <> q.vec_id AND len(c.v) = len(q.v) WHERE q.vec_id % 50 = 0),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5"""
