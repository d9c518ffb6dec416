"""Lazy tiled tensors: a graph of window functions over unbounded grids, pulled by rectangles.

A node knows its window grid, its dependencies and the window of each dependency that one of its
windows reads.  ``slice`` pushes a rectangle down the graph as sets of windows (never as
one hull), asks the tile store what is there already, computes the missing windows in Spark, and
sums the overlapping windows of the result.  Tiles travel as arrays, cut to what a window reads, one row a tile and window that reads it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import layers
from .shared import Shared
from .windows import WindowSpec, window_list

TILE = "wi long, wj long, h int, w int, data array<double>"
#: A tile function: the window (wi, wj) and a 2-D array per dependency to a 2-D array of the window's size.  A batched one takes a list of
#: windows and a 3-D array per dependency, and returns a 3-D array, a window each.
TileFunction = Callable[..., "object"]


@dataclass
class Node:
    id: str
    rows: WindowSpec
    cols: WindowSpec
    fn: TileFunction
    deps: list[Node] = field(default_factory=list)
    dep_rows: list[WindowSpec] = field(default_factory=list)
    dep_cols: list[WindowSpec] = field(default_factory=list)
    batch: int | None = None  # windows that one call of a batched tile function gets at most

    def __post_init__(self) -> None:
        if self.batch is not None and self.batch <= 0:
            raise ValueError("a batch must be positive")


class Store:
    """Registry of nodes by id, and their computed windows: a first definition and a first result stay.

    Windows are Parquet tables under ``path``, or in a folder of the store's own among those that driver and executors share: a lost
    executor loses none, and a node's plan ends at the tables of its dependencies.
    """

    def __init__(self, spark: SparkSession, path: str | None = None) -> None:
        self.shared = Shared(spark, path)
        self.spark, self.path = spark, path or self.shared.path
        self.nodes: dict[str, Node] = {}
        self.tiles: dict[str, DataFrame] = {}
        self._dropped = 0

    def get_or_create(self, node: Node) -> Node:
        return self.nodes.setdefault(node.id, node)

    def known(self, node: Node) -> DataFrame:
        return self.tiles.get(node.id, self.spark.createDataFrame([], TILE))

    def put(self, node: Node, tiles: DataFrame) -> DataFrame:
        """Add windows that are not there yet to the node's table."""
        fresh = tiles.join(self.known(node).select("wi", "wj"), ["wi", "wj"], "left_anti") if node.id in self.tiles else tiles
        where = f"{self.path}/{node.id}"
        fresh.select("wi", "wj", "h", "w", "data").write.mode("append").parquet(where)
        self.tiles[node.id] = self.spark.read.schema(TILE).parquet(where)
        return self.tiles[node.id]

    def drop(self, node_id: str) -> None:
        found = self.tiles.pop(node_id, None)
        if found is not None:
            self._dropped += found.count()
            self.shared.delete(f"{self.path}/{node_id}")

    def computed(self) -> int:
        """Windows computed so far, dropped ones included."""
        return self._dropped + sum(t.count() for t in self.tiles.values())

    def clear(self) -> None:
        for node_id in list(self.tiles):
            self.drop(node_id)

    def release(self) -> None:
        """Delete what stands in the store's own folder."""
        self.shared.release()
        self.tiles = {}


def demand(node: Node, windows: DataFrame) -> list[tuple[Node, DataFrame]]:
    """The windows of each dependency that the windows (wi, wj) of a node read, each once."""
    out = []
    for dep, rows, cols in zip(node.deps, node.dep_rows, node.dep_cols, strict=True):
        ranges = windows.select(rows.start("wi").alias("i0"), rows.stop("wi").alias("i1"), cols.start("wj").alias("j0"), cols.stop("wj").alias("j1"))
        out.append((dep, window_list(ranges, dep.rows, dep.cols)))
    return out


def _layer(node: Node) -> layers.Layer:
    """A node as a layer of one channel."""
    return layers.Layer(node.id, 1, node.rows, node.cols, None)


def tiles_from(cells: DataFrame, node: Node) -> DataFrame:
    """The tiles of a node that a table of cells (i, j, v) fills; absent cells are 0."""
    rows, cols = node.rows, node.cols
    at = cells.withColumn("wi", F.explode(rows.covering("i", F.col("i") + 1))).withColumn("wj", F.explode(cols.covering("j", F.col("j") + 1)))
    place = ((F.col("i") - rows.start("wi")) * cols.size + F.col("j") - cols.start("wj")).cast("int")
    filled = at.groupBy("wi", "wj", place.alias("k")).agg(F.sum("v").alias("v")).groupBy("wi", "wj").agg(F.map_from_entries(F.collect_list(F.struct("k", "v"))).alias("m"))
    data = F.transform(F.sequence(F.lit(0), F.lit(rows.size * cols.size - 1)), lambda k: F.coalesce(F.try_element_at("m", k), F.lit(0.0)))
    return filled.select("wi", "wj", F.lit(rows.size).alias("h"), F.lit(cols.size).alias("w"), data.alias("data"))


def ensure(store: Store, node: Node, windows: DataFrame, keep: bool = True) -> DataFrame:
    """The node's tiles, after the missing ones among ``windows`` were computed (dependencies first).

    Without ``keep``, tiles of this node that the store lacks are not put there: they are computed where they are used.
    """
    missing = windows.select("wi", "wj")
    if node.id in store.tiles:
        missing = missing.join(store.known(node).select("wi", "wj"), ["wi", "wj"], "left_anti")
    if node.deps:
        missing = store.shared.held(missing)  # every dependency's demand starts from it
    none = F.array().cast("array<double>")
    parts = missing.select("wi", "wj", F.lit(-1).alias("dep"), F.lit(0).cast("long").alias("r"), F.lit(0).cast("long").alias("c"), F.lit(0).alias("w"), none.alias("data"))
    for n, (dep, needed) in enumerate(demand(node, missing)):
        tiles = ensure(store, dep, needed).withColumn("seed", F.lit(0).cast("long"))
        rows, cols = node.dep_rows[n], node.dep_cols[n]
        asks = missing.select("wi", "wj", F.lit(0).cast("long").alias("seed"), rows.start("wi").alias("i0"), rows.stop("wi").alias("i1"), cols.start("wj").alias("j0"), cols.stop("wj").alias("j1"))
        met = layers.placed(asks, _layer(dep), tiles, 0, 1)
        parts = parts.unionByName(met.select("wi", "wj", F.lit(n).alias("dep"), "r", "c", F.col("w").cast("int").alias("w"), "data"))
    dealt = parts.repartition("wi", "wj").sortWithinPartitions("wi", "wj", "dep", "r", "c")
    made = dealt.mapInPandas(_compute(node), TILE)
    return store.put(node, made) if keep else store.known(node).unionByName(made) if node.id in store.tiles else made


def _compute(node: Node):
    """Assembles the windows as their parts come in, and calls the tile function for one or a batch of them."""
    size, fn, name, batch = (node.rows.size, node.cols.size), node.fn, node.id, node.batch
    shapes = [(r.size, c.size) for r, c in zip(node.dep_rows, node.dep_cols, strict=True)]

    def call(ready: list) -> pd.DataFrame:
        at = [key for key, _ in ready]
        if batch is None:
            out = [np.asarray(fn(*key, *arrays), float) for key, arrays in ready]
        else:
            out = list(np.asarray(fn(at, *[np.stack([arrays[n] for _, arrays in ready]) for n in range(len(shapes))]), float))
            if len(out) != len(ready):
                raise ValueError(f"tensor {name!r}: {len(ready)} windows were asked for, {len(out)} came")
        for a in out:
            if a.shape != size:
                raise ValueError(f"tensor {name!r}: a tile has shape {a.shape}, its window {size}")
        return pd.DataFrame({"wi": [k[0] for k in at], "wj": [k[1] for k in at], "h": size[0], "w": size[1], "data": [a.ravel() for a in out]})

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ready: list = []
        for b in batches:
            for wi, wj, dep, r, c, w, data in zip(b["wi"], b["wj"], b["dep"], b["r"], b["c"], b["w"], b["data"], strict=True):
                if not ready or ready[-1][0] != (wi, wj):
                    if len(ready) == (batch or 16):
                        yield call(ready)
                        ready = []
                    ready.append(((int(wi), int(wj)), [np.zeros(shape) for shape in shapes]))
                if dep >= 0:
                    part = np.asarray(data).reshape(-1, w)
                    ready[-1][1][dep][r : r + len(part), c : c + w] += part
        if ready:
            yield call(ready)

    return each


def slice_node(store: Store, node: Node, i0: int, i1: int, j0: int, j1: int, keep: bool = True) -> DataFrame:
    """The rectangle as cells (i, j, v), overlaps summed; cells that no window covers do not appear (their value is 0).

    A node that is read once needs no ``keep``: what it depends on is in the store, its own tiles are not.
    """
    node = store.get_or_create(node)
    ask = store.spark.createDataFrame([(i0, i1, j0, j1)], "i0 long, i1 long, j0 long, j1 long")
    windows = window_list(ask, node.rows, node.cols)
    tiles = ensure(store, node, windows, keep).withColumn("seed", F.lit(0).cast("long"))
    return layers.rectangle(_layer(node), tiles, i0, i1, j0, j1, 0, 1).withColumnRenamed("c0", "v")


def within_budget(accesses: DataFrame, budget: int, tensor: str = "tensor", key: str = "tile", at: str = "at", size: str = "bytes") -> DataFrame:
    """The tiles that a least-recently-used store of ``budget`` bytes a tensor still holds; the last one always stays."""
    from pyspark.sql import Window

    last = accesses.groupBy(tensor, key).agg(F.max(at).alias("last"), F.max_by(size, at).alias("bytes"))
    newest = Window.partitionBy(tensor).orderBy(F.desc("last"), F.desc(key))
    run = newest.rowsBetween(Window.unboundedPreceding, 0)
    return last.withColumns({"held": F.sum("bytes").over(run), "nth": F.row_number().over(newest)}).where((F.col("held") <= budget) | (F.col("nth") == 1)).drop("nth")


def strides(shape: tuple[int, ...]) -> tuple[int, ...]:
    out, step = [], 1
    for n in reversed(shape):
        out.append(step)
        step *= n
    return tuple(reversed(out))


def unflatten(rows: DataFrame, data: str, shape: tuple[int, int, int], keep: tuple[str, ...]) -> DataFrame:
    """Arrays as cells (ch, r, c, v) of a tensor in row-major order."""
    s = strides(shape)
    at = rows.select(*keep, F.posexplode(data).alias("k", "v"))
    return at.select(
        *keep, F.floor(F.col("k") / s[0]).cast("int").alias("ch"), (F.floor(F.col("k") / s[1]) % shape[1]).cast("int").alias("r"),
        (F.col("k") % shape[2]).cast("int").alias("c"), "v",
    )
