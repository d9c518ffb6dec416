"""Graphs of tensors with a channel axis, for many worlds and many requests in one plan.

A layer's windows are (channels, rows, columns); by custom the last channel is the weight that the
others were multiplied with, so values and weights travel together.  A window names its world by a
seed, which is a column like its place: tile functions take it from there.  What a tile function
reads comes by name: any channels of a rectangle of another layer, or, where that layer's windows are
single cells, a vector for each window.

Demand goes through the whole graph first: each layer's windows are the union of what all its readers
and the requests ask for, less what the store has; then each layer is computed once, from the sources
up.  Before tiles travel, the part that a window reads is cut out of them.  Cells come out of blocks without
overlaps, in which tiles were summed as arrays, so no sum goes over single cells.

Where a whole table is asked for once and nothing is to be kept, blocks of it take the sources' cells that they reach, and the
same tile functions are called for their windows in memory (:func:`rows_of`, :func:`within`).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import Shared
from .windows import WindowSpec

TILE = "seed long, wi long, wj long, data array<double>"
WINDOW = ["seed", "wi", "wj"]
#: Cells i0 to i1 and j0 to j1, ends exclusive.
Rectangle = tuple[int, int, int, int]


class Window(NamedTuple):
    seed: int
    wi: int
    wj: int


@dataclass(frozen=True)
class Read:
    """Channels ``low`` to ``high`` (exclusive; None: the last) of another layer under a window's rectangle in that layer's cells."""

    layer: Layer
    rows: WindowSpec
    cols: WindowSpec
    low: int = 0
    high: int | None = None

    @property
    def channels(self) -> tuple[int, int]:
        return self.low, self.layer.channels if self.high is None else self.high


@dataclass(frozen=True)
class Layer:
    """A node: its tile function takes a :class:`Window` and a (channels, rows, columns) array for each name in ``reads``.

    With ``batch`` it takes a list of so many windows at most and arrays with one more axis in front.  Layers are equal by name.
    """

    id: str
    channels: int
    rows: WindowSpec
    cols: WindowSpec
    fn: Callable[..., np.ndarray] | None = field(compare=False)
    reads: dict[str, Read] = field(default_factory=dict, compare=False)
    batch: int | None = None

    def __post_init__(self) -> None:
        if self.channels <= 0 or (self.batch is not None and self.batch <= 0):
            raise ValueError("channels and a batch must be positive")
        for name, r in self.reads.items():
            if not 0 <= r.channels[0] < r.channels[1] <= r.layer.channels:
                raise ValueError(f"layer {self.id!r}: {name!r} reads channels {r.channels} of {r.layer.channels}")


class TileStore(Shared):
    """Layers by name and the tiles that were computed: a first definition and a first result stay.

    Tiles are Parquet tables in the shared folder.  A table counts once it is whole, so a failed task leaves nothing.
    """

    def __init__(self, spark: SparkSession, path: str | None = None) -> None:
        super().__init__(spark, path)
        self._layers, self._tables = {}, {}

    def layer(self, layer: Layer) -> Layer:
        return self._layers.setdefault(layer.id, layer)

    def tiles(self, layer: Layer) -> DataFrame:
        found = self._tables.get(layer.id)
        return self.spark.read.schema(TILE).parquet(*found) if found else self.spark.createDataFrame([], TILE)

    def put(self, layer: Layer, tiles: DataFrame) -> None:
        """Add tiles of windows that are not there yet."""
        fresh = tiles if layer.id not in self._tables else tiles.join(self.tiles(layer).select(*WINDOW), WINDOW, "left_anti")
        where = f"{self.path}/{layer.id}-{len(self._tables.get(layer.id, []))}"
        fresh.select(*WINDOW, "data").write.parquet(where)
        self._tables.setdefault(layer.id, []).append(where)

    def computed(self, layer: Layer) -> int:
        return self.tiles(layer).count()

    def release(self) -> None:
        super().release()
        self._tables = {}


def windows_of(ranges: DataFrame, rows: WindowSpec, cols: WindowSpec) -> DataFrame:
    """All windows (seed, wi, wj) that the rectangles (seed, i0, i1, j0, j1; ends exclusive) meet, each once.

    Lines of windows are dealt before they are filled, so a single large rectangle is many tasks.
    """
    lines = ranges.select("seed", F.explode(rows.covering("i0", "i1")).alias("wi"), "j0", "j1").repartition("seed", "wi")
    return lines.select("seed", "wi", F.explode(cols.covering("j0", "j1")).alias("wj")).distinct()


def _rectangle(read: Read) -> list[Column]:
    """What a window reads, as a rectangle."""
    return [read.rows.start("wi").alias("i0"), read.rows.stop("wi").alias("i1"), read.cols.start("wj").alias("j0"), read.cols.stop("wj").alias("j1")]


def _cut(layer: Layer, low: int, high: int, top: Column, left: Column, h: Column, w: Column) -> Column:
    """Channels of the ``h`` x ``w`` cells from (top, left) of a tile, one line of cells after the other."""
    lines = F.sequence(F.lit(0).cast("long"), F.lit(high - low) * h - 1)
    first = lambda k: ((low + F.floor(k / h)) * layer.rows.size + top + k % h) * layer.cols.size + left + 1
    return F.flatten(F.transform(lines, lambda k: F.slice("data", first(k).cast("int"), w.cast("int"))))


def _overlap(layer: Layer, i0: Column, i1: Column, j0: Column, j1: Column, ti: str = "ti", tj: str = "tj") -> dict[str, Column]:
    """Where the tile (ti, tj) and a rectangle meet: in the tile (top, left), in the rectangle (r, c), and how large."""
    a, b = layer.rows.start(ti), layer.cols.start(tj)
    top, left = F.greatest(i0 - a, F.lit(0)), F.greatest(j0 - b, F.lit(0))
    return {
        "top": top, "left": left, "r": a + top - i0, "c": b + left - j0,
        "h": F.least(i1 - a, F.lit(layer.rows.size)) - top, "w": F.least(j1 - b, F.lit(layer.cols.size)) - left,
    }


def placed(asks: DataFrame, layer: Layer, tiles: DataFrame, low: int, high: int) -> DataFrame:
    """Asks with a rectangle (seed, i0, i1, j0, j1) joined with the parts of the tiles that they meet: r, c, h, w, data."""
    at = asks.withColumn("ti", F.explode(layer.rows.covering("i0", "i1"))).withColumn("tj", F.explode(layer.cols.covering("j0", "j1")))
    met = at.join(tiles.select("seed", F.col("wi").alias("ti"), F.col("wj").alias("tj"), "data").hint("merge"), ["seed", "ti", "tj"])
    met = met.withColumns(_overlap(layer, F.col("i0"), F.col("i1"), F.col("j0"), F.col("j1")))
    return met.withColumn("data", _cut(layer, low, high, F.col("top"), F.col("left"), F.col("h"), F.col("w"))).drop("ti", "tj", "top", "left")


def _order(layers: list[Layer]) -> list[Layer]:
    """All layers below, sources first."""
    out: dict[str, Layer] = {}

    def visit(layer: Layer) -> None:
        if layer.id not in out:
            for r in layer.reads.values():
                visit(r.layer)
            out[layer.id] = layer

    for layer in layers:
        visit(layer)
    return list(out.values())


def ensure(store: TileStore, wanted: list[tuple[Layer, DataFrame]]) -> None:
    """Compute all missing tiles of the windows (seed, wi, wj) that are wanted, each window of each layer once."""
    asked: dict[str, list[DataFrame]] = {}
    for layer, windows in wanted:
        asked.setdefault(layer.id, []).append(windows.select(*WINDOW))
    order, missing = _order([store.layer(layer) for layer, _ in wanted]), {}
    for layer in reversed(order):
        found = asked.get(layer.id)
        if not found or layer.fn is None:
            continue
        whole = found[0]
        for more in found[1:]:
            whole = whole.unionByName(more)
        missing[layer.id] = store.held(whole.distinct().join(store.tiles(layer).select(*WINDOW), WINDOW, "left_anti"))
        for r in layer.reads.values():
            asked.setdefault(r.layer.id, []).append(windows_of(missing[layer.id].select("seed", *_rectangle(r)), r.layer.rows, r.layer.cols))
    for layer in order:
        if layer.id in missing:
            _compute(store, layer, missing[layer.id])


def _dealt(store: TileStore, layer: Layer, windows: DataFrame, tasks: int | None = None) -> DataFrame:
    """What windows read, cut out of the store's tiles and dealt by window, the parts of a window one after the other."""
    none = {"read": F.lit(-1), **{n: F.lit(0).cast("long") for n in "rchw"}, "data": F.array().cast("array<double>")}
    parts = windows.select(*WINDOW, *[v.alias(k) for k, v in none.items()])
    for n, r in enumerate(layer.reads.values()):
        asks = windows.select(*WINDOW, *_rectangle(r))
        met = placed(asks, r.layer, store.tiles(r.layer), *r.channels)
        parts = parts.unionByName(met.select(*WINDOW, F.lit(n).alias("read"), *[F.col(c).cast("long").alias(c) for c in "rchw"], "data"))
    return parts.repartition(*([tasks] if tasks else []), *WINDOW).sortWithinPartitions(*WINDOW, "read", "r", "c")


def _compute(store: TileStore, layer: Layer, windows: DataFrame) -> None:
    store.put(layer, _dealt(store, layer, windows).mapInPandas(_assembler(layer), TILE))


def _outputs(layer: Layer, ready: list[tuple[Window, dict[str, np.ndarray]]]) -> list[np.ndarray]:
    """The tiles of windows whose inputs are there: the tile function is called for one or a batch of them."""
    at, size = [key for key, _ in ready], (layer.channels, layer.rows.size, layer.cols.size)
    if layer.batch is None:
        out = [np.asarray(layer.fn(key, **inputs), float) for key, inputs in ready]
    else:
        out = list(np.asarray(layer.fn(at, **{n: np.stack([inputs[n] for _, inputs in ready]) for n in layer.reads}), float))
    if len(out) != len(at) or any(a.shape != size for a in out):
        raise ValueError(f"layer {layer.id!r}: {len(at)} windows of {size} were asked for, {[a.shape for a in out][:3]} came")
    return out


def _gather(layer: Layer, most: int):
    """Puts the inputs of windows together as their parts come in: lists of so many windows and inputs at most."""
    shapes = {n: (r.channels[1] - r.channels[0], r.rows.size, r.cols.size) for n, r in layer.reads.items()}
    names = list(shapes)

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[list[tuple[Window, dict[str, np.ndarray]]]]:
        ready: list = []
        for b in batches:
            for seed, wi, wj, read, r, c, h, w, data in zip(*[b[n] for n in (*WINDOW, "read", *"rchw", "data")], strict=True):
                key = Window(int(seed), int(wi), int(wj))
                if not ready or ready[-1][0] != key:
                    if len(ready) == most:
                        yield ready
                        ready = []
                    ready.append((key, {n: np.zeros(s) for n, s in shapes.items()}))
                if read >= 0:
                    n = names[read]
                    ready[-1][1][n][:, r : r + h, c : c + w] += np.asarray(data).reshape(shapes[n][0], h, w)
        if ready:
            yield ready

    return each


def _assembler(layer: Layer):
    """Tiles of windows from their parts."""
    gather = _gather(layer, layer.batch or 16)

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for ready in gather(batches):
            columns = {n: [getattr(key, n) for key, _ in ready] for n in WINDOW}
            yield pd.DataFrame(columns | {"data": [a.ravel() for a in _outputs(layer, ready)]})

    return each


def rows_of(store: TileStore, layer: Layer, windows: DataFrame, schema: str, tasks: int) -> DataFrame:
    """Rows instead of tiles: the layer's function gives columns by name for each window, as they are read, and nothing of them is kept.

    What the layer reads must be in the store.  One window at a time is in a task's memory.
    """
    gather, fn = _gather(layer, 1), layer.fn

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for [(key, inputs)] in gather(b.to_pandas() for b in batches):
            columns = fn(key, **inputs)
            n = len(next(iter(columns.values())))
            for k in range(0, n, 16384):
                yield pa.RecordBatch.from_pydict({c: pa.array(v[k : k + 16384]) for c, v in columns.items()})

    return _dealt(store, layer, windows, tasks).mapInArrow(each, schema)


def reach(wanted: list[tuple[Layer, Rectangle]]) -> tuple[dict[str, Rectangle], dict[str, tuple[range, range]]]:
    """What rectangles of layers take of all layers below: a rectangle of cells of each, and of windows of those that are computed."""
    cells: dict[str, Rectangle] = {}
    windows: dict[str, tuple[range, range]] = {}

    def ask(layer: Layer, at: Rectangle) -> None:
        old = cells.get(layer.id, at)
        cells[layer.id] = (min(old[0], at[0]), max(old[1], at[1]), min(old[2], at[2]), max(old[3], at[3]))

    for layer, at in wanted:
        ask(layer, at)
    for layer in reversed(_order([layer for layer, _ in wanted])):
        if layer.fn is None or layer.id not in cells:
            continue
        i0, i1, j0, j1 = cells[layer.id]
        wi, wj = windows[layer.id] = layer.rows.meeting(i0, i1), layer.cols.meeting(j0, j1)
        if wi and wj:
            for r in layer.reads.values():
                ask(r.layer, (r.rows.start_of(wi[0]), r.rows.start_of(wi[-1]) + r.rows.size, r.cols.start_of(wj[0]), r.cols.start_of(wj[-1]) + r.cols.size))
    return cells, windows


def within(wanted: list[tuple[Layer, Rectangle]], seed: int, given: dict[str, tuple[np.ndarray, int, int]]) -> list[np.ndarray]:
    """Channels of rectangles of layers, overlaps summed, where a task has the sources' cells: arrays and their first cells by layer.

    Every window that a rectangle takes is computed by its tile function, each once, as :func:`ensure` does, but in memory.
    """
    (cells, windows), held = reach(wanted), {}
    for layer in _order([layer for layer, _ in wanted]):
        if layer.fn is None:
            held[layer.id] = given[layer.id]
            continue
        if layer.id not in windows:
            continue
        # Sums go over whole windows; what lies beyond the cells that are taken is cut off, as not all windows of it are there.
        (wi, wj), (i0, i1, j0, j1) = windows[layer.id], cells[layer.id]
        top, left = layer.rows.start_of(wi[0]) if wi else i0, layer.cols.start_of(wj[0]) if wj else j0
        sums = np.zeros((layer.channels, max(i1 - top, len(wi) * layer.rows.step + layer.rows.size), max(j1 - left, len(wj) * layer.cols.step + layer.cols.size)))
        sources = {}
        for name, r in layer.reads.items():
            if wi and wj:
                at = r.rows.start_of(wi[0]), r.rows.start_of(wi[-1]) + r.rows.size, r.cols.start_of(wj[0]), r.cols.start_of(wj[-1]) + r.cols.size
                sources[name] = _cells(held[r.layer.id], *r.channels, *at), r.rows, r.cols
        keys = [Window(seed, a, b) for a in wi for b in wj]
        for n in range(0, len(keys), layer.batch or 1):
            ready = []
            for key in keys[n : n + (layer.batch or 1)]:
                a, b = key.wi - wi[0], key.wj - wj[0]
                ready.append((key, {name: data[:, a * p.step : a * p.step + p.size, b * q.step : b * q.step + q.size] for name, (data, p, q) in sources.items()}))
            for (key, _), tile in zip(ready, _outputs(layer, ready), strict=True):
                a, b = (key.wi - wi[0]) * layer.rows.step, (key.wj - wj[0]) * layer.cols.step
                sums[:, a : a + layer.rows.size, b : b + layer.cols.size] += tile
        held[layer.id] = sums[:, i0 - top : i1 - top, j0 - left : j1 - left], i0, j0
    return [_cells(held[layer.id], 0, layer.channels, *at) for layer, at in wanted]


def _cells(held: tuple[np.ndarray, int, int], low: int, high: int, i0: int, i1: int, j0: int, j1: int) -> np.ndarray:
    """Channels of a rectangle of an array with its first cell; the array must have it."""
    data, top, left = held
    if i0 < top or j0 < left or i1 > top + data.shape[1] or j1 > left + data.shape[2]:
        raise IndexError(f"cells {(i0, i1, j0, j1)} of an array from {(top, left)} with {data.shape[1:]}")
    return data[low:high, i0 - top : i1 - top, j0 - left : j1 - left]


def from_cells(layer: Layer, cells: DataFrame, values: list[str]) -> DataFrame:
    """Tiles of a layer without overlaps from distinct cells (seed, i, j and a column a channel); what is absent or null is 0."""
    h, w, channels = layer.rows.size, layer.cols.size, len(values)
    place = (F.col("i") - layer.rows.start("wi")) * w + F.col("j") - layer.cols.start("wj")
    at = cells.withColumn("wi", F.explode(layer.rows.covering("i", F.col("i") + 1))).withColumn("wj", F.explode(layer.cols.covering("j", F.col("j") + 1)))
    own = [F.coalesce(F.col(v).cast("double"), F.lit(0.0)).alias(f"c{k}") for k, v in enumerate(values)]

    def fill(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        data = np.zeros((channels, h * w))
        data[:, part["k"].to_numpy(int)] = part[[f"c{k}" for k in range(channels)]].to_numpy(float).T
        return pd.DataFrame({**{n: [x] for n, x in zip(WINDOW, key, strict=True)}, "data": [data.ravel()]})

    return at.select(*WINDOW, place.alias("k"), *own).groupBy(*WINDOW).applyInPandas(fill, TILE)


def slices(store: TileStore, layer: Layer, requests: DataFrame, low: int = 0, high: int | None = None) -> DataFrame:
    """Channels of rectangles: (request, i, j, c<low>, ...), overlaps summed, for requests (request, seed, i0, i1, j0, j1).

    The windows of all requests are computed once, whoever asks; tiles come back to each request by a join of its range with its
    windows.  Cells that no window covers do not appear (they are 0).  A request id stands for one rectangle.
    """
    high = layer.channels if high is None else high
    layer = store.layer(layer)
    ensure(store, [(layer, windows_of(requests, layer.rows, layer.cols))])
    return cells_of(store, layer, requests, low, high)


def _blocks(layer: Layer, tiles: DataFrame, low: int, high: int, side: int, inside: tuple[int, int, int, int] | None = None) -> tuple[Layer, DataFrame]:
    """Tiles (seed, wi, wj, data) summed into blocks without overlaps of about ``side`` cells on a side; how many windows a cell has is the last channel.

    Each tile is cut up for its blocks, so the parts of arrays are all that travels; of what is not ``inside`` a rectangle (i0, i1, j0, j1) none does.
    """
    rows, cols = (WindowSpec(s.step * max(1, -(-side // s.step)), None, s.offset) for s in (layer.rows, layer.cols))
    block = Layer(f"{layer.id}-blocks", high - low + 1, rows, cols, None)
    at = tiles.withColumn("bi", F.explode(rows.covering(layer.rows.start("wi"), layer.rows.stop("wi"))))
    at = at.withColumn("bj", F.explode(cols.covering(layer.cols.start("wj"), layer.cols.stop("wj"))))
    i0, i1, j0, j1 = rows.start("bi"), rows.stop("bi"), cols.start("bj"), cols.stop("bj")
    if inside:
        i0, i1, j0, j1 = F.greatest(i0, F.lit(inside[0])), F.least(i1, F.lit(inside[1])), F.greatest(j0, F.lit(inside[2])), F.least(j1, F.lit(inside[3]))
    at = at.withColumns(_overlap(layer, i0, i1, j0, j1, "wi", "wj")).withColumns({"r": F.col("r") + i0 - rows.start("bi"), "c": F.col("c") + j0 - cols.start("bj")})
    at = at.where("h > 0 AND w > 0")
    data = _cut(layer, low, high, F.col("top"), F.col("left"), F.col("h"), F.col("w"))
    parts = at.select("seed", "bi", "bj", "wi", "wj", *[F.col(c).cast("long").alias(c) for c in "rchw"], data.alias("data"))
    dealt = parts.repartition("seed", "bi", "bj").sortWithinPartitions("seed", "bi", "bj", "wi", "wj")
    shape = (block.channels, rows.size, cols.size)

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ready: list = []
        frame = lambda: pd.DataFrame({**{n: [key[k] for key, _ in ready] for k, n in enumerate(WINDOW)}, "data": [a.ravel() for _, a in ready]})
        for b in batches:
            for seed, bi, bj, r, c, h, w, data in zip(*[b[n] for n in ("seed", "bi", "bj", *"rchw", "data")], strict=True):
                key = (int(seed), int(bi), int(bj))
                if not ready or ready[-1][0] != key:
                    if len(ready) == 16:
                        yield frame()
                        ready = []
                    ready.append((key, np.zeros(shape)))
                ready[-1][1][:-1, r : r + h, c : c + w] += np.asarray(data).reshape(-1, h, w)
                ready[-1][1][-1, r : r + h, c : c + w] += 1
        if ready:
            yield frame()

    return block, dealt.mapInPandas(each, TILE)


def cells_of(store: TileStore, layer: Layer, requests: DataFrame, low: int, high: int) -> DataFrame:
    """As :func:`slices`, from tiles that the store has."""
    block, blocks = _blocks(layer, store.tiles(layer), low, high, 12)
    # Ranges look as few to the planner as they were before they were laid on blocks: the join is one by sorting.
    at = placed(requests.select("request", "seed", "i0", "i1", "j0", "j1"), block, blocks, 0, block.channels)
    cut = at.select("request", (F.col("i0") + F.col("r")).alias("i"), (F.col("j0") + F.col("c")).alias("j"), "h", "w", "data")
    cut = cut.withColumn("n", F.explode(F.sequence(F.lit(0).cast("long"), F.col("h") * F.col("w") - 1)))
    channel = lambda k: F.get("data", (F.col("n") + k * F.col("h") * F.col("w")).cast("int"))
    own = [channel(k).alias(f"c{low + k}") for k in range(high - low)]
    return cut.where(channel(high - low) > 0).select("request", (F.col("i") + F.floor(F.col("n") / F.col("w"))).alias("i"), (F.col("j") + F.col("n") % F.col("w")).alias("j"), *own)


def rectangle(layer: Layer, tiles: DataFrame, i0: int, i1: int, j0: int, j1: int, low: int, high: int) -> DataFrame:
    """Channels of one rectangle: (i, j, c<low>, ...), overlaps summed, from tiles (seed, wi, wj, data) of one world.  Nothing is joined."""
    meets = (layer.rows.start("wi") < i1) & (layer.rows.stop("wi") > i0) & (layer.cols.start("wj") < j1) & (layer.cols.stop("wj") > j0)
    block, blocks = _blocks(layer, tiles.where(meets), low, high, 48, (i0, i1, j0, j1))
    h, w = block.rows.size, block.cols.size
    each = blocks.select(block.rows.start("wi").alias("i"), block.cols.start("wj").alias("j"), "data", F.explode(F.sequence(F.lit(0), F.lit(h * w - 1))).alias("n"))
    own = [F.get("data", F.col("n") + k * h * w).alias(f"c{low + k}") for k in range(high - low)]
    covered = F.get("data", F.col("n") + (high - low) * h * w) > 0
    return each.where(covered).select((F.col("i") + F.expr(f"n div {w}")).alias("i"), (F.col("j") + F.col("n") % w).alias("j"), *own)


def unweighted(value: str, weight: str, epsilon: float = 1e-6) -> Column:
    """A channel over its weight; 0 where the weight vanishes."""
    return F.when(F.col(weight) > epsilon, F.col(value) / F.col(weight)).otherwise(0.0)


def ramp(size: int) -> np.ndarray:
    """Blend weights along one axis of a window: 1 in the middle, a thousandth at the rim."""
    mid = (size - 1) / 2
    return 1 - 0.999 * np.minimum(1, np.abs(np.arange(size) - mid) / mid) if mid else np.ones(1)


@lru_cache(maxsize=64)
def _weights(h: int, w: int) -> np.ndarray:
    return np.outer(ramp(h), ramp(w))


def weighted(values: np.ndarray) -> np.ndarray:
    """A window's channels times its weights, and the weights as a last channel."""
    w = _weights(*values.shape[-2:])
    return np.concatenate([values * w, np.broadcast_to(w, (*values.shape[:-3], 1, *w.shape))], axis=-3)
