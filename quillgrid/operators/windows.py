"""Window grids over integer coordinates: which windows cover a cell, and which cells a window covers."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _col(x: Column | int | str) -> Column:
    return F.lit(x) if isinstance(x, int) else F.col(x) if isinstance(x, str) else x


def floor_div(a: Column | int | str, b: int) -> Column:
    """Division rounded down, also for negative numbers."""
    return F.floor(_col(a) / F.lit(float(b))).cast("long")


def ceil_div(a: Column | int | str, b: int) -> Column:
    return F.ceil(_col(a) / F.lit(float(b))).cast("long")


@dataclass(frozen=True)
class WindowSpec:
    """One axis of a window grid: window ``w`` covers ``[w * stride + offset, w * stride + offset + size)``.

    A stride of None tiles the axis.  Windows overlap where the stride is below the size and leave
    gaps where it is above.
    """

    size: int
    stride: int | None = None
    offset: int = 0

    def __post_init__(self) -> None:
        if self.size <= 0 or self.step <= 0:
            raise ValueError("size and stride must be positive")

    @property
    def step(self) -> int:
        return self.size if self.stride is None else self.stride

    def start(self, w: Column | int | str) -> Column:
        return _col(w) * self.step + self.offset

    def stop(self, w: Column | int | str) -> Column:
        return self.start(w) + self.size

    def lowest(self, begin: Column | int | str) -> Column:
        """The first window that reaches past ``begin``."""
        return ceil_div(_col(begin) - (self.offset + self.size - 1), self.step)

    def highest(self, end: Column | int | str) -> Column:
        """The last window that begins before ``end`` (exclusive)."""
        return floor_div(_col(end) - (1 + self.offset), self.step)

    def start_of(self, w: int) -> int:
        return w * self.step + self.offset

    def meeting(self, begin: int, end: int) -> range:
        """All windows that meet ``[begin, end)``."""
        return range(-((self.offset + self.size - 1 - begin) // self.step), (end - 1 - self.offset) // self.step + 1)

    def covering(self, begin: Column | int | str, end: Column | int | str) -> Column:
        """Array of all windows that meet ``[begin, end)``; empty where it lies in a gap."""
        lo, hi = self.lowest(begin), self.highest(end)
        return F.when(lo <= hi, F.sequence(lo, hi)).otherwise(F.array().cast("array<bigint>"))


def assign(cells: DataFrame, rows: WindowSpec, cols: WindowSpec, i: str = "i", j: str = "j") -> DataFrame:
    """Each cell once for every window (wi, wj) that covers it; generated from the closed form, so there is no join."""
    return cells.withColumn("wi", F.explode(rows.covering(i, F.col(i) + 1))).withColumn("wj", F.explode(cols.covering(j, F.col(j) + 1)))


def window_list(ranges: DataFrame, rows: WindowSpec, cols: WindowSpec) -> DataFrame:
    """All windows that the rectangles (i0, i1, j0, j1; ends exclusive) meet, each once.

    Lines of windows are dealt before they are filled, so a single large rectangle is many tasks; making them distinct needs no further shuffle.
    """
    lines = ranges.select(F.explode(rows.covering("i0", "i1")).alias("wi"), "j0", "j1").repartition("wi")
    return lines.select("wi", F.explode(cols.covering("j0", "j1")).alias("wj")).distinct()


def tile_snap(x: Column | str, tile: int) -> Column:
    """The start of the power-of-two tile that holds ``x``."""
    if tile <= 0 or tile & (tile - 1):
        raise ValueError("the tile size must be a power of two")
    bits = tile.bit_length() - 1
    return F.shiftleft(F.shiftright(_col(x), bits), bits)


def align(begin: Column | str, end: Column | str, unit: int) -> tuple[Column, Column]:
    """The range widened to multiples of ``unit``."""
    return floor_div(begin, unit) * unit, ceil_div(end, unit) * unit


def clamp(x: Column | str, low: Column | int, high: Column | int) -> Column:
    return F.greatest(_col(low), F.least(_col(high), _col(x)))


def native_range(begin: Column | str, end: Column | str, scale: int, pad: int = 2) -> tuple[Column, Column]:
    """Blocks to native cells at a scale, widened by the padding."""
    return floor_div(begin, scale) - pad, ceil_div(end, scale) + pad


def viewport(centre: Column | str, pan: int, size: int, unit: int = 256) -> tuple[Column, Column]:
    """The detail range of ``size`` cells around a coarse centre."""
    at = _col(centre) * unit + pan - size // 2
    return at, at + size


def dense(cells: DataFrame, i0: int, i1: int, j0: int, j1: int, fill: float = 0.0) -> DataFrame:
    """The rectangle ``[i0, i1) x [j0, j1)`` with every cell, ``fill`` where there was none."""
    # One number a cell, so that the planner knows the frame's size: it takes exploded rows for as many as before, and would broadcast them.
    w = max(0, j1 - j0)
    frame = cells.sparkSession.range(max(0, i1 - i0) * w).select(F.expr(f"id div {max(1, w)} + {i0}").alias("i"), (F.col("id") % max(1, w) + j0).alias("j"))
    inside = cells.where(F.col("i").between(i0, i1 - 1) & F.col("j").between(j0, j1 - 1)).select(F.col("i").cast("long"), F.col("j").cast("long"), "v")
    return frame.join(inside, ["i", "j"], "left").select("i", "j", F.coalesce("v", F.lit(fill)).alias("v"))


def crop(cells: DataFrame, i0: int, i1: int, j0: int, j1: int) -> DataFrame:
    """The cells of a rectangle, counted from its corner."""
    inside = F.col("i").between(i0, i1 - 1) & F.col("j").between(j0, j1 - 1)
    return cells.where(inside).withColumns({"i": F.col("i") - i0, "j": F.col("j") - j0})


def crop_clamped(cells: DataFrame, i0: int, i1: int, j0: int, j1: int, low: tuple[int, int], high: tuple[int, int]) -> DataFrame:
    """As :func:`crop`, where the rectangle may reach past the grid ``low..high`` and edge cells are repeated outwards."""
    frame = cells.sparkSession.range(i0, i1).select(F.col("id").alias("ti"), F.explode(F.sequence(F.lit(j0).cast("long"), F.lit(j1 - 1).cast("long"))).alias("tj"))
    frame = frame.withColumns({"i": clamp("ti", low[0], high[0]).cast("long"), "j": clamp("tj", low[1], high[1]).cast("long")})
    source = cells.select(F.col("i").cast("long"), F.col("j").cast("long"), "v")
    return frame.join(source, ["i", "j"]).select((F.col("ti") - i0).alias("i"), (F.col("tj") - j0).alias("j"), "v")
