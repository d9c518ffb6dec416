"""Overlapping windows blended by triangular weights, and sums over regions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .windows import WindowSpec, assign, dense

EDGE = 1e-3


def triangle(r: Column, size: int, edge: float = EDGE) -> Column:
    """Weight of the cell ``r`` of a window: 1 in the middle, ``edge`` at its rim."""
    mid = (size - 1) / 2
    if mid == 0:
        return F.lit(1.0)
    return F.lit(1.0) - F.lit(1.0 - edge) * F.least(F.lit(1.0), F.abs(r - F.lit(mid)) / F.lit(mid))


def total_weight(at: str, spec: WindowSpec) -> Column:
    """The weights of all windows of an axis that cover ``at``, summed from the closed form; those of a cell are the product of its axes'."""
    last = spec.highest(F.col(at) + 1)
    total = F.lit(0.0)
    for k in range(-(-spec.size // spec.step)):
        r = F.col(at) - spec.start(last - k)
        total = total + F.when(r < spec.size, triangle(r, spec.size)).otherwise(0.0)
    return total


def window_means(cells: DataFrame, rows: WindowSpec, cols: WindowSpec) -> DataFrame:
    """A stand-in tile function: every window holds the mean of its cells."""
    return assign(cells, rows, cols).groupBy("wi", "wj").agg(F.avg("v").alias("v"))


def spread(tiles: DataFrame, rows: WindowSpec, cols: WindowSpec) -> DataFrame:
    """The cells (i, j) of tiles (wi, wj) with their weights; tiles keep their other columns."""
    out = tiles.withColumn("i", F.explode(F.sequence(rows.start("wi"), rows.stop("wi") - 1)))
    out = out.withColumn("j", F.explode(F.sequence(cols.start("wj"), cols.stop("wj") - 1)))
    return out.withColumn("w", triangle(F.col("i") - rows.start("wi"), rows.size) * triangle(F.col("j") - cols.start("wj"), cols.size))


def blend(weighted: DataFrame, by: tuple[str, ...] = ("i", "j"), epsilon: float = 1e-6) -> DataFrame:
    """Sum of v * w over sum of w per cell; 0 where the weights vanish."""
    sums = weighted.groupBy(*by).agg(F.sum(F.col("v") * F.col("w")).alias("num"), F.sum("w").alias("den"))
    return sums.select(*by, F.when(F.col("den") > epsilon, F.col("num") / F.col("den")).otherwise(0.0).alias("v"), "den")


def blend_cells(cells: DataFrame, rows: WindowSpec, cols: WindowSpec) -> DataFrame:
    """Window means blended back at the cells that exist: one shuffle for the means, one for the sums."""
    means = window_means(cells, rows, cols)
    placed = assign(cells.select("i", "j"), rows, cols)
    placed = placed.withColumn("w", triangle(F.col("i") - rows.start("wi"), rows.size) * triangle(F.col("j") - cols.start("wj"), cols.size))
    return blend(placed.join(means, ["wi", "wj"]))


def slice_sum(contributions: DataFrame, i0: int, i1: int, j0: int, j1: int) -> DataFrame:
    """A rectangle of the sums of all contributions (i, j, v); uncovered cells are 0."""
    inside = contributions.where(F.col("i").between(i0, i1 - 1) & F.col("j").between(j0, j1 - 1))
    return dense(inside.groupBy("i", "j").agg(F.sum("v").alias("v")), i0, i1, j0, j1)


def accumulate(target: DataFrame, source: DataFrame, di: int, dj: int) -> DataFrame:
    """``target`` plus ``source`` moved by (di, dj), at the cells of ``target``."""
    moved = source.select((F.col("i") + di).alias("i"), (F.col("j") + dj).alias("j"), F.col("v").alias("add"))
    return target.join(moved, ["i", "j"], "left").select("i", "j", (F.col("v") + F.coalesce("add", F.lit(0.0))).alias("v"))
