"""Nearest-match search on grids."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import layers


def all_land(cells: DataFrame, weight: str = "w", epsilon: float = 1e-6) -> DataFrame:
    """Cells (i, j) whose whole 3 x 3 neighbourhood is land: each land cell votes for its nine neighbours."""
    land = cells.where((F.col(weight) > epsilon) & (F.col("v") > 0)).select("i", "j").distinct()
    near = F.array(*[F.struct((F.col("i") + a).alias("i"), (F.col("j") + b).alias("j")) for a in (-1, 0, 1) for b in (-1, 0, 1)])
    return land.select(F.explode(near).alias("n")).select("n.*").groupBy("i", "j").count().where("count = 9").select("i", "j")


def nearest(cells: DataFrame, ci: int, cj: int) -> DataFrame:
    """The cell nearest to (ci, cj) by the larger of both distances, ties by row, then column."""
    di, dj = F.col("i") - ci, F.col("j") - cj
    at = cells.withColumns({"di": di, "dj": dj, "dist": F.greatest(F.abs(di), F.abs(dj))})
    return at.orderBy("dist", "di", "dj").limit(1).select("i", "j", "dist")


def expanding(cells: DataFrame, ci: int, cj: int, initial: int = 16, largest: int = 128, step: int = 8) -> DataFrame:
    """One row (i, j, step): the nearest cell in the smallest region that holds one; the centre and -1 if none does.

    A region of size n admits offsets -n/2 + 1 to n/2 - 2; regions grow by ``step`` to ``largest``.
    """
    di, dj = F.col("i") - ci, F.col("j") - cj
    need = F.greatest(2 * F.greatest(1 - di, di + 2), 2 * F.greatest(1 - dj, dj + 2))
    region = F.greatest(F.lit(0), F.ceil((need - initial) / F.lit(float(step))).cast("long"))
    found = cells.withColumns({"step": region, "di": di, "dj": dj, "dist": F.greatest(F.abs(di), F.abs(dj))})
    found = found.where(initial + F.col("step") * step <= largest)
    best = found.agg(F.min(F.struct("step", "dist", "di", "dj")).alias("b"))
    return best.select(
        F.coalesce(F.col("b.di") + ci, F.lit(ci)).cast("long").alias("i"), F.coalesce(F.col("b.dj") + cj, F.lit(cj)).cast("long").alias("j"),
        F.coalesce("b.step", F.lit(-1)).cast("long").alias("step"),
    )


def growing(
    store: layers.TileStore, layer: layers.Layer, seed: int, ci: int, cj: int, initial: int = 16, largest: int = 128, step: int = 8, value: int = 0, weight: int | None = None
) -> DataFrame:
    """One row (i, j, dist, size): the nearest cell whose neighbourhood is land, in the smallest region around (ci, cj) that holds one.

    Regions of a layer grow by ``step`` from ``initial`` to ``largest``, and each asks the store for the windows of its new ring only; the
    search stops at the first find.  Land is where channel ``value`` over channel ``weight`` (None: the last) is above 0.  Where
    there is none at all, the centre comes back with -1 for distance and size.
    """
    spark, weight = store.spark, layer.channels - 1 if weight is None else weight
    for size in range(initial, largest + 1, step):
        half = size // 2
        ends = {"i0": ci - half, "i1": ci + half, "j0": cj - half, "j1": cj + half}
        ask = spark.range(1).select(F.col("id").alias("request"), F.lit(seed).cast("long").alias("seed"), *[F.lit(v).cast("long").alias(k) for k, v in ends.items()])
        cells = layers.slices(store, layer, ask).select("i", "j", layers.unweighted(f"c{value}", f"c{weight}").alias("v"), F.col(f"c{weight}").alias("w"))
        found = nearest(all_land(cells), ci, cj).first()
        if found:
            return spark.createDataFrame([(found["i"], found["j"], found["dist"], size)], "i long, j long, dist long, size long")
    return spark.createDataFrame([(ci, cj, -1, -1)], "i long, j long, dist long, size long")
