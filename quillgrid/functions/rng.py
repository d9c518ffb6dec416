"""Portable random numbers per tile: a 64-bit congruential generator with 32-bit output, and normals from it.

Spark's integer arithmetic does not wrap, so these are pandas functions on unsigned numpy arrays;
a tile is the unit of work.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Multiplier and increment of the generator and the multiplier of tile seeds (fixed values).
STEP, ADD, GOLDEN = 6364136223846793005, 1442695040888963407, 0x9E3779B9


def tile_seeds(base: int, ty: np.ndarray, tx: np.ndarray) -> np.ndarray:
    u = lambda a: a.astype(np.int64).view(np.uint64) & np.uint64(0xFFFFFFFF)
    h = np.uint64((base & (1 << 64) - 1) * GOLDEN & (1 << 64) - 1) + u(ty)
    return h * np.uint64(GOLDEN) + u(tx)


@lru_cache(maxsize=64)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """STEP^k and ADD * (STEP^(k-1) + ... + 1) of the first ``n`` states."""
    powers = np.cumprod(np.full(n, STEP, np.uint64))
    return powers, np.cumsum(np.concatenate([np.ones(1, np.uint64), powers[:-1]])) * np.uint64(ADD)


def outputs(seed: int, n: int) -> np.ndarray:
    """The first ``n`` 32-bit outputs, all at once: the k-th state is seed * STEP^k + ADD * (STEP^(k-1) + ... + 1)."""
    powers, sums = _powers(n)
    state = np.uint64(seed) * powers + sums
    x = (((state >> np.uint64(18)) ^ state) >> np.uint64(27)) & np.uint64(0xFFFFFFFF)
    rot = state >> np.uint64(59)
    return ((x >> rot) | (x << ((np.uint64(32) - rot) & np.uint64(31)))) & np.uint64(0xFFFFFFFF)


def normals(seed: int, n: int) -> np.ndarray:
    """``n`` standard normals by the polar method, in the order of accepted pairs."""
    want = int(n * 0.7) + 32
    while True:
        u = outputs(seed, 2 * want).astype(float)
        v = (2.0 * (u + 1.0) / 4294967296.0 - 1.0).reshape(-1, 2)
        s = v[:, 0] * v[:, 0] + v[:, 1] * v[:, 1]
        ok = (s > 0) & (s < 1)
        if 2 * ok.sum() >= n:
            break
        want *= 2
    at = np.flatnonzero(ok)[: (n + 1) // 2]
    s = s[at]
    f = np.sqrt(-2.0 * np.log(s) / s)
    return (v[at] * f[:, None]).ravel()[:n].astype(np.float32)


@lru_cache(maxsize=512)
def _tile(base: int, ty: int, tx: int, n: int) -> np.ndarray:
    """A tile's normals; neighbouring windows read the same ones."""
    seed = ((base * GOLDEN + (ty & 0xFFFFFFFF)) * GOLDEN + (tx & 0xFFFFFFFF)) & (1 << 64) - 1
    return normals(seed, n)


def patch(base: int, i0: int, j0: int, h: int, w: int, channels: int, tile: tuple[int, int]) -> np.ndarray:
    """(channels, h, w) normals of the cells from (i0, j0): they depend on the seed and the absolute cell only."""
    th, tw = tile
    out = np.empty((channels, h, w))
    for ty in range(i0 // th, (i0 + h - 1) // th + 1):
        for tx in range(j0 // tw, (j0 + w - 1) // tw + 1):
            made = _tile(base, ty, tx, channels * th * tw).reshape(channels, th, tw)
            r0, c0, r1, c1 = max(i0, ty * th), max(j0, tx * tw), min(i0 + h, ty * th + th), min(j0 + w, tx * tw + tw)
            out[:, r0 - i0 : r1 - i0, c0 - j0 : c1 - j0] = made[:, r0 - ty * th : r1 - ty * th, c0 - tx * tw : c1 - tx * tw]
    return out


def seed_column(base: int, ty: Column | str, tx: Column | str) -> Column:
    """The seed of a tile, as a signed long."""

    @F.pandas_udf("long")
    def seeds(y: pd.Series, x: pd.Series) -> pd.Series:
        return pd.Series(tile_seeds(base, y.to_numpy(), x.to_numpy()).view(np.int64))

    return seeds(ty, tx)


def gaussian_patch(cells: DataFrame, base: int, channels: int = 1, tile: int = 64) -> DataFrame:
    """``cells`` (i, j) with ``ch`` and ``v``: noise that depends on the absolute cell only.

    Cells are dealt by tile, and a tile's normals are made once where its cells are; a hot tile
    holds tile * tile cells at most when cells are distinct.
    """
    ty, tx = (F.floor(F.col(c) / tile).cast("long") for c in ("i", "j"))

    def fill(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        seed = int(tile_seeds(base, np.array([key[0]]), np.array([key[1]]))[0])
        flat = normals(seed, channels * tile * tile).reshape(channels, tile, tile)
        r, c = part["i"].to_numpy() - key[0] * tile, part["j"].to_numpy() - key[1] * tile
        return pd.concat([pd.DataFrame({"i": part["i"], "j": part["j"], "ch": ch, "v": flat[ch, r, c].astype(float)}) for ch in range(channels)])

    rows = cells.select(F.col("i").cast("long"), F.col("j").cast("long"), ty.alias("ty"), tx.alias("tx"))
    return rows.groupBy("ty", "tx").applyInPandas(fill, "i long, j long, ch int, v double")
