"""Sinks: binary tiles and pictures, made where the data is."""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def raw_tiles(cells: DataFrame, tile: int = 256) -> DataFrame:
    """(ty, tx, data): heights as little-endian 16-bit rows followed by temperatures as 32-bit floats; absent cells are 0."""
    ty, tx = (F.floor(F.col(c) / tile).cast("long").alias(n) for c, n in (("i", "ty"), ("j", "tx")))

    def encode(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        elev, temp = np.zeros((tile, tile), "<i2"), np.zeros((tile, tile), "<f4")
        r, c = part["i"].to_numpy() - key[0] * tile, part["j"].to_numpy() - key[1] * tile
        elev[r, c] = np.clip(np.floor(part["elev"].to_numpy()), -32768, 32767)
        temp[r, c] = part["temp"].to_numpy()
        return pd.DataFrame({"ty": [key[0]], "tx": [key[1]], "data": [elev.tobytes() + temp.tobytes()]})

    return cells.select("i", "j", "elev", "temp", ty, tx).groupBy("ty", "tx").applyInPandas(encode, "ty long, tx long, data binary")


def png(rgb: np.ndarray) -> bytes:
    """A picture of an array (height, width, 3) of bytes."""
    h, w, _ = rgb.shape

    def chunk(kind: bytes, body: bytes) -> bytes:
        return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))

    lines = b"".join(b"\0" + rgb[r].astype(np.uint8).tobytes() for r in range(h))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(lines)) + chunk(b"IEND", b"")


def png_tiles(pixels: DataFrame, tile: int = 256) -> DataFrame:
    """(ty, tx, data): one picture per tile of pixels (i, j, r, g, b) in [0, 1]."""
    ty, tx = (F.floor(F.col(c) / tile).cast("long").alias(n) for c, n in (("i", "ty"), ("j", "tx")))

    def draw(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        rgb = np.zeros((tile, tile, 3))
        r, c = part["i"].to_numpy() - key[0] * tile, part["j"].to_numpy() - key[1] * tile
        rgb[r, c] = part[["r", "g", "b"]].to_numpy()
        return pd.DataFrame({"ty": [key[0]], "tx": [key[1]], "data": [png(np.floor(rgb * 255 + 0.5))]})

    return pixels.select("i", "j", "r", "g", "b", ty, tx).groupBy("ty", "tx").applyInPandas(draw, "ty long, tx long, data binary")
