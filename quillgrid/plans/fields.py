"""Noise queries: every kind, rotation, return and warp over the line items as places."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import noise
from ..functions.noise import Noise
from . import noise_sql
from .tables import table

_KEEP = "l_orderkey, l_linenumber"
_XY = ["l_partkey - 300", "l_suppkey * 3 - 77"]
_XYZ = [*_XY, "l_linenumber * 11"]


def _places(spark, d):
    line = table(spark, d, "lineitem")
    return line.select("l_orderkey", "l_linenumber", *[F.expr(c).alias(n) for c, n in zip(_XYZ, "xyz", strict=True)])


def _field(n: Noise, dims: int):
    """The query of a noise field and its SQL."""

    def query(spark, d):
        out = noise.add_noise(_places(spark, d), list("xyz"[:dims]), n, "v")
        return out.select("l_orderkey", "l_linenumber", (F.round("v", 6) + 0.0).alias("v"))

    return query, noise_sql.field(n, "lineitem", _XYZ[:dims], _KEEP)


def _warp(n: Noise, dims: int, amplitude: float, kind: str, mode: str):
    names = list("xyz"[:dims])

    def query(spark, d):
        out = noise.warp(_places(spark, d).select("l_orderkey", "l_linenumber", *names), names, n, amplitude, kind, mode)
        return out.select("l_orderkey", "l_linenumber", *[(F.round(c, 4) + 0.0).alias(c) for c in names])

    return query, noise_sql.warped(n, "lineitem", _XYZ[:dims], _KEEP, names, amplitude, kind, mode)


_CELLS = Noise(seed=8, frequency=0.05, kind="cellular")


def cellular(spark, d):
    out = noise.cellular(_places(spark, d), ["x", "y"], seed=8, frequency=0.05)
    return out.select("l_orderkey", "l_linenumber", F.round("f1", 6).alias("f1"), F.round("f2", 6).alias("f2"))


QUERIES = {
    "perlin_space": _field(Noise(seed=5, frequency=0.02, fractal="fbm", octaves=2), 3),
    "perlin_rotated": _field(Noise(seed=15, frequency=0.021, fractal="ridged", octaves=2, rotation="xz"), 3),
    "value_space": _field(Noise(seed=16, frequency=0.03, kind="value", fractal="pingpong", octaves=2, weighted=0.3), 3),
    "value_cubic": _field(Noise(seed=6, frequency=0.02, kind="cubic"), 2),
    "cubic_space": _field(Noise(seed=17, frequency=0.023, kind="cubic"), 3),
    "simplex_folded": _field(Noise(seed=7, frequency=0.02, kind="simplex", fractal="pingpong", octaves=2), 2),
    "simplex_space": _field(Noise(seed=18, frequency=0.017, kind="simplex", fractal="fbm", octaves=2), 3),
    "simplex_rotated": _field(Noise(seed=19, frequency=0.019, kind="simplex", rotation="xy"), 3),
    "smooth_fbm": _field(Noise(seed=20, frequency=0.018, kind="smooth", fractal="fbm", octaves=2), 2),
    "smooth_space": _field(Noise(seed=21, frequency=0.016, kind="smooth"), 3),
    "cellular": (cellular, noise_sql.nearest(_CELLS, "lineitem", _XY, _KEEP)),
    "cellular_value": _field(Noise(seed=22, frequency=0.05, kind="cellular", distance="euclidean", returns="value"), 2),
    "cellular_edges": _field(Noise(seed=23, frequency=0.04, kind="cellular", distance="euclidean", returns="difference"), 2),
    "cellular_sum": _field(Noise(seed=24, frequency=0.04, kind="cellular", distance="manhattan", returns="sum", jitter=0.7), 2),
    "cellular_product": _field(Noise(seed=25, frequency=0.04, kind="cellular", distance="hybrid", returns="product"), 2),
    "cellular_space": _field(Noise(seed=26, frequency=0.03, kind="cellular", distance="hybrid", returns="quotient"), 3),
    "cellular_second": _field(Noise(seed=27, frequency=0.03, kind="cellular", returns="second", fractal="fbm", octaves=2), 2),
    "domain_warp": _warp(Noise(seed=9, frequency=0.01, octaves=2), 2, 30.0, "grid", "progressive"),
    "warp_simplex": _warp(Noise(seed=10, frequency=0.012, octaves=2), 2, 20.0, "simplex", "independent"),
    "warp_reduced": _warp(Noise(seed=11, frequency=0.012), 2, 20.0, "reduced", "single"),
    "warp_space": _warp(Noise(seed=12, frequency=0.013, octaves=2), 3, 15.0, "simplex", "progressive"),
    "warp_space_reduced": _warp(Noise(seed=13, frequency=0.013, octaves=2, rotation="xz"), 3, 15.0, "reduced", "independent"),
    "warp_space_grid": _warp(Noise(seed=14, frequency=0.014, rotation="xy"), 3, 15.0, "grid", "single"),
}
