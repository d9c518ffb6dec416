"""Colour maps as column expressions: a scalar in [0, 1] to red, green and blue in [0, 1].

A map is a table of 256 entries between anchor colours; the anchors are all that is stated, the
entries in between are interpolated.  Terrain and the red-blue map are piecewise linear by definition, so their entries are exact;
of
viridis every eighth entry is an anchor, and those in between are within 0.0065.  A full table can be given as anchors at k / 255.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Anchors (place, (red, green, blue)) of the maps; fixed values.
TERRAIN = [(0.0, (0.2, 0.2, 0.6)), (0.15, (0.0, 0.6, 1.0)), (0.25, (0.0, 0.8, 0.4)), (0.5, (1.0, 1.0, 0.6)), (0.75, (0.5, 0.36, 0.33)), (1.0, (1.0, 1.0, 1.0))]
VIRIDIS_STEPS = [
    (0.267004, 0.004874, 0.329415), (0.277018, 0.050344, 0.375715), (0.282327, 0.094955, 0.417331), (0.282884, 0.135920, 0.453427), (0.278826, 0.175490, 0.483397),
    (0.270595, 0.214069, 0.507052), (0.258965, 0.251537, 0.524736), (0.244972, 0.287675, 0.537260), (0.229739, 0.322361, 0.545706), (0.214298, 0.355619, 0.551184),
    (0.199430, 0.387607, 0.554642), (0.185556, 0.418570, 0.556753), (0.172719, 0.448791, 0.557885), (0.160665, 0.478540, 0.558115), (0.149039, 0.508051, 0.557250),
    (0.137770, 0.537492, 0.554906), (0.127568, 0.566949, 0.550556), (0.120565, 0.596422, 0.543611), (0.120638, 0.625828, 0.533488), (0.132268, 0.655014, 0.519661),
    (0.157851, 0.683765, 0.501686), (0.196571, 0.711827, 0.479221), (0.246070, 0.738910, 0.452024), (0.304148, 0.764704, 0.419943), (0.369214, 0.788888, 0.382914),
    (0.440137, 0.811138, 0.340967), (0.515992, 0.831158, 0.294279), (0.595839, 0.848717, 0.243329), (0.678489, 0.863742, 0.189503), (0.762373, 0.876424, 0.137064),
    (0.845561, 0.887322, 0.099702), (0.926106, 0.897330, 0.104071), (0.993248, 0.906157, 0.143936),
]
RDBU_R_STEPS = [
    (5, 48, 97), (33, 102, 172), (67, 147, 195), (146, 197, 222), (209, 229, 240), (247, 247, 247), (253, 219, 199), (244, 165, 130), (214, 96, 77), (178, 24, 43), (103, 0, 31),
]
SIZE = 256
VIRIDIS = [(min(8 * k, 255) / (SIZE - 1), c) for k, c in enumerate(VIRIDIS_STEPS)]
RDBU_R = [(k / 10, tuple(x / 255 for x in c)) for k, c in enumerate(RDBU_R_STEPS)]


def table(anchors: list[tuple[float, tuple[float, float, float]]]) -> list[tuple[float, float, float]]:
    """The map's 256 colours."""
    out = []
    for k in range(SIZE):
        t = k / (SIZE - 1)
        n = max(i for i in range(len(anchors) - 1) if anchors[i][0] <= t)
        (a, x), (b, y) = anchors[n], anchors[n + 1]
        f = (t - a) / (b - a)
        out.append(tuple(round(p + f * (q - p), 6) for p, q in zip(x, y, strict=True)))
    return out


def index(t: Column) -> Column:
    """Place of a scalar in a table."""
    return F.greatest(F.lit(0), F.least(F.lit(SIZE - 1), F.floor(t * (SIZE - 1) + 0.5).cast("int")))


def lookup(t: Column, anchors: list[tuple[float, tuple[float, float, float]]]) -> list[Column]:
    rows = table(anchors)
    return [F.get(F.array(*[F.lit(r[k]) for r in rows]), index(t)) for k in range(3)]


def terrain(t: Column) -> list[Column]:
    return lookup(t, TERRAIN)


def viridis(t: Column) -> list[Column]:
    return lookup(t, VIRIDIS)


def rdbu_r(t: Column) -> list[Column]:
    return lookup(t, RDBU_R)
