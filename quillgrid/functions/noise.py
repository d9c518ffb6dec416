"""Deterministic coherent noise as column expressions: no Python runs on the executors.

32-bit wrapping arithmetic is done on longs whose low 32 bits are then read as a signed number.
Values are doubles.  Each function adds columns step by step, so nothing is computed twice.
"""

from __future__ import annotations

import functools
import itertools
import math
from dataclasses import dataclass

from pyspark import SparkContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Lattice primes and the hash multiplier (fixed values).
PRIMES = (501125321, 1136930381, 1720413743)
HASH = 0x27D4EB2D
#: Amplitudes that bring the kinds to about [-1, 1] (fixed values).
PERLIN_2D, PERLIN_3D, SIMPLEX_2D, SIMPLEX_3D = 1.4247691104677813, 0.964921414852142333984375, 99.83685446303647, 32.69428253173828125
SMOOTH_2D, SMOOTH_3D, CUBIC_2D, CUBIC_3D = 18.24196194486065, 9.046026385208288, 1 / 2.25, 1 / 3.375
#: What is added to the seed for the second lattice of the smooth kind, how far feature points lie off their cells, and the reach of warps (fixed values).
SECOND_SEED, JITTER_2D, JITTER_3D = 1293373, 0.43701595, 0.39614353
WARP_2D, WARP_3D = {"simplex": 38.283687591552734375, "reduced": 16.0, "grid": 1.0}, {"simplex": 32.69428253173828125, "reduced": 7.71604938271605, "grid": 1.0}
#: Directions that hashes choose from.
DIRECTIONS = 256


@dataclass(frozen=True)
class Noise:
    """Parameters of a noise field.

    kind: perlin, value, cubic, simplex, smooth (simplex with a wider kernel) or cellular; fractal: none, fbm, ridged or pingpong;
    rotation (three coordinates): none, xy or xz; of cellular noise, distance: euclidean, squared, manhattan or hybrid; returns: value, first,
    second, sum, difference, product or quotient (of the two nearest distances).  ``seed`` may be a column: a field for each row.
    ``directions``: 256 vectors, of as many numbers as there are coordinates, that cellular noise and warps choose from (None: by rule).
    """

    seed: int | Column = 1337
    frequency: float = 0.01
    kind: str = "perlin"
    fractal: str = "none"
    octaves: int = 3
    lacunarity: float = 2.0
    gain: float = 0.5
    weighted: float = 0.0
    pingpong: float = 2.0
    rotation: str = "none"
    distance: str = "squared"
    returns: str = "first"
    jitter: float = 1.0
    directions: tuple[tuple[float, ...], ...] | None = None

    @property
    def bounding(self) -> float:
        """One over the sum of the octaves' amplitudes."""
        return 1 / sum(abs(self.gain) ** k for k in range(self.octaves))


def wrap32(x: Column) -> Column:
    """The low 32 bits of a long as a signed number: shifts, which are never checked for overflow."""
    return F.shiftright(F.shiftleft(x, 32), 32)


@functools.cache
def _literal(application: str, name: str) -> Column:
    return F.expr(f"array({', '.join(f'{v!r}D' for v in _TABLES[name])})")


def _table(name: str, k: Column) -> Column:
    """The k-th value of a constant table; the table is parsed once in an application."""
    return F.get(_literal(SparkContext.getOrCreate().applicationId, name), k.cast("int"))


def apart(df: DataFrame, name: str) -> DataFrame:
    """The same rows, computed up to here on their own.

    Projections in a row are compiled to one loop; beyond the size that the JVM compiles to machine code it runs many times slower. A
    function with a lambda is outside such loops, so column ``name``, passed through one, ends the loop.
    """
    return df.withColumn(name, F.get(F.transform(F.array(name), lambda v: v), F.lit(0)))


def lattice_floor(x: Column) -> Column:
    """Rounded down, but negative whole numbers go one too low (as the noise family defines it)."""
    cut = x.cast("long")
    return F.when(x >= 0, cut).otherwise(cut - 1)


def hashed(seed: int | Column, *primed: Column) -> Column:
    h = F.lit(seed).cast("long")  # a column stays what it is
    for p in primed:
        h = h.bitwiseXOR(p)
    return wrap32(h * F.lit(HASH).cast("long"))


def _gradient_index(h: Column, bits: int, shift: int) -> Column:
    return F.shiftright(h.bitwiseXOR(F.shiftright(h, 15)).bitwiseAND(F.lit(bits << shift).cast("long")), shift)


def lattice_round(x: Column) -> Column:
    """The nearest whole number, halves away from zero."""
    return (x + F.when(x >= 0, 0.5).otherwise(-0.5)).cast("long")


def _bits(h: Column, shift: int, mask: int) -> Column:
    return F.shiftright(h, shift).bitwiseAND(F.lit(mask).cast("long"))


def _edge(k: int) -> tuple[float, float, float]:
    """The twelve edges of a cube in turn; the last four of 64 indices are edges 8, 1, 9 and 3."""
    e = k % 12 if k < 60 else (8, 1, 9, 3)[k - 60]
    a, b = 1.0 - 2.0 * (e & 1), 1.0 - (e & 2)
    return (0.0, a, b) if e < 4 else (a, 0.0, b) if e < 8 else (a, b, 0.0)


def _tables() -> dict[str, list[float]]:
    """Gradients: 24 directions 15 degrees apart, five times over, and eight more 45 degrees apart; the edges of a cube.

    Directions: evenly around the circle; on a spiral over the sphere.
    """
    plane = [math.radians(7.5 + 15.0 * (k % 24) if k < 120 else 22.5 + 45.0 * (k - 120)) for k in range(128)]
    turns, spiral = [2 * math.pi * k / DIRECTIONS for k in range(DIRECTIONS)], [k * math.pi * (3 - math.sqrt(5)) for k in range(DIRECTIONS)]
    rises = [1.0 - (2.0 * k + 1.0) / DIRECTIONS for k in range(DIRECTIONS)]
    flat = [math.sqrt(1.0 - z * z) for z in rises]
    edges = [_edge(k) for k in range(64)]
    return {
        "gradient_x": [math.sin(t) for t in plane], "gradient_y": [math.cos(t) for t in plane], **{f"edge_{c}": [e[n] for e in edges] for n, c in enumerate("xyz")},
        "circle_x": [math.cos(t) for t in turns], "circle_y": [math.sin(t) for t in turns],
        "sphere_x": [r * math.cos(t) for r, t in zip(flat, spiral, strict=True)], "sphere_y": [r * math.sin(t) for r, t in zip(flat, spiral, strict=True)], "sphere_z": rises,
    }


_TABLES = _tables()


def direction_2d(k: Column) -> list[Column]:
    """One of DIRECTIONS unit vectors, evenly around the circle."""
    return [_table("circle_x", k), _table("circle_y", k)]


def direction_3d(k: Column) -> list[Column]:
    """One of DIRECTIONS unit vectors on a spiral over the sphere."""
    return [_table("sphere_x", k), _table("sphere_y", k), _table("sphere_z", k)]


@functools.lru_cache(maxsize=16)
def _given(application: str, values: tuple[float, ...]) -> Column:
    return F.expr(f"array({', '.join(f'{float(v)!r}D' for v in values)})")


def directions_of(dims: int, given: tuple[tuple[float, ...], ...] | None):
    """A function from an index column to the vector's components: of the given table, else of the rule."""
    if given is None:
        return direction_2d if dims == 2 else direction_3d
    if len(given) != DIRECTIONS or any(len(v) != dims for v in given):
        raise ValueError(f"{DIRECTIONS} vectors of {dims} numbers are needed")
    tables = [_given(SparkContext.getOrCreate().applicationId, tuple(column)) for column in zip(*given, strict=True)]
    return lambda k: [F.get(t, k.cast("int")) for t in tables]


def gradient_2d(h: Column, dx: Column, dy: Column, k: Column | None = None) -> Column:
    """Dot product with the gradient that a hash (or an index) chooses."""
    k = _gradient_index(h, 127, 1) if k is None else k
    return dx * _table("gradient_x", k) + dy * _table("gradient_y", k)


def gradient_3d(h: Column, dx: Column, dy: Column, dz: Column, k: Column | None = None) -> Column:
    """Dot product with the cube edge that a hash (or an index) chooses."""
    k = _gradient_index(h, 63, 2) if k is None else k
    return dx * _table("edge_x", k) + dy * _table("edge_y", k) + dz * _table("edge_z", k)


def add_values(df: DataFrame, seeds: dict[str, Column]) -> DataFrame:
    """Columns with a value in [-1, 1) of each hash, in steps, so that no hash is computed twice."""
    df = df.withColumns({f"{n}_h": h for n, h in seeds.items()})
    df = df.withColumns({f"{n}_s": wrap32(F.col(f"{n}_h") * F.col(f"{n}_h")) for n in seeds})
    shifted = {n: wrap32(F.col(f"{n}_s") * F.lit(1 << 19).cast("long")) for n in seeds}
    return df.withColumns({n: wrap32(F.col(f"{n}_s").bitwiseXOR(x)) / F.lit(2147483648.0) for n, x in shifted.items()})


def lerp(a: Column, b: Column, t: Column) -> Column:
    return a + t * (b - a)


def hermite(t: Column) -> Column:
    return t * t * (3 - 2 * t)


def quintic(t: Column) -> Column:
    return t * t * t * (t * (t * 6 - 15) + 10)


def cubic(a: Column, b: Column, c: Column, d: Column, t: Column) -> Column:
    p = (d - c) - (a - b)
    return t * t * t * p + t * t * ((a - b) - p) + t * (c - a) + b


def _lattice(df: DataFrame, axes: list[str]) -> DataFrame:
    """Lattice cell and place in it for each axis column: _c<k>, _d<k>."""
    df = df.withColumns({f"_c{k}": lattice_floor(F.col(a)) for k, a in enumerate(axes)})
    return df.withColumns({f"_d{k}": F.col(a) - F.col(f"_c{k}") for k, a in enumerate(axes)})


def _primed(k: int, step: int = 0) -> Column:
    return wrap32(wrap32(F.col(f"_c{k}") * F.lit(PRIMES[k]).cast("long")) + F.lit(step * PRIMES[k]).cast("long"))


def _perlin(df: DataFrame, seed: int, axes: list[str], out: str, noise: Noise) -> DataFrame:
    n = len(axes)
    df = _lattice(df, axes)
    names = {b: f"_h{''.join(map(str, b))}" for b in itertools.product((0, 1), repeat=n)}
    df = df.withColumns({h: hashed(seed, *[_primed(k, x) for k, x in enumerate(b)]) for b, h in names.items()})
    dot = gradient_2d if n == 2 else gradient_3d
    corners = {b: dot(F.col(h), *[F.col(f"_d{k}") - x for k, x in enumerate(b)]) for b, h in names.items()}
    df = df.withColumns({f"_g{''.join(map(str, b))}": g for b, g in corners.items()} | {f"_s{k}": quintic(F.col(f"_d{k}")) for k in range(n)})
    now = {b: F.col(f"_g{''.join(map(str, b))}") for b in corners}
    for k in range(n):
        now = {b: lerp(now[(0, *b)], now[(1, *b)], F.col(f"_s{k}")) for b in itertools.product((0, 1), repeat=n - 1 - k)}
    return df.withColumn(out, now[()] * (PERLIN_2D if n == 2 else PERLIN_3D))


def _value(df: DataFrame, seed: int, axes: list[str], out: str, noise: Noise) -> DataFrame:
    n = len(axes)
    df = _lattice(df, axes)
    names = {b: f"_v{''.join(map(str, b))}" for b in itertools.product((0, 1), repeat=n)}
    df = add_values(df, {v: hashed(seed, *[_primed(k, x) for k, x in enumerate(b)]) for b, v in names.items()})
    now = {b: F.col(v) for b, v in names.items()}
    for k in range(n):
        now = {b: lerp(now[(0, *b)], now[(1, *b)], hermite(F.col(f"_d{k}"))) for b in itertools.product((0, 1), repeat=n - 1 - k)}
    return df.withColumn(out, now[()])


def _cubic(df: DataFrame, seed: int, axes: list[str], out: str, noise: Noise) -> DataFrame:
    """Lines of four along the first axis, then across the others."""
    df, n = _lattice(df, axes), len(axes)
    lines = {}
    for rest in itertools.product(range(-1, 3), repeat=n - 1):
        name = "_r" + "".join(str(y + 1) for y in rest)
        df = add_values(df, {f"_q{x + 1}": hashed(seed, _primed(0, x), *[_primed(k + 1, y) for k, y in enumerate(rest)]) for x in range(-1, 3)})
        df = df.withColumn(name, cubic(*[F.col(f"_q{x}") for x in range(4)], F.col("_d0")))
        if n == 3 and rest[1] % 2:
            df = apart(df, name)
        lines[rest] = F.col(name)
    for k in range(1, n):
        lines = {rest: cubic(*[lines[(y, *rest)] for y in range(-1, 3)], F.col(f"_d{k}")) for rest in itertools.product(range(-1, 3), repeat=n - 1 - k)}
    return df.withColumn(out, lines[()] * (CUBIC_2D if n == 2 else CUBIC_3D))


#: A lattice point near a place: its hash, the way from it, and how far the kernel is above zero there.
Corner = tuple[Column, list[Column], Column]


def _triangle(df: DataFrame, seed: int, reach: float, points: list[tuple[int, int]]) -> tuple[DataFrame, list[Corner]]:
    """Points of the triangular lattice around places whose coordinates are skewed already, by their offsets in skewed cells."""
    g = (3 - math.sqrt(3)) / 6
    df = _lattice(df, ["_a0", "_a1"])
    t = (F.col("_d0") + F.col("_d1")) * g
    df = df.withColumns({"_x": F.col("_d0") - t, "_y": F.col("_d1") - t})
    columns = {}
    for n, (p, q) in enumerate(points):
        columns |= {f"_x{n}": F.col("_x") - (p - (p + q) * g), f"_y{n}": F.col("_y") - (q - (p + q) * g), f"_h{n}": hashed(seed, _primed(0, p), _primed(1, q))}
    df = df.withColumns(columns)
    way = [[F.col(f"_x{n}"), F.col(f"_y{n}")] for n in range(len(points))]
    return df, [(F.col(f"_h{n}"), [x, y], F.greatest(F.lit(0.0), reach - x * x - y * y)) for n, (x, y) in enumerate(way)]


def _cubes(df: DataFrame, seed: int) -> tuple[DataFrame, list[Corner]]:
    """Of two cube lattices half a cell apart, each one's nearest point and the next along the longest way; rotated coordinates."""
    axes = range(3)
    df = df.withColumns({f"_c{k}": lattice_round(F.col(f"_a{k}")) for k in axes})
    df = df.withColumns({f"_d{k}": F.col(f"_a{k}") - F.col(f"_c{k}") for k in axes})
    df = df.withColumns({f"_u{k}": F.when(F.col(f"_d{k}") >= 0, -1).otherwise(1).cast("long") for k in axes})
    found = []
    for lattice in (0, 1):
        p = f"_l{lattice}"
        far = {f"{p}f{k}": F.abs(F.col(f"_d{k}")) if lattice == 0 else 0.5 - F.abs(F.col(f"_d{k}")) for k in axes}
        sign = [F.col(f"_u{k}") if lattice == 0 else -F.col(f"_u{k}") for k in axes]
        df = df.withColumns(far)
        f = [F.col(f"{p}f{k}") for k in axes]
        way = [F.col(f"_d{k}") if lattice == 0 else F.col(f"_u{k}") * f[k] for k in axes]
        cell = [F.col(f"_c{k}") + (F.when(F.col(f"_u{k}") < 0, 1).otherwise(0) if lattice == 1 else F.lit(0)) for k in axes]
        along = F.when((f[0] >= f[1]) & (f[0] >= f[2]), 0).when((f[1] > f[0]) & (f[1] >= f[2]), 1).otherwise(2)
        df = df.withColumns({f"{p}m": along} | {f"{p}w{k}": way[k] for k in axes} | {f"{p}c{k}": cell[k] for k in axes})
        step = [F.when(F.col(f"{p}m") == k, sign[k]).otherwise(F.lit(0).cast("long")) for k in axes]
        prime = [F.lit(PRIMES[k]).cast("long") for k in axes]
        own = seed if lattice == 0 else F.bitwise_not(seed) if isinstance(seed, Column) else ~seed
        df = df.withColumns(
            {f"{p}h": hashed(own, *[wrap32(F.col(f"{p}c{k}") * prime[k]) for k in axes]), f"{p}n": hashed(own, *[wrap32((F.col(f"{p}c{k}") - step[k]) * prime[k]) for k in axes])}
            | {f"{p}v{k}": F.col(f"{p}w{k}") + step[k] for k in axes}
        )
        df = apart(df, f"{p}v0")
        for h, w in (("h", "w"), ("n", "v")):
            d = [F.col(f"{p}{w}{k}") for k in axes]
            found.append((F.col(f"{p}{h}"), d, F.greatest(F.lit(0.0), 0.6 - d[0] * d[0] - d[1] * d[1] - d[2] * d[2])))
    return df, found


def _simplex(df: DataFrame, seed: int, axes: list[str], out: str, noise: Noise) -> DataFrame:
    if len(axes) == 2:
        df, corners = _triangle(df, seed, 0.5, [(0, 0), (1, 0), (0, 1), (1, 1)])
        return df.withColumn(out, sum((a * a * a * a * gradient_2d(h, *d) for h, d, a in corners), F.lit(0.0)) * SIMPLEX_2D)
    df, corners = _cubes(df, seed)
    return df.withColumn(out, sum((a * a * a * a * gradient_3d(h, *d) for h, d, a in corners), F.lit(0.0)) * SIMPLEX_3D)


def _smooth(df: DataFrame, seed: int, axes: list[str], out: str, noise: Noise) -> DataFrame:
    """The kernels reach over one lattice spacing: all lattice points within it add to the value."""
    if len(axes) == 2:
        # The corners of both triangles of a cell, and what lies opposite their edges.
        df, corners = _triangle(df, seed, 2 / 3, [(0, 0), (1, 0), (0, 1), (1, 1), (0, -1), (2, 1), (-1, 0), (1, 2)])
        return df.withColumn(out, sum((a * a * a * a * gradient_2d(h, *d) for h, d, a in corners), F.lit(0.0)) * SMOOTH_2D)
    df = _lattice(df, axes)
    # The second lattice is half a cell on; its corners below and above a place.
    df = df.withColumns({f"_b{k}": F.when(F.col(f"_d{k}") >= 0.5, 1).otherwise(0).cast("long") for k in range(3)})
    total = F.lit(0.0)
    for lattice, low, y in itertools.product((0, 1), repeat=3):
        columns, terms = {}, []
        for z in (0, 1):
            step = [F.lit(x).cast("long") + (F.col(f"_b{k}") if lattice else F.lit(0)) for k, x in enumerate((low, y, z))]
            columns |= {f"_w{k}{z}": F.col(f"_d{k}") - step[k] + 0.5 * lattice for k in range(3)}
            primed = [wrap32(wrap32(F.col(f"_c{k}") * F.lit(PRIMES[k]).cast("long")) + step[k] * F.lit(PRIMES[k]).cast("long")) for k in range(3)]
            columns[f"_h{z}"] = hashed(_signed(seed + SECOND_SEED * lattice), *primed)
            d = [F.col(f"_w{k}{z}") for k in range(3)]
            a = F.greatest(F.lit(0.0), 0.75 - d[0] * d[0] - d[1] * d[1] - d[2] * d[2])
            terms.append((a, gradient_3d(F.col(f"_h{z}"), *d)))
        # The kernel's height is a column of its own, as it enters four times.
        df = df.withColumns(columns).withColumns({f"_e{z}": a for z, (a, _) in enumerate(terms)})
        fourth = lambda z: F.col(f"_e{z}") * F.col(f"_e{z}") * F.col(f"_e{z}") * F.col(f"_e{z}")
        name = f"_t{lattice}{low}{y}"
        df = apart(df.withColumn(name, sum((fourth(z) * g for z, (_, g) in enumerate(terms)), F.lit(0.0))), "_d0")
        total = total + F.col(name)
    return df.withColumn(out, total * SMOOTH_3D)


def _signed(x: int | Column) -> int | Column:
    return wrap32(x.cast("long")) if isinstance(x, Column) else (x + (1 << 31)) % (1 << 32) - (1 << 31)


def nearest_points(df: DataFrame, seed: int, axes: list[str], distance: str, jitter: float, given: tuple[tuple[float, ...], ...] | None = None) -> DataFrame:
    """Of the feature points of the cells around a place: ``_f1``, ``_f2``, the distances of the two nearest, and ``_own``, the hash of the nearest one's cell.

    A feature point lies off its cell's corner in a direction that the cell's hash chooses.  Three cells at a time are compiled to a loop.
    """
    dims = len(axes)
    df = df.withColumns({f"_c{k}": lattice_round(F.col(a)) for k, a in enumerate(axes)})
    cells = list(itertools.product((-1, 0, 1), repeat=dims))
    off, direct = jitter * (JITTER_2D if dims == 2 else JITTER_3D), directions_of(dims, given)
    for group in range(0, len(cells), 3):
        now = list(enumerate(cells))[group : group + 3]
        df = df.withColumns({f"_h{n}": hashed(seed, *[_primed(k, x) for k, x in enumerate(cell)]) for n, cell in now})
        moves, found = {}, {}
        for n, cell in now:
            way = direct(_bits(F.col(f"_h{n}"), dims - 1, 255))
            moves |= {f"_w{k}{n}": F.col(f"_c{k}") + x - F.col(axes[k]) + way[k] * off for k, x in enumerate(cell)}
            w = [F.col(f"_w{k}{n}") for k in range(dims)]
            squares, sizes = sum((x * x for x in w), F.lit(0.0)), sum((F.abs(x) for x in w), F.lit(0.0))
            found[f"_e{n}"] = {"euclidean": squares, "squared": squares, "manhattan": sizes, "hybrid": sizes + squares}[distance]
        df = df.withColumns(moves).withColumns(found)
        for n, _ in now:
            e, f1, f2 = F.col(f"_e{n}"), F.col("_f1"), F.col("_f2")
            if n == 0:
                # Not a number is greater than any; what is null stays null.
                df = df.withColumns({"_f1": e, "_f2": F.when(e.isNotNull(), F.lit(float("nan"))), "_own": F.col("_h0")})
            else:
                df = df.withColumns({"_f1": F.least(f1, e), "_f2": F.least(f2, F.greatest(f1, e)), "_own": F.when(e < f1, F.col(f"_h{n}")).otherwise(F.col("_own"))})
        df = apart(df, axes[0])
    return df


def _cellular(df: DataFrame, seed: int, axes: list[str], out: str, noise: Noise) -> DataFrame:
    df = nearest_points(df, seed, axes, noise.distance, noise.jitter, noise.directions)
    a, b = (F.sqrt("_f1"), F.sqrt("_f2")) if noise.distance == "euclidean" else (F.col("_f1"), F.col("_f2"))
    made = {
        "value": F.col("_own") / 2147483648.0, "first": a - 1.0, "second": b - 1.0, "sum": (b + a) * 0.5 - 1.0, "difference": b - a - 1.0, "product": b * a * 0.5 - 1.0, "quotient": a / b - 1.0,
    }
    return df.withColumn(out, made[noise.returns])


_KINDS = {"perlin": _perlin, "value": _value, "cubic": _cubic, "simplex": _simplex, "smooth": _smooth, "cellular": _cellular}


def turned(df: DataFrame, axes: list[str], mode: str, simplex: bool) -> DataFrame:
    """Axis columns skewed (two) or rotated (three) for a kind of noise; ``mode``: none, xy or xz."""
    if len(axes) == 2:
        if not simplex:
            return df
        k = (F.col(axes[0]) + F.col(axes[1])) * (0.5 * (math.sqrt(3) - 1))
        return df.withColumn("_k", k).withColumns({a: F.col(a) + F.col("_k") for a in axes})
    root = math.sqrt(3)
    if mode in ("xy", "xz"):
        # The third axis goes along the diagonal, the plane of the other two across it.
        first, second, third = axes if mode == "xy" else (axes[0], axes[2], axes[1])
        both, up = F.col(first) + F.col(second), F.col(third) / root
        df = df.withColumns({"_k0": both * -((3 - root) / 6) - up, "_k1": up + both / root})
        return df.withColumns({first: F.col(first) + F.col("_k0"), second: F.col(second) + F.col("_k0"), third: F.col("_k1")})
    if not simplex:
        return df
    return df.withColumn("_k", (F.col(axes[0]) + F.col(axes[1]) + F.col(axes[2])) * (2 / 3)).withColumns({a: F.col("_k") - F.col(a) for a in axes})


def add_noise(df: DataFrame, coordinates: list[str | Column], noise: Noise, out: str) -> DataFrame:
    """``df`` with the noise at two or three coordinates in column ``out``."""
    if len(coordinates) not in (2, 3):
        raise ValueError(f"noise of {len(coordinates)} coordinates is not defined")
    single = _KINDS[noise.kind]
    columns = df.columns
    axes = [f"_a{k}" for k in range(len(coordinates))]
    df = df.withColumns({a: (F.col(c) if isinstance(c, str) else c).cast("double") * noise.frequency for a, c in zip(axes, coordinates, strict=True)})
    df = turned(df, axes, noise.rotation, noise.kind in ("simplex", "smooth"))
    if noise.fractal == "none":
        return single(df, noise.seed, axes, out, noise).select(*[c for c in columns if c != out], out)
    df = df.withColumns({"_sum": F.lit(0.0), "_amp": F.lit(noise.bounding)})
    for octave in range(noise.octaves):
        df = single(apart(df, "_a0") if octave else df, noise.seed + octave, axes, "_n", noise)
        n, w = F.col("_n"), noise.weighted
        if noise.fractal == "fbm":
            add, share = n, (F.least(n + 1, F.lit(2.0)) if len(axes) == 2 else n + 1) * 0.5
        elif noise.fractal == "ridged":
            add, share = F.abs(n) * -2 + 1, 1 - F.abs(n)
        else:
            p = (n + 1) * noise.pingpong
            p = p - F.lit(2.0) * (p * 0.5).cast("long")
            fold = F.when(p < 1, p).otherwise(2 - p)
            add, share = (fold - 0.5) * 2, fold
        df = df.withColumn("_sum", F.col("_sum") + add * F.col("_amp"))
        df = df.withColumn("_amp", F.col("_amp") * (1.0 + w * (share - 1.0)) * noise.gain)
        df = df.withColumns({a: F.col(a) * noise.lacunarity for a in axes})
    return df.withColumn(out, F.col("_sum")).select(*[c for c in columns if c != out], out)


def _pull(df: DataFrame, seed: int | Column, kind: str, dims: int, given: tuple[tuple[float, ...], ...] | None = None) -> tuple[DataFrame, list[Column]]:
    """The direction and strength of a warp at the axis columns."""
    direct, low = directions_of(dims, given), dims - 1
    if kind == "grid":
        df = _lattice(df, [f"_a{k}" for k in range(dims)])
        names = {b: "".join(map(str, b)) for b in itertools.product((0, 1), repeat=dims)}
        df = df.withColumns({f"_h{n}": hashed(seed, *[_primed(k, x) for k, x in enumerate(b)]) for b, n in names.items()})
        df = df.withColumns({f"_v{m}{n}": v for n in names.values() for m, v in enumerate(direct(_bits(F.col(f"_h{n}"), low, 255)))})
        pull = []
        for m in range(dims):
            now = {b: F.col(f"_v{m}{n}") for b, n in names.items()}
            for k in range(dims):
                now = {b: lerp(now[(0, *b)], now[(1, *b)], hermite(F.col(f"_d{k}"))) for b in itertools.product((0, 1), repeat=dims - 1 - k)}
            pull.append(now[()])
        return df, pull
    df, corners = _triangle(df, seed, 0.5, [(0, 0), (1, 0), (0, 1), (1, 1)]) if dims == 2 else _cubes(df, seed)
    strengths, pull = {}, [F.lit(0.0)] * dims
    for n, (h, d, a) in enumerate(corners):
        if kind == "reduced":
            weight, k = a * a * a * a, _bits(h, low, 255)
        else:
            dot = gradient_2d(h, *d, k=_bits(h, 1, 127)) if dims == 2 else gradient_3d(h, *d, k=_bits(h, 2, 63))
            weight, k = a * a * a * a * dot, _bits(h, 8, 255)
        strengths |= {f"_s{n}": weight, f"_k{n}": k}
    df = df.withColumns(strengths)
    for n in range(len(corners)):
        pull = [p + F.col(f"_s{n}") * v for p, v in zip(pull, direct(F.col(f"_k{n}")), strict=True)]
    return df, pull


def warp(df: DataFrame, coordinates: list[str], noise: Noise, amplitude: float, kind: str = "grid", mode: str = "progressive") -> DataFrame:
    """The coordinate columns (two or three) moved by gradients.

    kind: grid, simplex or reduced (directions only); mode: single (one octave), progressive (octaves start from the moved place) or
    independent (all start from the first place).  ``noise.rotation`` turns the lattice under three coordinates.
    """
    columns, dims = df.columns, len(coordinates)
    axes = [f"_a{k}" for k in range(dims)]
    df = df.withColumns({f"_b{k}": F.col(c).cast("double") for k, c in enumerate(coordinates)}).withColumns({f"_o{k}": F.col(c).cast("double") for k, c in enumerate(coordinates)})
    amp, freq, scale = amplitude * noise.bounding, noise.frequency, (WARP_2D if dims == 2 else WARP_3D)[kind]
    for octave in range(1 if mode == "single" else noise.octaves):
        df = apart(df, "_o0") if octave else df
        df = df.withColumns({a: F.col(f"_o{k}" if mode == "progressive" else f"_b{k}") for k, a in enumerate(axes)})
        df = turned(df, axes, noise.rotation, kind != "grid").withColumns({a: F.col(a) * freq for a in axes})
        df, pull = _pull(df, noise.seed + octave, kind, dims, noise.directions)
        df = df.withColumns({f"_o{k}": F.col(f"_o{k}") + v * (amp * scale) for k, v in enumerate(pull)})
        amp, freq = amp * noise.gain, freq * noise.lacunarity
    return df.withColumns({c: F.col(f"_o{k}") for k, c in enumerate(coordinates)}).select(*columns)


def cellular(points: DataFrame, coordinates: list[str], seed: int = 1337, frequency: float = 0.01, jitter: float = 1.0, distance: str = "squared") -> DataFrame:
    """``f1``, ``f2``: distances to the two nearest feature points, one per lattice cell; ``cell``: the nearest one's value in [-1, 1)."""
    columns, axes = points.columns, [f"_a{k}" for k in range(len(coordinates))]
    df = points.withColumns({a: F.col(c) * frequency for a, c in zip(axes, coordinates, strict=True)})
    df = nearest_points(df, seed, axes, distance, jitter)
    return df.select(*columns, F.col("_f1").alias("f1"), F.col("_f2").alias("f2"), (F.col("_own") / 2147483648.0).alias("cell"))
