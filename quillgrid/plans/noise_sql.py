"""DuckDB SQL of noise fields and warps, in relational form: places meet the lattice points around them, and each point's part is summed up."""

from __future__ import annotations

import math

from ..functions import noise
from ..functions.noise import Noise

G = (3 - math.sqrt(3)) / 6


def wrap(x: str) -> str:
    """The low 32 bits as a signed number."""
    return f"(xor(({x}) & 4294967295, 2147483648) - 2147483648)"


def _floor(c: str) -> str:
    return f"CAST(CASE WHEN {c} >= 0 THEN trunc({c}) ELSE trunc({c}) - 1 END AS BIGINT)"


def _round(c: str) -> str:
    return f"CAST(trunc({c} + CASE WHEN {c} >= 0 THEN 5e-1 ELSE -5e-1 END) AS BIGINT)"


def _hash(seed: str, dims: int) -> str:
    h = seed
    for k in range(dims):
        h = f"xor({h}, {wrap(f'i{k} * {noise.PRIMES[k]}')})"
    return wrap(f"{h} * {noise.HASH}")


def _offsets(dims: int, low: int, high: int) -> str:
    return " CROSS JOIN ".join(f"(SELECT unnest(range({low}, {high + 1})) AS f{k})" for k in range(dims))


def _gradient(dims: int, index: str) -> str:
    """The way to the point times the gradient that an index chooses."""
    if dims == 2:
        turn = f"radians(CASE WHEN {index} < 120 THEN 75e-1 + 15e0 * ({index} % 24) ELSE 225e-1 + 45e0 * ({index} - 120) END)"
        return f"(w0 * sin({turn}) + w1 * cos({turn}))"
    edge = f"(CASE WHEN {index} < 60 THEN {index} % 12 WHEN {index} = 60 THEN 8 WHEN {index} = 61 THEN 1 WHEN {index} = 62 THEN 9 ELSE 3 END)"
    return f"((1 - 2 * ({edge} & 1)) * CASE WHEN {edge} < 4 THEN w1 ELSE w0 END + (1 - ({edge} & 2)) * CASE WHEN {edge} >= 8 THEN w1 ELSE w2 END)"


def _direction(dims: int, index: str) -> list[str]:
    if dims == 2:
        turn = f"({index} * {2 * math.pi / 256!r}::DOUBLE)"
        return [f"cos({turn})", f"sin({turn})"]
    turn, z = f"({index} * {math.pi * (3 - math.sqrt(5))!r}::DOUBLE)", f"(1 - (2e0 * {index} + 1) / 256)"
    return [f"sqrt(1 - {z} * {z}) * cos({turn})", f"sqrt(1 - {z} * {z}) * sin({turn})", z]


_FADE = {"perlin": "({t} * {t} * {t} * ({t} * ({t} * 6 - 15) + 10))", "value": "({t} * {t} * (3 - 2 * {t}))", "grid": "({t} * {t} * (3 - 2 * {t}))"}


def _points(kind: str, dims: int, seed: int, src: str, p: str) -> list[str]:
    """CTEs up to ``{p}h`` (rid, h, w0.., a): the points around the places x0.. of ``src``, their hashes, the way from them, and their weight."""
    axes = range(dims)
    at = ", ".join(f"x{k}" for k in axes)
    if kind in ("simplex", "reduced") and dims == 3:
        cells = ", ".join(f"{_round(f'x{k}')} AS c{k}" for k in axes)
        ways = ", ".join(f"x{k} - c{k} AS d{k}, CASE WHEN x{k} - c{k} >= 0 THEN -1 ELSE 1 END AS u{k}" for k in axes)
        two = ", ".join(
            f"CASE l WHEN 0 THEN abs(d{k}) ELSE 5e-1 - abs(d{k}) END AS f{k}, CASE l WHEN 0 THEN d{k} ELSE u{k} * (5e-1 - abs(d{k})) END AS y{k}, "
            f"c{k} + CASE WHEN l = 1 AND u{k} < 0 THEN 1 ELSE 0 END AS e{k}, CASE l WHEN 0 THEN u{k} ELSE -u{k} END AS g{k}" for k in axes
        )
        step = lambda k: f"n * CASE WHEN m = {k} THEN g{k} ELSE 0 END"
        moved = ", ".join(f"e{k} - {step(k)} AS i{k}, y{k} + {step(k)} AS w{k}" for k in axes)
        square = " - ".join(f"w{k} * w{k}" for k in axes)
        return [
            f"{p}a AS (SELECT rid, {at}, {cells} FROM {src})", f"{p}b AS (SELECT *, {ways} FROM {p}a)", f"{p}c AS (SELECT rid, l, {two} FROM {p}b, (VALUES (0), (1)) t(l))",
            f"{p}d AS (SELECT *, CASE WHEN f0 >= f1 AND f0 >= f2 THEN 0 WHEN f1 > f0 AND f1 >= f2 THEN 1 ELSE 2 END AS m FROM {p}c)",
            f"{p}e AS (SELECT rid, l, {moved} FROM {p}d, (VALUES (0), (1)) t(n))",
            f"{p}h AS (SELECT rid, w0, w1, w2, {_hash(f'CASE l WHEN 0 THEN {seed} ELSE {~seed} END', 3)} AS h, pow(greatest(0e0, 6e-1 - {square}), 4) AS a FROM {p}e)",
        ]
    cells = ", ".join(f"{_floor(f'x{k}')} AS c{k}" for k in axes)
    if kind == "smooth" and dims == 3:
        ways = ", ".join(f"c{k} + f{k} AS i{k}, x{k} - c{k} - f{k} + 5e-1 * l AS w{k}" for k in axes)
        square = " - ".join(f"w{k} * w{k}" for k in axes)
        return [
            f"{p}a AS (SELECT rid, {at}, {cells} FROM {src})", f"{p}b AS (SELECT rid, l, {ways} FROM {p}a, {_offsets(3, -1, 2).replace(' CROSS JOIN ', ', ')}, (VALUES (0), (1)) t(l))",
            f"{p}h AS (SELECT rid, w0, w1, w2, {_hash(f'CASE l WHEN 0 THEN {seed} ELSE {noise._signed(seed + noise.SECOND_SEED)} END', 3)} AS h, pow(greatest(0e0, 75e-2 - {square}), 4) AS a FROM {p}b WHERE 75e-2 - {square} > 0)",
        ]
    low, high = {"perlin": (0, 1), "value": (0, 1), "grid": (0, 1), "cubic": (-1, 2), "simplex": (-1, 2), "reduced": (-1, 2), "smooth": (-1, 2)}[kind]
    ways = ", ".join(f"c{k} + f{k} AS i{k}, x{k} - c{k} AS d{k}, x{k} - c{k} - f{k} AS r{k}, f{k}" for k in axes)
    if kind in ("simplex", "reduced", "smooth"):
        reach = "5e-1" if kind != "smooth" else "(2e0 / 3)"
        way = f"r0 - (r0 + r1) * {G!r}::DOUBLE AS w0, r1 - (r0 + r1) * {G!r}::DOUBLE AS w1"
        weight = f"pow(greatest(0e0, {reach} - w0 * w0 - w1 * w1), 4)"
    else:
        way = ", ".join(f"r{k} AS w{k}" for k in axes)
        if kind == "cubic":
            part = lambda k: f"(CASE f{k} WHEN -1 THEN -d{k} * d{k} * d{k} + 2 * d{k} * d{k} - d{k} WHEN 0 THEN d{k} * d{k} * d{k} - 2 * d{k} * d{k} + 1 WHEN 1 THEN -d{k} * d{k} * d{k} + d{k} * d{k} + d{k} ELSE d{k} * d{k} * d{k} - d{k} * d{k} END)"
        else:
            part = lambda k: f"(CASE f{k} WHEN 0 THEN 1 - {_FADE[kind].format(t=f'd{k}')} ELSE {_FADE[kind].format(t=f'd{k}')} END)"
        weight = " * ".join(part(k) for k in axes)
    return [
        f"{p}a AS (SELECT rid, {at}, {cells} FROM {src})", f"{p}b AS (SELECT rid, {ways} FROM {p}a, {_offsets(dims, low, high).replace(' CROSS JOIN ', ', ')})",
        f"{p}c AS (SELECT *, {way} FROM {p}b)", f"{p}h AS (SELECT rid, {', '.join(f'w{k}' for k in axes)}, {_hash(str(seed), dims)} AS h, {weight} AS a FROM {p}c)",
    ]


def _single(n: Noise, dims: int, seed: int, src: str, p: str) -> list[str]:
    """CTEs up to ``{p}n`` (rid, n)."""
    if n.kind == "cellular":
        axes = range(dims)
        cells = ", ".join(f"x{k}, {_round(f'x{k}')} AS c{k}" for k in axes)
        low, off = (1, noise.JITTER_2D) if dims == 2 else (2, noise.JITTER_3D)
        way = ", ".join(f"i{k} - x{k} + ({v}) * {off * n.jitter!r}::DOUBLE AS w{k}" for k, v in enumerate(_direction(dims, f"((h >> {low}) & 255)")))
        squares, sizes = " + ".join(f"w{k} * w{k}" for k in axes), " + ".join(f"abs(w{k})" for k in axes)
        distance = {"euclidean": squares, "squared": squares, "manhattan": sizes, "hybrid": f"{sizes} + {squares}"}[n.distance]
        root = "sqrt" if n.distance == "euclidean" else ""
        a, b = f"{root}(f1)", f"{root}(f2)"
        made = {
            "value": "own / 2147483648e0", "first": f"{a} - 1", "second": f"{b} - 1", "sum": f"({b} + {a}) * 5e-1 - 1", "difference": f"{b} - {a} - 1", "product": f"{b} * {a} * 5e-1 - 1", "quotient": f"{a} / {b} - 1",
        }[n.returns]
        order = ", ".join(f"f{k}" for k in axes)
        return [
            f"{p}a AS (SELECT rid, {cells} FROM {src})", f"{p}b AS (SELECT *, {', '.join(f'c{k} + f{k} AS i{k}' for k in axes)} FROM {p}a, {_offsets(dims, -1, 1).replace(' CROSS JOIN ', ', ')})",
            f"{p}c AS (SELECT *, {_hash(str(seed), dims)} AS h FROM {p}b)", f"{p}d AS (SELECT *, {way} FROM {p}c)",
            f"{p}e AS (SELECT rid, h, {distance} AS d, row_number() OVER (PARTITION BY rid ORDER BY {distance}, {order}) AS place FROM {p}d)",
            f"{p}f AS (SELECT rid, max(d) FILTER (place = 1) AS f1, max(d) FILTER (place = 2) AS f2, max(h) FILTER (place = 1) AS own FROM {p}e GROUP BY rid)",
            f"{p}n AS (SELECT rid, f1, f2, {made} AS n FROM {p}f)",
        ]
    index = f"((xor(h, h >> 15) >> {1 if dims == 2 else 2}) & {127 if dims == 2 else 63})"
    if n.kind in ("value", "cubic"):
        square = wrap("h * h")
        value = f"{wrap(f'xor({square}, {wrap(f'{square} * 524288')})')} / 2147483648e0"
    else:
        value = _gradient(dims, index)
    scale = {
        ("perlin", 2): noise.PERLIN_2D, ("perlin", 3): noise.PERLIN_3D, ("cubic", 2): noise.CUBIC_2D, ("cubic", 3): noise.CUBIC_3D, ("simplex", 2): noise.SIMPLEX_2D, ("simplex", 3): noise.SIMPLEX_3D,
        ("smooth", 2): noise.SMOOTH_2D, ("smooth", 3): noise.SMOOTH_3D,
    }.get((n.kind, dims), 1.0)
    return [*_points(n.kind, dims, seed, src, p), f"{p}n AS (SELECT rid, sum(a * {value}) * {scale!r}::DOUBLE AS n FROM {p}h GROUP BY rid)"]


def _turned(dims: int, mode: str, simplex: bool) -> list[str]:
    """The coordinates skewed or rotated, from x0.. ."""
    same = [f"x{k}" for k in range(dims)]
    if dims == 2:
        return [f"x{k} + (x0 + x1) * {0.5 * (math.sqrt(3) - 1)!r}::DOUBLE" for k in range(2)] if simplex else same
    root = math.sqrt(3)
    if mode in ("xy", "xz"):
        # The same order of operations as in the columns: where two ways are equally long, the last bit decides between lattice points.
        a, b, c = (0, 1, 2) if mode == "xy" else (0, 2, 1)
        out = dict.fromkeys(range(3), "")
        out[a], out[b] = (f"x{k} + ((x{a} + x{b}) * {-G!r}::DOUBLE - x{c} / {root!r}::DOUBLE)" for k in (a, b))
        out[c] = f"x{c} / {root!r}::DOUBLE + (x{a} + x{b}) / {root!r}::DOUBLE"
        return [out[k] for k in range(3)]
    return [f"(x0 + x1 + x2) * {2 / 3!r}::DOUBLE - x{k}" for k in range(3)] if simplex else same


def field(n: Noise, base: str, coordinates: list[str], keep: str, out: str = "v", digits: int = 6, with_: str = "") -> str:
    """SQL for the noise at the coordinates of the rows of ``base`` (a FROM clause), beside the columns ``keep``."""
    dims = len(coordinates)
    axes = range(dims)
    turned = _turned(dims, n.rotation, n.kind in ("simplex", "smooth"))
    ctes = [
        f"base AS MATERIALIZED (SELECT row_number() OVER () AS rid, {keep}, " + ", ".join(f"({c}) * {n.frequency!r}::DOUBLE AS x{k}" for k, c in enumerate(coordinates)) + f" FROM {base})",
        "o0 AS (SELECT rid, " + ", ".join(f"{t} AS x{k}" for k, t in enumerate(turned)) + f", 0e0 AS s, {n.bounding!r}::DOUBLE AS amp FROM base)",
    ]
    octaves = 1 if n.fractal == "none" else n.octaves
    for k in range(octaves):
        ctes += _single(n, dims, n.seed + k, f"o{k}", f"q{k}")
        fold = f"(CASE WHEN p{k} < 1 THEN p{k} ELSE 2 - p{k} END)"
        add, share = {
            "none": ("n", "1e0"), "fbm": ("n", "least(n + 1, 2e0) * 5e-1" if dims == 2 else "(n + 1) * 5e-1"), "ridged": ("(abs(n) * -2 + 1)", "1 - abs(n)"), "pingpong": (f"({fold} - 5e-1) * 2", fold),
        }[n.fractal]
        raw = f"(n + 1) * {n.pingpong!r}::DOUBLE"
        ctes.append(f"r{k} AS (SELECT o{k}.*, n, {raw} - 2 * trunc({raw} * 5e-1) AS p{k} FROM o{k} JOIN q{k}n USING (rid))")
        amp = "amp" if n.fractal != "none" else "1e0"
        grown = ", ".join(f"x{j} * {n.lacunarity!r} AS x{j}" for j in axes)
        ctes.append(f"o{k + 1} AS (SELECT rid, {grown}, s + {add} * {amp} AS s, amp * (1e0 + {n.weighted!r}::DOUBLE * ({share} - 1e0)) * {n.gain!r}::DOUBLE AS amp FROM r{k})")
    return f"WITH {with_}{', '.join(ctes)} SELECT {keep}, round(s, {digits}) + 0e0 AS {out} FROM base JOIN o{octaves} USING (rid)"


def nearest(n: Noise, base: str, coordinates: list[str], keep: str) -> str:
    """SQL for the two least distances of cellular noise."""
    ctes = [f"base AS MATERIALIZED (SELECT row_number() OVER () AS rid, {keep}, " + ", ".join(f"({c}) * {n.frequency!r}::DOUBLE AS x{k}" for k, c in enumerate(coordinates)) + f" FROM {base})"]
    ctes += _single(n, len(coordinates), n.seed, "base", "q")
    return f"WITH {', '.join(ctes)} SELECT {keep}, round(f1, 6) AS f1, round(f2, 6) AS f2 FROM base JOIN qn USING (rid)"


def warped(n: Noise, base: str, coordinates: list[str], keep: str, names: list[str], amplitude: float, kind: str, mode: str) -> str:
    """SQL for warped coordinates."""
    dims = len(coordinates)
    axes = range(dims)
    ctes = [f"base AS MATERIALIZED (SELECT row_number() OVER () AS rid, {keep}, " + ", ".join(f"CAST({c} AS DOUBLE) AS b{k}" for k, c in enumerate(coordinates)) + f" FROM {base})"]
    ctes.append("m0 AS (SELECT rid, " + ", ".join(f"b{k}, b{k} AS y{k}" for k in axes) + " FROM base)")
    amp, freq, scale = amplitude * n.bounding, n.frequency, (noise.WARP_2D if dims == 2 else noise.WARP_3D)[kind]
    low = 1 if dims == 2 else 2
    octaves = 1 if mode == "single" else n.octaves
    for k in range(octaves):
        origin = "y" if mode == "progressive" else "b"
        ctes.append(f"u{k} AS (SELECT rid, " + ", ".join(f"{origin}{j} AS x{j}" for j in axes) + f" FROM m{k})")
        ctes.append(f"t{k} AS (SELECT rid, " + ", ".join(f"({t}) * {freq!r}::DOUBLE AS x{j}" for j, t in enumerate(_turned(dims, n.rotation, kind != "grid"))) + f" FROM u{k})")
        ctes += _points(kind, dims, n.seed + k, f"t{k}", f"q{k}")
        if kind == "simplex":
            weight, index = f"a * {_gradient(dims, f'((h >> {low}) & {127 if dims == 2 else 63})')}", "((h >> 8) & 255)"
        else:
            weight, index = "a", f"((h >> {low}) & 255)"
        pulls = ", ".join(f"sum({weight} * {v}) AS p{j}" for j, v in enumerate(_direction(dims, index)))
        ctes.append(f"s{k} AS (SELECT rid, {pulls} FROM q{k}h GROUP BY rid)")
        ctes.append(f"m{k + 1} AS (SELECT rid, " + ", ".join(f"b{j}, y{j} + p{j} * {amp * scale!r}::DOUBLE AS y{j}" for j in axes) + f" FROM m{k} JOIN s{k} USING (rid))")
        amp, freq = amp * n.gain, freq * n.lacunarity
    shown = ", ".join(f"round(y{k}, 4) + 0e0 AS {name}" for k, name in enumerate(names))
    return f"WITH {', '.join(ctes)} SELECT {keep}, {shown} FROM base JOIN m{octaves} USING (rid)"
