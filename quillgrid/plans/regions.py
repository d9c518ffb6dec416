"""Region plans that join several operators, and the SQL of the longer raster queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import colormaps, noise, rng, text
from ..operators import classify, raster, stats
from ..sources import sinks
from . import noise_sql
from .grids import SOBEL, _linear, _resized
from .tables import CHANNELS, DENSE, GRID, channel_grid, dense_grid, table
from .values import CLASSIFY_CTE, climate_cells


def _blurred(taps: list[float], source: str, p: str, h: str = "(SELECT h FROM size)", w: int = 31) -> str:
    """CTEs up to ``{p}i``: a separable blur with clamped edges."""
    half = len(taps) // 2
    values = ", ".join(f"({n - half}, {t!r}::DOUBLE)" for n, t in enumerate(taps))
    return (
        f"{p}k AS (SELECT * FROM (VALUES {values}) AS t(o, c)), "
        f"{p}j AS (SELECT a.i, a.j, sum(b.v * c) AS v FROM {source} a CROSS JOIN {p}k JOIN {source} b ON b.i = a.i AND b.j = greatest(0, least({w - 1}, a.j + o)) GROUP BY a.i, a.j), "
        f"{p}i AS (SELECT a.i, a.j, sum(b.v * c) AS v FROM {p}j a CROSS JOIN {p}k JOIN {p}j b ON b.j = a.j AND b.i = greatest(0, least({h} - 1, a.i + o)) GROUP BY a.i, a.j)"
    )


def _shaded(source: str, p: str) -> str:
    """CTEs up to ``{p}s``: hillshade at the resolution of ninety."""
    return (
        f"{p}g AS (SELECT a.i, a.j, (coalesce(s.v, a.v) - coalesce(n.v, a.v)) / (CASE WHEN s.v IS NULL OR n.v IS NULL THEN 1e0 ELSE 2e0 END) / 15e0 AS dy, "
        f"(coalesce(e.v, a.v) - coalesce(w.v, a.v)) / (CASE WHEN e.v IS NULL OR w.v IS NULL THEN 1e0 ELSE 2e0 END) / 15e0 AS dx FROM {source} a "
        f"LEFT JOIN {source} n ON n.i = a.i - 1 AND n.j = a.j LEFT JOIN {source} s ON s.i = a.i + 1 AND s.j = a.j LEFT JOIN {source} w ON w.i = a.i AND w.j = a.j - 1 LEFT JOIN {source} e ON e.i = a.i AND e.j = a.j + 1), "
        f"{p}s AS (SELECT i, j, greatest(0e0, least(1e0, sin(radians(45e0)) * sin(pi() / 2 - atan(sqrt(dx * dx + dy * dy))) "
        f"+ cos(radians(45e0)) * cos(pi() / 2 - atan(sqrt(dx * dx + dy * dy))) * cos(radians(315e0) - atan2(dy, -dx)))) AS shade FROM {p}g)"
    )


def _colours(anchors, name: str) -> str:
    rows = ", ".join(f"({k}, {r!r}::DOUBLE, {g!r}::DOUBLE, {b!r}::DOUBLE)" for k, (r, g, b) in enumerate(colormaps.table(anchors)))
    return f"{name} AS (SELECT * FROM (VALUES {rows}) AS x(k, r, g, b))"


def _relief_sql() -> str:
    sea = {"r": (0.68, 0.0), "g": (0.88, 0.1), "b": (1.0, 0.45)}
    shown = ", ".join(
        f"round(CASE WHEN v < 0 THEN (1 - t) * {a!r}::DOUBLE + t * {z!r}::DOUBLE ELSE greatest(0e0, least(1e0, {c} * (0.35e0 + 0.65e0 * hs))) END, 4) AS {c}" for c, (a, z) in sea.items()
    )
    return (
        f"WITH {DENSE}, flat AS (SELECT i, j, v - 50 AS v FROM dense), {_blurred(raster.kernel_wide(6.0), 'flat', 'a')}, {_blurred(raster.kernel_wide(1.2), 'flat', 'b')}, "
        f"{_shaded('ai', 'c')}, {_shaded('bi', 'd')}, {_colours(colormaps.TERRAIN, 'lut')}, top AS (SELECT greatest(max(v), 0e0) AS m FROM flat), "
        "x AS (SELECT f.i, f.j, f.v, pow(greatest(0e0, least(1e0, 0.75e0 * cs.shade + 0.25e0 * ds.shade)), 0.85e0) AS hs, pow(least(1e0, greatest(0e0, -f.v / 10000e0)), 0.7e0) AS t, "
        "0.25e0 + pow(greatest(0e0, least(1e0, greatest(f.v, 0e0) / (m + 1e-8))), 0.7e0) * 0.75e0 AS p FROM flat f JOIN cs USING (i, j) JOIN ds USING (i, j), top) "
        f"SELECT i, j, {shown} FROM x JOIN lut ON k = greatest(0, least(255, CAST(floor(p * 255 + 5e-1) AS INT)))"
    )


RELIEF = _relief_sql()

_DETAIL = noise.Noise(seed=3, frequency=0.05, fractal="fbm", octaves=2)
_SLOPES = SOBEL.replace("SELECT i, j, round(sqrt(dx * dx + dy * dy) / 30e0, 6) AS v FROM g", "SELECT i, j, sqrt(dx * dx + dy * dy) AS grad FROM g")
DETAIL = (
    f"SELECT i, j, round(CASE WHEN v < 0 THEN v ELSE v + n * 100e0 * pow(least(1e0, grad / 40e0), 2.5e0) END, 6) AS v "
    f"FROM (WITH {DENSE} SELECT * FROM dense) d JOIN ({_SLOPES}) s USING (i, j) JOIN ({noise_sql.field(_DETAIL, 'dense', ['j', 'i'], 'i, j', 'n', 12, DENSE + ', ')}) m USING (i, j)"
)


def _classes(rows: str, keys: str) -> str:
    """The classifier's CTEs up to ``cls`` over a CTE ``r`` (keys, elev, t, sd, p, cv, sl, ns)."""
    rules = CLASSIFY_CTE[CLASSIFY_CTE.index("a AS (SELECT *") :].replace("l_orderkey, l_linenumber", keys)
    return f"r AS ({rows}), {rules}"


def _enlarged(value: str) -> str:
    """CTEs up to ``big``: the dense grid's values at twice its size, rounded so that whole numbers stay whole."""
    lines = f"{_linear('(SELECT h FROM size)', '(SELECT 2 * h FROM size)', 'ri')}, {_linear('31', '62', 'rj')}"
    return f"{DENSE}, src AS (SELECT i, j, {value} AS v FROM dense), {lines}, big AS MATERIALIZED (SELECT i, j, round(v + 1e-9, 6) AS v FROM ({_resized('src')}))"


_BIG_SLOPE = (
    "kk AS (SELECT * FROM (VALUES " + ", ".join(f"({a}, {b}, {b * [1, 2, 1][a + 1]}, {a * [1, 2, 1][b + 1]})" for a in (-1, 0, 1) for b in (-1, 0, 1)) + ") AS t(a, b, kx, ky)), "
    "gg AS MATERIALIZED (SELECT x.i, x.j, sum(y.v * kx) / 8e0 AS dx, sum(y.v * ky) / 8e0 AS dy FROM big x CROSS JOIN kk "
    "JOIN big y ON y.i = greatest(0, least((SELECT 2 * h - 1 FROM size), x.i + a)) AND y.j = greatest(0, least(61, x.j + b)) GROUP BY x.i, x.j)"
)
_HEIGHT = "CAST(greatest(-32768, least(32767, floor({v}))) AS INT)"
_BLOCK = "CAST(CASE WHEN floor({v}) >= 0 THEN trunc(floor({v}) / 15e0) + 63 ELSE trunc(-sqrt(abs(floor({v})) + 10e0) + sqrt(10e0)) + 62 END AS INT)"
HEIGHTMAP = (
    f"WITH {_enlarged('v * 8 - 300')}, {_BIG_SLOPE}, "
    + _classes("SELECT i, j, v AS elev, 25e0 - v / 160 AS t, 6e0 AS sd, greatest(0e0, j * 25e0) AS p, 40e0 AS cv, sqrt(dx * dx + dy * dy) / 60e0 AS sl, 0e0 AS ns FROM big JOIN gg USING (i, j)", "i, j, elev")
    + f" SELECT i, j, {_HEIGHT.format(v='elev')} AS height_m, class_id, {_BLOCK.format(v='elev')} AS y FROM cls"
)


def _extrapolated(source: str, ratio: int, p: str, h: str = "(SELECT h FROM size)", w: int = 31) -> str:
    """CTEs up to ``{p}u``: a grid enlarged after its border was continued linearly."""
    lines = f"{_linear(f'({h} + 2)', f'({ratio} * {h} + {2 * ratio})', f'{p}y')}, {_linear(str(w + 2), str(ratio * w + 2 * ratio), f'{p}x')}"
    return (
        f"{p}a AS (SELECT * FROM {source} UNION ALL SELECT -1, a.j, 2 * a.v - b.v FROM {source} a JOIN {source} b ON a.i = 0 AND b.i = 1 AND a.j = b.j "
        f"UNION ALL SELECT {h}, a.j, 2 * a.v - b.v FROM {source} a JOIN {source} b ON a.j = b.j WHERE a.i = {h} - 1 AND b.i = {h} - 2), "
        f"{p}b AS (SELECT * FROM {p}a UNION ALL SELECT a.i, -1, 2 * a.v - b.v FROM {p}a a JOIN {p}a b ON a.j = 0 AND b.j = 1 AND a.i = b.i "
        f"UNION ALL SELECT a.i, {w}, 2 * a.v - b.v FROM {p}a a JOIN {p}a b ON a.j = {w - 1} AND b.j = {w - 2} AND a.i = b.i), "
        f"{p}c AS (SELECT i + 1 AS i, j + 1 AS j, v FROM {p}b), {lines}, "
        f"{p}u AS (SELECT i - {ratio} AS i, j - {ratio} AS j, v FROM ({_resized(f'{p}c', f'{p}y', f'{p}x')}) WHERE i BETWEEN {ratio} AND {ratio} * {h} + {ratio - 1} AND j BETWEEN {ratio} AND {ratio * w + ratio - 1})"
    )


_H4 = "(SELECT 4 * h FROM size)"
ELEVATION = (
    f"WITH {DENSE}, low AS (SELECT i, j, CAST(sign(v - 40) AS DOUBLE) * sqrt(abs(v - 40)) AS v FROM dense), {_extrapolated('low', 4, 'e')}, "
    "res AS (SELECT u.i, u.j, d.v / 100 AS v FROM eu u JOIN dense d ON d.i = u.i // 4 AND d.j = u.j // 4), "
    "whole AS (SELECT u.i, u.j, u.v + r.v AS v FROM eu u JOIN res r USING (i, j)), "
    f"{_linear(_H4, '(SELECT h FROM size)', 'dy')}, {_linear('124', '31', 'dx')}, down AS ({_resized('whole', 'dy', 'dx')}), {_blurred(raster.kernel_truncated(5.0), 'down', 'b')}, "
    f"{_linear('(SELECT h FROM size)', _H4, 'uy')}, {_linear('31', '124', 'ux')}, up AS ({_resized('bi', 'uy', 'ux')}), "
    "full_ AS (SELECT u.i - 8 AS i, u.j - 8 AS j, u.v + r.v AS v FROM up u JOIN res r USING (i, j)) "
    "SELECT i, j, round(CAST(sign(v) AS DOUBLE) * v * v, 5) + 0e0 AS v FROM full_, size WHERE i BETWEEN 0 AND 4 * h - 17 AND j BETWEEN 0 AND 107"
)

CLIMATE = f"""WITH {DENSE}, k AS (SELECT CAST(extract('doy' FROM l_shipdate) AS BIGINT) % 60 AS i, CAST(l_quantity AS BIGINT) - 1 AS j,
  round(avg(l_extendedprice) / 1000, 6) AS t, round((avg(l_discount) - 0.045e0) * 5000, 6) AS e FROM lineitem GROUP BY 1, 2),
g AS (SELECT a.i, b.j, coalesce(t, 0e0) AS t, coalesce(e, 0e0) AS e FROM (SELECT unnest(range(0, 60)) AS i) a CROSS JOIN (SELECT unnest(range(0, 50)) AS j) b LEFT JOIN k ON k.i = a.i AND k.j = b.j),
m AS (SELECT x.i, x.j, coalesce(sum(y.t) FILTER (y.e > 0), 0e0) AS st, coalesce(sum(y.e) FILTER (y.e > 0), 0e0) AS se, coalesce(sum(y.e * y.e) FILTER (y.e > 0), 0e0) AS see,
  coalesce(sum(y.e * y.t) FILTER (y.e > 0), 0e0) AS se_t, count(*) FILTER (y.e > 0) AS w, max(CASE WHEN y.i = x.i + 7 AND y.j = x.j + 7 THEN y.t END) AS tc, max(CASE WHEN y.i = x.i + 7 AND y.j = x.j + 7 THEN y.e END) AS ec
  FROM g x JOIN g y ON y.i BETWEEN x.i AND x.i + 14 AND y.j BETWEEN x.j AND x.j + 14 WHERE x.i <= 45 AND x.j <= 35 GROUP BY x.i, x.j),
n AS (SELECT *, see / (w + 1e-6) - (se / (w + 1e-6)) * (se / (w + 1e-6)) AS var, se_t / (w + 1e-6) - (se / (w + 1e-6)) * (st / (w + 1e-6)) AS cov FROM m),
b AS (SELECT i, j, tc, ec, greatest(-0.012e0, least(0e0, CASE WHEN var < 1 OR w < 0.02e0 * 225 THEN -0.0065e0 ELSE cov / (var + 1e-6) END)) AS beta FROM n),
s AS (SELECT i, j, beta, tc - beta * ec AS sea FROM b),
p AS (SELECT i, j, v * 9 - 200 AS elev, greatest(0e0, least(45e0, (i + 5e-1) / 2 - 5e-1)) AS y, greatest(0e0, least(35e0, (j + 5e-1) / 2 - 5e-1)) AS x FROM dense),
c AS (SELECT *, CAST(floor(y) AS BIGINT) AS y0, CAST(floor(x) AS BIGINT) AS x0, y - floor(y) AS fy, x - floor(x) AS fx FROM p),
q AS (SELECT c.i, c.j, any_value(elev) AS elev, sum(s.beta * CASE WHEN a = 1 THEN fy ELSE 1 - fy END * CASE WHEN d = 1 THEN fx ELSE 1 - fx END) AS beta,
  sum(s.sea * CASE WHEN a = 1 THEN fy ELSE 1 - fy END * CASE WHEN d = 1 THEN fx ELSE 1 - fx END) AS sea
  FROM c CROSS JOIN (VALUES (0), (1)) u(a) CROSS JOIN (VALUES (0), (1)) v(d) JOIN s ON s.i = least(45, y0 + a) AND s.j = least(35, x0 + d) GROUP BY c.i, c.j)
SELECT i, j, round(sea + beta * greatest(elev, 0e0) + 1e-9, 5) AS temp, round(beta, 7) AS beta FROM q"""

_STEPS = 3000
PATCH = f"""WITH RECURSIVE {GRID}, c AS (SELECT i - 20 AS i, j - 5 AS j, CAST(floor((i - 20) / 32e0) AS BIGINT) AS ty, CAST(floor((j - 5) / 32e0) AS BIGINT) AS tx FROM grid),
t AS (SELECT DISTINCT ty, tx, ((42 * {rng.GOLDEN} + (ty & 4294967295))::HUGEINT * {rng.GOLDEN} + (tx & 4294967295)) % 18446744073709551616 AS s FROM c),
st AS (SELECT ty, tx, 0 AS k, s FROM t UNION ALL SELECT ty, tx, k + 1, (s * {rng.STEP}::HUGEINT + {rng.ADD}) % 18446744073709551616 FROM st WHERE k < {_STEPS}),
u AS (SELECT ty, tx, k - 1 AS k, CAST(s AS UBIGINT) AS s FROM st WHERE k > 0),
o AS (SELECT ty, tx, k, (xor(s >> 18, s) >> 27) & 4294967295 AS x, s >> 59 AS r FROM u),
w AS (SELECT ty, tx, k, ((x >> r) | ((x << ((32 - r) & 31)) & 4294967295)) & 4294967295 AS u FROM o),
v AS (SELECT ty, tx, k // 2 AS p, max(2e0 * (u + 1e0) / 4294967296e0 - 1e0) FILTER (k % 2 = 0) AS a, max(2e0 * (u + 1e0) / 4294967296e0 - 1e0) FILTER (k % 2 = 1) AS b FROM w GROUP BY ALL),
n AS (SELECT ty, tx, a, b, sqrt(-2e0 * ln(a * a + b * b) / (a * a + b * b)) AS f, row_number() OVER (PARTITION BY ty, tx ORDER BY p) - 1 AS q FROM v WHERE a * a + b * b > 0 AND a * a + b * b < 1),
z AS (SELECT ty, tx, 2 * q AS k, a * f AS v FROM n UNION ALL SELECT ty, tx, 2 * q + 1, b * f FROM n)
SELECT c.i, c.j, CAST(ch AS INT) AS ch, round(CAST(z.v AS FLOAT)::DOUBLE, 5) + 0e0 AS v FROM c CROSS JOIN (VALUES (0), (1)) h(ch)
JOIN z ON z.ty = c.ty AND z.tx = c.tx AND z.k = ch * 1024 + (c.i - c.ty * 32) * 32 + c.j - c.tx * 32"""


def classify_noisy(spark, d):
    """Classes of line items whose climate is moved by noise inputs."""
    out = classify.classify(climate_cells(spark, d, (F.col("l_partkey") % 7 - 3) * 0.5, (F.col("l_suppkey") % 9 - 4) * 0.05))
    return out.select("l_orderkey", "l_linenumber", F.col("class_id").cast("int").alias("class_id"))


CLASSIFY_NOISY = "WITH " + CLASSIFY_CTE.replace("l_quantity * 0.9e0 - 13.5e0 END AS t", "l_quantity * 0.9e0 - 13.5e0 + (l_partkey % 7 - 3) * 0.5e0 END AS t").replace(
    "greatest(0e0, l_extendedprice / 25) AS p", "greatest(0e0, l_extendedprice / 25) * (1e0 + (l_suppkey % 9 - 4) * 0.05e0) AS p"
) + " SELECT l_orderkey, l_linenumber, class_id FROM cls"


def coarse_picture(spark, d):
    """One channel as a picture: scaled to its extremes, coloured, and dimmed where any bounded channel is out of its range."""
    wide = stats.channel_pivot(channel_grid(spark, d), ["click", "purchase", "view"])
    masked = stats.range_mask(wide, {"click": (20.0, 300.0), "view": (10.0, None)})
    shown = stats.minmax(masked.withColumn("v", F.coalesce("purchase", F.lit(0.0))))
    rgb = [stats.dim(c, F.col("inside")) for c in colormaps.viridis(F.col("t"))]
    return shown.select("i", "j", "inside", *[F.floor(c * 255 + 0.5).cast("int").alias(n) for c, n in zip(rgb, "rgb", strict=True)])


PICTURE = (
    f"WITH {CHANNELS}, {_colours(colormaps.VIRIDIS, 'lut')}, w AS (SELECT i, j, max(v) FILTER (ch = 'click') AS c, coalesce(max(v) FILTER (ch = 'purchase'), 0e0) AS v, max(v) FILTER (ch = 'view') AS s FROM cg GROUP BY i, j), "
    "x AS (SELECT min(v) AS lo, max(v) AS hi FROM w), "
    "y AS (SELECT i, j, coalesce(c >= 20 AND c <= 300 AND s >= 10, false) AS inside, greatest(0e0, least(1e0, (v - lo) / CASE WHEN hi = lo THEN 1e0 ELSE hi - lo END)) AS t FROM w, x) "
    "SELECT i, j, inside, " + ", ".join(f"CAST(floor(CASE WHEN inside THEN {c} ELSE {c} * 3e-1 END * 255 + 5e-1) AS INT) AS {c}" for c in "rgb")
    + " FROM y JOIN lut ON k = greatest(0, least(255, CAST(floor(t * 255 + 5e-1) AS INT)))"
)


def scale_plan(spark, d):
    """A region at scale two: heights and four climate channels enlarged, classes by the heights without detail, and noise on the slopes of what is shown."""
    g, (h, w) = dense_grid(spark, d)
    to = (2 * h, 2 * w)
    big = raster.resize_bilinear(g.withColumn("v", F.col("v") * 8 - 300), (h, w), to).withColumn("v", F.round(F.col("v") + 1e-9, 6))
    channels = {"temp": F.col("v") / 16 - 6, "t_season": F.col("v") * 3 + 200, "precip": F.col("v") * 9, "p_cv": F.col("v") / 5 + 10}
    # One pass enlarges all channels: they are columns of one array.
    coarse = g.select("i", "j", F.posexplode(F.array(*channels.values())).alias("ch", "v"))
    up = [raster.resize_bilinear(coarse.where(F.col("ch") == k).drop("ch"), (h, w), to).withColumnRenamed("v", n) for k, n in enumerate(channels)]
    cells = big.withColumnRenamed("v", "elev").join(raster.sobel(big).withColumnRenamed("v", "grad"), ["i", "j"])
    for u in up:
        cells = cells.join(u, ["i", "j"])
    cells = cells.withColumns({"slope": F.col("grad") / 60.0, **{n: F.lit(0.0) for n in ("n_temp", "n_precip", "n_snow")}})
    cells = classify.classify(cells.withColumns({n: F.round(F.col(n) + 1e-9, 6) for n in channels}))
    noisy = noise.add_noise(cells, ["j", "i"], _DETAIL, "n")
    shown = F.when(F.col("elev") < 0, F.col("elev")).otherwise(F.col("elev") + F.col("n") * 100.0 * F.pow(F.least(F.lit(1.0), F.col("grad") / 40.0), F.lit(2.5)))
    return noisy.select("i", "j", F.round(shown, 6).alias("elev"), F.col("class_id").cast("int").alias("class_id"), "temp", "precip")


def _scale_sql() -> str:
    lines = f"{_linear('(SELECT h FROM size)', '(SELECT 2 * h FROM size)', 'ri')}, {_linear('31', '62', 'rj')}"
    parts = {"big": "v * 8 - 300", "u0": "v / 16 - 6", "u1": "v * 3 + 200", "u2": "v * 9", "u3": "v / 5 + 10"}
    sources = ", ".join(f"s{n} AS (SELECT i, j, {e} AS v FROM dense), {n} AS (SELECT i, j, round(v + 1e-9, 6) AS v FROM ({_resized(f's{n}')}))" for n, e in parts.items())
    grid = f"{DENSE}, {lines}, {sources}"
    rows = (
        "SELECT b.i, b.j, b.v AS elev, u0.v AS t, u1.v / 100e0 AS sd, greatest(0e0, u2.v) AS p, u3.v AS cv, sqrt(dx * dx + dy * dy) / 60e0 AS sl, 0e0 AS ns, sqrt(dx * dx + dy * dy) AS grad, u2.v AS rain "
        "FROM big b JOIN gg USING (i, j) JOIN u0 USING (i, j) JOIN u1 USING (i, j) JOIN u2 USING (i, j) JOIN u3 USING (i, j)"
    )
    classes = f"WITH {grid}, {_BIG_SLOPE}, {_classes(rows, 'i, j, elev, grad, t, rain')} SELECT * FROM cls"
    field = noise_sql.field(_DETAIL, "big", ["j", "i"], "i, j", "n", 12, f"{grid}, ")
    return (
        "SELECT i, j, round(CASE WHEN elev < 0 THEN elev ELSE elev + n * 100e0 * pow(least(1e0, grad / 40e0), 2.5e0) END, 6) AS elev, class_id, t AS temp, rain AS precip "
        f"FROM ({classes}) c JOIN ({field}) f USING (i, j)"
    )


def raw_tile_rows(spark, d):
    """The height rows of raw tiles, byte by byte."""
    g, _ = dense_grid(spark, d)
    tiles = sinks.raw_tiles(g.select("i", "j", (F.col("v") - 60).alias("elev"), (F.col("v") / 7).alias("temp")), 32)
    rows = tiles.withColumn("r", F.explode(F.sequence(F.lit(0), F.lit(31))))
    return rows.select("ty", "tx", "r", F.hex(F.substring("data", 1, 2 * 32 * 32)).alias("all")).select("ty", "tx", "r", F.expr("substring(all, 1 + r * 128, 128)").alias("bytes"))


RAW_ROWS = f"""WITH {DENSE}, t AS (SELECT DISTINCT CAST(floor(i / 32e0) AS BIGINT) AS ty, CAST(floor(j / 32e0) AS BIGINT) AS tx FROM dense),
c AS (SELECT ty, tx, r, k, CAST(coalesce(floor(v - 60), 0) AS BIGINT) AS e FROM t CROSS JOIN (SELECT unnest(range(0, 32)) AS r) CROSS JOIN (SELECT unnest(range(0, 32)) AS k) LEFT JOIN dense ON i = ty * 32 + r AND j = tx * 32 + k)
SELECT ty, tx, CAST(r AS INT) AS r, string_agg(printf('%02X%02X', e & 255, (e >> 8) & 255), '' ORDER BY k) AS bytes FROM c GROUP BY ty, tx, r"""

def detail_pictures(spark, d):
    """The whole grid in the modes that scale a channel to its extremes: heights, and temperatures that fall with them."""
    g, _ = dense_grid(spark, d)
    cells = g.select("i", "j", (F.col("v") * 8 - 300).alias("elev"), (25.0 - F.col("v") / 4 + F.col("j")).alias("temp"))
    shown = [raster.detail(cells, mode).withColumn("mode", F.lit(mode)) for mode in ("elevation", "temperature")]
    return shown[0].unionByName(shown[1]).select("mode", "i", "j", *[F.floor(F.col(c) * 255 + 0.5).cast("int").alias(c) for c in "rgb"])


DETAIL_PICTURES = (
    f"WITH {DENSE}, {_colours(colormaps.TERRAIN, 'land')}, {_colours(colormaps.RDBU_R, 'heat')}, lut AS (SELECT 'elevation' AS mode, * FROM land UNION ALL SELECT 'temperature', * FROM heat), "
    "m AS (SELECT 'elevation' AS mode, i, j, v * 8 - 300 AS v FROM dense UNION ALL SELECT 'temperature', i, j, 25e0 - v / 4 + j FROM dense), "
    "x AS (SELECT mode, min(v) AS lo, max(v) AS hi FROM m GROUP BY mode), y AS (SELECT mode, i, j, (v - lo) / CASE WHEN hi = lo THEN 1e0 ELSE hi - lo END AS t FROM m JOIN x USING (mode)) "
    "SELECT mode, i, j, " + ", ".join(f"CAST(floor({c} * 255 + 5e-1) AS INT) AS {c}" for c in "rgb")
    + " FROM (SELECT mode, i, j, greatest(0, least(255, CAST(floor(t * 255 + 5e-1) AS INT))) AS k FROM y) JOIN lut USING (mode, k)"
)

#: Names of the coarse channels and metres a cell, as a status shows them (fixed values).
CHANNEL_NAMES, NATIVE_RESOLUTION = ["Elev", "p5", "Temp", "T std", "Precip", "Precip CV"], 30.0


def world_status(spark, d):
    """A world for each supplier whose seed came in a request: the status of each, the seed as it was read and without sign."""
    key = F.col("s_suppkey").cast("long")
    asked = F.when(key % 3 == 0, key).when(key % 3 == 1, key * 1_000_003 * 700_001 * 31).otherwise(-key * 1_000_003 * 900_001)
    body = F.concat(F.when(key % 11 == 0, '{"sead": ').otherwise('{"seed": '), asked.cast("string"), F.lit("}"))
    seen = table(spark, d, "supplier").select(key.alias("world"), text.seed_of(body).alias("seed")).where("seed IS NOT NULL")
    status = F.struct(text.unsigned(F.col("seed")).alias("seed"), F.array(*[F.lit(c) for c in CHANNEL_NAMES]).alias("channels"), F.lit(NATIVE_RESOLUTION).alias("native_resolution"), (F.col("world") % 6 + 1).alias("scale"))
    return seen.select("world", "seed", F.to_json(status).alias("status"))


WORLD_STATUS = (
    "WITH a AS (SELECT CAST(s_suppkey AS BIGINT) AS world, CASE s_suppkey % 3 WHEN 0 THEN CAST(s_suppkey AS HUGEINT) WHEN 1 THEN s_suppkey * 1000003::HUGEINT * 700001 * 31 ELSE -s_suppkey * 1000003::HUGEINT * 900001 END AS n FROM supplier WHERE s_suppkey % 11 <> 0), "
    "s AS (SELECT world, CAST(CAST(n AS DOUBLE) AS BIGINT) AS seed FROM a) SELECT world, seed, '{\"seed\":\"' || CASE WHEN seed < 0 THEN seed + 18446744073709551616 ELSE seed END || '\",\"channels\":["
    + ",".join(f'\"{c}\"' for c in CHANNEL_NAMES).replace('\\"', '"') + f"],\"native_resolution\":{NATIVE_RESOLUTION},\"scale\":' || (world % 6 + 1) || '}}' AS status FROM s"
)

QUERIES = {
    "detail_pictures": (detail_pictures, DETAIL_PICTURES), "world_status": (world_status, WORLD_STATUS),
    "classify_noisy": (classify_noisy, CLASSIFY_NOISY), "coarse_picture": (coarse_picture, PICTURE), "scale_plan": (scale_plan, _scale_sql()), "raw_tile_rows": (raw_tile_rows, RAW_ROWS),
}
#: SQL of queries that other modules register.
SQL = {"relief_picture": RELIEF, "elevation_detail": DETAIL, "heightmap": HEIGHTMAP, "elevation_assembly": ELEVATION, "climate_assembly": CLIMATE, "gaussian_patch": PATCH}
