"""SQL of the model graphs: the same stages cell by cell, with windows only where a window's own vector enters."""

from __future__ import annotations

import math
import re

from ..functions import rng
from ..operators import raster
from .assembly import LATENT_TIMES, SEEDS
from .grids import _linear, _resized
from .regions import _BIG_SLOPE, _HEIGHT, _blurred, _classes, _extrapolated
from .tables import CHANNELS, DENSE
from .worlds import COND_MEANS, COND_STDS, FIRST, LATENT_SEED, LOW_MEAN, LOW_STD, PARTS, RESIDUAL, SECOND, SNR, STEP_SEED

_MODULUS = 1 << 64
#: The solver's steps (k, now, next, last, n): noise levels and the norm at each.
SOLVER = """ramp AS (SELECT pow(80e0, 1 / 7e0) AS hi, pow(0.002e0, 1 / 7e0) AS lo), lv AS (SELECT k, CASE WHEN k < 20 THEN pow(hi + k / 19e0 * (lo - hi), 7) ELSE 0e0 END AS s FROM ramp, (SELECT unnest(range(0, 21)) AS k)),
sv AS MATERIALIZED (SELECT a.k, a.s AS now, b.s AS next, z.s AS last, sqrt(a.s * a.s + 25e-2) AS n, cos(atan(a.s / 5e-1)) AS lab FROM lv a JOIN lv b ON b.k = a.k + 1 LEFT JOIN lv z ON z.k = a.k - 1)"""


def _d(x: float) -> str:
    return f"{float(x)!r}::DOUBLE"


def _tiles(layers: list[tuple[int, int, str, str, int]]) -> str:
    """Tiles (tag, ty, tx, n, s) of noise: for each layer its seed, normals a tile, last row and last column of tiles, and the first of both."""
    parts = [
        f"SELECT {tag} AS tag, ty, tx, {n} AS n, {seed} AS seed FROM (SELECT unnest(range({low}, {rows} + 1)) AS ty), (SELECT unnest(range({low}, {cols} + 1)) AS tx)"
        for tag, (seed, n, rows, cols, low) in enumerate(layers)
    ]
    return (
        f"tl AS MATERIALIZED (SELECT tag, ty, tx, n, ((seed::UHUGEINT * {rng.GOLDEN} + (ty & 4294967295)::UHUGEINT) * {rng.GOLDEN}::UHUGEINT + (tx & 4294967295)::UHUGEINT) % {_MODULUS}::UHUGEINT AS s "
        f"FROM ({' UNION ALL '.join(parts)}))"
    )


def _normals(most: int) -> str:
    """CTEs up to ``nz`` (tag, ty, tx, k, v): the first n normals of every tile; ``most`` is the largest n."""
    return f"""pw AS (SELECT 1 AS k, {rng.STEP}::UHUGEINT AS a, {rng.ADD}::UHUGEINT AS b UNION ALL
  SELECT k + 1, (a * {rng.STEP}::UHUGEINT) % {_MODULUS}::UHUGEINT, (b * {rng.STEP}::UHUGEINT + {rng.ADD}::UHUGEINT) % {_MODULUS}::UHUGEINT FROM pw WHERE k < {8 * most // 5 + 128}),
no AS (SELECT tag, ty, tx, n, k - 1 AS k, CAST((s * a + b) & {_MODULUS - 1}::UHUGEINT AS UBIGINT) AS s FROM tl JOIN pw ON k <= 8 * n // 5 + 128),
nw AS (SELECT tag, ty, tx, n, k, (xor(s >> 18, s) >> 27) & 4294967295 AS x, s >> 59 AS r FROM no),
nu AS (SELECT tag, ty, tx, n, k // 2 AS p, k % 2 AS side, 2e0 * ((((x >> r) | ((x << ((32 - r) & 31)) & 4294967295)) & 4294967295) + 1e0) / 4294967296e0 - 1e0 AS u FROM nw),
nv AS (SELECT tag, ty, tx, n, p, max(u) FILTER (side = 0) AS a, max(u) FILTER (side = 1) AS b FROM nu GROUP BY ALL),
nn AS (SELECT tag, ty, tx, n, a, b, sqrt(-2e0 * ln(a * a + b * b) / (a * a + b * b)) AS f, row_number() OVER (PARTITION BY tag, ty, tx ORDER BY p) - 1 AS m FROM nv WHERE a * a + b * b > 0 AND a * a + b * b < 1),
nz AS MATERIALIZED (SELECT tag, ty, tx, k, CAST(v AS FLOAT)::DOUBLE AS v FROM (SELECT tag, ty, tx, n, 2 * m AS k, a * f AS v FROM nn UNION ALL SELECT tag, ty, tx, n, 2 * m + 1, b * f FROM nn) WHERE k < n)"""


def _noise_cells(tag: int, tile: int) -> str:
    """Rows (i, j, c, v) of one layer's noise by absolute cell."""
    return f"SELECT ty * {tile} + k % {tile * tile} // {tile} AS i, tx * {tile} + k % {tile} AS j, k // {tile * tile} AS c, v FROM nz WHERE tag = {tag}"


def _in_order(sql: str) -> str:
    """Joins to cells that are all there, as outer joins: they are then done in the order written, whatever sizes are guessed."""
    return re.sub(r"(?<!CROSS )JOIN", "LEFT JOIN", sql)


def _flow(x: str, answer: str, t: float) -> str:
    return f"(({_d(math.cos(t))} * ({x}) + {_d(math.sin(t) * 0.5)} * ({answer})) / 5e-1)"


def _decoder_sql() -> str:
    """Every stage is a function of the cell, so window weights cancel where windows agree, which is what the SQL assumes and the graph has to show."""
    t1, t2 = LATENT_TIMES
    rows = "CAST(({n} * h - 1) // {tile} AS BIGINT) AS"
    sizes = f"sz AS (SELECT {rows.format(n=2, tile=16)} lr, {rows.format(n=8, tile=64)} dr FROM size)"
    latent, wide = "(SELECT lr FROM sz)", "(SELECT dr FROM sz)"
    tiles = _tiles([(42 + SEEDS[0], 256, latent, "3", 0), (42 + SEEDS[1], 256, latent, "3", 0), (42 + SEEDS[2], 4096, wide, "3", 0)])
    noisy = f"{_d(math.sin(t1) * 0.5)} * v"
    return f"""WITH RECURSIVE {DENSE.replace('dense AS (', 'dense AS MATERIALIZED (')}, {sizes}, {SOLVER}, {tiles}, {_normals(4096)},
r AS (SELECT i, j, 0 AS k, v AS x, 0e0 AS old FROM dense UNION ALL
  SELECT i, j, k + 1, next / now * x - (next / now - 1) * (clean + CASE WHEN k IN (0, 19) THEN 0e0 ELSE 5e-1 * (clean - old) / (ln(last / now) / ln(now / next)) END), clean
  FROM (SELECT i, j, k, x, old, now, next, last, 25e-2 / (n * n) * x + now * 5e-1 / n * 5e-1 * lab * x / n AS clean FROM r JOIN sv USING (k))),
co AS MATERIALIZED (SELECT i, j, x / 100 AS c FROM r WHERE k = 20),
l1 AS (SELECT n.i, n.j, {_flow('x', f'{_d(math.cos(t1))} * x', t1)} + c AS v FROM (SELECT i, j, {noisy} AS x FROM ({_noise_cells(0, 16)})) n JOIN co ON co.i = n.i // 2 AND co.j = n.j // 2),
l2 AS MATERIALIZED (SELECT n.i, n.j, {_flow('x', f'{_d(math.cos(t2))} * x', t2)} + c AS v
  FROM (SELECT s.i, s.j, {_d(math.cos(t2))} * l1.v / 5e-1 + {_d(math.sin(t2) * 0.5)} * s.v AS x FROM ({_noise_cells(1, 16)}) s JOIN l1 USING (i, j)) n JOIN co ON co.i = n.i // 2 AND co.j = n.j // 2)
SELECT n.i, n.j, round({_flow('x', f'{_d(math.cos(t1))} * x', t1)} + l2.v, 5) + 0e0 AS v FROM (SELECT i, j, {noisy} AS x FROM ({_noise_cells(2, 64)})) n JOIN l2 ON l2.i = n.i // 4 AND l2.j = n.j // 4"""


def _ramp(at: str, size: int) -> str:
    """The weight of a window's cell along one axis."""
    mid = (size - 1) / 2
    return f"(1e0 - 0.999e0 * least(1e0, abs({at} - {_d(mid)}) / {_d(mid)}))"


def _region_sql() -> str:
    seed, image = 42, (0, 2, 3, 4, 5)
    near, far = math.cos(math.atan(SNR[0])), math.sin(math.atan(SNR[0]))
    sizes = "sz AS (SELECT h, CAST((h + 7) // 8 AS BIGINT) AS cr, CAST((4 * h + 5) // 8 AS BIGINT) AS lr, CAST((8 * h + 11) // 32 AS BIGINT) AS dr FROM size)"
    q = lambda name: f"(SELECT {name} FROM sz)"
    tiles = _tiles([
        (seed, 320, q("cr"), "4", -1), (seed + 1, 384, q("cr"), "4", -1), (seed + LATENT_SEED, 320, q("lr"), "16", -1),
        (seed + STEP_SEED, 320, q("lr"), "16", -1), (seed + LATENT_SEED, 1024, q("dr"), "8", -1),
    ])
    shaped = ["(click - 40e0) / 2", "error / 4e0", "purchase * 4e0 + 100", "signup * 9e0", "view / 2e0 + 10"]
    types = ", ".join(f"coalesce(max(v) FILTER (ch = '{t}'), 0e0) AS {t}" for t in ("click", "error", "purchase", "signup", "view"))
    scale = math.sqrt(sum(PARTS) * len(PARTS)) / len(PARTS)
    fixed = {2: (1 - COND_MEANS[6]) / COND_STDS[6] * scale / 4 * 0.3, 3: -0.5 * math.sqrt(12) * scale / 6 * 0.3}
    consts = ", ".join(f"({c}, {_d(m)}, {_d(s)})" for c, (m, s) in enumerate(zip(COND_MEANS[:6], COND_STDS[:6], strict=True)))
    answer = lambda t: f"{_d(math.cos(t))} * x + b"

    def blended(name: str, x: str, source: str, t: float) -> str:
        """CTEs: a latent stage's cells in every window that covers them, and their weighted mean."""
        return (
            f"{name}w AS (SELECT i, j, n.c, {_flow('x', answer(t), t)} AS v, {_ramp('(i - wi * 4)', 8)} * {_ramp('(j - wj * 4)', 8)} AS wt "
            f"FROM (SELECT s.i, s.j, s.c, {x} AS x FROM {source}) n LEFT JOIN lw ON lw.p = CAST(floor(n.i / 4e0) AS BIGINT) AND lw.q = CAST(floor(n.j / 4e0) AS BIGINT) AND lw.c = n.c), "
            f"{name} AS MATERIALIZED (SELECT i, j, c, sum(v * wt) / sum(wt) AS v FROM {name}w GROUP BY i, j, c)"
        )

    first = blended("l1", f"{_d(math.sin(FIRST) * 0.5)} * s.v", f"({_noise_cells(2, 8)}) s", FIRST)
    second = blended("l2", f"{_d(math.cos(SECOND) * 0.5)} * l1.v + {_d(math.sin(SECOND) * 0.5)} * s.v", f"({_noise_cells(3, 8)}) s JOIN l1 USING (i, j, c)", SECOND)
    low_h, full_h = "(SELECT 4 * h + 12 FROM size)", "(SELECT 8 * h + 24 FROM size)"
    slope = _in_order(_BIG_SLOPE.replace("2 * h - 1", "8 * h - 1").replace("least(61,", "least(247,"))
    sampled = ", ".join(
        f"(p.{n} * (1 - fx) + q.{n} * fx) * (1 - fy) + (r.{n} * (1 - fx) + s.{n} * fx) * fy AS {n}" for n in ("beta", "sea", "season", "rain", "spread")
    )
    corners = " ".join(
        f"JOIN cb {n} ON {n}.i = least((SELECT h + 1 FROM size), y0 + {a}) AND {n}.j = least(32, x0 + {b})" for n, a, b in (("p", 0, 0), ("q", 0, 1), ("r", 1, 0), ("s", 1, 1))
    )
    rows = "SELECT i, j, v AS elev, sea + beta * greatest(v, 0e0) AS t, season / 100 AS sd, greatest(0e0, rain) AS p, spread AS cv, sqrt(dx * dx + dy * dy) / 30e0 AS sl, 0e0 AS ns FROM big JOIN gg USING (i, j) JOIN cm USING (i, j)"
    return f"""WITH RECURSIVE {CHANNELS}, size AS (SELECT CAST(max(user_id) + 1 AS BIGINT) AS h FROM events), {sizes}, {SOLVER}, {tiles}, {_normals(1024)},
tw AS (SELECT i, j, {types} FROM cg GROUP BY i, j),
mp AS ({' UNION ALL '.join(f'SELECT i, j, {k} AS c, {e} AS v FROM tw' for k, e in enumerate(shaped))}),
st AS (SELECT * FROM (VALUES {consts}) AS t(c, mean, std)),
im AS (SELECT n.i, n.j, n.c, {_d(near)} * (CASE WHEN n.c = 1 AND coalesce(mp.v, 0e0) <= 20 THEN (coalesce(mp.v, 0e0) - 20) * 125e-2 + 20 ELSE coalesce(mp.v, 0e0) END - mean) / std + {_d(far)} * n.v AS v
  FROM ({_noise_cells(0, 8)}) n LEFT JOIN mp ON mp.i = n.i AND mp.j = n.j AND mp.c = n.c JOIN st ON st.c = [{', '.join(map(str, image))}][n.c + 1]),
r AS (SELECT n.i, n.j, n.c, 0 AS k, n.v * 80 AS x, 0e0 AS old, im.v * 4e-1 AS g FROM ({_noise_cells(1, 8)}) n JOIN im ON im.i = n.i AND im.j = n.j AND im.c = greatest(n.c - 1, 0) UNION ALL
  SELECT i, j, c, k + 1, next / now * x - (next / now - 1) * (clean + CASE WHEN k IN (0, 19) THEN 0e0 ELSE 5e-1 * (clean - old) * ln(now / next) / ln(last / now) END), clean, g
  FROM (SELECT i, j, c, k, x, old, g, now, next, last, 25e-2 / (n * n) * x + now * 5e-1 / n * (5e-1 * lab * x / n + g) AS clean FROM r JOIN sv USING (k))),
cw AS (SELECT i, j, c, x / 5e-1 * std + mean AS v FROM r JOIN st USING (c) WHERE k = 20),
co AS MATERIALIZED (SELECT c.i, c.j, c.c, CASE WHEN c.c = 1 THEN z.v - c.v ELSE c.v END AS v FROM cw c JOIN cw z ON z.i = c.i AND z.j = c.j AND z.c = 0 WHERE c.i BETWEEN -8 AND (SELECT h + 7 FROM size) AND c.j BETWEEN -8 AND 38),
cn AS (SELECT i, j, c, (v - mean) / std AS v FROM co JOIN st USING (c)),
ve AS MATERIALIZED (SELECT i - a AS wi, j - b AS wj, avg(v) FILTER (c = 1) * {_d(scale / 4 * 0.3)} AS b0, avg(v) FILTER (c >= 2 AND a IN (0, 1) AND b IN (0, 1)) * {_d(scale / 2 * 0.3)} AS b1, avg(v) FILTER (c = 0) * {_d(scale / 4 * 3.0)} AS b4
  FROM cn, (SELECT unnest(range(-1, 3)) AS a), (SELECT unnest(range(-1, 3)) AS b) GROUP BY 1, 2 HAVING count(*) = 96),
lw AS MATERIALIZED (SELECT wi, wj, wi + a AS p, wj + b AS q, c, CASE c WHEN 0 THEN b0 WHEN 1 THEN b1 WHEN 2 THEN {_d(fixed[2])} WHEN 3 THEN {_d(fixed[3])} ELSE b4 END AS b
  FROM ve, (SELECT unnest(range(0, 2)) AS a), (SELECT unnest(range(0, 2)) AS b), (SELECT unnest(range(0, 5)) AS c)),
{first}, {second},
la AS (SELECT i, j, sum(v) AS v FROM l2 WHERE c < 4 GROUP BY i, j),
res AS MATERIALIZED (SELECT n.i + 12 AS i, n.j + 12 AS j, {_flow('x', f'{_d(math.cos(FIRST))} * x + 0.02e0 * la.v', FIRST)} * {_d(RESIDUAL[1])} + {_d(RESIDUAL[0])} AS v
  FROM (SELECT i, j, {_d(math.sin(FIRST) * 0.5)} * v AS x FROM ({_noise_cells(4, 32)})) n JOIN la ON la.i = CAST(floor(n.i / 2e0) AS BIGINT) AND la.j = CAST(floor(n.j / 2e0) AS BIGINT)
  WHERE n.i BETWEEN -12 AND (SELECT 8 * h + 11 FROM size) AND n.j BETWEEN -12 AND 259),
low AS MATERIALIZED (SELECT i + 6 AS i, j + 6 AS j, v * {_d(LOW_STD)} + {_d(LOW_MEAN)} AS v FROM l2 WHERE c = 4 AND i BETWEEN -6 AND (SELECT 4 * h + 5 FROM size) AND j BETWEEN -6 AND 129),
{_extrapolated('low', 2, 'e', low_h, 136).replace('ec AS (', 'ec AS MATERIALIZED (').replace(_resized('ec', 'ey', 'ex'), _in_order(_resized('ec', 'ey', 'ex')))},
whole AS MATERIALIZED (SELECT u.i, u.j, u.v + r.v AS v FROM eu u JOIN res r USING (i, j)),
{_linear(full_h, low_h, 'dy')}, {_linear('272', '136', 'dx')}, down AS MATERIALIZED ({_in_order(_resized('whole', 'dy', 'dx'))}), {_in_order(_blurred(raster.kernel_truncated(5.0), 'down', 'b', low_h, 136)).replace('bi AS (', 'bi AS MATERIALIZED (').replace('bj AS (', 'bj AS MATERIALIZED (')},
{_linear(low_h, full_h, 'uy')}, {_linear('136', '272', 'ux')}, up AS ({_in_order(_resized('bi', 'uy', 'ux'))}),
big AS MATERIALIZED (SELECT i, j, CAST(sign(v) AS DOUBLE) * v * v AS v FROM (SELECT u.i - 12 AS i, u.j - 12 AS j, u.v + r.v AS v FROM up u JOIN res r USING (i, j)), size WHERE i BETWEEN 0 AND 8 * h - 1 AND j BETWEEN 0 AND 247),
{slope},
cg2 AS MATERIALIZED (SELECT i + 8 AS i, j + 8 AS j, pow(greatest(max(v) FILTER (c = 0), 0e0), 2) AS e, max(v) FILTER (c = 2) AS t, max(v) FILTER (c = 3) AS season, max(v) FILTER (c = 4) AS rain, max(v) FILTER (c = 5) AS spread FROM co GROUP BY 1, 2),
cs AS (SELECT y.i - a AS i, y.j - b AS j, coalesce(sum(t) FILTER (e > 0), 0e0) AS st, coalesce(sum(e) FILTER (e > 0), 0e0) AS se, coalesce(sum(e * e) FILTER (e > 0), 0e0) AS see, coalesce(sum(e * t) FILTER (e > 0), 0e0) AS se_t,
  count(*) FILTER (e > 0) AS w FROM cg2 y, (SELECT unnest(range(0, 15)) AS a), (SELECT unnest(range(0, 15)) AS b) GROUP BY 1, 2 HAVING count(*) = 225),
cv_ AS (SELECT *, see / (w + 1e-6) - (se / (w + 1e-6)) * (se / (w + 1e-6)) AS var, se_t / (w + 1e-6) - (se / (w + 1e-6)) * (st / (w + 1e-6)) AS cov FROM cs),
cb AS MATERIALIZED (SELECT i, j, beta, t - beta * e AS sea, season, rain, spread FROM (SELECT i, j, greatest(-0.012e0, least(0e0, CASE WHEN var < 1 OR w < 0.02e0 * 225 THEN -0.0065e0 ELSE cov / (var + 1e-6) END)) AS beta FROM cv_)
  JOIN (SELECT i - 7 AS i, j - 7 AS j, e, t, season, rain, spread FROM cg2) USING (i, j)),
cp AS (SELECT i, j, greatest(0e0, least((SELECT h + 1e0 FROM size), (i + 5e-1) / 8 + 5e-1)) AS y, greatest(0e0, least(32e0, (j + 5e-1) / 8 + 5e-1)) AS x FROM big),
cq AS (SELECT i, j, CAST(floor(y) AS BIGINT) AS y0, CAST(floor(x) AS BIGINT) AS x0, y - floor(y) AS fy, x - floor(x) AS fx FROM cp),
cm AS MATERIALIZED (SELECT cq.i, cq.j, {sampled} FROM cq {_in_order(corners)}),
{_classes(rows, 'i, j, elev').replace('r AS (', 'rw AS (', 1).replace('FROM r)', 'FROM rw)', 1)}
SELECT i, j, {_HEIGHT.format(v='elev')} AS height_m, class_id FROM cls"""


SQL = {"decoder_graph": _decoder_sql(), "world_region": _region_sql()}
