"""Statistics, classification, search, solver, noise and interface queries."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..functions import colormaps, noise, rng, text
from ..operators import classify, diffusion, search, stats, tensor
from ..operators.windows import floor_div
from ..sources import config, sinks
from .tables import CHANNELS, DENSE, GRID, channel_grid, dense_grid, event_grid, table



def channel_stats(spark, d):
    g = channel_grid(spark, d).withColumn("v", F.when(F.col("i") % 17 == 0, F.lit(float("nan"))).otherwise(F.col("v")))
    return stats.channel_stats(g)


CHANNEL_STATS = f"""WITH {CHANNELS} SELECT ch, floor(coalesce(min(v) FILTER (i % 17 <> 0), 0e0) * 1000e0 + 5e-1) / 1000e0 AS vmin,
floor(coalesce(max(v) FILTER (i % 17 <> 0), 0e0) * 1000e0 + 5e-1) / 1000e0 AS vmax FROM cg GROUP BY ch"""


def channel_pivot(spark, d):
    """Two channels side by side, and their difference as a third."""
    a, b = "click", "purchase"
    wide = stats.channel_pivot(channel_grid(spark, d), [a, b])
    return wide.select("i", "j", a, b, F.round(F.col(a) - F.col(b), 6).alias("diff"))


PIVOT = f"""WITH {CHANNELS} SELECT i, j, max(CASE WHEN ch = 'click' THEN v END) AS click, max(CASE WHEN ch = 'purchase' THEN v END) AS purchase,
round(max(CASE WHEN ch = 'click' THEN v END) - max(CASE WHEN ch = 'purchase' THEN v END), 6) AS diff FROM cg GROUP BY i, j"""


def range_filter_dim(spark, d):
    wide = stats.channel_pivot(channel_grid(spark, d), ["click", "purchase"])
    wide = wide.withColumn("click", F.when(F.col("i") % 17 == 0, F.lit(float("nan"))).otherwise(F.col("click")))
    masked = stats.range_mask(wide, {"click": (20.0, 300.0), "purchase": (None, 250.0)})
    return masked.select("i", "j", "inside", F.round(stats.dim(F.coalesce("purchase", F.lit(0.0)), F.col("inside")), 6).alias("shown"))


RANGE = f"""WITH {CHANNELS}, w AS (SELECT i, j, max(CASE WHEN ch = 'click' THEN v END) AS c, max(CASE WHEN ch = 'purchase' THEN v END) AS p FROM cg GROUP BY i, j),
m AS (SELECT *, coalesce((i % 17 = 0 OR (c >= 20 AND c <= 300)) AND p <= 250, false) AS inside FROM w)
SELECT i, j, inside, round(CASE WHEN inside THEN coalesce(p, 0e0) ELSE coalesce(p, 0e0) * 3e-1 END, 6) AS shown FROM m"""


def channel_arrays(spark, d):
    """Each channel's array, a line of the grid a row, its values as text with two digits."""
    rows = stats.nested(channel_grid(spark, d))
    return rows.select("ch", "i", F.array_join(F.transform("row", lambda v: F.format_string("%.2f", v)), ",").alias("row"), F.size("row").alias("n"))


ARRAYS = f"""WITH {CHANNELS} SELECT ch, i, string_agg(printf('%.2f', floor(v * 100e0 + 5e-1) / 100e0), ',' ORDER BY j) AS row, CAST(count(*) AS INT) AS n FROM cg GROUP BY ch, i"""


def minmax_colormap(spark, d):
    p = table(spark, d, "part").select("p_partkey", F.log1p(F.greatest("p_retailprice", F.lit(0.0))).alias("v"))
    t = stats.minmax(p)
    r, g, b = colormaps.viridis(F.col("t"))
    return t.select("p_partkey", F.round("t", 6).alias("t"), r.alias("r"), g.alias("g"), b.alias("b"))


_LUT = ", ".join(f"({k}, {r!r}::DOUBLE, {g!r}::DOUBLE, {b!r}::DOUBLE)" for k, (r, g, b) in enumerate(colormaps.table(colormaps.VIRIDIS)))
COLORMAP = f"""WITH p AS (SELECT p_partkey, ln(1e0 + greatest(p_retailprice, 0e0)) AS v FROM part), m AS (SELECT min(v) AS lo, max(v) AS hi FROM p),
t AS (SELECT p_partkey, (v - lo) / CASE WHEN hi = lo THEN 1e0 ELSE hi - lo END AS t FROM p, m), lut AS (SELECT * FROM (VALUES {_LUT}) AS x(k, r, g, b))
SELECT p_partkey, round(t, 6) AS t, r, g, b FROM t JOIN lut ON k = greatest(0, least(255, CAST(floor(t * 255 + 5e-1) AS INT)))"""


def quantile_table(spark, d):
    q = stats.quantile_table(table(spark, d, "lineitem").select(F.col("l_quantity").alias("v")), 64)
    return spark.createDataFrame(list(enumerate(q)), "k int, q double").select("k", F.round("q", 8).alias("q"))


_LEVELS64 = ", ".join(repr(1e-4 + k * (1 - 2e-4) / 63) + "::DOUBLE" for k in range(64))
QUANTILES = f"""WITH RECURSIVE q AS (SELECT unnest(quantile_cont(l_quantity, [{_LEVELS64}])) AS q, generate_subscripts(quantile_cont(l_quantity, [{_LEVELS64}]), 1) - 1 AS k FROM lineitem),
s AS (SELECT coalesce(min(q.q - p.q) FILTER (q.q > p.q), 1e-10) * 1e-1 AS least FROM q JOIN q p ON p.k = q.k - 1),
r AS (SELECT k, q FROM q WHERE k = 0 UNION ALL SELECT q.k, CASE WHEN q.q > r.q THEN q.q ELSE r.q + least END FROM r JOIN q ON q.k = r.k + 1, s)
SELECT CAST(k AS INT) AS k, round(q, 8) AS q FROM r"""


def quantile_match(spark, d):
    line = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_extendedprice").alias("v"))
    source = stats.quantile_table(line, 33)
    target = stats.quantile_table(table(spark, d, "orders").select(F.col("o_totalprice").alias("v")), 33)
    return stats.quantile_match(line, source, target).select("l_orderkey", "l_linenumber", F.round("matched", 4).alias("matched"))


_LEVELS33 = ", ".join(repr(1e-4 + k * (1 - 2e-4) / 32) + "::DOUBLE" for k in range(33))
MATCH = f"""WITH x AS (SELECT unnest(quantile_cont(l_extendedprice, [{_LEVELS33}])) AS q, unnest(range(33)) AS k FROM lineitem),
y AS (SELECT unnest(quantile_cont(o_totalprice, [{_LEVELS33}])) AS q, unnest(range(33)) AS k FROM orders),
s AS (SELECT a.q AS x0, b.q AS x1, c.q AS y0, e.q AS y1 FROM x a JOIN x b ON b.k = a.k + 1 JOIN y c ON c.k = a.k JOIN y e ON e.k = a.k + 1),
m AS (SELECT min(x0) AS lo, max(x1) AS hi, min(y0) AS ylo, max(y1) AS yhi FROM s)
SELECT l_orderkey, l_linenumber, round(CASE WHEN l_extendedprice <= lo THEN ylo WHEN l_extendedprice >= hi THEN yhi
  ELSE y0 + (l_extendedprice - x0) / (x1 - x0) * (y1 - y0) END, 4) AS matched FROM m, lineitem LEFT JOIN s ON l_extendedprice >= x0 AND l_extendedprice < x1"""


def windowed_baseline(spark, d):
    grid = _line_grid(spark, d)
    out = stats.windowed_baseline(grid, 15)
    return out.select("i", "j", F.round("beta", 7).alias("beta"), F.round(F.col("t_sea") + 1e-9, 4).alias("t_sea"))


def _line_grid(spark, d):
    cells = table(spark, d, "lineitem").select((F.dayofyear("l_shipdate") % 60).cast("long").alias("i"), F.col("l_quantity").cast("long").alias("j"), "l_extendedprice", "l_discount")
    known = cells.groupBy("i", "j").agg(F.round(F.avg("l_extendedprice") / 1000, 6).alias("t"), F.round((F.avg("l_discount") - 0.045) * 5000, 6).alias("e"))
    frame = spark.range(0, 60).select(F.col("id").alias("i"), F.explode(F.sequence(F.lit(1).cast("long"), F.lit(50).cast("long"))).alias("j"))
    return frame.join(known, ["i", "j"], "left").select("i", "j", F.coalesce("t", F.lit(0.0)).alias("t"), F.coalesce("e", F.lit(0.0)).alias("e"))


BASELINE = """WITH k AS (SELECT CAST(extract('doy' FROM l_shipdate) AS BIGINT) % 60 AS i, CAST(l_quantity AS BIGINT) AS j,
  round(avg(l_extendedprice) / 1000, 6) AS t, round((avg(l_discount) - 0.045e0) * 5000, 6) AS e FROM lineitem GROUP BY 1, 2),
g AS (SELECT a.i, b.j, coalesce(t, 0e0) AS t, coalesce(e, 0e0) AS e FROM (SELECT unnest(range(0, 60)) AS i) a CROSS JOIN (SELECT unnest(range(1, 51)) AS j) b LEFT JOIN k ON k.i = a.i AND k.j = b.j),
m AS (SELECT x.i, x.j, coalesce(sum(y.t) FILTER (y.e > 0), 0e0) AS st, coalesce(sum(y.e) FILTER (y.e > 0), 0e0) AS se, coalesce(sum(y.e * y.e) FILTER (y.e > 0), 0e0) AS see,
  coalesce(sum(y.e * y.t) FILTER (y.e > 0), 0e0) AS se_t, count(*) FILTER (y.e > 0) AS w, max(CASE WHEN y.i = x.i + 7 AND y.j = x.j + 7 THEN y.t END) AS tc, max(CASE WHEN y.i = x.i + 7 AND y.j = x.j + 7 THEN y.e END) AS ec
  FROM g x JOIN g y ON y.i BETWEEN x.i AND x.i + 14 AND y.j BETWEEN x.j AND x.j + 14 WHERE x.i <= 45 AND x.j <= 36 GROUP BY x.i, x.j),
n AS (SELECT *, see / (w + 1e-6) - (se / (w + 1e-6)) * (se / (w + 1e-6)) AS var, se_t / (w + 1e-6) - (se / (w + 1e-6)) * (st / (w + 1e-6)) AS cov FROM m),
b AS (SELECT *, greatest(-0.012e0, least(0e0, CASE WHEN var < 1 OR w < 0.02e0 * 225 THEN -0.0065e0 ELSE cov / (var + 1e-6) END)) AS beta FROM n)
SELECT i, j, round(beta, 7) AS beta, round(tc - beta * ec + 1e-9, 4) AS t_sea FROM b"""


def climate_correct(spark, d):
    rows = table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", (F.col("l_extendedprice") / 10 - 2000).alias("elev"), (F.col("l_quantity") - 15).cast("double").alias("temp"),
        (F.col("l_discount") * 8000).alias("temp_std"), (F.col("l_extendedprice") / 20).alias("precip"), (F.col("l_tax") * 900).alias("precip_std"),
    )
    out = stats.climate_correct(rows, -9.0, 500.0, 50.0, 1200.0)
    return out.select("l_orderkey", "l_linenumber", *[F.round(c, 4).alias(c) for c in ("elev", "temp", "temp_std", "precip", "precip_std")])


CLIMATE = """WITH r AS (SELECT l_orderkey, l_linenumber, l_extendedprice / 10 - 2000 AS elev, l_quantity - 15 AS temp0, l_discount * 8000 AS std0, l_extendedprice / 20 AS precip, l_tax * 900 AS pstd FROM lineitem),
a AS (SELECT *, greatest(-10e0, least(40e0, temp0 + greatest(-9.8e0, least(-4e0, -6.5e0 + 0.0015e0 * precip)) / 1000e0 * greatest(0e0, elev))) AS temp FROM r),
b AS (SELECT *, -9e0 * temp + 500e0 AS base, greatest(50e0, 9e0 * temp - 500e0) AS fl FROM a)
SELECT l_orderkey, l_linenumber, round(CAST(sign(elev) AS DOUBLE) * sqrt(abs(elev)), 4) AS elev, round(temp, 4) AS temp,
round(greatest(20e0, (std0 - 50e0) / 1150e0 * (1200e0 - fl) + fl + base), 4) AS temp_std, round(precip, 4) AS precip,
round(pstd * greatest(0e0, (185e0 - 0.04111e0 * precip) / 185e0), 4) AS precip_std FROM b"""


def signed_powers(spark, d):
    c = table(spark, d, "customer")
    v = F.col("c_acctbal")
    snr = stats.snr_mix(v, F.col("c_custkey") % 7 - 3.0, 0.8)
    return c.select(
        "c_custkey", F.round(stats.signed_root(v), 6).alias("root"), F.round(stats.signed_square(v / 100), 6).alias("square"),
        F.round(stats.warm_rescale(v / 100), 6).alias("warm"), F.round(snr, 6).alias("mixed"),
    )


POWERS = """SELECT c_custkey, round(CAST(sign(c_acctbal) AS DOUBLE) * sqrt(abs(c_acctbal)), 6) AS root,
round(CAST(sign(c_acctbal) AS DOUBLE) * (c_acctbal / 100e0) * (c_acctbal / 100e0), 6) AS square,
round(CASE WHEN c_acctbal / 100e0 <= 20 THEN (c_acctbal / 100e0 - 20e0) * 1.25e0 + 20e0 ELSE c_acctbal / 100e0 END, 6) AS warm,
round(cos(atan(0.8e0)) * c_acctbal + sin(atan(0.8e0)) * (c_custkey % 7 - 3e0), 6) AS mixed FROM customer"""


def climate_cells(spark, d, n_temp=0.0, n_precip=0.0):
    """Climate-like columns of line items, and noise inputs (numbers or columns); every 97th order has no climate."""
    line = table(spark, d, "lineitem")
    known = F.col("l_orderkey") % 97 != 0
    return line.select(
        "l_orderkey", "l_linenumber", F.floor(F.col("l_extendedprice") / 12 - 1500).cast("double").alias("elev"),
        F.when(known, F.col("l_quantity") * 0.9 - 13.5).alias("temp"), (F.col("l_discount") * 12000).alias("t_season"),
        (F.col("l_extendedprice") / 25).alias("precip"), (F.col("l_tax") * 1200).alias("p_cv"),
        ((F.col("l_partkey") % 20) * 0.071).alias("slope"), F.lit(n_temp).alias("n_temp"), F.lit(n_precip).alias("n_precip"), ((F.col("l_suppkey") % 5) - 2.0).alias("n_snow"),
    )


def classify_rules(spark, d):
    out = classify.classify(climate_cells(spark, d))
    return out.select("l_orderkey", "l_linenumber", F.col("class_id").cast("int").alias("class_id"))


_IDS = {n: k for k, n in classify.CLASSES.items()}
CLASSIFY_CTE = """r AS (SELECT l_orderkey, l_linenumber, floor(l_extendedprice / 12 - 1500) AS elev, CASE WHEN l_orderkey % 97 <> 0 THEN l_quantity * 0.9e0 - 13.5e0 END AS t,
  l_discount * 12000 / 100e0 AS sd, greatest(0e0, l_extendedprice / 25) AS p, l_tax * 1200 AS cv, (l_partkey % 20) * 0.071e0 AS sl, (l_suppkey % 5) - 2e0 AS ns FROM lineitem),
a AS (SELECT *, greatest(0e0, t + 5e-1 * sd) AS te, sd * 1.414e0 AS amp FROM r),
b AS (SELECT *, p / greatest(1e0, greatest(250e0, 250e0 + 25e0 * te + 0.7e0 * te * te)) * (1e0 - 0.35e0 * least(1e0, cv / 100e0)) AS m,
  CASE WHEN amp < 1e-1 THEN CASE WHEN t > 5 THEN 365e0 ELSE 0e0 END WHEN (5e0 - t) / amp <= -1 THEN 365e0 WHEN (5e0 - t) / amp >= 1 THEN 0e0
    ELSE 365e0 * (5e-1 - asin(greatest(-1e0, least(1e0, (5e0 - t) / amp))) / pi()) END AS gs FROM a),
c AS (SELECT *, m * greatest(0e0, least(1e0, (gs - 60e0) / 90e0)) AS tr, 0.7e0 + (1.19e0 - 0.7e0) * greatest(0e0, least(1e0, (m - 0.35e0) / 0.45e0)) AS bt FROM b),
e AS (SELECT *, sl >= bt AS bare, sl >= 0.62e0 AND sl < bt AS med, t + ns < 0 AND p > 150 AND NOT sl > 0.78e0 AS snow, m < 0.05e0 OR gs < 60 AS barren, m < 0.35e0 OR p < 350 AS dry FROM c),
f AS (SELECT *, tr < 0.2e0 OR bare AS none_, NOT bare AND tr >= 0.2e0 AND (tr < 0.5e0 OR med) AS sparse, NOT bare AND NOT med AND tr >= 0.5e0 AND tr < 0.8e0 AS forest,
  NOT bare AND NOT med AND tr >= 0.8e0 AND tr < 1.3e0 AS dense_, NOT bare AND NOT med AND tr >= 1.3e0 AS rain FROM e),
cls AS (SELECT l_orderkey, l_linenumber, CAST(CASE WHEN t IS NULL THEN 1
  WHEN elev < 0 THEN CASE WHEN t < -5 THEN 48 WHEN t < 5 THEN 46 WHEN t >= 20 THEN 41 ELSE 44 END
  WHEN bare THEN CASE WHEN snow THEN 33 ELSE 35 END
  WHEN elev > 2500 THEN CASE WHEN snow THEN CASE WHEN none_ THEN 32 WHEN sparse OR forest THEN 116 ELSE 16 END
    WHEN none_ THEN CASE WHEN barren THEN 19 WHEN dry THEN 31 ELSE 1 END WHEN sparse OR forest THEN 115 ELSE 15 END
  WHEN snow THEN CASE WHEN none_ THEN 3 WHEN sparse OR forest THEN 116 ELSE 16 END
  WHEN none_ THEN CASE WHEN t >= 20 THEN 5 WHEN barren AND NOT elev < 200 AND t >= -5 AND t < 20 THEN 31 WHEN dry THEN 31 ELSE 1 END
  WHEN sparse OR forest THEN CASE WHEN t >= 26 THEN 23 WHEN t >= 20 AND sparse AND NOT med THEN 17 WHEN t >= 20 AND forest THEN 108 WHEN t >= 12 AND t < 20 THEN 108 ELSE 115 END
  WHEN dense_ THEN CASE WHEN t >= 26 THEN 23 WHEN t >= 20 AND elev < 200 THEN 6 WHEN t >= -5 AND t < 12 THEN 15 ELSE 8 END
  ELSE CASE WHEN t >= 26 OR (t >= 20 AND sd < 5) THEN 23 WHEN elev < 200 THEN 6 WHEN t >= -5 AND t < 12 THEN 15 ELSE 8 END END AS INT) AS class_id FROM f)"""
CLASSIFY = f"WITH {CLASSIFY_CTE} SELECT l_orderkey, l_linenumber, class_id FROM cls"


def class_dimension(spark, d):
    """Named classes; ids of every seventh part are unknown and fall back."""
    out = classify.classify(climate_cells(spark, d)).withColumn("class_id", F.when(F.col("l_linenumber") == 7, F.lit(999)).otherwise(F.col("class_id")).cast("smallint"))
    return classify.with_names(out).groupBy("class_name").count().withColumnRenamed("count", "n")


_DIM = ", ".join(f"({k}, '{n}')" for k, n in classify.CLASSES.items())
DIMENSION = f"""WITH {CLASSIFY_CTE}, dim AS (SELECT * FROM (VALUES {_DIM}) AS x(id, name))
SELECT coalesce(name, 'plains') AS class_name, count(*) AS n FROM cls LEFT JOIN dim ON id = CASE WHEN l_linenumber = 7 THEN 999 ELSE class_id END GROUP BY 1"""


def heights(spark, d):
    c = table(spark, d, "customer").withColumn("scale", classify.clamp_scale((F.col("c_custkey") % 9).cast("int")))
    m = F.col("c_acctbal") * 3.7
    y = classify.block_height(m, F.col("scale"))
    rain = classify.precipitation(F.col("c_custkey") % 3 != 0, F.col("c_acctbal") / 10000)
    return c.select(
        "c_custkey", y.alias("y"), classify.top_height(F.col("scale")).alias("top"), classify.density(F.when(F.col("c_custkey") % 11 != 0, y), F.lit(70)).alias("density"),
        classify.to_int16(F.when(F.col("c_custkey") % 13 == 0, F.lit(float("nan"))).otherwise(m * 4)).cast("int").alias("h16"), rain.alias("falls"),
    )


HEIGHTS = """WITH c AS (SELECT c_custkey, c_acctbal, c_acctbal * 3.7e0 AS m, greatest(1, least(6, c_custkey % 9)) AS s FROM customer),
y AS (SELECT *, CAST(CASE WHEN m >= 0 THEN trunc(m / (30e0 / s)) + 63 ELSE trunc(-sqrt(abs(m) + 10e0) + sqrt(10e0)) + 62 END AS INT) AS y FROM c)
SELECT c_custkey, y, CAST(trunc(10000e0 / (30e0 / s)) + 63 AS INT) AS top, CAST(CASE WHEN c_custkey % 11 <> 0 THEN y - 70 ELSE -70 END AS INT) AS density,
CAST(CASE WHEN c_custkey % 13 = 0 THEN 0 ELSE greatest(-32768, least(32767, floor(m * 4))) END AS INT) AS h16,
CASE WHEN c_custkey % 3 = 0 THEN 'none' WHEN c_acctbal / 10000 >= 0.15e0 THEN 'rain' ELSE 'snow' END AS falls FROM y"""


def land_cells(spark, d):
    g = event_grid(spark, d)
    return search.all_land(g.withColumns({"v": F.col("v") - 30.0, "w": F.lit(1.0)}))


LAND = f"""WITH {GRID}, l AS (SELECT i, j FROM grid WHERE v - 30 > 0)
SELECT a.i + o.a AS i, a.j + p.b AS j FROM l a, (VALUES (-1), (0), (1)) o(a), (VALUES (-1), (0), (1)) p(b) GROUP BY 1, 2 HAVING count(*) = 9"""


def nearest_land(spark, d):
    return search.nearest(land_cells(spark, d), 7, 15)


NEAREST = f"WITH c AS ({LAND}) SELECT i, j, greatest(abs(i - 7), abs(j - 15)) AS dist FROM c ORDER BY dist, i - 7, j - 15 LIMIT 1"


def expanding_search(spark, d):
    return search.expanding(land_cells(spark, d), 7, 15)


EXPANDING = f"""WITH c AS ({LAND}), s AS (SELECT i, j, n, (n - 16) // 8 AS step FROM c, (SELECT unnest(range(16, 129, 8)) AS n) WHERE i - 7 BETWEEN -n // 2 + 1 AND n // 2 - 2 AND j - 15 BETWEEN -n // 2 + 1 AND n // 2 - 2),
b AS (SELECT i, j, step FROM s ORDER BY step, greatest(abs(i - 7), abs(j - 15)), i - 7, j - 15 LIMIT 1)
SELECT coalesce((SELECT i FROM b), 7) AS i, coalesce((SELECT j FROM b), 15) AS j, coalesce((SELECT step FROM b), -1) AS step"""


def sigma_schedule(spark, d):
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_quantity").cast("int") % 21).alias("step"))
    s = diffusion.schedule_table(rows, 20)
    skip = 0.25 / (F.col("sigma") * F.col("sigma") + 0.25)
    return s.select("l_orderkey", "l_linenumber", F.round("sigma", 6).alias("sigma"), F.round(F.atan(F.col("sigma") / 0.5), 6).alias("label"), F.round(skip, 6).alias("skip"))


_A, _B = 80.0 ** (1 / 7), 0.002 ** (1 / 7)
SCHEDULE = f"""WITH s AS (SELECT l_orderkey, l_linenumber, CASE WHEN CAST(l_quantity AS INT) % 21 >= 20 THEN 0e0 ELSE pow({_A!r}::DOUBLE + (CAST(l_quantity AS INT) % 21) / 19e0 * {_B - _A!r}::DOUBLE, 7e0) END AS s FROM lineitem)
SELECT l_orderkey, l_linenumber, round(s, 6) AS sigma, round(atan(s / 5e-1), 6) AS label, round(25e-2 / (s * s + 25e-2), 6) AS skip FROM s"""


def solver_steps(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", F.transform("embedding", lambda v: v.cast("double") * 80.0).alias("x"))
    out = diffusion.solve(e, diffusion.linear_stub(), 6)
    # Exploded through a transform: a filter that Spark infers on a plain array would repeat the whole chain.
    each = F.explode(F.transform("x", lambda v, k: F.struct(k.alias("k"), v.alias("v"))))
    return out.select("vec_id", each.alias("c")).select("vec_id", "c.k", (F.round("c.v", 5) + 0.0).alias("v"))


def _solver_sql(steps: int = 6) -> str:
    """The same steps on one component at a time: with a linear model they are a chain of scalar updates."""
    s = diffusion.schedule(steps)
    ctes = ["s0 AS (SELECT vec_id, unnest(range(len(embedding))) AS k, CAST(unnest(embedding) AS DOUBLE) * 80e0 AS x, 0e0 AS b FROM embeddings)"]
    for n in range(steps):
        now, then = s[n], s[n + 1]
        gain = 0.5 * math.cos(math.atan(now / 0.5)) / math.sqrt(now * now + 0.25)
        clean = f"(x * {0.25 / (now * now + 0.25)!r}::DOUBLE + x * {gain * now * 0.5 / math.sqrt(now * now + 0.25)!r}::DOUBLE)"
        r = then / now
        if n in (0, steps - 1):
            nxt = f"{r!r}::DOUBLE * x - {r - 1!r}::DOUBLE * c"
        else:
            ratio = math.log(now / then) / math.log(s[n - 1] / now)
            nxt = f"{r!r}::DOUBLE * x - {r - 1!r}::DOUBLE * c - {0.5 * (r - 1) * ratio!r}::DOUBLE * (c - b)"
        ctes.append(f"s{n + 1} AS (SELECT vec_id, k, {nxt} AS x, c AS b FROM (SELECT *, {clean} AS c FROM s{n}))")
    return "WITH " + ", ".join(ctes) + f" SELECT vec_id, CAST(k AS INT) AS k, round(x, 5) + 0e0 AS v FROM s{steps}"


def tensor_unflatten(spark, d):
    e = table(spark, d, "embeddings")
    cells = tensor.unflatten(e, "embedding", (4, 4, 4), ("vec_id",))
    return cells.groupBy("vec_id", "ch").agg(F.round(F.avg(F.when(F.col("r").isin(1, 2) & F.col("c").isin(1, 2), F.col("v").cast("double"))), 6).alias("centre"), F.count("*").alias("n"))


UNFLATTEN = """WITH e AS (SELECT vec_id, unnest(range(len(embedding))) AS k, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings)
SELECT vec_id, CAST(k // 16 AS INT) AS ch, round(avg(v) FILTER ((k // 4) % 4 IN (1, 2) AND k % 4 IN (1, 2)), 6) AS centre, count(*) AS n FROM e GROUP BY vec_id, k // 16"""


def scaled_concat(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", F.slice("embedding", 1, 16).cast("array<double>").alias("a"), F.slice("embedding", 17, 42).cast("array<double>").alias("b"))
    joined = e.withColumn("z", stats.scaled_concat([("a", 16), ("b", 42)]))
    return joined.select("vec_id", F.size("z").alias("n"), F.round(F.aggregate("z", F.lit(0.0), lambda s, v: s + v * v), 6).alias("power"), (F.size("z") * 4).alias("n_bytes"))


CONCAT = """WITH e AS (SELECT vec_id, unnest(range(len(embedding))) AS k, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings)
SELECT vec_id, CAST(count(*) AS INT) AS n, round(sum(pow(v * CASE WHEN k < 16 THEN sqrt(116e0) / sqrt(16e0) / 2 ELSE sqrt(116e0) / sqrt(42e0) / 2 END, 2)), 6) AS power, CAST(count(*) * 4 AS INT) AS n_bytes FROM e WHERE k < 58 GROUP BY vec_id"""


def lru_budget(spark, d):
    """The event log as accesses to tiles of 16 users, one tensor per event type."""
    log = table(spark, d, "events").select(F.col("event_type").alias("tensor"), floor_div("user_id", 4).alias("tile"), F.col("event_id").alias("at"), (F.lit(1000) + F.col("user_id") % 7).alias("bytes"))
    return tensor.within_budget(log, 20_000).select("tensor", "tile", "last", "bytes")


LRU = """WITH a AS (SELECT event_type AS tensor, CAST(floor(user_id / 4e0) AS BIGINT) AS tile, max(event_id) AS last, arg_max(1000 + user_id % 7, event_id) AS bytes FROM events GROUP BY 1, 2),
h AS (SELECT *, sum(bytes) OVER (PARTITION BY tensor ORDER BY last DESC, tile DESC ROWS UNBOUNDED PRECEDING) AS held, row_number() OVER (PARTITION BY tensor ORDER BY last DESC, tile DESC) AS n FROM a)
SELECT tensor, tile, last, bytes FROM h WHERE held <= 20000 OR n = 1"""


def memo_lookup(spark, d):
    """Windows of large customers' orders that the memo of small ones does not hold."""
    o = table(spark, d, "orders").select(floor_div("o_custkey", 8).alias("wi"), F.dayofmonth("o_orderdate").cast("long").alias("wj"), "o_totalprice")
    asked, known = (o.where(c).select("wi", "wj").distinct() for c in ("o_totalprice > 200000", "o_totalprice <= 200000"))
    hit = asked.join(known, ["wi", "wj"], "left_semi").withColumn("known", F.lit(True))
    return hit.unionByName(asked.join(known, ["wi", "wj"], "left_anti").withColumn("known", F.lit(False)))


MEMO = """WITH o AS (SELECT CAST(floor(o_custkey / 8e0) AS BIGINT) AS wi, CAST(extract('day' FROM o_orderdate) AS BIGINT) AS wj, o_totalprice AS p FROM orders),
a AS (SELECT DISTINCT wi, wj FROM o WHERE p > 200000) SELECT wi, wj, EXISTS (SELECT 1 FROM o WHERE o.wi = a.wi AND o.wj = a.wj AND p <= 200000) AS known FROM a"""


def human_bytes(spark, d):
    return table(spark, d, "documents").select("doc_id", text.human_bytes(F.col("n_chars") * F.col("n_chars") * 37).alias("shown"))


HUMAN = """WITH b AS (SELECT doc_id, n_chars * n_chars * 37 AS n FROM documents)
SELECT doc_id, CASE WHEN n < 1024 THEN n || ' B' WHEN n / 1024e0 < 1024 THEN printf('%.1f KiB', floor(n / 1024e0 * 10 + 5e-1) / 10) WHEN n / 1048576e0 < 1024 THEN printf('%.1f MiB', floor(n / 1048576e0 * 10 + 5e-1) / 10) ELSE printf('%.2f GiB', floor(n / 1073741824e0 * 100 + 5e-1) / 100) END AS shown FROM b"""


def config_json(spark, d):
    """Event properties as records: a typed field, and the same through a query string with a default."""
    e = table(spark, d, "events").select("event_id", F.from_json("props", "k int").alias("p"), F.concat(F.lit("k="), F.get_json_object("props", "$.k"), F.lit("&x=abc&flag")).alias("q"))
    m = text.query_map(F.col("q"))
    return e.select("event_id", F.col("p.k").alias("k"), text.int_or(F.try_element_at(m, F.lit("k")), -1).alias("qk"), text.int_or(F.try_element_at(m, F.lit("x")), 50).alias("qx"), F.size(m).alias("n"))


CONFIG = "SELECT event_id, CAST(json_extract(props, '$.k') AS INT) AS k, CAST(json_extract(props, '$.k') AS INT) AS qk, 50 AS qx, 3 AS n FROM events"


def manifest(spark, d):
    """Parts as a manifest in JSON, read back as one row per asset."""
    p = table(spark, d, "part")
    asset = F.struct(F.sha2("p_name", 256).alias("sha256"), F.col("p_size").cast("long").alias("sizeBytes"), F.concat(F.lit("u/"), "p_brand").alias("url"))
    # A manifest holds the parts of one brand and one block of keys, so none grows with the table.
    body = p.groupBy("p_brand", floor_div("p_partkey", 1000).alias("block")).agg(F.map_from_entries(F.collect_list(F.struct(F.col("p_partkey").cast("string"), asset))).alias("assets"))
    texts = body.select(F.to_json(F.struct(F.col("p_brand").alias("repositorySlug"), F.lit("r1").alias("revision"), "assets")).alias("value"))
    return config.manifest_assets(texts)


MANIFEST = "SELECT p_brand AS slug, 'r1' AS revision, CAST(p_partkey AS VARCHAR) AS name, sha256(p_name) AS sha256, CAST(p_size AS BIGINT) AS size_bytes, 'u/' || p_brand AS url FROM part"


def _points(spark, d):
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_partkey") - 300).alias("x"), (F.col("l_suppkey") * 3 - 77).alias("y"))


_FBM = noise.Noise(seed=12345, frequency=1 / 50, fractal="fbm", octaves=3, weighted=0.4)


def perlin_fbm(spark, d):
    return noise.add_noise(_points(spark, d), ["x", "y"], _FBM, "v").select("l_orderkey", "l_linenumber", (F.round("v", 6) + 0.0).alias("v"))


def _wrap(x: str) -> str:
    return f"(xor(({x}) & 4294967295, 2147483648) - 2147483648)"


def _noise_sql(n: noise.Noise) -> str:
    """The octaves as a chain of CTEs: lattice, four hashes, gradients or values, interpolation, sum."""
    px, py = noise.PRIMES[:2]
    ctes = [f"o0 AS (SELECT l_orderkey, l_linenumber, (l_partkey - 300) * {n.frequency!r}::DOUBLE AS x, (l_suppkey * 3 - 77) * {n.frequency!r}::DOUBLE AS y, 0e0 AS s, {n.bounding!r}::DOUBLE AS amp FROM lineitem)"]
    octaves = 1 if n.fractal == "none" else n.octaves
    for k in range(octaves):
        fl = lambda c: f"CAST(CASE WHEN {c} >= 0 THEN trunc({c}) ELSE trunc({c}) - 1 END AS BIGINT)"
        ctes.append(f"a{k} AS (SELECT *, {fl('x')} AS cx, {fl('y')} AS cy FROM o{k})")
        ctes.append(f"b{k} AS (SELECT *, x - cx AS dx, y - cy AS dy, {_wrap(f'cx * {px}')} AS x0, {_wrap(f'cy * {py}')} AS y0 FROM a{k})")
        ctes.append(f"c{k} AS (SELECT *, {_wrap(f'x0 + {px}')} AS x1, {_wrap(f'y0 + {py}')} AS y1 FROM b{k})")
        h = lambda a, b: _wrap(f"xor(xor({n.seed + k}, x{a}), y{b}) * {noise.HASH}")
        ctes.append(f"d{k} AS (SELECT *, " + ", ".join(f"{h(a, b)} AS h{a}{b}" for a in (0, 1) for b in (0, 1)) + f" FROM c{k})")
        if n.kind == "perlin":
            ctes.append(f"e{k} AS (SELECT *, " + ", ".join(f"(xor(h{a}{b}, h{a}{b} >> 15) & 254) >> 1 AS g{a}{b}" for a in (0, 1) for b in (0, 1)) + f" FROM d{k})")
            turn = lambda a, b: f"radians(CASE WHEN g{a}{b} < 120 THEN 75e-1 + 15e0 * (g{a}{b} % 24) ELSE 225e-1 + 45e0 * (g{a}{b} - 120) END)"
            corner = lambda a, b: f"((dx - {a}) * sin({turn(a, b)}) + (dy - {b}) * cos({turn(a, b)}))"
            fade = lambda t: f"({t} * {t} * {t} * ({t} * ({t} * 6 - 15) + 10))"
            amp = noise.PERLIN_2D
        else:
            ctes.append(f"w{k} AS (SELECT *, " + ", ".join(f"{_wrap(f'h{a}{b} * h{a}{b}')} AS g{a}{b}" for a in (0, 1) for b in (0, 1)) + f" FROM d{k})")
            ctes.append(f"e{k} AS (SELECT * FROM w{k})")
            corner = lambda a, b: "(" + _wrap(f"xor(g{a}{b}, {_wrap(f'g{a}{b} * 524288')})") + " / 2147483648e0)"
            fade = lambda t: f"({t} * {t} * (3 - 2 * {t}))"
            amp = 1.0
        ctes.append(f"f{k} AS (SELECT *, " + ", ".join(f"{corner(a, b)} AS q{a}{b}" for a in (0, 1) for b in (0, 1)) + f", {fade('dx')} AS sx, {fade('dy')} AS sy FROM e{k})")
        ctes.append(f"n{k} AS (SELECT *, (q00 + sx * (q10 - q00) + sy * ((q01 + sx * (q11 - q01)) - (q00 + sx * (q10 - q00)))) * {amp!r}::DOUBLE AS n FROM f{k})")
        add, share = {"fbm": ("n", "least(n + 1, 2e0) * 5e-1"), "ridged": ("(abs(n) * -2 + 1)", "1 - abs(n)"), "none": ("n", "1e0")}[n.fractal]
        unit = "amp" if n.fractal != "none" else "1e0"
        ctes.append(f"o{k + 1} AS (SELECT l_orderkey, l_linenumber, x * {n.lacunarity!r} AS x, y * {n.lacunarity!r} AS y, s + {add} * {unit} AS s, amp * (1e0 + {n.weighted!r}::DOUBLE * ({share} - 1e0)) * {n.gain!r}::DOUBLE AS amp FROM n{k})")
    return "WITH " + ", ".join(ctes) + f" SELECT l_orderkey, l_linenumber, round(s, 6) + 0e0 AS v FROM o{octaves}"


_RIDGED = noise.Noise(seed=99, frequency=0.03, kind="value", fractal="ridged", octaves=2)
_PLAIN = noise.Noise(seed=-7, frequency=0.011)


def value_ridged(spark, d):
    return noise.add_noise(_points(spark, d), ["x", "y"], _RIDGED, "v").select("l_orderkey", "l_linenumber", (F.round("v", 6) + 0.0).alias("v"))


def perlin_plain(spark, d):
    return noise.add_noise(_points(spark, d), ["x", "y"], _PLAIN, "v").select("l_orderkey", "l_linenumber", (F.round("v", 6) + 0.0).alias("v"))


def tile_seeds(spark, d):
    g = event_grid(spark, d).select((F.col("i") - 75).alias("ty"), F.col("j").alias("tx"))
    return g.select("ty", "tx", rng.seed_column(42, "ty", "tx").alias("seed"))


SEEDS = f"""WITH {GRID}, g AS (SELECT i - 75 AS ty, j AS tx FROM grid),
h AS (SELECT ty, tx, ((42 * 2654435769 + (ty & 4294967295))::HUGEINT * 2654435769 + (tx & 4294967295)) % 18446744073709551616 AS h FROM g)
SELECT ty, tx, CAST(CASE WHEN h >= 9223372036854775808 THEN h - 18446744073709551616 ELSE h END AS BIGINT) AS seed FROM h"""


def gaussian_patch(spark, d):
    cells = event_grid(spark, d).select((F.col("i") - 20).alias("i"), (F.col("j") - 5).alias("j"))
    return rng.gaussian_patch(cells, 42, channels=2, tile=32).withColumn("v", F.round("v", 5) + 0.0)


def elevation_detail(spark, d):
    """Noise on slopes above the sea: strength grows with the gradient to the power of two and a half."""
    from ..operators import raster

    g, _ = dense_grid(spark, d)
    slope = raster.sobel(g).withColumnRenamed("v", "grad")
    both = noise.add_noise(g.join(slope, ["i", "j"]), ["j", "i"], noise.Noise(seed=3, frequency=0.05, fractal="fbm", octaves=2), "n")
    part = F.least(F.lit(1.0), F.col("grad") / 40.0)
    return both.select("i", "j", F.round(F.when(F.col("v") < 0, F.col("v")).otherwise(F.col("v") + F.col("n") * 100.0 * F.pow(part, F.lit(2.5))), 6).alias("v"))


def heightmap(spark, d):
    """Region plan: enlarge, classify by height and climate of the same cells, and give block heights."""
    from ..operators import raster

    g, (h, w) = dense_grid(spark, d)
    big = raster.resize_bilinear(g.withColumn("v", F.col("v") * 8 - 300), (h, w), (2 * h, 2 * w))
    big = big.withColumn("v", F.round(F.col("v") + 1e-9, 6))  # whole numbers stay whole
    slope = raster.sobel(big, 60.0).withColumnRenamed("v", "slope")
    cells = big.join(slope, ["i", "j"]).select(
        "i", "j", F.col("v").alias("elev"), "slope", (25.0 - F.col("v") / 160).alias("temp"), F.lit(600.0).alias("t_season"), (F.col("j") * 25.0).alias("precip"),
        F.lit(40.0).alias("p_cv"), F.lit(0.0).alias("n_temp"), F.lit(0.0).alias("n_precip"), F.lit(0.0).alias("n_snow"),
    )
    out = classify.classify(cells)
    return out.select("i", "j", classify.to_int16(F.col("elev")).cast("int").alias("height_m"), F.col("class_id").cast("int").alias("class_id"), classify.block_height(F.floor("elev").cast("double"), F.lit(2)).alias("y"))


def picture_tiles(spark, d):
    from ..operators import raster

    shown = raster.relief(dense_grid(spark, d)[0])
    return sinks.png_tiles(shown, 64).select("ty", "tx", F.length("data").alias("n_bytes"))


def raw_tiles(spark, d):
    g, _ = dense_grid(spark, d)
    return sinks.raw_tiles(g.select("i", "j", F.col("v").alias("elev"), (F.col("v") / 7).alias("temp")), 32).select("ty", "tx", F.length("data").alias("n_bytes"))


RAW = f"WITH {DENSE} SELECT DISTINCT CAST(floor(i / 32e0) AS BIGINT) AS ty, CAST(floor(j / 32e0) AS BIGINT) AS tx, 6144 AS n_bytes FROM dense"

QUERIES = {
    "channel_stats": (channel_stats, CHANNEL_STATS), "channel_pivot": (channel_pivot, PIVOT), "channel_arrays": (channel_arrays, ARRAYS), "range_filter_dim": (range_filter_dim, RANGE),
    "minmax_colormap": (minmax_colormap, COLORMAP), "quantile_table": (quantile_table, QUANTILES), "quantile_match": (quantile_match, MATCH),
    "windowed_baseline": (windowed_baseline, BASELINE), "climate_correct": (climate_correct, CLIMATE), "signed_powers": (signed_powers, POWERS),
    "classify_rules": (classify_rules, CLASSIFY), "class_dimension": (class_dimension, DIMENSION), "heights": (heights, HEIGHTS), "land_cells": (land_cells, LAND),
    "nearest_land": (nearest_land, NEAREST), "expanding_search": (expanding_search, EXPANDING), "sigma_schedule": (sigma_schedule, SCHEDULE),
    "solver_steps": (solver_steps, _solver_sql()), "tensor_unflatten": (tensor_unflatten, UNFLATTEN), "scaled_concat": (scaled_concat, CONCAT), "lru_budget": (lru_budget, LRU),
    "memo_lookup": (memo_lookup, MEMO), "human_bytes": (human_bytes, HUMAN), "config_json": (config_json, CONFIG), "manifest": (manifest, MANIFEST),
    "perlin_fbm": (perlin_fbm, _noise_sql(_FBM)), "perlin_plain": (perlin_plain, _noise_sql(_PLAIN)), "value_ridged": (value_ridged, _noise_sql(_RIDGED)),
    "tile_seeds": (tile_seeds, SEEDS), "gaussian_patch": (gaussian_patch, None), "elevation_detail": (elevation_detail, None),
    "heightmap": (heightmap, None), "picture_tiles": (picture_tiles, None), "raw_tiles": (raw_tiles, RAW),
}
