"""Statistics of grids: channel extremes, pivots and filters, quantile matching, windowed regression, climate."""

from __future__ import annotations

import math
from bisect import bisect_right

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .raster import halo, inner, line
from .shared import Shared
from .windows import clamp


def nan_min(v: Column | str) -> Column:
    v = F.col(v) if isinstance(v, str) else v
    return F.coalesce(F.min(F.when(~F.isnan(v), v)), F.lit(0.0))


def nan_max(v: Column | str) -> Column:
    v = F.col(v) if isinstance(v, str) else v
    return F.coalesce(F.max(F.when(~F.isnan(v), v)), F.lit(0.0))


def half_up(x: Column, digits: int) -> Column:
    """Rounded to so many digits, halves upwards also below zero."""
    f = float(10**digits)
    return F.floor(x * F.lit(f) + F.lit(0.5)) / F.lit(f)


def channel_stats(cells: DataFrame, channel: str = "ch") -> DataFrame:
    """Least and greatest value of each channel, NaN left out, 0 where there is none, to three digits."""
    return cells.groupBy(channel).agg(half_up(nan_min("v"), 3).alias("vmin"), half_up(nan_max("v"), 3).alias("vmax"))


def channel_pivot(cells: DataFrame, channels: list[str], channel: str = "ch") -> DataFrame:
    """One row per cell, one column per channel."""
    return cells.groupBy("i", "j").pivot(channel, channels).agg(F.first("v"))


def nested(cells: DataFrame, channel: str = "ch", digits: int = 2) -> DataFrame:
    """The rows of each channel's 2-D array: (channel, i, row), values by j, rounded.

    One row a line of the grid; a channel's whole array never stands in one row.
    """
    rows = cells.groupBy(channel, "i").agg(F.array_sort(F.collect_list(F.struct("j", half_up(F.col("v"), digits).alias("v")))).alias("row"))
    return rows.select(channel, "i", F.transform("row", lambda c: c["v"]).alias("row"))


def range_mask(wide: DataFrame, bounds: dict[str, tuple[float | None, float | None]]) -> DataFrame:
    """``inside``: whether all bounded channels lie in their inclusive ranges; a NaN passes, a missing cell does not."""
    ok = F.lit(True)
    for name, (low, high) in bounds.items():
        v = F.col(name)
        if low is not None:
            ok = ok & (F.isnan(v) | (v >= F.lit(float(low))))
        if high is not None:
            ok = ok & (F.isnan(v) | (v <= F.lit(float(high))))
    return wide.withColumn("inside", F.coalesce(ok, F.lit(False)))


def dim(value: Column, inside: Column, factor: float = 0.3) -> Column:
    return F.when(inside, value).otherwise(value * F.lit(factor))


def normalise(cells: DataFrame, stats: DataFrame, channel: str = "ch", back: bool = False) -> DataFrame:
    """(v - mean) / std per channel of ``stats`` (channel, mean, std), or back; the statistics are joined by channel."""
    joined = cells.join(stats, channel)
    v = F.col("v") * F.col("std") + F.col("mean") if back else F.when(F.col("std") != 0, (F.col("v") - F.col("mean")) / F.col("std")).otherwise(0.0)
    return joined.withColumn("v", v).drop("mean", "std")


def minmax(cells: DataFrame) -> DataFrame:
    """``t``: v scaled to [0, 1] over the whole grid; a constant grid counts as one wide."""
    ends = cells.agg(nan_min("v").alias("_lo"), nan_max("v").alias("_hi"))
    ends = ends.withColumn("_hi", F.when(F.col("_hi") == F.col("_lo"), F.col("_lo") + 1.0).otherwise(F.col("_hi")))
    both = cells.crossJoin(F.broadcast(ends))  # one row
    return both.withColumn("t", clamp((F.col("v") - F.col("_lo")) / (F.col("_hi") - F.col("_lo")), F.lit(0.0), F.lit(1.0))).drop("_lo", "_hi")


def place(x: Column, knots: list[float]) -> Column:
    """How many of the sorted knots are not above ``x``, by halving."""
    steps = [1 << k for k in range(max(1, len(knots).bit_length()) - 1, -1, -1)]
    table = F.array(*[F.lit(float(q)) for q in knots])
    up = lambda at, s: F.when((at + s <= len(knots)) & (F.get(table, at + s - 1) <= x), at + s).otherwise(at)
    return F.aggregate(F.array(*[F.lit(s) for s in steps]), F.lit(0), up)


def exact_quantiles(cells: DataFrame, levels: list[float], v: str = "v", bins: int = 1024) -> list[float]:
    """Linearly interpolated quantiles, exact; empty for no values.

    Approximate quantiles cut the values into bins of about equal weight; bin counts tell in which
    bins the wanted ranks lie, and only there values are counted and summed up in order.  What comes to the driver is
    ``bins`` cuts and counts and two values a level; no task holds more than a bin's distinct values, and sorts of them can spill.
    """
    rows = cells.select(F.col(v).cast("double").alias("v")).where(F.col(v).isNotNull())
    cuts = rows.agg(F.percentile_approx("v", [k / bins for k in range(1, bins)], 10 * bins).alias("c")).first()["c"]
    if not cuts:
        return []
    binned = rows.withColumn("bin", place(F.col("v"), sorted(set(cuts))))
    counts = {r["bin"]: r["n"] for r in binned.groupBy("bin").agg(F.count("*").alias("n")).collect()}
    total, before, at = sum(counts.values()), {}, 0
    for k in sorted(counts):
        before[k], at = at, at + counts[k]
    ranks = sorted({r for p in levels for r in (math.floor(p * (total - 1)), math.ceil(p * (total - 1)))})
    asked, order = [], sorted(before)
    for r in ranks:
        k = order[bisect_right([before[x] for x in order], r) - 1]
        asked.append((k, r - before[k], r))
    wanted = cells.sparkSession.createDataFrame(asked, "bin int, place long, rank long")
    ordered = Window.partitionBy("bin").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    summed = binned.where(F.col("bin").isin(sorted({k for k, _, _ in asked}))).groupBy("bin", "v").agg(F.count("*").alias("n"))
    summed = summed.withColumn("upto", F.sum("n").over(ordered)).join(F.broadcast(wanted), "bin")  # two rows a level
    value = {r["rank"]: r["v"] for r in summed.where((F.col("place") < F.col("upto")) & (F.col("place") >= F.col("upto") - F.col("n"))).collect()}
    found = []
    for p in levels:
        pos = p * (total - 1)
        low, high = value[math.floor(pos)], value[math.ceil(pos)]
        found.append(low + (pos - math.floor(pos)) * (high - low))
    return found


def quantile_table(cells: DataFrame, n: int, eps: float = 1e-4, v: str = "v") -> list[float]:
    """``n`` linearly interpolated quantiles from ``eps`` to 1 - eps, made strictly increasing."""
    found = exact_quantiles(cells, [eps + k * (1 - 2 * eps) / (n - 1) for k in range(n)], v)
    least = min((b - a for a, b in zip(found, found[1:], strict=False) if b > a), default=1e-10) * 0.1
    out: list[float] = []
    for x in found:
        out.append(x if not out or x > out[-1] else out[-1] + least)
    return out


def quantile_rows(cells: DataFrame, key: str, levels: list[float], shared: Shared, v: str = "v") -> DataFrame:
    """(key, n, q): exact linearly interpolated quantiles of every group, an array in the order of ``levels``; nulls do not count.

    Values are counted, and counts are sorted by ranges of (key, value), so a group of any size is many tasks; running sums within
    ranges and the ranges' totals tell each value its ranks, and only values at a wanted rank go on.  Nothing comes to the driver.
    """
    counts = cells.where(F.col(v).isNotNull() & F.col(key).isNotNull()).groupBy(key, F.col(v).cast("double").alias("v")).agg(F.count("*").alias("m"))
    ranged = shared.held(counts.repartitionByRange(key, "v").sortWithinPartitions(key, "v").withColumn("part", F.spark_partition_id()))
    totals = ranged.groupBy(key, "part").agg(F.sum("m").alias("t"))  # a row a group and range
    by_key = Window.partitionBy(key)
    totals = totals.select(key, "part", F.sum("t").over(by_key).alias("n"), (F.sum("t").over(by_key.orderBy("part").rowsBetween(Window.unboundedPreceding, 0)) - F.col("t")).alias("before"))
    upto = F.sum("m").over(Window.partitionBy(key, "part").orderBy("v").rowsBetween(Window.unboundedPreceding, 0))
    placed = ranged.withColumn("upto", upto).join(totals, [key, "part"]).withColumn("upto", F.col("upto") + F.col("before"))
    ps = F.array(*[F.lit(float(p)) for p in levels])
    first = F.col("upto") - F.col("m")
    holds = lambda rank: (rank >= first) & (rank < F.col("upto"))
    at = lambda p: p * (F.col("n") - 1)
    hits = F.filter(F.transform(ps, lambda p, k: F.struct(k.alias("k"), holds(F.floor(at(p))).alias("low"), holds(F.ceil(at(p))).alias("high"), (at(p) - F.floor(at(p))).alias("f"))), lambda s: s["low"] | s["high"])
    near = placed.select(key, "n", "v", F.explode(hits).alias("s"))
    ends = near.groupBy(key, "n", "s.k", "s.f").agg(F.max(F.when(F.col("s.low"), F.col("v"))).alias("a"), F.max(F.when(F.col("s.high"), F.col("v"))).alias("b"))
    value = F.struct("k", (F.col("a") + F.col("f") * (F.col("b") - F.col("a"))).alias("q"))
    return ends.groupBy(key, "n").agg(F.transform(F.array_sort(F.collect_list(value)), lambda s: s["q"]).alias("q"))  # as many as levels


def increasing(q: Column) -> Column:
    """Quantiles made strictly increasing: a repeated one lies a tenth of the least gap above the one before."""
    gaps = F.filter(F.zip_with(F.slice(q, 2, F.size(q)), q, lambda b, a: b - a), lambda g: g > 0)
    least = F.coalesce(F.array_min(gaps), F.lit(1e-10)) * 0.1
    step = lambda out, x: F.concat(out, F.array(F.when(x > F.element_at(out, -1), x).otherwise(F.element_at(out, -1) + least)))
    return F.when(F.size(q) < 2, q).otherwise(F.aggregate(F.slice(q, 2, F.size(q)), F.slice(q, 1, 1), step))


def match_rows(cells: DataFrame, key: str, source: DataFrame, target: DataFrame, n: int, v: str = "v") -> DataFrame:
    """``matched``: v taken from the place among its group's source quantiles (key, q) to the group's target quantiles, ``n`` knots each.

    Groups without a table get null.  The knots come by a join on the group; the segment is found by halving.
    """
    tables = source.select(key, F.col("q").alias("_xs")).join(target.select(key, F.col("q").alias("_ys")), key)
    met = cells.join(tables, key, "left")
    x, xs, ys = F.col(v), F.col("_xs"), F.col("_ys")
    steps = [1 << k for k in range(n.bit_length() - 1, -1, -1)]
    up = lambda at, s: F.when((at + s <= n) & (F.get(xs, at + s - 1) <= x), at + s).otherwise(at)
    met = met.withColumn("_k", F.greatest(F.lit(0), F.least(F.lit(n - 2), F.aggregate(F.array(*[F.lit(s) for s in steps]), F.lit(0), up) - 1)))
    a, b, c, d = (F.get(t, F.col("_k") + k) for t in (xs, ys) for k in (0, 1))
    inside = c + (x - a) / (b - a) * (d - c)
    ends = F.when(x <= F.get(xs, F.lit(0)), F.get(ys, F.lit(0))).when(x >= F.get(xs, F.lit(n - 1)), F.get(ys, F.lit(n - 1)))
    return met.withColumn("matched", F.when(xs.isNotNull() & x.isNotNull(), ends.otherwise(inside))).drop("_xs", "_ys", "_k")


def interp(x: Column, xp: list[float], fp: list[float]) -> Column:
    """Piecewise linear interpolation, clamped at the ends; xp increases strictly."""
    n = len(xp)
    segments = F.array(*[F.struct(F.lit(a).alias("x"), F.lit(c).alias("y"), F.lit((e - c) / (b - a)).alias("k")) for a, b, c, e in zip(xp, xp[1:], fp, fp[1:], strict=False)])
    lo = F.greatest(F.lit(0), F.least(F.lit(n - 2), place(x, xp) - 1))
    # The segment is looked up once; the lambda names it.
    within = F.get(F.transform(F.array(F.get(segments, lo)), lambda s: s["y"] + (x - s["x"]) * s["k"]), F.lit(0))
    return F.when(x <= xp[0], F.lit(fp[0])).when(x >= xp[-1], F.lit(fp[-1])).otherwise(within)


def quantile_match(cells: DataFrame, source: list[float], target: list[float]) -> DataFrame:
    """``matched``: v taken to the place that it has among the source's quantiles in the target's (as many knots)."""
    if not source or not target:
        return cells.withColumn("matched", F.lit(None).cast("double"))
    return cells.withColumn("matched", interp(F.col("v"), source, target))


def windowed_baseline(grid: DataFrame, size: int, threshold: float = 0.02) -> DataFrame:
    """Regression of ``t`` on ``e`` over the land cells of each size x size window that lies in the dense grid.

    Rows (i, j, beta, t_sea) by window corner; the slope falls back to -0.0065 where the land is
    flat or scarce and is clamped to [-0.012, 0].  Moments are summed along j, then along i.
    """
    land = F.when(F.col("e") > 0, 1.0).otherwise(0.0)
    parts = {"_t": F.col("t") * land, "_e": F.col("e") * land, "_ee": F.col("e") * F.col("e") * land, "_et": F.col("e") * F.col("t") * land, "_w": land}
    out = grid.withColumns(parts)
    pad = (size - 1) // 2
    out = halo(out, (0, size - 1), (0, size - 1))
    step_j, step_i = line("j"), line("i")
    along_j, along_i = step_j.rowsBetween(0, size - 1), step_i.rowsBetween(0, size - 1)
    out = out.withColumns({k: F.sum(k).over(along_j) for k in parts} | {"_n": F.count("*").over(along_j), "_tc": F.lead("t", pad).over(step_j), "_ec": F.lead("e", pad).over(step_j)})
    out = out.withColumns(
        {k: F.sum(k).over(along_i) for k in parts} | {"_n": F.sum("_n").over(along_i), "_tc": F.lead("_tc", pad).over(step_i), "_ec": F.lead("_ec", pad).over(step_i)}
    )
    out = inner(out).where(F.col("_n") == size * size)
    den = F.col("_w") + 1e-6
    mt, me, mee, met = (F.col(k) / den for k in ("_t", "_e", "_ee", "_et"))
    var, cov = mee - me * me, met - me * mt
    beta = F.when((var < 1.0) | (F.col("_w") < threshold * size * size), F.lit(-0.0065)).otherwise(cov / (var + 1e-6))
    out = out.withColumn("beta", clamp(beta, F.lit(-0.012), F.lit(0.0)))
    return out.select("i", "j", "beta", (F.col("_tc") - F.col("beta") * F.col("_ec")).alias("t_sea"))


def climate_correct(rows: DataFrame, a: float, b: float, p1: float, p99: float) -> DataFrame:
    """Columns elev, temp, temp_std, precip, precip_std after lapse-rate, spread and signed-root corrections."""
    elev, precip = F.col("elev"), F.col("precip")
    lapse = clamp(-6.5 + 0.0015 * precip, F.lit(-9.8), F.lit(-4.0)) / 1000.0
    rows = rows.withColumn("temp", clamp(F.col("temp") + lapse * F.greatest(F.lit(0.0), elev), F.lit(-10.0), F.lit(40.0)))
    baseline = F.lit(a) * F.col("temp") + F.lit(b)
    floor = F.greatest(F.lit(p1), -baseline)
    std = (F.col("temp_std") - F.lit(p1)) / F.lit(p99 - p1) * (F.lit(p99) - floor) + floor + baseline
    return rows.withColumns({
        "temp_std": F.greatest(std, F.lit(20.0)),
        "precip_std": F.col("precip_std") * F.greatest(F.lit(0.0), (185.0 - 0.04111 * precip) / 185.0),
        "elev": signed_root(elev),
    })


def signed_root(v: Column) -> Column:
    return F.signum(v) * F.sqrt(F.abs(v))


def signed_square(v: Column) -> Column:
    return F.signum(v) * v * v


def warm_rescale(v: Column) -> Column:
    """Temperatures of 20 and less are spread by a quarter around 20."""
    return F.when(v <= 20, (v - 20.0) * 1.25 + 20.0).otherwise(v)


def snr_mix(x: Column, noise: Column, snr: float) -> Column:
    """Signal and noise on the quarter circle whose angle is atan(snr)."""
    return F.cos(F.atan(F.lit(snr))) * x + F.sin(F.atan(F.lit(snr))) * noise


def scaled_concat(parts: list[tuple[str, int]]) -> Column:
    """Array columns (name, length) joined so that each keeps its share of magnitude."""
    total, k = sum(n for _, n in parts), len(parts)
    def scaled(name: str, n: int) -> Column:
        return F.transform(name, lambda v: v * F.lit((total * k) ** 0.5 / n**0.5 / k))

    return F.concat(*[scaled(name, n) for name, n in parts])
