"""Noise schedules and solver steps on rows of arrays, with a pluggable model."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DATA = 0.5
LOW, HIGH, RHO = 0.002, 80.0, 7.0


def schedule(n: int) -> list[float]:
    """``n`` falling noise levels from 80 to 0.002 on a power-7 ramp, and a final 0."""
    a, b = HIGH ** (1 / RHO), LOW ** (1 / RHO)
    return [(a + k / (n - 1) * (b - a)) ** RHO for k in range(n)] + [0.0]


def schedule_table(ids: DataFrame, n: int, step: str = "step") -> DataFrame:
    """``sigma`` of each row's step as a column expression."""
    a, b = HIGH ** (1 / RHO), LOW ** (1 / RHO)
    ramp = F.pow(F.lit(a) + F.col(step) / F.lit(float(n - 1)) * F.lit(b - a), F.lit(RHO))
    return ids.withColumn("sigma", F.when(F.col(step) >= n, 0.0).otherwise(ramp))


def scale_in(x: Column, sigma: float) -> Column:
    return F.transform(x, lambda v: v * F.lit(1 / math.sqrt(sigma * sigma + DATA * DATA)))


def noise_label(sigma: float) -> float:
    return math.atan(sigma / DATA)


def scale_out(x: Column, model_out: Column, sigma: float) -> Column:
    """The clean estimate from a noisy sample and the model's raw answer."""
    s2, d2 = sigma * sigma, DATA * DATA
    skip, out = d2 / (s2 + d2), sigma * DATA / math.sqrt(s2 + d2)
    return F.zip_with(x, model_out, lambda a, b: F.lit(skip) * a + F.lit(out) * b)


def first_order(x: Column, clean: Column, now: float, then: float) -> Column:
    r = then / now
    return F.zip_with(x, clean, lambda a, c: F.lit(r) * a - F.lit(r - 1) * c)


def second_order(x: Column, clean: Column, before: Column, now: float, then: float, last: float) -> Column:
    """Midpoint step; ``before`` is the clean estimate of the step from ``last``."""
    r, h, h0 = then / now, math.log(now / then), math.log(last / now)
    c0, c1 = -(r - 1), -0.5 * (r - 1) * h / h0
    both = F.zip_with(clean, before, lambda c, b: F.lit(c0) * c + F.lit(c1) * (c - b))
    return F.zip_with(x, both, lambda a, d: F.lit(r) * a + d)


def solve(tiles: DataFrame, model: Callable[[Column, float], Column], steps: int, x: str = "x") -> DataFrame:
    """Column ``x`` of every tile after all solver steps: first order at both ends, second order between.

    ``model`` gets the scaled sample and the noise label and returns an array column, so a stub
    stays in the JVM; a real one is a pandas UDF.
    """
    sigma = schedule(steps)
    out = tiles
    for k in range(steps):
        answer = model(scale_in(F.col(x), sigma[k]), noise_label(sigma[k]))
        out = out.withColumn("_clean", scale_out(F.col(x), answer, sigma[k]))
        if k in (0, steps - 1):
            step = first_order(F.col(x), F.col("_clean"), sigma[k], sigma[k + 1])
        else:
            step = second_order(F.col(x), F.col("_clean"), F.col("_before"), sigma[k], sigma[k + 1], sigma[k - 1])
        out = out.withColumn(x, step).withColumn("_before", F.col("_clean")).drop("_clean")
    return out.drop("_before")


def linear_stub(gain: float = 0.5) -> Callable[[Column, float], Column]:
    """A deterministic stand-in for a learned model."""
    return lambda x, label: F.transform(x, lambda v: v * F.lit(gain * math.cos(label)))


def flow_step(x: Column, answer: Column, t: float) -> Column:
    """One step of flow matching on the circle: cos(t) x - sin(t) * data scale * answer."""
    return F.zip_with(x, answer, lambda a, b: F.lit(math.cos(t)) * a - F.lit(math.sin(t) * DATA) * b)


def solve_array(x: np.ndarray, model: Callable[[np.ndarray, float], np.ndarray], steps: int) -> np.ndarray:
    """As :func:`solve`, on an array within a tile function."""
    sigma, before = schedule(steps), None
    for k in range(steps):
        now, then = sigma[k], sigma[k + 1]
        norm = math.hypot(now, DATA)
        clean = DATA * DATA / norm**2 * x + now * DATA / norm * model(x / norm, noise_label(now))
        bend = 0.0 if k in (0, steps - 1) else 0.5 * (clean - before) * math.log(now / then) / math.log(sigma[k - 1] / now)
        x, before = then / now * x - (then / now - 1) * (clean + bend), clean
    return x


def flow_array(x: np.ndarray, answer: np.ndarray, t: float) -> np.ndarray:
    """One step of flow matching, in units of the data's scale; ``answer`` is the model's, which is negated."""
    return (math.cos(t) * x + math.sin(t) * DATA * answer) / DATA
