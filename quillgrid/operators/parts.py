"""Raster operators on a rectangle of a dense grid that a task has in memory.

The arithmetic is that of :mod:`raster` and :mod:`stats`, on arrays whose last two axes are rows and columns.  Resizing, blurring and
sampling work along one axis: they are told at which cell the array begins and how long the grid is, so a neighbour beyond the
grid's edge is the edge cell, whatever rectangle a task has.  For each, ``*_reads`` tells which cells a range of targets takes.
"""

from __future__ import annotations

import numpy as np
from numpy.lib.stride_tricks import sliding_window_view

Span = tuple[int, int]


def _take(a: np.ndarray, axis: int, first: int, at: np.ndarray) -> np.ndarray:
    """Cells of the grid at places along an axis of an array that begins at ``first``."""
    if at.size and (at.min() < first or at.max() >= first + a.shape[axis]):
        raise IndexError(f"cells {at.min()} to {at.max()} of an array from {first} with {a.shape[axis]}")
    return a.take(at - first, axis)


def _mixed(a: np.ndarray, axis: int, first: int, x: np.ndarray, n: int) -> np.ndarray:
    """Linear interpolation at places ``x`` of ``n`` cells, clamped to the grid."""
    x = np.clip(x, 0.0, n - 1.0)
    low = np.floor(x).astype(np.int64)
    part = (x - low)[:, None] if axis % a.ndim == a.ndim - 2 else x - low
    return _take(a, axis, first, low) * (1.0 - part) + _take(a, axis, first, np.minimum(low + 1, n - 1)) * part


def _mixed_reads(x: np.ndarray, n: int) -> Span:
    x = np.clip(x, 0.0, n - 1.0)
    return int(x.min()), min(int(x.max()) + 2, n)


def _centres(t: Span, n_in: int, n_out: int) -> np.ndarray:
    return (np.arange(*t) + 0.5) * (n_in / n_out) - 0.5


def resize_reads(t: Span, n_in: int, n_out: int) -> Span:
    return _mixed_reads(_centres(t, n_in, n_out), n_in)


def resize(a: np.ndarray, axis: int, first: int, t: Span, n_in: int, n_out: int) -> np.ndarray:
    """Targets ``t`` of a linear resize of ``n_in`` cells to ``n_out`` (half-pixel centres)."""
    return _mixed(a, axis, first, _centres(t, n_in, n_out), n_in)


def enlarge_reads(t: Span, n: int, ratio: int) -> Span:
    low, high = (k - 1 for k in resize_reads((t[0] + ratio, t[1] + ratio), n + 2, ratio * (n + 2)))
    # A continued cell is made from the two next to it.
    return max(0, min(low, n - 2) if high > n else low), min(n, max(high, 2) if low < 0 else high)


def enlarge(a: np.ndarray, axis: int, first: int, t: Span, n: int, ratio: int) -> np.ndarray:
    """Targets ``t`` of an axis enlarged ``ratio`` times after it was continued linearly by a cell at both ends."""
    cell = lambda k: _take(a, axis, first, np.array([k]))
    before = [2 * cell(0) - cell(1)] if first == 0 else []
    after = [2 * cell(n - 1) - cell(n - 2)] if first + a.shape[axis] == n else []
    a, begin = np.concatenate([*before, a, *after], axis), first + 1 - len(before)
    return resize(a, axis, begin, (t[0] + ratio, t[1] + ratio), n + 2, ratio * (n + 2))


def blur_reads(t: Span, n: int, taps: list[float]) -> Span:
    half = len(taps) // 2
    return max(0, t[0] - half), min(n, t[1] + half)


def blur(a: np.ndarray, axis: int, first: int, t: Span, n: int, taps: list[float]) -> np.ndarray:
    """Targets ``t`` of a weighted sum along an axis."""
    half, at = len(taps) // 2, np.arange(*t)
    return sum(_take(a, axis, first, np.clip(at + k - half, 0, n - 1)) * c for k, c in enumerate(taps))


def sobel_reads(t: Span, n: int) -> Span:
    return max(0, t[0] - 1), min(n, t[1] + 1)


def sobel(a: np.ndarray, first: Span, rows: Span, cols: Span, shape: tuple[int, int], pixel: float = 1.0) -> np.ndarray:
    """Gradient magnitude by the Sobel kernels over eight, per ``pixel`` of length."""
    near = lambda a, axis, f, t, n, d: _take(a, axis, f, np.clip(np.arange(*t) + d, 0, n - 1))
    before, own, after = (near(a, -1, first[1], cols, shape[1], d) for d in (-1, 0, 1))
    d, s = ([near(x, -2, first[0], rows, shape[0], k) for k in (-1, 0, 1)] for x in (after - before, before + 2 * own + after))
    dx, dy = (d[0] + 2 * d[1] + d[2]) / 8.0, (s[2] - s[0]) / 8.0
    return np.sqrt(dx * dx + dy * dy) / pixel


def sample_reads(x: np.ndarray, n: int) -> Span:
    return _mixed_reads(x, n)


def sample(a: np.ndarray, first: Span, y: np.ndarray, x: np.ndarray, shape: tuple[int, int]) -> np.ndarray:
    """Values at all places of rows ``y`` and columns ``x``, interpolated; places are clamped to the grid."""
    return _mixed(_mixed(a, -1, first[1], x, shape[1]), -2, first[0], y, shape[0])


def windowed_baseline(t: np.ndarray, e: np.ndarray, size: int, threshold: float = 0.02) -> tuple[np.ndarray, np.ndarray]:
    """``beta`` and ``t_sea`` of each size x size window that lies in the arrays, by corner: a regression over land cells."""
    land = np.where(e <= 0, 0.0, 1.0)  # as in columns and SQL, NaN is above all numbers: land, and no slope
    sums = [sliding_window_view(sliding_window_view(v * land, size, 1).sum(-1), size, 0).sum(-1) for v in (t, e, e * e, e * t, np.ones_like(e))]
    w, pad = sums[4], (size - 1) // 2
    mt, me, mee, met = (s / (w + 1e-6) for s in sums[:4])
    var, cov = mee - me * me, met - me * mt
    beta = np.where((var < 1.0) | (w < threshold * size * size), -0.0065, cov / (var + 1e-6))
    beta = np.fmax(np.fmin(beta, 0.0), -0.012)
    middle = np.s_[pad : pad + beta.shape[0], pad : pad + beta.shape[1]]
    return beta, t[middle] - beta * e[middle]
