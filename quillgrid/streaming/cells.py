"""Grids kept up to date from a stream of cell values."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.windows import WindowSpec, assign


def window_sums(stream: DataFrame, rows: WindowSpec, cols: WindowSpec, time: str = "ts", late: str = "1 hour", every: str = "1 day") -> DataFrame:
    """Sum and count per time window and spatial window of a stream (time, i, j, v); works for a table as well.

    Late rows are taken up to the watermark; the state is one row per open window pair.
    """
    at = assign(stream.withWatermark(time, late), rows, cols)
    return at.groupBy(F.window(time, every).alias("at"), "wi", "wj").agg(F.sum("v").alias("total"), F.count("*").alias("n"))
