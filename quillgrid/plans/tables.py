"""Grids over the test tables, and the same grids in DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.windows import dense

#: Days of a month: the width of the event grids.
DAYS = 31


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def event_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as cells: i user, j day of the month from 0, ch type, x value."""
    e = table(spark, sf_dir, "events")
    return e.select(F.col("user_id").cast("long").alias("i"), (F.dayofmonth("ts") - 1).cast("long").alias("j"), F.col("event_type").alias("ch"), F.col("value").alias("x"))


def event_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sparse: the mean value of each cell, to six digits."""
    return event_cells(spark, sf_dir).groupBy("i", "j").agg(F.round(F.avg("x"), 6).alias("v"))


def channel_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return event_cells(spark, sf_dir).groupBy("ch", "i", "j").agg(F.round(F.avg("x"), 6).alias("v"))


def height_of(spark: SparkSession, sf_dir: str) -> int:
    """Rows of the event grid."""
    return int(table(spark, sf_dir, "events").agg(F.coalesce(F.max("user_id"), F.lit(0))).first()[0]) + 1


def dense_grid(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, tuple[int, int]]:
    """The event grid with every cell, and its shape."""
    h = height_of(spark, sf_dir)
    return dense(event_grid(spark, sf_dir), 0, h, 0, DAYS), (h, DAYS)


EVENTS = "ev AS (SELECT CAST(user_id AS BIGINT) AS i, CAST(extract('day' FROM ts) AS BIGINT) - 1 AS j, event_type AS ch, value AS x FROM events)"
GRID = f"{EVENTS}, grid AS (SELECT i, j, round(avg(x), 6) AS v FROM ev GROUP BY i, j)"
CHANNELS = f"{EVENTS}, cg AS (SELECT ch, i, j, round(avg(x), 6) AS v FROM ev GROUP BY ch, i, j)"
DENSE = (
    f"{GRID}, size AS (SELECT max(user_id) + 1 AS h, {DAYS} AS w FROM events), "
    f"rows_ AS (SELECT unnest(range(0, (SELECT h FROM size))) AS i), cols_ AS (SELECT unnest(range(0, {DAYS})) AS j), "
    "dense AS (SELECT r.i, c.j, coalesce(g.v, 0e0) AS v FROM rows_ r CROSS JOIN cols_ c LEFT JOIN grid g ON g.i = r.i AND g.j = c.j)"
)
