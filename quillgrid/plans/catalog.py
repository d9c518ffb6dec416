"""All queries of the grid engine by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import assembly, fields, files, grids, region_sql, regions, values, worlds

_ALL = grids.QUERIES | values.QUERIES | fields.QUERIES | regions.QUERIES | assembly.QUERIES | worlds.QUERIES | files.QUERIES


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: fn for name, (fn, _) in _ALL.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in _ALL.items() if sql} | regions.SQL | region_sql.SQL
