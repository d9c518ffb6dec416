"""A procedural source: cells of an unbounded field, which must be read with bounds on both axes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceReader, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual
from pyspark.sql.types import StructType


#: Cells of an Arrow batch, about.
BATCH = 1 << 16


class _Block(InputPartition):
    def __init__(self, i0: int, i1: int, j0: int, j1: int) -> None:
        self.i0, self.i1, self.j0, self.j1 = i0, i1, j0, j1


class _Reader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.seed, self.tile = int(options.get("seed", 42)), int(options.get("tile", 64))
        self.low: dict[str, int] = {}
        self.high: dict[str, int] = {}  # exclusive

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Bounds on i and j are taken; all else is left to Spark."""
        for f in filters:
            name = f.attribute[0] if getattr(f, "attribute", None) else None
            if name in ("i", "j") and isinstance(f, (GreaterThan, GreaterThanOrEqual)):
                self.low[name] = max(self.low.get(name, -(1 << 62)), int(f.value) + isinstance(f, GreaterThan))
            elif name in ("i", "j") and isinstance(f, (LessThan, LessThanOrEqual)):
                self.high[name] = min(self.high.get(name, 1 << 62), int(f.value) + isinstance(f, LessThanOrEqual))
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        if {*self.low} != {"i", "j"} or {*self.high} != {"i", "j"}:
            raise ValueError("the field has no end: filter i and j from both sides")
        t = self.tile
        (i0, i1), (j0, j1) = ((self.low[a], self.high[a]) for a in "ij")
        return [
            _Block(max(i0, a * t), min(i1, a * t + t), max(j0, b * t), min(j1, b * t + t))
            for a in range(i0 // t, -(-i1 // t)) for b in range(j0 // t, -(-j1 // t))
        ]

    def read(self, block: _Block) -> Iterator[pa.RecordBatch]:
        from ..functions.rng import patch

        t, width = self.tile, block.j1 - block.j0
        made = patch(self.seed, block.i0, block.j0, block.i1 - block.i0, width, 1, (t, t))[0]
        lines = max(1, BATCH // width)
        for at in range(0, len(made), lines):
            part = made[at : at + lines]
            i = np.repeat(np.arange(block.i0 + at, block.i0 + at + len(part)), width)
            yield pa.record_batch({"i": i, "j": np.tile(np.arange(block.j0, block.j1), len(part)), "v": part.ravel()})


class NoiseField(DataSource):
    """``spark.read.format("noise_field").option("seed", 42).load().where(<bounds>)``; one partition a tile, read in Arrow batches."""

    @classmethod
    def name(cls) -> str:
        return "noise_field"

    def schema(self) -> str:
        return "i long, j long, v double"

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(self.options)


def register(spark) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(NoiseField)
