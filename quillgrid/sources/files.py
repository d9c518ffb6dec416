"""Sink for binary tiles: a file for each row, all of them or none."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import Row, StructType


@dataclass
class _Written(WriterCommitMessage):
    files: list[tuple[str, str]]  # (where it was written, its name)


class _Writer(DataSourceWriter):
    """Tasks write into a folder of the job; committing moves the files of the attempts that counted, aborting leaves nothing."""

    def __init__(self, path: str, suffix: str) -> None:
        self.path, self.suffix, self.job = path.rstrip("/"), suffix, f"_new-{uuid.uuid4().hex}"

    def _open(self):
        from pyarrow import fs

        return fs.FileSystem.from_uri(self.path) if "://" in self.path or self.path.startswith("file:") else (fs.LocalFileSystem(), self.path)

    def write(self, rows: Iterator[Row]) -> WriterCommitMessage:
        store, root = self._open()
        own, files = f"{root}/{self.job}/{uuid.uuid4().hex}", []  # an attempt's own folder: a second attempt meets none of the first one's files
        store.create_dir(own, recursive=True)
        for r in rows:
            name = f"{r['ty']}_{r['tx']}{self.suffix}"
            with store.open_output_stream(f"{own}/{name}") as out:
                out.write(bytes(r["data"]))
            files.append((f"{own}/{name}", name))
        return _Written(files)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        store, root = self._open()
        files = [f for m in messages if m for f in m.files]
        names = [n for _, n in files]
        if len(set(names)) < len(names):
            self.abort(messages)
            raise ValueError("a tile came twice")
        for at, name in files:
            store.move(at, f"{root}/{name}")
        self._clear(store, root)

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        self._clear(*self._open())

    def _clear(self, store, root: str) -> None:
        from pyarrow import fs

        if store.get_file_info(f"{root}/{self.job}").type != fs.FileType.NotFound:
            store.delete_dir(f"{root}/{self.job}")


class TileFiles(DataSource):
    """``tiles.write.format("tile_files").option("path", ...).option("suffix", ".png").mode("append").save()`` for (ty, tx, data).

    The path is a folder that all executors see, local or a store that Arrow's file systems reach.
    """

    @classmethod
    def name(cls) -> str:
        return "tile_files"

    def schema(self) -> str:
        return "ty long, tx long, data binary"

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        missing = {"ty", "tx", "data"} - set(schema.fieldNames())
        if missing or overwrite:
            raise ValueError(f"tiles need {sorted(missing)}" if missing else "files are added, not replaced: write with mode append")
        return _Writer(self.options["path"], self.options.get("suffix", ""))


def write_tiles(tiles: DataFrame, path: str, suffix: str) -> None:
    """Write tiles (ty, tx, data) as files ``<ty>_<tx><suffix>``: all of them, or none where a task fails."""
    tiles.sparkSession.dataSource.register(TileFiles)
    tiles.select("ty", "tx", "data").write.format("tile_files").option("path", path).option("suffix", suffix).mode("append").save()


def read_tiles(spark, path: str, suffix: str) -> DataFrame:
    """The files of a folder as tiles again."""
    from pyspark.sql import functions as F

    found = spark.read.format("binaryFile").option("pathGlobFilter", f"*{suffix}").load(path)
    at = F.regexp_extract("path", r"(-?\d+)_(-?\d+)[^/]*$", 1), F.regexp_extract("path", r"(-?\d+)_(-?\d+)[^/]*$", 2)
    return found.select(at[0].cast("long").alias("ty"), at[1].cast("long").alias("tx"), F.col("content").alias("data"))
