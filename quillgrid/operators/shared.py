"""Tables on the way, in a folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


class Shared:
    """A folder of its own under ``path``, else under the session's ``spark.checkpoint.dir`` (a fresh local one only where none is set and
    there is no cluster).  :meth:`release` deletes it."""

    def __init__(self, spark: SparkSession, path: str | None = None) -> None:
        root = path or spark.conf.get("spark.checkpoint.dir", None)
        if not root:
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
            root = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        self.spark, self.path, self._held = spark, f"{root.rstrip('/')}/grid-{uuid.uuid4().hex}", 0

    def held(self, df: DataFrame) -> DataFrame:
        """``df`` written and read back: its lineage is cut, and a lost executor loses nothing of it."""
        where = f"{self.path}/on-the-way-{self._held}"
        df.write.parquet(where)
        self._held += 1
        return self.spark.read.schema(df.schema).parquet(where)

    def delete(self, where: str) -> None:
        found = self.spark._jvm.org.apache.hadoop.fs.Path(where)
        found.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(found, True)

    def release(self) -> None:
        self.delete(self.path)
        self._held = 0
