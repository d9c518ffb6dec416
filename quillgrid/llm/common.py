"""Helpers that several training-data operators share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the word definitions (space and the five ASCII controls), as a Java/RE2 class.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Tables that :func:`save` wrote in this process and nobody has deleted.
SAVED: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The shared folder that the cluster names; a fresh local one only where none is set and there is no cluster (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def save(df: DataFrame, partition_by: Sequence[str] = ()) -> tuple[DataFrame, str]:
    """Write ``df`` as Parquet in the shared folder and read it back: the lineage is cut and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/quillgrid-{uuid.uuid4().hex}"
    df.write.partitionBy(*partition_by).parquet(path)
    SAVED.append(path)
    return spark.read.schema(df.schema).parquet(path), path


def as_text(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, text) for a function on pandas frames, the id as text: pandas makes whole numbers beside nulls floats, which round large ones."""
    return docs.select(F.col(id_col).cast("long").cast("string").alias("doc_id"), F.col(text_col).alias("text"))


def whole_ids(df: DataFrame) -> DataFrame:
    """The id as a whole number again."""
    return df.withColumn("doc_id", F.col("doc_id").cast("long"))


def forget(spark: SparkSession, path: str) -> None:
    """Delete a table that :func:`save` wrote, when nothing reads it any more."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
    if path in SAVED:
        SAVED.remove(path)


def hash_sample(df: DataFrame, n: int, salt: str, by: str, total: int | None = None) -> DataFrame:
    """About ``n`` rows drawn by a hash of a column, so that reruns agree; rows travel only once they are drawn.

    (A top-n would send n rows of every task; here all tasks together send about n.)
    """
    total = df.count() if total is None else total
    most = 1 << 30
    return df.where(F.pmod(F.xxhash64(F.lit(salt), by), F.lit(most)) < F.lit(int(min(1.0, n / max(1, total)) * most)))


def unused(df: DataFrame, name: str) -> str:
    """A column name that ``df`` has not yet, whatever its letter case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def shuffle_parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """Connected components of an undirected edge list, as (id, component), the component being its smallest id.

    Large-star and small-star alternate: every round halves paths, and each star is handled by a
    minimum per node and an equi-join, so a hub's neighbours are never gathered into one row and
    adaptive execution can split a hub's side of the join.  Self-loops and null ends are ignored;
    nodes without edges do not appear.
    """
    spark = edges.sparkSession
    now, path = save(
        edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
        .where(F.col(a).isNotNull() & F.col(b).isNotNull())
        .where("u <> v")
        .distinct()
    )
    sign = None
    for _ in range(max_rounds):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(low, "u")
            .where("v <> m")
            .select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionByName(low.select("u", F.col("m").alias("v")))
            .where("u <> v")
            .distinct()
        )
        after, new_path = save(small)
        forget(spark, path)
        now, path = after, new_path
        seen = tuple(
            now.agg(
                F.count("*"),
                F.sum(F.hash("u", "v").cast("long")),
                F.sum(F.xxhash64("v", "u").bitwiseAND(F.lit((1 << 40) - 1))),
                F.count_if(F.col("u") < F.col("v")),
            ).first()
        )
        if seen == sign:
            break
        sign = seen
    else:
        raise RuntimeError("components did not converge")
    leaves = now.select(F.col("u").alias("id"), F.col("v").alias("component"))
    return leaves.unionByName(now.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())
