"""JSON documents of unknown shape as rows of paths and values."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import Shared


def leaves(documents: DataFrame, id_col: str, text_col: str, shared: Shared, deepest: int = 1000) -> DataFrame:
    """(id, path, kind, value): every value of each document that holds no other, with its place, as ``$.a[0].b``.

    ``value`` is JSON text, ``kind`` the type.  Objects and arrays without members are values.  A text that is null or no JSON
    has no rows; what follows a whole value is not looked at.  Members of a level are taken apart together, and the next level is what still holds members: as many passes
    as the deepest document has levels, each over what is left.
    """
    spark = documents.sparkSession
    now = documents.select(F.col(id_col).alias("id"), F.lit("$").alias("path"), F.try_parse_json(text_col).alias("v")).where("v IS NOT NULL")
    done = None
    for _ in range(deepest):
        kind = F.schema_of_variant("v")
        typed = shared.held(now.select("id", "path", F.to_json("v").alias("value"), kind.alias("kind")))
        holds = F.col("kind").startswith("OBJECT<") & (F.col("value") != "{}") | F.col("kind").startswith("ARRAY<") & (F.col("value") != "[]")
        ends = typed.where(~holds).select("id", "path", F.regexp_extract("kind", "^[A-Z]+", 0).alias("kind"), "value")
        done = ends if done is None else done.unionByName(ends)
        rest = typed.where(holds).select("id", "path", "kind", F.parse_json("value").alias("v"))
        if rest.isEmpty():
            return done
        rest.createOrReplaceTempView("_nested_rest")
        members = spark.sql("SELECT r.id, r.path, r.kind, m.pos, m.key, m.value AS v FROM _nested_rest r, LATERAL variant_explode(r.v) m")
        step = F.when(F.col("kind").startswith("ARRAY"), F.concat(F.lit("["), F.col("pos").cast("string"), F.lit("]"))).otherwise(F.concat(F.lit("."), "key"))
        now = members.select("id", F.concat("path", step).alias("path"), "v")
    raise ValueError(f"documents are nested deeper than {deepest}")
