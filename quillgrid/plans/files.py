"""Queries of sources and sinks: a procedural field, tiles written as files and read again, nested documents."""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from ..operators import nested
from ..operators.shared import Shared
from ..sources import files, procedural, sinks
from .regions import PATCH, PICTURE, coarse_picture
from .tables import DAYS, DENSE, GRID, dense_grid, height_of, table


def noise_field(spark, d):
    """The procedural source over the rows that the table has: bounds on both axes reach the reader."""
    procedural.register(spark)
    field = spark.read.format("noise_field").option("seed", 42).option("tile", 32).load()
    inside = (F.col("i") >= 0) & (F.col("i") < height_of(spark, d)) & (F.col("j") >= 0) & (F.col("j") < DAYS)
    return field.where(inside).select("i", "j", (F.round("v", 5) + 0.0).alias("v"))


NOISE_FIELD = (
    PATCH.replace(GRID, DENSE).replace("i - 20", "i").replace("j - 5", "j").replace("FROM grid), t AS", "FROM dense), t AS").replace("FROM grid),\nt AS", "FROM dense),\nt AS")
    .replace("CAST(ch AS INT) AS ch, ", "").replace("(VALUES (0), (1)) h(ch)", "(VALUES (0)) h(ch)")
)


def raw_files(spark, d):
    """Raw tiles written as files and read again: length and hash of the bytes."""
    shared, (g, _) = Shared(spark), dense_grid(spark, d)
    tiles = sinks.raw_tiles(g.select("i", "j", (F.col("v") - 60).alias("elev"), (F.col("v") / 7).alias("temp")), 32)
    files.write_tiles(tiles, f"{shared.path}/raw", ".raw")
    return files.read_tiles(spark, f"{shared.path}/raw", ".raw").select("ty", "tx", F.length("data").alias("n_bytes"), F.md5("data").alias("md5"))


_TILES = "t AS (SELECT DISTINCT CAST(floor(i / 32e0) AS BIGINT) AS ty, CAST(floor(j / 32e0) AS BIGINT) AS tx FROM {source}), c AS (SELECT ty, tx, r, k FROM t CROSS JOIN (SELECT unnest(range(0, 32)) AS r) CROSS JOIN (SELECT unnest(range(0, 32)) AS k))"
RAW_FILES = f"""WITH {DENSE}, {_TILES.format(source='dense')},
e AS (SELECT ty, tx, r, k, CAST(coalesce(floor(v - 60), 0) AS BIGINT) AS e, CAST(coalesce(v / 7, 0) AS FLOAT)::DOUBLE AS f FROM c LEFT JOIN dense ON i = ty * 32 + r AND j = tx * 32 + k),
x AS (SELECT *, CASE WHEN f = 0 THEN 0 ELSE CAST(floor(log2(abs(f)) + 1e-12) AS BIGINT) END AS p FROM e),
b AS (SELECT ty, tx, r, k, e, CASE WHEN f = 0 THEN 0 ELSE (CASE WHEN f < 0 THEN 2147483648 ELSE 0 END) + (p + 127) * 8388608 + CAST((abs(f) / pow(2, p) - 1) * 8388608 AS BIGINT) END AS w FROM x)
SELECT ty, tx, CAST(6144 AS INT) AS n_bytes, md5(unhex(string_agg(printf('%02X%02X', e & 255, (e >> 8) & 255), '' ORDER BY r, k)
  || string_agg(printf('%02X%02X%02X%02X', w & 255, (w >> 8) & 255, (w >> 16) & 255, (w >> 24) & 255), '' ORDER BY r, k))) AS md5 FROM b GROUP BY ty, tx"""


def _pixels(data: pd.Series) -> pd.Series:
    """The bytes of a picture's pixels, line by line, from its one compressed chunk."""
    def decode(png: bytes) -> bytes:
        width, at = int.from_bytes(png[16:20], "big"), png.index(b"IDAT")
        lines = np.frombuffer(zlib.decompress(png[at + 4 : at + 4 + int.from_bytes(png[at - 4 : at], "big")]), np.uint8).reshape(-1, 3 * width + 1)
        return lines[:, 1:].tobytes()

    return data.map(decode)


def picture_files(spark, d):
    """A coloured channel drawn in tiles, written as pictures and read again: a hash of the decoded pixels."""
    shared = Shared(spark)
    shown = coarse_picture(spark, d).select("i", "j", *[(F.col(c) / 255.0).alias(c) for c in "rgb"])
    files.write_tiles(sinks.png_tiles(shown, 32), f"{shared.path}/pictures", ".png")
    pixels = F.pandas_udf(_pixels, "binary")
    return files.read_tiles(spark, f"{shared.path}/pictures", ".png").select("ty", "tx", F.md5(pixels("data")).alias("md5"))


PICTURE_FILES = (
    f"WITH p AS ({PICTURE}), {_TILES.format(source='p')} SELECT ty, tx, md5(unhex(string_agg(printf('%02X%02X%02X', coalesce(r_, 0), coalesce(g, 0), coalesce(b, 0)), '' ORDER BY r, k))) AS md5 "
    "FROM c LEFT JOIN (SELECT i, j, r AS r_, g, b FROM p) ON i = ty * 32 + r AND j = tx * 32 + k GROUP BY ty, tx"
)


def nested_leaves(spark, d):
    """Each event as a nested document, taken apart to its values; one in fifty is no JSON."""
    e, text = table(spark, d, "events"), lambda c: F.col(c).cast("string")
    doc = F.concat(
        F.lit('{"type":"'), "event_type", F.lit('","user":{"id":'), text("user_id"), F.lit(',"props":'), "props", F.lit('},"tags":['), (F.col("event_id") % 3).cast("string"), F.lit(',{"odd":'),
        F.when(F.col("event_id") % 2 == 1, "true").otherwise("false"), F.lit("},[]],\"none\":null}"),
    )
    out = nested.leaves(e.select("event_id", F.when(F.col("event_id") % 50 == 0, F.concat(F.lit("x"), doc)).otherwise(doc).alias("doc")), "event_id", "doc", Shared(spark))
    return out.select(F.col("id").alias("event_id"), "path", "value")


NESTED_LEAVES = """WITH d AS (SELECT event_id, '{"type":"' || event_type || '","user":{"id":' || user_id || ',"props":' || props || '},"tags":[' || event_id % 3 || ',{"odd":' || CASE WHEN event_id % 2 = 1 THEN 'true' ELSE 'false' END || '},[]],"none":null}' AS doc
  FROM events WHERE event_id % 50 <> 0)
SELECT event_id, fullkey AS path, CAST(value AS VARCHAR) AS value FROM d, json_tree(doc) WHERE type NOT IN ('OBJECT', 'ARRAY') OR CAST(value AS VARCHAR) IN ('{}', '[]')"""

QUERIES = {"noise_field": (noise_field, NOISE_FIELD), "raw_files": (raw_files, RAW_FILES), "picture_files": (picture_files, PICTURE_FILES), "nested_leaves": (nested_leaves, NESTED_LEAVES)}
