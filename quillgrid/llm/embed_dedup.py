"""Embedding near-duplicates by p-stable hashing.

Normalised vectors are projected on random directions and quantised; a table's bucket is the
tuple of its quantised projections.  Vectors that share a bucket in any table are compared by
exact cosine.  A pair counts in the first table where it meets, so links are counted without ever
writing pairs; for components each bucket gives a spanning forest of its links.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, save, shuffle_parts, table
from .vectors import matrix, usable

COSINE = 0.93
#: Width of the quantisation cells for vectors of norm 1.
CELL = 2.0
#: Chance to meet that pairs just at the threshold shall have, and the unrelated rows wanted in a row's bucket at most.
RECALL, STRANGERS = 0.98, 1.0
#: Rows of a bucket that are compared at a time; a larger bucket is compared block by block.
BLOCK = 1024
#: Pairs of indices that are kept until they are reduced to a spanning forest.
FOREST = 1 << 20
_PROJECTIONS: dict[tuple, tuple] = {}


def collision(distance: float, cell: float = CELL) -> float:
    """Chance that one quantised projection of two points at this distance agrees."""
    c = distance / cell
    if c == 0:
        return 1.0
    return math.erf(1 / c / math.sqrt(2)) - 2 * c / math.sqrt(2 * math.pi) * (1 - math.exp(-1 / (2 * c * c)))


def shape(rows: int, cosine: float = COSINE) -> tuple[int, int]:
    """(projections a table, tables) for so many rows in the largest label: both follow from the two chances above."""
    near, far = collision(math.sqrt(2 - 2 * cosine)), collision(math.sqrt(2))
    m = max(4, math.ceil(math.log(max(2.0, rows / STRANGERS)) / -math.log(far)))
    return m, max(1, math.ceil(math.log(1 - RECALL) / math.log(1 - near**m)))


def projections(length: int, n: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Directions and shifts for vectors of a length: made where they are used, so no table of lengths is needed."""
    key = (length, n, seed)
    if key not in _PROJECTIONS:
        rng = np.random.default_rng([seed, length])
        _PROJECTIONS[key] = rng.normal(size=(length, n)), rng.uniform(0, CELL, n)
    return _PROJECTIONS[key]


def near_links(classes: DataFrame, cosine: float, seed: int) -> DataFrame:
    """Rows (rep, links, root) of classes (rep, label, weight, v): ``links`` add up to a class's links, (rep, root) span the components.

    ``label`` names what is compared: vectors of one label have one length.
    """
    spark = classes.sparkSession
    largest = classes.groupBy("label").count().agg(F.max("count")).first()[0] or 1
    m, tables = shape(largest, cosine)
    mix = np.random.default_rng(seed).integers(1, 1 << 62, m * tables, dtype=np.int64) | 1
    sent = spark.sparkContext.broadcast(mix)

    def sign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        f = sent.value
        for b in (part for whole in batches for _, part in whole.groupby(whole["v"].map(len))):
            d, s = projections(len(b["v"].iloc[0]), m * tables, seed)
            x = matrix(b["v"])
            x /= np.linalg.norm(x, axis=1, keepdims=True)
            cells = np.floor((x @ d + s) / CELL).astype(np.int64)
            with np.errstate(over="ignore"):
                keys = (cells * f).reshape(len(x), tables, m).sum(2)
                keys ^= keys >> 29
                keys *= np.int64(0x5851F42D4C957F2D)
                keys ^= keys >> 32
            yield pd.DataFrame({"rep": b["rep"], "label": b["label"], "weight": b["weight"], "v": list(x), "keys": list(keys)})

    signed, _ = save(classes.mapInPandas(sign, "rep long, label long, weight long, v array<double>, keys array<long>"))
    met = signed.select("rep", "label", F.posexplode("keys").alias("t", "key"))
    # Only buckets with company are of use; crowded ones are dealt in pairs of blocks.
    company = met.groupBy("t", "label", "key").count().where("count > 1").withColumn("blocks", F.ceil(F.col("count") / BLOCK).cast("int")).drop("count")
    met = met.join(company, ["t", "label", "key"])
    met = met.withColumn("own", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    met = met.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    met = met.select(
        "rep", "t", F.xxhash64("t", "label", "key", F.least("own", "other"), F.greatest("own", "other")).alias("bucket"),
        ((F.col("own") > F.col("other")).cast("int")).alias("side"), (F.col("own") != F.col("other")).alias("two"),
    )
    met = met.join(signed.select("rep", "label", "weight", "v", "keys"), "rep")
    met = met.repartition(shuffle_parts(spark), "bucket").sortWithinPartitions("bucket")

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest = None
        for b in _and_last(batches):
            if b is not None:
                rest = b if rest is None else pd.concat([rest, b], ignore_index=True)
                whole = int(np.searchsorted(rest["bucket"].to_numpy(), rest["bucket"].iloc[-1])) if len(rest) else 0
                if not whole:
                    continue
                part, rest = rest.iloc[:whole], rest.iloc[whole:].reset_index(drop=True)
            elif rest is None or not len(rest):
                return
            else:
                part = rest
            # A bucket's vectors have one length.
            for _, same in part.groupby(part["v"].map(len)):
                yield from links_of(same)

    def links_of(p: pd.DataFrame) -> Iterator[pd.DataFrame]:
        bucket, rep, t = p["bucket"].to_numpy(np.int64), p["rep"].to_numpy(np.int64), p["t"].to_numpy(np.int64)
        label, side, two = p["label"].to_numpy(np.int64), p["side"].to_numpy(np.int64), p["two"].to_numpy(bool)
        weight, x, keys = p["weight"].to_numpy(np.int64), matrix(p["v"]), np.stack(p["keys"].to_numpy())
        links, ends = np.zeros(len(p), np.int64), []
        at = np.arange(len(p))
        for shift in range(1, len(p)):
            at = at[at + shift < len(p)]
            at = at[bucket[at + shift] == bucket[at]]
            if not len(at):
                break
            for lo in range(0, len(at), 1 << 15):
                i = at[lo : lo + (1 << 15)]
                j = i + shift
                ok = (label[i] == label[j]) & (t[i] == t[j]) & (~two[i] | (side[i] != side[j])) & (rep[i] != rep[j])
                i, j = i[ok], j[ok]
                ok = np.einsum("ij,ij->i", x[i], x[j]) >= cosine
                i, j = i[ok], j[ok]
                if not len(i):
                    continue
                earlier = (keys[i] == keys[j]) & (np.arange(tables)[None, :] < t[i][:, None])
                new = ~earlier.any(1)
                np.add.at(links, i[new], weight[j[new]])
                np.add.at(links, j[new], weight[i[new]])
                ends.append(np.stack([i, j]))
                if sum(e.shape[1] for e in ends) > FOREST:
                    ends = [spanning(len(p), np.concatenate(ends, axis=1))]
        root = np.arange(len(p))
        if ends:
            i, j = spanning(len(p), np.concatenate(ends, axis=1))
            root[i] = j
        say = (links > 0) | (root != np.arange(len(p)))
        if say.any():
            yield pd.DataFrame({"rep": rep[say], "links": links[say], "root": rep[root[say]]})

    return met.mapInPandas(compare, "rep long, links long, root long")


def spanning(n: int, ends: np.ndarray) -> np.ndarray:
    """Pairs (member, smallest member of its component) that connect what the pairs ``ends`` of 0 to n - 1 connect."""
    root = np.arange(n)
    i, j = ends
    while True:
        low = np.minimum(root[i], root[j])
        before = root.copy()
        np.minimum.at(root, i, low)
        np.minimum.at(root, j, low)
        np.minimum.at(root, before[i], low)
        np.minimum.at(root, before[j], low)
        while (root[root] != root).any():
            root = root[root]
        if (root == before).all():
            member = np.flatnonzero(root != np.arange(n))
            return np.stack([member, root[member]])


def _and_last(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame | None]:
    for b in batches:
        if len(b):
            yield b
    yield None


def embed_dedup(
    vectors: DataFrame, cosine: float = COSINE, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", seed: int = 6
) -> DataFrame:
    """One row per row of ``vectors``: vec_id, n_links, component_id, kept.

    Only rows of one label and vectors of one length are compared.  Rows with a null id or label, or a
    vector that is null, zero or holds null or non-finite components, link with nothing: n_links 0 and a component of their own (null id: null component, not kept).  Equal vectors of
    a label are one class before hashing; each row of it counts as a vector.  Ties do not matter;
    an empty table gives an empty result; other columns are ignored.
    """
    rows = vectors.select(
        F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"), F.col(label_col).cast("long").alias("label")
    )
    joins = usable("v") & F.col("vec_id").isNotNull() & F.col("label").isNotNull()
    rows = rows.withColumn("h1", F.when(joins, F.xxhash64(F.lit(1), "v"))).withColumn("h2", F.when(joins, F.xxhash64(F.lit(2), "v")))
    rows, _ = save(rows)
    cls = ["label", "h1", "h2"]
    classes, _ = save(rows.where("h1 is not null").groupBy(*cls).agg(F.min("vec_id").alias("rep"), F.count("*").alias("weight"), F.first("v").alias("v")))
    # A class is named by its smallest id; rows that share an id but not a vector are told apart by the class's own number below.
    named = classes.withColumn("rep_key", F.xxhash64("rep", "label", "h1", "h2"))
    found, _ = save(near_links(named.select(F.col("rep_key").alias("rep"), F.xxhash64("label", F.size("v")).alias("label"), "weight", "v"), cosine, seed))
    counts = found.groupBy("rep").agg(F.sum("links").alias("links"))
    comp = components(found.select(F.col("rep").alias("a"), F.col("root").alias("b")))
    named = named.join(comp, named["rep_key"] == comp["id"], "left").withColumn("component", F.coalesce("component", "rep_key"))
    lowest = named.groupBy("component").agg(F.min("rep").alias("component_id"))
    named = named.join(lowest, "component").join(counts.withColumnRenamed("rep", "rep_key"), "rep_key", "left")
    per_class = named.select(*cls, "component_id", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"))
    out = rows.select("vec_id", *cls).join(per_class, cls, "left")
    comp_id = F.coalesce("component_id", "vec_id")
    return out.select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), comp_id.alias("component_id"),
        F.coalesce(F.col("vec_id") == comp_id, F.lit(False)).alias("kept"),
    )


def op6(spark, sf_dir: str) -> DataFrame:
    """Near copies among all ``embeddings`` of a label: vec_id, n_links, component_id, kept."""
    return embed_dedup(table(spark, sf_dir, "embeddings"))
