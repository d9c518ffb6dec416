"""Corpus pipeline: from raw documents to packed token windows.

Language identification drops what it rejects, near duplicates are reduced to one document of
each group, secrets are masked, sources are mixed to their target weights, and the mix is packed.
Each stage is written as Parquet in the shared folder and read again as the next one's input.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgrid.llm import langid, mixing, packing, secrets, simhash
from quillgrid.llm.common import SAVED, forget, save, table


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised; texts that are null, have no letter or are unlike any language go."""
    model = langid.train(langid.sample(docs))
    return langid.recognised(docs, model)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash component."""
    return simhash.keep_one(docs)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their secrets masked."""
    masked = secrets.redact(docs)
    return masked.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    mixed = mixing.realise(docs)
    return mixed.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents and their places in token windows."""
    return packing.pack(docs)


STAGES = [
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("secret_scan", secret_scan),
    ("mix_sources", mix_sources),
    ("pack", pack),
]
#: Neither the trained stages nor the tokeniser can be put in SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of the packed mix of ``documents``, as :func:`pack` returns them.

    Null ids, texts, languages and sources, repeated rows and further columns pass through the stages as their
    operators say; an empty table gives an empty result.  Once a stage is written, what it read and wrote on its way is deleted.
    """
    docs, known = table(spark, sf_dir, "documents"), set(SAVED)
    for _, stage in STAGES:
        docs, path = save(stage(spark, docs, sf_dir))
        for old in [p for p in SAVED if p not in known and p != path]:
            forget(spark, old)
    return docs
