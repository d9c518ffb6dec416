"""Queries of the training-data operators, by name, and their DuckDB SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import alignment, ann, conversations, embed_dedup, langid, licenses, mixing, packing, pii, secrets, simhash, substrings, voronoi


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_ann": ann.op1,
        "op2_pii": pii.op2,
        "op3_mixing": mixing.op3,
        "op4_simhash": simhash.op4,
        "op5_licenses": licenses.op5,
        "op6_embed_dedup": embed_dedup.op6,
        "op7_secrets": secrets.op7,
        "op8_substrings": substrings.op8,
        "op9_langid": langid.op9,
        "op10_packing": packing.op10,
        "op11_alignment": alignment.op11,
        "op12_conversations": conversations.op12,
        "op13_voronoi": voronoi.op13,
    }


def oracle_sql() -> dict[str, str]:
    return {"op3_mixing": mixing.OP3_SQL, "op12_conversations": conversations.OP12_SQL, "op13_voronoi": voronoi.OP13_SQL}
