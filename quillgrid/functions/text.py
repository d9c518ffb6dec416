"""Small text functions of the query interface."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def human_bytes(n: Column) -> Column:
    """A byte count in B, KiB, MiB or GiB."""
    k = n / F.lit(1024.0)
    return (
        F.when(n < 1024, F.concat(n.cast("string"), F.lit(" B")))
        .when(k < 1024, F.format_string("%.1f KiB", k))
        .when(k / 1024 < 1024, F.format_string("%.1f MiB", k / 1024))
        .otherwise(F.format_string("%.2f GiB", k / 1024 / 1024))
    )


def query_map(raw: Column) -> Column:
    """A query string as a map; a name without a value is empty, a repeated name keeps the last."""
    pairs = F.filter(F.split(F.coalesce(raw, F.lit("")), "&"), lambda p: p != "")
    entries = F.transform(pairs, lambda p: F.struct(F.substring_index(p, "=", 1).alias("k"), F.when(p.contains("="), F.regexp_replace(p, "^[^=]*=", "")).otherwise("").alias("v")))
    last = F.filter(entries, lambda e, i: ~F.exists(F.slice(entries, i + 2, F.size(entries)), lambda x: x["k"] == e["k"]))
    return F.map_from_entries(last)


def int_or(value: Column, default: int) -> Column:
    """A whole number of 32 bits, or the default."""
    return F.coalesce(F.when(value.rlike("^[+-]?[0-9]+$"), value).try_cast("int"), F.lit(default))


def seed_of(body: Column) -> Column:
    """The seed that a JSON body names: a number read as a double, so beyond 2^53 not every one is met; null where none is named."""
    read = F.try_variant_get(F.try_parse_json(body), "$.seed", "double")
    most = float(1 << 63)
    return F.when(read >= most, F.lit((1 << 63) - 1)).when(read <= -most, F.lit(-(1 << 63))).when(F.isnan(read), F.lit(0)).otherwise(read.cast("long"))


def unsigned(n: Column) -> Column:
    """A long as a decimal number without sign."""
    wide = n.cast("decimal(20,0)")
    return F.when(n < 0, wide + F.lit(str(1 << 64)).cast("decimal(20,0)")).otherwise(wide).cast("string")
