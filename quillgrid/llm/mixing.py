"""Mixing sources to target weights by capped water-filling.

Weights are clamped where a source would pass its maximum epochs; the excess goes to the other
sources in proportion to their weights until no source is above its cap.  The mix then takes
every document a whole number of times and a seeded selection of documents once more.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, save, table, unused

#: Bits of the seeded 32-bit order in the first and in the second histogram.
LEVEL_BITS = 10
#: Sources, and bytes of their names together, up to which the rules of the sources are broadcast; more are joined by source and salt.
BROADCAST_SOURCES, BROADCAST_BYTES, SALTS = 100_000, 16 << 20, 32
#: Repeated rows that one array numbers.
STEP = 10_000


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def water_fill(sources: DataFrame, max_epochs: float) -> DataFrame:
    """Add ``target`` to one row a source (``source``, ``weight``, ``source_size``).

    Sources in order of cap over weight fill up first, so the capped ones are a prefix: the level
    at the first source that stays below its cap is final.  One row per source is small by nature.
    """
    order = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    onward = order.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy(F.lit(1))
    capped = (
        sources.withColumn("cap", F.col("source_size") * F.lit(float(max_epochs)))
        .withColumn("total", F.sum("source_size").over(everything).cast("double"))
        .withColumn("gone", F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
        .withColumn("rest", F.sum("weight").over(onward))
        .withColumn("level_here", (F.col("total") - F.col("gone")) / F.col("rest"))
        .withColumn("free", F.col("cap") > F.col("level_here") * F.col("weight"))
        .withColumn("place", F.row_number().over(order))
        .withColumn("first_free", F.min(F.when(F.col("free"), F.col("place"))).over(everything))
        .withColumn("level", F.max(F.when(F.col("place") == F.col("first_free"), F.col("level_here"))).over(everything))
    )
    target = F.when(F.col("place") >= F.col("first_free"), F.col("weight") * F.col("level")).otherwise(F.col("cap"))
    return capped.select("source", "weight", "source_size", F.coalesce(target, F.lit(0.0)).alias("target"))


def _order(seed: str, id_col: str) -> Column:
    """A document's place in the seeded order: 32 bits."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit("")))), 1, 8), 16, 10).cast("long")


def _with_rules(rows: DataFrame, rules: DataFrame, source: str, order: str, small: bool, how: str = "left") -> DataFrame:
    """Rows with their source's columns of ``rules``.  Few sources are broadcast; many are joined with a salt, so a hot source is many tasks."""
    if small:
        return rows.join(F.broadcast(rules), rows[source].eqNullSafe(rules["r_source"]), how)
    salt = unused(rows, "salt")
    salted = rules.withColumn("r_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    rows = rows.withColumn(salt, F.pmod(F.hash(order), F.lit(SALTS)))
    return rows.join(salted, rows[source].eqNullSafe(salted["r_source"]) & (rows[salt] == salted["r_salt"]), how).drop(salt, "r_salt")


def rules_of(sized: DataFrame, weights: tuple[float, ...], max_epochs: float) -> tuple[DataFrame, bool]:
    """One row a source: its target, whole repetitions, and the group of equal rows at which its remainder ends; and whether they are few.

    ``sized`` has doc_id, source, size and h.  The end is found by two histograms over the seeded
    order (2**LEVEL_BITS bins each); only the rows of one narrow bin a source are then grouped
    by (h, doc_id, size) and summed in order, so equal rows cost one.
    """
    shift1, shift2 = 32 - LEVEL_BITS, 32 - 2 * LEVEL_BITS
    sized = sized.withColumn("b1", F.shiftright("h", shift1)).withColumn("b2", F.shiftright("h", shift2))
    by_source = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    picks = F.array(*[F.lit(float(w)) for w in weights])
    weighted = by_source.withColumn("weight", F.element_at(picks, (rank % len(weights) + 1).cast("int")))
    goal, size = F.floor(F.col("target") + 0.5).cast("long"), F.col("source_size")
    whole = F.when(size > 0, F.floor(goal / size).cast("long")).otherwise(F.lit(0).cast("long"))
    plan = water_fill(weighted, max_epochs).withColumn("whole", whole).withColumn("rest", goal - F.col("whole") * size)
    plan, _ = save(plan.select("source", "source_size", "target", "whole", "rest").withColumnsRenamed({c: f"r_{c}" for c in ("source", "source_size", "target", "whole", "rest")}))
    known = plan.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length(F.col("r_source").cast("string"))), F.lit(0)).alias("bytes")).first()
    small = known["n"] <= BROADCAST_SOURCES and known["bytes"] <= BROADCAST_BYTES

    def ending(hist: DataFrame, order: list, before: str | None) -> DataFrame:
        """Of each source the row of ``hist`` (source, ..., words) in which its remainder ends, and the words before it."""
        run = Window.partitionBy("source").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
        sums = hist.withColumn("before", F.coalesce(F.sum("words").over(run), F.lit(0)) + (F.col(before) if before else F.lit(0)))
        return _with_rules(sums, plan.select("r_source", "r_rest"), "source", "words", small, "inner").where((F.col("before") <= F.col("r_rest")) & (F.col("r_rest") < F.col("before") + F.col("words")))

    end1 = ending(sized.groupBy("source", "b1").agg(F.sum("size").alias("words")), ["b1"], None).select("r_source", F.col("b1").alias("r_b1"), F.col("before").alias("r_before"))
    inside = _with_rules(sized, end1, "source", "h", small, "inner").where("b1 = r_b1")
    end2 = ending(inside.groupBy("source", "b2", "r_before").agg(F.sum("size").alias("words")), ["b2"], "r_before")
    end2 = end2.select("r_source", F.col("b2").alias("r_b2"), F.col("before").alias("r_before"))
    inside = _with_rules(sized, end2, "source", "h", small, "inner").where("b2 = r_b2")
    equal = inside.groupBy("source", "h", "doc_id", "size", "r_before").agg(F.count("*").alias("n"), F.sum("size").alias("words"))
    end3 = ending(equal, ["h", F.col("doc_id").asc_nulls_first(), "size"], "r_before")
    end3 = end3.select(F.col("r_source").alias("e_source"), *[F.col(c).alias(f"r_{c}") for c in ("h", "doc_id", "size", "n", "before")])
    rules, _ = save(plan.join(end3, plan["r_source"].eqNullSafe(end3["e_source"]), "left").drop("e_source"))
    return rules, small


def _decided(rows: DataFrame, rules: DataFrame, small: bool, doc_id: str, source: str, size: str, h: str) -> tuple[DataFrame, Column]:
    """Rows with r_whole and r_part, and a condition for the equal rows among which a remainder ends (they are to be numbered: r_part is null)."""
    rows = _with_rules(rows, rules, source, h, small)
    less = F.col(doc_id).isNull() & F.col("r_doc_id").isNotNull() | F.coalesce(F.col(doc_id) < F.col("r_doc_id"), F.lit(False))
    same = F.col(doc_id).eqNullSafe(F.col("r_doc_id"))
    first = (F.col(h) < F.col("r_h")) | (F.col(h) == F.col("r_h")) & (less | same & (F.col(size) < F.col("r_size")))
    at_end = F.coalesce((F.col(h) == F.col("r_h")) & same & (F.col(size) == F.col("r_size")), F.lit(False))
    part = F.when(at_end & (F.col("r_n") > 1), F.lit(None)).when(at_end, F.col("r_rest") - F.col("r_before")).when(F.coalesce(first, F.lit(False)), F.col(size)).otherwise(F.lit(0))
    return rows.withColumn("r_part", part.cast("long")), at_end & (F.col("r_n") > 1)


def _nth_part(nth: Column, size: str) -> Column:
    """The part of the nth of equal rows."""
    return F.greatest(F.lit(0), F.least(F.col(size), F.col("r_rest") - F.col("r_before") - (nth - 1) * F.col(size))).cast("long")


def _sized(docs: DataFrame, seed: str, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """The narrow table that all sums are taken from."""
    h = _order(seed, id_col)
    return save(docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"), h.alias("h")))[0]


def mix(
    docs: DataFrame,
    weights: tuple[float, ...] = (5.0, 2.0, 1.0),
    max_epochs: float = 3.0,
    seed: str = "mix-1",
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, taken, whole, part.

    ``weights`` repeat over the sources in code-point order, null last.  Each document is taken
    ``whole`` times plus ``part`` words: documents in a seeded order are repeated once more while
    the source's remainder lasts, and the document at its end is repeated in part, so a source's
    taken words equal its rounded target.  Documents stay where they are read: what decides is one
    row a source (see :func:`rules_of`).

    Null text: size 0.  Null source: a source of its own.  Rows with the same id, size and source
    are interchangeable.  An empty table gives an empty result; other columns are ignored.
    """
    sized = _sized(docs, seed, id_col, text_col, source_col)
    rules, small = rules_of(sized, weights, max_epochs)
    rows, at_end = _decided(sized, rules, small, "doc_id", "source", "size", "h")
    # The equal rows at an end are made anew from their number.
    ends = rules.where("r_n > 1").withColumn("r_k", F.explode(F.transform(F.sequence(F.lit(0).cast("long"), F.floor((F.col("r_n") - 1) / STEP)), lambda b: b * STEP)))
    ends = ends.withColumn("r_nth", F.explode(F.sequence(F.col("r_k") + 1, F.least(F.col("r_n"), F.col("r_k") + STEP))))
    ends = ends.withColumns({"doc_id": F.col("r_doc_id"), "source": F.col("r_source"), "size": F.col("r_size"), "r_part": _nth_part(F.col("r_nth"), "r_size")})
    names = ["doc_id", "source", "size", "r_source_size", "r_target", "r_whole", "r_part"]
    out = rows.where(~at_end).select(*names).unionByName(ends.select(*names))
    return out.select(
        "doc_id", "source", "size", F.col("r_source_size").alias("source_size"), F.col("r_target").alias("target"),
        (F.col("r_whole") * F.col("size") + F.col("r_part")).cast("long").alias("taken"), F.col("r_whole").alias("whole"), F.col("r_part").alias("part"),
    )


def realise(
    docs: DataFrame, weights: tuple[float, ...] = (5.0, 2.0, 1.0), max_epochs: float = 3.0, seed: str = "mix-1",
    id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
) -> DataFrame:
    """The mixed documents themselves: each row as often as the mix takes it, a part as its first words joined by spaces.

    Columns are those of ``docs``; its rows are not shuffled.  Only where a source's remainder ends
    among rows that agree in id, source and size are those rows numbered, in the order of their text.
    """
    columns = docs.columns
    rules, small = rules_of(_sized(docs, seed, id_col, text_col, source_col), weights, max_epochs)
    # Working columns get names that ``docs`` has not; its own are put in a struct meanwhile.
    own = F.struct(*[F.col(f"`{c}`") for c in columns]).alias("own")
    rows = docs.select(own, F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), F.col(text_col).alias("text"), word_count(F.col(text_col)).alias("size"), _order(seed, id_col).alias("h"))
    rows, at_end = _decided(rows, rules, small, "doc_id", "source", "size", "h")
    if rules.where("r_n > 1").head(1):
        nth = F.row_number().over(Window.partitionBy("source").orderBy("text"))
        rows = rows.where(~at_end).unionByName(rows.where(at_end).withColumn("r_part", _nth_part(nth, "size")))
    times = (F.col("r_whole") + (F.col("r_part") > 0).cast("long")).cast("int")
    rows = rows.where(times > 0).withColumn("copy", F.explode(F.sequence(F.lit(1), times)))
    cut = (F.col("copy") > F.col("r_whole")) & (F.col("r_part") < F.col("size"))
    first = F.array_join(F.slice(F.regexp_extract_all("text", F.lit(WORD), F.lit(0)), F.lit(1), F.col("r_part").cast("int")), " ")
    text = F.when(cut, first).otherwise(F.col("text"))
    return rows.select(*[text.alias(c) if c == text_col else F.col("own")[c].alias(c) for c in columns])


def op3(spark, sf_dir: str) -> DataFrame:
    """All ``documents`` mixed to the weights of their sources: doc_id, size, source_size, target, taken."""
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


OP3_SQL = r"""
WITH d AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         CAST('0x' || substr(md5('mix-1:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) AS h
  FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5e0 WHEN 1 THEN 2e0 ELSE 1e0 END AS weight,
             source_size * 3e0 AS cap FROM s),
r AS (SELECT *, row_number() OVER o AS place, CAST(sum(source_size) OVER () AS DOUBLE) AS total,
             coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0e0) AS gone,
             sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest
      FROM w WINDOW o AS (ORDER BY cap / weight, source NULLS LAST)),
f AS (SELECT *, (total - gone) / rest AS level_here FROM r),
x AS (SELECT min(place) AS first_free FROM f WHERE cap > level_here * weight),
lv AS (SELECT level_here AS level FROM f, x WHERE place = first_free),
t AS (SELECT source, source_size, coalesce(CASE WHEN place >= (SELECT first_free FROM x) THEN weight * (SELECT level FROM lv) ELSE cap END, 0e0) AS target FROM f),
g AS (SELECT *, CAST(floor(target + 5e-1) AS BIGINT) AS goal FROM t),
p AS (SELECT *, CASE WHEN source_size > 0 THEN goal // source_size ELSE 0 END AS whole FROM g),
c AS (SELECT d.doc_id, d.size, p.source_size, p.target, p.whole, p.goal - p.whole * p.source_size AS rest,
             coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.h, d.doc_id NULLS FIRST, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
      FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source)
SELECT doc_id, size, source_size, target, CAST(whole * size + greatest(0, least(size, rest - before)) AS BIGINT) AS taken FROM c
"""
