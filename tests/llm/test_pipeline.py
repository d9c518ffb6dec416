"""The corpus pipeline, stage by stage, against brute force on the smallest tables; and the shared components."""

import random

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from quillgrid.llm import langid, mixing, secrets, simhash
from quillgrid.llm.common import SAVED, components, save, table
from quillgrid.llm.registry import oracle_sql, queries

from .test_text_operators import brute_fingerprint, documents, joined, prose


@pytest.fixture(scope="module")
def stages(spark, sf):
    """The documents before and after each stage."""
    seen = [table(spark, sf, "documents")]
    for _, stage in corpus_pipeline.STAGES:
        out, _ = save(stage(spark, seen[-1], sf))
        seen.append(out)
    return seen


def texts(df):
    return {r["doc_id"]: r["text"] for r in df.collect()}


def test_language_stage_keeps_what_is_recognised(stages):
    before, after = texts(stages[0]), texts(stages[1])
    gone = set(before) - set(after)
    assert len(gone) < 0.05 * len(before) and all(after[k] == before[k] for k in after)
    model = langid.train(langid.sample(stages[0]))
    for k in list(gone)[:20]:
        lang, score = model.predict(before[k])
        assert lang == langid.UNKNOWN or score < model.threshold


def test_near_dedup_stage_keeps_one_of_each_group(stages):
    before, after = texts(stages[1]), texts(stages[2])
    ids = sorted(before)
    fps = [brute_fingerprint(before[k]) for k in ids]
    comp = joined(ids, lambda a, b: (fps[a] ^ fps[b]).bit_count() <= simhash.MAX_DIFFERENCE)
    assert set(after) == set(comp)


def test_secret_stage_masks(stages):
    before, after = texts(stages[2]), texts(stages[3])
    assert set(before) == set(after)
    masked = [k for k in before if before[k] != after[k]]
    assert all(secrets.MASK in after[k] for k in masked)
    assert all(r["n_chars"] == len(r["text"]) for r in stages[3].collect())


def test_mixing_stage_takes_what_the_mix_says(stages):
    plan = mixing.mix(stages[3]).groupBy("source").agg(F.sum("taken").alias("n")).collect()
    got = {r["source"]: r["n"] for r in stages[4].groupBy("source").agg(F.sum(mixing.word_count(F.col("text"))).alias("n")).collect()}
    assert {r["source"]: r["n"] for r in plan if r["n"]} == got


def test_packing_stage_packs_every_row(stages):
    pieces = stages[5].collect()
    assert sum(r["start"] == 0 for r in pieces) == stages[4].count()
    assert all(r["offset"] + r["length"] <= 2048 for r in pieces)
    assert [s.columns for s in stages[:5]] == [stages[0].columns] * 5


def test_run_on_nulls_repeats_clashes_and_nothing(spark, tmp_path):
    rng = random.Random(3)
    rows = [(k, prose(rng, rng.randrange(5, 60)), rng.choice(["en", "de"]), rng.choice(["a", "b"])) for k in range(60)]
    rows += [(None, rows[2][1], "en", "a"), (None, None, None, None), (70, "", "en", None), (71, None, "de", "a"), (72, "word " * 4000, "en", "b"), (5, rows[5][1], "en", "a"), (5, rows[5][1], "en", "a")]
    documents(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    known = set(SAVED)
    got = corpus_pipeline.run(spark, str(tmp_path))
    assert len(set(SAVED) - known) == 1  # only the last stage's table is left
    pieces = got.collect()
    windows = {}
    for r in pieces:
        windows.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert pieces and all(w == sorted(w) or sorted(w)[0][0] == 0 for w in windows.values()) and all(sum(n for _, n in w) <= 2048 for w in windows.values())
    docs = documents(spark, rows)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out, _ = save(stage(spark, docs, str(tmp_path)))
        assert out.columns == docs.columns
        one = out.drop("doc_id", "text", "lang", "source", "n_chars").first()
        assert one is None or all(v == k for k, v in one.asDict().items())
        docs = out
    empty = str(tmp_path / "none")
    documents(spark, rows).where("false").write.parquet(f"{empty}/documents.parquet")
    assert corpus_pipeline.run(spark, empty).count() == 0


def test_registered_queries():
    numbers = {n.split("_")[0] for n in queries()}
    assert numbers == {f"op{k}" for k in range(1, 14)} and set(oracle_sql()) <= set(queries())


def test_components_of_chains_stars_and_nothing(spark):
    rng = random.Random(1)
    edges = [(k, k + 1) for k in range(100, 160)] + [(500, k) for k in range(501, 900)] + [(7, 7), (8, None), (None, 9)]
    edges += [(rng.randrange(1000, 1400), rng.randrange(1000, 1400)) for _ in range(250)]
    got = {r["id"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long").repartition(4)).collect()}
    ids = sorted({x for a, b in edges if a is not None and b is not None and a != b for x in (a, b)})
    at = {x: k for k, x in enumerate(ids)}
    linked = {frozenset((at[a], at[b])) for a, b in edges if a in at and b in at and a != b}
    assert got == dict(zip(ids, joined(ids, lambda a, b: frozenset((a, b)) in linked), strict=True))
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
