"""Language identification: averaged hashed subword embeddings with a linear softmax.

A text is the average of the embeddings of its hashed character n-grams; a linear layer scores
the languages.  Both are trained by stochastic gradient descent in numpy on a bounded sample of
labelled documents: mean gradients of a batch, clipped by their norm, in steps that shrink with the
squares seen so far.  Scores are calibrated by a temperature and by the rejection threshold that
keeps all but a stated share of held-out calibration windows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import table, unused

UNKNOWN = "und"
#: N-gram orders, hash buckets and embedding width of the model.
ORDERS, BUCKETS, WIDTH = (1, 2, 3), 1 << 16, 16
#: Distinct texts a language that training uses (about), all languages' together, and characters of a text's window: the sample stays small at any size.
SAMPLE_PER_LANG, SAMPLE_ROWS, SAMPLE_CHARS = 800, 40_000, 3000
#: The longest gradient of a batch, and steps of training at least.
CLIP, LEAST_STEPS = 5.0, 200
#: Share of calibration windows that rejection may lose, and the highest threshold.
LOSS, MAX_THRESHOLD = 0.001, 0.5
#: Code points scored at a time; longer texts are summed over slices.
SLICE = 1 << 20
_MIX = np.array([0x9E3779B1, 0x85EBCA6B, 0xC2B2AE35], np.uint32)
_LETTERS: list[np.ndarray] = []


def letters() -> np.ndarray:
    """Which code points are letters."""
    if not _LETTERS:
        _LETTERS.append(np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000))
    return _LETTERS[0]


def codes(text: str) -> np.ndarray:
    """Lower-case code points of a text between spaces; runs of anything but letters become one space.  Empty without letters."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    is_letter = letters()[points]
    if not is_letter.any():
        return np.empty(0, np.uint32)
    first_gap = ~is_letter & np.concatenate([[True], is_letter[:-1]])
    points = np.where(is_letter, points, np.uint32(32))[is_letter | first_gap]
    space = np.array([32], np.uint32)
    return np.concatenate([space[: int(points[0] != 32)], points, space[: int(points[-1] != 32)]])


def grams(points: np.ndarray) -> list[np.ndarray]:
    """Bucket of the n-gram that starts at each code point, for each order."""
    out = []
    for n in ORDERS:
        if len(points) < n:
            out.append(np.empty(0, np.int64))
            continue
        h = np.full(len(points) - n + 1, n * 0x27D4EB2F & 0xFFFFFFFF, np.uint32)
        for k in range(n):
            h = (h ^ points[k : len(points) - n + 1 + k]) * _MIX[k]
            h ^= h >> np.uint32(15)
        out.append((h & np.uint32(BUCKETS - 1)).astype(np.int64))
    return out


@dataclass
class Model:
    """``scores[b]``: what an n-gram in bucket b adds to each language's logit (embedding times linear layer)."""

    langs: list[str]
    scores: np.ndarray
    bias: np.ndarray
    temperature: float = 1.0
    threshold: float = 0.0

    def mean_logits(self, points: np.ndarray) -> np.ndarray:
        total, n, overlap = np.zeros(len(self.langs)), 0, max(ORDERS) - 1
        for at in range(0, max(1, len(points)), SLICE):
            part = points[at : at + SLICE + overlap]
            for order, g in zip(ORDERS, grams(part), strict=True):
                g = g[: max(0, min(SLICE, len(points) - order + 1 - at))]
                total += self.scores[g].sum(0, dtype=np.float64)
                n += len(g)
        return total / max(1, n) + self.bias

    def predict(self, text: str | None) -> tuple[str, float]:
        """(language, calibrated probability); ``und`` and 0 for a text that is null or has no letter."""
        points = codes(text) if isinstance(text, str) else ()
        if not len(points):
            return UNKNOWN, 0.0
        z = self.mean_logits(points) / self.temperature
        p = np.exp(z - z.max())
        k = int(np.argmax(p))
        return self.langs[k], float(p[k] / p.sum())


def _windows(text: str, rng: np.random.Generator) -> list[np.ndarray]:
    """Training examples of one text: itself, and windows of many lengths anywhere in it."""
    points = codes(text)
    if len(points) < 3:
        return []
    out = [points] if len(points) <= 1000 else []
    for size in (24, 60, 200, 600):
        if len(points) > size:
            at = int(rng.integers(0, len(points) - size))
            out.append(points[at : at + size])
    return out


def _clipped(parts: list[np.ndarray]) -> list[np.ndarray]:
    norm = math.sqrt(sum(float((g.astype(np.float64) ** 2).sum()) for g in parts))
    return [g * np.float32(CLIP / norm) for g in parts] if norm > CLIP else parts


def train(rows: list[tuple[str, str]], epochs: int = 3, rate: float = 0.15, batch: int = 64, seed: int = 9) -> Model:
    """A model of (text, language) rows; none known when there are no rows.  Weights that are not finite are an error."""
    rng = np.random.default_rng(seed)
    rows = sorted(rows)
    langs = sorted({lang for _, lang in rows})
    if not langs:
        return Model([], np.zeros((BUCKETS, 0), np.float32), np.zeros(0))
    number = {lang: k for k, lang in enumerate(langs)}
    examples, seen = [], dict.fromkeys(langs, 0)
    for text, lang in rows:
        seen[lang] += 1  # every tenth text of a language is for calibration
        for w in _windows(text, rng):
            ids, times = np.unique(np.concatenate(grams(w)), return_counts=True)
            examples.append((ids.astype(np.uint16), (times / times.sum()).astype(np.float32), number[lang], seen[lang] % 10 == 0))
    if not examples:
        return Model(langs, np.zeros((BUCKETS, len(langs)), np.float32), np.zeros(len(langs)))
    fit, held = [x for x in examples if not x[3]] or examples, [x for x in examples if x[3]] or examples
    weight = 1.0 / np.maximum(1, np.bincount([y for _, _, y, _ in fit], minlength=len(langs)))
    weight *= len(fit) / np.count_nonzero(np.bincount([y for _, _, y, _ in fit], minlength=len(langs)))
    emb = rng.normal(0, 0.1, (BUCKETS, WIDTH)).astype(np.float32)
    out, bias = rng.normal(0, 0.1, (WIDTH, len(langs))).astype(np.float32), np.zeros(len(langs), np.float32)
    seen_emb, seen_out, seen_bias = np.full(emb.shape, 1e-8, np.float32), np.full(out.shape, 1e-8, np.float32), np.full(bias.shape, 1e-8, np.float32)
    epochs = max(epochs, -(-LEAST_STEPS * batch // len(fit)))
    steps, total = 0, epochs * -(-len(fit) // batch)
    for _ in range(epochs):
        order = rng.permutation(len(fit))
        for at in range(0, len(order), batch):
            part = [fit[i] for i in order[at : at + batch]]
            lr = np.float32(rate * (1 - steps / total))
            steps += 1
            # Share of each n-gram in each example, for the n-grams of the batch.
            used, place = np.unique(np.concatenate([ids for ids, _, _, _ in part]), return_inverse=True)
            example = np.repeat(np.arange(len(part)), [len(ids) for ids, _, _, _ in part])
            share = np.zeros((len(part), len(used)), np.float32)
            share[example, place] = np.concatenate([x for _, x, _, _ in part])
            y = np.array([k for _, _, k, _ in part])
            used = used.astype(np.int64)
            x = share @ emb[used]
            z = x @ out + bias
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(y)), y] -= 1
            p *= (weight[y] / len(y)).astype(np.float32)[:, None]
            g_emb, g_out, g_bias = _clipped([share.T @ (p @ out.T), x.T @ p, p.sum(0)])
            seen_emb[used] += g_emb * g_emb
            seen_out += g_out * g_out
            seen_bias += g_bias * g_bias
            emb[used] -= lr * g_emb / np.sqrt(seen_emb[used])
            out -= lr * g_out / np.sqrt(seen_out)
            bias -= lr * g_bias / np.sqrt(seen_bias)
    model = Model(langs, (emb @ out).astype(np.float32), bias.astype(float))
    if not (np.isfinite(model.scores).all() and np.isfinite(model.bias).all()):
        raise FloatingPointError("training of the language model diverged")
    logits = np.array([(model.scores[ids.astype(np.int64)] * x[:, None]).sum(0, dtype=np.float64) + model.bias for ids, x, _, _ in held])
    truth = np.array([k for _, _, k, _ in held])

    def loss(t: float) -> float:
        z = logits / t
        z -= z.max(1, keepdims=True)
        return float((np.log(np.exp(z).sum(1)) - z[np.arange(len(truth)), truth]).mean())

    model.temperature = min((float(t) for t in np.geomspace(0.05, 5, 60)), key=loss)
    z = logits / model.temperature
    p = np.exp(z - z.max(1, keepdims=True))
    model.threshold = min(MAX_THRESHOLD, float(np.quantile((p / p.sum(1, keepdims=True)).max(1), LOSS)))
    return model


def sample(docs: DataFrame, per_lang: int = SAMPLE_PER_LANG, rows_at_most: int = SAMPLE_ROWS, chars: int = SAMPLE_CHARS) -> list[tuple[str, str]]:
    """About ``per_lang`` distinct labelled texts (text, lang) a language, drawn by a hash, so reruns agree.

    Every language is kept: where there are many, each gets fewer texts.  Of a text longer than
    ``chars`` one window is taken, at a place that the hash gives.  Copies count once.
    """
    key = F.xxhash64(F.lit("langid"), "text")
    rows = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("text", "lang", key.alias("key"))
    counts = rows.groupBy("lang").agg(F.approx_count_distinct("key", 0.02).alias("n")).collect()
    if not counts:
        return []
    most = 1 << 30
    each = max(1, min(per_lang, rows_at_most // len(counts)))
    share = docs.sparkSession.createDataFrame([(r["lang"], int(min(1.0, each / max(1, r["n"])) * most)) for r in counts], "lang string, share long")
    picked = rows.join(F.broadcast(share), "lang").where(F.pmod(F.col("key"), F.lit(most)) < F.col("share"))  # one row a language
    at = F.pmod(F.shiftright("key", 30), F.greatest(F.lit(1), F.length("text") - chars + 1)).cast("int") + 1
    picked = picked.select("lang", "key", F.substr("text", at, F.lit(chars)).alias("text")).distinct()
    return [(r["text"], r["lang"]) for r in picked.collect()]


def _predictor(docs: DataFrame, model: Model):
    """A column function from texts to (lang_pred, score, rejected)."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, score double, rejected boolean")
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        m = sent.value
        for texts in batches:
            found = [m.predict(t) if m.langs else (UNKNOWN, 0.0) for t in texts]
            out = pd.DataFrame(found, columns=["lang_pred", "score"])
            yield out.assign(rejected=(out["lang_pred"] == UNKNOWN) | (out["score"] < m.threshold))

    return predict


def identify(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """All columns of ``docs`` and lang_pred, score, rejected (columns of these names are replaced).

    Only the text is an input.  A text that is null or has no letter is ``und`` with score 0 and
    rejected; others get a learned language, and are rejected where the calibrated score is below
    the model's threshold.  A model without languages says ``und`` to all.
    """
    docs = docs.drop("lang_pred", "score", "rejected")
    said = unused(docs, "said")
    return docs.withColumn(said, _predictor(docs, model)(F.col(text_col))).select(*docs.columns, f"{said}.*")


def recognised(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that :func:`identify` does not reject, with their own columns."""
    said = unused(docs, "said")
    return docs.withColumn(said, _predictor(docs, model)(F.col(text_col))).where(f"not {said}.rejected").select(*docs.columns)


def held_out(doc_id) -> F.Column:
    """Documents that training never sees: crc32 of the id as text leaves 2 when divided by 4 (a null id: not held out)."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def op9(spark, sf_dir: str) -> DataFrame:
    """Language of every whole text of ``documents``, learned from the rows that are not held out: doc_id, held_out, lang_pred, score, rejected."""
    docs = table(spark, sf_dir, "documents")
    model = train(sample(docs.where(~held_out("doc_id"))))
    return identify(docs.select("doc_id", "text"), model).select("doc_id", held_out("doc_id").alias("held_out"), "lang_pred", "score", "rejected")
