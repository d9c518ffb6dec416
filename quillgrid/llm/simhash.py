"""SimHash near-duplicates by anchor-point covering.

A 64-bit fingerprint is two halves of 32 bits; where two fingerprints differ in at most three
bits, one half differs in at most one.  The anchors of a half are the words of the perfect
[31, 26] Hamming code, with the half's last bit as it is: a covering code of radius 1.  Every
fingerprint has one home anchor within the covering radius and is replicated to every anchor
within radius plus threshold (two flips); two fingerprints that agree but for one bit of a half
meet at the home of either.  Comparing per anchor is then exact.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import components, save, shuffle_parts, table, unused, whole_ids

SHINGLE = 3
SEED = 42
MAX_DIFFERENCE = 3
#: Homes of one anchor that one comparison holds at a time; an anchor with more is split by salt, nothing is dropped.
HOMES_AT_ONCE = 2048
_SPACE = re.compile(rb"[\x20\x09-\x0D]")


def fingerprint(text: str | None, shingle: int = SHINGLE, seed: int = SEED, block: int = 1 << 20) -> int:
    """64-bit SimHash of a text's word shingles, each counted as often as it occurs; 0 without words.

    ``block``: bytes whose words are in hand at a time; the last words of a block begin the next one's shingles.
    """
    data = text.encode().lower() if isinstance(text, str) else b""
    hashed, ones, total, carry, at = xxhash.xxh64_intdigest, np.zeros(64, np.int64), 0, [], 0
    while at < len(data):
        m = _SPACE.search(data, min(at + block, len(data)))
        end = m.start() if m else len(data)
        words = carry + data[at:end].split()
        at = end
        grams = list(map(b" ".join, zip(*[words[k:] for k in range(shingle)], strict=False)))
        if not total and not grams and words and at >= len(data):
            grams = [b" ".join(words)]  # fewer words than a shingle
        carry = words[max(0, len(words) - shingle + 1) :] if shingle > 1 else []
        if grams:
            h = np.array([hashed(g, seed) for g in grams], ">u8")
            ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
            total += len(grams)
    return int.from_bytes(np.packbits(ones * 2 > total).tobytes(), "big") if total else 0


def fingerprints(docs: DataFrame, id_col: str, text_col: str, shingle: int, seed: int) -> DataFrame:
    """Rows (doc_id, th, fp): a hash of the text and the fingerprint, both as signed longs."""

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            fp = np.array([fingerprint(t, shingle, seed) for t in batch["text"]], np.uint64).view(np.int64)
            yield pd.DataFrame({"doc_id": batch["doc_id"], "th": batch["th"], "fp": fp})

    rows = docs.select(F.col(id_col).cast("long").cast("string").alias("doc_id"), F.xxhash64(text_col).alias("th"), F.col(text_col).alias("text"))
    return whole_ids(rows.mapInPandas(each, "doc_id string, th long, fp long"))


def _syndrome(half: np.ndarray) -> np.ndarray:
    """Which of bits 1 to 31 to flip to reach the Hamming code (0: none); bit 0 takes no part."""
    s = np.zeros(len(half), np.int64)
    for bit in range(1, 32):
        s ^= np.where((half >> np.uint64(bit)) & np.uint64(1), bit, 0)
    return s


def home_anchors(fp: np.ndarray, which: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(half, syndrome, home) of one half of each fingerprint; home: the code word within distance 1."""
    half = (fp.view(np.uint64) >> np.uint64(32 * which)) & np.uint64(0xFFFFFFFF)
    s = _syndrome(half)
    return half, s, np.where(s > 0, half ^ (np.uint64(1) << s.astype(np.uint64)), half)


def anchors(fp: np.ndarray, others: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, anchor, is_home) of each fingerprint's anchors in both halves; anchors are 33-bit numbers.

    Others: the anchors within distance 2, which are the homes of all points one flip away.
    """
    rows, one = np.arange(len(fp)), np.uint64(1)
    found = []
    for which in (0, 1):
        half, s, home = home_anchors(fp, which)
        here = [(rows, home, True)]
        if others:
            here.append((rows, home ^ one, False))
            for p in range(1, 32):
                q = s ^ p
                pair = (s > 0) & (q > p)
                here.append((rows[pair], half[pair] ^ (one << np.uint64(p)) ^ (one << q[pair].astype(np.uint64)), False))
        found += [(r, (a | np.uint64(which << 32)).astype(np.int64), np.full(len(r), h)) for r, a, h in here]
    row, anchor, home = (np.concatenate(x) for x in zip(*found, strict=True))
    return row, anchor, home


def _links(fp: np.ndarray, is_home: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links among one anchor's homes and guests: at most one edge per row."""
    homes, guests = fp[is_home], fp[~is_home]
    root = np.arange(len(homes))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    a, b = [], []
    step = max(1, (1 << 20) // max(1, len(homes)))
    for other, own in ((homes, True), (guests, False)):
        for at in range(0, len(other), step):
            near = np.bitwise_count(other[at : at + step, None].view(np.uint64) ^ homes[None, :].view(np.uint64)) <= most
            for k in np.flatnonzero(near.any(1)):
                hits = np.flatnonzero(near[k])
                first = find(hits[0])
                for j in hits[1:]:
                    r = find(j)
                    if r != first:
                        lo, hi = min(first, r), max(first, r)
                        root[hi], first = lo, lo
                if not own:
                    a.append(other[at + k])
                    b.append(homes[hits[0]])
    for i in range(len(homes)):
        if (r := find(i)) != i:
            a.append(homes[i])
            b.append(homes[r])
    return np.array(a, np.int64), np.array(b, np.int64)


def near_fingerprints(fps: DataFrame, most: int = MAX_DIFFERENCE) -> DataFrame:
    """Edges (a, b) between distinct fingerprints that connect every pair at ``most`` (three) or fewer bits."""
    if most > 3:
        raise ValueError("two halves and anchors of radius 1 + 1 cover at most three differing bits")
    spark = fps.sparkSession

    def replicate(others: bool):
        def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                fp = batch["fp"].to_numpy(np.int64)
                for at in range(0, len(fp), 20_000):
                    part = fp[at : at + 20_000]
                    row, anchor, home = anchors(part, others)
                    yield pd.DataFrame({"anchor": anchor, "fp": part[row], "home": home})

        return fps.mapInPandas(each, "anchor long, fp long, home boolean")

    # Anchors with too many homes are split: a home belongs to one salt and is a guest of the others, guests go to all.
    crowded, _ = save(
        replicate(False).groupBy("anchor").count().where(F.col("count") > HOMES_AT_ONCE)
        .select("anchor", F.ceil(F.col("count") / HOMES_AT_ONCE).cast("int").alias("salts"))
    )
    dealt = replicate(True)
    if crowded.head(1):
        dealt = dealt.join(crowded, "anchor", "left").withColumn("salts", F.coalesce("salts", F.lit(1)))
        own = F.pmod(F.xxhash64("fp"), F.col("salts")).cast("int")
        dealt = dealt.withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).withColumn("home", F.col("home") & (F.col("salt") == own))
    else:
        dealt = dealt.withColumn("salt", F.lit(0))
    dealt = dealt.select("anchor", "salt", "fp", "home")
    parts = shuffle_parts(spark)
    dealt = dealt.repartition(parts, "anchor", "salt").sortWithinPartitions("anchor", "salt", F.col("home").desc())

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Rows arrive by anchor, homes first; the homes of the anchor at hand are all that is kept between batches."""
        held_key, held = None, np.empty(0, np.int64)
        for batch in batches:
            anchor, salt = batch["anchor"].to_numpy(np.int64), batch["salt"].to_numpy(np.int64)
            fp, home = batch["fp"].to_numpy(np.int64), batch["home"].to_numpy(bool)
            cuts = np.flatnonzero((np.diff(anchor) != 0) | (np.diff(salt) != 0)) + 1
            starts = np.concatenate([[0], cuts]) if len(fp) else np.empty(0, np.int64)
            ends = np.concatenate([cuts, [len(fp)]]) if len(fp) else starts
            n_home = np.add.reduceat(home.astype(np.int64), starts) if len(fp) else starts
            many = (n_home > 0) & (ends - starts > 1)
            if len(starts):
                many[0] |= held_key == (anchor[0], salt[0])
            a, b = [], []
            for g in np.flatnonzero(many):
                s, e = starts[g], ends[g]
                carried = held if (anchor[s], salt[s]) == held_key else held[:0]
                x = np.concatenate([carried, fp[s:e]])
                y = np.concatenate([np.ones(len(carried), bool), home[s:e]])
                if y.any() and len(x) > 1:
                    ea, eb = _links(x, y, most)
                    a.append(ea)
                    b.append(eb)
            if len(fp):
                s, last = starts[-1], (anchor[-1], salt[-1])
                own = fp[s:][home[s:]]
                held = np.concatenate([held, own]) if last == held_key else own
                held_key = last
            if a:
                a, b = np.concatenate(a), np.concatenate(b)
                if len(a):
                    yield pd.DataFrame({"a": a, "b": b})

    return dealt.mapInPandas(compare, "a long, b long").where("a <> b").distinct()


def grouped(rows: DataFrame, most: int) -> DataFrame:
    """(fp, component): the component of each distinct fingerprint, named by one of its fingerprints."""
    fps = rows.select("fp").distinct()
    comp = components(near_fingerprints(fps, most))
    return fps.join(comp, fps["fp"] == comp["id"], "left").select("fp", F.coalesce("component", "fp").alias("component"))


def simhash(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, seed: int = SEED, most: int = MAX_DIFFERENCE
) -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hex digits), component_id.

    Documents with equal fingerprints are one class before anything is compared, so copies cost
    one row.  component_id is the smallest doc_id reachable over links.  Null and wordless texts
    have fingerprint zero and link like any other.  A null doc_id gets its component's smallest id
    (null where no document there has one).  Repeated rows give repeated rows; an empty table gives
    an empty result; other columns are ignored.
    """
    rows, _ = save(fingerprints(docs, id_col, text_col, shingle, seed))
    reach, _ = save(grouped(rows, most))
    first = rows.groupBy("fp").agg(F.min("doc_id").alias("first"))
    lowest = reach.join(first, "fp").groupBy("component").agg(F.min("first").alias("component_id"))
    by_fp = reach.join(lowest, "component").select("fp", "component_id")
    return rows.join(by_fp, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, seed: int = SEED, most: int = MAX_DIFFERENCE
) -> DataFrame:
    """``docs`` with one document of each component: that of smallest id (null last), then of smallest text hash.

    Of rows that agree in id and text one stays.
    """
    rows, _ = save(fingerprints(docs, id_col, text_col, shingle, seed))
    reach = grouped(rows, most)
    order = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("best_doc"), F.col("th").alias("best_th"))
    best = rows.groupBy("fp").agg(F.min(order).alias("best")).join(reach, "fp").groupBy("component").agg(F.min("best").alias("best")).select("best.*")
    th, nth = unused(docs, "th"), unused(docs, "nth")
    keyed = docs.withColumn(th, F.xxhash64(text_col))
    same = keyed[id_col].cast("long").eqNullSafe(best["best_doc"]) & (keyed[th] == best["best_th"])
    kept = keyed.join(best, same, "left_semi")
    if rows.groupBy("doc_id", "th").count().where("count > 1").limit(1).count():
        one = Window.partitionBy(id_col, th).orderBy(F.lit(1))
        kept = kept.withColumn(nth, F.row_number().over(one)).where(F.col(nth) == 1)
    return kept.select(*docs.columns)


def op4(spark, sf_dir: str) -> DataFrame:
    """Fingerprints of all ``documents`` and their components of near copies: doc_id, fingerprint, component_id."""
    return simhash(table(spark, sf_dir, "documents"))
