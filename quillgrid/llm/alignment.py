"""Alignment of two tokenizers by divide and conquer at shared cuts.

Both tokenizers end some of their tokens at the same byte.  An interval between two such cuts is
divided at a common end near its middle: the middle token end of the one is looked up among those of
the other by bisection, and where they differ, both leapfrog to the right, then to the left, until an
end is common.  Both halves go on alike; intervals without a common end inside are groups.  All
intervals of a batch of texts that stand at the same depth are divided together.

Links (pairs of overlapping tokens) are counted over all documents.  A document keeps its different
id pairs with their number, so one pass of the texts does; counts come back to the documents by a
broadcast of the most frequent pairs, a bounded number, and by a join of the others.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_text, save, table

#: Characters that are tokenised at a time (a longer text goes alone).
STRETCH = 1 << 20
#: Id pairs that are broadcast, the most frequent ones: 20 bytes each.
BROADCAST_PAIRS = 1 << 18
#: Ids of B are below this, so a pair is one whole number.
IDS_B = 1 << 15
_LOADED: dict[tuple, object] = {}


def byte_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def piece_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class Tokenizers:
    """Both tokenizers, and the bytes of each of their ids.

    A is read from the ranks of byte_bpe_50k.json, which give the same ids (a test compares them); special tokens in a text are plain text.
    """

    def __init__(self, a_path: str, b_path: str) -> None:
        import public_tokenizers
        import sentencepiece
        import tiktoken

        with open(a_path, "rb") as f:
            ranks = {base64.b64decode(x): int(y) for x, y in map(bytes.split, f)}
        self.a = tiktoken.Encoding("a", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        self.a_bytes = [b""] * (max(ranks.values()) + 1)
        for token, k in ranks.items():
            self.a_bytes[k] = token
        self.b_bytes = [self._piece(self.b.id_to_piece(k)) for k in range(self.b.get_piece_size())]
        self.a_length, self.b_length = (np.array([len(t) for t in x], np.int64) for x in (self.a_bytes, self.b_bytes))

    @staticmethod
    def _piece(piece: str) -> bytes:
        byte = re.fullmatch(r"<0x([0-9A-F]{2})>", piece)
        return bytes([int(byte[1], 16)]) if byte else piece.replace("▁", " ").encode()

    def encode(self, texts: list[str]) -> list[tuple[list[int], list[int]]]:
        """Ids of each text (A of a space and the text); none where the bytes of either are not those of a space and the text."""
        out = []
        for text, b in zip(texts, self.b.encode(texts, num_threads=1), strict=True):
            said = " " + text
            a, raw = self.a.encode_ordinary(said), said.encode()
            same = text != "" and b"".join([self.a_bytes[k] for k in a]) == raw and b"".join([self.b_bytes[k] for k in b]) == raw
            out.append((a, b) if same else ([], []))
        return out


def tokenizers(a_path: str, b_path: str) -> Tokenizers:
    """One pair of tokenizers in each Python worker."""
    key = (a_path, b_path)
    if key not in _LOADED:
        _LOADED[key] = Tokenizers(a_path, b_path)
    return _LOADED[key]


def cuts(a: np.ndarray, b: np.ndarray, shared: np.ndarray) -> np.ndarray:
    """All common values of two strictly increasing arrays, by division at some of them (``shared``, increasing, with the last of both).

    An interval is given by places: after ``lo`` and before ``hi`` in each array.  Intervals with nothing between in either are done.
    """
    found = [shared]
    a_hi, b_hi = np.searchsorted(a, shared), np.searchsorted(b, shared)
    a_lo, b_lo = np.concatenate([[-1], a_hi[:-1]]), np.concatenate([[-1], b_hi[:-1]])
    while True:
        open_ = (a_hi - a_lo > 1) & (b_hi - b_lo > 1)
        a_lo, a_hi, b_lo, b_hi = a_lo[open_], a_hi[open_], b_lo[open_], b_hi[open_]
        if not len(a_lo):
            return np.sort(np.concatenate(found))
        middle = (a_lo + a_hi) // 2
        place_a, place_b = middle.copy(), np.searchsorted(b, a[middle])
        # To the right: the side that is behind catches up with the other one, until both stand at one value or leave the interval.
        going = np.flatnonzero(a[place_a] != b[place_b])
        while len(going):
            behind = a[place_a[going]] < b[place_b[going]]
            up_a, up_b = going[behind], going[~behind]
            place_a[up_a] = np.searchsorted(a, b[place_b[up_a]])
            place_b[up_b] = np.searchsorted(b, a[place_a[up_b]])
            going = going[(a[place_a[going]] != b[place_b[going]]) & (place_a[going] < a_hi[going]) & (place_b[going] < b_hi[going])]
        none = np.flatnonzero((place_a >= a_hi) | (place_b >= b_hi))
        # To the left, for those that found none.
        place_a[none] = middle[none]
        place_b[none] = np.searchsorted(b, a[middle[none]], "right") - 1
        going = none[place_b[none] > b_lo[none]]
        lost = none[place_b[none] <= b_lo[none]]
        while len(going):
            ahead = a[place_a[going]] > b[place_b[going]]
            down_a, down_b = going[ahead], going[~ahead]
            place_a[down_a] = np.searchsorted(a, b[place_b[down_a]], "right") - 1
            place_b[down_b] = np.searchsorted(b, a[place_a[down_b]], "right") - 1
            out = (place_a[going] <= a_lo[going]) | (place_b[going] <= b_lo[going])
            lost = np.concatenate([lost, going[out]])
            going = going[~out]
            going = going[a[place_a[going]] != b[place_b[going]]]
        cut = np.ones(len(a_lo), bool)
        cut[lost] = False
        a_lo, a_hi, b_lo, b_hi, place_a, place_b = (x[cut] for x in (a_lo, a_hi, b_lo, b_hi, place_a, place_b))
        found.append(a[place_a])
        a_lo, a_hi = np.stack([a_lo, place_a], 1).ravel(), np.stack([place_a, a_hi], 1).ravel()
        b_lo, b_hi = np.stack([b_lo, place_b], 1).ravel(), np.stack([place_b, b_hi], 1).ravel()


def listed(a: np.ndarray, b: np.ndarray, a_ends: np.ndarray, b_ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids ``a1,a2|b1;a3|b2`` in groups as text, and where each group ends in it; ``ends`` count the ids up to each group's end."""
    group_a, group_b = (np.repeat(np.arange(len(e)), np.diff(e, prepend=0)) for e in (a_ends, b_ends))
    starts_b = np.concatenate([[0], b_ends[:-1]])
    at_a, at_b = np.arange(len(a)) + starts_b[group_a], np.arange(len(b)) + a_ends[group_b]
    ids, sign = np.empty(len(a) + len(b), np.int64), np.full(len(a) + len(b), ord(","), np.uint8)
    ids[at_a], ids[at_b] = a, b
    sign[at_a[a_ends - 1]], sign[at_b[b_ends - 1]] = ord("|"), ord(";")
    width = len(str(int(ids.max())))
    shown = np.empty((len(ids), width + 1), np.uint8)
    keep = np.ones((len(ids), width + 1), bool)
    for k in range(width):
        power = 10 ** (width - 1 - k)
        shown[:, k] = ids // power % 10 + 48
        keep[:, k] = (ids >= power) | (power == 1)
    shown[:, width] = sign
    lengths = keep.sum(1).cumsum()
    return shown[keep], lengths[at_b[b_ends - 1]]


DOCUMENT = "doc_id string, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<int>, counts array<int>"


def align(ids: list[tuple[list[int], list[int]]], t: Tokenizers) -> list[tuple]:
    """(n_a, n_b, n_groups, n_links, groups_sha256, pairs, counts) of each text's ids; texts without ids get zeros."""
    full = [k for k, (a, _) in enumerate(ids) if a]
    out = [(0, 0, 0, 0, "", [], [])] * len(ids)
    if not full:
        return out
    a, b = (np.concatenate([np.array(ids[k][side], np.int64) for k in full]) for side in (0, 1))
    a_at, b_at = (np.cumsum([len(ids[k][side]) for k in full]) for side in (0, 1))
    a_end, b_end = t.a_length[a].cumsum(), t.b_length[b].cumsum()
    shared = a_end[a_at - 1]  # a text's end is a common end
    cut = cuts(a_end, b_end, shared)
    a_ends, b_ends = np.searchsorted(a_end, cut) + 1, np.searchsorted(b_end, cut) + 1
    text, stops = listed(a, b, a_ends, b_ends)
    # Within a group every end of either side begins a new link, so links are as many as ends.
    ends = np.sort(np.concatenate([a_end, b_end]), kind="stable")
    ends = ends[np.append(ends[1:] != ends[:-1], True)]
    link = a[np.searchsorted(a_end, ends)] * IDS_B + b[np.searchsorted(b_end, ends)]
    groups, links = np.searchsorted(cut, shared) + 1, np.searchsorted(ends, shared) + 1
    lo_a = lo_b = lo_g = lo_l = lo_t = 0
    whole = text.tobytes()
    for n, k in enumerate(full):
        hi_t = stops[groups[n] - 1]
        pairs, counts = np.unique(link[lo_l : links[n]], return_counts=True)
        hashed = hashlib.sha256(whole[lo_t : hi_t - 1]).hexdigest()
        out[k] = (int(a_at[n] - lo_a), int(b_at[n] - lo_b), int(groups[n] - lo_g), int(links[n] - lo_l), hashed, pairs.astype(np.int32), counts.astype(np.int32))
        lo_a, lo_b, lo_g, lo_l, lo_t = a_at[n], b_at[n], groups[n], links[n], hi_t
    return out


def _aligned(a_path: str, b_path: str):
    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        t = tokenizers(a_path, b_path)
        names = [c.split()[0] for c in DOCUMENT.split(", ")]
        for batch in batches:
            texts = [x if isinstance(x, str) else "" for x in batch["text"]]
            ids, lo = batch["doc_id"].tolist(), 0
            while lo < len(texts):
                hi, size = lo + 1, len(texts[lo])
                while hi < len(texts) and size + len(texts[hi]) <= STRETCH:
                    size, hi = size + len(texts[hi]), hi + 1
                rows = [(doc_id, *row) for doc_id, row in zip(ids[lo:hi], align(t.encode(texts[lo:hi]), t), strict=True)]
                yield pd.DataFrame(rows, columns=names)
                lo = hi

    return each


def alignment(docs: DataFrame, a_path: str | None = None, b_path: str | None = None, broadcast_pairs: int = BROADCAST_PAIRS, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(per document, per id pair).

    Documents: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256; one row a row of ``docs``, repeated rows and null
    ids too.  A text that is null, empty or that either tokenizer changes has no tokens: zeros and an empty hash.  Pairs: a_id, b_id,
    n (links of all documents), best (whether no pair of the same b_id has more links; ties are all best).  An empty table
    gives empty results; other columns are ignored.  A pair that every document holds is one row a document at most, and is broadcast.
    """
    spark = docs.sparkSession
    each = _aligned(a_path or byte_vocabulary(), b_path or piece_vocabulary())
    rows, path = save(as_text(docs, id_col, text_col).mapInPandas(each, DOCUMENT).withColumn("row", F.monotonically_increasing_id()))
    held = rows.select(F.explode(F.arrays_zip("pairs", "counts")).alias("p")).select("p.pairs", "p.counts")
    counted = held.groupBy("pairs").agg(F.sum(F.col("counts").cast("long")).alias("n")).withColumn("b", F.col("pairs") % IDS_B)
    top = counted.groupBy("b").agg(F.max("n").alias("most"))  # one row an id of B: 32,768 at most
    known, _ = save(counted.join(F.broadcast(top), "b").select("pairs", "n", (F.col("n") == F.col("most")).alias("best")))
    # The count that so many pairs reach, from a histogram of counts by powers of the square root of two.
    level = F.floor(F.log2("n") * 2).cast("int")
    levels = {r["level"]: r["m"] for r in known.groupBy(level.alias("level")).agg(F.count("*").alias("m")).collect()}
    least, sum_ = max(levels, default=0) + 1, 0
    for x in sorted(levels, reverse=True):
        sum_ += levels[x]
        if sum_ > broadcast_pairs:
            break
        least = x
    frequent, rare = known.where(level >= least), known.where(level < least)
    again = spark.read.schema(rows.schema).parquet(path)
    parts = again.select("row", F.explode(F.arrays_zip("pairs", "counts")).alias("p")).select("row", F.col("p.pairs").alias("pairs"), F.col("p.counts").alias("m"))
    near = parts.join(F.broadcast(frequent), "pairs", "left")  # broadcast_pairs rows at most
    both = F.sum(F.col("m") * F.col("n")), F.sum(F.when(F.col("best"), F.col("m")).otherwise(0).cast("long"))
    sums = lambda df: df.groupBy("row").agg(both[0].alias("count_sum"), both[1].alias("n_best"))
    far = near.where("n IS NULL").select("row", "pairs", "m").join(rare, "pairs")
    total = sums(near.where("n IS NOT NULL")).unionByName(sums(far)).groupBy("row").agg(F.sum("count_sum").alias("count_sum"), F.sum("n_best").alias("n_best"))
    out = rows.drop("pairs", "counts").join(total, "row", "left")
    names = ["n_a", "n_b", "n_groups", "n_links"]
    out = out.select(F.col("doc_id").cast("long").alias("doc_id"), *names, *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n_best", "count_sum")], "groups_sha256")
    return out, known.select(F.floor(F.col("pairs") / IDS_B).cast("int").alias("a_id"), (F.col("pairs") % IDS_B).alias("b_id"), "n", "best")


def op11(spark, sf_dir: str) -> DataFrame:
    """All ``documents`` aligned between byte_bpe_50k.json and piece_bpe_32k.model: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256."""
    return alignment(table(spark, sf_dir, "documents"))[0]
