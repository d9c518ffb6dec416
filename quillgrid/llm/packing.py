"""Packing documents into token windows by sum-of-squares online packing.

Documents are tokenised where they are read; what is shuffled is one short row per piece.  A
piece is a full window of a document or its remainder.  Remainders go to the fill level that
makes the sum of squared counts of partially filled windows smallest; the counts live in one
level array per packing group.  Groups are small, so they run side by side; the windows that a
group leaves open are given up, and their pieces are packed once more in larger groups.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_text, save, table, whole_ids

WINDOW = 2048
#: Remainders of documents per packing group of the first and of the second round.
GROUP, SECOND_GROUP = 1024, 65536
#: Share of a window from which it counts as filled at the end of the first round.
FILLED = 0.99
END_ID = 1
PIECE = "doc_id string, start long, length long, ids_crc32 long, doc_tokens long"
#: Where the numbers of full windows, and of windows of the second round, begin.
FULL, SECOND = 1 << 61, 1 << 60
_ENCODERS: dict[str, object] = {}


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in a byte-level vocabulary: itself where it can be seen, else one from 256 on."""
    seen = [*range(33, 127), *range(161, 173), *range(174, 256)]
    return {chr(b): b for b in seen} | {chr(256 + n): b for n, b in enumerate(sorted(set(range(256)) - set(seen)))}


def encoder(path: str):
    """The byte-level BPE of a tokenizer file, its added tokens included, one per Python worker.

    Ids are those of the file (a test compares them); this form of it encodes about four times as fast.
    """
    if path not in _ENCODERS:
        import public_tokenizers
        import tiktoken

        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        added, letters = {t["content"]: t["id"] for t in file["added_tokens"]}, byte_letters()
        ranks = {bytes(letters[c] for c in token): k for token, k in file["model"]["vocab"].items() if token not in added}
        _ENCODERS[path] = tiktoken.Encoding("byte_bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=added)
    return _ENCODERS[path]


def pieces(docs: DataFrame, window: int, vocab: str, groups: int, id_col: str, text_col: str) -> DataFrame:
    """Rows (doc_id, start, length, ids_crc32, doc_tokens, shard, sequence_id): full windows of a document, then its remainder.

    Full windows are sequences of their own and get their number from the task and their place in it; remainders are dealt to the groups
    (shard) in turn, so that no group holds more than its share even if all rows are alike.
    """

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = encoder(vocab)
        task = TaskContext.get().partitionId()
        full, dealt = 0, task * 7919
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch["doc_id"], batch["text"], strict=True):
                ids = np.array((enc.encode(text, allowed_special="all") if isinstance(text, str) else []) + [END_ID], "<u4")
                for at in range(0, len(ids), window):
                    part = ids[at : at + window]
                    if len(part) == window:
                        shard, number, full = None, FULL | task << 36 | full, full + 1
                    else:
                        shard, number, dealt = dealt % groups, None, dealt + 1
                    rows.append((doc_id, at, len(part), zlib.crc32(part.tobytes()), len(ids), shard, number))
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "shard", "sequence_id"]
            # Column by column: numbers beside nulls would become floats on the way.
            columns = zip(*rows, strict=True) if rows else [()] * len(names)
            yield pd.DataFrame({n: pd.array(list(c), dtype=object if n == "doc_id" else "Int64") for n, c in zip(names, columns, strict=True)})

    return as_text(docs, id_col, text_col).mapInPandas(cut, f"{PIECE}, shard long, sequence_id long")


def place(lengths: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """(sequence, offset) of each piece in turn, by the sum-of-squares rule; ties go to the fullest level.

    Moving a window from level h to h + s changes the sum by 1 - 2 N[h] for what leaves (nothing
    for a new window) and by 2 N[h + s] + 1 for what arrives (nothing when it becomes full).
    """
    count = np.zeros(window + 1, np.int64)
    open_at: list[list[int]] = [[] for _ in range(window + 1)]
    sequence, offset, made = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64), 0
    never = np.iinfo(np.int64).max
    for k, s in enumerate(lengths):
        if s == window:
            sequence[k], offset[k], made = made, 0, made + 1
            continue
        top = window - s
        arrive = 2 * count[s : window + 1] + 1
        arrive[top] = 0
        leave = count[: top + 1]
        cost = np.where(leave > 0, arrive - 2 * leave + 1, never)
        cost[0] = arrive[0]
        level = top - int(np.argmin(cost[::-1]))
        if level == 0:
            bin_id, made = made, made + 1
        else:
            bin_id = open_at[level].pop()
            count[level] -= 1
        sequence[k], offset[k] = bin_id, level
        if level + s < window:
            open_at[level + s].append(bin_id)
            count[level + s] += 1
    return sequence, offset


def pack(
    docs: DataFrame,
    window: int = WINDOW,
    group: int = GROUP,
    second_group: int = SECOND_GROUP,
    vocab: str | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A document's tokens are its ids and a final end id; null text counts as empty, so it is one
    piece of length 1.  Every id lies in one piece; a window's pieces are gapless from 0.  Full
    windows need no company; remainders (one a document at most) are packed in groups, and what
    stands in windows that are not filled then, in larger groups once more.  Repeated rows are
    packed once each.  An empty table gives an empty result; other columns are ignored.
    """
    groups = max(1, -(-docs.count() // group))
    cut, _ = save(pieces(docs, window, vocab or vocabulary(), groups, id_col, text_col))

    def fill(base: int, filled: float):
        def each(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
            rows = rows.sort_values(["doc_id", "start", "ids_crc32", "length"], na_position="first", kind="stable")
            lengths = rows["length"].to_numpy(np.int64)
            sequence, offset = place(lengths, window)
            level = np.bincount(sequence, lengths)
            return rows.drop(columns="shard").assign(sequence_id=base + sequence + (int(key[0]) << 36), offset=offset, open=level[sequence] < filled * window)

        return each

    placed = f"{PIECE}, sequence_id long, offset long, open boolean"
    full = cut.where("sequence_id IS NOT NULL").withColumn("offset", F.lit(0).cast("long")).drop("shard")
    first, _ = save(cut.where("sequence_id IS NULL").drop("sequence_id").groupBy("shard").applyInPandas(fill(0, FILLED), placed))
    rest = first.where("open")
    more = max(1, -(-rest.count() // second_group))
    rest = rest.withColumn("shard", F.pmod(F.xxhash64("sequence_id", "offset"), F.lit(more))).drop("sequence_id", "offset", "open")
    second = rest.groupBy("shard").applyInPandas(fill(SECOND, 0.0), placed)
    return whole_ids(full.unionByName(first.where("not open").drop("open")).unionByName(second.drop("open")))


def op10(spark, sf_dir: str) -> DataFrame:
    """All ``documents`` packed into windows: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    return pack(table(spark, sf_dir, "documents"))
