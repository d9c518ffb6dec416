"""Exact substring deduplication by suffix sorting: deep-shallow order within minimiser groups.

Every 100-byte string belongs to the group of the smallest hash among its 24-byte substrings, so
equal strings fall into one group wherever they stand.  A run of neighbouring strings with one
such minimiser is one row, about one for 39 bytes of text.  Rows that repeat as a whole are settled by
their hash; where a group holds different runs, the suffixes that start in them are sorted:
multikey quicksort on eight-byte characters to a shallow depth, then blind tries (only branching
positions are looked at) order what still shares a prefix.  Sorted neighbours that agree over the
whole length are repeats of their earliest one.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import forget, hash_sample, save, shuffle_parts, table, whole_ids

LENGTH = 100
#: Bytes of the substrings that are hashed; strings a run can span (a longer one is cut; both fit in a packed position).
GRAM, MAX_RUN = 24, 255
#: Bytes hashed at a time, and rows of different runs in a group from which on its strings are dealt out singly by content.
CHUNK, CROWD = 1 << 20, 4096
#: Documents (about) in which frequent minimisers are looked for, and the share of them from which one counts as frequent.
SAMPLE_DOCS, FREQUENT = 20_000, 1 / 256
#: Strings of crowded groups that a task remembers, to settle equal ones where they are read.
REMEMBERED = 200_000
#: Depth in bytes to which multikey quicksort sorts before blind tries take over.
SHALLOW = 24
NO_ID = -(1 << 63)


def _words(buf: np.ndarray, order: str) -> np.ndarray:
    """The eight bytes from each position on as a number (the buffer is padded)."""
    padded = np.concatenate([buf, np.zeros(16, np.uint8)])
    out = np.empty(len(buf) + 8, np.uint64)
    for r in range(8):
        n = (len(padded) - r) // 8
        view = padded[r : r + 8 * n].view(order)
        part = out[r::8]
        part[:] = view[: len(part)]
    return out[: len(buf)]


def _minimisers(buf: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """The hash of the gram at each position; for each start of a string of ``length`` bytes, the smallest among its grams."""
    w = _words(buf, "<u8")
    n = len(buf) - GRAM + 1
    h = (w[:n] ^ (w[:n] >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15)
    for k, odd in ((8, 0xC2B2AE3D27D4EB4F), (16, 0x165667B19E3779F9)):
        x = w[k : n + k]
        h += (x ^ (x >> np.uint64(31))) * np.uint64(odd)
        h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    grams, span, have = h, length - GRAM + 1, 1
    while have * 2 <= span:
        h = np.minimum(h[:-have], h[have:])
        have *= 2
    if have < span:
        h = np.minimum(h[: len(h) - (span - have)], h[span - have :])
    return grams, h


def runs(texts: list[bytes], length: int = LENGTH) -> tuple[np.ndarray, ...]:
    """(text number, start, strings, minimiser, content hash, loop) of the runs of all texts of ``length`` bytes or more.

    loop: the minimiser stands in the run more than once, so the run can repeat a string of its own.
    """
    found: list[tuple[np.ndarray, ...]] = []
    held: list[tuple[int, int, bytes]] = []
    size = 0

    def flush() -> None:
        if not held:
            return
        data = b"".join(b for _, _, b in held)
        sizes = np.array([len(b) for _, _, b in held])
        begins = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        grams, v = _minimisers(np.frombuffer(data, np.uint8), length)
        # Starts of strings that lie within one text; a run ends where the minimiser or the text changes.
        ok = np.zeros(len(data) + 1, np.int8)
        np.add.at(ok, begins, 1)
        np.add.at(ok, begins + sizes - length + 1, -1)
        inside = np.flatnonzero(np.cumsum(ok[: len(v)]))
        new = np.concatenate([[True], (np.diff(inside) > 1) | (np.diff(v[inside].view(np.int64)) != 0)])
        first = np.zeros(len(v) + 1, bool)
        first[begins[begins < len(v)]] = True
        new |= first[inside]
        at = np.flatnonzero(new)
        count = np.diff(np.append(at, len(inside)))
        pieces = -(-count // MAX_RUN)
        if (pieces > 1).any():
            which = np.repeat(np.arange(len(at)), pieces)
            nth = np.arange(len(which)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            at, count = at[which] + nth * MAX_RUN, np.minimum(MAX_RUN, count[which] - nth * MAX_RUN)
        start = inside[at]
        reach = count + length - GRAM
        edge = np.cumsum(reach) - reach
        at_gram = np.arange(reach.sum()) + np.repeat(start - edge, reach)
        loop = np.add.reduceat((grams[at_gram] == np.repeat(v[start], reach)).astype(np.int64), edge) > 1
        view, digest = memoryview(data), xxhash.xxh3_64_intdigest
        content = np.array([digest(view[a:b]) for a, b in zip(start.tolist(), (start + count + length - 1).tolist(), strict=True)], np.uint64)
        own = np.searchsorted(begins, start, side="right") - 1
        text = np.array([k for k, _, _ in held])[own]
        offset = np.array([o for _, o, _ in held])[own]
        found.append((text, start - begins[own] + offset, count, v[start].view(np.int64), content.view(np.int64), loop))
        held.clear()

    for k, b in enumerate(texts):
        for at in range(0, len(b) - length + 1, CHUNK):
            part = b[at : at + CHUNK + length - 1]
            held.append((k, at, part))
            size += len(part)
            if size >= CHUNK:
                flush()
                size = 0
    flush()
    if not found:
        return tuple(np.empty(0, np.int64) for _ in range(6))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _regroup(group: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of the members by (group, key), and their new group numbers in that order."""
    order = np.lexsort((key, group))
    g, k = group[order], key[order]
    return order, np.cumsum(np.concatenate([[0], (np.diff(g) != 0) | (k[1:] != k[:-1])]))


def equal_groups(buf: np.ndarray, starts: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """A number for each suffix start; two get one number just if their first ``length`` bytes agree (-1: alone)."""
    word = _words(buf, ">u8")
    member, group = np.arange(len(starts)), np.zeros(len(starts), np.int64)

    def company(member: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        stay = np.bincount(group)[group] > 1 if len(group) else np.empty(0, bool)
        return member[stay], group[stay]

    # Shallow: multikey quicksort, one eight-byte character a round, groups of one drop out.
    for depth in range(0, SHALLOW, 8):
        if not len(member):
            break
        order, group = _regroup(group, word[starts[member] + depth])
        member, group = company(member[order], group)
    # Deep: one trie node a round for every group.  Its branching byte is the first in which a member differs from the group's first.
    out = np.full(len(starts), -1, np.int64)
    made = 0
    spots = [(d, np.uint64(0xFFFFFFFFFFFFFFFF) << np.uint64(8 * max(0, 8 - (length - d)))) for d in range(SHALLOW, length, 8)]
    while len(member):
        heads = np.flatnonzero(np.concatenate([[True], np.diff(group) != 0]))
        number = np.cumsum(np.concatenate([[0], np.diff(group) != 0]))
        lead = starts[member[heads]][number]
        here = starts[member]
        branch = np.full(len(member), length, np.int64)
        open_ = np.arange(len(member))
        for d, mask in spots:
            x = (word[here[open_] + d] ^ word[lead[open_] + d]) & mask
            differs = x != 0
            bits = x[differs]
            if len(bits):
                zeros = np.zeros(len(bits), np.int64)  # whole zero bytes at the top
                for s in (32, 16, 8):
                    small = (bits >> np.uint64(64 - s)) == 0
                    zeros += np.where(small, s // 8, 0)
                    bits = np.where(small, bits << np.uint64(s), bits)
                branch[open_[differs]] = d + zeros
            open_ = open_[~differs]
        at = np.minimum.reduceat(branch, heads)
        same = at == length
        done = same[number]
        out[member[done]] = made + number[done]
        made += len(heads)
        member, group, number = member[~done], group[~done], number[~done]
        if len(member):
            order, group = _regroup(group, buf[starts[member] + at[number]])
            member, group = company(member[order], group)
    return out


def repeats(rows: pd.DataFrame, length: int) -> pd.DataFrame:
    """Spans (doc, tie, start, size) of the strings in these runs that stand earlier in another one."""
    data = rows["bytes"].tolist()
    sizes = np.array([len(b) for b in data])
    begins = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    n = rows["n"].to_numpy(np.int64)
    row = np.repeat(np.arange(len(rows)), n)
    nth = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
    group = equal_groups(np.frombuffer(b"".join(data), np.uint8), begins[row] + nth, length)
    doc, tie, start = rows["doc"].to_numpy(np.int64)[row], rows["tie"].to_numpy(np.int64)[row], rows["start"].to_numpy(np.int64)[row] + nth
    known = np.flatnonzero(group >= 0)
    order = known[np.lexsort((start[known], tie[known], doc[known], group[known]))]
    later = np.concatenate([[False], np.diff(group[order]) == 0]) if len(order) else np.empty(0, bool)
    dup = np.zeros(len(row), bool)
    dup[order[later]] = True
    hit = np.flatnonzero(dup)
    cut = np.concatenate([[True], (np.diff(hit) > 1) | (np.diff(row[hit]) != 0)]) if len(hit) else np.empty(0, bool)
    first = hit[cut]
    strings = np.diff(np.append(np.flatnonzero(cut), len(hit)))
    return pd.DataFrame({"doc": doc[first], "tie": tie[first], "start": start[first], "size": strings + length - 1})


def frequent(docs: DataFrame, length: int) -> np.ndarray:
    """Minimisers of many documents of a bounded sample, sorted: SAMPLE_DOCS times the runs of a document, over 78, at most.

    They only decide how rows are dealt, not what is found; one that the sample misses is one group of up to that share of the rows.
    """
    total = docs.count()
    least = max(64, math.ceil(min(total, SAMPLE_DOCS) * FREQUENT))
    if total < least:
        return np.empty(0, np.int64)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for at in range(0, len(b), 2000):
                text, _, _, h, _, _ = runs([t.encode() for t in b["text"].iloc[at : at + 2000]], length)
                h = h[np.lexsort((text, h))]
                seen, times = np.unique(h, return_counts=True)
                often = times > 1  # once in a batch is no sign of a frequent one
                yield pd.DataFrame({"h": seen[often], "n": times[often]})

    drawn = hash_sample(docs.select("text", F.xxhash64("doc", "text").alias("key")), SAMPLE_DOCS, "frequent", "key", total)
    found = drawn.select("text").mapInPandas(count, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
    return np.sort(np.array([r["h"] for r in found.select("h").collect()], np.int64))


def remove_repeats(docs: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept (the bytes that stay).

    A byte goes if a string of ``length`` bytes that covers it also starts earlier: in a document
    of smaller id (a null id comes first), or earlier in its own.  Rows that agree in id and text
    are one document, each with its result; different texts under one id are documents of their
    own, in the order of a hash.  Null text is empty.  An empty table gives an empty result; other
    columns are ignored.  Common strings do not gather: copies within a batch are settled before
    the shuffle, the rows of a frequent minimiser are dealt out by their content, and so are the
    strings of a group of many different runs.
    """
    if length < GRAM + 8 or length < SHALLOW:
        raise ValueError(f"length must be at least {GRAM + 8}")
    spark = docs.sparkSession
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    docs = docs.withColumn("doc", F.coalesce("doc_id", F.lit(NO_ID)))
    own = F.xxhash64("text")
    clash = docs.groupBy("doc").agg(F.min(own).alias("a"), F.max(own).alias("b")).where("a <> b").limit(1).count()
    docs = docs.withColumn("tie", own if clash else F.lit(0).cast("long"))
    often = spark.sparkContext.broadcast(frequent(docs, length))

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for at in range(0, len(b), 2000):
                part = b.iloc[at : at + 2000]
                text, start, n, h, content, loop = runs([t.encode() for t in part["text"]], length)
                doc, tie = part["doc"].to_numpy(np.int64)[text], part["tie"].to_numpy(np.int64)[text]
                pos = (start << 8) | n
                order = np.lexsort((pos, tie, doc, content, h))
                again = np.zeros(len(order), bool)
                if len(order):
                    x, y = h[order], content[order]
                    again[order[1:]] = (x[1:] == x[:-1]) & (y[1:] == y[:-1])
                    same = np.zeros(len(order), bool)  # the same row twice is no repeat
                    same[order[1:]] = (np.diff(doc[order]) == 0) & (np.diff(tie[order]) == 0) & (np.diff(pos[order]) == 0)
                    keep = ~(again & same)
                    hot = np.isin(h, often.value)
                    key = np.where(again, pos * 0x9E3779B1 + doc, np.where(hot, h ^ (content * 0x5851F42D4C957F2D), h))
                    rows = {"key": key, "h": h, "content": content, "doc": doc, "tie": tie, "pos": pos, "again": again, "loop": loop.astype(bool) | hot}
                    yield pd.DataFrame(rows)[keep]

    found = docs.select("doc", "tie", "text").mapInPandas(scan, "key long, h long, content long, doc long, tie long, pos long, again boolean, loop boolean")
    in_group = Window.partitionBy("key")
    in_copies = Window.partitionBy("key", "h", "content").orderBy("doc", "tie", "pos")
    found = (
        found.withColumn("low", F.min("content").over(in_group)).withColumn("high", F.max("content").over(in_group))
        .withColumn("first_doc", F.first(F.struct("doc", "tie", "pos")).over(in_copies))
        .withColumn("nth", F.row_number().over(in_copies))
        .where("again or nth > 1 or low < high or loop")
        .withColumn("whole", F.expr("again or first_doc <> struct(doc, tie, pos)"))
        .where("whole or nth = 1")
    )
    found, found_path = save(found.select("h", "doc", "tie", "pos", "whole"))
    start, n = F.shiftright("pos", 8), F.col("pos").bitwiseAND(F.lit(MAX_RUN)).cast("int")
    whole = found.where("whole").select("doc", "tie", start.alias("start"), (n + length - 1).cast("long").alias("size"))

    # Runs that share a group with different ones need their bytes.
    mixed = found.where("not whole").select("h", "doc", "tie", "pos")
    crowd, crowd_path = save(mixed.groupBy("h").count().where(F.col("count") > CROWD).select("h", F.lit(True).alias("crowd")))
    if crowd.head(1):
        mixed = mixed.join(crowd, "h", "left").withColumn("crowd", F.coalesce("crowd", F.lit(False)))
    else:
        mixed = mixed.withColumn("crowd", F.lit(False))
    asked = mixed.groupBy("doc", "tie").agg(F.collect_list(F.struct("h", "pos", "crowd")).alias("asked"))

    def squeeze(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Texts travel compressed."""
        c = zstandard.ZstdCompressor(level=1)
        for b in batches:
            yield b.assign(text=[c.compress(t.encode()) for t in b["text"]])

    packed = docs.select(F.col("doc_id").cast("string").alias("doc_id"), "doc", "tie", "text").mapInPandas(squeeze, "doc_id string, doc long, tie long, text binary")

    def fetch(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """The bytes of the runs; of a crowded group each string for itself, by content.

        Of equal strings that are read together only the earliest goes on; the others are repeats (``done``).
        """
        z, digest, names = zstandard.ZstdDecompressor(), xxhash.xxh3_64_intdigest, ["key", "doc", "tie", "start", "n", "done", "bytes"]
        for b in batches:
            rows: list[tuple] = []
            earliest: dict[bytes, tuple[int, int, int]] = {}

            def settled(doc: int, tie: int, k: int) -> tuple:
                return ((k * 0x9E3779B1 + doc) & ((1 << 62) - 1), doc, tie, k, 1, True, b"")

            def strings(earliest: dict) -> list[tuple]:
                return [(digest(s) - (1 << 63), *at, 1, False, s) for s, at in earliest.items()]

            for doc, tie, text, asked in zip(b["doc"], b["tie"], b["text"], b["asked"], strict=True):
                text = z.decompress(text)
                for r in asked:
                    at, n = r["pos"] >> 8, r["pos"] & MAX_RUN
                    if r["crowd"]:
                        for k in range(at, at + n):
                            s = text[k : k + length]
                            here = (doc, tie, k)
                            known = earliest.setdefault(s, here)
                            if known != here:
                                if here < known:
                                    earliest[s], here = here, known
                                rows.append(settled(*here))
                        if len(earliest) >= REMEMBERED:
                            rows += strings(earliest)
                            earliest.clear()
                    else:
                        rows.append((r["h"], doc, tie, at, n, False, text[at : at + n + length - 1]))
                    if len(rows) >= 20_000:
                        yield pd.DataFrame(rows, columns=names)
                        rows = []
            rows += strings(earliest)
            for at in range(0, len(rows), 20_000):
                yield pd.DataFrame(rows[at : at + 20_000], columns=names)

    # Rows of one (doc, tie) have one text: it is asked once.
    once = packed.join(asked, ["doc", "tie"]).select("doc", "tie", "text", "asked")
    once = once.dropDuplicates(["doc", "tie"]) if clash or _repeated(docs) else once
    with_bytes = once.mapInPandas(fetch, "key long, doc long, tie long, start long, n int, done boolean, bytes binary")
    with_bytes = with_bytes.repartition(shuffle_parts(spark), "key").sortWithinPartitions("key")

    def settle(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest: list[pd.DataFrame] = []
        for b in batches:
            done = b[b["done"]]
            if len(done):
                yield done[["doc", "tie", "start"]].assign(size=length)
                b = b[~b["done"]]
            if not len(b):
                continue
            key = b["key"].to_numpy(np.int64)
            cut = int(np.searchsorted(key, key[-1]))
            if cut or (rest and rest[-1]["key"].iloc[-1] != key[0]):
                done = pd.concat([*rest, b.iloc[:cut]], ignore_index=True)
                rest = []
                if len(done) > 1:
                    yield repeats(done, length)
            rest.append(b.iloc[cut:])
        if rest:
            yield repeats(pd.concat(rest, ignore_index=True), length)

    parts = with_bytes.mapInPandas(settle, "doc long, tie long, start long, size long")
    spans = whole.unionByName(parts).groupBy("doc", "tie").agg(F.collect_list(F.struct("start", "size")).alias("spans"))
    spans, _ = save(spans)
    forget(spark, found_path)
    forget(spark, crowd_path)

    def finish(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        z = zstandard.ZstdDecompressor()
        for b in batches:
            rows = []
            for doc_id, text, spans in zip(b["doc_id"], b["text"], b["spans"], strict=True):
                text = z.decompress(text)
                kept, merged = text, []
                for s, e in sorted((r["start"], r["start"] + r["size"]) for r in (spans if spans is not None else ())):
                    if merged and s <= merged[-1][1]:
                        merged[-1][1] = max(merged[-1][1], e)
                    else:
                        merged.append([s, e])
                if merged:
                    ends = [0, *(e for _, e in merged)]
                    kept = b"".join(text[a:s] for a, s in zip(ends, [*(s for s, _ in merged), len(text)], strict=True))
                rows.append((doc_id, len(text), len(text) - len(kept), len(merged), hashlib.sha256(kept).hexdigest(), kept))
            out = pd.DataFrame(rows, columns=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])
            yield out

    every = packed.join(spans, ["doc", "tie"], "left").select("doc_id", "text", "spans")
    return whole_ids(every.mapInPandas(finish, "doc_id string, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"))


def _repeated(docs: DataFrame) -> bool:
    return bool(docs.groupBy("doc", "tie").count().where("count > 1").limit(1).count())


def op8(spark, sf_dir: str) -> DataFrame:
    """Repeated 100-byte strings out of every whole text of ``documents``: doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    return remove_repeats(table(spark, sf_dir, "documents")).drop("kept")
