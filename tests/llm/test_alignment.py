"""Alignment of tokenizers against a plain computation with the tokenizer files themselves."""

import base64
import hashlib
import json
import random
import re
from collections import Counter

import numpy as np
import public_tokenizers as P
import pytest
import sentencepiece
from tokenizers import Tokenizer

from quillgrid.llm import alignment as A

SCHEMA = "doc_id long, text string, pairs string, row string, N string"


def test_cuts_are_all_common_ends():
    rng = np.random.default_rng(3)
    for n in range(300):
        last = int(rng.integers(1, 400))
        a, b = (np.unique(np.append(rng.integers(1, last + 1, int(rng.integers(1, 200))), last)) for _ in range(2))
        if n % 5 == 0:  # no common end but the last
            b = np.append(np.setdiff1d(b, a), last)
        common = np.intersect1d(a, b)
        shared = np.unique(np.append(rng.choice(common, len(common) // 3), last))
        assert (A.cuts(a, b, shared) == common).all()


def byte_letters():
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    return {chr(b): b for b in shown} | {chr(256 + n): b for n, b in enumerate(b for b in range(256) if b not in shown)}


def brute(rows):
    a = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    letters = byte_letters()
    with open(P.path("byte_bpe_50k.json")) as f:
        entry = {v: bytes(letters[c] for c in k) for k, v in json.load(f)["model"]["vocab"].items() if v != 50256}
    ends, out = {}, []
    for n, (_, text) in enumerate(rows):
        x = a.encode(" " + text, add_special_tokens=False).ids if text else []
        y = b.encode(text) if text else []
        pieces = [b.id_to_piece(k) for k in y]
        ya = [bytes([int(p[3:5], 16)]) if re.fullmatch("<0x..>", p) else p.replace("▁", " ").encode() for p in pieces]
        xa = [entry[k] for k in x]
        if not text or b"".join(xa) != (" " + text).encode() or b"".join(ya) != (" " + text).encode():
            x, y, xa, ya = [], [], [], []
        ends[n] = [(ids, np.cumsum([0, *map(len, tokens)]).tolist()) for ids, tokens in ((x, xa), (y, ya))]
    count, links = Counter(), {}
    for n, ((x, xe), (y, ye)) in ends.items():
        links[n], j = [], 0
        for i in range(len(x)):
            while j and ye[j] > xe[i]:
                j -= 1
            while ye[j + 1] <= xe[i]:
                j += 1
            k = j
            while k < len(y) and ye[k] < xe[i + 1]:
                links[n].append((x[i], y[k]))
                k += 1
        count.update(links[n])
    best = {}
    for (_, y), m in count.items():
        best[y] = max(best.get(y, 0), m)
    for n, ((x, xe), (y, ye)) in ends.items():
        cuts, parts, i, j = sorted(set(xe[1:]) & set(ye[1:])), [], 0, 0
        for c in cuts:
            lo_i, lo_j = i, j
            while i < len(x) and xe[i + 1] <= c:
                i += 1
            while j < len(y) and ye[j + 1] <= c:
                j += 1
            parts.append(",".join(map(str, x[lo_i:i])) + "|" + ",".join(map(str, y[lo_j:j])))
        hashed = hashlib.sha256(";".join(parts).encode()).hexdigest() if x else ""
        out.append((rows[n][0], len(x), len(y), len(cuts), len(links[n]), sum(count[p] == best[p[1]] for p in links[n]), sum(count[p] for p in links[n]), hashed))
    return sorted(out, key=str)


def made(sf_text):
    rng = random.Random(7)
    letters = "aAbB éüß日本語🙂\t\n 　.,!?'019<|>▁\x00\x7f﻿ﬁ"
    odd = ["", None, "<|endoftext|>", "a <|endoftext|> b<|endoftext|>", "<s> </s> <unk> <0x41>", "▁", " ", "  two  spaces ", "\x00", "ﬁ", "é", "é", "x" * 3000, "ab" * 50_000 + " end"]
    odd += ["".join(rng.choice(letters) for _ in range(rng.randrange(1, 60))) for _ in range(150)]
    texts = odd + sf_text + sf_text[:5] + ["the same words here"] * 40
    return [(None if k % 37 == 36 else k, t) for k, t in enumerate(texts)] + [(1, "repeated row"), (1, "repeated row")]


@pytest.mark.parametrize("broadcast", [1 << 18, 3])
def test_alignment_is_that_of_the_files(spark, sf, broadcast):
    texts = [r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id").limit(25).collect()]
    rows = made(texts)
    df = spark.createDataFrame([(*r, "x", "y", "z") for r in rows], SCHEMA).repartition(4)
    per_doc, pairs = A.alignment(df, broadcast_pairs=broadcast)
    names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    got = sorted((tuple(r[n] for n in names) for r in per_doc.collect()), key=str)
    assert got == brute(rows)
    assert sum(r["n"] for r in pairs.collect()) == sum(r[4] for r in got)


def test_alignment_of_nothing(spark):
    per_doc, pairs = A.alignment(spark.createDataFrame([], SCHEMA))
    assert per_doc.count() == 0 and pairs.count() == 0
    per_doc, pairs = A.alignment(spark.createDataFrame([(1, None, "", "", "")], SCHEMA))
    assert [tuple(r) for r in per_doc.collect()] == [(1, 0, 0, 0, 0, 0, 0, "")] and pairs.count() == 0


def test_rank_file_holds_the_same_tokens():
    letters = byte_letters()
    with open(P.path("byte_bpe_50k.json")) as f:
        vocab = json.load(f)["model"]["vocab"]
    with open(P.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(x): int(y) for x, y in map(bytes.split, f)}
    assert ranks == {bytes(letters[c] for c in k): v for k, v in vocab.items() if v != 50256}
