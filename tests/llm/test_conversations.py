"""Conversation repair against exhaustive search, a plain dynamic program over strings, and its SQL."""

import hashlib
import itertools
import os
import random
import re
import zlib

import duckdb
import pytest

from quillgrid.llm import conversations as C

PATTERN = re.compile("(s?(ua)+)?")


def exhaustive(firsts, faults, most):
    """The least of the cheapest edits with at most so many insertions, by trying all."""
    best = None
    for kinds in itertools.product("DKR", repeat=len(firsts)):
        for n in range(most + 1):
            for gaps in itertools.combinations_with_replacement(range(len(firsts) + 1), n):
                order = [x for k in range(len(firsts) + 1) for x in ["I"] * gaps.count(k) + ([kinds[k]] if k < len(firsts) else [])]
                free = [i for i, e in enumerate(order) if e in "IR"]
                for roles in itertools.product("ua", repeat=len(free)):
                    named, k, out, cost, ok = dict(zip(free, roles, strict=True)), 0, "", 0, True
                    for i, e in enumerate(order):
                        if e != "I":
                            bad, extra = faults[k] in "bd", faults[k] == "t"
                            ok &= e == "D" or not bad
                            cost += {"D": 3, "K": extra, "R": 2 + extra}[e]
                            out += firsts[k] if e == "K" else ""
                            k += 1
                        else:
                            cost += 2
                        out += named.get(i, "")
                    if ok and PATTERN.fullmatch(out):
                        best = min(best or (99, ""), (cost, "".join(order)))
    return best


def test_edits_are_the_cheapest_and_the_least():
    rng = random.Random(5)
    cases = [("", "")] + [tuple("".join(rng.choice(x) for _ in range(n)) for x in ("suax", "..tbd")) for n in (1, 1, 1, 2, 2, 2, 3, 3, 3) for _ in range(4)]
    for firsts, faults in cases:
        assert (C.costs(firsts, faults, C.LAST)[0], C.walk(firsts, faults, 0, C.LAST, True)[0]) == exhaustive(firsts, faults, 3)


def plain(rows):
    """The contract's row of one conversation's damaged rows (turn, role, text) in order, by whole strings."""
    seen, faults, white = set(), "", " \t\n\v\f\r"
    for _, role, text in rows:
        kept = text.strip(white)
        faults += "b" if not kept else "d" if (role, text) in seen else "." if kept[-1] in ".!?" else "t"
        seen.add((role, text))
    firsts = "".join(r[1][:1] or "\0" for r in rows)
    end = [(0, ""), (4, "II"), (2, "I"), (0, "")]
    for f, bad in zip(reversed(firsts), reversed(faults), strict=True):
        options = []
        for q in range(4):
            x = [(end[q][0] + 3, "D" + end[q][1])]
            if bad not in "bd":
                to = {"s": [1, None, None, None], "u": [2, 2, None, 2], "a": [None, None, 3, None]}.get(f, [None] * 4)[q]
                x += [(end[C.NEXT[q]][0] + 2 + (bad == "t"), "R" + end[C.NEXT[q]][1])] + ([(end[to][0] + (bad == "t"), "K" + end[to][1])] if to is not None else [])
            options.append(min(x))
        for _ in range(3):
            options = [min(options[q], (options[C.NEXT[q]][0] + 2, "I" + options[C.NEXT[q]][1])) for q in range(4)]
        end = options
    cost, audit = end[0]
    lines, k, said = [], 0, 0
    for e in audit:
        if e == "K" and rows[k][1][0] == "s":
            lines.append(f"{rows[k][1]}:{rows[k][2]}")
        elif e != "D":
            role = rows[k][1] if e == "K" else ("user", "assistant")[said % 2]
            lines.append(f"{role}:{'' if e == 'I' else rows[k][2]}")
            said += 1
        k += e != "I"
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    bad = sum(a + b not in ("su", "ua", "au") for a, b in itertools.pairwise(firsts))
    return (gaps, faults.count("b"), faults.count("d"), faults.count("t"), bad, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())


def damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if kind:
            out += [(conv, turn, "user" if kind == 4 else role, "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text)] * (1 + (kind == 3))
    return out


SCHEMA = "conv_id long, turn long, role string, text string, seg string, blk string, CONV string"


def made():
    rng = random.Random(2)
    roles = ["user", "assistant", "user", "assistant", "system", "tool", "", None]
    rows = [(k % 30, k // 30, rng.choice(roles), rng.choice(["Yes.", "No", "Why?", "", None, " \n", "a b c.\t", f"Number {k}.", "é ü."])) for k in range(300)]
    rows += [(99, n, rng.choice(roles), f"Long {n % 700}.") for n in range(2000)] + [(98, None, "user", "No turn."), (None, 1, "user", "No id."), (None, 2, "assistant", "None.")]
    return rows + [(97, 4, "user", "x" * 300_000 + "."), (97, 9, "assistant", "Far.")]


def check(got, rows):
    want = {}
    for conv, turn, role, text in damaged(rows):
        want.setdefault(conv, []).append((turn, role, text))
    empty = (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    names = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    assert sorted(str(r["conv_id"]) for r in got) == sorted({str(r[0]) for r in rows})
    for r in got:
        mine = sorted(want.get(r["conv_id"], []), key=lambda x: (x[0] is not None, x[0] or 0))
        assert tuple(r[n] for n in names) == (plain(mine) if mine else empty), r["conv_id"]


def query(spark, rows, tmp_path, extra=("x", "y", "z")):
    path = str(tmp_path / "conversations.parquet")
    spark.createDataFrame([(*r, *extra) for r in rows], SCHEMA).repartition(5).write.parquet(path)
    return C.op12(spark, str(tmp_path))


@pytest.mark.parametrize("block", [7, 1024])
def test_repair_of_long_and_odd_conversations(spark, tmp_path, monkeypatch, block):
    monkeypatch.setattr(C.repair, "__defaults__", (block,))
    check(query(spark, made(), tmp_path).collect(), made())


def test_repair_of_nothing_and_of_equal_turns(spark, tmp_path):
    assert query(spark, [], tmp_path / "a").count() == 0
    rows = [(1, 1, "user", "Same."), (1, 1, "user", "Same."), (1, None, None, None), (2, 5, "assistant", "B."), (2, 5, "assistant", "B.")]
    check(query(spark, rows, tmp_path / "b").collect(), rows)


def test_repair_equals_sql(spark, sf):
    con = duckdb.connect()
    path = f"{sf}/conversations.parquet"
    con.sql(f"CREATE VIEW conversations AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    got, want = C.op12(spark, sf).toPandas(), con.sql(C.OP12_SQL).df()
    pick = lambda f: sorted(map(tuple, f[sorted(f.columns)].astype(object).values.tolist()))
    assert sorted(got.columns) == sorted(want.columns) and pick(got) == pick(want)
