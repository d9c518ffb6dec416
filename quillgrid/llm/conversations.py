"""Conversation structure repair: the cheapest edits that make the roles of a conversation take turns.

Roles have to read ``(s?(ua)+)?`` (an optional system turn, then user and assistant in turn).  Every
row is kept, given another role or deleted, and empty rows may be inserted; the cheapest edits are
found by dynamic programming over rows and the four states of that pattern.  Costs are computed
backwards, so that walking forwards can take the least letter that is still cheapest; of the backward
vectors only those at every square root of the length are stored, and the block under the walk is
computed again.

Rows are put in order by ranges, so a long conversation lies in several tasks.  A conversation that a
task holds whole is repaired where it is read.  Any other goes by blocks of rows, which are checkpoints
of the same kind: a block is a table of costs from state to state, a chain over blocks gives each
block the costs behind it, blocks are walked from every state, and a second chain picks the walk.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from math import isqrt

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import save, table

#: Rows of a block, and the most rows of a conversation that is repaired where it is read.
BLOCK = 1024
#: White space, and signs that end a sentence.
BLANKS, ENDS = " \t\n\v\f\r", ".!?"
#: Costs of giving another role, deleting, inserting, and leaving a row cut short.
REROLE, DELETE, INSERT, CUT = 2, 3, 2, 1
#: States: nothing yet, after system, after user, after assistant.  The state that a role that may come next leads to, and that role.
NEXT, ROLE = (2, 2, 3, 2), ("user", "user", "assistant", "user")
#: States that keeping a row of an initial leads to.
KEEP = {"s": (1, None, None, None), "u": (2, 2, None, 2), "a": (None, None, 3, None)}
NOWHERE = (None, None, None, None)
FAR = 1 << 60
#: Costs behind the last row: an assistant or nothing may end, other states need inserted rows.
LAST = (0, 2 * INSERT, INSERT, 0)

Vector = tuple[int, int, int, int]


def fault(text: str) -> str:
    """``b`` for a blank text, ``t`` for one that is cut short, else ``.``."""
    kept = text.rstrip(BLANKS)
    return "b" if not kept else "." if kept[-1] in ENDS else "t"


def before(role: str, fault: str, after: Vector) -> Vector:
    """Costs in front of a row, from those behind it."""
    out = [DELETE + c for c in after]
    if fault not in "bd":
        extra, keep = (CUT if fault == "t" else 0), KEEP.get(role, NOWHERE)
        for q in range(4):
            out[q] = min(out[q], REROLE + extra + after[NEXT[q]])
            if keep[q] is not None:
                out[q] = min(out[q], extra + after[keep[q]])
    out[2] = min(out[2], INSERT + out[3])
    out[3] = min(out[3], INSERT + out[2])
    out[0], out[1] = min(out[0], INSERT + out[2]), min(out[1], INSERT + out[2])
    return tuple(out)


def costs(roles: str, faults: str, end: Vector) -> Vector:
    """Costs in front of all rows (initials ``roles``), from those behind them."""
    for role, f in zip(reversed(roles), reversed(faults), strict=True):
        end = before(role, f, end)
    return end


def walk(roles: str, faults: str, state: int, end: Vector, last: bool) -> tuple[str, int]:
    """The least of the cheapest edits from ``state`` on, and the state after them; ``last``: no row follows.

    Vectors are stored at every square root of the length and computed again in between.
    """
    n = len(roles)
    hop = isqrt(n) + 1
    marks = [end]
    for lo in range((n - 1) // hop * hop, -1, -hop):
        marks.append(costs(roles[lo : lo + hop], faults[lo : lo + hop], marks[-1]))
    marks.reverse()
    out = []
    for block, lo in enumerate(range(0, n, hop)):
        hi = min(n, lo + hop)
        vectors = [marks[block + 1]]
        for k in range(hi - 1, lo - 1, -1):
            vectors.append(before(roles[k], faults[k], vectors[-1]))
        vectors.reverse()
        for k in range(lo, hi):
            here, after = vectors[k - lo], vectors[k - lo + 1]
            extra, keep = (CUT if faults[k] == "t" else 0), KEEP.get(roles[k], NOWHERE)
            while True:
                if here[state] == DELETE + after[state]:
                    out.append("D")
                elif here[state] == INSERT + here[NEXT[state]]:
                    out.append("I")
                    state = NEXT[state]
                    continue
                elif keep[state] is not None and here[state] == extra + after[keep[state]]:
                    out.append("K")
                    state = keep[state]
                else:
                    out.append("R")
                    state = NEXT[state]
                break
    while last and state in (1, 2):
        out.append("I")
        state = NEXT[state]
    return "".join(out), state


def apply_edits(edits: str, state: int, roles: list[str], texts: list[str]) -> tuple[list[str], list[str]]:
    """Roles and texts after the edits."""
    new_roles, new_texts, k = [], [], 0
    for e in edits:
        if e in "RI":
            new_roles.append(ROLE[state])
            new_texts.append(texts[k] if e == "R" else "")
            state = NEXT[state]
        elif e == "K":
            new_roles.append(roles[k])
            new_texts.append(texts[k])
            state = KEEP[roles[k][:1]][state]
        k += e != "I"
    return new_roles, new_texts


def initials(roles: list[str]) -> str:
    """The first character of each role; of an empty one a character that no role begins with."""
    return "".join(r[:1] or "\0" for r in roles)


def illegal(firsts: str) -> int:
    return sum(a + b not in ("su", "ua", "au") for a, b in zip(firsts, firsts[1:], strict=False))


def damage(conversations: DataFrame) -> DataFrame:
    """Rows (conv, turn, role, text, alive) with faults put in by a checksum of ``conv_id:turn``: one in twenty each is dropped (``alive``
    false), emptied, freed of its sentence ends, repeated, or given to the user.  ``conv`` is the id as text; nulls count as one space."""
    ids = [F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")]
    kind = F.crc32(F.concat(ids[0], F.lit(":"), ids[1])) % 20
    text, role = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("text", "role"))
    return conversations.select(
        F.col("conv_id").cast("string").alias("conv"), F.col("turn").cast("long").alias("turn"), F.when(kind == 4, "user").otherwise(role).alias("role"),
        F.when(kind == 1, "").when(kind == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"), (kind != 0).alias("alive"),
        F.explode(F.when(kind == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"),
    ).drop("copy")


PART = (
    "conv string, seg long, blk long, roles array<string>, texts array<string>, keys array<string>, faults string, "
    "audit string, cost long, blank long, duplicate long, truncated long, illegal long"
)
NAMES = [c.split()[0] for c in PART.split(", ")]


def _reader(limit: int):
    """Ordered rows to repaired conversations, and to blocks of those that may go on in another task or are long.

    Of a conversation the task holds a block's rows, and 16 bytes for each different row.
    """

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seg, now, out = TaskContext.get().partitionId(), None, []
        roles, texts, keys, faults, seen = [], [], [], [], set()
        blk, whole = 0, False  # whether the conversation began in this task behind another one

        def block() -> list:
            return [now, seg, blk, roles, texts, keys, "".join(faults), None, None, None, None, None, None]

        def finished() -> list:
            firsts, f = initials(roles), "".join(faults)
            edits, _ = walk(firsts, f, 0, LAST, True)
            new_roles, new_texts = apply_edits(edits, 0, roles, texts)
            return [now, None, 0, new_roles, new_texts, None, f, edits, costs(firsts, f, LAST)[0], f.count("b"), f.count("d"), f.count("t"), illegal(firsts)]

        def frame() -> pd.DataFrame:
            columns = list(zip(*out, strict=True))
            whole_numbers = {"seg", "blk", "cost", "blank", "duplicate", "truncated", "illegal"}
            return pd.DataFrame({n: pd.array(c, dtype="Int64") if n in whole_numbers else pd.Series(c, dtype=object) for n, c in zip(NAMES, columns, strict=True)})

        held = 0
        for b in batches:
            for conv, role, text in zip(b["conv"], b["role"], b["text"], strict=True):
                conv = conv if isinstance(conv, str) else None
                if not texts and now is None and not seen and not blk:
                    now = conv
                elif conv != now:
                    if texts:
                        out.append(finished() if whole and not blk else block())
                    now, roles, texts, keys, faults, seen, blk, whole = conv, [], [], [], [], set(), 0, True
                elif len(texts) == limit:
                    out.append(block())
                    roles, texts, keys, faults, blk = [], [], [], [], blk + 1
                f, key = fault(text), hashlib.blake2b(f"{len(role)}:{role}{text}".encode(), digest_size=16).digest()
                if f != "b" and key in seen:
                    f = "d"
                seen.add(key)
                roles.append(role)
                texts.append(text)
                keys.append(key.hex())
                faults.append(f)
                held += len(text)
                if len(out) >= 256 or held > 1 << 24 and out:
                    yield frame()
                    out, held = [], 0
        if texts:
            out.append(block())
        if out:
            yield frame()

    return read


def _same(names: tuple[str, ...], a: DataFrame, b: DataFrame) -> Column:
    """Equal in all of the columns; nulls are equal to nulls."""
    cond = F.lit(True)
    for n in names:
        cond = cond & a[n].eqNullSafe(b[f"_{n}"])
    return cond


def _beside(a: DataFrame, b: DataFrame, names: tuple[str, ...], how: str = "left") -> DataFrame:
    """``a`` joined with the further columns of ``b`` (one row a key) by null-safe equality."""
    right = b.withColumnsRenamed({n: f"_{n}" for n in names})
    return a.join(right, _same(names, a, right), how).drop(*[f"_{n}" for n in names])


def _matrices(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Costs of each block from every state to every state."""
    for b in batches:
        rows = []
        for conv, seg, blk, roles, faults in zip(b["conv"], b["seg"], b["blk"], b["roles"], b["faults"], strict=True):
            firsts = initials(list(roles))
            ends = [costs(firsts, faults, tuple(0 if r == k else FAR for r in range(4))) for k in range(4)]
            flat = [ends[r][q] for q in range(4) for r in range(4)]
            rows.append((conv, seg, blk, flat, firsts[0], firsts[-1], faults.count("b"), faults.count("d"), faults.count("t"), illegal(firsts)))
        yield pd.DataFrame(rows, columns=["conv", "seg", "blk", "flat", "first", "last", "blank", "duplicate", "truncated", "illegal"])


def _behind(blocks: pd.DataFrame) -> pd.DataFrame:
    """The costs behind each block of one conversation, and its figures."""
    blocks = blocks.sort_values(["seg", "blk"], kind="stable").reset_index(drop=True)
    end, ends = LAST, []
    for flat in reversed(blocks["flat"].tolist()):
        ends.append(list(end))
        end = tuple(min(flat[4 * q + r] + end[r] for r in range(4)) for q in range(4))
    seams = sum(a + b not in ("su", "ua", "au") for a, b in zip(blocks["last"], blocks["first"].iloc[1:], strict=False))
    out = blocks[["conv", "seg", "blk"]].assign(end=ends[::-1], is_last=[False] * (len(blocks) - 1) + [True])
    for n in ("blank", "duplicate", "truncated", "illegal"):
        out[n] = [int(blocks[n].sum()) + (seams if n == "illegal" else 0)] + [0] * (len(blocks) - 1)
    return out.assign(cost=[int(end[0])] + [0] * (len(blocks) - 1))


def _walks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Each block walked from every state."""
    for b in batches:
        rows = []
        for conv, seg, blk, roles, faults, end, is_last in zip(b["conv"], b["seg"], b["blk"], b["roles"], b["faults"], b["end"], b["is_last"], strict=True):
            found = [walk(initials(list(roles)), faults, q, tuple(int(c) for c in end), bool(is_last)) for q in range(4)]
            rows.append((conv, seg, blk, [e for e, _ in found], [q for _, q in found]))
        yield pd.DataFrame(rows, columns=["conv", "seg", "blk", "edits", "exits"])


def _entries(blocks: pd.DataFrame) -> pd.DataFrame:
    """The state in which each block of one conversation is entered."""
    blocks = blocks.sort_values(["seg", "blk"], kind="stable")
    state, states = 0, []
    for exits in blocks["exits"]:
        states.append(state)
        state = int(exits[state])
    return blocks[["conv", "seg", "blk"]].assign(entry=states)


def _applied(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        done = [apply_edits(e[q], q, list(r), list(t)) for e, q, r, t in zip(b["edits"], b["entry"], b["roles"], b["texts"], strict=True)]
        yield b[["conv", "seg", "blk"]].assign(roles=[r for r, _ in done], texts=[t for _, t in done], audit=[e[q] for e, q in zip(b["edits"], b["entry"], strict=True)])


def repair(rows: DataFrame, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """(repaired, report) of rows (conv string, turn long, role string, text string), none of role and text null.

    ``repaired``: conv, seg, blk, roles, texts, audit; a conversation's rows in pieces of at most ``block`` rows and what is inserted, in the order of
    (seg, blk).  ``report``: one row a conversation: conv, blank, duplicate, truncated, illegal, cost.  Rows go by turn, nulls first; ties
    go by role, then by a hash of the text.  A null ``conv`` is a conversation of its own.  A row is blank, else a duplicate of an
    earlier one in role and text, else cut short; blank rows and duplicates must go.  Of the cheapest edits the ASCII-least letters are
    taken.  A role that is empty or begins with another letter than s, u and a cannot be kept.  An empty table gives empty results;
    other columns are ignored.  A conversation with a third of all rows lies in many tasks; what a single task holds of it is 16 numbers
    for every block.
    """
    spark = rows.sparkSession
    order = ["conv", "turn", "role", F.xxhash64("text")]
    arranged = rows.select("conv", "turn", "role", "text").repartitionByRange(*order).sortWithinPartitions(*order)
    parts, _ = save(arranged.select("conv", "role", "text").mapInPandas(_reader(block), PART))
    blocks, key = parts.where("audit IS NULL"), ("conv", "seg", "blk")
    # Duplicates over several tasks: within a task each different row stands once by now.
    at = blocks.select(*key, F.posexplode("keys").alias("pos", "key"), F.col("faults"))
    firsts = at.where(~F.substring("faults", F.col("pos") + 1, F.lit(1)).isin("b", "d")).drop("faults")
    shared = firsts.groupBy("conv", "key").agg(F.min("seg").alias("seg0"), F.count("*").alias("n")).where("n > 1").drop("n")
    late = _beside(firsts, shared, ("conv", "key"), "inner").where("seg > seg0").groupBy(*key).agg(F.collect_set("pos").alias("late"))
    marked = _beside(blocks.select(*key, "roles", "texts", "faults"), late, key)
    signs = F.transform(F.sequence(F.lit(0), F.length("faults") - 1), lambda p: F.when(F.array_contains("late", p), "d").otherwise(F.substring("faults", p + 1, F.lit(1))))
    marked, _ = save(marked.withColumn("faults", F.when(F.col("late").isNull(), F.col("faults")).otherwise(F.concat_ws("", signs))).drop("late"))
    plain = marked.drop("texts")
    key_type = "conv string, seg long, blk long"
    figures = "blank long, duplicate long, truncated long, illegal long"
    chained = plain.mapInPandas(_matrices, f"{key_type}, flat array<long>, first string, last string, {figures}")
    chained, _ = save(chained.groupBy("conv").applyInPandas(_behind, f"{key_type}, end array<long>, is_last boolean, {figures}, cost long"))
    walked, _ = save(_beside(plain, chained.select(*key, "end", "is_last"), key, "inner").mapInPandas(_walks, f"{key_type}, edits array<string>, exits array<int>"))
    entered = walked.select(*key, "exits").groupBy("conv").applyInPandas(_entries, f"{key_type}, entry int")
    picked = _beside(_beside(marked, walked.select(*key, "edits"), key, "inner"), entered, key, "inner")
    by_blocks = picked.mapInPandas(_applied, f"{key_type}, roles array<string>, texts array<string>, audit string")
    whole = parts.where("audit IS NOT NULL")
    names = ["blank", "duplicate", "truncated", "illegal", "cost"]
    report = whole.select("conv", *names).unionByName(chained.groupBy("conv").agg(*[F.sum(n).alias(n) for n in names]))
    return whole.select(*key, "roles", "texts", "audit").unionByName(by_blocks), report


def _digests(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """SHA-256 of conversations whose pieces come in order; pieces stream, as this hash can only be taken in order."""
    now, state, audit, begun = None, None, [], False

    def out() -> pd.DataFrame:
        return pd.DataFrame({"conv": [now], "audit": ["".join(audit)], "repaired_sha256": [state.hexdigest()]})

    for b in batches:
        for conv, roles, texts, edits in zip(b["conv"], b["roles"], b["texts"], b["audit"], strict=True):
            conv = conv if isinstance(conv, str) else None
            if state is None or conv != now:
                if state is not None:
                    yield out()
                now, state, audit, begun = conv, hashlib.sha256(), [], False
            audit.append(edits)
            for r, t in zip(roles, texts, strict=True):
                state.update((("\n" if begun else "") + f"{r}:{t}").encode())
                begun = True
    if state is not None:
        yield out()


def digest(repaired: DataFrame) -> DataFrame:
    """(conv, audit, repaired_sha256): all edits of a conversation, and the hash of its repaired rows ``role:text`` on lines."""
    single = repaired.where("seg IS NULL")
    lines = F.concat_ws("\n", F.zip_with("roles", "texts", lambda r, t: F.concat(r, F.lit(":"), t)))
    at_once = single.select("conv", "audit", F.sha2(lines, 256).alias("repaired_sha256"))
    pieces = repaired.where("seg IS NOT NULL").repartition("conv").sortWithinPartitions("conv", "seg", "blk")
    return at_once.unionByName(pieces.mapInPandas(_digests, "conv string, audit string, repaired_sha256 string"))


def op12(spark, sf_dir: str) -> DataFrame:
    """All ``conversations``, damaged and repaired: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256.

    ``gaps`` counts the turns that are missing between the first and the last one; rows without a turn do not count.  Of a conversation
    with no rows left all figures are 0 and the texts empty.
    """
    damaged = damage(table(spark, sf_dir, "conversations"))
    repaired, report = repair(damaged.where("alive"))
    turns = damaged.groupBy("conv", "turn").agg(F.max("alive").alias("alive"))
    turn = F.when(F.col("alive"), F.col("turn"))
    convs = turns.groupBy("conv").agg(F.coalesce(F.max(turn) - F.min(turn) + 1 - F.count(turn), F.lit(0)).cast("long").alias("gaps"))
    out = _beside(_beside(convs, report, ("conv",)), digest(repaired), ("conv",))
    numbers = [F.coalesce(n, F.lit(0)).cast("long").alias(n) for n in ("blank", "duplicate", "truncated", "illegal", "cost")]
    return out.select(
        F.col("conv").cast("long").alias("conv_id"), "gaps", *numbers, F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"),
    )


def _step(row: str) -> str:
    """SQL of the four states' least edits (nine digits of cost, then letters) in front of a row, from those behind it."""
    def put(letter: str, cost: str, state: str) -> str:
        return f"printf('%09d', CAST(substr({state}, 1, 9) AS INTEGER) + {cost}) || '{letter}' || substr({state}, 10)"

    out = []
    keep = [{"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2}]
    for q in range(4):
        rows = [put("D", str(DELETE), f"s{q}"), f"CASE WHEN {row}.fault < 2 THEN {put('R', f'{REROLE} + {row}.fault', f's{NEXT[q]}')} END"]
        rows += [f"CASE WHEN {row}.fault < 2 AND {row}.first = '{c}' THEN {put('K', f'{row}.fault', f's{to}')} END" for c, to in keep[q].items()]
        out.append(f"least({', '.join(rows)}) AS b{q}")
    return ", ".join(out)


def _inserted() -> str:
    put = lambda s: f"printf('%09d', CAST(substr({s}, 1, 9) AS INTEGER) + {INSERT}) || 'I' || substr({s}, 10)"
    return f"least(b0, {put('b2')}, {put(put('b3'))}) AS s0, least(b1, {put('b2')}, {put(put('b3'))}) AS s1, least(b2, {put('b3')}) AS s2, least(b3, {put('b2')}) AS s3"


OP12_SQL = rf"""WITH RECURSIVE crc AS (SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(CAST(i AS BIGINT), list_transform(range(8), lambda z: CAST(z AS BIGINT))),
    lambda c, z: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
src AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS k FROM conversations),
kinds AS (SELECT src.*, xor(4294967295, list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(k, ''), lambda x: CAST(ascii(x) AS BIGINT))),
    lambda c, b: xor(c >> 8, t[xor(c, b) % 256 + 1]))) % 20 AS kind FROM src, crc),
rows_ AS (SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
    CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(CASE WHEN kind = 3 THEN [0, 1] ELSE [0] END) AS copy FROM kinds WHERE kind <> 0),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS n FROM rows_),
seen AS (SELECT *, left(role, 1) AS first, lead(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY n) AS next_first,
    CASE WHEN regexp_full_match(text, '[\x20\x09-\x0D]*') THEN 2 WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY n) > 1 THEN 3
      WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*\z') THEN 1 ELSE 0 END AS fault FROM placed),
sums AS (SELECT conv_id, max(n) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 2) AS blank, count(*) FILTER (fault = 3) AS duplicate,
    count(*) FILTER (fault = 1) AS truncated, count(*) FILTER (next_first IS NOT NULL AND first || next_first NOT IN ('su', 'ua', 'au')) AS illegal FROM seen GROUP BY conv_id),
best AS (SELECT conv_id, n, '000000000' AS s0, '00000000' || '4II' AS s1, '00000000' || '2I' AS s2, '000000000' AS s3 FROM sums
  UNION ALL SELECT conv_id, n, {_inserted()} FROM (SELECT b.conv_id, b.n - 1 AS n, {_step('r')}
    FROM best b JOIN seen r ON r.conv_id IS NOT DISTINCT FROM b.conv_id AND r.n = b.n)),
plan AS (SELECT conv_id, CAST(substr(s0, 1, 9) AS BIGINT) AS cost, substr(s0, 10) AS audit FROM best WHERE n = 0),
letters AS (SELECT conv_id, unnest(string_split(audit, '')) AS e, unnest(range(1, length(audit) + 1)) AS p FROM plan WHERE audit <> ''),
put AS (SELECT conv_id, p, e, count(*) FILTER (e <> 'I') OVER (PARTITION BY conv_id ORDER BY p) AS n FROM letters),
held AS (SELECT put.conv_id, p, e, role, text, row_number() OVER (PARTITION BY put.conv_id ORDER BY p) - max(CASE WHEN e = 'K' AND first = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY put.conv_id) AS turn_
    FROM put LEFT JOIN seen r ON r.conv_id IS NOT DISTINCT FROM put.conv_id AND r.n = put.n WHERE e <> 'D'),
texts AS (SELECT conv_id, string_agg(CASE WHEN e = 'K' THEN role WHEN turn_ % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || CASE WHEN e = 'I' THEN '' ELSE text END, chr(10) ORDER BY p) AS body
    FROM held GROUP BY conv_id)
SELECT c.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
    coalesce(cost, 0) AS cost, coalesce(audit, '') AS audit, sha256(coalesce(body, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN sums s ON s.conv_id IS NOT DISTINCT FROM c.conv_id
LEFT JOIN plan p ON p.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN texts t ON t.conv_id IS NOT DISTINCT FROM c.conv_id"""
