"""Structure repair against a search over all edit strings."""

import hashlib
import heapq
import random
import re
import zlib
from itertools import pairwise

import pytest

from terraflux.llm import queries, structure

GRAMMAR = re.compile(r"(s?(ua)+)?")
BLANK = re.compile(r"[^\x20\x09-\x0D]")


def damage(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        k = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if k == 1 else re.sub(r"[.!?]", "", text) if k == 2 else text
        out += [(conv, turn, "user" if k == 4 else role, text)] * (0 if k == 0 else 2 if k == 3 else 1)
    return out


def faults(turns):
    seen, out = set(), []
    for _, role, text in turns:
        marks = BLANK.findall(text)
        out.append("blank" if not marks else "duplicate" if (role, text) in seen else "truncated" if marks[-1] not in ".!?" else None)
        seen.add((role, text))
    return out


def cheapest(turns, found):
    """Dijkstra over (turns read, initials' state by the pattern itself), paths ordered by cost, then edits."""
    heap, done = [(0, "", 0, "", ())], set()
    while heap:
        cost, audit, i, initials, lines = heapq.heappop(heap)
        short = initials if len(initials) < 3 else initials[:1].replace("u", "").replace("a", "") + ("ua" if initials[-1] == "a" else "uau")
        if i == len(turns) and GRAMMAR.fullmatch(initials):
            return cost, audit, lines
        if (i, short) in done:
            continue
        done.add((i, short))
        legal = lambda x: any(GRAMMAR.fullmatch(x + more) for more in ("", "a", "ua"))
        steps = [(3, "I", i, r, f"{r}:") for r in ("user", "assistant")]
        if i < len(turns):
            _, role, text = turns[i]
            steps.append((4, "D", i + 1, None, None))
            if found[i] not in ("blank", "duplicate"):
                late = 3 * (found[i] == "truncated")
                steps.append((late, "K", i + 1, role, f"{role}:{text}"))
                steps += [(3 + late, "R", i + 1, r, f"{r}:{text}") for r in ("user", "assistant")]
        for more, edit, j, role, line in steps:
            after = initials + (role[:1] if role is not None else "")
            if role is None or (role[:1] and legal(after)):
                heapq.heappush(heap, (cost + more, audit + edit, j, after, lines if line is None else (*lines, line)))


def expected(rows):
    out = []
    key = lambda r: (r[1] is not None, r[1] or 0, r[2], r[3])
    after = damage(rows)
    for conv in {r[0] for r in rows}:
        turns = [(t, r, x) for c, t, r, x in sorted((r for r in after if r[0] == conv), key=key)]
        found = faults(turns)
        cost, audit, lines = cheapest(turns, found)
        known = {t for t, _, _ in turns if t is not None}
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in pairwise(turns))
        out.append((conv, max(known) - min(known) + 1 - len(known) if known else 0, found.count("blank"), found.count("duplicate"), found.count("truncated"), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return sorted(out, key=lambda r: (r[0] is not None, r[0] or 0))


COLUMNS = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def got(frame):
    return sorted((tuple(r[c] for c in COLUMNS) for r in frame.collect()), key=lambda r: (r[0] is not None, r[0] or 0))


def test_query_against_brute_force(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    out = queries.op13_structure(spark, sf)
    assert set(out.columns) == set(COLUMNS)
    assert got(out) == expected(rows)


def test_odd_conversations_against_brute_force(spark):
    draw = random.Random(13)
    roles = ["system", "user", "assistant", "user", "assistant", "tool", "", None]
    texts = ["Well.", "Well.", "cut off", "", " \t", None, "Why? ", "x!\n", "no end)", "long " * 3000 + "."]
    rows = []
    for conv in [None, *range(120)]:
        for t in draw.sample(range(40), draw.randrange(1, 12)):
            rows.append((conv, t, draw.choice(roles), draw.choice(texts)))
        if draw.random() < 0.3:
            rows.append((conv, None, draw.choice(roles), draw.choice(texts)))
    frame = spark.createDataFrame([(*r, "x", "y", "z") for r in rows], "conv_id long, turn long, role string, text string, digest string, kind string, cost string")
    assert got(structure.report(structure.damaged(frame), frame)) == expected(rows)


@pytest.mark.parametrize("seed", range(6))
def test_walk_is_least_of_the_cheapest(seed):
    draw = random.Random(seed)
    for _ in range(60):
        turns = [(k, draw.choice(["system", "user", "assistant", "tool"]), draw.choice([f"t{k}.", f"t{k}", "", "same."])) for k in range(draw.randrange(0, 9))]
        found = faults(turns)
        initials = ["s", "u", "a", ""]
        codes = bytearray(4 * initials.index(r[:1] if r[:1] in "sua" else "") + (1 if f in ("blank", "duplicate") else 2 if f else 0) for (_, r, _), f in zip(turns, found, strict=True))
        cost, audit, _ = cheapest(turns, found)
        assert structure.walk(codes, initials) == (audit, cost)


def test_copies_and_nothing(spark):
    schema = "conv_id long, turn long, role string, text string"
    frame = spark.createDataFrame([(1, 0, "user", "Hi.")] * 5 + [(1, 1, "assistant", "Ho.")] * 3 + [(2, None, None, None)], schema)
    rows = {r.conv_id: r for r in structure.report(frame, frame).collect()}
    assert (rows[1].duplicate, rows[1].audit, rows[1].cost, rows[1].illegal) == (6, "KDDDDKDD", 24, 6)
    assert rows[1].repaired_sha256 == hashlib.sha256(b"user:Hi.\nassistant:Ho.").hexdigest()
    assert (rows[2].blank, rows[2].audit, rows[2].gaps) == (1, "D", 0)
    assert [tuple(r) for r in structure.repair(frame).orderBy("conv_id", "seq").collect()] == [(1, 0, "user", "Hi."), (1, 1, "assistant", "Ho.")]
    none = frame.where("false")
    assert structure.report(none, none).collect() == []
    gone = structure.report(none, frame).where("conv_id = 2").first()
    assert (gone.gaps, gone.blank, gone.cost, gone.audit, gone.repaired_sha256) == (0, 0, 0, "", hashlib.sha256(b"").hexdigest())


def test_one_long_conversation(spark):
    frame = spark.range(20_000).selectExpr("7L as conv_id", "id as turn", "if(id % 2 = 0, 'user', 'assistant') as role", "if(id % 10 = 3, 'cut', concat('t', id, '.')) as text")
    row = structure.report(frame, frame).first()
    assert (row.gaps, row.truncated, row.duplicate, row.illegal) == (0, 1, 1999, 0)
    assert structure.repair(frame).count() == len(row.audit.replace("D", ""))
