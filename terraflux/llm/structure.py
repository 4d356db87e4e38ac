"""Operator 13. Conversation structure repair by a backward dynamic programme and a greedy forward walk.

A conversation's turns are edited until the roles' initials read ``(s?(ua)+)?``. Keep
costs 0, a new role (user or assistant) 3, Delete 4, an empty turn inserted 3; blank
turns and repetitions must go, and a truncated turn that stays costs 3 more. Grammar
states are: nothing yet, after s, after u, after a. From the last turn back, the cost to
go is known for each state; walking forward, of the edits whose cost is tight the one
with the ASCII-least initial is taken. An initial leads to one state only, so the walk's
string is the least of all cheapest ones.

Texts are not gathered to decide: turns go to the programme as a few flags and a digest,
sorted by conversation inside hash partitions and read as a stream. Of the conversation
being read some thirty bytes a turn are held; the ``audit`` in the result's row, too, is
in proportion to its turns. Texts meet the edits by a join on the turn's own key, and are hashed
as a sorted stream, one turn at a time. Repetitions are found by an aggregation and a
join, which adaptive execution splits where one turn is repeated very often.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator
from itertools import islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise, trimming

#: Edits by their initials in ASCII order with their costs, and the surcharge of a truncated turn that stays.
COST = {"D": 4, "I": 3, "K": 0, "R": 3}
TRUNCATED = 3
#: Grammar states (0 nothing yet, 1 after s, 2 after u, 3 after a), the way from each by an initial, and the cost to go at the end.
WAY = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
AT_END = (0, 6, 3, 0)
#: The role that may be inserted, or given to a turn, in each state.
ROLE = ("u", "u", "a", "u")
NAMES = {"u": "user", "a": "assistant"}
#: Legal pairs of adjacent initials.
LEGAL = ("su", "ua", "au")
SPACE = " \t\n\x0b\f\r"

KEY = ["conv_id", "turn", "role", "digest"]


def _same(a: DataFrame, b: DataFrame, names: list[str], how: str = "left") -> DataFrame:
    """``a`` joined with ``b`` on columns that may be null; b's copies are dropped."""
    right = b.select(*[F.col(c).alias(f"_{c}") if c in names else F.col(c) for c in b.columns])
    on = None
    for c in names:
        equal = a[c].eqNullSafe(right[f"_{c}"])
        on = equal if on is None else on & equal
    return a.join(right, on, how).drop(*[f"_{c}" for c in names])


def turns_of(rows: DataFrame) -> DataFrame:
    """``conv_id, turn, role, text`` and the text's digest; a null role or text is one space."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("role", "text"))
    known = rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"))
    return known.select("*", F.md5(F.col("text").cast("binary")).alias("digest"))


def _flagged(turns: DataFrame) -> DataFrame:
    """Narrow turns: the key, whether blank or truncated, and whether role and text stood in an earlier turn."""
    last = F.substring(F.rtrim(F.col("text"), F.lit(SPACE)), -1, 1)
    narrow = turns.select(*KEY, (last == "").alias("blank"), (~last.isin(".", "!", "?")).alias("truncated"))
    seen = ["conv_id", "role", "digest"]
    order = F.struct(F.col("turn").isNotNull().alias("known"), "turn")
    first = narrow.groupBy(*seen).agg(F.min(order).alias("first"))
    return _same(narrow, first, seen).select(*KEY, "blank", "truncated", (order > F.col("first")).alias("repeated"))


def walk(codes: bytearray, initials: list[str]) -> tuple[str, int]:
    """The cheapest edits' initials, ASCII-least of the cheapest, and their cost.

    ``codes`` has a byte a turn: 4 for the initial's place in ``initials``, + 1 where it
    must go, + 2 where it is truncated. Two passes, four bytes held a turn.
    """
    after, choice = AT_END, bytearray(4 * len(codes))
    for i in range(len(codes) - 1, -1, -1):
        code = codes[i]
        initial, stay = initials[code >> 2], TRUNCATED if code & 2 else 0
        best, taken = [0] * 4, [""] * 4
        for state in range(4):
            cost, edit = COST["D"] + after[state], "D"
            if not code & 1:
                if initial in WAY[state] and (kept := COST["K"] + stay + after[WAY[state][initial]]) < cost:
                    cost, edit = kept, "K"
                if (other := COST["R"] + stay + after[WAY[state][ROLE[state]]]) < cost:
                    cost, edit = other, "R"
            best[state], taken[state] = cost, edit
        for _ in range(2):  # two turns inserted at most: after them the state repeats
            for state in range(4):
                cost = COST["I"] + best[WAY[state][ROLE[state]]]
                if cost < best[state] or cost == best[state] and taken[state] in "KR":
                    best[state], taken[state] = cost, "I"
        choice[4 * i : 4 * i + 4] = "".join(taken).encode()
        after = tuple(best)
    state, audit = 0, []
    for i, code in enumerate(codes):
        while True:
            edit = chr(choice[4 * i + state])
            audit.append(edit)
            if edit == "K":
                state = WAY[state][initials[code >> 2]]
            elif edit != "D":
                state = WAY[state][ROLE[state]]
            if edit != "I":
                break
    while state in (1, 2):
        audit.append("I")
        state = WAY[state][ROLE[state]]
    return "".join(audit), after[0]


_PLAN = pa.schema([(n, pa.int64()) for n in ("kind", "conv_id", "seq", "turn")] + [(n, pa.string()) for n in ("role", "digest", "new_role", "audit")] + [(n, pa.int64()) for n in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")])
_PLAN_DDL = ", ".join(f"{f.name} {'string' if f.type == pa.string() else 'long'}" for f in _PLAN)


class _Turns:
    """The conversation being read: a code a turn, counts, and the keys of the turns that may stay."""

    def __init__(self, conv_id: int | None):
        self.conv_id, self.codes, self.initials = conv_id, bytearray(), []
        self.count = dict.fromkeys(("blank", "duplicate", "truncated", "illegal"), 0)
        self.distinct, self.low, self.high = 0, None, None
        self.before: tuple | None = None
        self.turns, self.unknown, self.roles, self.digests, self.names = array("q"), bytearray(), array("q"), bytearray(), {}

    def add(self, turn: int | None, role: str, digest: str, blank: bool, truncated: bool, repeated: bool) -> None:
        if turn is not None and turn != self.high:
            self.distinct, self.low, self.high = self.distinct + 1, turn if self.low is None else self.low, turn
        repeated = repeated or self.before == (turn, role, digest)
        fault = "blank" if blank else "duplicate" if repeated else "truncated" if truncated else None
        if fault:
            self.count[fault] += 1
        if self.before is not None and self.before[1][:1] + role[:1] not in LEGAL:
            self.count["illegal"] += 1
        self.before = turn, role, digest
        initial = role[:1] if role[:1] in ("s", "u", "a") else ""
        if initial not in self.initials:
            self.initials.append(initial)
        self.codes.append(4 * self.initials.index(initial) + (1 if blank or repeated else 2 if truncated else 0))
        if not self.codes[-1] & 1:
            self.turns.append(turn or 0)
            self.unknown.append(turn is None)
            self.roles.append(self.names.setdefault(role, len(self.names)))
            self.digests += bytes.fromhex(digest)

    def rows(self) -> Iterator[tuple]:
        """A row of kind 0 (what was found and done), and rows of kind 1 (a turn that stays) and 2 (one put in)."""
        audit, cost = walk(self.codes, self.initials)
        gaps = self.high - self.low + 1 - self.distinct if self.distinct else 0
        yield 0, self.conv_id, *(None,) * 5, audit, gaps, *self.count.values(), cost
        at, may, seq, state, names = 0, 0, 0, 0, list(self.names)
        for edit in audit:
            key: tuple = (None, None, None)
            code = None
            if edit != "I":
                code, at = self.codes[at], at + 1
                if not code & 1:
                    key = None if self.unknown[may] else self.turns[may], names[self.roles[may]], self.digests[16 * may : 16 * may + 16].hex()
                    may += 1
            if edit != "D":
                role = None if edit == "K" else ROLE[state]
                yield 2 if edit == "I" else 1, self.conv_id, seq, *key, role and NAMES[role], *(None,) * 7
                state, seq = WAY[state][role or self.initials[code >> 2]], seq + 1


def _batches(rows: Iterator[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    while out := list(islice(rows, 1 << 14)):
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)


def _planned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The plan's rows of turns sorted by conversation."""
    def rows() -> Iterator[tuple]:
        held = None
        for batch in batches:
            for conv_id, *turn in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held is None or conv_id != held.conv_id:
                    if held is not None:
                        yield from held.rows()
                    held = _Turns(conv_id)
                held.add(*turn)
        if held is not None:
            yield from held.rows()

    return _batches(rows(), _PLAN)


def plan(turns: DataFrame) -> DataFrame:
    """The edits of all conversations, as a written table: rows of kind 0, 1 and 2 (see ``_Turns.rows``)."""
    flagged = _flagged(turns).repartition("conv_id").sortWithinPartitions(F.asc_nulls_first("conv_id"), F.asc_nulls_first("turn"), "role", "digest")
    return materialise(flagged.mapInArrow(trimming(_planned), _PLAN_DDL), "structure-plan")


def repaired(turns: DataFrame, planned: DataFrame) -> DataFrame:
    """``conv_id, seq, role, text`` of the repaired conversations, seq from 0."""
    stays = planned.where("kind = 1").select(*KEY, "seq", "new_role")
    one = turns.groupBy(*KEY).agg(F.any_value("text").alias("text"))  # copies of a turn are one turn: all but one of them go
    texts = _same(stays, one, KEY, "inner").select("conv_id", "seq", F.coalesce("new_role", "role").alias("role"), "text")
    return texts.union(planned.where("kind = 2").select("conv_id", "seq", "new_role", F.lit("")))


def repair(rows: DataFrame) -> DataFrame:
    """The turns of ``rows(conv_id, turn, role, text)`` after repair: ``conv_id, seq, role, text``.

    Turns stand in order of turn (nulls first), those of one turn by role and digest;
    copies of a turn are repetitions. Null roles and texts are one space: such a text is
    blank, such a role can't be kept. A null conv_id is a conversation like any other. Very
    long texts are read whole. Extra columns are ignored, and a table without rows gives none.
    """
    turns = turns_of(rows)
    return repaired(turns, plan(turns))


_HASHED = pa.schema([("conv_id", pa.int64()), ("repaired_sha256", pa.string())])


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A digest of each conversation, from its turns in order, one turn at a time."""
    def rows() -> Iterator[tuple]:
        conv, state = None, None
        for batch in batches:
            for conv_id, role, text in zip(*batch.columns, strict=True):
                if state is None or conv_id.as_py() != conv:
                    if state is not None:
                        yield conv, state.hexdigest()
                    conv, state = conv_id.as_py(), hashlib.sha256()
                else:
                    state.update(b"\n")
                state.update(f"{role.as_py()}:{text.as_py()}".encode())
        if state is not None:
            yield conv, state.hexdigest()

    return _batches(rows(), _HASHED)


def report(rows: DataFrame, conversations: DataFrame) -> DataFrame:
    """One row for each ``conv_id`` of ``conversations``: faults of ``rows``, the audit and a digest of the repaired turns.

    ``rows`` is as for ``repair``. ``gaps`` are turn numbers missing between the least and
    the greatest. A turn's first fault counts: blank, duplicate, truncated; ``illegal``
    are adjacent pairs of initials. A conversation without rows has zeros, an empty audit
    and the digest of nothing.
    """
    turns = turns_of(rows)
    planned = plan(turns)
    stream = repaired(turns, planned).repartition("conv_id").sortWithinPartitions(F.asc_nulls_first("conv_id"), "seq").select("conv_id", "role", "text")
    counts = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    found = _same(conversations.select(F.col("conv_id").cast("long").alias("conv_id")).distinct(), planned.where("kind = 0").select("conv_id", *counts, "audit"), ["conv_id"])
    found = _same(found, stream.mapInArrow(trimming(_hashed), "conv_id long, repaired_sha256 string"), ["conv_id"])
    return found.select("conv_id", *[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in counts], F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"))


def damaged(rows: DataFrame) -> DataFrame:
    """``conv_id, turn, role, text`` with a quarter of the turns damaged, by crc32 of ``conv_id:turn``.

    Of 20 remainders 0 drops the turn, 1 empties its text, 2 takes its ``[.!?]`` away, 3
    repeats it and 4 makes it the user's. Nulls are one space, in the key too; a null turn stays null.
    """
    shown = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    k = F.crc32(F.concat(shown("conv_id"), F.lit(":"), shown("turn")).cast("binary")) % 20
    known = rows.select("conv_id", "turn", shown("role").alias("role"), shown("text").alias("text"), k.alias("k")).where("k <> 0")
    text: Column = F.when(F.col("k") == 1, "").when(F.col("k") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    copies = F.explode(F.when(F.col("k") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return known.select("conv_id", "turn", F.when(F.col("k") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), copies.alias("copy")).drop("copy")
