"""Operator 12. Periodic runs of words, by a suffix automaton.

A run is a stretch of words with smallest period q, repeated at least ``times`` times and
at least ``least`` words long, that no neighbouring word extends. Every such run holds
two equal windows of ``least - least / times`` words at most a third of the text apart
(for three times), one after the other without a third between them. A batch of texts is
first searched for such pairs, by hashes of windows; the stretches that chains of pairs
cover hold all runs, and only they reach the automaton.

The automaton of a stretch has a state for each set of end positions. States are merged
into their suffix links from the longest to the shortest, the smaller ordered set into
the larger one. Two positions that become neighbours in the set of a state, at a distance
not over the state's length, seed a square. It can't be extended to the left, as the
state is the longest common suffix of both prefixes, and seeds with the same start and
period extend one another to the right; the longest is the run.

All work is inside a task and no row is shuffled. Python holds the words of one slice of
a batch (``SLICE`` bytes of text, or one longer text) and the automaton of one stretch.
"""

from __future__ import annotations

import re
from array import array
from bisect import bisect_left, bisect_right
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import trimmed

WORD = re.compile(rb"[^\x20\x09-\x0D]+")
#: Bytes of text whose words are held at a time, and the length of a block of an ordered set.
SLICE, BLOCK = 1 << 20, 512


class Ends:
    """An ordered set of positions, in blocks."""

    __slots__ = ("blocks", "lows", "size")

    def __init__(self, position: int):
        self.blocks, self.lows, self.size = [[position]], [position], 1

    def __iter__(self) -> Iterator[int]:
        for block in self.blocks:
            yield from block

    def add(self, position: int) -> tuple[int | None, int | None]:
        """Puts a new position in; the neighbours on its left and right."""
        k = max(0, bisect_right(self.lows, position) - 1)
        block = self.blocks[k]
        at = bisect_left(block, position)
        left = block[at - 1] if at else None
        right = block[at] if at < len(block) else self.lows[k + 1] if k + 1 < len(self.lows) else None
        block.insert(at, position)
        if not at:
            self.lows[k] = position
        if len(block) > 2 * BLOCK:
            self.blocks[k : k + 1] = [block[:BLOCK], block[BLOCK:]]
            self.lows.insert(k + 1, block[BLOCK])
        self.size += 1
        return left, right


class Automaton:
    """The suffix automaton of a sequence of small integers.

    Most states have one way on, held in two arrays; further ones are in a dictionary of
    the state. ``end`` is the position that made a state, -1 for a copied one.
    """

    def __init__(self, words: Iterable[int]):
        self.length, self.link, self.end = array("q", [0]), array("q", [-1]), array("q", [-1])
        self.symbol, self.target, self.more = array("q", [-1]), array("q", [-1]), {}
        last = 0
        for position, w in enumerate(words):
            last = self._extend(last, w, position)

    def _state(self, length: int, end: int) -> int:
        for column, value in ((self.length, length), (self.link, 0), (self.end, end), (self.symbol, -1), (self.target, -1)):
            column.append(value)
        return len(self.length) - 1

    def _next(self, state: int, w: int) -> int:
        if self.symbol[state] == w:
            return self.target[state]
        others = self.more.get(state)
        return -1 if others is None else others.get(w, -1)

    def _put(self, state: int, w: int, target: int) -> None:
        if self.symbol[state] in (-1, w):
            self.symbol[state], self.target[state] = w, target
        else:
            self.more.setdefault(state, {})[w] = target

    def _extend(self, last: int, w: int, position: int) -> int:
        new, p = self._state(self.length[last] + 1, position), last
        while p != -1 and (q := self._next(p, w)) == -1:
            self._put(p, w, new)
            p = self.link[p]
        if p == -1:
            return new
        if self.length[q] == self.length[p] + 1:
            self.link[new] = q
            return new
        copy = self._state(self.length[p] + 1, -1)
        self.link[copy], self.symbol[copy], self.target[copy] = self.link[q], self.symbol[q], self.target[q]
        if q in self.more:
            self.more[copy] = dict(self.more[q])
        while p != -1 and self._next(p, w) == q:
            self._put(p, w, copy)
            p = self.link[p]
        self.link[q] = self.link[new] = copy
        return new


def stretch_runs(words: list[int], least: int, times: int) -> list[tuple[int, int, int]]:
    """``(start, length, period)`` of the runs of one stretch, whose ends no run crosses."""
    built = Automaton(words)
    length, link = built.length, built.link
    held = [None if end < 0 else Ends(end) for end in built.end]
    longest: dict[tuple[int, int], int] = {}
    for state in sorted(range(1, len(length)), key=length.__getitem__, reverse=True):
        parent, mine = link[state], held[state]
        held[state] = None
        theirs = held[parent]
        if parent == 0 or theirs is None:  # the root's length seeds nothing
            held[parent] = mine if parent else None
            continue
        small, large = (mine, theirs) if mine.size <= theirs.size else (theirs, mine)
        held[parent], common, own = large, length[parent], list(small)
        for k, position in enumerate(own):
            left, right = large.add(position)
            found = []
            if left is not None and not (k and left == own[k - 1]):
                found.append((position, position - left))
            if right is not None and not (k + 1 < len(own) and own[k + 1] < right):
                found.append((right, right - position))
            for end, period in found:
                if period <= common and common + period >= max(least, times * period):
                    key = (end - common - period + 1, period)
                    longest[key] = max(longest.get(key, 0), common + period)
    return sorted((start, n, period) for (start, period), n in longest.items())


def stretches(ids: np.ndarray, bounds: np.ndarray, least: int, times: int) -> list[tuple[int, int, int]]:
    """``(text, from, to)`` of stretches of a batch's words that together hold all runs.

    ``ids`` are the words' hashes, the texts' words lie between ``bounds``. Two words with
    one hash add a stretch at most.
    """
    need = max(1, least - least // times)
    width, grams = 1, ids.astype(np.uint64)
    with np.errstate(over="ignore"):
        while 2 * width <= need and len(grams) > width:
            grams = (grams[:-width] * np.uint64(0x9E3779B97F4A7C15)) ^ (grams[:-width] >> np.uint64(29)) ^ (grams[width:] * np.uint64(0xC2B2AE3D27D4EB4F) + np.uint64(width))
            width *= 2
    text = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    if len(grams) < 2:
        return []
    at = np.flatnonzero(text[: len(grams)] == text[width - 1 : width - 1 + len(grams)])
    order = at[np.argsort(grams[at], kind="stable")]
    a, b = order[:-1], order[1:]
    near = (grams[a] == grams[b]) & (text[a] == text[b]) & ((b - a) * times <= np.diff(bounds)[text[a]])
    a, b = a[near], b[near] + width
    out: list[list[int]] = []
    for k in np.argsort(a, kind="stable"):
        lo, hi = int(a[k]), int(b[k])
        if out and lo <= out[-1][2] and text[lo] == out[-1][0]:
            out[-1][2] = max(out[-1][2], hi)
        else:
            out.append([int(text[lo]), lo, hi])
    return [(t, lo - int(bounds[t]), hi - int(bounds[t])) for t, lo, hi in out]


def batch_runs(texts: list[list[bytes]], least: int = 24, times: int = 3) -> list[list[tuple[int, int, int]]]:
    """The runs of each text, given as its words, by start and period."""
    bounds = np.cumsum([0, *map(len, texts)])
    ids = np.fromiter((hash(w) for words in texts for w in words), np.int64, int(bounds[-1]))
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    for t, lo, hi in stretches(ids, bounds, least, times):
        known: dict[bytes, int] = {}
        found = stretch_runs([known.setdefault(w, len(known)) for w in texts[t][lo:hi]], least, times)
        out[t] += [(lo + start, n, period) for start, n, period in found]
    return [sorted(x) for x in out]


def kept_words(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """The words that no run holds after its first period."""
    keep = bytearray(b"\1") * len(words)
    for start, n, period in runs:
        keep[start + period : start + n] = bytes(n - period)
    return [w for w, k in zip(words, keep, strict=True) if k]


_RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
_FOUND = pa.struct([("runs", _RUNS), ("collapsed", pa.string())])


def _slices(texts: pa.Array) -> Iterator[list[list[bytes]]]:
    held, size = [], 0
    for text in texts:
        raw = (text.as_py() or "").encode()
        held.append(WORD.findall(raw))
        size += len(raw)
        if size >= SLICE:
            yield held
            held, size = [], 0
    if held:
        yield held


def found_in(text: Column | str, least: int = 24, times: int = 3) -> Column:
    """A struct for each text: ``runs`` (array of start, length, period, in words) and ``collapsed``.

    ``collapsed`` are the words that no run holds after its first period, joined by one
    space. A null or wordless text has no runs and an empty ``collapsed``; very long texts
    are searched whole; runs that overlap or start together are all listed, by start, then
    period.
    """
    if least < 1 or times < 2:
        raise ValueError("a run has a word at least and repeats at least twice")

    @F.arrow_udf("struct<runs:array<struct<start:bigint,length:bigint,period:bigint>>,collapsed:string>")
    def search(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in trimmed(batches):
            made = []
            for texts in _slices(batch):
                for words, runs in zip(texts, batch_runs(texts, least, times), strict=True):
                    made.append({"runs": [dict(zip(("start", "length", "period"), r, strict=True)) for r in runs], "collapsed": b" ".join(kept_words(words, runs)).decode()})
            yield pa.array(made, _FOUND)

    return search(F.col(text).cast("string") if isinstance(text, str) else text.cast("string"))


def collapse(docs: DataFrame, least: int = 24, times: int = 3) -> DataFrame:
    """``docs`` with each run in ``text`` cut down to its first period.

    Texts without runs stay as they are, white space and null included; in others the
    words kept are joined by one space, and ``n_chars``, where there is such a column, is
    counted anew. No row is dropped; null doc_ids, repeated rows and extra columns, whatever their names, are kept.
    """
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), found_in("text", least, times).alias("found"))
    shorter = F.col("row").withField("text", F.col("found.collapsed"))
    if "n_chars" in docs.columns:
        shorter = shorter.withField("n_chars", F.length("found.collapsed").cast(docs.schema["n_chars"].dataType))
    return rows.select(F.when(F.size("found.runs") > 0, shorter).otherwise(F.col("row")).alias("row")).select("row.*")


def planted(docs: DataFrame) -> DataFrame:
    """``doc_id, text``: a tenth of the documents, by crc32 of the doc_id, turns periodic from some word on.

    With n words, h the crc32 and g = h / 10, word i >= a = g % n becomes the word at
    a + (i - a) % p, p = 1 + (n - a) / (3 + g % 8). A row with a null doc_id stays as it is.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    rows = rows.withColumn("g", F.when(h % 10 == 0, F.floor(h / 10))).withColumn("words", F.when(F.col("g").isNotNull(), F.regexp_extract_all("text", F.lit(r"([^\x20\x09-\x0D]+)"), F.lit(1))))
    rows = rows.withColumn("n", F.size("words"))
    rows = rows.withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n"))).withColumn("p", F.expr("1 + (n - a) div (3 + g % 8)"))
    periodic = F.expr("array_join(transform(words, (w, i) -> if(i < a, w, words[cast(a + (i - a) % p as int)])), ' ')")
    return rows.select("doc_id", F.when(F.col("a").isNotNull(), periodic).otherwise(F.col("text")).alias("text"))


def digest(docs: DataFrame, least: int = 24, times: int = 3) -> DataFrame:
    """Counts and digests of the runs of each row of ``docs(doc_id, text)``.

    ``n_runs``; ``start, length, period, exponent_milli`` of the run that repeats most
    (exactly compared; ties: smallest start, then period; nulls without a run);
    ``runs_sha256`` over a line ``start,length,period`` a run; ``collapsed_sha256``. A null
    text has no words. Repeated rows and null doc_ids are rows like any other, extra
    columns are ignored, and an empty table gives an empty result.
    """
    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), found_in("text", least, times).alias("found"))
    best = F.expr("aggregate(found.runs, cast(null as struct<start:bigint,length:bigint,period:bigint>), (b, r) -> if(b is null or r.length * b.period > b.length * r.period, r, b))")
    lines = F.expr("array_join(transform(found.runs, r -> concat(r.start, ',', r.length, ',', r.period, '\n')), '')")
    return found.withColumn("best", best).select(
        "doc_id", F.size("found.runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(lines.cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("found.collapsed").cast("binary"), 256).alias("collapsed_sha256"))
