"""Operator 10. SentencePiece encoding and decoding by suffix-array matching.

A text's pieces never cross the start of a word (a piece holds the space mark only in
front, or is made of marks alone; ``Model`` checks this), so a batch is reduced to its
distinct words. The parts of those not met before are concatenated and indexed by a suffix
array, as deep as the longest piece. Every piece is binary-searched for its range of occurrences;
each occurrence is an edge from one position to another. Edges sorted by position are
then relaxed: position j is reached by the one edge whose piece may follow the piece
that position i was reached by.

For a BPE model "may follow" means that merging the two pieces' characters from scratch
gives just these two pieces; by that rule the path is the merge order's own result, not
the best sum of scores. Characters without a piece are spelled by byte pieces.
"""

from __future__ import annotations

import hashlib
import re
from array import array
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MARK = "▁"
WORD = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")
#: Bytes of a generation of words, and of word parts, that a worker remembers; the longest of either; pairs of pieces
#: remembered; characters indexed at a time.
REMEMBERED, LONGEST, PAIRS, INDEXED = 3 << 26, 128, 3 << 20, 1 << 18
_SPELLED = -1


class Memory(dict):
    """Ids of words, with an upper bound of the bytes that the entries take."""

    size = 0

    def keep(self, entries: dict[str, bytes]) -> None:
        some = {w: x for w, x in entries.items() if len(w) <= LONGEST}
        self.size += sum(180 + 4 * len(w) + len(x) for w, x in some.items())
        self.update(some)


class Model:
    """A BPE model's pieces and the words encoded so far."""

    def __init__(self, file: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=file)
        n = sp.get_piece_size()
        self.bytes_of = {int(sp.id_to_piece(i)[1:-1], 16): i for i in range(n) if sp.is_byte(i)}
        self.piece = {sp.id_to_piece(i): i for i in range(n) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))}
        self.score = {p: sp.get_score(i) for p, i in self.piece.items()}
        self.text = {i: p for p, i in self.piece.items()}
        self.unknown = sp.unk_id()
        if bad := [p for p in self.piece if MARK in p.lstrip(MARK)]:
            raise ValueError(f"pieces cross words: {bad[:3]}")
        self.plain = [b""] * n
        for p, i in self.piece.items():
            self.plain[i] = p.replace(MARK, " ").encode()
        for b, i in self.bytes_of.items():
            self.plain[i] = bytes([b])
        self.code = {c: k + 1 for k, c in enumerate(sorted({c for p in self.piece for c in p}))}
        self.longest = max(map(len, self.piece))
        names = sorted(self.piece)
        self.ids = np.array([self.piece[p] for p in names])
        self.size = np.array([len(p) for p in names])
        self.low = self._keys([self._coded(p) for p in names], 0)
        self.high = self._keys([self._coded(p) for p in names], 0xFFFF)
        self.inside = {p[i : i + 2] for p in self.piece for i in range(len(p) - 1)}
        self.words, self.older, self.parts = Memory(), Memory(), Memory()
        self.follows: dict[int, bool] = {}

    def _coded(self, text: str) -> list[int]:
        return [self.code.get(c, 0) for c in text]

    def _keys(self, codes: list[list[int]], fill: int) -> np.ndarray:
        table = np.full((len(codes), self.longest), fill, ">u2")
        for row, c in zip(table, codes, strict=True):
            row[: len(c)] = c
        return table.view(f"S{2 * self.longest}").ravel()

    def merged(self, text: str) -> list[str]:
        """The model's merges from single characters: best score first, leftmost of equals."""
        parts = list(text)
        while True:
            found = [(-self.score[x + y], i) for i, (x, y) in enumerate(zip(parts, parts[1:], strict=False)) if x + y in self.score]
            if not found:
                return parts
            i = min(found)[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]

    def may_follow(self, a: int, b: int) -> bool:
        """Whether piece b stands right after piece a; a < 0: at the start, or after a spelled character."""
        x, y = self.text.get(a, ""), self.text[b]
        return self.merged(x + y) == [p for p in (x, y) if p]

    def learn(self, words: list[str]) -> dict[str, bytes]:
        """The ids of words.

        A word is cut first where no piece holds the two characters side by side (between
        a letter and a full stop, say); its parts are encoded once for all words.
        """
        inside, cut = self.inside, []
        for w in words:
            at = [i for i in range(1, len(w)) if w[i - 1 : i + 1] not in inside]
            cut.append([w[i:j] for i, j in zip([0, *at], [*at, len(w)], strict=True)] if at else [w])
        if self.parts.size > REMEMBERED:
            self.parts = Memory()
        distinct = set().union(*cut)
        parts = {x: self.parts[x] for x in distinct if x in self.parts}
        new = sorted(distinct.difference(parts))
        at = 0
        while at < len(new):
            size, stop = 0, at
            while stop < len(new) and (stop == at or size + len(new[stop]) < INDEXED):
                size += len(new[stop]) + 1
                stop += 1
            found = self._index(new[at:stop])
            self.parts.keep(found)
            parts |= found
            at = stop
        get = parts.__getitem__
        return {w: b"".join(map(get, x)) for w, x in zip(words, cut, strict=True)}

    def _edges(self, joined: str, start: int, stop: int) -> tuple[list, list, list]:
        """Edges that end after ``start`` and by ``stop``, sorted by their end: begins, pieces, and bounds by end.

        The text from ``start`` less the longest piece to ``stop`` is indexed by a suffix
        array; every piece is binary-searched for its range of occurrences.
        """
        low = max(0, start - self.longest)
        text = joined[low:stop]
        codes = np.zeros(len(text) + self.longest, ">u2")
        codes[: len(text)] = [*map(self.code.get, text, repeat(0))]
        suffix = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(codes, self.longest)[: len(text)]).view(f"S{2 * self.longest}").ravel()
        order = np.argsort(suffix, kind="stable")
        ranked = suffix[order]
        first, last = np.searchsorted(ranked, self.low, "left"), np.searchsorted(ranked, self.high, "right")
        count = last - first
        which = np.repeat(np.arange(len(count)), count)
        begin = order[np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(first, count)] + low
        end = begin + self.size[which]
        here = np.flatnonzero((end > start) & (end <= stop))
        begin, end, which = begin[here], end[here], which[here]
        by_place = np.lexsort((begin, end))
        bounds = np.searchsorted(end[by_place], np.arange(start + 1, stop + 2)).tolist()
        return begin[by_place].tolist(), self.ids[which[by_place]].tolist(), bounds

    def _index(self, words: list[str]) -> dict[str, bytes]:
        """Ids of word parts, concatenated; INDEXED characters are indexed and relaxed at a time, however long a part is."""
        joined = "\0".join(words) + "\0"
        if len(self.follows) > PAIRS:
            self.follows.clear()
        known, reached, length = self.follows, array("i", [_SPELLED]) * (len(joined) + 1), bytearray(len(joined) + 1)
        for start in range(0, len(joined), INDEXED):
            stop = min(start + INDEXED, len(joined))
            begins, edges, bounds = self._edges(joined, start, stop)
            for j in range(start + 1, stop + 1):
                for e in range(bounds[j - start - 1], bounds[j - start]):
                    i, piece = begins[e], edges[e]
                    before = reached[i]
                    pair = before << 20 | piece
                    may = known.get(pair)
                    if may is None:
                        may = known[pair] = self.may_follow(before, piece)
                    if may:
                        reached[j], length[j] = piece, j - i
                        break
        out, start = {}, 0
        for word in words:
            stop = start + len(word)
            ids, j = [], stop
            while j > start:
                if not length[j]:
                    j -= 1
                    raw = joined[j].encode()
                    ids += [self.bytes_of[b] for b in reversed(raw)] if self.bytes_of else [self.unknown]
                else:
                    ids.append(reached[j])
                    j -= length[j]
            out[word] = array("i", ids[::-1]).tobytes()
            start = stop + 1
        return out

    def split(self, text: str) -> list[str]:
        """The words of a text, each with the marks in front of it."""
        return WORD.findall(MARK + text.replace(" ", MARK)) if text else []

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text. Words of two generations are remembered: used ones outlive a change."""
        split = [self.split(t) for t in texts]
        distinct = set().union(*split)
        if self.words.size > REMEMBERED:
            self.older, self.words = self.words, Memory()
        told = {w: self.words[w] for w in distinct if w in self.words}
        again = {w: self.older[w] for w in distinct.difference(told) if w in self.older}
        new = self.learn(sorted(distinct.difference(told, again)))
        for x in (again, new):
            self.words.keep(x)
            told |= x
        get = told.__getitem__
        return [np.frombuffer(b"".join(map(get, words)), "<i4") for words in split]

    def decode(self, ids) -> str:
        raw = b"".join(map(self.plain.__getitem__, ids))
        return (raw[1:] if raw[:1] == b" " else raw).decode("utf-8", "replace")


_MODELS: dict[str, Model] = {}


def model(name: str) -> Model:
    """One model for each file and Python worker; ``name`` is a public tokenizer's file, or a path."""
    if name not in _MODELS:
        import os

        import public_tokenizers

        _MODELS[name] = Model(name if os.path.isabs(name) else public_tokenizers.path(name))
    return _MODELS[name]


#: Characters of text worked on at a time, so that a batch's words fit the memory of words.
BATCH = 1 << 22


def encode(docs: DataFrame, name: str = "piece_bpe_32k.model") -> DataFrame:
    """``doc_id, ids, n_ids, decoded_sha256, exact`` for each row of ``docs(doc_id, text)``.

    ``decoded_sha256`` is the digest of the ids decoded again, ``exact`` whether that is
    the text (the mark U+2581 itself decodes to a space). A null text is empty, and has
    no ids; a null doc_id is kept; repeated rows are encoded each for itself; a very long
    text, and one without a break, is indexed some characters at a time; extra columns
    are ignored; an empty table gives an empty result.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32())), ("n_ids", pa.int64()), ("decoded_sha256", pa.string()), ("exact", pa.bool_())])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = model(name)

        def out(held: list[tuple]) -> pa.RecordBatch:
            ids = own.encode([t for _, t in held])
            decoded = [own.decode(x.tolist()) for x in ids]
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum([len(x) for x in ids])]), pa.int32()), pa.array(np.concatenate(ids), pa.int32()))
            rest = ([len(x) for x in ids], [hashlib.sha256(t.encode()).hexdigest() for t in decoded], [t == d for (_, t), d in zip(held, decoded, strict=True)])
            return pa.RecordBatch.from_arrays([pa.array([i for i, _ in held], pa.int64()), lists, *(pa.array(x, f.type) for x, f in zip(rest, list(schema)[2:], strict=True))], schema=schema)

        held, size = [], 0
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                held.append((doc_id, text.as_py() or ""))
                size += len(held[-1][1])
                if size >= BATCH:
                    yield out(held)
                    held, size = [], 0
        if held:
            yield out(held)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(scan, "doc_id long, ids array<int>, n_ids long, decoded_sha256 string, exact boolean")


def decode_column(ids, name: str = "piece_bpe_32k.model"):
    """The text of a column of ids (array<int>); null for null."""
    @F.pandas_udf("string")
    def decode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = model(name)
        for lists in batches:
            yield pd.Series([None if x is None else own.decode(list(x)) for x in lists], dtype=object)

    return decode(ids)
