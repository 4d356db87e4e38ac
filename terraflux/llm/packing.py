"""Operator 3. Sum-of-squares online packing of documents into sequences.

Each document's token ids are cut into full sequences and a remainder. Remainders are
dealt to packers, about ``PACKED`` to each, however many tasks read the documents. A
packer places its remainders one by one: among the windows it keeps one stack for each
fill level of ``WIDTH`` tokens, and a remainder goes to the level (none: a new window) for
which the sum over levels of the squared counts of partially filled windows grows least;
the counts are the level array. A remainder that runs past the end of the window, by less
than a level's width, is cut there, and what is cut off is placed in turn. When a packer
has placed all, the few windows still open are strung together, cut at the capacity, and
what is left over is cut into powers of two, the lengths that need no padding.

A packer holds the remainders dealt to it, and open windows of at most one level array.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, trimming, trimming_groups

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, closed_by string"
NAMES = [x.split()[0] for x in PIECES.split(", ")]
#: Characters from which on a part of a text ends at the next space, and the bits of a sequence_id that number a task's sequences.
PART, TASK_BITS = 1 << 18, 38
#: A space after a character that no tokenizer takes for white space.
SEAM = re.compile(r"(?<=\S) ")
#: Remainders of a packer, and tokens of a fill level.
PACKED, WIDTH = 1 << 14, 16


def parts(text: str) -> Iterator[str]:
    """The text in parts of PART characters or somewhat more, each but the first with a space in front."""
    at = 0
    while len(text) - at > PART and (seam := SEAM.search(text, at + PART)):
        yield text[at : seam.start()]
        at = seam.start()
    yield text[at:]


class Encoder:
    """Token ids of texts under a byte-level BPE vocabulary, as little-endian 32-bit words.

    The vocabulary's split pattern ends a token before every space that follows a
    character other than white space, so a long text is encoded in parts that end there.
    A text that holds the string of a special token is left to ``tokenizers`` itself.
    """

    def __init__(self, vocabulary: str, ranks: str, special: tuple[str, ...] = ("<|endoftext|>",)):
        import base64

        import public_tokenizers
        import tiktoken

        self.special = special
        self.vocabulary = public_tokenizers.path(vocabulary)
        with open(public_tokenizers.path(ranks), "rb") as lines:
            table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.units = tiktoken.Encoding("units", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})

    @cached_property
    def whole(self):
        """The library's own tokenizer, loaded where a text needs it."""
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.vocabulary)

    def encode(self, text: str) -> bytes:
        if any(x in text for x in self.special):
            return np.array(self.whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        return b"".join([np.array(self.units.encode_ordinary(x), "<u4").tobytes() for x in parts(text)])


_ENCODERS: dict[tuple, Encoder] = {}


def encoder(vocabulary: str, ranks: str) -> Encoder:
    """One encoder for each vocabulary and Python worker."""
    if (key := (vocabulary, ranks)) not in _ENCODERS:
        _ENCODERS[key] = Encoder(vocabulary, ranks)
    return _ENCODERS[key]


class Packer:
    """Open windows by fill level. A window is a list of (piece, from, length), and its fill."""

    def __init__(self, capacity: int, width: int = WIDTH):
        self.capacity, self.width = capacity, width
        levels = -(-capacity // width)
        self.count = np.zeros(levels, np.int64)
        self.top = np.zeros(levels, np.int64)  # fill of the window that would be taken from each level
        self.open: list[list[tuple[list, int]]] = [[] for _ in range(levels)]

    def choose(self, r: int) -> int | None:
        """The level for a piece of r tokens, None for a new window; ties go to the fullest window."""
        after = self.top + r
        closes = after >= self.capacity
        fits = (self.count > 0) & (after < self.capacity + self.width)
        to = np.minimum(after // self.width, len(self.count) - 1)
        here = np.arange(len(self.count))
        grow = np.where(closes, 1 - 2 * self.count, np.where(to == here, 0, 2 * (self.count[to] - self.count) + 2))
        grow = np.where(fits, grow, np.iinfo(np.int64).max)
        best = len(grow) - 1 - int(grow[::-1].argmin())
        return best if grow[best] <= 2 * self.count[min(r // self.width, len(grow) - 1)] + 1 else None

    def add(self, piece, begin: int, r: int) -> list | None:
        """Places tokens begin to begin + r of a piece (fewer than the capacity); the window if that closed it."""
        while True:
            h = self.choose(r)
            window, fill = ([], 0) if h is None else self.open[h].pop()
            if h is not None:
                self.count[h] -= 1
                self.top[h] = self.open[h][-1][1] if self.open[h] else 0
            n = min(r, self.capacity - fill)
            window.append((piece, begin, n))
            if fill + n < self.capacity:
                to = (fill + n) // self.width
                self.open[to].append((window, fill + n))
                self.count[to] += 1
                self.top[to] = fill + n
                return None
            if n == r:
                return window
            self.cut = (piece, begin + n, r - n)
            return window

    cut: tuple | None = None

    def place(self, piece, begin: int, r: int) -> Iterator[list]:
        """Windows that the piece, and what is cut off it, close."""
        todo = (piece, begin, r)
        while todo:
            self.cut = None
            if (done := self.add(*todo)) is not None:
                yield done
            todo = self.cut

    def rest(self) -> Iterator[list]:
        """The open windows strung together, cut at the capacity, the last into powers of two."""
        window, fill = [], 0
        for level in reversed(self.open):
            for held, _ in level:
                for piece, at, r in held:
                    while r:
                        n = min(r, self.capacity - fill)
                        window.append((piece, at, n))
                        at, r, fill = at + n, r - n, fill + n
                        if fill == self.capacity:
                            yield window
                            window, fill = [], 0
            level.clear()
        while fill:
            room, part = 1 << (fill.bit_length() - 1), []
            fill -= room
            while room:
                piece, at, n = window[0]
                here = min(n, room)
                part.append((piece, at, here))
                room -= here
                window[:1] = [(piece, at + here, n - here)] if n > here else []
            yield part


def _rows(schema: pa.Schema, out: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*out, strict=True)) or [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(columns, schema, strict=True)], schema=schema)


def pack(docs: DataFrame, capacity: int = 2048, end_id: int = 1, vocabulary: str = "byte_bpe_50k.json", ranks: str = "byte_bpe_50k.tiktoken", with_ids: bool = False) -> DataFrame:
    """Pieces of sequences of at most ``capacity`` tokens that hold all of ``docs(doc_id, text)``.

    One row for each piece: ``doc_id``, ``start`` (its document's ids before it),
    ``length``, ``ids_crc32``, ``doc_tokens``, ``sequence_id``, ``offset``, ``closed_by``
    (``document``: cut from one document, ``rule``: by the sum of squares, ``rest``: strung
    together at the end); with ``with_ids`` also ``ids``. ``end_id`` closes each document.
    A null or empty text is a document of that id alone; a very long one is cut into full
    sequences as it is read; repeated rows and null doc_ids are packed like any other.
    Extra columns are ignored; an empty table gives no pieces. Sequences shorter than
    ``capacity`` have a power of two tokens, so none is padded.
    """
    if capacity < 1 or capacity & (capacity - 1):
        raise ValueError("capacity must be a power of two")
    end = int(end_id).to_bytes(4, "little")
    own = pa.schema([*[(n, pa.int64()) for n in NAMES[:7]], ("closed_by", pa.string()), ("ids", pa.binary())])

    def piece(doc_id, start: int, ids: bytes, at: int, n: int, total: int, sequence: int, offset: int, closed_by: str, keep: bool) -> tuple:
        part = ids[4 * at : 4 * (at + n)]
        return doc_id, start + at, n, zlib.crc32(part), total, sequence, offset, closed_by, part if keep else None

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Full sequences, and remainders (no sequence yet) with their ids."""
        encode, out, size, sequence = encoder(vocabulary, ranks).encode, [], 0, None
        for batch in batches:
            if sequence is None and batch.num_rows:
                sequence = batch.column(2)[0].as_py() << TASK_BITS
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = encode(text.as_py() or "") + end
                total = len(ids) // 4
                full = total - total % capacity
                for at in range(0, full, capacity):
                    out.append(piece(doc_id, 0, ids, at, capacity, total, sequence, 0, "document", with_ids))
                    sequence += 1
                if total > full:
                    out.append((doc_id, full, total - full, 0, total, sequence, 0, None, ids[4 * full :]))
                    sequence += 1  # a number of its own, by which it is dealt and sorted
                size += len(ids)
                if size >= 1 << 22:
                    yield _rows(own, out)
                    out, size = [], 0
        if out:
            yield _rows(own, out)

    table = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.spark_partition_id().cast("long").alias("partition"))
    rows = materialise(table.mapInArrow(trimming(read), f"{PIECES}, ids binary"), "packing-read")
    left = rows.where("closed_by is null")
    packers = max(1, -(-left.count() // PACKED))

    def place(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = pa.Table.from_batches(list(batches)).sort_by("sequence_id").to_pydict()
        packer, out, sequence = Packer(capacity), [], -1 - (key[0].as_py() << TASK_BITS)

        def put(window: list, closed_by: str) -> None:
            nonlocal sequence
            offset = 0
            for i, at, n in window:
                out.append(piece(held["doc_id"][i], held["start"][i], held["ids"][i], at, n, held["doc_tokens"][i], sequence, offset, closed_by, with_ids))
                offset += n
            sequence -= 1

        for i, r in enumerate(held["length"]):
            for window in packer.place(i, 0, r):
                put(window, "rule")
        for window in packer.rest():
            put(window, "rest")
        yield _rows(own, out)

    dealt = left.withColumn("packer", F.pmod(F.xxhash64("sequence_id"), F.lit(packers)))
    placed = dealt.groupBy("packer").applyInArrow(trimming_groups(place), f"{PIECES}, ids binary")
    made = rows.where("closed_by is not null").unionByName(placed)
    if not with_ids:
        return made.drop("ids")

    @F.pandas_udf("array<int>")
    def numbers(ids: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for x in ids:
            yield pd.Series([np.frombuffer(v, "<i4") for v in x])

    return made.withColumn("ids", numbers("ids"))
