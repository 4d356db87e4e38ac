"""Operator 8. Quality by an interpolated modified Kneser-Ney n-gram model.

Symbols are the code points of a text as they stand, with ``ORDER - 1`` marks before it;
n-grams are strings of them, so every script and case is told apart and the model grows
with the text it is trained on.

Training counts the n-grams of all trusted text (each task its own, summed by Spark).
Each lower order's continuation counts are an aggregation of the order above; a context's
total and back-off weight are an aggregation by context; and the probabilities of an
order are its counts joined with those of its contexts and of the order below. All these
joins are dealt by the hash of a gram; nothing of the model is collected or broadcast.

Scoring asks for each n-gram once a chunk of documents and once in all: the distinct
n-grams of the documents are joined with the probabilities, order by order, and the
answers go back to the chunks that asked. The documents of a chunk, compressed, meet
their answers in one task, which reads them in pieces.

A document's score is the perplexity at the lower end of the confidence interval of its
mean surprisal, so that short texts are not judged by a few characters. A fifth of the
trusted documents, by hash of doc_id, is kept out of training: what the model has read
looks too plain to it. A document is rejected where its score is over a quantile of those
in its language by more than ``slack`` bits a character.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from .common import materialise, slot_filter, trimming, whole_row

#: Symbols of an n-gram, and the mark that stands before a text.
ORDER, START = 5, "\x02"
#: One in so many trusted documents is held out.
HELD_OUT = 5
#: Characters of a chunk of documents, of text worked on at a time, and of one compressed block; answers of one block.
CHUNK, PIECE, BLOCK, PACK = 1 << 24, 1 << 20, 1 << 20, 1 << 18
BLOCKS = "chunk long, part int, block binary"
_MISSING = "the documents were not the same when read again; write them to a table first"


@cache
def _factors(order: int) -> np.ndarray:
    return np.random.default_rng(order).integers(0, 1 << 63, order, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _hashed(points: np.ndarray, order: int) -> np.ndarray:
    """A 64-bit hash of each run of ``order`` code points."""
    n = max(0, len(points) - order + 1)
    h, points = np.zeros(n, np.uint64), points.astype(np.uint64)
    for j, f in enumerate(_factors(order)):
        h += points[j : n + j] * f
    return h


class Piece:
    """Some characters of several texts: code points, the hashes of their n-grams, and whose they are.

    ``numbers`` and ``lengths`` are the texts' numbers and how many n-grams each has here.
    """

    def __init__(self, held: list[str], numbers: list[int], lengths: list[int], order: int):
        self.order, self.numbers, self.lengths = order, np.array(numbers), np.array(lengths)
        self.points = np.frombuffer("".join(held).encode("utf-32-le"), np.uint32)
        h = _hashed(self.points, order)
        self.last = np.cumsum(self.lengths)
        own = np.ones(len(h), bool)  # a run that reaches into the next text is no n-gram
        for j in range(order - 1):
            own[(self.last + np.arange(len(self.last)) * (order - 1))[:-1] + j] = False
        self.hashes = h[own]

    def grams(self, which: np.ndarray) -> np.ndarray:
        """The code points of the n-grams with these numbers, a row each."""
        begin = which + np.searchsorted(self.last, which, "right") * (self.order - 1)
        return self.points[begin[:, None] + np.arange(self.order)]

    def sums(self, values: np.ndarray) -> np.ndarray:
        """The sum over each text's n-grams."""
        return np.add.reduceat(values, self.last - self.lengths)


def pieces(texts: Iterable[str | None], order: int, size: int) -> Iterator[Piece]:
    """Texts some ``size`` characters at a time; a longer text goes on in the next piece."""
    marks = START * (order - 1)
    held, numbers, lengths, room = [], [], [], size
    for number, text in enumerate(texts):
        at = 0
        while at < len(text or ""):
            part = text[at : at + room]
            held.append(((marks + text[max(0, at - order + 1) : at])[len(marks) and -len(marks) :] if marks else "") + part)
            numbers.append(number)
            lengths.append(len(part))
            at, room = at + len(part), room - len(part)
            if not room:
                yield Piece(held, numbers, lengths, order)
                held, numbers, lengths, room = [], [], [], size
    if held:
        yield Piece(held, numbers, lengths, order)


class Table:
    """Distinct hashes in order, found by their upper bits."""

    def __init__(self, keys: np.ndarray):
        self.keys = keys
        self.shift = np.uint64(64 - max(8, len(keys).bit_length() + 1))
        self.start = np.searchsorted(keys >> self.shift, np.arange((1 << int(64 - self.shift)) + 1, dtype=np.uint64))
        self.padded = np.append(keys, np.uint64(0))

    def find(self, h: np.ndarray) -> np.ndarray:
        """The place of each hash, -1 for those that are not there."""
        slot = (h >> self.shift).astype(np.int64)
        at = self.start[slot]
        rest = np.flatnonzero(self.padded[at] != h)
        end = self.start[slot[rest] + 1]
        h, place = h[rest], at[rest]
        missing = np.zeros(len(rest), bool)
        while len(live := np.flatnonzero(~missing)):
            place[live] += 1
            gone = place[live] >= end[live]
            missing[live[gone]] = True
            live = live[~gone]
            same = self.padded[place[live]] == h[live]
            at[rest[live[same]]] = place[live[same]]
            keep = np.ones(len(rest), bool)
            keep[live[same]] = False
            at[rest[missing]] = -1
            keep &= ~missing
            rest, end, h, place, missing = rest[keep], end[keep], h[keep], place[keep], missing[keep]
        return at


class Grams:
    """The distinct n-grams of a chunk, with their counts."""

    def __init__(self, order: int, piece: int):
        self.order, self.piece = order, piece
        self.counts, self.points = np.zeros(0, np.int64), np.zeros((0, order), np.uint32)
        self.table = Table(np.zeros(0, np.uint64))

    def add(self, texts: Iterable[str | None]) -> None:
        for piece in pieces(texts, self.order, self.piece):
            at = self.table.find(piece.hashes)
            self.counts += np.bincount(at[at >= 0], minlength=len(self.counts))
            unknown = np.flatnonzero(at < 0)
            if len(unknown):
                keys, first, count = np.unique(piece.hashes[unknown], return_index=True, return_counts=True)
                both = np.concatenate([self.table.keys, keys])
                order = np.argsort(both, kind="stable")
                self.table, self.counts = Table(both[order]), np.concatenate([self.counts, count])[order]
                self.points = np.concatenate([self.points, piece.grams(unknown[first])])[order]

    def rows(self, chunk: int) -> Iterator[pa.RecordBatch]:
        for at in range(0, len(self.points), 1 << 16):
            part = self.points[at : at + (1 << 16)]
            joined, n = part.astype("<u4").tobytes().decode("utf-32-le"), self.order
            grams = pa.array([joined[i : i + n] for i in range(0, len(joined), n)], pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), chunk), pa.int64()), grams, pa.array(self.counts[at : at + len(part)])], names=["chunk", "gram", "n"])


def _numbered(df: DataFrame) -> DataFrame:
    """``df`` after a first column with the number of the partition that a row is read in."""
    return df.select(F.spark_partition_id().alias("partition"), *df.columns)


def _chunk(batch: pa.RecordBatch, serial: int) -> int:
    return (batch.column(0)[0].as_py() << 24) + serial


def gram_counts(texts: DataFrame, order: int = ORDER) -> DataFrame:
    """``chunk, gram, n``: the distinct n-grams of each chunk of a table with one column, the text or that in zstandard form.

    A chunk is what a task reads, or as many rows of it as hold CHUNK characters.
    """
    most, piece = CHUNK, PIECE

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        serial, size, grams, held, waiting, batch = 0, 0, Grams(order, piece), [], 0, None
        press = zstandard.ZstdDecompressor()
        for batch in batches:
            for text in batch.column(1):
                text = text.as_py()
                text = press.decompress(text).decode() if isinstance(text, bytes) else text
                held.append(text)
                size, waiting = size + len(text or ""), waiting + len(text or "")
                if waiting >= piece or size >= most:
                    grams.add(held)
                    held, waiting = [], 0
                if size >= most:
                    yield from grams.rows(_chunk(batch, serial))
                    serial, size, grams = serial + 1, 0, Grams(order, piece)
        grams.add(held)
        if batch is not None and len(grams.points):
            yield from grams.rows(_chunk(batch, serial))

    return _numbered(texts).mapInArrow(trimming(scan), "chunk long, gram string, n long")


def _block(chunk: int, part: int, rows: pa.RecordBatch) -> pa.RecordBatch:
    """One row, ``chunk, part, block``, that holds rows in compressed form."""
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, rows.schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", compression_level=6))) as out:
        out.write_batch(rows)
    return pa.RecordBatch.from_arrays([pa.array([chunk], pa.int64()), pa.array([part], pa.int32()), pa.array([sink.getvalue().to_pybytes()], pa.binary())], names=["chunk", "part", "block"])


def _blocks(docs: DataFrame, text: str) -> DataFrame:
    """``chunk, part, block``: the rows themselves, compressed, by the chunks that ``gram_counts`` makes of their texts."""
    column, most, room = docs.columns.index(text) + 1, CHUNK, BLOCK

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        serial = size = part = 0

        def put(rows: pa.RecordBatch) -> pa.RecordBatch:
            return _block(_chunk(rows, serial), part, rows.select([*range(1, rows.num_columns)]))

        for batch in batches:
            lengths = pc.fill_null(pc.utf8_length(batch.column(column)), 0).to_pylist()
            begin = here = 0
            for i, n in enumerate(lengths):
                size, here = size + n, here + n
                if here >= room or size >= most:
                    yield put(batch.slice(begin, i + 1 - begin))
                    begin, here, part = i + 1, 0, part + 1
                if size >= most:
                    serial, size, part = serial + 1, 0, 0
            if begin < len(lengths):
                yield put(batch.slice(begin))
                part += 1

    return _numbered(docs).mapInArrow(trimming(scan), BLOCKS)


def discounts(n1: int, n2: int, n3: int, n4: int) -> tuple[float, float, float]:
    """Modified Kneser-Ney discounts for counts of one, two, and three or more; 0.1 at least, so that nothing is impossible."""
    y = n1 / (n1 + 2 * n2) if n1 else 0.0
    steps = [(1, n1, n2), (2, n2, n3), (3, n3, n4)]
    return tuple(min(float(k), max(0.1, k - (k + 1) * y * b / a)) if a else 0.5 * k * (y or 1.0) for k, a, b in steps)


def _cut(n: Column, d: tuple[float, float, float]) -> Column:
    return F.when(n >= 3, d[2]).when(n == 2, d[1]).otherwise(d[0])


class Model:
    """The tables of a trained model: probabilities of seen grams, and back-off weights of contexts, by order.

    ``seen[k]`` is ``gram, p``; ``spare[k]`` is ``context, weight`` (k of at least 2);
    ``rest`` is the probability of a symbol that was never seen.
    """

    def __init__(self, counts: DataFrame, order: int):
        self.order, self.seen, self.spare = order, {}, {}
        levels = {order: materialise(counts, "quality-counts")}
        for k in range(order - 1, 0, -1):
            levels[k] = materialise(levels[k + 1].groupBy(F.substring("gram", 2, k).alias("gram")).agg(F.count("*").alias("n")), "quality-counts")
        few = None
        for k, level in levels.items():
            own = level.where("n <= 4").groupBy("n").count().select(F.lit(k).alias("k"), "n", "count")
            few = own if few is None else few.union(own)
        of = {(r.k, r.n): r["count"] for r in few.collect()}  # four numbers an order
        cut = {k: discounts(*(of.get((k, n), 0) for n in (1, 2, 3, 4))) for k in levels}
        n = F.col("n")
        whole = levels[1].agg(F.count("*").alias("symbols"), F.sum("n").alias("total"), F.sum(_cut(n, cut[1])).alias("spare")).first()
        self.rest = whole.spare / whole.total / (whole.symbols + 1) if whole.total else 1.0
        below = None
        for k in range(1, order + 1):
            table = levels[k]
            if k == 1:
                p = table.select("gram", ((n - _cut(n, cut[1])) / (whole.total or 1) + self.rest).alias("p"))
            else:
                context = F.substring("gram", 1, k - 1)
                sums = table.groupBy(context.alias("context")).agg(F.sum("n").alias("total"), F.sum(_cut(n, cut[k])).alias("cut"))
                sums = materialise(sums.select("context", "total", (F.col("cut") / F.col("total")).alias("weight")), "quality-contexts")
                self.spare[k] = sums.select("context", "weight")
                rows = table.select("gram", "n", context.alias("context"), F.substring("gram", 2, k - 1).alias("suffix"))
                rows = rows.join(sums, "context").join(below.select(F.col("gram").alias("suffix"), F.col("p").alias("lower")), "suffix")
                p = rows.select("gram", ((n - _cut(n, cut[k])) / F.col("total") + F.col("weight") * F.col("lower")).alias("p"))
            self.seen[k] = below = materialise(p, "quality-seen")

    def probabilities(self, grams: DataFrame) -> DataFrame:
        """``gram, p`` of distinct ``gram``, seen or not."""
        rows = grams.join(self.seen[self.order], "gram", "left")
        unseen = materialise(rows.where("p is null").select("gram"), "quality-unseen")
        return rows.where("p is not null").unionByName(self.unseen(unseen))

    def unseen(self, grams: DataFrame) -> DataFrame:
        """``gram, p`` of distinct ``gram`` that were not seen in training.

        Such a gram has the weight its context leaves (1 for an unseen context) times the
        probability of the gram without its first symbol, which may be unseen in turn.
        """
        asked, seen = {self.order: grams}, {}
        for k in range(self.order - 1, 0, -1):
            lower = asked[k + 1].select(F.substring("gram", 2, k).alias("gram")).distinct()
            rows = materialise(lower.join(self.seen[k], "gram", "left"), "quality-asked")
            seen[k], asked[k] = rows.where("p is not null"), rows.where("p is null").select("gram")
        told = seen[1].unionByName(asked[1].withColumn("p", F.lit(self.rest)))
        for k in range(2, self.order + 1):
            lower = told.select(F.col("gram").alias("suffix"), F.col("p").alias("lower"))
            rows = asked[k].select("gram", F.substring("gram", 1, k - 1).alias("context"), F.substring("gram", 2, k - 1).alias("suffix"))
            rows = rows.join(self.spare[k], "context", "left").join(lower, "suffix")
            found = rows.select("gram", (F.coalesce("weight", F.lit(1.0)) * F.col("lower")).alias("p"))
            told = materialise(found if k == self.order else seen[k].unionByName(found), "quality-told")
        return told


def train(texts: DataFrame, order: int = ORDER) -> Model:
    """The model of a table with one column, the text. Without any text all symbols are equally likely."""
    return Model(gram_counts(texts, order).groupBy("gram").agg(F.sum("n").alias("n")), order)


def surprisals(docs: DataFrame, model: Model, margin: float, text: str = "text", keep: bool = True) -> DataFrame:
    """``docs`` with ``mean`` and ``low`` (a column of each name must not be there): bits a character, and the lower confidence end.

    Both are null for an empty text. ``keep`` False leaves the text out of the result. ``docs`` is read twice and must be the same both
    times, rows in the same partitions, as a table is; else this raises.
    """
    order, piece, pack = model.order, PIECE, PACK
    requests = gram_counts(docs.select(text), order).select("gram", "chunk", F.lit(None).cast("double").alias("p"))
    both = requests.unionByName(model.seen[order].select("gram", F.lit(None).cast("long").alias("chunk"), "p"))
    # A common gram is asked for by every chunk: its chunks are listed a bounded number at a time.
    listed = both.groupBy("gram", F.shiftrightunsigned("chunk", 36).alias("some")).agg(F.collect_list("chunk").alias("chunks"), F.max("p").alias("p"))
    found = Window.partitionBy("gram")
    listed = materialise(listed.withColumn("p", F.max("p").over(found)).where("size(chunks) > 0").select("gram", "chunks", "p"), "quality-requests")
    unseen = listed.where("p is null")
    told = listed.where("p is not null").unionByName(unseen.drop("p").join(model.unseen(materialise(unseen.select("gram").distinct(), "quality-unseen")), "gram"))
    answers = told.select(F.explode("chunks").alias("chunk"), "gram", (-F.log2("p")).cast("float").alias("bits"))

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def out() -> Iterator[pa.RecordBatch]:
            rows = pa.Table.from_batches(held).sort_by([("chunk", "ascending"), ("gram", "ascending")]).combine_chunks()
            chunk = rows.column(0).to_numpy()
            edges = np.flatnonzero(chunk[1:] != chunk[:-1]) + 1
            for a, b in zip([0, *edges], [*edges, len(chunk)], strict=True):
                yield _block(int(chunk[a]), -1, rows.slice(a, b - a).select(["gram", "bits"]).combine_chunks().to_batches()[0])

        for batch in batches:
            held.append(batch)
            size += batch.num_rows
            if size >= pack:
                yield from out()
                held, size = [], 0
        if size:
            yield from out()

    met = answers.mapInArrow(trimming(packed), BLOCKS).unionByName(_blocks(docs, text)).repartition("chunk").sortWithinPartitions("chunk", "part")
    kept = [k for k, c in enumerate(docs.columns) if keep or c != text]
    schema = StructType([*(docs.schema.fields[k] for k in kept), StructField("mean", DoubleType()), StructField("low", DoubleType())])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, waiting, table, bits = None, [], None, None

        def known() -> tuple[Table, np.ndarray]:
            rows = [x for block in waiting for x in pa.ipc.open_stream(block)]
            points = np.frombuffer("".join("".join(x.column(0).to_pylist()) for x in rows).encode("utf-32-le"), np.uint32).reshape(-1, order)
            h = (points.astype(np.uint64) * _factors(order)).sum(axis=1, dtype=np.uint64)
            at = np.argsort(h)
            return Table(h[at]), np.concatenate([*(x.column(1).to_numpy() for x in rows), np.zeros(0, np.float32)])[at].astype(np.float64)

        def scored(block: bytes) -> Iterator[pa.RecordBatch]:
            for rows in pa.ipc.open_stream(block):
                texts = rows.column(rows.schema.get_field_index(text)).to_pylist()
                sums = np.zeros((3, len(texts)))
                for x in pieces(texts, order, piece):
                    at = table.find(x.hashes)
                    if (at < 0).any():
                        raise RuntimeError(_MISSING)
                    s = bits[at]
                    for total, own in zip(sums, (x.lengths, x.sums(s), x.sums(s * s)), strict=True):
                        total[x.numbers] += own
                n, total, squares = sums
                some = n > 0
                mean = total / np.maximum(n, 1)
                sd = np.sqrt(np.maximum(0, squares / np.maximum(n, 1) - mean * mean))
                low = np.round(np.maximum(0, mean - margin * sd / np.sqrt(np.maximum(n, 1))), 6)
                more = [pa.array(x, pa.float64(), mask=~some) for x in (np.round(mean, 6), low)]
                yield pa.RecordBatch.from_arrays([*(rows.column(k) for k in kept), *more], names=[f.name for f in schema])

        for batch in batches:
            for chunk, part, block in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                if chunk != current:
                    current, waiting, table = chunk, [], None
                if part < 0:
                    waiting.append(block.as_py())
                    continue
                if table is None:
                    table, bits = known()
                    waiting = []
                yield from scored(block.as_py())

    return met.mapInArrow(trimming(score), schema)


def trusted_ids(labels: DataFrame) -> DataFrame:
    """``doc_id`` of documents whose labels all say quality 1."""
    return labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").alias("q")).where("q = 1").select("doc_id")


def held_out() -> Column:
    """Whether a trusted document sets the threshold and is not trained on."""
    return F.pmod(F.xxhash64(F.lit(8), F.col("doc_id").cast("long")), F.lit(HELD_OUT)) == 0


def fit(docs: DataFrame, labels: DataFrame, order: int = ORDER) -> Model:
    """The model of the trusted documents of ``docs(doc_id, text)`` that are not held out."""
    @F.pandas_udf("binary")
    def small(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        press = zstandard.ZstdCompressor(level=3)
        for x in texts:
            yield pd.Series([None if t is None else press.compress(t.encode()) for t in x], dtype=object)

    trusted = trusted_ids(labels).where(~held_out())
    some = slot_filter(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), "doc_id", trusted).where("slot_hit").drop("slot_hit")
    met = some.select("doc_id", small("text").alias("block")).join(trusted.hint("shuffle_hash"), "doc_id", "left_semi")
    return train(met.select("block"), order)


def told(scored: DataFrame, labels: DataFrame, quantile: float, slack: float) -> DataFrame:
    """``scored`` (with ``doc_id, lang, mean, low``) and ``verdict``: perplexity, its lower end, threshold, rejected.

    The quantile is read off counts by thousandths of a bit, rounded up.
    """
    known = scored.select("doc_id", "lang", "low").join(trusted_ids(labels).where(held_out()), "doc_id", "left_semi").where("low is not null")
    counts = known.groupBy(F.col("lang").alias("threshold_lang"), F.ceil(F.col("low") * 1000).alias("bits")).agg(F.count("*").alias("n"))
    by = Window.partitionBy("threshold_lang")
    upto = counts.withColumn("upto", F.sum("n").over(by.orderBy("bits"))).withColumn("all", F.sum("n").over(by))
    thresholds = materialise(upto.where(F.col("upto") >= quantile * F.col("all")).groupBy("threshold_lang").agg((F.min("bits") / 1000 + slack).alias("threshold")), "quality-thresholds")
    power = lambda c: F.pow(F.lit(2.0), c)
    verdict = F.struct(power("mean").alias("perplexity"), power("low").alias("perplexity_low"), power("threshold").alias("threshold"), F.coalesce(F.col("low") > F.col("threshold"), F.lit(False)).alias("rejected"))
    return scored.join(thresholds, F.col("lang").eqNullSafe(F.col("threshold_lang")), "left").withColumn("verdict", verdict)


def report(docs: DataFrame, labels: DataFrame, quantile: float = 0.99, slack: float = 0.15, margin: float = 2.0, order: int = ORDER) -> DataFrame:
    """``doc_id, lang, perplexity, perplexity_low, threshold, rejected`` for each row of ``docs``.

    An empty or null text has no perplexity and is not rejected, nor is any text in a
    language that has no held-out trusted document; a null lang is a language of its own.
    Conflicting labels of a document make it untrusted. Very long texts are read in
    pieces. Repeated rows are scored alike. Extra columns are ignored. An empty table
    gives an empty result.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "lang", "text")
    scored = materialise(surprisals(rows, fit(docs, labels, order), margin, keep=False), "quality-scored")
    return told(scored, labels, quantile, slack).select("doc_id", "lang", "verdict.*")


def accept(docs: DataFrame, labels: DataFrame, quantile: float = 0.99, slack: float = 0.15, margin: float = 2.0, order: int = ORDER) -> DataFrame:
    """``docs`` without those that ``report`` rejects; all columns stay, whatever their names."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "lang", "text", whole_row(docs.drop("text")))
    scored = materialise(surprisals(rows, fit(docs, labels, order), margin), "quality-scored")
    back = [F.col("text") if c == "text" else F.col(f"row.`{c}`") for c in docs.columns]
    return told(scored, labels, quantile, slack).where("not verdict.rejected").select(*back)
