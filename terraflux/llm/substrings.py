"""Operator 4. Substring deduplication by de Bruijn compaction.

Every run of ``span`` words is an edge of a de Bruijn graph over words. Edges are first
compacted within their document: a content-defined anchor (the least of the hashed
``seed``-word k-mers inside a window) is chosen for each window, and the maximal run of
consecutive windows with one anchor is a path without branches there. Equal windows
choose equal anchors, so two documents that share a window meet at its anchor.

* Paths with the same words are joined into one class; whoever holds it, but for the
  document with the smallest id, repeats all its windows. The class keeps the coordinates
  of its source: the first document, and where the path begins there.
* An anchor with one class is a nonbranching node and is settled. Where an anchor has
  several classes the paths branch, and the first holder of each class is taken apart
  into single windows, which are joined in turn.
* Repeated paths that go on from each other both in the document and in the source are
  compacted into one long span, with one source coordinate.
* A path that a document holds many times (a line said again and again) is one row there,
  with the starts of all its copies, from the first step to the last.

So far spans rest on 128-bit keys. Each is then verified on words: its source document is
read at the source coordinates and gives a cryptographic digest of the words there, and
only a span whose own words have that digest is removed.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, slot_filter, trimming, whole_row

_MIX = np.uint64(0x9E3779B97F4A7C15)
_BASE = 0xD6E8FEB86659FD93
#: lo and hi: first and last window of the first copy; later: where the other copies begin.
PATH = "h1 long, h2 long, anchor long, doc_id long, of long, lo int, hi int, later array<int>"
WINDOW = "h1 long, h2 long, doc_id long, of long, lo int, hi int, later array<int>"
#: Rows put together before they are handed to Spark; spans of one source that a task proves together; later copies that take the room of a span.
BATCH, PROVED, ROOM = 1 << 16, 4096, 16


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().split()


def _keys(words: list[bytes], lo, hi, span: int, key=xxhash.xxh3_128_digest) -> list[bytes]:
    """128-bit keys of words[lo[i] : hi[i] + span]."""
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    begins = np.concatenate([[0], ends[:-1] + 1])
    a, b = begins[lo].tolist(), ends[np.asarray(hi) + span - 1].tolist()
    return [key(joined[i:j]) for i, j in zip(a, b, strict=True)]


def _digest(words: bytes) -> bytes:
    return hashlib.blake2b(words, digest_size=16).digest()


def _identified(docs: DataFrame) -> DataFrame:
    """``doc_id, of, text``: rows that share an id are told apart by a hash of their text."""
    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("of"), text.alias("text"))


def paths(words: list[bytes], span: int, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First window, last window and anchor hash of each run of windows with one anchor."""
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    n = len(words) - seed + 1
    gram = h[:n].copy()
    for j in range(1, seed):
        gram += h[j : n + j] * np.uint64(pow(_BASE, j, 1 << 64))
    gram ^= gram >> np.uint64(29)
    gram *= _MIX
    gram ^= gram >> np.uint64(32)
    least = (gram & np.uint64(0xFFFFFFFF00000000)) | np.arange(n, dtype=np.uint64)
    wide, width = 1, span - seed + 1
    while wide * 2 <= width:
        least = np.minimum(least[:-wide], least[wide:])
        wide *= 2
    if wide < width:
        least = np.minimum(least[: len(least) - (width - wide)], least[width - wide :])
    turn = np.flatnonzero(least[1:] != least[:-1])
    lo = np.concatenate([[0], turn + 1])
    hi = np.concatenate([turn, [len(least) - 1]])
    return lo, hi, gram[(least[lo] & np.uint64(0xFFFFFFFF)).astype(np.int64)]


def _copies(keys: list[bytes]) -> tuple[list[bytes], list[int], list[int], list[int]]:
    """The different keys, where each stands first, how often later, and where, key by key."""
    if len(set(keys)) == len(keys):
        return keys, list(range(len(keys))), [0] * len(keys), []
    at: dict[bytes, list[int]] = {}
    for i, k in enumerate(keys):
        at.setdefault(k, []).append(i)
    return list(at), [x[0] for x in at.values()], [len(x) - 1 for x in at.values()], [i for x in at.values() for i in x[1:]]


def _everywhere(lo: np.ndarray, hi: np.ndarray, counts: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First and last windows of all copies, and which of the given spans each is a copy of."""
    own = np.arange(len(lo))
    which = np.concatenate([own, np.repeat(own, counts)])
    begin = np.concatenate([lo, starts])
    return begin, begin + (hi - lo)[which], which


def _batches(rows: Iterator[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Gathers (keys, *columns, lo, hi) of single documents, one row for each different key, into batches; a column may be one value for all its rows."""
    held, count = [], 0

    def out() -> pa.RecordBatch:
        key = np.frombuffer(b"".join(k for ks, *_ in held for k in ks), np.int64).reshape(-1, 2)
        rest = [np.concatenate([np.broadcast_to(x[i], len(x[0])) for x in held]) for i in range(1, len(held[0]) - 2)]
        ends = np.cumsum(np.concatenate([[0], *(x[-2] for x in held)]))
        later = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([x[-1] for x in held]), pa.int32()))
        return pa.RecordBatch.from_arrays([*(pa.array(x, f.type) for x, f in zip((key[:, 0], key[:, 1], *rest), schema, strict=False)), later], schema=schema)

    for keys, *columns, lo, hi in rows:
        keys, first, counts, later = _copies(keys)
        held.append((keys, *(x[first] if isinstance(x, np.ndarray) else x for x in columns), lo[first], hi[first], counts, lo[later]))
        count += len(lo)
        if count >= BATCH:
            yield out()
            held, count = [], 0
    if held:
        yield out()


def _arrow(ddl: str) -> pa.Schema:
    return pa.schema([(n, {"long": pa.int64(), "int": pa.int32(), "array<int>": pa.list_(pa.int32())}[t]) for n, t in (x.split() for x in ddl.split(", "))])


def path_table(docs: DataFrame, span: int = 50, seed: int = 8) -> DataFrame:
    """Compacted paths of each document of ``docs(doc_id, of, text)`` with a doc_id and at least ``span`` words."""
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for batch in batches:
                for doc_id, of, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                    if len(words := words_of(text.as_py())) >= span:
                        lo, hi, anchor = paths(words, span, seed)
                        yield _keys(words, lo, hi, span), anchor.view(np.int64), doc_id, of, lo, hi

        return _batches(rows(), _arrow(PATH))

    return docs.where("doc_id is not null").select("doc_id", "of", "text").mapInArrow(trimming(scan), PATH)


def _marked(docs: DataFrame, spans: DataFrame, column: str = "proof") -> DataFrame:
    """``docs`` that may hold ``spans``, each with the list of its spans (null: none)."""
    lists = spans.groupBy("doc_id", "of").agg(F.collect_list(F.struct(column, "lo", "hi", "later")).alias("spans"))
    lists = lists.select(F.col("doc_id").alias("span_doc"), F.col("of").alias("span_of"), "spans")
    met = (F.col("doc_id") == F.col("span_doc")) & (F.col("of") == F.col("span_of"))
    return docs.join(lists.hint("shuffle_hash"), met, "left").drop("span_doc", "span_of")


def _listed(column: pa.Array) -> Iterator[tuple[list, np.ndarray, np.ndarray] | None]:
    """The first field, first and last windows of each list, a later copy as an entry of its own."""
    for x in column:
        if not x.is_valid:
            yield None
        else:
            v = x.values
            head, later = v.field(0).to_pylist(), v.field(3)
            lo, hi, counts, starts = (y.to_numpy(zero_copy_only=False) for y in (v.field(1), v.field(2), later.value_lengths(), later.flatten()))
            lo, hi, which = _everywhere(lo, hi, counts, starts)
            yield [head[k] for k in which.tolist()], lo, hi


def window_table(docs: DataFrame, open_paths: DataFrame, span: int) -> DataFrame:
    """The single windows of ``open_paths``."""
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for batch in batches:
                for doc_id, of, text, listed in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), _listed(batch.column(3)), strict=True):
                    words = words_of(text.as_py())
                    _, lo, hi = listed
                    at = np.unique(np.concatenate([np.arange(a, b + 1) for a, b in zip(lo, hi, strict=True)]))
                    yield _keys(words, at, at, span), doc_id, of, at, at

        return _batches(rows(), _arrow(WINDOW))

    some = slot_filter(docs.select("doc_id", "of", "text"), "of", open_paths.select("of")).where("slot_hit").drop("slot_hit")
    return _marked(some, open_paths, "h1").where("spans is not null").select("doc_id", "of", "text", "spans").mapInArrow(trimming(scan), WINDOW)


def compacted(spans: DataFrame) -> DataFrame:
    """Spans that go on from each other, in the source and in all copies in the document, as one."""
    line = Window.partitionBy("doc_id", "of", "src_doc", "src_of", "shift", "shifts").orderBy("lo", "hi")
    known = spans.withColumn("shift", F.col("src_lo") - F.col("lo")).withColumn("shifts", F.transform("later", lambda x: F.col("src_lo") - x)).withColumn("reach", F.max("hi").over(line.rowsBetween(Window.unboundedPreceding, -1)))
    runs = known.withColumn("run", F.sum(F.when(F.col("lo") <= F.col("reach") + 1, 0).otherwise(1)).over(line))
    out = runs.groupBy("doc_id", "of", "src_doc", "src_of", "shift", "shifts", "run").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    out = out.withColumn("src_lo", F.col("lo") + F.col("shift"))
    return out.select("doc_id", "of", "lo", "hi", F.transform("shifts", lambda x: F.col("src_lo") - x).alias("later"), "src_doc", "src_of", "src_lo")


def proved(docs: DataFrame, spans: DataFrame, span: int) -> DataFrame:
    """``doc_id, of, lo, hi, later, proof``: each span with the digest of the words at its source.

    The spans of a source are listed and meet its text; the lists of all sources are split
    by the holder into as many as the most wanted source needs to have PROVED in each, or
    ROOM times as many later copies.
    """
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text, listed in zip(batch.column(0), batch.column(1), strict=True):
                doc_id, of, lo, hi, later, begin = (listed.values.field(k) for k in range(6))
                low, high = lo.to_numpy(zero_copy_only=False), hi.to_numpy(zero_copy_only=False)
                src = begin.to_numpy(zero_copy_only=False)
                places, which = np.unique(np.stack([src, src + high - low], 1), axis=0, return_inverse=True)
                proofs = _keys(words_of(text.as_py()), places[:, 0], places[:, 1], span, _digest)
                yield pa.RecordBatch.from_arrays([doc_id, of, lo, hi, later, pa.array([proofs[k] for k in which.ravel().tolist()], pa.binary())], names=["doc_id", "of", "lo", "hi", "later", "proof"])

    room = F.sum(ROOM + F.size("later")).alias("room")
    most = spans.groupBy("src_doc", "src_of").agg(room).agg(F.max("room")).first()[0] or 0
    slot = F.pmod(F.xxhash64("doc_id", "of", "lo"), F.lit(max(1, -(-most // (PROVED * ROOM)))))
    lists = spans.groupBy("src_doc", "src_of", slot.alias("slot")).agg(F.collect_list(F.struct("doc_id", "of", "lo", "hi", "later", "src_lo")).alias("spans"))
    some = slot_filter(docs.select("doc_id", "of", "text"), "of", spans.select("src_of")).where("slot_hit").drop("slot_hit").dropDuplicates(["doc_id", "of"])
    met = some.join(lists.hint("shuffle_hash"), (some["doc_id"] == lists["src_doc"]) & (some["of"] == lists["src_of"]))
    return met.select("text", "spans").mapInArrow(trimming(scan), "doc_id long, of long, lo int, hi int, later array<int>, proof binary")


def repeated_spans(docs: DataFrame, span: int = 50, seed: int = 8) -> DataFrame:
    """Runs of windows of each document that start in a document with a smaller doc_id too.

    ``docs`` is what ``_identified`` gives. Columns ``doc_id, of, lo, hi, later, proof``:
    windows lo to hi, the starts of further copies of them in the document, and the digest
    of the words from lo to hi + span as they stand in the source.
    """
    if not 0 < seed <= span:
        raise ValueError("seed must be 1 to span")
    path = materialise(path_table(docs, span, seed), "substring-paths")
    first = F.min(F.struct("doc_id", "of", "lo")).alias("first")
    classes = path.groupBy("h1", "h2").agg(F.min("anchor").alias("anchor"), first, F.max("doc_id").alias("last_doc"))
    branching = classes.groupBy("anchor").agg(F.count("*").alias("ways"), F.min("first.doc_id").alias("x"), F.max("last_doc").alias("y")).where("ways > 1 and x < y").select("anchor", F.lit(True).alias("branches"))
    told = classes.join(branching, "anchor", "left").where("last_doc > first.doc_id or branches").select("h1", "h2", "first", "branches")
    source = [F.col("first.doc_id").alias("src_doc"), F.col("first.of").alias("src_of"), F.col("first.lo").alias("src_lo")]
    met = path.join(told, ["h1", "h2"]).where("doc_id > first.doc_id or branches").select("h1", "doc_id", "of", "lo", "hi", "later", (F.col("doc_id") > F.col("first.doc_id")).alias("repeats"), *source)
    met = materialise(met, "substring-met")
    windows = materialise(window_table(docs, met.where("not repeats").select("h1", "doc_id", "of", "lo", "hi", "later"), span), "substring-windows")
    shared = windows.groupBy("h1", "h2").agg(first, F.max("doc_id").alias("last_doc")).where("last_doc > first.doc_id").drop("last_doc")
    single = windows.join(shared, ["h1", "h2"]).where("doc_id > first.doc_id").select("doc_id", "of", "lo", "hi", "later", *source)
    spans = materialise(compacted(met.where("repeats").drop("h1", "repeats").unionByName(single)), "substring-long")
    return proved(docs, spans, span)


def _cut(words: list[bytes], listed, span: int) -> list[bytes]:
    """The words outside all windows whose words are those of the source."""
    proofs, lo, hi = listed
    fits = hi + span <= len(words)
    proofs, lo, hi = [p for p, f in zip(proofs, fits, strict=True) if f], lo[fits], hi[fits]
    same = np.array([a == b for a, b in zip(proofs, _keys(words, lo, hi, span, _digest), strict=True)], bool) if len(lo) else np.zeros(0, bool)
    change = np.zeros(len(words) + 1, np.int64)
    np.add.at(change, lo[same], 1)
    np.add.at(change, hi[same] + span, -1)
    keep = np.flatnonzero(np.cumsum(change[:-1]) == 0)
    return [words[i] for i in keep.tolist()] if len(keep) < len(words) else words


def _applied(rows: DataFrame, docs: DataFrame, span: int, seed: int) -> list[DataFrame]:
    """``rows`` (with ``doc_id, of``) and a column ``spans``; those that can't have any are kept out of the join."""
    spans = materialise(repeated_spans(docs, span, seed), "substring-spans")
    flagged = slot_filter(rows, "of", spans.select("of"))
    none = F.lit(None).cast("array<struct<proof:binary,lo:int,hi:int,later:array<int>>>")
    return [_marked(flagged.where("slot_hit").drop("slot_hit"), spans), flagged.where("not slot_hit").drop("slot_hit").withColumn("spans", none)]


def digest(docs: DataFrame, span: int = 50, seed: int = 8) -> DataFrame:
    """``doc_id, n_words, n_removed, kept_sha256`` for each row of ``docs(doc_id, text)``.

    A null or wordless text has no words and the digest of nothing. A row with a null
    doc_id keeps all its words and is no one's source, as null is not smaller than any
    id. Repeated rows repeat nothing of each other, as their ids are equal. Very long
    texts are read whole. Extra columns are ignored; an empty table gives an empty result.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string())])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, listed in zip(batch.column(1), _listed(batch.column(2)), strict=True):
                words = words_of(text.as_py())
                kept = words if listed is None else _cut(words, listed, span)
                out.append((len(words), len(words) - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest()))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([x[i] for x in out], schema.field(i + 1).type) for i in range(3))], schema=schema)

    docs = _identified(docs)
    parts = [x.select("doc_id", "text", "spans").mapInArrow(trimming(scan), "doc_id long, n_words long, n_removed long, kept_sha256 string") for x in _applied(docs, docs, span, seed)]
    return parts[0].union(parts[1])


def deduplicate(docs: DataFrame, span: int = 50, seed: int = 8) -> DataFrame:
    """``docs`` with repeated spans cut out of ``text``; kept words are joined by one space.

    Texts that lose nothing stay as they are, white space included. ``n_chars``, where
    there is such a column, is counted anew for the others. No row is dropped.
    """
    @F.pandas_udf("string")
    def cut(texts, spans):
        import pandas as pd

        out = []
        for text, listed in zip(texts, _listed(pa.Array.from_pandas(spans, type=_SPANS)), strict=True):
            words = words_of(text)
            kept = words if listed is None else _cut(words, listed, span)
            out.append(text if len(kept) == len(words) else b" ".join(kept).decode())
        return pd.Series(out, dtype=object)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.col("text").cast("string")).alias("of"), whole_row(docs))
    joined, rest = _applied(rows, _identified(docs), span, seed)
    shorter = F.col("row").withField("text", F.col("cut"))
    if "n_chars" in docs.columns:
        shorter = shorter.withField("n_chars", F.length("cut").cast(docs.schema["n_chars"].dataType))
    joined = joined.withColumn("cut", F.when(F.col("spans").isNotNull(), cut("row.text", "spans")))
    joined = joined.withColumn("row", F.when(F.col("cut").isNull() | F.col("cut").eqNullSafe(F.col("row.text")), F.col("row")).otherwise(shorter))
    return joined.select("row.*").unionByName(rest.select("row.*"))


_SPANS = pa.list_(pa.struct([("proof", pa.binary()), ("lo", pa.int32()), ("hi", pa.int32()), ("later", pa.list_(pa.int32()))]))
