"""Operator 1. Exact top-k by inner product over a bit-sliced index.

Components are quantised to floor(scale * x). A block of rows is stored as bit slices:
for each dimension, one bitmap per binary digit of the value above the block's least.
For a query the slices are added with bitmap arithmetic: a slice of weight 2**j counts
at 2**(j + b) for each digit b of the query's component, and layers of full adders
reduce all slices of one weight to one slice of the sum. A negative component takes the
complement of the slices and a constant. The rows with the k greatest sums are then
selected from the most significant slice downward; rows equal on all slices are the
boundary, which is resolved exactly by the smaller id.

Blocks of rows meet blocks of queries; a pair of blocks is one piece of work, and each
returns its k best rows for each of its queries.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise
from .vectors import matrices

#: Rows of a stored slice set, slice sets worked on together, queries of a block, blocks of queries that meet one group,
#: and the limit of a quantised value (a score must fit a long).
ROWS, GROUP, QUERIES, ASKED, LIMIT = 4096, 16, 64, 64, 1 << 62


def slices(q: np.ndarray) -> np.ndarray:
    """Bit slices (dimension, digit, words of 64 rows) of a block (rows, dimensions) in two's complement."""
    digits = int(np.abs(q).max()).bit_length() + 1
    u = q.view(np.uint64) & np.uint64((1 << digits) - 1)
    if pad := -len(u) % 64:
        u = np.vstack([u, np.zeros((pad, u.shape[1]), np.uint64)])
    bits = ((u.T[:, None, :] >> np.arange(digits, dtype=np.uint64)[None, :, None]) & np.uint64(1)).astype(np.uint8)
    return np.ascontiguousarray(np.packbits(bits, axis=2, bitorder="little")).view(np.uint64)


def added(cut: np.ndarray, query: np.ndarray) -> tuple[int, list[np.ndarray]]:
    """The sum over dimensions of query * value: a constant, and the slices of the rest by weight.

    ``cut`` holds values raised by half their range, so that all digits count upward.
    """
    d, digits, words = cut.shape
    flat = cut.reshape(d * digits, words)
    size = np.abs(query)
    weight = defaultdict(list)
    negative = query < 0
    for b in range(int(size.max()).bit_length() if d else 0):
        rows = np.flatnonzero((size >> b) & 1)
        for j in range(digits):
            weight[b + j].append(rows * digits + j)
    constant = -sum(query.tolist()) * (1 << (digits - 1)) - sum(size[negative].tolist()) * ((1 << digits) - 1)
    flip = np.where(np.repeat(negative, digits), np.uint64(0xFFFFFFFFFFFFFFFF), np.uint64(0))
    out, carried = [], []
    w = 0
    while w in weight or carried:
        layer = carried
        if w in weight:
            rows = np.concatenate(weight[w])
            layer = [flat[rows] ^ flip[rows][:, None], *layer]
        planes, carried = np.concatenate(layer) if layer else np.zeros((0, words), np.uint64), []
        while len(planes) > 1:
            n = len(planes) // 3
            if n:
                a, b, c = planes[:n], planes[n : 2 * n], planes[2 * n : 3 * n]
                x = a ^ b
                carried.append((a & b) | (c & x))
                planes = np.concatenate([x ^ c, planes[3 * n :]])
            else:
                carried.append(planes[:1] & planes[1:])
                planes = planes[:1] ^ planes[1:]
        out.append(planes[0] if len(planes) else np.zeros(words, np.uint64))
        w += 1
    return constant, out


def select(sums: list[np.ndarray], live: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows with the k greatest sums among ``live`` bits, ties to the smaller id; and their sums."""
    sure, maybe, have = np.zeros_like(live), live.copy(), 0
    for plane in reversed(sums):
        ones = maybe & plane
        n = int(np.bitwise_count(ones).sum())
        if have + n > k:
            maybe = ones
        else:
            sure |= ones
            have += n
            maybe = maybe & ~plane
        if have == k:
            break
    on = lambda x: np.flatnonzero(np.unpackbits(x.view(np.uint8), bitorder="little"))
    first, edge = on(sure), on(maybe) if have < k else np.empty(0, np.int64)
    if len(edge) > k - have:
        edge = edge[np.argsort(ids[edge], kind="stable")[: k - have]]
    rows = np.concatenate([first, edge])
    word, bit = rows // 64, (rows % 64).astype(np.uint64)
    total = np.zeros(len(rows), np.int64 if len(sums) < 62 else object)  # sums of more digits as Python's integers
    for w, plane in enumerate(sums):
        total = total + ((plane[word] >> bit) & np.uint64(1)).astype(np.int64).astype(total.dtype) * (1 << w)
    order = np.array(sorted(range(len(rows)), key=lambda i: (-total[i], ids[rows[i]])), np.int64)
    return rows[order], total[order]


SLICE_SET = "part long, dims int, digits int, ids binary, rows binary, cut binary"


def slice_sets(vectors: DataFrame, scale: float) -> DataFrame:
    """One row for each set of at most ROWS rows of a partition, built where the rows are read."""
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        serial = TaskContext.get().partitionId() << 32
        held: dict[int, list] = defaultdict(list)

        def put(d: int, ids: np.ndarray, q: np.ndarray) -> pa.RecordBatch:
            nonlocal serial
            serial += 1
            cut = slices(q)
            row = (serial, d, cut.shape[1], ids.astype("<i8").tobytes(), q.astype("<i8").tobytes(), cut.astype("<u8").tobytes())
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, (pa.int64(), pa.int32(), pa.int32(), *[pa.binary()] * 3), strict=True)], names=[x.split()[0] for x in SLICE_SET.split(", ")])

        for batch in batches:
            for ids, x in matrices(batch):
                q = np.floor(scale * x)
                if (np.abs(q) >= LIMIT).any():
                    raise OverflowError(f"a component of {LIMIT / scale:g} or more: its scores don't fit a long")
                d = x.shape[1]
                held[d].append((ids, q.astype(np.int64)))
                if sum(len(i) for i, _ in held[d]) >= ROWS:
                    ids, q = np.concatenate([i for i, _ in held[d]]), np.concatenate([x for _, x in held[d]])
                    full = len(ids) - len(ids) % ROWS
                    for at in range(0, full, ROWS):
                        yield put(d, ids[at : at + ROWS], q[at : at + ROWS])
                    held[d] = [(ids[full:], q[full:])]
        for d, parts in held.items():
            ids = np.concatenate([i for i, _ in parts])
            if len(ids):
                yield put(d, ids, np.concatenate([x for _, x in parts]))

    return vectors.mapInArrow(scan, SLICE_SET)


def _merged(sets: list) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Slice sets side by side: ids, row numbers, slices of values raised by half their range, live rows."""
    d, digits = sets[0].dims, max(s.digits for s in sets)
    ids, uid, live, parts = [], [], [], []
    for s in sets:
        cut = np.frombuffer(s.cut, "<u8").reshape(d, s.digits, -1)
        cut = np.concatenate([cut, *[cut[:, -1:]] * (digits - s.digits)], axis=1)
        cut[:, -1] ^= np.uint64(0xFFFFFFFFFFFFFFFF)
        own = np.frombuffer(s.ids, "<i8")
        rows = cut.shape[2] * 64
        ids.append(np.pad(own, (0, rows - len(own))))
        uid.append(np.where(np.arange(rows) < len(own), (s.part << 12) + np.arange(rows), -1))
        live.append(np.arange(rows) < len(own))
        parts.append(cut)
    return np.concatenate(ids), np.concatenate(uid), np.concatenate(parts, axis=2), np.packbits(np.concatenate(live), bitorder="little").view(np.uint64)


def top_k(vectors: DataFrame, id_column: str, vector_column: str, every: int, k: int, scale: float = 256.0) -> DataFrame:
    """``query_id, rank, vec_id, score``: the k rows of greatest inner product for each query.

    Queries are the rows whose id is divisible by ``every``; candidates are all rows but
    the query's own. Fewer than k candidates give as many rows. Vectors that are null or
    empty or hold null or non-finite components, and rows with a null id take no part.
    Vectors are compared with those of as many dimensions. Rows that repeat an id are rows
    of their own; a repeated query has an answer for each row. Sums are exact whatever
    their size; a component of 2**62 / scale or more, and an answer that doesn't fit a
    long, raise OverflowError. Extra columns are ignored; an empty table gives no rows.
    """
    spark = vectors.sparkSession
    sets = materialise(slice_sets(vectors.select(F.col(id_column).cast("long"), F.col(vector_column).cast("array<double>")), scale), "topk-slices")
    groups, block = max(1, -(-sets.count() // GROUP)), QUERIES

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for part, d, ids, rows in zip(b["part"], b["dims"], b["ids"], b["rows"], strict=True):
                own = np.frombuffer(ids, "<i8")
                which = np.flatnonzero(own % every == 0)
                q = np.frombuffer(rows, "<i8").reshape(-1, d)[which]
                for at in range(0, len(which), block):
                    w = which[at : at + block]
                    yield pd.DataFrame({"dims": [d], "query_ids": [own[w].astype("<i8").tobytes()], "query_rows": [((int(part) << 12) + w).astype("<i8").tobytes()], "query": [q[at : at + block].tobytes()]})

    asked = materialise(sets.select("part", "dims", "ids", "rows").mapInPandas(ask, "dims int, query_ids binary, query_rows binary, query binary"), "topk-queries")

    def search(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(left) and len(right):
            ids, uid, cut, live = _merged(sorted(right.itertuples(), key=lambda s: s.part))
            for block in left.itertuples():
                own, row = np.frombuffer(block.query_ids, "<i8"), np.frombuffer(block.query_rows, "<i8")
                for i, query in enumerate(np.frombuffer(block.query, "<i8").reshape(len(own), -1)):
                    mask = live
                    if len(at := np.flatnonzero(uid == row[i])):
                        mask = live.copy()
                        mask[at // 64] &= ~(np.uint64(1) << (at % 64).astype(np.uint64))
                    constant, sums = added(cut, query)
                    found, total = select(sums, mask, ids, k)
                    score = [int(x) + constant for x in total]
                    if any(not -(1 << 63) <= x < 1 << 63 for x in score):
                        raise OverflowError(f"a score of query {own[i]} doesn't fit a long")
                    out.append((np.full(len(found), row[i]), np.full(len(found), own[i]), ids[found], np.array(score, np.int64)))
        names = ("query_row", "query_id", "vec_id", "score")
        return pd.DataFrame({c: np.concatenate([x[j] for x in out]) if out else np.empty(0, np.int64) for j, c in enumerate(names)})

    # The stated query set against all rows, in blocks: each block of queries meets each group of
    # slice sets once. A group is copied for every ASKED blocks of queries, so that neither side of
    # a piece of work grows with the table; where there are few groups, it is copied for the cores.
    copies = max(1, 24 // groups, -(-asked.count() // ASKED))
    every_group = F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))
    left = asked.withColumn("number", every_group).withColumn("copy", F.pmod(F.xxhash64("query_rows"), F.lit(copies)).cast("int"))
    right = sets.drop("rows").withColumn("number", F.pmod(F.xxhash64("part"), F.lit(groups)).cast("int")).withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(copies - 1))))
    found = left.groupBy("number", "dims", "copy").cogroup(right.groupBy("number", "dims", "copy")).applyInPandas(search, "query_row long, query_id long, vec_id long, score long")
    best = Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
