"""Operator 6. Approximate nearest neighbours by stable projections and a chi-square test.

Vectors are projected to ``PROJECTED`` dimensions by Gaussian (2-stable) vectors: for two
points at distance d, the squared projected distance over d**2 follows a chi-square law.
The projections are indexed by a kd-tree. A query takes its neighbours in the order of
projected distance, verifies them on the original vectors, and stops as soon as a point
as near as its k-th best would have shown up already with probability ``sure``.

The tree has two levels. Its upper part is fitted on a bounded sample (``SAMPLE``
vectors, those least by hash) and has at most ``CELLS`` cells; every vector is assigned
to one. A cell's vectors, in pieces of about ``PIECE``, carry a tree of their own with
small leaves. A query first searches its own cell, then every cell that the test does
not rule out given what the first search found.

Equal vectors are one point with its k + 1 smallest ids (repeated ones included), more than
any answer can use. A query's slot bounds how many queries meet one piece in a task: a piece
is copied once for each ``ASKED`` queries that are sent to it, and not for those sent elsewhere.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise
from .vectors import matrices

PROJECTED, SAMPLE, CELLS, PIECE, LEAF, ASKED = 8, 20000, 4096, 4096, 32, 1024


def chi_square_cdf(x: float, freedom: int = PROJECTED) -> float:
    """For an even number of degrees of freedom."""
    term = total = 1.0
    for i in range(1, freedom // 2):
        term *= x / 2 / i
        total += term
    return 1 - math.exp(-x / 2) * total


def stop_ratio(sure: float) -> float:
    """The ratio of squared projected to squared true distance at which the test holds."""
    low, high = 0.0, 1.0
    while chi_square_cdf(high) < sure:
        high *= 2
    for _ in range(80):
        middle = (low + high) / 2
        low, high = (middle, high) if chi_square_cdf(middle) < sure else (low, middle)
    return high


def projected(x: np.ndarray) -> np.ndarray:
    return x @ np.random.default_rng([x.shape[1], PROJECTED]).standard_normal((x.shape[1], PROJECTED))


def split(points: np.ndarray, most: int) -> tuple[list, list[np.ndarray]]:
    """A kd-tree: nodes (axis, value, lower child, upper child; a leaf is (-1, number)), and the rows of the leaves."""
    nodes, leaves, todo = [], [], [(np.arange(len(points)), None, 0)]
    while todo:
        rows, parent, side = todo.pop()
        if parent is not None:
            nodes[parent][side] = len(nodes)
        spread = np.ptp(points[rows], axis=0) if len(rows) else np.zeros(1)
        if len(rows) <= most or not spread.max() > 0:
            nodes.append([-1, len(leaves)])
            leaves.append(rows)
            continue
        axis = int(spread.argmax())
        x = points[rows, axis]
        value = float(np.median(x))
        if not (x < value).any():
            value = float(x[x > value].min())
        nodes.append([axis, value, -1, -1])
        todo += [(rows[x < value], len(nodes) - 1, 2), (rows[x >= value], len(nodes) - 1, 3)]
    return nodes, leaves


def assign(nodes: list, points: np.ndarray) -> np.ndarray:
    """The leaf of each point."""
    out, todo = np.zeros(len(points), np.int64), [(0, np.arange(len(points)))]
    while todo:
        at, rows = todo.pop()
        node = nodes[at]
        if node[0] < 0:
            out[rows] = node[1]
        elif len(rows):
            below = points[rows, node[0]] < node[1]
            todo += [(node[2], rows[below]), (node[3], rows[~below])]
    return out


def box_distance(low: np.ndarray, high: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Squared distance of a point from each box."""
    gap = np.maximum(np.maximum(low - p, p - high), 0)
    return (gap * gap).sum(axis=1)


class Piece:
    """Points of a cell under a kd-tree, in the order of its leaves."""

    def __init__(self, x: np.ndarray, ids: list):
        p = projected(x)
        _, leaves = split(p, LEAF)
        order = np.concatenate(leaves)
        self.x, self.p, self.ids = x[order], p[order], [ids[i] for i in order]
        self.end = np.cumsum([len(r) for r in leaves])
        self.begin = self.end - [len(r) for r in leaves]
        self.low = np.array([p[r].min(axis=0) for r in leaves])
        self.high = np.array([p[r].max(axis=0) for r in leaves])

    def search(self, query: np.ndarray, k: int, ratio: float, reach: float) -> list[tuple[float, int]]:
        """The best (distance, id), at most k: projected neighbours in order, until the test holds.

        ``reach`` is a k-th best distance known already (infinite: none).
        """
        p = projected(query[None])[0]
        near = box_distance(self.low, self.high, p)
        order, at, step, best = np.argsort(near, kind="stable"), 0, 1, []
        while at < len(order):
            take = order[at : at + step]
            if near[take[0]] > ratio * reach * reach:
                break
            rows = np.concatenate([np.arange(self.begin[i], self.end[i]) for i in take])
            rows = rows[((self.p[rows] - p) ** 2).sum(axis=1) <= ratio * reach * reach * (1 + 1e-9)] if reach < math.inf else rows
            true = np.sqrt(((self.x[rows] - query) ** 2).sum(axis=1))
            close = true <= reach
            best = heapq.nsmallest(k, best + [(d, i) for d, r in zip(true[close].tolist(), rows[close].tolist(), strict=True) for i in self.ids[r]])
            if len(best) == k:
                reach = min(reach, best[-1][0])
            at, step = at + step, step * 2
        return best


def points(vectors: DataFrame, id_column: str, vector_column: str, every: int, k: int) -> tuple[DataFrame, DataFrame]:
    """Distinct vectors: ``c1, c2`` (a 128-bit key), ``dims, v, ids`` (the k + 1 smallest), ``asked``; and the key of each id."""
    def valid(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, x in matrices(batch):
                keep = (x != 0).any(axis=1)
                x = x[keep] + 0.0
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * x.shape[1], pa.int32()), pa.array(x.ravel()))
                yield pa.RecordBatch.from_arrays([pa.array(ids[keep]), lists], names=["vec_id", "v"])

    own = vectors.select(F.col(id_column).cast("long"), F.col(vector_column).cast("array<double>")).mapInArrow(valid, "vec_id long, v array<double>")
    rows = materialise(own.select("vec_id", "v", F.xxhash64("v").alias("c1"), F.xxhash64(F.reverse("v")).alias("c2")), "neighbour-rows")
    ids = rows.select("vec_id", "c1", "c2")
    first = Window.partitionBy("c1", "c2").orderBy("vec_id")
    some = ids.withColumn("n", F.row_number().over(first)).where(F.col("n") <= k + 1).groupBy("c1", "c2").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
    asked = ids.where(F.col("vec_id") % every == 0).groupBy("c1", "c2").agg(F.lit(True).alias("asked"))
    vector = rows.groupBy("c1", "c2").agg(F.first("v").alias("v"))
    return materialise(vector.join(some, ["c1", "c2"]).join(asked, ["c1", "c2"], "left").select("c1", "c2", F.size("v").alias("dims"), "v", "ids", "asked"), "neighbour-points"), ids


def nearest(vectors: DataFrame, id_column: str, vector_column: str, every: int, k: int, sure: float = 0.99) -> DataFrame:
    """``query_id, rank, vec_id, score``: the k nearest found for each query, by Euclidean distance.

    Queries are the rows whose id is divisible by ``every``; candidates are all rows but
    the query's own. Ties go to the smaller id. Rows with a null id, and vectors that are
    null, empty or zero or hold null or non-finite components take no part; vectors are
    compared with those of as many dimensions. Rows that repeat an id are rows of their
    own, as queries and as candidates, whether their vectors are equal or not. Fewer
    candidates give fewer rows, an empty table none. Extra columns are ignored.
    """
    ratio = stop_ratio(sure)
    classes, ids = points(vectors, id_column, vector_column, every, k)
    sizes = {r.dims: r["count"] for r in classes.groupBy("dims").count().orderBy(F.desc("count"), "dims").limit(1000).collect()}

    def thin(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for d, rows in b.groupby("dims").indices.items():
                yield pd.DataFrame({"c1": b["c1"].to_numpy()[rows], "dims": d, "p": list(projected(np.stack(b["v"].to_numpy()[rows])))})

    sample = classes.select("c1", "dims", "v").mapInPandas(thin, "c1 long, dims int, p array<double>").orderBy("c1").limit(SAMPLE).collect()  # SAMPLE rows of PROJECTED numbers
    trees: dict[int, list] = {}
    for d in {r.dims for r in sample}:
        x = np.array([r.p for r in sample if r.dims == d])
        trees[d] = split(x, max(2, -(-len(x) // min(CELLS, max(1, round(sizes.get(d, 1) / PIECE))))))[0]

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            cell = np.zeros(len(b), np.int64)
            for d, rows in b.groupby("dims").indices.items():
                if int(d) in trees:
                    cell[rows] = assign(trees[int(d)], projected(np.stack(b["v"].to_numpy()[rows])))
            yield b.assign(cell=cell)

    placed = materialise(classes.mapInPandas(place, "c1 long, c2 long, dims int, v array<double>, ids array<long>, asked boolean, cell long"), "neighbour-cells")
    counts = placed.groupBy("dims", "cell").agg(F.greatest(F.lit(1), F.round(F.count("*") / PIECE)).cast("int").alias("pieces"))
    dealt = placed.join(counts, ["dims", "cell"]).withColumn("piece", F.pmod("c1", F.col("pieces")).cast("int"))

    def bounds(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for (d, cell), rows in b.groupby(["dims", "cell"]).indices.items():
                p = projected(np.stack(b["v"].to_numpy()[rows]))
                yield pd.DataFrame({"dims": [d], "cell": [cell], "low": [p.min(axis=0)], "high": [p.max(axis=0)]})

    least = [F.min(F.col("low")[i]).alias(f"l{i}") for i in range(PROJECTED)] + [F.max(F.col("high")[i]).alias(f"h{i}") for i in range(PROJECTED)]
    cells = placed.select("dims", "cell", "v").mapInPandas(bounds, "dims int, cell long, low array<double>, high array<double>").groupBy("dims", "cell").agg(*least).join(counts, ["dims", "cell"]).collect()  # at most CELLS for each length of vectors
    boxes = {d: [r for r in cells if r.dims == d] for d in {r.dims for r in cells}}
    boxes = {d: (np.array([r.cell for r in rs]), np.array([[r[f"l{i}"] for i in range(PROJECTED)] for r in rs]), np.array([[r[f"h{i}"] for i in range(PROJECTED)] for r in rs]), np.array([r.pieces for r in rs])) for d, rs in boxes.items()}
    queries = placed.where("asked").select("c1", "c2", "dims", "v", "cell")
    def search(key: tuple, asked: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(asked) and len(held):
            held = held.sort_values(["c1", "c2"])
            piece = Piece(np.stack(held["v"].to_numpy()), list(held["ids"]))
            for q in asked.itertuples():
                out += [(q.c1, q.c2, i, d) for d, i in piece.search(np.asarray(q.v), k + 1, ratio, q.reach)]
        return pd.DataFrame(out, columns=["c1", "c2", "vec_id", "score"]).astype({"c1": "int64", "c2": "int64", "vec_id": "int64", "score": "float64"})

    def searched(asked: DataFrame) -> DataFrame:
        key = ["dims", "cell", "piece", "slot"]
        asked = materialise(asked, "neighbour-asked")
        wanted = asked.groupBy("dims", "cell", "piece").agg(F.ceil(F.count("*") / ASKED).cast("int").alias("slots"))
        left = asked.join(wanted, key[:3]).withColumn("slot", F.pmod("c2", F.col("slots")).cast("int")).drop("slots")
        right = dealt.select("dims", "cell", "piece", "c1", "c2", "v", "ids").join(wanted, key[:3]).withColumn("slot", F.explode(F.sequence(F.lit(0), F.col("slots") - 1))).drop("slots")
        left, right = left.toDF(*left.columns), right.toDF(*right.columns)  # columns of their own
        return left.groupBy(*key).cogroup(right.groupBy(*key)).applyInPandas(search, "c1 long, c2 long, vec_id long, score double")

    best = Window.partitionBy("c1", "c2").orderBy("score", "vec_id")

    def kept(found: DataFrame) -> DataFrame:
        return found.withColumn("n", F.row_number().over(best)).where(F.col("n") <= k + 1)

    at_home = queries.join(counts, ["dims", "cell"]).withColumn("piece", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1))).drop("pieces").withColumn("reach", F.lit(float("inf")))
    home = materialise(kept(searched(at_home)), "neighbour-home")
    known = home.where(F.col("n") == k + 1).select("c1", "c2", F.col("score").alias("reach"))

    def abroad(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for q in b.itertuples():
                number, low, high, pieces = boxes[q.dims]
                reach = q.reach if q.reach == q.reach else math.inf
                go = (box_distance(low, high, projected(np.asarray(q.v)[None])[0]) <= ratio * reach * reach) & (number != q.cell)
                where = [(c, p) for c, n in zip(number[go], pieces[go], strict=True) for p in range(n)]
                if where:
                    yield pd.DataFrame({"c1": q.c1, "c2": q.c2, "dims": q.dims, "v": [q.v] * len(where), "cell": [c for c, _ in where], "piece": [p for _, p in where], "reach": reach})

    away = queries.join(known, ["c1", "c2"], "left").mapInPandas(abroad, "c1 long, c2 long, dims int, v array<double>, cell long, piece int, reach double")
    answers = kept(home.drop("n").unionByName(searched(away))).drop("n")
    # A query's own row is among its answers at distance 0; one such row is left out. Repeated queries have equal answers.
    rows = ids.where(F.col("vec_id") % every == 0).groupBy(F.col("vec_id").alias("query_id"), "c1", "c2").agg(F.count("*").cast("int").alias("times"))
    met = rows.join(answers, ["c1", "c2"]).withColumn("itself", (F.col("vec_id") == F.col("query_id")) & (F.col("score") == 0))
    same = Window.partitionBy("query_id", "c1", "c2")
    met = met.withColumn("n", F.row_number().over(Window.partitionBy("query_id", "c1", "c2", "itself").orderBy("score", "vec_id"))).where("not itself or n > 1")
    ranked = met.withColumn("rank", F.row_number().over(same.orderBy("score", "vec_id"))).where(F.col("rank") <= k)
    return ranked.withColumn("again", F.explode(F.sequence(F.lit(1), F.col("times")))).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
