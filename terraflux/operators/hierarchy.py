"""Least costs between given pairs of nodes of a sparse network, by contraction and labels.

Nodes of few neighbours are taken out in rounds: those that come before all their
neighbours, by the power of two below their degree and then by a hash, go together, and what ran through one of them is
kept as a shortcut. An edge to a node that outlives its other end leads up. What is left,
crowded nodes included, is the core. A least path goes up, through the core and down, so
the label of a source (nodes reached by edges up and in the core) and that of a target
(nodes that reach it by edges down) share a node of it. A pair then costs one join of two
labels, whatever the length of its path in edges.

``shortest_paths`` relaxes each source over all edges and takes a round for each edge of the
longest path; here a source meets the nodes above it only. Complete graphs are all core and
gain nothing.
"""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import written
from .routing import shortest_paths

#: Nodes of more neighbours are never taken out: a shortcut for each pair of them would be too many.
MOST_NEIGHBOURS = 64
#: So few nodes are not contracted any further.
CORE_NODES = 64


def _united(parts: list[DataFrame]) -> DataFrame:
    return functools.reduce(DataFrame.unionByName, parts)


def _first_of_neighbours(edges: DataFrame, keys: tuple[str, ...], most: int) -> DataFrame:
    """``keys, node`` of nodes that come before all their neighbours; no two of them are joined by an edge."""
    there = edges.select(*keys, F.col("src").alias("node"), F.col("dst").alias("other"))
    both = there.unionByName(edges.select(*keys, F.col("dst").alias("node"), F.col("src").alias("other"))).distinct()
    rank = both.groupBy(*keys, "node").agg(F.count("*").alias("degree")).withColumn("rank", F.struct(F.floor(F.log2("degree")).alias("class"), F.xxhash64("node").alias("mix"), "node"))
    around = both.join(rank, [*keys, "node"]).groupBy(*keys, F.col("other").alias("node")).agg(F.min("rank").alias("around"))
    return rank.where(F.col("degree") <= most).join(around, [*keys, "node"]).where(F.col("rank") < F.col("around")).select(*keys, "node")


def contracted(edges: DataFrame, keys: tuple[str, ...] = (), most_neighbours: int = MOST_NEIGHBOURS, core_nodes: int = CORE_NODES) -> tuple[DataFrame, DataFrame]:
    """``up`` and ``down`` edges ``keys, src, dst, cost`` of directed ``src, dst, cost``.

    ``up`` holds edges and shortcuts to nodes that outlive their source, and the core's
    edges; ``down`` those from nodes that outlive their target. Of parallel edges the
    cheapest counts; loops, and edges with a null, are left out. Negative costs are an error.
    """
    known = functools.reduce(lambda a, c: a & F.col(c).isNotNull(), ("dst", "cost", *keys), F.col("src").isNotNull())
    left = written(edges.where(known & (F.col("src") != F.col("dst"))).groupBy(*keys, "src", "dst").agg(F.min("cost").cast("double").alias("cost")), "roads")
    if edges.where("cost < 0").limit(1).count():
        raise ValueError("costs must not be negative")
    up, down = [], []
    while True:
        nodes = left.select(*keys, F.col("src").alias("node")).union(left.select(*keys, "dst")).distinct().count()
        if nodes <= core_nodes:
            break
        gone = _first_of_neighbours(left, keys, most_neighbours).withColumn("gone", F.lit(True))
        end = lambda c: gone.withColumnsRenamed({"node": c, "gone": f"gone_{c}"})
        marked = written(left.join(end("src"), [*keys, "src"], "left").join(end("dst"), [*keys, "dst"], "left").select(*keys, "src", "dst", "cost", "gone_src", "gone_dst"), "marked")
        leaving, entering = (marked.where(f"gone_{c}").select(*keys, "src", "dst", "cost") for c in ("src", "dst"))
        if not leaving.limit(1).count() and not entering.limit(1).count():
            break
        up.append(leaving)
        down.append(entering)
        through = entering.withColumnsRenamed({"dst": "via", "cost": "first"}).join(leaving.withColumnsRenamed({"src": "via", "cost": "second"}), [*keys, "via"])
        shortcuts = through.where("src <> dst").select(*keys, "src", "dst", (F.col("first") + F.col("second")).alias("cost"))
        stay = marked.where("gone_src is null and gone_dst is null").select(*keys, "src", "dst", "cost")
        left = written(stay.unionByName(shortcuts).groupBy(*keys, "src", "dst").agg(F.min("cost").alias("cost")), "roads")
    return _united([*up, left]), _united(down) if down else left.limit(0)


def least_costs(edges: DataFrame, pairs: DataFrame, keys: tuple[str, ...] = (), most_neighbours: int = MOST_NEIGHBOURS, core_nodes: int = CORE_NODES) -> DataFrame:
    """``keys, source, node, cost`` of each distinct pair of ``pairs(keys, source, node)`` that a path joins; 0 from a node to itself.

    ``keys`` separate graphs (a year, a scenario) that are solved side by side. Pairs with a
    null have no row. Pairs meet the labels of their source first and those of their
    target on the target and the shared node, so no join is on a node that all labels hold.
    """
    wanted = pairs.select(*keys, "source", "node").dropna().distinct()
    up, down = contracted(edges, keys, most_neighbours, core_nodes)
    ends = lambda c: wanted.select(*keys, F.col(c).alias("node")).distinct()
    rising = shortest_paths(up, ends("source"), keys).select(*keys, "source", F.col("node").alias("hub"), F.col("cost").alias("rise"))
    back = down.select(*keys, F.col("dst").alias("src"), F.col("src").alias("dst"), "cost")
    falling = shortest_paths(back, ends("node"), keys).select(*keys, F.col("source").alias("node"), F.col("node").alias("hub"), F.col("cost").alias("fall"))
    met = wanted.join(rising, [*keys, "source"]).join(falling, [*keys, "node", "hub"])
    return met.groupBy(*keys, "source", "node").agg(F.min(F.col("rise") + F.col("fall")).alias("cost"))
