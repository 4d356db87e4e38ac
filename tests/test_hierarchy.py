"""Contraction and labels against a heap over the whole graph."""

import heapq
import random
from collections import defaultdict

import pytest

from terraflux.operators import hierarchy
from terraflux.operators.routing import shortest_paths

EDGES = "src long, dst long, cost double"


def heap(edges, source):
    out = defaultdict(list)
    for a, b, c in edges:
        out[a].append((b, c))
    cost, left = {}, [(0.0, source)]
    while left:
        d, at = heapq.heappop(left)
        if at not in cost:
            cost[at] = d
            for b, c in out[at]:
                heapq.heappush(left, (d + c, b))
    return cost


def grid(side, draw):
    """A directed road grid with one-way streets, parallel lanes, a loop and an island."""
    node = lambda r, c: r * side + c
    edges = [(10**6, 10**6 + 1, 1.0), (0, 0, 0.5)]
    for r in range(side):
        for c in range(side):
            for a, b in ((r + 1, c), (r, c + 1)):
                if a < side and b < side:
                    edges += [(node(r, c), node(a, b), draw.uniform(1, 9))] * draw.choice((1, 1, 2))
                    if draw.random() < 0.8:
                        edges.append((node(a, b), node(r, c), draw.uniform(1, 9)))
    return edges


@pytest.mark.parametrize("most", [24, 4])
def test_grid_as_by_a_heap(spark, most):
    draw = random.Random(7)
    edges = grid(7, draw)
    pairs = [(draw.randrange(49), draw.randrange(49)) for _ in range(60)] + [(5, 10**6), (10**6, 10**6 + 1), (8, 8), (5, 77777)]
    got = hierarchy.least_costs(spark.createDataFrame(edges, EDGES), spark.createDataFrame(pairs + pairs[:3], "source long, node long"), most_neighbours=most, core_nodes=8)
    got = {(r.source, r.node): r.cost for r in got.collect()}
    wanted = {(s, t): heap(edges, s)[t] for s, t in pairs if t in heap(edges, s)}
    assert got == pytest.approx(wanted) and (5, 10**6) not in got and got[8, 8] == 0


def test_labels_hold_a_part_of_the_network(spark):
    draw, side = random.Random(3), 12
    edges = spark.createDataFrame(grid(side, draw), EDGES)
    up, _ = hierarchy.contracted(edges, core_nodes=24)
    sources = spark.createDataFrame([(k,) for k in range(0, side * side, 9)], "node long")
    assert shortest_paths(up, sources).count() < 16 * side * side / 2


def test_keys_keep_graphs_apart(spark):
    rows = [(y, k, k + 1, float(y)) for y in (1, 2) for k in range(30)]
    edges = spark.createDataFrame(rows, f"year int, {EDGES}")
    pairs = spark.createDataFrame([(1, 0, 30), (2, 0, 30), (2, 30, 0), (2, None, 1), (3, 0, 1)], "year int, source long, node long")
    got = {(r.year, r.source, r.node): r.cost for r in hierarchy.least_costs(edges, pairs, ("year",), core_nodes=4).collect()}
    assert got == {(1, 0, 30): 30.0, (2, 0, 30): 60.0}


def test_crowded_node_stays_and_odd_rows(spark):
    spokes = [(0, k, 1.0) for k in range(1, 80)] + [(k, 0, 2.0) for k in range(1, 80)]
    odd = [(None, 1, 1.0), (1, None, 1.0), (1, 2, None)]
    pairs = spark.createDataFrame([(1, 2), (79, 3)], "source long, node long")
    got = hierarchy.least_costs(spark.createDataFrame(spokes + odd, EDGES), pairs, core_nodes=2)
    assert {r.cost for r in got.collect()} == {3.0}
    empty = spark.createDataFrame([], EDGES)
    assert hierarchy.least_costs(empty, pairs).count() == 0
    assert hierarchy.least_costs(spark.createDataFrame(spokes, EDGES), pairs.limit(0)).count() == 0
    with pytest.raises(ValueError):
        hierarchy.contracted(spark.createDataFrame([(1, 2, -1.0)], EDGES))
