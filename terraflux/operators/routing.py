"""Transport networks as edge tables, scenarios priced at query time, least-cost paths.

Edges are ``src, dst, mode, length_km, hours, flags`` (node ids of one mode's graph).
"""

from __future__ import annotations

import heapq
from collections import defaultdict
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions.geo import Scenario, arc_flags, edge_cost, freight_cost, great_circle_km
from .atoms import systematic_sample
from .components import checkpointed
from .measures import overland, power_mean, shares


def complete_edges(nodes: DataFrame, within_km: float | None = None) -> DataFrame:
    """``src, dst`` (src < dst) and ``length_km`` of all pairs of a hub list ``id, lon, lat``."""
    side = lambda s: nodes.select(F.col("id").alias(s), F.col("lon").alias(f"lon_{s}"), F.col("lat").alias(f"lat_{s}"), F.lit(1).alias("_all"))
    met = side("src").join(side("dst"), "_all").where("src < dst").drop("_all")
    met = met.withColumn("length_km", great_circle_km("lon_src", "lat_src", "lon_dst", "lat_dst"))
    return met.where(F.col("length_km") <= within_km) if within_km else met


def maritime_edges(ports: DataFrame) -> DataFrame:
    """The complete undirected sea graph of a port list, with chokepoint flags."""
    e = complete_edges(ports)
    return e.select("src", "dst", F.lit("maritime").alias("mode"), "length_km", (F.col("length_km") / K.SPEED["maritime"]).alias("hours"), arc_flags("lon_src", "lat_src", "lon_dst", "lat_dst").alias("flags"))


def scheduled_airports(airports: DataFrame) -> DataFrame:
    """Airports with a code and a place; an unknown type counts as an airport."""
    code = F.col("iata")
    return airports.where((F.lower(F.coalesce("type", F.lit("airport"))) == "airport") & code.isNotNull() & ~code.isin("\\N", "") & F.col("lat").isNotNull() & F.col("lon").isNotNull())


def air_edges(airports: DataFrame, routes: DataFrame | None = None, most: int = K.HUB_LIMIT) -> DataFrame:
    """Air graph: the given routes between known hubs, or all hubs within range. Handling is charged on each edge."""
    hubs = systematic_sample(scheduled_airports(airports), ("country", "iata"), most)
    if routes is None:
        e = complete_edges(hubs, K.AIR_RANGE_KM)
    else:
        side = lambda s, key: hubs.select(F.col("id").alias(s), F.col("lon").alias(f"lon_{s}"), F.col("lat").alias(f"lat_{s}"), F.col("id").alias(key))
        e = routes.join(side("src", "src_airport_id"), "src_airport_id").join(side("dst", "dst_airport_id"), "dst_airport_id").where("src <> dst").withColumn("length_km", great_circle_km("lon_src", "lat_src", "lon_dst", "lat_dst"))
    return e.select("src", "dst", F.lit("air").alias("mode"), "length_km", (F.col("length_km") / K.SPEED["air"] + K.AIRPORT_HOURS).alias("hours"), F.lit(0).alias("flags"))


def road_edges(edges: DataFrame) -> DataFrame:
    """A given road table ``src, dst, length_km`` with travel times."""
    return edges.select("src", "dst", F.lit("road").alias("mode"), "length_km", (F.col("length_km") / K.SPEED["road"]).alias("hours"), F.lit(0).alias("flags"))


def undirected(edges: DataFrame) -> DataFrame:
    return edges.unionByName(edges.withColumns({"src": F.col("dst"), "dst": F.col("src")}))


def composed(*graphs: DataFrame) -> DataFrame:
    """The union of edge tables; of an edge that several have, the last table's stays."""
    out = None
    for k, g in enumerate(graphs):
        g = g.withColumn("_k", F.lit(k))
        out = g if out is None else out.unionByName(g)
    rest = [c for c in out.columns if c not in ("src", "dst", "_k")]
    return out.groupBy("src", "dst").agg(F.max_by(F.struct(*rest), "_k").alias("r")).select("src", "dst", "r.*")


def out_degree(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    return nodes.select("id").join(edges.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("degree")), "id", "left").select("id", F.coalesce("degree", F.lit(0)).alias("degree"))


def priced(edges: DataFrame, scenario: Scenario) -> DataFrame:
    """Adds ``cost`` under a scenario."""
    return edges.withColumn("cost", edge_cost("mode", "hours", "flags", scenario))


def scenario_costs(edges: DataFrame, scenarios: dict[str, Scenario]) -> DataFrame:
    """Every edge under every scenario, in one job."""
    many = None
    for name, s in scenarios.items():
        one = priced(edges, s).withColumn("scenario", F.lit(name))
        many = one if many is None else many.unionByName(one)
    return many


def nearest_node(points: DataFrame, nodes: DataFrame, key: str = "id", most_broadcast: int = 10_000, cell: float = 0.5) -> DataFrame:
    """The node least far in degrees (no wrap) from each point, ties to the smaller id.

    A hub list of at most ``most_broadcast`` rows goes to every task. A longer one is met
    in cells: a point looks at the nodes of its cell and the eight around it, and what it
    finds within one cell's width is its nearest; the other points go on with cells twice
    as wide, until none is left.
    """
    n = nodes.select(F.col("id").alias("node"), F.col("lon").alias("_lon"), F.col("lat").alias("_lat"))
    dx, dy = F.col("lon") - F.col("_lon"), F.col("lat") - F.col("_lat")
    best = F.min_by(F.struct("node", "d"), F.struct("d", "node")).alias("b")
    points = points.select(key, "lon", "lat").where("lon is not null and lat is not null")
    count = nodes.count()
    if count <= most_broadcast:
        # A point passes over the list in its own row, so that what is dealt and sorted is one row a point.
        hubs = n.where("_lon is not null and _lat is not null").agg(F.collect_list(F.struct("node", "_lon", "_lat")).alias("hubs")).where("size(hubs) > 0")
        far = lambda h: (F.col("lon") - h["_lon"]) * (F.col("lon") - h["_lon"]) + (F.col("lat") - h["_lat"]) * (F.col("lat") - h["_lat"])
        start = F.struct(far(F.col("hubs")[0]).alias("d"), F.col("hubs")[0]["node"].alias("node"))
        least = F.aggregate("hubs", start, lambda held, h: F.least(held, F.struct(far(h).alias("d"), h["node"].alias("node"))))
        met = points.join(F.broadcast(hubs)).select(key, least.alias("b"))  # checked above
        return met.groupBy(key).agg(F.min("b").alias("b")).select(key, F.col("b.node").alias("node"))
    done, left = None, points
    while True:
        slot = lambda c, width=cell: F.floor(F.col(c) / width)
        around = left.withColumn("_x", F.explode(F.array(*[slot("lon") + k for k in (-1, 0, 1)]))).withColumn("_y", F.explode(F.array(*[slot("lat") + k for k in (-1, 0, 1)])))
        met = around.join(n.withColumns({"_x": slot("_lon"), "_y": slot("_lat")}), ["_x", "_y"])
        found = checkpointed(met.withColumn("d", dx * dx + dy * dy).groupBy(key).agg(best).select(key, "b.*"))
        last = cell > 720
        sure = (found if last else found.where(F.col("d") <= cell * cell)).select(key, "node")
        done = sure if done is None else done.unionByName(sure)
        left = checkpointed(left.join(sure, key, "left_anti"))
        if last or not left.limit(1).count():
            return done
        cell *= 2


def shortest_paths(edges: DataFrame, sources: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """``source, node, cost`` of all nodes reachable from ``sources(node)`` over directed ``src, dst, cost``.

    Relaxation by joins: each round extends what improved in the last, until nothing does,
    after as many rounds as the longest path has edges. Negative costs are an error.
    ``keys`` (a scenario, a mode) separate graphs that are solved side by side.
    """
    edges = checkpointed(edges.groupBy(*keys, "src", "dst").agg(F.min("cost").alias("cost")))
    best = checkpointed(sources.select(*keys, F.col("node").alias("source"), "node", F.lit(0.0).alias("cost")).distinct())
    fresh = best
    if edges.where("cost < 0").limit(1).count():
        raise ValueError("costs must not be negative")
    while True:
        step = fresh.withColumnsRenamed({"node": "src", "cost": "so_far"}).join(edges, [*keys, "src"]).select(*keys, "source", F.col("dst").alias("node"), (F.col("so_far") + F.col("cost")).alias("cost"))
        both = best.withColumn("old", F.lit(True)).unionByName(step.withColumn("old", F.lit(False)))
        after = checkpointed(both.groupBy(*keys, "source", "node").agg(F.min("cost").alias("cost"), F.min(F.when(F.col("old"), F.col("cost"))).alias("was")))
        best = after.select(*keys, "source", "node", "cost")
        fresh = after.where("was is null or cost < was").select(*keys, "source", "node", "cost")
        if not fresh.limit(1).count():
            return best


def shortest_paths_local(edges: DataFrame, sources: DataFrame, most_edges: int = 2_000_000) -> DataFrame:
    """The same by a heap in each task, for a graph of at most ``most_edges`` edges; larger ones are relaxed by joins."""
    if edges.count() > most_edges:
        return shortest_paths(edges, sources)
    graph = edges.sparkSession.sparkContext.broadcast(edges.select("src", "dst", "cost").toPandas())  # checked above

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out_of = defaultdict(list)
        for a, b, c in graph.value.itertuples(index=False):
            out_of[a].append((b, c))
        for batch in batches:
            for source in batch["node"]:
                cost, heap = {}, [(0.0, source)]
                while heap:
                    d, at = heapq.heappop(heap)
                    if at not in cost:
                        cost[at] = d
                        for b, c in out_of[at]:
                            if b not in cost:
                                heapq.heappush(heap, (d + c, b))
                yield pd.DataFrame({"source": source, "node": list(cost), "cost": list(cost.values())})

    return sources.select("node").distinct().mapInPandas(solve, "source long, node long, cost double")


def many_to_many(edges: DataFrame, sources: DataFrame, targets: DataFrame, sparse: bool = False) -> DataFrame:
    """``source, target, cost`` for every pair, infinite where there is no path; ``sparse`` networks are contracted first."""
    wanted = sources.select(F.col("node").alias("source"), F.lit(1).alias("_all")).join(targets.select(F.col("node").alias("target"), F.lit(1).alias("_all")), "_all").drop("_all")
    if sparse:
        from .hierarchy import least_costs

        paths = least_costs(edges, wanted.withColumnRenamed("target", "node"))
    else:
        paths = shortest_paths(edges, sources)
    return wanted.join(paths.withColumnRenamed("node", "target"), ["source", "target"], "left").withColumn("cost", F.coalesce("cost", F.lit(float("inf"))))


MODE_ORDER = {"road": 0, "maritime": 1, "air": 2}
#: Modes whose graphs have few edges a node; these are contracted, complete ones relaxed.
SPARSE = ("road",)
HANDLING = {"road": 0.0, "maritime": K.PORT_HOURS * K.RATE["maritime"], "air": K.AIRPORT_HOURS * K.RATE["air"]}


def least_cost(places: DataFrame, graphs: dict[str, tuple[DataFrame, DataFrame]], scenario: Scenario, pairs: DataFrame) -> DataFrame:
    """``o, d, cost, mode`` of pairs of ``places(id, lon, lat)``: the cheapest mode, or the road's great circle.

    ``graphs`` maps a mode to (nodes, edges). A mode's cost is that of the path between
    the nodes nearest to the places, plus its handling; ties go to road, sea, air.
    """
    found = None
    for mode, (nodes, edges) in graphs.items():
        at = checkpointed(nearest_node(places, nodes))
        paths = shortest_paths(priced(undirected(edges), scenario), at.select("node").distinct())
        a, b = at.select(F.col("id").alias("o"), F.col("node").alias("source")), at.select(F.col("id").alias("d"), F.col("node").alias("node"))
        cost = pairs.join(a, "o").join(b, "d").join(paths, ["source", "node"]).select("o", "d", (F.col("cost") + HANDLING[mode]).alias("cost"), F.lit(mode).alias("mode"), F.lit(MODE_ORDER[mode]).alias("rank"))
        found = cost if found is None else found.unionByName(cost)
    best = found.groupBy("o", "d").agg(F.min_by(F.struct("cost", "mode"), F.struct("cost", "rank")).alias("b")).select("o", "d", "b.*")
    side = lambda s: places.select(F.col("id").alias(s), F.col("lon").alias(f"lon_{s}"), F.col("lat").alias(f"lat_{s}"))
    direct = pairs.join(side("o"), "o").join(side("d"), "d").select("o", "d", freight_cost(great_circle_km("lon_o", "lat_o", "lon_d", "lat_d"), "road").alias("direct"))
    return direct.join(best, ["o", "d"], "left").select("o", "d", F.coalesce("cost", "direct").alias("cost"), F.coalesce("mode", F.lit("gc_fallback")).alias("mode"))


def agglomeration_costs(agglomerations: DataFrame, graphs: dict[str, tuple[DataFrame, DataFrame]], scenarios: dict[int, Scenario]) -> DataFrame:
    """``iso_o, iso_d, year, share_o, share_d, cost`` of all pairs of agglomerations of two countries in a year.

    ``agglomerations`` has ``iso3, year, lon, lat`` and ``share``; ``scenarios`` says how a
    year is priced, and other years have no rows. An agglomeration enters a mode's graph at its nearest
    node. Paths are found once for the nodes in use, all years side by side; each pair then
    takes its cheapest mode with handling, or the road's great circle where no mode has a path.
    """
    place = F.concat_ws("|", "lon", "lat").alias("place")
    rows = agglomerations.where(F.col("year").isin(*scenarios)).select("iso3", "year", "lon", "lat", "share", place)
    paths = {}
    for mode, (nodes, edges) in graphs.items():
        at = checkpointed(nearest_node(rows.select("place", "lon", "lat").distinct(), nodes, "place"))
        rows = rows.join(at.withColumnRenamed("node", f"node_{mode}"), "place")
        by_year = scenario_costs(undirected(edges), {str(y): s for y, s in scenarios.items()}).withColumn("year", F.col("scenario").cast("int"))
        if mode in SPARSE:
            from .hierarchy import least_costs

            ends = rows.select("year", F.col("iso3").alias("iso"), F.col(f"node_{mode}").alias("source")).distinct()
            asked = ends.join(ends.withColumnsRenamed({"iso": "iso_d", "source": "node"}), "year").where("iso <> iso_d").select("year", "source", "node")
            paths[mode] = least_costs(by_year, asked, keys=("year",))
        else:
            starts = at.select("node").distinct().withColumn("year", F.explode(F.array(*[F.lit(y) for y in scenarios])))
            paths[mode] = shortest_paths(by_year, starts, keys=("year",))
    side = lambda s: rows.select("year", F.col("iso3").alias(f"iso_{s}"), *[F.col(c).alias(f"{c}_{s}") for c in ("lon", "lat", "share", *[f"node_{m}" for m in graphs])])
    met = side("o").join(side("d"), "year").where("iso_o <> iso_d")
    for mode, table in paths.items():
        own = table.select("year", F.col("source").alias(f"node_{mode}_o"), F.col("node").alias(f"node_{mode}_d"), (F.col("cost") + HANDLING[mode]).alias(f"cost_{mode}"))
        met = met.join(own, ["year", f"node_{mode}_o", f"node_{mode}_d"], "left")
    direct = freight_cost(great_circle_km("lon_o", "lat_o", "lon_d", "lat_d"), "road")
    modes = [F.col(f"cost_{m}") for m in graphs]
    cheapest = F.least(*modes) if len(modes) > 1 else modes[0] if modes else F.lit(None).cast("double")
    return met.select("iso_o", "iso_d", "year", "share_o", "share_d", F.coalesce(cheapest, direct).alias("cost"))


def lcp_by_year(agglomerations: DataFrame, graphs: dict[str, tuple[DataFrame, DataFrame]], scenarios: dict[int, Scenario], theta: float = -1.0, weight: str = "pop") -> DataFrame:
    """``iso_o, iso_d, year, d_lcp_multi_t``: power mean of the least costs between the agglomerations of two countries."""
    shared = shares(agglomerations, ("iso3", "year"), weight)
    return power_mean(agglomeration_costs(shared, graphs, scenarios), ("iso_o", "iso_d", "year"), theta).withColumnRenamed("effective", "d_lcp_multi_t")


def all_variants(agglomerations: DataFrame, graphs: dict[str, tuple[DataFrame, DataFrame]], scenarios: dict[int, Scenario], weighted: DataFrame, centrality: DataFrame | None = None, theta: float = -1.0) -> DataFrame:
    """The eleven-column panel from agglomerations, graphs and a scenario a year; the static overland distance is the first year's."""
    over = overland(agglomerations, theta).withColumnRenamed("d_ovdl", "d_ovdl_t")
    first = agglomerations.agg(F.min("year").alias("year"))
    static = over.join(F.broadcast(first), "year").select("iso_o", "iso_d", F.col("d_ovdl_t").alias("d_ovdl"))  # one row
    return variants_wide(lcp_by_year(agglomerations, graphs, scenarios, theta), over, static, weighted, centrality)


def variants_wide(lcp: DataFrame, overland: DataFrame, static: DataFrame, weighted: DataFrame, centrality: DataFrame | None = None) -> DataFrame:
    """The eleven-column distance panel.

    ``lcp`` and ``overland`` have ``iso_o, iso_d, year``; ``static`` one overland distance a
    pair; ``weighted`` one published distance a pair. Road, multi and actual paths stay
    null; the adjusted distance needs ``centrality(iso3, year, centrality_norm)``.
    """
    p = lcp.join(overland, ["iso_o", "iso_d", "year"], "full_outer")
    p = p.join(weighted.dropDuplicates(["iso_o", "iso_d"]), ["iso_o", "iso_d"], "left").join(static, ["iso_o", "iso_d"], "left")
    if centrality is None:
        p = p.withColumn("d_net_adj", F.lit(None).cast("double"))
    else:
        p = p.join(centrality.select(F.col("iso3").alias("iso_o"), "year", "centrality_norm"), ["iso_o", "year"], "left")
        p = p.withColumn("d_net_adj", F.col("d_lcp_multi_t") / F.coalesce("centrality_norm", F.lit(1.0)))
    for c in ("d_lcp_road", "d_lcp_multi", "d_lcp_act"):
        p = p.withColumn(c, F.lit(None).cast("double"))
    return p.select("iso_o", "iso_d", "year", "d_cepii_distw", "d_ovdl", "d_ovdl_t", "d_lcp_road", "d_lcp_multi", "d_lcp_multi_t", "d_lcp_act", "d_net_adj")
