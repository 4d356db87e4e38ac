"""Power means between large clouds by a dual tree.

A region's atoms stand in a quadtree over the region's own box. Two nodes that are far
apart for their size meet by proxies: ``Q`` by ``Q`` Chebyshev points of each box carry
the node's weight, interpolated, so the kernel is evaluated at the proxies in place of
the atoms. For boxes whose centres are ``APART`` times their radii apart the error of a
pair of nodes is below about ``(z + sqrt(z * z - 1)) ** -Q`` of its value, z = 2 * APART - 1
(``node_error``). Nodes with no more atoms than proxies are met atom by atom, exactly,
and so are leaves that touch. Near node pairs are opened, the wider node first.

Everything is a plan over tables: nodes by aggregation, a level at a time; node pairs by
rounds of joins that are written out, as many as the tree is deep; kernels in one
aggregation by pair of regions. Node pairs are dealt by their nodes, so a heavy pair of regions is no
single key. There is no Python in it.
"""

from __future__ import annotations

import functools
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions.geo import haversine_km
from .components import written

#: Proxies a side of a box, how far apart in radii nodes must be, levels of a tree.
Q, APART, DEEPEST = 8, 3.0, 20
#: A node with more atoms than this is split.
LEAF = Q * Q
NODES = [math.cos((2 * k + 1) * math.pi / (2 * Q)) for k in range(Q)]
NODE = ["region", "level", "ix", "iy"]


def node_error(apart: float = APART, q: int = Q) -> float:
    """How much of its value a pair of nodes may be wrong by."""
    z = 2 * apart - 1
    return (z + math.sqrt(z * z - 1)) ** -q


def _boxed(atoms: DataFrame) -> DataFrame:
    """Atoms of positive weight, equal places summed, as ``region, x, y, w`` with x in degrees from the region's middle, and the region's box."""
    known = atoms.where("weight > 0 and lat is not null and lon is not null").select("region", F.col("lat").cast("double").alias("y"), (F.pmod(F.col("lon") + 180, F.lit(360.0)) - 180).alias("lon"), F.col("weight").cast("double").alias("w"))
    lon = F.radians("lon")
    middle = known.groupBy("region").agg(F.degrees(F.atan2(F.sum(F.sin(lon)), F.sum(F.cos(lon)))).alias("mid"))
    own = known.join(middle, "region").select("region", "mid", "y", "w", (F.pmod(F.col("lon") - F.col("mid") + 180, F.lit(360.0)) - 180).alias("x"))
    places = own.groupBy("region", "mid", "x", "y").agg(F.sum("w").alias("w"))
    box = places.groupBy("region").agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"))
    wide = F.greatest(F.col("x1") - F.col("x0"), F.lit(1e-9)) * 1.000001
    high = F.greatest(F.col("y1") - F.col("y0"), F.lit(1e-9)) * 1.000001
    return written(places.join(box, "region").select("region", "mid", "x", "y", "w", "x0", "y0", wide.alias("wide"), high.alias("high")), "tree-atoms")


def _at_level(atoms: DataFrame, level: int) -> DataFrame:
    """Atoms with the node they are in, and their place in its box, from -1 to 1."""
    n = float(1 << level)
    fx, fy = (F.col("x") - F.col("x0")) / F.col("wide") * n, (F.col("y") - F.col("y0")) / F.col("high") * n
    ix, iy = F.floor(fx), F.floor(fy)
    return atoms.select("*", F.lit(level).alias("level"), ix.alias("ix"), iy.alias("iy"), ((fx - ix) * 2 - 1).alias("u"), ((fy - iy) * 2 - 1).alias("v"))


def _nodes(atoms: DataFrame) -> DataFrame:
    """The nodes of all trees: ``region, level, ix, iy, n``, the box's centre and halves in degrees, and its radius in km."""
    out, live = None, None
    for level in range(DEEPEST + 1):
        own = _at_level(atoms, level)
        if live is not None:
            own = own.withColumns({"px": F.floor(F.col("ix") / 2), "py": F.floor(F.col("iy") / 2)}).join(live, ["region", "px", "py"], "left_semi")
        counts = own.groupBy(*NODE).agg(F.count("*").alias("n"), F.first("mid").alias("mid"), F.first("x0").alias("x0"), F.first("y0").alias("y0"), F.first("wide").alias("wide"), F.first("high").alias("high"))
        half_x, half_y = F.col("wide") / float(2 << level), F.col("high") / float(2 << level)
        placed = counts.withColumns({"hx": half_x, "hy": half_y}).withColumns({"cx": F.col("mid") + F.col("x0") + (2 * F.col("ix") + 1) * F.col("hx"), "cy": F.col("y0") + (2 * F.col("iy") + 1) * F.col("hy")})
        low = F.greatest(F.abs(F.col("cy")) - F.col("hy"), F.lit(0.0))
        radius = F.radians(F.sqrt(F.pow(F.col("hy"), 2) + F.pow(F.col("hx") * F.cos(F.radians(low)), 2))) * K.EARTH_KM
        nodes = written(placed.select(*NODE, "n", "cx", "cy", "hx", "hy", radius.alias("km")), "tree-nodes")
        out = nodes if out is None else out.unionByName(nodes)
        live = nodes.where(F.col("n") > LEAF).select("region", F.col("ix").alias("px"), F.col("iy").alias("py"))
        if not live.limit(1).count():
            break
    return written(out, "tree-all")


def _proxies(atoms: DataFrame, wanted: DataFrame, levels: list[int]) -> DataFrame:
    """The proxies of the ``wanted`` nodes: ``region, level, ix, iy, lat, lon, w``."""
    basis = lambda c, k: functools.reduce(Column.__mul__, [(F.col(c) - NODES[j]) / (NODES[k] - NODES[j]) for j in range(Q) if j != k])
    parts = []
    for level in levels:
        own = _at_level(atoms, level).join(wanted.select(*NODE), NODE, "left_semi").withColumns({f"{c}{k}": basis(c, k) for c in "uv" for k in range(Q)})
        parts.append(own.groupBy(*NODE).agg(*[F.sum(F.col("w") * F.col(f"u{i}") * F.col(f"v{j}")).alias(f"w{i}_{j}") for i in range(Q) for j in range(Q)]))
    if not parts:
        return wanted.select(*NODE, F.lit(0.0).alias("lat"), F.lit(0.0).alias("lon"), F.lit(0.0).alias("w")).where("false")
    held = functools.reduce(DataFrame.unionByName, parts).join(wanted.select(*NODE, "cx", "cy", "hx", "hy"), NODE)
    points = F.explode(F.array(*[F.struct((F.col("cy") + F.col("hy") * NODES[j]).alias("lat"), (F.col("cx") + F.col("hx") * NODES[i]).alias("lon"), F.col(f"w{i}_{j}").alias("w")) for i in range(Q) for j in range(Q)])).alias("p")
    return held.select(*NODE, points).select(*NODE, "p.*")


def _sided(nodes: DataFrame, side: str) -> DataFrame:
    return nodes.select(*[F.col(c).alias(f"{c}_{side}") for c in nodes.columns])


def node_pairs(pairs: DataFrame, origins: DataFrame, destinations: DataFrame, floor_km: float) -> DataFrame:
    """The pairs of nodes that meet, with both sides' ``n`` and ``proxy_o, proxy_d``: whether proxies stand for the atoms."""
    sides = {"o": origins, "d": destinations}
    front = pairs.select(F.col("o").alias("region_o"), F.col("d").alias("region_d")).withColumns({f"{c}_{s}": F.lit(0).cast("int" if c == "level" else "long") for s in sides for c in NODE[1:]})
    done = None
    for _ in range(2 * DEEPEST + 2):
        met = front
        for s, nodes in sides.items():
            met = met.join(_sided(nodes, s), [f"{c}_{s}" for c in NODE])
        apart = haversine_km("cy_o", "cx_o", "cy_d", "cx_d")
        reach = F.col("km_o") + F.col("km_d")
        clear = F.least(F.col("gap"), F.lit(math.pi * K.EARTH_KM) - F.col("gap"))  # from the point itself, and from the one opposite
        met = met.withColumn("gap", apart).withColumn("far", (clear >= APART * reach) & (F.col("gap") - reach > floor_km))
        few = F.col("n_o") * F.col("n_d") <= LEAF * LEAF
        opens = {s: F.col(f"n_{s}") > LEAF for s in sides}
        first = F.when(opens["o"] & (~opens["d"] | (F.col("km_o") >= F.col("km_d"))), "o").when(opens["d"], "d")
        judged = met.withColumn("open", F.when(~(few | F.col("far")), first))
        judged = written(judged.select(*[f"{c}_{s}" for s in sides for c in [*NODE, "n"]], *[(F.col("far") & opens[s] & ~few).alias(f"proxy_{s}") for s in sides], "open"), "tree-pairs")
        settled = judged.where("open is null").drop("open")
        done = settled if done is None else done.unionByName(settled)
        left = judged.where("open is not null")
        if not left.limit(1).count():
            return done
        child = lambda c, s, k: F.when(F.col("open") == s, 2 * F.col(f"{c}_{s}") + k).otherwise(F.col(f"{c}_{s}"))
        quarter = F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (0, 1) for b in (0, 1)])).alias("k")
        front = left.select("*", quarter).select(
            *[F.col(f"region_{s}") for s in sides],
            *[(F.col(f"level_{s}") + F.when(F.col("open") == s, 1).otherwise(0)).alias(f"level_{s}") for s in sides],
            *[child(c, s, F.col(f"k.{k}")).cast("long").alias(f"{c}_{s}") for s in sides for c, k in (("ix", "a"), ("iy", "b"))])
    raise RuntimeError("node pairs did not settle")


def _points(atoms: DataFrame, nodes: DataFrame, used: DataFrame, side: str) -> DataFrame:
    """What the used nodes meet with: ``region, level, ix, iy, proxy, lat, lon, w``."""
    key = used.select(*[F.col(f"{c}_{side}").alias(c) for c in NODE], F.col(f"proxy_{side}").alias("proxy")).distinct()
    key = written(key.join(nodes, NODE), "tree-used")
    levels = sorted((r.level, r.proxy) for r in key.select("level", "proxy").distinct().collect())  # DEEPEST levels at most
    proxies = _proxies(atoms, key.where("proxy"), [k for k, p in levels if p]).withColumn("proxy", F.lit(True))
    for level in [k for k, p in levels if not p]:
        own = _at_level(atoms, level).join(key.where("not proxy").select(*NODE), NODE, "left_semi")
        proxies = proxies.unionByName(own.select(*NODE, F.col("y").alias("lat"), (F.col("mid") + F.col("x")).alias("lon"), "w", F.lit(False).alias("proxy")))
    return proxies.select(*[F.col(c).alias(f"{c}_{side}") for c in (*NODE, "proxy", "lat", "lon", "w")])


def work(met: DataFrame) -> int:
    """How many times the kernel is evaluated for these node pairs."""
    size = lambda s: F.when(F.col(f"proxy_{s}"), LEAF).otherwise(F.col(f"n_{s}"))
    return met.agg(F.sum(size("o") * size("d")).alias("n")).first().n or 0


def effective_distance(pairs: DataFrame, origins: DataFrame, destinations: DataFrame, theta: float = -5.0, floor_km: float = K.FLOOR_KM) -> DataFrame:
    """``o, d, d_eff``: what ``measures.effective_distance`` gives for all pairs of atoms, by node pairs.

    Only positive weights count, a pair of regions without any has no row, and near
    theta 0 it is the geometric mean. ``pairs`` are pairs of regions, once each.
    """
    if not 0 < floor_km < float("inf"):
        raise ValueError("floor_km must be finite and positive")
    a = _boxed(origins)
    b = a if destinations is origins else _boxed(destinations)
    nodes_a = _nodes(a)
    nodes_b = nodes_a if b is a else _nodes(b)
    met = written(node_pairs(pairs, nodes_a, nodes_b, floor_km), "tree-met")
    rows = met
    for side, atoms, nodes in (("o", a, nodes_a), ("d", b, nodes_b)):
        rows = rows.join(_points(atoms, nodes, met, side), [f"{c}_{side}" for c in (*NODE, "proxy")])
    km = F.greatest(haversine_km("lat_o", "lon_o", "lat_d", "lon_d"), F.lit(floor_km))
    bound = floor_km if theta < 0 else math.pi * K.EARTH_KM
    kernel = F.log(km) if abs(theta) < 1e-8 else F.pow(km / bound, F.lit(float(theta)))
    sums = rows.groupBy(F.col("region_o").alias("o"), F.col("region_d").alias("d")).agg(F.sum(F.col("w_o") * F.col("w_d") * kernel).alias("s"))
    mass = lambda t, s: t.groupBy(F.col("region").alias(s)).agg(F.sum("w").alias(f"mass_{s}"))
    mean = F.col("s") / (F.col("mass_o") * F.col("mass_d"))
    d_eff = F.exp(mean) if abs(theta) < 1e-8 else F.pow(mean, F.lit(1.0 / theta)) * bound
    return sums.join(mass(a, "o"), "o").join(mass(b, "d"), "d").select("o", "d", d_eff.alias("d_eff"))
