"""Optimal transport between regions' atoms: exact, iceberg, entropic, sliced.

There is no relational form of the first three, so each pair of regions is one group of a
cogrouped Python solver. Atoms of one place are summed first. Cap atoms: a group holds two
clouds, and exact transport is meant for some hundreds of places a side.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.constants import EARTH_KM, KM_PER_DEGREE
from .measures import places, tasks


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Great-circle kilometres between (lat, lon) rows."""
    p, q = np.radians(a)[:, None, :], np.radians(b)[None, :, :]
    h = np.sin((q[..., 0] - p[..., 0]) / 2) ** 2 + np.cos(p[..., 0]) * np.cos(q[..., 0]) * np.sin((q[..., 1] - p[..., 1]) / 2) ** 2
    return 2 * EARTH_KM * np.arcsin(np.minimum(1.0, np.sqrt(h)))


def exact(cost: np.ndarray, a: np.ndarray, b: np.ndarray) -> float:
    """The least cost of moving weights ``a`` to ``b`` (of one total): network simplex on strongly feasible trees.

    Arcs enter while one has a negative reduced cost. The potentials bound the cost from below;
    a plan that costs more than that by a millionth is an error, so a value that is returned is the least one.
    """
    n, m = cost.shape
    root, big, c = n + m, float(cost.max()) + 1.0, cost.tolist()
    # Each node hangs at first on the root by an arc dearer than any; ``flow`` is on the arc to ``parent``, from a source or to a sink.
    parent, depth, below = [root] * root + [-1], [1] * root + [0], [set() for _ in range(root)] + [set(range(root))]
    flow, price, tiny = [*a.tolist(), *b.tolist()], [big] * root, 1e-12 * big

    def pivot(i: int, j: int, gain: float) -> None:
        """Brings in the arc from source ``i`` to sink ``j``; the last blocking arc of the cycle goes, which rules out cycling."""
        x, y, down, up = i, n + j, [], []
        while x != y:
            if depth[x] >= depth[y]:
                down.append(x)
                x = parent[x]
            else:
                up.append(y)
                y = parent[y]
        size, out, of_source = math.inf, -1, True
        for x in down:
            if x < n and flow[x] < size:
                size, out = flow[x], x
        for y in up:
            if y >= n and flow[y] <= size:
                size, out, of_source = flow[y], y, False
        for x in down:
            flow[x] += -size if x < n else size
        for y in up:
            flow[y] += -size if y >= n else size
        head, tail = (i, n + j) if of_source else (n + j, i)
        x, above, held = head, tail, size
        while True:  # the part cut off is hung on the new arc
            old, moved = parent[x], flow[x]
            below[old].discard(x)
            below[above].add(x)
            parent[x], flow[x] = above, held
            if x == out:
                break
            x, above, held = old, x, moved
        depth[head], stack = depth[tail] + 1, [head]
        while stack:
            x = stack.pop()
            price[x] += gain if (x < n) == (head < n) else -gain
            for k in below[x]:
                depth[k] = depth[x] + 1
                stack.append(k)

    while True:
        slack = cost - np.array(price[:n])[:, None] - np.array(price[n:root])
        i, j = (np.arange(n), slack.argmin(1)) if n > m else (slack.argmin(0), np.arange(m))
        least = slack[i, j]
        order = np.argsort(least)[: int((least < -tiny).sum())]
        if not len(order):
            break
        for x, y in zip(i[order].tolist(), j[order].tolist(), strict=True):
            gain = c[x][y] - price[x] - price[n + y]
            if gain < -tiny:
                pivot(x, y, gain)
    if sum(f for f, up in zip(flow, parent[:root], strict=True) if up == root) > 1e-9 * max(1.0, a.sum()):
        raise ArithmeticError("not all is moved")
    u = np.array(price[:n])
    found = sum(f * (c[x][up - n] if x < n else c[up][x - n]) for x, (f, up) in enumerate(zip(flow, parent[:root], strict=True)) if up != root)
    least = float(a @ u + b @ (cost - u[:, None]).min(axis=0))
    if not abs(found - least) <= 1e-6 * max(1.0, found):
        raise ArithmeticError(f"the plan costs {found}, its potentials say {least}")
    return found


def entropic(cost: np.ndarray, a: np.ndarray, b: np.ndarray, eps: float, rounds: int = 1000, tol: float = 1e-9) -> float:
    """Transport cost of the entropically regularised plan, by scaling.

    Rounds in logarithms are followed by the same rounds as products with the kernel under the potentials
    so far, until its scalings leave the range of a double.
    """
    la, lb = np.log(np.maximum(a, 1e-300)), np.log(np.maximum(b, 1e-300))
    f, g, wa, wb = np.zeros(len(a)), np.zeros(len(b)), np.exp(la), np.exp(lb)

    def lse(x: np.ndarray, axis: int) -> np.ndarray:
        top = x.max(axis=axis, keepdims=True)
        return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis=axis))

    inside = lambda x: bool((x > 1e-50).all() and (x < 1e50).all())
    done = False
    while rounds > 0 and not done:
        f = -eps * lse((g[None] - cost) / eps + lb[None], 1)
        new = -eps * lse((f[:, None] - cost) / eps + la[:, None], 0)
        done, g, rounds = np.abs(new - g).max() < tol * eps, new, rounds - 1
        kernel, p, q = np.exp((f[:, None] + g[None] - cost) / eps), np.ones(len(a)), np.ones(len(b))
        while rounds > 0 and not done:
            rows = kernel @ (wb * q)
            columns = (wa / rows) @ kernel if inside(rows) else rows
            if not inside(columns):
                break
            done, p, q, rounds = np.abs(np.log(columns * q)).max() < tol, 1 / rows, 1 / columns, rounds - 1
        f, g = f + eps * np.log(p), g + eps * np.log(q)
    plan = np.exp((f[:, None] + g[None] - cost) / eps + la[:, None] + lb[None])
    return float((plan * cost).sum())


def sinkhorn(a: np.ndarray, wa: np.ndarray, b: np.ndarray, wb: np.ndarray, eps: float = 50.0, theta: float = 1.0) -> float:
    """The debiased divergence."""
    c = lambda x, y: distances(x, y) ** theta
    return entropic(c(a, b), wa, wb, eps) - entropic(c(a, a), wa, wa, eps) / 2 - entropic(c(b, b), wb, wb, eps) / 2


def line_transport(x: np.ndarray, wx: np.ndarray, y: np.ndarray, wy: np.ndarray, p: float = 2.0) -> float:
    """The p-th power of the p-Wasserstein distance on a line."""
    i, j = np.argsort(x, kind="stable"), np.argsort(y, kind="stable")
    cx, cy = np.cumsum(wx[i]), np.cumsum(wy[j])
    q = np.unique(np.concatenate([cx, cy]))
    q = q[q <= min(cx[-1], cy[-1]) + 1e-12]
    width = np.diff(np.concatenate([[0.0], q]))
    middle = q - width / 2
    ax = x[i][np.minimum(np.searchsorted(cx, middle), len(x) - 1)]
    ay = y[j][np.minimum(np.searchsorted(cy, middle), len(y) - 1)]
    return float((width * np.abs(ax - ay) ** p).sum())


def sliced(a: np.ndarray, wa: np.ndarray, b: np.ndarray, wb: np.ndarray, projections: int = 100, seed: int = 42, p: float = 2.0) -> float:
    """Sliced distance on the latitude-longitude plane, in kilometres at the mean latitude of the centroids.

    Both axes are scaled alike; the measure is declared coarse.
    """
    angle = np.random.default_rng(seed).uniform(0, 2 * np.pi, projections)
    way = np.stack([np.cos(angle), np.sin(angle)])
    lat = (wa @ a[:, 0] + wb @ b[:, 0]) / 2
    mean = np.mean([line_transport(a @ w, wa, b @ w, wb, p) for w in way.T])
    return float(mean ** (1 / p) * KM_PER_DEGREE * np.cos(np.radians(lat)))


def _value(kind: str, a: np.ndarray, wa: np.ndarray, b: np.ndarray, wb: np.ndarray, options: dict) -> float:
    if not len(a) or not len(b):
        return float("nan")
    if kind == "wasserstein":
        return exact(distances(a, b), wa, wb)
    if kind == "iceberg":
        theta, p = options.get("theta", 1.0), options.get("p", 1.0)
        return exact(distances(a, b) ** (theta * p), wa, wb) ** (1 / p)
    if kind == "entropic":
        return entropic(distances(a, b) ** options.get("theta", 1.0), wa, wb, options.get("eps", 50.0))
    raise ValueError(f"unknown transport {kind!r}")


def _cloud(rows: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    rows = rows[rows["weight"] > 0].sort_values(["lat", "lon", "weight"])
    w = rows["weight"].to_numpy(float)
    return rows[["lat", "lon"]].to_numpy(float), w / w.sum() if len(w) else w


def solve(origins: DataFrame, destinations: DataFrame, pairs: DataFrame, wanted: list[tuple[str, str, dict]]) -> DataFrame:
    """``o, d`` and one column for each (name, kind, options); only atoms of positive weight count, and values are null where a cloud has none."""
    names = [n for n, _, _ in wanted]

    def one(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        (a, wa), (b, wb) = _cloud(left), _cloud(right)
        return pd.DataFrame({"o": [key[0]], "d": [key[1]], **{n: [_value(k, a, wa, b, wb, dict(x))] for n, k, x in wanted}})

    spark = pairs.sparkSession
    origins, destinations = places(origins), places(destinations)  # cost and weight of a place are all that counts
    left = pairs.join(origins.select(F.col("region").alias("o"), "lat", "lon", "weight"), "o").select("o", "d", "lat", "lon", "weight")
    right = pairs.join(destinations.select(F.col("region").alias("d"), "lat", "lon", "weight"), "d").select("o", "d", "lat", "lon", "weight")
    kinds = dict(pairs.dtypes)
    left, right = (t.toDF(*t.columns).repartition(tasks(spark), "o", "d") for t in (left, right))
    return left.groupBy("o", "d").cogroup(right.groupBy("o", "d")).applyInPandas(one, f"o {kinds['o']}, d {kinds['d']}, " + ", ".join(f"`{n}` double" for n in names))


def m6_wasserstein(origins: DataFrame, destinations: DataFrame, pairs: DataFrame) -> DataFrame:
    return solve(origins, destinations, pairs, [("m6", "wasserstein", {})])


def m7_iceberg(origins: DataFrame, destinations: DataFrame, pairs: DataFrame, theta: float = 1.0, p: float = 1.0) -> DataFrame:
    return solve(origins, destinations, pairs, [("m7", "iceberg", {"theta": theta, "p": p})])


def _debiased(crossed: DataFrame, origins: DataFrame, destinations: DataFrame, name: str, eps: float, theta: float) -> DataFrame:
    """``crossed`` with its column ``name`` less half of each side's term with itself, which is solved once a region and side."""
    def own(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        a, w = _cloud(rows)
        return pd.DataFrame({"side": [key[0]], "region": [key[1]], "own": [_value("entropic", a, w, a, w, {"eps": eps, "theta": theta})]})

    rows = lambda t, s, c: t.join(crossed.select(F.col(c).alias("region")).distinct(), "region", "left_semi").select(F.lit(s).alias("side"), "region", "lat", "lon", "weight")
    clouds = rows(places(origins), "from", "o").unionByName(rows(places(destinations), "to", "d"))
    clouds = clouds.repartition(tasks(clouds.sparkSession), "side", "region")
    terms = clouds.groupBy("side", "region").applyInPandas(own, f"side string, region {dict(clouds.dtypes)['region']}, own double")
    side = lambda s, c: terms.where(F.col("side") == s).select(F.col("region").alias(c), F.col("own").alias(f"own_{c}"))
    value = F.col(name) - F.col("own_o") / 2 - F.col("own_d") / 2
    return crossed.join(side("from", "o"), "o", "left").join(side("to", "d"), "d", "left").select(*[value.alias(c) if c == name else F.col(c) for c in crossed.columns])


def m8_sinkhorn(origins: DataFrame, destinations: DataFrame, pairs: DataFrame, eps: float = 50.0, theta: float = 1.0) -> DataFrame:
    """The debiased divergence of each pair; null where a cloud is empty."""
    return _debiased(solve(origins, destinations, pairs, [("m8", "entropic", {"eps": eps, "theta": theta})]), origins, destinations, "m8", eps, theta)


def m6_to_m8(origins: DataFrame, destinations: DataFrame, pairs: DataFrame, thetas: tuple[float, ...], eps: float = 50.0) -> DataFrame:
    """``o, d, m6``, ``m7_theta...`` for each theta, and ``m8``, null where a cloud is empty; at theta 1 the iceberg distance is m6 and is not solved again."""
    others = [(f"m7_theta{t:g}", "iceberg", {"theta": t}) for t in thetas if t != 1]
    found = solve(origins, destinations, pairs, [("m6", "wasserstein", {}), *others, ("m8", "entropic", {"eps": eps})])
    wide = found.select("o", "d", "m6", *[F.col("m6" if t == 1 else f"`m7_theta{t:g}`").alias(f"m7_theta{t:g}") for t in thetas], "m8")
    return _debiased(wide.withColumnsRenamed({c: c.replace(".", "_") for c in wide.columns}), origins, destinations, "m8", eps, 1.0).withColumnsRenamed({c.replace(".", "_"): c for c in wide.columns})


def sliced_angles(projections: int = 100, seed: int = 42) -> list[float]:
    """The directions of the slices, in radians."""
    return [float(x) for x in np.random.default_rng(seed).uniform(0, 2 * np.pi, projections)]


def m9_sliced(origins: DataFrame, destinations: DataFrame, pairs: DataFrame, projections: int = 100, seed: int = 42) -> DataFrame:
    """``o, d, m9``: sliced 2-Wasserstein distance, in km at the mean latitude of both centroids; NaN where a cloud is empty.

    Relational throughout. On a slice, with F and G the quantile functions, the squared
    distance is the integral of F F + G G - 2 F G. The first two belong to one cloud; the
    third is a sum over the origin's atoms of steps of F times the integral of G up to
    the atom's cumulated weight. So each destination's slice is sorted once, together with
    the cumulated weights of all origins' atoms on that slice, not once a pair. Slices are
    centred first, so that nothing cancels but what is small.
    """
    spark = pairs.sparkSession
    ways = F.broadcast(spark.createDataFrame([(k, float(np.cos(a)), float(np.sin(a))) for k, a in enumerate(sliced_angles(projections, seed))], "slice int, c double, s double"))  # as many rows as slices

    def side(table: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
        """Each region's mean and latitude, and its atoms' centred places on each slice with the weight before them."""
        own = places(table).where("weight > 0").select(F.col("region").alias(name), "lat", "lon", "weight").join(pairs.select(name).distinct(), name, "left_semi")
        sums = own.groupBy(name).agg(F.sum("weight").alias("mass"), (F.sum(F.col("weight") * F.col("lat")) / F.sum("weight")).alias(f"lat_{name}"), (F.sum(F.col("weight") * F.col("lon")) / F.sum("weight")).alias(f"lon_{name}"))
        at = own.join(sums, name).join(ways)
        x = (F.col("lat") - F.col(f"lat_{name}")) * F.col("c") + (F.col("lon") - F.col(f"lon_{name}")) * F.col("s")
        return sums.drop("mass"), at.select(name, "slice", x.alias("x"), (F.col("weight") / F.col("mass")).alias("w"))

    (means_o, atoms_o), (means_d, atoms_d) = side(origins, "o"), side(destinations, "d")
    ranked = lambda name: Window.partitionBy(name, "slice").orderBy("x", "w")
    squares = lambda t, name: t.groupBy(name, "slice").agg(F.sum(F.col("w") * F.col("x") * F.col("x")).alias(f"square_{name}"))
    upto = F.sum("w").over(ranked("o").rowsBetween(Window.unboundedPreceding, 0))
    steps = atoms_o.select("o", "slice", upto.alias("q"), (F.col("x") - F.coalesce(F.lead("x").over(ranked("o")), F.lit(0.0))).alias("step"))
    asked = steps.join(pairs.select("o", "d"), "o").select("d", "slice", "q", "o", "step", F.lit(None).cast("struct<q:double,h:double,x:double>").alias("knot"))
    earlier = ranked("d").rowsBetween(Window.unboundedPreceding, -1)
    before, integral = F.coalesce(F.sum("w").over(earlier), F.lit(0.0)), F.coalesce(F.sum(F.col("w") * F.col("x")).over(earlier), F.lit(0.0))
    knots = atoms_d.select("d", "slice", before.alias("q"), F.lit(None).cast(dict(pairs.dtypes)["o"]).alias("o"), F.lit(None).cast("double").alias("step"), F.struct(before.alias("q"), integral.alias("h"), F.col("x").alias("x")).alias("knot"))
    below = F.last("knot", ignorenulls=True).over(Window.partitionBy("d", "slice").orderBy("q", F.col("step").isNotNull()).rowsBetween(Window.unboundedPreceding, 0))
    met = knots.unionByName(asked).withColumn("at", below).where("step is not null")
    value = F.col("step") * (F.col("at.h") + (F.col("q") - F.col("at.q")) * F.col("at.x"))
    cross = met.groupBy("o", "d", "slice").agg(F.sum(value).alias("cross"))
    apart = (F.col("lat_o") - F.col("lat_d")) * F.col("c") + (F.col("lon_o") - F.col("lon_d")) * F.col("s")
    each = cross.join(squares(atoms_o, "o"), ["o", "slice"]).join(squares(atoms_d, "d"), ["d", "slice"]).join(ways, "slice").join(means_o, "o").join(means_d, "d")
    each = each.withColumn("square", F.greatest(F.lit(0.0), F.col("square_o") + F.col("square_d") - 2 * F.col("cross")) + apart * apart)
    found = each.groupBy("o", "d").agg((F.sqrt(F.avg("square")) * KM_PER_DEGREE * F.cos(F.radians(F.first((F.col("lat_o") + F.col("lat_d")) / 2)))).alias("m9"))
    return pairs.select("o", "d").join(found, ["o", "d"], "left").withColumn("m9", F.coalesce("m9", F.lit(float("nan"))))
