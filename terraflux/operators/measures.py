"""Distances between regions that are weighted point clouds (long tables of atoms).

Atoms have ``region, lat, lon, weight``. A pair of regions is a row of a pair table; its
atoms meet by equality joins on the two region keys, so the atom-by-atom work is dealt
out by pair and summed on the map side. Power means see places only, so atoms of one place
are summed first (``place_pairs``). Cap or coarsen atoms (``atoms``), or take ``tree``, where
there are many: the work for a pair is the product of its regions' counts of places.
"""

from __future__ import annotations

import functools
import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions.geo import haversine_km, planar_km


def shares(atoms: DataFrame, keys: tuple[str, ...] = ("region",), weight: str = "weight") -> DataFrame:
    """Adds ``share`` of the region's total; a total of zero gives equal shares."""
    total = atoms.groupBy(*[F.col(k).alias(f"_{k}") for k in keys]).agg(F.coalesce(F.sum(weight), F.lit(0.0)).alias("_total"), F.count("*").alias("_count"))
    same = functools.reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys])
    share = F.when(F.col("_total") == 0, F.lit(1.0) / F.col("_count")).otherwise(F.coalesce(F.col(weight), F.lit(0.0)) / F.col("_total"))
    return atoms.join(total, same).withColumn("share", share).drop("_total", "_count", *[f"_{k}" for k in keys])


def spherical_centroid(atoms: DataFrame, keys: tuple[str, ...] = ("region",), weight: str | None = "weight") -> DataFrame:
    """Weighted mean direction: ``centroid_lat, centroid_lon, total_mass, n_atoms``; weight None: equal."""
    w = F.col(weight) if weight else F.lit(1.0)
    lat, lon = F.radians("lat"), F.radians("lon")
    x, y, z = (F.sum(w * v) for v in (F.cos(lat) * F.cos(lon), F.cos(lat) * F.sin(lon), F.sin(lat)))
    out = atoms.groupBy(*keys).agg(x.alias("x"), y.alias("y"), z.alias("z"), F.sum(w).alias("total_mass"), F.count("*").alias("n_atoms"))
    return out.select(*keys, F.degrees(F.atan2("z", F.sqrt(F.col("x") * F.col("x") + F.col("y") * F.col("y")))).alias("centroid_lat"), F.degrees(F.atan2("y", "x")).alias("centroid_lon"), "total_mass", "n_atoms")


def planar_centroid(atoms: DataFrame, keys: tuple[str, ...] = ("region",), weight: str = "weight") -> DataFrame:
    w = F.sum(weight)
    return atoms.groupBy(*keys).agg((F.sum(F.col("lat") * F.col(weight)) / w).alias("lat"), (F.sum(F.col("lon") * F.col(weight)) / w).alias("lon"), w.alias("weight"))


def pairs_of(origins: DataFrame, destinations: DataFrame, same: bool = True, keys: tuple[str, ...] = ()) -> DataFrame:
    """All ordered pairs ``o, d`` of two region lists (a few thousand regions), by equal ``keys``."""
    a = origins.select(*keys, F.col("region").alias("o")).distinct().withColumn("_all", F.lit(1))
    b = destinations.select(*keys, F.col("region").alias("d")).distinct().withColumn("_all", F.lit(1))
    out = a.join(b, ["_all", *keys]).drop("_all")
    return out if same else out.where("o <> d")


def atom_pairs(pairs: DataFrame, origins: DataFrame, destinations: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """``o, d, lat_o, lon_o, w_o, lat_d, lon_d, w_d`` for every pair of atoms of every pair of regions."""
    side = lambda t, s: t.select(*keys, F.col("region").alias(s), F.col("lat").alias(f"lat_{s}"), F.col("lon").alias(f"lon_{s}"), F.col("weight").alias(f"w_{s}"))
    return pairs.join(side(origins, "o"), [*keys, "o"]).join(side(destinations, "d"), [*keys, "d"])


def places(atoms: DataFrame, by: tuple[str, ...] = ("region",)) -> DataFrame:
    """``by, lat, lon, weight``: one row a place, with its positive weights summed (0 if it has none)."""
    weight = F.col("weight").cast("double")
    return atoms.groupBy(*by, "lat", "lon").agg(F.sum(F.when(weight > 0, weight).otherwise(0.0)).alias("weight"))


def tasks(spark: SparkSession) -> int:
    """Into how many tasks rows are dealt that are few but costly, which Spark would put into one by their size."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism)


def place_pairs(pairs: DataFrame, origins: DataFrame, destinations: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """``atom_pairs`` over places in place of atoms: what depends on distances and sums of weights is the same.

    The origins' places are dealt out by place, as a few rows of them stand for many meetings.
    """
    a = places(origins, (*keys, "region"))
    dealt = a.repartition(tasks(pairs.sparkSession), *keys, "region", "lat", "lon")
    return atom_pairs(pairs, dealt, a if destinations is origins else places(destinations, (*keys, "region")), keys)


def power_mean(costs: DataFrame, keys: tuple[str, ...], theta: float, cost: str = "cost", w_o: str = "share_o", w_d: str = "share_d") -> DataFrame:
    """``(sum w_o w_d cost**theta)**(1/theta)``; theta 0 is an error here."""
    if theta == 0:
        raise ValueError("theta must not be 0")
    return costs.groupBy(*keys).agg(F.pow(F.sum(F.col(w_o) * F.col(w_d) * F.pow(cost, F.lit(float(theta)))), F.lit(1.0 / theta)).alias("effective"))



def _one_pass_holds(theta: float, floor_km: float) -> bool:
    """Whether a double holds the widest ratio of distances, from the floor to half the girth of the sphere, to this power."""
    return abs(theta) * abs(math.log10(math.pi * K.EARTH_KM / floor_km)) < 290


def _one_pass(meetings: DataFrame, keys: tuple[str, ...], thetas: tuple[float, ...], floor_km: float, planar: bool) -> DataFrame:
    """``keys`` and a column ``d0, d1, ...`` for each theta: one aggregation of the atom pairs, whatever the number of thetas.

    Distances are taken relative to the floor, the least they can be (theta < 0), or to
    half the girth of the sphere, the greatest (theta > 0), so that no term overflows.
    """
    km = (planar_km if planar else haversine_km)("lat_o", "lon_o", "lat_d", "lon_d")
    rows = meetings.where("w_o > 0 and w_d > 0").select(*keys, (F.col("w_o") * F.col("w_d")).alias("w"), F.greatest(km, F.lit(floor_km)).alias("km"))
    bound = lambda t: floor_km if t < 0 else math.pi * K.EARTH_KM
    term = lambda t: F.log("km") if abs(t) < 1e-8 else F.pow(F.col("km") / bound(t), F.lit(t))
    sums = rows.groupBy(*keys).agg(F.sum("w").alias("mass"), *[F.sum(F.col("w") * term(t)).alias(f"s{k}") for k, t in enumerate(thetas)])
    mean = lambda k: F.col(f"s{k}") / F.col("mass")
    return sums.select(*keys, *[(F.exp(mean(k)) if abs(t) < 1e-8 else F.pow(mean(k), F.lit(1.0 / t)) * bound(t)).alias(f"d{k}") for k, t in enumerate(thetas)])


def effective_distance(meetings: DataFrame, keys: tuple[str, ...] = ("o", "d"), theta: float = -5.0, floor_km: float = K.FLOOR_KM, planar: bool = False) -> DataFrame:
    """Power-mean distance of atom pairs, stable for any theta: ``d_eff`` by ``keys``.

    Distances are floored. Weights are normalised within the pair; only positive ones
    count, and a pair without any has no row. Near theta 0 it is the geometric mean.
    Where a double can hold all terms relative to one bound it is a single aggregation;
    beyond that, one for the largest log-term and one for the sum relative to it.
    """
    if not 0 < floor_km < float("inf"):
        raise ValueError("floor_km must be finite and positive")
    if _one_pass_holds(theta, floor_km):
        return _one_pass(meetings, keys, (float(theta),), floor_km, planar).withColumnRenamed("d0", "d_eff")
    km = (planar_km if planar else haversine_km)("lat_o", "lon_o", "lat_d", "lon_d")
    rows = meetings.where("w_o > 0 and w_d > 0").select(*keys, (F.col("w_o") * F.col("w_d")).alias("w"), (F.log(F.greatest(km, F.lit(floor_km))) * theta).alias("term"))
    both = rows.join(rows.groupBy(*keys).agg(F.max("term").alias("top")), list(keys))
    sums = both.groupBy(*keys).agg(F.max("top").alias("top"), F.sum("w").alias("mass"), F.sum(F.col("w") * F.exp(F.col("term") - F.col("top"))).alias("scaled"))
    return sums.select(*keys, F.exp((F.col("top") + F.log(F.col("scaled") / F.col("mass"))) / theta).alias("d_eff"))


def theta_sweep(meetings: DataFrame, thetas: tuple[float, ...], keys: tuple[str, ...] = ("o", "d"), floor_km: float = K.FLOOR_KM) -> DataFrame:
    """``effective_distance`` for several thetas, in one aggregation of the atom pairs."""
    if not all(_one_pass_holds(t, floor_km) for t in thetas):
        parts = [effective_distance(meetings, keys, t, floor_km).select(*keys, F.lit(float(t)).alias("theta"), "d_eff") for t in thetas]
        return functools.reduce(DataFrame.unionByName, parts)
    wide = _one_pass(meetings, keys, tuple(map(float, thetas)), floor_km, False)
    long = F.explode(F.array(*[F.struct(F.lit(float(t)).alias("theta"), F.col(f"d{k}").alias("d_eff")) for k, t in enumerate(thetas)])).alias("x")
    return wide.select(*keys, long).select(*keys, "x.*")


def between_points(a: DataFrame, b: DataFrame, pairs: DataFrame, name: str) -> DataFrame:
    """Great-circle distance of two tables of one point a region (``region, lat, lon``)."""
    left = a.select(F.col("region").alias("o"), F.col("lat").alias("lat_o"), F.col("lon").alias("lon_o"))
    right = b.select(F.col("region").alias("d"), F.col("lat").alias("lat_d"), F.col("lon").alias("lon_d"))
    return pairs.join(left, "o").join(right, "d").select("o", "d", haversine_km("lat_o", "lon_o", "lat_d", "lon_d").alias(name))


def _point(centroids: DataFrame) -> DataFrame:
    return centroids.select("region", F.col("centroid_lat").alias("lat"), F.col("centroid_lon").alias("lon"))


def m1_capital(capitals: DataFrame | None, pairs: DataFrame) -> DataFrame:
    if capitals is None:
        raise ValueError("M1 needs capitals")
    return between_points(capitals, capitals, pairs, "m1")


def m2_unweighted_centroid(origins: DataFrame, destinations: DataFrame, pairs: DataFrame) -> DataFrame:
    return between_points(_point(spherical_centroid(origins, weight=None)), _point(spherical_centroid(destinations, weight=None)), pairs, "m2")


def m3_weighted_centroid(origins: DataFrame, destinations: DataFrame, pairs: DataFrame) -> DataFrame:
    return between_points(_point(spherical_centroid(origins)), _point(spherical_centroid(destinations)), pairs, "m3")


def m5_directional_centroid(production: DataFrame, consumption: DataFrame, pairs: DataFrame) -> DataFrame:
    return between_points(_point(spherical_centroid(production)), _point(spherical_centroid(consumption)), pairs, "m5")


def m10_effective(origins: DataFrame, destinations: DataFrame, pairs: DataFrame, theta: float = -5.0, floor_km: float = K.FLOOR_KM) -> DataFrame:
    return effective_distance(place_pairs(pairs, origins, destinations), theta=theta, floor_km=floor_km).withColumnRenamed("d_eff", "m10")


def distance(measure: str, origins: DataFrame, destinations: DataFrame, pairs: DataFrame, capitals: DataFrame | None = None, **options) -> DataFrame:
    """Any measure by its name, in either case."""
    from . import transport

    name = measure.upper()
    if name == "M1":
        return m1_capital(capitals, pairs)
    known = {"M2": m2_unweighted_centroid, "M3": m3_weighted_centroid, "M5": m5_directional_centroid, "M6": transport.m6_wasserstein, "M7": transport.m7_iceberg, "M8": transport.m8_sinkhorn, "M9": transport.m9_sliced, "M10": m10_effective}
    if name not in known:
        raise ValueError(f"unknown measure {measure!r}")
    return known[name](origins, destinations, pairs, **options)


def all_measures(origins: DataFrame, destinations: DataFrame, pairs: DataFrame, capitals: DataFrame | None = None, thetas: tuple[float, ...] = (0.5, 1.0, 1.5, 2.0)) -> DataFrame:
    """One wide row a pair: M1 if capitals are given, M2, M3, M5, M6, M7 at each theta, M8, M9."""
    from . import transport

    out = pairs.select("o", "d")
    parts = ([m1_capital(capitals, pairs)] if capitals is not None else []) + [f(origins, destinations, pairs) for f in (m2_unweighted_centroid, m3_weighted_centroid, m5_directional_centroid)]
    parts.append(transport.m6_to_m8(origins, destinations, pairs, thetas))
    parts.append(transport.m9_sliced(origins, destinations, pairs))
    for part in parts:
        out = out.join(part, ["o", "d"], "left")
    return out


def bilateral(agglomerations: DataFrame, cost: Column, theta: float = -1.0, weight: str = "pop") -> DataFrame:
    """Power mean of a cost between the agglomerations of each country pair and year.

    ``agglomerations`` has ``iso3, year, lon, lat`` and the weight; ``cost`` is an expression
    over ``lon_o, lat_o, lon_d, lat_d``.
    """
    shared = shares(agglomerations, ("iso3", "year"), weight)
    side = lambda s: shared.select("year", F.col("iso3").alias(f"iso_{s}"), F.col("lon").alias(f"lon_{s}"), F.col("lat").alias(f"lat_{s}"), F.col("share").alias(f"share_{s}"))
    met = side("o").join(side("d"), "year").where("iso_o <> iso_d")
    return power_mean(met.withColumn("cost", cost), ("iso_o", "iso_d", "year"), theta)


def overland(agglomerations: DataFrame, theta: float = -1.0, use_lights: bool = False) -> DataFrame:
    """``d_ovdl``: the great-circle power mean by population, or by radiance."""
    km = haversine_km("lat_o", "lon_o", "lat_d", "lon_d")
    return bilateral(agglomerations, F.greatest(km, F.lit(K.FLOOR_KM)), theta, "viirs_radiance" if use_lights else "pop").withColumnRenamed("effective", "d_ovdl")
