"""Directional distances from production to consumption, and how they differ by direction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.geo import haversine_km
from .measures import effective_distance, pairs_of, place_pairs, spherical_centroid


def directional_matrix(production: DataFrame, consumption: DataFrame, theta: float = -5.0, floor_km: float = 0.5, shared: bool = True) -> DataFrame:
    """``o, d, d_eff`` for all ordered pairs of the regions that both clouds have, each with itself too.

    ``shared`` False: from every region of production to every region of consumption.
    """
    both = production.select("region").intersect(consumption.select("region"))
    pairs = pairs_of(both, both) if shared else pairs_of(production, consumption)
    return effective_distance(place_pairs(pairs, production, consumption), theta=theta, floor_km=floor_km)


def asymmetry_index(matrix: DataFrame, value: str = "d_eff") -> DataFrame:
    """``asi = ln(d_od / d_do)`` once for each unordered pair, most asymmetric first."""
    back = matrix.select(F.col("o").alias("_d"), F.col("d").alias("_o"), F.col(value).alias("d_do"))
    met = matrix.select("o", "d", F.col(value).alias("d_od")).join(back, (F.col("o") == F.col("_o")) & (F.col("d") == F.col("_d")) & (F.col("o") < F.col("d")))
    asi = F.log(F.col("d_od") / F.col("d_do"))
    return met.select("o", "d", "d_od", "d_do", asi.alias("asi"), F.abs(asi).alias("abs_asi")).orderBy(F.desc("abs_asi"), "o", "d")


def asymmetry_against_trade(index: DataFrame, flows: DataFrame) -> DataFrame:
    """Index and log trade ratio of pairs that trade both ways: ``o, d, asi, log_ratio``."""
    there = flows.select("o", "d", F.col("x").alias("x_od"))
    back = flows.select(F.col("o").alias("d"), F.col("d").alias("o"), F.col("x").alias("x_do"))
    met = index.join(there, ["o", "d"], "left").join(back, ["o", "d"], "left").where("x_od > 0 and x_do > 0")
    return met.select("o", "d", "asi", F.log(F.col("x_od") / F.col("x_do")).alias("log_ratio"))


def centroid_divergence(production: DataFrame, consumption: DataFrame) -> DataFrame:
    """``region, divergence_km``: how far apart a region's two centroids are, farthest first."""
    a = spherical_centroid(production).select("region", F.col("centroid_lat").alias("lat_p"), F.col("centroid_lon").alias("lon_p"))
    b = spherical_centroid(consumption).select("region", F.col("centroid_lat").alias("lat_c"), F.col("centroid_lon").alias("lon_c"))
    return a.join(b, "region").withColumn("divergence_km", haversine_km("lat_p", "lon_p", "lat_c", "lon_c")).orderBy(F.desc("divergence_km"), "region")
