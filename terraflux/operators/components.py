"""Connected components, agglomerations of dense cells, coverage cuts."""

from __future__ import annotations

import functools
import re
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions.geo import haversine_km
from .measures import planar_centroid


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``; a folder of our own only on one machine where it is unset."""
    known = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not known:
        if not re.fullmatch(r"local(\[[^-]*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir is not set: iterations need a folder that all executors share")
        known = "file:///tmp/checkpoints/terraflux"
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(known)
    return known.rstrip("/")


def checkpointed(df: DataFrame) -> DataFrame:
    """Cuts the lineage of an iteration, in the folder the session names for it."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def written(df: DataFrame, name: str) -> DataFrame:
    """The same rows, written as Parquet into the shared folder and read back."""
    path = f"{shared_dir(df.sparkSession)}/terraflux/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def components(nodes: DataFrame, edges: DataFrame, max_rounds: int = 50) -> DataFrame:
    """``node, component``: the least node reachable over ``edges(a, b)``, taken in both directions.

    A round hangs the greater neighbours of a node on its least neighbour (large star), then
    the lesser ones (small star), until all hang on a least node; the rounds grow with the
    logarithm of a component's size. Each is written, not checkpointed: a checkpoint keeps its
    plan's estimate of size, and as joins multiply those, its digits double in a round.
    """
    own = written(nodes.select("node").where("node is not null").distinct(), "component-nodes")
    two = lambda names, *rows: F.inline(F.array(*[F.struct(*[F.lit(v).alias(n) if isinstance(v, int) else F.col(v).alias(n) for n, v in zip(names, r, strict=True)]) for r in rows]))
    end = lambda c: own.select(F.col("node").alias(c))
    known = edges.where("a <> b").join(end("a"), "a", "left_semi").join(end("b"), "b", "left_semi")
    pairs = written(known.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "component-edges")
    for _ in range(max_rounds):
        ends = pairs.select(two(("n", "hangs"), ("a", 1), ("b", 0))).groupBy("n").agg(F.sum("hangs").alias("hangs"), F.count("*").alias("edges"))
        if not ends.where("hangs > 1 or (hangs = 1 and edges > 1)").limit(1).count():
            return own.join(pairs.toDF("node", "least"), "node", "left").select("node", F.coalesce("least", "node").alias("component"))
        both = pairs.select(two("uv", "ab", "ba"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()
        small = large.join(large.groupBy("a").agg(F.min("b").alias("m")), "a")
        pairs = written(small.select(two("ab", "am", "bm")).where("a <> b").distinct(), "component-edges")
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")


def grid_components(cells: DataFrame) -> DataFrame:
    """Adds ``component`` to cells ``region, row, col``: 4-neighbours of one region hang together."""
    name = F.concat_ws(":", "region", "row", "col")
    own = cells.withColumn("node", name)
    step = lambda dr, dc: own.select("region", F.col("row") + dr, F.col("col") + dc, F.col("node").alias("b")).toDF("region", "row", "col", "b")
    edges = own.select("region", "row", "col", F.col("node").alias("a")).join(step(1, 0).unionByName(step(0, 1)), ["region", "row", "col"]).select("a", "b")
    return own.join(components(own.select("node"), edges), "node").drop("node")


def near_pairs(points: DataFrame, km: float, by: tuple[str, ...] = (), key: str = "id") -> DataFrame:
    """``a, b`` (a < b): points within ``km``, found among neighbouring latitude and longitude buckets."""
    tall = km / K.KM_PER_DEGREE
    band = F.floor(F.col("lat") / tall).cast("int")
    own = points.select(*by, F.col(key).alias("a"), F.col("lat").alias("lat_a"), F.col("lon").alias("lon_a"), F.explode(F.array(*[band + k for k in (-1, 0, 1)])).alias("band"))
    other = points.select(*by, F.col(key).alias("b"), F.col("lat").alias("lat_b"), F.col("lon").alias("lon_b"), band.alias("band"))
    # The longitude bucket's width depends on the band alone, so both sides compute the same.
    of = lambda lat_band: F.least(F.lit(360.0), tall / F.cos(F.radians(F.least(F.lit(89.9), F.greatest(F.abs(lat_band * tall), F.abs((lat_band + 1) * tall)) + tall))) * 1.001)
    count = lambda lat_band: F.greatest(F.lit(1), F.floor(F.lit(360.0) / of(lat_band)).cast("int"))
    slot = lambda lon, lat_band: F.floor(F.pmod(lon + 180, F.lit(360.0)) / (F.lit(360.0) / count(lat_band))).cast("int")
    b = F.col("band")
    left = own.withColumn("slot", F.explode(F.array_distinct(F.array(*[F.pmod(slot(F.col("lon_a"), b) + k, count(b)) for k in (-1, 0, 1)]))))
    right = other.withColumn("slot", F.pmod(slot(F.col("lon_b"), b), count(b)))
    met = left.join(right, [*by, "band", "slot"]).where("a < b")
    return met.where(haversine_km("lat_a", "lon_a", "lat_b", "lon_b") <= km).select(*by, "a", "b").distinct()


def merged(points: DataFrame, km: float = K.MERGE_KM, by: tuple[str, ...] = ("region",), key: str = "id") -> DataFrame:
    """Points ``id, lat, lon, weight`` chained within ``km`` become one, at their weighted mean.

    Points of one place hang together, so the least of them stands for all when neighbours are sought.
    """
    place = (*by, "lat", "lon")
    known = functools.reduce(Column.__and__, [F.col(c).isNotNull() for c in place]) & ~F.isnan("lat") & ~F.isnan("lon")
    firsts = written(points.where(known).groupBy(*place).agg(F.min(key).alias("_first")), "merged-places")
    groups = components(firsts.select(F.col("_first").alias("node")), near_pairs(firsts, km, by, "_first").select("a", "b"))
    labels = firsts.join(groups, firsts["_first"] == groups["node"]).select(*place, "component")
    unknown = points.where(F.coalesce(~known, F.lit(True))).withColumn("component", F.col(key))  # near to nothing
    own = points.where(known).join(labels, list(place)).unionByName(unknown)
    return planar_centroid(own, (*by, "component")).join(own.groupBy(*by, "component").agg(F.count("*").alias("n_merged")), [*by, "component"])


def coverage_cut(points: DataFrame, target: float = K.COVERAGE, most: int = K.MOST_AGGLOMERATIONS, by: tuple[str, ...] = ("region",), weight: str = "weight", key: str = "id") -> DataFrame:
    """The heaviest points until ``target`` of the region is covered, one at least, ``most`` at most.

    Adds ``agglom_id`` (rank from 0) and ``coverage_share``, the final share on every row.
    """
    from .order import running

    ranked = running(points, [F.desc(weight), F.col(key)], by, weight).withColumn("agglom_id", F.col("_rank").cast("int"))
    kept = ranked.where((F.col("agglom_id") < most) & ((F.col("agglom_id") == 0) | (F.col("_before") / F.col("_total") < target)))
    whole = Window.partitionBy(*by)  # at most ``most`` rows
    return kept.withColumn("coverage_share", F.sum(weight).over(whole) / F.col("_total")).drop("_before", "_total", "_rank", "_count")


def window_sum(points: DataFrame, cells: DataFrame, radius_deg: float, value: str = "value", key: str = "id") -> DataFrame:
    """Adds to ``points`` the sum of cells within ``radius_deg`` in both axes, by a bucketed band join."""
    slot = lambda c: F.floor(F.col(c) / radius_deg).cast("int")
    around = lambda c: F.explode(F.array(*[slot(c) + k for k in (-1, 0, 1)]))
    p = points.select(F.col(key).alias("_k"), F.col("lat").alias("_lat"), F.col("lon").alias("_lon")).withColumn("_r", around("_lat")).withColumn("_c", around("_lon"))
    c = cells.select("lat", "lon", F.col(value).alias("_v"), slot("lat").alias("_r"), slot("lon").alias("_c"))
    met = p.join(c, ["_r", "_c"]).where((F.abs(F.col("lat") - F.col("_lat")) <= radius_deg) & (F.abs(F.col("lon") - F.col("_lon")) <= radius_deg))
    sums = met.groupBy(F.col("_k").alias(key)).agg(F.sum("_v").alias("viirs_radiance"))
    return points.join(sums, key, "left").withColumn("viirs_radiance", F.coalesce("viirs_radiance", F.lit(0.0)))


def agglomerations(cells: DataFrame, lights: DataFrame | None = None, density: float = K.DENSITY, least: float = K.LEAST_POPULATION, merge_km: float = K.MERGE_KM, target: float = K.COVERAGE, most: int = K.MOST_AGGLOMERATIONS, radius_deg: float = 0.25) -> DataFrame:
    """Urban nodes of each region from population cells ``region, row, col, lat, lon, value, area_km2``.

    Dense cells hang together by sides; components under ``least`` people go, those within
    ``merge_km`` merge, and the largest that cover ``target`` stay. A region without any
    dense cell is one node at its population's centre, with coverage 1; one whose
    components are all small has none.
    """
    people = cells.withColumn("value", F.when(F.col("value") > 0, F.col("value")).otherwise(0.0))
    dense = people.where((F.col("value") / F.col("area_km2") >= density) & (F.col("value") > 0))
    parts = planar_centroid(grid_components(dense).withColumnRenamed("value", "weight"), ("region", "component"))
    big = written(parts.where(F.col("weight") >= least).withColumnRenamed("component", "id"), "agglomeration-parts")  # places are met by equality: their sums must not be taken twice
    cut = coverage_cut(merged(big, merge_km).withColumnRenamed("component", "id"), target, most).select("region", "id", "agglom_id", "lat", "lon", F.col("weight").alias("pop"), "coverage_share")
    whole = planar_centroid(people.join(dense.select("region").distinct(), "region", "left_anti").where("value > 0").withColumnRenamed("value", "weight"), ("region",))
    out = cut.unionByName(whole.select("region", F.concat_ws(":", "region", F.lit("all")).alias("id"), F.lit(0).alias("agglom_id"), "lat", "lon", F.col("weight").alias("pop"), F.lit(1.0).alias("coverage_share")))
    out = window_sum(out, lights, radius_deg) if lights is not None else out.withColumn("viirs_radiance", F.lit(0.0))
    return out.select("region", "agglom_id", F.bround("lon", 5).alias("lon"), F.bround("lat", 5).alias("lat"), F.bround("pop", 0).alias("pop"), F.bround("viirs_radiance", 4).alias("viirs_radiance"), F.bround("coverage_share", 6).alias("coverage_share"))
