"""Clouds of regions by layer, kept in a folder: only what is missing or has changed is computed.

The folder has clouds in ``clouds/layer=.../region=...`` and a manifest of ``layer, region,
content``, where the content is an order-free digest of the layer's cells and the region's
membership. A pair whose content is in the manifest is read; an anti join finds the others, and a
dynamic overwrite replaces their partitions and no other. Clouds carry their content, too, so what a
pair that has become empty leaves behind is not returned. The manifest is written after the
clouds, so a job that is lost in between computes its pairs again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.atoms import masked, to_atoms
from ..operators.components import written
from .readers import exists

CLOUDS = "layer string, region string, lat double, lon double, weight double, total_mass double, content string"
MANIFEST = "layer string, region string, content string, rank long"


def contents(cells: DataFrame, members: DataFrame, rule: str = "") -> DataFrame:
    """``layer, region, content`` of cells ``layer, row, col, value`` and ``members(region, row, col)``.

    A region's content covers its own cells of the layer, so a change elsewhere does not
    touch it. ``rule`` names whatever else the clouds depend on.
    """
    own = cells.join(members, ["row", "col"]).select("layer", F.col("region").cast("string").alias("region"), F.md5(F.concat_ws("|", "row", "col", F.coalesce(F.col("value").cast("string"), F.lit("null")))).alias("key"))
    half = lambda start: F.sum(F.conv(F.substring("key", start, 15), 16, 10).cast("decimal(20,0)"))
    sums = own.groupBy("layer", "region").agg(half(1).alias("a"), half(17).alias("b"), F.count("*").alias("n"))
    return sums.select("layer", "region", F.sha2(F.concat_ws("|", F.lit(rule), "a", "b", "n"), 256).alias("content"))


def _manifest(spark, path: str) -> DataFrame:
    """The latest content of each pair."""
    at = f"{path}/manifest"
    rows = spark.read.schema(MANIFEST).parquet(at) if exists(spark, at) else spark.createDataFrame([], MANIFEST)
    return rows.groupBy("layer", "region").agg(F.max_by("content", "rank").alias("content"), F.max("rank").alias("rank"))


def through(cells: DataFrame, members: DataFrame, affine: tuple, path: str, k: int = 1, least: float = 0.0, by_area: bool = True) -> tuple[DataFrame, int]:
    """Clouds ``layer, region, lat, lon, weight, total_mass`` of all pairs of a layer and a region, and how many had to be computed.

    ``cells`` are ``layer, row, col, value`` and ``members(region, row, col)`` says which cells a region
    has; a layer and a region that share no cell have no cloud, and neither has one without
    a cell above ``least``. Regions come back as text. Clouds in the folder of pairs that are not
    asked for stay and are not returned.
    """
    spark = cells.sparkSession
    asked = written(contents(cells, members, f"{affine} {k} {least} {by_area}"), "contents")
    known = written(_manifest(spark, path), "manifest")
    missing = written(asked.join(known.select("layer", "region", "content"), ["layer", "region", "content"], "left_anti"), "missing")
    count = missing.count()
    if count:
        own = members.withColumn("region", F.col("region").cast("string"))
        fresh = cells.join(own, ["row", "col"]).join(missing.select("layer", "region"), ["layer", "region"], "left_semi")
        # Membership was applied above; masks of several layers are one plan.
        pairs = fresh.withColumn("pair", F.struct("layer", "region"))
        blocks = masked(pairs.select("pair", "row", "col", "value"), pairs.select("row", "col", "region").distinct(), affine, k, least, keys=("pair",)).where("pair.region = region")
        whole = blocks.drop("region").withColumnRenamed("pair", "region")
        masses = whole.groupBy("region").agg(F.sum("value").alias("total_mass"))
        clouds = to_atoms(whole, by_area).join(masses, "region").select("region.layer", "region.region", "lat", "lon", "weight", "total_mass").join(missing, ["layer", "region"])
        clouds.repartition("layer", "region").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("layer", "region").parquet(f"{path}/clouds")
        rank = known.agg(F.coalesce(F.max("rank"), F.lit(0))).first()[0] + 1
        missing.select("layer", "region", "content", F.lit(rank).cast("long").alias("rank")).coalesce(1).write.mode("append").parquet(f"{path}/manifest")
    at = f"{path}/clouds"
    clouds = spark.read.schema(CLOUDS).parquet(at) if exists(spark, at) else spark.createDataFrame([], CLOUDS)
    return clouds.join(asked, ["layer", "region", "content"], "left_semi").drop("content"), count
