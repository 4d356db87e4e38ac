"""Raster cells to atoms: masks, coarsening, caps, samples, mass."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geo import cell_area_km2, cell_centre
from .order import running


def coarsen(cells: DataFrame, k: int, keys: tuple[str, ...] = ()) -> DataFrame:
    """Sums blocks of k by k cells ``row, col, value``; the edge is padded with nothing."""
    if k < 1:
        raise ValueError("k must be positive")
    down = lambda c: F.floor(F.col(c) / k).cast("int").alias(c)
    return cells.groupBy(*keys, down("row"), down("col")).agg(F.sum("value").alias("value"))


def coarse_affine(affine: tuple, k: int) -> tuple:
    a, b, c, d, e, f = affine
    return a * k, b * k, c, d * k, e * k, f


def masked(cells: DataFrame, members: DataFrame, affine: tuple, k: int = 1, least: float = 0.0, nodata: float | None = None, geographic: bool = True, keys: tuple[str, ...] = ()) -> DataFrame:
    """Cells of each region as ``region, lat, lon, value, area_km2``, led by ``keys`` (a layer, a year) that stay apart.

    ``members(region, row, col)`` says which cells a region has. Nodata and values that
    are not finite are 0; blocks of k are summed, and those above ``least`` stay.
    """
    value = F.when(F.col("value").isNull() | F.isnan("value") | (F.abs("value") == float("inf")) | (F.lit(False) if nodata is None else F.col("value") == nodata), 0.0).otherwise(F.col("value"))
    own = cells.withColumn("value", value).join(members, ["row", "col"])
    blocks = coarsen(own, k, (*keys, "region")).where(F.col("value") > least)
    fine = coarse_affine(affine, k)
    lon, lat = cell_centre("row", "col", fine)
    out = blocks.select(*keys, "region", lat.alias("lat"), lon.alias("lon"), "value")
    return out.withColumn("area_km2", cell_area_km2("lat", abs(fine[0]), abs(fine[4])) if geographic else F.lit(1.0))


def mass(cells: DataFrame) -> DataFrame:
    """Total value, area and count of each region before any cap."""
    return cells.groupBy("region").agg(F.sum("value").alias("total_mass"), F.sum("area_km2").alias("total_area_km2"), F.count("*").alias("n_cells"))


def to_atoms(cells: DataFrame, by_area: bool = True) -> DataFrame:
    """``region, lat, lon, weight`` that sum to one by region; a total of zero gives zero weights."""
    w = F.col("value") * F.col("area_km2") if by_area else F.col("value")
    total = cells.groupBy("region").agg(F.sum(w).alias("_total"))
    return cells.join(total, "region").select("region", "lat", "lon", F.when(F.col("_total") > 0, w / F.col("_total")).otherwise(0.0).alias("weight"))


def capped(atoms: DataFrame, most: int, strategy: str = "top", key: str = "atom", weight: str = "weight", seed: int = 42, by: tuple[str, ...] = ("region",)) -> DataFrame:
    """At most ``most`` atoms of each region.

    ``top``: the heaviest; ``stratified``: drawn without replacement in proportion to
    weight; ``uniform``: drawn evenly. Draws are a function of seed and key, so they are
    the same in every run.
    """
    u = hash_uniform(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string")))
    orders = {"top": F.desc(weight), "stratified": F.desc(F.log(u) / F.col(weight)), "uniform": F.asc(u)}
    if strategy not in orders:
        raise ValueError(f"unknown strategy {strategy!r}")
    if strategy == "stratified":
        atoms = atoms.where(F.col(weight) > 0)
    return atoms.withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy(orders[strategy], key))).where(F.col("_n") <= most).drop("_n")


def hash_uniform(text: Column) -> Column:
    """A number in (0, 1) from the first eight hex digits of a digest."""
    return (F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double") + 0.5) / 4294967296.0


def from_raster(cells: DataFrame, affine: tuple, least: float = 1e-9, most: int | None = None) -> DataFrame:
    """Atoms of masked cells ``region, row, col, value``: those above ``least``, shares after the cap, mass before it."""
    lon, lat = cell_centre("row", "col", affine)
    own = cells.where((F.col("value") > least) & ~F.isnan("value") & (F.col("value") < float("inf"))).withColumns({"lat": lat, "lon": lon, "atom": F.concat_ws(",", "row", "col")})
    sums = lambda t, name: t.groupBy("region").agg(F.sum("value").alias(name))
    kept = capped(own, most, weight="value") if most else own
    return kept.join(sums(own, "total_mass"), "region").join(sums(kept, "_kept"), "region").select("region", "lat", "lon", (F.col("value") / F.col("_kept")).alias("weight"), "total_mass")


def systematic_sample(table: DataFrame, order: tuple[str, ...], most: int) -> DataFrame:
    """Every n-th row in an order, n so that about ``most`` stay, and no more than that."""
    if most < 1:
        raise ValueError("most must be positive")
    step = max(1, table.count() // most)
    return running(table, [F.col(c) for c in order]).where((F.col("_rank") % step == 0) & (F.col("_rank") < step * most)).drop("_rank", "_before", "_count", "_total")


def wrapped_longitude(lon: Column) -> Column:
    return F.pmod(lon + 180, F.lit(360.0)) - 180


def sensor_of(year: Column) -> Column:
    return F.when(year <= 2013, "calDMSP").otherwise("simVIIRS")
