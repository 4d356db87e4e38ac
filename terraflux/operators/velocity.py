"""Movement of weighted centroids over years. Positive projections approach the partner."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.constants import KM_PER_DEGREE
from ..functions.geo import haversine_km
from .atoms import masked
from .measures import spherical_centroid


def centroid_series(atoms: DataFrame) -> DataFrame:
    """``region, year, centroid_lat, centroid_lon, v_lat_deg, v_lon_deg, total_mass, n_atoms``.

    Differences are to the row before in year order, over a gap of years too.
    """
    w = Window.partitionBy("region").orderBy("year")
    c = spherical_centroid(atoms, ("region", "year"))
    step = lambda x: F.col(x) - F.lag(x).over(w)
    return c.withColumn("v_lat_deg", step("centroid_lat")).withColumn("v_lon_deg", step("centroid_lon"))


def raster_series(cells: DataFrame, members: DataFrame, affine: tuple, k: int = 5, nodata: float | None = None) -> DataFrame:
    """``centroid_series`` of yearly rasters: cells ``year, row, col, value`` masked by ``members(region, row, col)``, blocks of k summed and weighted by value and area.

    All years and regions are one plan; a region without a cell above zero in a year has no row for it.
    """
    own = masked(cells, members, affine, k=k, nodata=nodata, keys=("year",))
    return centroid_series(own.select("region", "year", "lat", "lon", (F.col("value") * F.col("area_km2")).alias("weight")))


def projection(series: DataFrame) -> DataFrame:
    """Velocity of ``o`` toward ``d``, from the positions a year before (a gap drops the row).

    ``o, d, year, v_proj_deg, v_proj_km, gc_dist_km_lag1``. The direction is the flat unit
    vector in degrees; kilometres scale longitude at the lagged middle latitude.
    """
    now = series.select("region", "year", F.col("centroid_lat").alias("lat1"), F.col("centroid_lon").alias("lon1"))
    old = series.select("region", (F.col("year") + 1).alias("year"), F.col("centroid_lat").alias("lat0"), F.col("centroid_lon").alias("lon0"))
    moved = now.join(old, ["region", "year"]).where("lat0 is not null and lon0 is not null and lat1 is not null and lon1 is not null")
    side = lambda s: moved.select("year", F.col("region").alias(s), *[F.col(c).alias(f"{c}_{s}") for c in ("lat0", "lon0", "lat1", "lon1")])
    met = side("o").join(side("d"), "year").where("o <> d")
    dy, dx = F.col("lat0_d") - F.col("lat0_o"), F.col("lon0_d") - F.col("lon0_o")
    norm = F.sqrt(dx * dx + dy * dy)
    ux, uy = dx / norm, dy / norm
    ry = (F.col("lat1_o") - F.col("lat0_o")) - (F.col("lat1_d") - F.col("lat0_d"))
    rx = (F.col("lon1_o") - F.col("lon0_o")) - (F.col("lon1_d") - F.col("lon0_d"))
    shrink = F.cos(F.radians((F.col("lat0_o") + F.col("lat0_d")) / 2))
    return met.where(norm >= 1e-9).select("o", "d", "year", (rx * ux + ry * uy).alias("v_proj_deg"), ((rx * shrink * ux + ry * uy) * KM_PER_DEGREE).alias("v_proj_km"), haversine_km("lat0_o", "lon0_o", "lat0_d", "lon0_d").alias("gc_dist_km_lag1"))


def attach(panel: DataFrame, velocity: DataFrame) -> DataFrame:
    """The panel (``o, d, year``) with velocities where they are known."""
    return panel.join(velocity, ["o", "d", "year"], "left")
