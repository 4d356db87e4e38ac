"""Polygons as edge tables: point in polygon, region masks, areas.

Polygons are vertices ``region, ring, hole, seq, lon, lat`` in degrees; a ring closes by
itself. Inside is even-odd over all rings of a region, so holes and islands need no order.
An edge takes the short way round: one that jumps by over 180 degrees crosses the
antimeridian and is cut there, and a ring that goes once around the globe holds the nearer pole.

A point is inside where an odd number of edges lies north of it. Edges are dealt to
strips of longitude and points look only at their own strip, an equality join that
adaptive execution splits where a strip is crowded; what comes out of it is summed on the
map side. Strips are made so narrow that an edge table has about ``PER_STRIP`` of them.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geo import cell_centre

#: Edges of an average strip, and strips at most and least.
PER_STRIP, MOST_STRIPS, LEAST_STRIPS = 8, 1 << 18, 360
#: Radius (km) of the sphere that equal-area maps of the world are drawn on.
EQUAL_AREA_KM = 6378.137


def _folded(lon: Column) -> Column:
    return F.pmod(lon + 180, F.lit(360.0)) - 180


def edges(vertices: DataFrame) -> DataFrame:
    """``region, ring, hole, x1, y1, x2, y2`` with unbroken longitudes, and the pole's edge of a ring around it.

    Rings of fewer than three vertices have no edges; null coordinates are left out.
    """
    ring = Window.partitionBy("region", "ring")
    known = vertices.where("lon is not null and lat is not null").select("region", "ring", F.coalesce(F.col("hole"), F.lit(False)).alias("hole"), "seq", _folded(F.col("lon")).alias("x"), F.col("lat").cast("double").alias("y"))
    order = ring.orderBy("seq")
    nxt = lambda c: F.coalesce(F.lead(c).over(order), F.first(c).over(order))
    steps = known.withColumns({"n": F.count("*").over(ring), "to": nxt("x"), "y2": nxt("y")}).where("n >= 3")
    steps = steps.withColumn("step", _folded(F.col("to") - F.col("x")))
    start = F.first("x").over(order) + F.coalesce(F.sum("step").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    own = steps.withColumn("x1", start).select("region", "ring", "hole", "x1", F.col("y").alias("y1"), (F.col("x1") + F.col("step")).alias("x2"), "y2", "step")
    turns = own.groupBy("region", "ring", "hole").agg(F.round(F.sum("step") / 360).alias("turns"), F.avg("y1").alias("y")).where("turns <> 0")
    half = F.explode(F.array(F.lit(-180.0), F.lit(0.0))).alias("x1")  # half the globe each, as an edge may not go round it
    pole = F.when(F.col("y") >= 0, 90.0).otherwise(-90.0)
    poles = turns.select("region", "ring", "hole", half, pole.alias("y"), "turns").select("region", "ring", "hole", (-F.col("turns") * F.col("x1")).alias("x1"), F.col("y").alias("y1"), (-F.col("turns") * (F.col("x1") + 180)).alias("x2"), F.col("y").alias("y2"))
    return own.drop("step").unionByName(poles)


def _segments(table: DataFrame) -> DataFrame:
    """Edges from west to east inside [-180, 180), as ``region, lo, hi, slope, level`` (the latitude at longitude x is level + slope x)."""
    east = F.greatest("x1", "x2")
    base = F.floor((F.least("x1", "x2") + 180) / 360) * 360
    slope = (F.col("y2") - F.col("y1")) / (F.col("x2") - F.col("x1"))
    flat = table.where("x1 <> x2").select("region", (F.least("x1", "x2") - base).alias("lo"), (east - base).alias("hi"), slope.alias("slope"), (F.col("y1") - slope * (F.col("x1") - base)).alias("level"))
    over = flat.where("hi > 180").select("region", F.lit(-180.0).alias("lo"), (F.col("hi") - 360).alias("hi"), "slope", (F.col("level") + F.col("slope") * 360).alias("level"))
    return flat.withColumn("hi", F.least("hi", F.lit(180.0))).unionByName(over)


def containing(points: DataFrame, vertices: DataFrame, strips: int | None = None) -> DataFrame:
    """``points`` with each ``region`` they lie in; points in none have no row.

    ``points`` has ``lon, lat`` and any other columns but ``region``; rows that repeat are
    kept. A point on an edge belongs to one side of it. Null or infinite coordinates are in no region.
    """
    own = F.struct(*[F.col(f"`{c}`") for c in points.columns])
    segments = _segments(edges(vertices))
    if strips is None:
        strips = min(MOST_STRIPS, max(LEAST_STRIPS, segments.count() // PER_STRIP))
    strip = lambda x: F.floor((x + 180) * (strips / 360.0)).cast("int")
    dealt = segments.withColumn("strip", F.explode(F.sequence(strip(F.col("lo")), strip(F.col("hi")))))
    finite = points.where("lon is not null and lat is not null and abs(lon) < double('infinity') and abs(lat) < double('infinity')")
    at = finite.select(own.alias("point"), _folded(F.col("lon").cast("double")).alias("x"), F.col("lat").cast("double").alias("y")).groupBy("x", "y").agg(F.count("*").alias("copies")).withColumn("strip", strip(F.col("x")))
    met = at.join(dealt, "strip").where((F.col("lo") <= F.col("x")) & (F.col("x") < F.col("hi")) & (F.col("level") + F.col("slope") * F.col("x") > F.col("y")))
    inside = met.groupBy("x", "y", "region").agg(F.count("*").alias("above")).where("above % 2 = 1").select("x", "y", "region")
    rows = finite.select(own.alias("point"), _folded(F.col("lon").cast("double")).alias("x"), F.col("lat").cast("double").alias("y"))
    return rows.join(inside, ["x", "y"]).select("point.*", "region")


def members(cells: DataFrame, affine: tuple, vertices: DataFrame) -> DataFrame:
    """``region, row, col`` of the cells whose centres lie in a region: what ``atoms.masked`` asks for."""
    lon, lat = cell_centre("row", "col", affine)
    centres = cells.select("row", "col").distinct().withColumns({"lon": lon, "lat": lat})
    return containing(centres, vertices).select("region", "row", "col")


def areas(vertices: DataFrame, radius_km: float = EQUAL_AREA_KM) -> DataFrame:
    """``region, area_km2`` on the sphere, holes taken away; edges are straight in longitude and latitude.

    The area under an edge is the integral of the sine of its latitude over longitude, which has a closed form.
    """
    a, b = F.radians("y1"), F.radians("y2")
    mean = F.when(F.abs(b - a) < 1e-9, F.sin((a + b) / 2)).otherwise((F.cos(a) - F.cos(b)) / (b - a))
    rings = edges(vertices).groupBy("region", "ring", "hole").agg(F.abs(F.sum(F.radians(F.col("x2") - F.col("x1")) * mean)).alias("area"))
    signed = F.when(F.col("hole"), -F.col("area")).otherwise(F.col("area"))
    return rings.groupBy("region").agg((F.sum(signed) * radius_km * radius_km).alias("area_km2"))


def globe_area(radius_km: float = EQUAL_AREA_KM) -> float:
    return 4 * math.pi * radius_km * radius_km
