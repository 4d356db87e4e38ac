"""The star-schema tables read as regions, atoms, flows and panels.

Places and areas are integer arithmetic on keys, so any engine computes the same.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def nations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``region, bloc, lat, lon, area_km2`` (a nation is a region, its region a bloc)."""
    k = F.col("n_nationkey").cast("long")
    return table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("region"), F.col("n_regionkey").alias("bloc"), (k * 37 % 111 - 50).cast("double").alias("lat"), (k * 89 % 301 - 150).cast("double").alias("lon"), ((k * 7919 % 9000 + 50) * 1000.0).alias("area_km2"))


def _atoms(spark: SparkSession, sf_dir: str, name: str, key: str, nation: str, weight: str) -> DataFrame:
    k = F.col(key)
    own = table(spark, sf_dir, name).select(k.alias("atom"), F.col(nation).alias("region"), (k * 17 % 400 / 100.0 - 2).alias("dy"), (k * 29 % 400 / 100.0 - 2).alias("dx"), F.col(weight).alias("weight"))
    places = nations(spark, sf_dir).select("region", F.col("lat").alias("y"), F.col("lon").alias("x"))
    return own.join(places, "region").select("region", "atom", (F.col("y") + F.col("dy")).alias("lat"), (F.col("x") + F.col("dx")).alias("lon"), "weight")


def consumption(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _atoms(spark, sf_dir, "customer", "c_custkey", "c_nationkey", "c_acctbal").where("weight > 0")


def production(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _atoms(spark, sf_dir, "supplier", "s_suppkey", "s_nationkey", "s_acctbal").where("weight > 0")


def shipments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a line: ``o, d, t, k, x``."""
    line = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey", "l_partkey", (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("x"))
    order = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey", F.year("o_orderdate").alias("t"))
    customer = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("d"))
    supplier = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").alias("o"))
    return line.join(order, "l_orderkey").join(customer, "o_custkey").join(supplier, "l_suppkey").select("o", "d", "t", "l_partkey", "x")


def flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shipments(spark, sf_dir).groupBy("o", "d", "t").agg(F.sum("x").alias("x"))


def gdp(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``region, t, gdp``: what a nation's customers order in a year."""
    order = table(spark, sf_dir, "orders").select("o_custkey", F.year("o_orderdate").alias("t"), "o_totalprice")
    customer = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("region"))
    return order.join(customer, "o_custkey").groupBy("region", "t").agg(F.sum("o_totalprice").alias("gdp"))


def covariates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ordered pairs of nations in each year, with distances and gdp."""
    from ..functions.geo import haversine_km, head_mayer

    n = nations(spark, sf_dir).withColumn("_all", F.lit(1))
    side = lambda s: n.select("_all", F.col("region").alias(f"iso3_{s}"), F.col("bloc").alias(f"bloc_{s}"), F.col("lat").alias(f"lat_{s}"), F.col("lon").alias(f"lon_{s}"), F.col("area_km2").alias(f"area_{s}"))
    years = gdp(spark, sf_dir).select(F.col("region").alias("iso3_o"), F.col("t").alias("year"), F.col("gdp").alias("gdp_o"))
    partner = gdp(spark, sf_dir).select(F.col("region").alias("iso3_d"), F.col("t").alias("year"), F.col("gdp").alias("gdp_d"))
    pairs = side("o").join(side("d"), "_all").join(years, "iso3_o").join(partner, ["iso3_d", "year"])
    d = F.when(F.col("iso3_o") == F.col("iso3_d"), head_mayer("area_o")).otherwise(haversine_km("lat_o", "lon_o", "lat_d", "lon_d"))
    return pairs.select("year", "iso3_o", "iso3_d", "gdp_o", "gdp_d", d.alias("distw_harmonic"), ((F.col("bloc_o") == F.col("bloc_d")) & (F.col("iso3_o") != F.col("iso3_d"))).cast("int").alias("contig"))


def named_flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flows(spark, sf_dir).select(F.col("o").alias("iso3_o"), F.col("d").alias("iso3_d"), F.col("t").alias("year"), F.col("x").alias("X_ij_usd"))


def cells(spark: SparkSession, sf_dir: str, degrees: float = 0.25) -> DataFrame:
    """Population cells: consumption atoms on a grid, ``region, row, col, lat, lon, value, area_km2``."""
    from ..functions.geo import cell_area_km2

    c = consumption(spark, sf_dir)
    grid = c.groupBy("region", F.floor((F.col("lat") + 90) / degrees).cast("int").alias("row"), F.floor((F.col("lon") + 180) / degrees).cast("int").alias("col")).agg(F.sum("weight").alias("value"))
    at = grid.withColumns({"lat": (F.col("row") + 0.5) * degrees - 90, "lon": (F.col("col") + 0.5) * degrees - 180})
    return at.withColumn("area_km2", cell_area_km2("lat", degrees))


#: Corners of a border and of the hole in it, in degrees from a nation's place.
BORDER = ((-1.7, -1.3), (1.9, -1.6), (1.2, 1.8), (-1.5, 1.1))
HOLE = ((-0.4, -0.5), (0.6, -0.3), (0.1, 0.7))


def borders(spark: SparkSession, sf_dir: str, shift: float = 45.0) -> DataFrame:
    """A border with a hole around each nation, moved east so that some cross the antimeridian: ``region, ring, hole, seq, lon, lat``."""
    corner = lambda ring, k, at: F.struct(F.lit(ring).alias("ring"), F.lit(ring == 1).alias("hole"), F.lit(k).alias("seq"), F.lit(at[0]).alias("dx"), F.lit(at[1]).alias("dy"))
    corners = F.explode(F.array(*[corner(ring, k, at) for ring, points in enumerate((BORDER, HOLE)) for k, at in enumerate(points)])).alias("c")
    size = 0.6 + (F.col("region") % 5) * 0.2
    own = nations(spark, sf_dir).select("region", "lat", "lon", size.alias("size"), corners)
    east = F.pmod(F.col("lon") + F.col("c.dx") * F.col("size") + (shift + 180), F.lit(360.0)) - 180
    return own.select("region", "c.ring", "c.hole", "c.seq", east.alias("lon"), (F.col("lat") + F.col("c.dy") * F.col("size")).alias("lat"))


def yearly_atoms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Consumption atoms weighted by the year's orders: ``region, year, lat, lon, weight``."""
    order = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("atom"), F.year("o_orderdate").alias("year")).agg(F.sum("o_totalprice").alias("weight"))
    return consumption(spark, sf_dir).drop("weight").join(order, "atom")


def hubs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations as ports and airports: ``id, country, lat, lon, iata, type``."""
    n = nations(spark, sf_dir)
    return n.select(F.col("region").cast("long").alias("id"), F.col("bloc").cast("string").alias("country"), "lat", "lon", F.lpad(F.col("region").cast("string"), 3, "A").alias("iata"), F.when(F.col("region") % 2 == 0, "airport").alias("type"))


def agglomerations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best customers that cover each nation, by the coverage cut, for two years."""
    from ..operators.components import coverage_cut

    top = coverage_cut(consumption(spark, sf_dir), key="atom").select(F.col("region").alias("iso3"), "lat", "lon", F.col("weight").alias("pop"), (F.col("weight") * F.lit(0.5) + F.col("atom") % 7).alias("viirs_radiance"))
    return top.withColumn("year", F.explode(F.array(F.lit(2020), F.lit(2021))))


def roads(spark: SparkSession, sf_dir: str, degrees: float = 0.5) -> DataFrame:
    """Roads between cells of people that touch by a side or a corner, both ways: ``src, dst, length_km``; a cell's id is 100000 row + col."""
    from ..functions.geo import haversine_km

    grid = cells(spark, sf_dir, degrees).select("row", "col", "lat", "lon").distinct()
    name = lambda r, c: F.col(r).cast("long") * 100000 + F.col(c)
    steps = F.explode(F.array(*[F.struct(F.lit(r).alias("r"), F.lit(c).alias("c")) for r in (-1, 0, 1) for c in (-1, 0, 1) if r or c])).alias("s")
    there = grid.select("row", "col", F.col("lat").alias("lat1"), F.col("lon").alias("lon1"), steps).withColumns({"r": F.col("row") + F.col("s.r"), "c": F.col("col") + F.col("s.c")})
    met = there.join(grid.select(F.col("row").alias("r"), F.col("col").alias("c"), F.col("lat").alias("lat2"), F.col("lon").alias("lon2")), ["r", "c"])
    return met.select(name("row", "col").alias("src"), name("r", "c").alias("dst"), haversine_km("lat1", "lon1", "lat2", "lon2").alias("length_km"))
