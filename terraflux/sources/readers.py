"""Readers of flows, covariates, places, rasters and cached tables, all by Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..operators.panel import COVARIATES, aggregate_flows, crosswalk, with_names
from . import schemas


def csv(spark: SparkSession, path: str, schema: StructType | None = None, header: bool = True, null: str = "") -> DataFrame:
    """A CSV under a declared schema: its columns by name (present ones only), NaN as null."""
    reader = spark.read.option("header", header).option("nullValue", null)
    if schema is None or not header:
        raw = (reader.schema(schema) if schema else reader).csv(path)
    else:
        raw = reader.csv(path)
        raw = raw.select(*[F.expr(f"try_cast(`{f.name}` AS {f.dataType.simpleString()})").alias(f.name) for f in schema if f.name in raw.columns])
    return raw.select(*[F.when(~F.isnan(c), F.col(c)).alias(c) if t == "double" else F.col(c) for c, t in raw.dtypes])


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path (or glob) is there, on any file system Spark knows."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    found = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(p)
    return bool(found)


def flows(spark: SparkSession, folder: str, year: int | None = None, aggregation: str = "raw") -> DataFrame:
    """Bilateral flows of one year or of all, in the source's thousands."""
    path = f"{folder}/*Y{year if year else '*'}*.csv"
    if not exists(spark, path):
        raise FileNotFoundError(path)
    raw = csv(spark, path, schemas.FLOWS)
    raw = raw.withColumns({"v": F.expr("try_cast(v AS DOUBLE)"), "q": F.expr("try_cast(q AS DOUBLE)")})
    return aggregate_flows(raw, aggregation)


def covariates(spark: SparkSession, path: str, years: list[int] | None = None, gdp_scale: float = 1.0) -> DataFrame:
    """Pair covariates, with ``distw`` as an alias of the harmonic distance where it is missing."""
    c = csv(spark, path, schemas.COVARIATES)
    c = c.select(*[x for x in COVARIATES if x in c.columns])
    if years:
        c = c.where(F.col("year").isin(years))
    if "distw" not in c.columns and "distw_harmonic" in c.columns:
        c = c.withColumn("distw", F.col("distw_harmonic"))
    return c.withColumns({g: F.col(g) * gdp_scale for g in ("gdp_o", "gdp_d") if g in c.columns})


def named_flows(spark: SparkSession, folder: str, covariate_path: str, year: int | None = None, aggregation: str = "raw") -> DataFrame:
    """Flows with country names; unknown codes keep null names."""
    return with_names(flows(spark, folder, year, aggregation), crosswalk(covariates(spark, covariate_path)), drop_unknown=False)


def centrality(spark: SparkSession, path: str) -> DataFrame:
    return csv(spark, path, schemas.CENTRALITY)


def ports(spark: SparkSession, path: str) -> DataFrame:
    return csv(spark, path, schemas.PORTS).withColumnsRenamed({"latitude": "lat", "longitude": "lon"})


def airports(spark: SparkSession, path: str) -> DataFrame:
    """The header-less list, with its null mark."""
    return csv(spark, path, schemas.AIRPORTS, header=False, null="\\N").withColumn("id", F.col("airport_id").cast("long"))


def sea_distances(spark: SparkSession, path: str) -> DataFrame:
    return csv(spark, path, schemas.SEA)


def industry(spark: SparkSession, path: str, industry_id: int, first_year: int, last_year: int) -> DataFrame:
    return csv(spark, path, schemas.INDUSTRY).where((F.col("industry_id") == industry_id) & F.col("year").between(first_year, last_year))


def cells(spark: SparkSession, path: str, layer: str | None = None, box: tuple[int, int, int, int] | None = None) -> DataFrame:
    """Raster cells as a table partitioned by layer; a box of rows and columns is pushed to the scan."""
    c = spark.read.schema(schemas.CELLS).parquet(path)
    if layer:
        c = c.where(F.col("layer") == layer)
    if box:
        c = c.where(F.col("row").between(box[0], box[1]) & F.col("col").between(box[2], box[3]))
    return c


def atoms(spark: SparkSession, path: str, layer: str, region: str) -> DataFrame | None:
    """A cached cloud of (layer, region), or None."""
    at = f"{path}/layer={layer}/region={region}"
    return spark.read.parquet(at) if exists(spark, at) else None


def nightlights_path(spark: SparkSession, folder: str, year: int) -> str:
    """The year's raster: the sensor of that time, else the other."""
    order = ("calDMSP", "simVIIRS") if year <= 2013 else ("simVIIRS", "calDMSP")
    for sensor in order:
        path = f"{folder}/Harmonized_DN_NTL_{year}_{sensor}.tif"
        if exists(spark, path):
            return path
    raise FileNotFoundError(f"no night lights of {year} in {folder}")


def first_existing(spark: SparkSession, *paths: str) -> str:
    for p in paths:
        if exists(spark, p):
            return p
    raise FileNotFoundError(", ".join(paths))


def road_extract_path(folder: str, region: str | None = None) -> str:
    return f"{folder}/{region or 'planet'}-latest.osm.pbf"


#: Longitude, latitude and population in millions of twenty countries.
CENTROIDS = {
    "USA": (-95.71, 37.09, 331.0), "MEX": (-102.55, 23.63, 128.0), "CAN": (-96.80, 56.13, 38.0), "JAM": (-77.30, 18.11, 3.0),
    "DEU": (10.45, 51.17, 83.0), "FRA": (2.21, 46.23, 67.0), "POL": (19.15, 51.92, 38.0), "NGA": (8.67, 9.08, 206.0),
    "ETH": (40.49, 9.15, 115.0), "ZAF": (25.08, -29.00, 59.0), "SAU": (45.08, 23.89, 35.0), "IND": (78.96, 20.59, 1380.0),
    "PAK": (69.35, 30.38, 220.0), "CHN": (104.20, 35.86, 1411.0), "JPN": (138.25, 36.20, 126.0), "VNM": (108.28, 14.06, 97.0),
    "BRA": (-51.93, -14.24, 212.0), "COL": (-74.30, 4.57, 51.0), "AUS": (133.78, -25.27, 26.0), "NZL": (172.50, -41.50, 5.0),
}


def fallback_agglomerations(spark: SparkSession, year: int, names: list[str] | None = None) -> DataFrame:
    """One agglomeration a country where there are no rasters."""
    rows = [(n, 0, lon, lat, 1e6 * people, 0.0, 1.0, year) for n, (lon, lat, people) in CENTROIDS.items() if names is None or n in names]
    return spark.createDataFrame(rows, schemas.AGGLOMERATIONS)
