"""Declared schemas of the inputs; nothing is inferred."""

from pyspark.sql.types import DoubleType, IntegerType, LongType, StringType, StructField, StructType

_TYPES = {"INT": IntegerType(), "LONG": LongType(), "STRING": StringType(), "DOUBLE": DoubleType()}


def _schema(ddl: str) -> StructType:
    """``name TYPE, ...`` without a session, so that the module can be imported before one."""
    return StructType([StructField(n, _TYPES[t]) for n, t in (x.split() for x in ddl.split(", "))])


FLOWS = _schema("t INT, i INT, j INT, k STRING, v STRING, q STRING")
COVARIATES = _schema("year INT, iso3_o STRING, iso3_d STRING, iso3num_o INT, iso3num_d INT, gdp_o DOUBLE, gdp_d DOUBLE, pop_o DOUBLE, pop_d DOUBLE, dist DOUBLE, distcap DOUBLE, distw_arithmetic DOUBLE, distw_harmonic DOUBLE, contig INT, comlang_off INT, comlang_ethno INT, col_dep_ever INT, gatt_o INT, gatt_d INT, rta INT")
CENTRALITY = _schema("iso3 STRING, year INT, centrality_norm DOUBLE")
PORTS = _schema("id LONG, country STRING, latitude DOUBLE, longitude DOUBLE")
AIRPORTS = _schema("airport_id INT, name STRING, city STRING, country STRING, iata STRING, icao STRING, lat DOUBLE, lon DOUBLE, altitude DOUBLE, timezone STRING, dst STRING, tz STRING, type STRING, source STRING")
ROUTES = _schema("src_airport_id INT, dst_airport_id INT")
INDUSTRY = _schema("exporter_iso3 STRING, importer_iso3 STRING, year INT, industry_id INT, industry_descr STRING, trade DOUBLE")
SEA = _schema("iso1 STRING, iso2 STRING, seadistance DOUBLE")
CELLS = _schema("layer STRING, row INT, col INT, value DOUBLE")
ATOMS = _schema("region STRING, lat DOUBLE, lon DOUBLE, weight DOUBLE")
AGGLOMERATIONS = _schema("iso3 STRING, agglom_id INT, lon DOUBLE, lat DOUBLE, pop DOUBLE, viirs_radiance DOUBLE, coverage_share DOUBLE, year INT")
EDGES = _schema("src LONG, dst LONG, mode STRING, length_km DOUBLE, hours DOUBLE, flags INT")
