"""SQL for the oracle: the fixtures as common table expressions, and distance formulas."""

from __future__ import annotations


def km(lat1: str, lon1: str, lat2: str, lon2: str) -> str:
    return f"(2*6371.0E0*asin(least(1.0E0, sqrt(pow(sin(radians({lat2}-({lat1}))/2),2) + cos(radians({lat1}))*cos(radians({lat2}))*pow(sin(radians({lon2}-({lon1}))/2),2)))))"


def centroid(source: str, keys: str = "region", weight: str = "weight") -> str:
    """Select list and grouping of the spherical centroid."""
    return f"""SELECT {keys}, degrees(atan2(z, sqrt(x*x+y*y))) AS lat, degrees(atan2(y, x)) AS lon, mass, n FROM (
      SELECT {keys}, sum({weight}*cos(radians(lat))*cos(radians(lon))) AS x, sum({weight}*cos(radians(lat))*sin(radians(lon))) AS y,
        sum({weight}*sin(radians(lat))) AS z, sum({weight}) AS mass, count(*) AS n FROM {source} GROUP BY {keys})"""


NATIONS = """nations AS (SELECT n_nationkey AS region, n_regionkey AS bloc, CAST(CAST(n_nationkey AS BIGINT)*37%111 - 50 AS DOUBLE) AS lat,
  CAST(CAST(n_nationkey AS BIGINT)*89%301 - 150 AS DOUBLE) AS lon, (CAST(n_nationkey AS BIGINT)*7919%9000 + 50)*1000.0E0 AS area FROM nation)"""
CONSUMPTION = """consumption AS (SELECT n.region, c_custkey AS atom, n.lat + ((c_custkey*17%400)/100.0E0 - 2) AS lat, n.lon + ((c_custkey*29%400)/100.0E0 - 2) AS lon, c_acctbal AS weight
  FROM customer JOIN nations n ON c_nationkey = n.region WHERE c_acctbal > 0)"""
PRODUCTION = """production AS (SELECT n.region, s_suppkey AS atom, n.lat + ((s_suppkey*17%400)/100.0E0 - 2) AS lat, n.lon + ((s_suppkey*29%400)/100.0E0 - 2) AS lon, s_acctbal AS weight
  FROM supplier JOIN nations n ON s_nationkey = n.region WHERE s_acctbal > 0)"""
SHIPMENTS = """shipments AS (SELECT s_nationkey AS o, c_nationkey AS d, CAST(year(o_orderdate) AS INTEGER) AS t, l_partkey, l_extendedprice*(1-l_discount) AS x
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey)"""
FLOWS = SHIPMENTS + ", flows AS (SELECT o, d, t, sum(x) AS x FROM shipments GROUP BY o, d, t)"
GDP = "gdp AS (SELECT c_nationkey AS region, CAST(year(o_orderdate) AS INTEGER) AS t, sum(o_totalprice) AS gdp FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2)"
COVARIATES = f"""covariates AS (SELECT g.t AS year, a.region AS iso3_o, b.region AS iso3_d, g.gdp AS gdp_o, h.gdp AS gdp_d,
  CASE WHEN a.region = b.region THEN 0.67E0*sqrt(a.area/pi()) ELSE {km("a.lat", "a.lon", "b.lat", "b.lon")} END AS dist,
  CASE WHEN a.bloc = b.bloc AND a.region <> b.region THEN 1 ELSE 0 END AS contig
  FROM nations a, nations b, gdp g, gdp h WHERE g.region = a.region AND h.region = b.region AND g.t = h.t)"""
PANEL = f"""{NATIONS}, {FLOWS}, {GDP}, {COVARIATES},
exports AS (SELECT o, t, sum(x) AS exports FROM flows GROUP BY o, t),
panel AS (
  SELECT c.year, c.iso3_o, c.iso3_d, coalesce(f.x, 0) AS X_ij_usd, 0 AS home, c.dist, c.gdp_o, c.gdp_d, c.contig
  FROM covariates c LEFT JOIN flows f ON f.o = c.iso3_o AND f.d = c.iso3_d AND f.t = c.year WHERE c.iso3_o <> c.iso3_d
  UNION ALL
  SELECT g.t, g.region, g.region, greatest(0.0E0, g.gdp - coalesce(e.exports, 0)), 1, 0.67E0*sqrt(n.area/pi()), g.gdp, g.gdp, 0
  FROM gdp g JOIN nations n ON n.region = g.region LEFT JOIN exports e ON e.o = g.region AND e.t = g.t WHERE g.gdp > 0)"""
AGGLOMERATIONS = f"""{NATIONS}, {CONSUMPTION}, agg AS (SELECT region AS iso3, lat, lon, weight AS pop, weight*0.5E0 + atom%7 AS viirs, year FROM (
  SELECT *, row_number() OVER w AS rn, coalesce(sum(weight) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, sum(weight) OVER (PARTITION BY region) AS tot FROM consumption
  WINDOW w AS (PARTITION BY region ORDER BY weight DESC, atom)) x, (VALUES (2020), (2021)) y(year) WHERE rn <= 50 AND (rn = 1 OR before/tot < 0.8E0))"""
YEARLY = f"""{NATIONS}, {CONSUMPTION}, yearly AS (SELECT c.region, o.year, c.lat, c.lon, o.weight FROM consumption c JOIN (
  SELECT o_custkey, CAST(year(o_orderdate) AS INTEGER) AS year, sum(o_totalprice) AS weight FROM orders GROUP BY 1, 2) o ON o.o_custkey = c.atom)"""
CELLS = f"""{NATIONS}, {CONSUMPTION}, cells AS (SELECT region, r AS row, c AS col, (r + 0.5E0)*0.25E0 - 90 AS lat, (c + 0.5E0)*0.25E0 - 180 AS lon, value,
  abs(0.25E0*111.32E0*cos(radians((r + 0.5E0)*0.25E0 - 90))*0.25E0*111.32E0) AS area FROM (
  SELECT region, CAST(floor((lat + 90)/0.25E0) AS INTEGER) AS r, CAST(floor((lon + 180)/0.25E0) AS INTEGER) AS c, sum(weight) AS value FROM consumption GROUP BY 1, 2, 3))"""


def border_edges(border: tuple, hole: tuple) -> str:
    """Edges of the borders relative to their nation's place: ``region, hole, x1, y1, x2, y2``."""
    sides = [(ring, a, b) for ring, points in enumerate((border, hole)) for a, b in zip(points, points[1:] + points[:1], strict=True)]
    values = ", ".join(f"({ring}, {a[0]}E0, {a[1]}E0, {b[0]}E0, {b[1]}E0)" for ring, a, b in sides)
    return f"edges AS (SELECT region, lat, lon, hole, x1*s AS x1, y1*s AS y1, x2*s AS x2, y2*s AS y2 FROM (SELECT *, 0.6E0 + (region % 5)*0.2E0 AS s FROM nations), (VALUES {values}) v(hole, x1, y1, x2, y2))"


MEETINGS = f"""{NATIONS}, {CONSUMPTION}, {PRODUCTION}, met AS (SELECT p.region AS o, c.region AS d, p.weight*c.weight AS w, greatest(0.5E0, {km("p.lat", "p.lon", "c.lat", "c.lon")}) AS km FROM production p, consumption c)"""


def effective(theta: str, alias: str = "d_eff") -> str:
    """The power mean of MEETINGS' distances, relative to the least one for stability."""
    return f"SELECT o, d, round(min(m)*pow(sum(w*pow(km/m, {theta}))/sum(w), 1/({theta})), 4) AS {alias} FROM (SELECT *, min(km) OVER (PARTITION BY o, d) AS m FROM met) GROUP BY o, d"
