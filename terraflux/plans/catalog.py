"""One query for each operator over the star-schema fixtures, with SQL where it exists."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions import geo
from ..operators import asymmetry, atoms, components, gravity, hierarchy, measures, panel, polygons, resistance, routing, stats, studies, transport, tree, velocity
from ..sources import cloud_cache, raster
from . import fixtures as X
from . import sql as Q

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(oracle: str | None = None):
    """Registers a query under its function's name."""
    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLE[f.__name__] = oracle
        return f

    return add


def rounded(df: DataFrame, places: int = 4, **own: int) -> DataFrame:
    """Doubles rounded, as sums differ in their last digits by the order of rows."""
    return df.select(*[F.round(c, own.get(c, places)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def _meetings(spark: SparkSession, sf: str) -> DataFrame:
    p, c = X.production(spark, sf), X.consumption(spark, sf)
    return measures.place_pairs(measures.pairs_of(p, c), p, c)


# Distances between clouds


@query(f"WITH {Q.MEETINGS} {Q.effective('-5')}")
def ces_tree(spark, sf):
    """The directional effective distance by a dual tree in place of all pairs of atoms."""
    p, c = X.production(spark, sf), X.consumption(spark, sf)
    return rounded(tree.effective_distance(measures.pairs_of(p, c), p, c))


@query(f"WITH {Q.NATIONS}, {Q.CONSUMPTION}, met AS (SELECT a.region AS o, b.region AS d, a.weight*b.weight AS w, greatest(0.5E0, {Q.km('a.lat', 'a.lon', 'b.lat', 'b.lon')}) AS km FROM consumption a JOIN consumption b ON a.region = b.region) SELECT o AS region, d_eff FROM ({Q.effective('-1')})")
def internal_tree(spark, sf):
    """Each nation's harmonic distance to itself by a dual tree."""
    c = X.consumption(spark, sf)
    own = c.select(F.col("region").alias("o"), F.col("region").alias("d")).distinct()
    return rounded(tree.effective_distance(own, c, c, theta=-1.0).select(F.col("o").alias("region"), "d_eff"))


@query(f"WITH {Q.MEETINGS} {Q.effective('-5')}")
def ces_directional(spark, sf):
    return rounded(asymmetry.directional_matrix(X.production(spark, sf), X.consumption(spark, sf), shared=False))


@query(f"WITH {Q.MEETINGS} " + " UNION ALL ".join(f"SELECT o, d, CAST({t} AS DOUBLE) AS theta, d_eff FROM ({Q.effective(str(t))})" for t in (-5, -1, 1)))
def ces_theta_sweep(spark, sf):
    return rounded(measures.theta_sweep(_meetings(spark, sf), (-5.0, -1.0, 1.0)))


@query(f"WITH {Q.MEETINGS} SELECT o, d, round(exp(sum(w*ln(km))/sum(w)), 4) AS d_eff FROM met GROUP BY o, d")
def ces_geometric_limit(spark, sf):
    return rounded(measures.effective_distance(_meetings(spark, sf), theta=0.0))


def _ovdl(weight: str) -> str:
    return f"""WITH {Q.AGGLOMERATIONS}, s AS (SELECT *, {weight}/sum({weight}) OVER (PARTITION BY iso3, year) AS w FROM agg)
    SELECT a.iso3 AS iso_o, b.iso3 AS iso_d, a.year AS year, round(1/sum(a.w*b.w/greatest(0.5E0, {Q.km("a.lat", "a.lon", "b.lat", "b.lon")})), 4) AS d_ovdl
    FROM s a JOIN s b ON a.year = b.year AND a.iso3 <> b.iso3 GROUP BY 1, 2, 3"""


@query(_ovdl("pop"))
def ovdl_pop(spark, sf):
    return rounded(measures.overland(X.agglomerations(spark, sf)))


@query(_ovdl("viirs"))
def ovdl_viirs(spark, sf):
    return rounded(measures.overland(X.agglomerations(spark, sf), use_lights=True))


@query(f"WITH {Q.NATIONS} SELECT a.region AS o, b.region AS d, round({Q.km('a.lat', 'a.lon', 'b.lat', 'b.lon')}, 4) AS m1 FROM nations a, nations b")
def capital_distance_m1(spark, sf):
    n = X.nations(spark, sf)
    return rounded(measures.m1_capital(n, measures.pairs_of(n, n)))


def _centroid_pair(a: str, b: str, name: str, weight: str) -> str:
    return f"""WITH {Q.NATIONS}, {Q.CONSUMPTION}, {Q.PRODUCTION}, a AS ({Q.centroid(a, weight=weight)}), b AS ({Q.centroid(b, weight=weight)})
    SELECT a.region AS o, b.region AS d, round({Q.km("a.lat", "a.lon", "b.lat", "b.lon")}, 4) AS {name} FROM a, b"""


@query(_centroid_pair("production", "consumption", "m2", "1.0E0"))
def unweighted_centroid_m2(spark, sf):
    p, c = X.production(spark, sf), X.consumption(spark, sf)
    return rounded(measures.m2_unweighted_centroid(p, c, measures.pairs_of(p, c)))


@query(_centroid_pair("consumption", "consumption", "m3", "weight"))
def weighted_centroid_m3(spark, sf):
    c = X.consumption(spark, sf)
    return rounded(measures.m3_weighted_centroid(c, c, measures.pairs_of(c, c)))


@query(_centroid_pair("production", "consumption", "m5", "weight"))
def directional_centroid_m5(spark, sf):
    p, c = X.production(spark, sf), X.consumption(spark, sf)
    return rounded(measures.m5_directional_centroid(p, c, measures.pairs_of(p, c)))


@query(f"WITH {Q.MEETINGS}, m AS ({Q.effective('-5')}) SELECT a.o, a.d, round(a.d_eff, 4) AS d_od, round(b.d_eff, 4) AS d_do, round(ln(a.d_eff/b.d_eff), 6) AS asi, round(abs(ln(a.d_eff/b.d_eff)), 6) AS abs_asi FROM m a JOIN m b ON a.o = b.d AND a.d = b.o AND a.o < a.d")
def asymmetry_index(spark, sf):
    return rounded(asymmetry.asymmetry_index(ces_directional(spark, sf)), 6, d_od=4, d_do=4)


@query(f"""WITH {Q.MEETINGS}, {Q.FLOWS}, m AS ({Q.effective('-5')}), x AS (SELECT o, d, sum(x) AS x FROM flows GROUP BY o, d),
r AS (SELECT ln(a.d_eff/b.d_eff) AS asi, ln(f.x/g.x) AS lr FROM m a JOIN m b ON a.o = b.d AND a.d = b.o AND a.o < a.d JOIN x f ON f.o = a.o AND f.d = a.d JOIN x g ON g.o = a.d AND g.d = a.o WHERE f.x > 0 AND g.x > 0)
SELECT count(*) AS n, round(corr(asi, lr), 6) AS pearson, round(regr_slope(lr, asi), 4) AS slope FROM r""")
def asi_vs_trade(spark, sf):
    x = X.flows(spark, sf).groupBy("o", "d").agg(F.sum("x").alias("x"))
    r = asymmetry.asymmetry_against_trade(asymmetry.asymmetry_index(ces_directional(spark, sf)), x)
    return r.agg(F.count("*").alias("n"), F.round(F.corr("asi", "log_ratio"), 6).alias("pearson"), F.round(F.regr_slope("log_ratio", "asi"), 4).alias("slope"))


@query(f"""WITH {Q.NATIONS}, {Q.CONSUMPTION}, {Q.PRODUCTION}, a AS ({Q.centroid("production")}), b AS ({Q.centroid("consumption")})
SELECT a.region AS region, round(a.lat, 6) AS lat_p, round(a.lon, 6) AS lon_p, round(b.lat, 6) AS lat_c, round(b.lon, 6) AS lon_c, round({Q.km("a.lat", "a.lon", "b.lat", "b.lon")}, 4) AS divergence_km FROM a JOIN b ON a.region = b.region""")
def centroid_divergence(spark, sf):
    return rounded(asymmetry.centroid_divergence(X.production(spark, sf), X.consumption(spark, sf)), 6, divergence_km=4)


_SERIES = f"WITH {Q.YEARLY}, c AS ({Q.centroid('yearly', 'region, year')})"


@query(f"{_SERIES} SELECT region, year, round(lat, 6) AS centroid_lat, round(lon, 6) AS centroid_lon, round(mass, 2) AS total_mass, n AS n_atoms, round(lat - lag(lat) OVER w, 6) AS v_lat_deg, round(lon - lag(lon) OVER w, 6) AS v_lon_deg FROM c WINDOW w AS (PARTITION BY region ORDER BY year)")
def centroid_series(spark, sf):
    return rounded(velocity.centroid_series(X.yearly_atoms(spark, sf)), 6, total_mass=2)


_PROJECTION = f"""{_SERIES}, m AS (SELECT a.region, a.year, b.lat AS y0, b.lon AS x0, a.lat - b.lat AS vy, a.lon - b.lon AS vx FROM c a JOIN c b ON a.region = b.region AND b.year = a.year - 1),
p AS (SELECT a.region AS o, b.region AS d, a.year AS year, a.vy - b.vy AS ry, a.vx - b.vx AS rx, b.y0 - a.y0 AS dy, b.x0 - a.x0 AS dx, sqrt((b.y0-a.y0)*(b.y0-a.y0) + (b.x0-a.x0)*(b.x0-a.x0)) AS nn, cos(radians((a.y0+b.y0)/2)) AS sh, {Q.km("a.y0", "a.x0", "b.y0", "b.x0")} AS gc FROM m a JOIN m b ON a.year = b.year AND a.region <> b.region),
v AS (SELECT o, d, year, (rx*dx + ry*dy)/nn AS v_proj_deg, (rx*sh*dx + ry*dy)/nn*111.32E0 AS v_proj_km, gc AS gc_dist_km_lag1 FROM p WHERE nn >= 1e-9)"""


@query(f"{_PROJECTION} SELECT o, d, year, round(v_proj_deg, 6) AS v_proj_deg, round(v_proj_km, 4) AS v_proj_km, round(gc_dist_km_lag1, 4) AS gc_dist_km_lag1 FROM v")
def velocity_projection(spark, sf):
    return rounded(velocity.projection(velocity.centroid_series(X.yearly_atoms(spark, sf))), 4, v_proj_deg=6)


@query(f"{_PROJECTION}, {Q.FLOWS} SELECT f.o, f.d, f.t AS year, round(f.x, 4) AS x, round(v.v_proj_km, 4) AS v_proj_km FROM flows f LEFT JOIN v ON v.o = f.o AND v.d = f.d AND v.year = f.t")
def attach_velocity(spark, sf):
    v = velocity.projection(velocity.centroid_series(X.yearly_atoms(spark, sf))).select("o", "d", "year", "v_proj_km")
    return rounded(velocity.attach(X.flows(spark, sf).withColumnRenamed("t", "year"), v).select("o", "d", "year", "x", "v_proj_km"))


# Flows and panels


@query(f"WITH {Q.FLOWS} SELECT t, o AS i, d AS j, round(x, 4) AS v FROM flows")
def flow_pair_year(spark, sf):
    s = X.shipments(spark, sf).selectExpr("t", "o AS i", "d AS j", "x AS v")
    return rounded(panel.aggregate_flows(s, "pair-year"))


@query(f"WITH {Q.SHIPMENTS} SELECT t, o AS i, d AS j, substr(p_type, 1, 2) AS hs2, round(sum(x), 4) AS v FROM shipments JOIN part ON l_partkey = p_partkey GROUP BY 1, 2, 3, 4")
def flow_pair_year_hs2(spark, sf):
    part = X.table(spark, sf, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_type").alias("k"))
    s = X.shipments(spark, sf).join(part, "l_partkey").selectExpr("t", "o AS i", "d AS j", "k", "x AS v")
    return rounded(panel.aggregate_flows(s, "pair-year-hs2"))


@query(f"WITH {Q.FLOWS} SELECT f.o AS i, f.d AS j, round(sum(f.x), 4) AS v, a.n_name AS iso3_o, b.n_name AS iso3_d FROM flows f JOIN nation a ON a.n_nationkey = f.o JOIN nation b ON b.n_nationkey = f.d GROUP BY 1, 2, 4, 5")
def crosswalk_join(spark, sf):
    n = X.table(spark, sf, "nation")
    pairs = n.select(F.col("n_nationkey").alias("iso3num_o"), F.col("n_name").alias("iso3_o"), F.col("n_nationkey").alias("iso3num_d"), F.col("n_name").alias("iso3_d"))
    f = X.flows(spark, sf).groupBy(F.col("o").alias("i"), F.col("d").alias("j")).agg(F.sum("x").alias("v"))
    return rounded(panel.with_names(f, panel.crosswalk(pairs)).select("i", "j", "v", "iso3_o", "iso3_d"))


def _panel(spark, sf) -> DataFrame:
    areas = X.nations(spark, sf).select(F.col("region").alias("iso3"), "area_km2")
    return panel.gravity_panel(X.covariates(spark, sf), X.named_flows(spark, sf), areas, gdp_scale=1.0)


_P = "year, iso3_o, iso3_d, round(X_ij_usd, 4) AS X_ij_usd, home, round(dist, 4) AS distw_harmonic"


@query(f"WITH {Q.PANEL} SELECT {_P}, round(gdp_o, 4) AS gdp_o, round(gdp_d, 4) AS gdp_d, contig FROM panel")
def gravity_panel(spark, sf):
    return rounded(_panel(spark, sf).select("year", "iso3_o", "iso3_d", "X_ij_usd", "home", "distw_harmonic", "gdp_o", "gdp_d", "contig"))


@query(f"WITH {Q.PANEL} SELECT g.region AS iso3_o, g.t AS year, round(g.gdp, 4) AS gdp, round(coalesce(e.exports, 0), 4) AS exports_usd, round(greatest(0.0E0, g.gdp - coalesce(e.exports, 0)), 4) AS X_ij_usd FROM gdp g LEFT JOIN exports e ON e.o = g.region AND e.t = g.t WHERE g.gdp > 0")
def wei_proxy(spark, sf):
    g = X.gdp(spark, sf).selectExpr("region AS iso3_o", "t AS year", "gdp")
    return rounded(panel.wei_proxy(g, X.named_flows(spark, sf), ("iso3_o", "year")))


@query(f"WITH {Q.PANEL} SELECT {_P} FROM panel WHERE home = 1")
def panel_union_intra(spark, sf):
    return rounded(_panel(spark, sf).where("home = 1").select("year", "iso3_o", "iso3_d", "X_ij_usd", "home", "distw_harmonic"))


@query(f"""WITH {Q.PANEL} SELECT year, iso3_o, iso3_d, CASE WHEN X_ij_usd > 0 THEN round(ln(greatest(X_ij_usd, 1)), 6) END AS log_X, CASE WHEN dist > 0 THEN round(ln(greatest(dist, 1)), 6) END AS log_d,
CASE WHEN gdp_o > 0 AND gdp_d > 0 THEN round(ln(greatest(gdp_o, 1)), 6) END AS log_gdp_o, CASE WHEN gdp_o > 0 AND gdp_d > 0 THEN round(ln(greatest(gdp_d, 1)), 6) END AS log_gdp_d FROM panel""")
def log_columns(spark, sf):
    return rounded(panel.add_logs(_panel(spark, sf)).select("year", "iso3_o", "iso3_d", "log_X", "log_d", "log_gdp_o", "log_gdp_d"), 6)


@query(f"WITH {Q.PANEL} SELECT year, iso3_o, iso3_d, round(CASE WHEN home = 1 AND iso3_o % 2 = 0 THEN 10.0E0 + iso3_o ELSE dist END, 4) AS distw_harmonic FROM panel")
def swap_intra(spark, sf):
    new = X.nations(spark, sf).where("region % 2 = 0").select(F.col("region").alias("iso3"), (F.col("region") + 10.0).alias("d_new"))
    return rounded(panel.swap_intra_distance(_panel(spark, sf), new).select("year", "iso3_o", "iso3_d", "distw_harmonic"))


@query(f"""WITH {Q.PANEL}, p AS (SELECT *, CASE WHEN (iso3_o + iso3_d) % 3 = 0 THEN dist*0.5E0 END AS pilot FROM panel), s AS (
SELECT 'A' AS spec, contig, dist AS d FROM p UNION ALL SELECT 'B', contig, coalesce(pilot, dist) FROM p UNION ALL SELECT 'C', contig, CASE WHEN contig = 1 THEN coalesce(pilot, dist) ELSE dist END FROM p
UNION ALL SELECT 'D', contig, dist FROM p WHERE contig IS DISTINCT FROM 1)
SELECT spec, CASE WHEN contig = 1 THEN 'touching' ELSE 'separated' END AS regime, count(*) AS n, round(avg(d), 4) AS mean_d FROM s GROUP BY 1, 2""")
def spec_variants(spark, sf):
    p = _panel(spark, sf)
    pilot = p.where("(iso3_o + iso3_d) % 3 = 0").groupBy("iso3_o", "iso3_d").agg((F.max("distw_harmonic") * 0.5).alias("d_pilot"))
    v = panel.contiguity_regime(panel.distance_variants(p, pilot))
    return rounded(v.groupBy("spec", "regime").agg(F.count("*").alias("n"), F.avg("d").alias("mean_d")))


@query(f"WITH {Q.PANEL} SELECT iso3_o || '_' || iso3_d AS pair_id, iso3_o || '_' || year AS oy, iso3_d || '_' || year AS dy FROM panel")
def composite_keys(spark, sf):
    return panel.composite_keys(_panel(spark, sf)).select("pair_id", "oy", "dy")


@query(f"""WITH {Q.PANEL}, a AS (SELECT *, count(*) OVER (PARTITION BY iso3_o, year) AS k FROM panel WHERE X_ij_usd > 100000), b AS (SELECT *, count(*) OVER (PARTITION BY iso3_d, year) AS k2 FROM a WHERE k > 1)
SELECT year, iso3_o, iso3_d FROM b WHERE k2 > 1""")
def singleton_drop(spark, sf):
    p = panel.composite_keys(_panel(spark, sf).where("X_ij_usd > 100000"))
    return panel.drop_singletons(p, "oy", "dy").select("year", "iso3_o", "iso3_d")


@query(f"WITH {Q.PANEL} SELECT count(*) AS n_obs, CAST(sum(home) AS BIGINT) AS n_intra, count(*) FILTER (WHERE X_ij_usd = 0) AS n_zero FROM panel")
def sample_counts(spark, sf):
    return stats.sample_counts(panel.estimation_sample(_panel(spark, sf), ("X_ij_usd", "distw_harmonic"), ("distw_harmonic",)))


# Closed forms


def _d_eff_sql(theta: float, scale: float, floor: float) -> str:
    knots = K.DISK_CURVE
    parts = " ".join(f"WHEN z <= {x1!r}E0 THEN {y0!r}E0 + (z - {x0!r}E0)*{(y1 - y0) / (x1 - x0)!r}E0" for (x0, y0), (x1, y1) in zip(knots, knots[1:], strict=False))
    return f"SELECT region, CAST({theta} AS DOUBLE) AS theta, CAST({floor} AS DOUBLE) AS floor_km, round(least({scale}E0*(CASE WHEN z <= {knots[0][0]}E0 THEN {knots[0][1]}E0 {parts} END)*r/1000.0E0, 0.9E0*r), 6) AS d_eff FROM (SELECT region, r, least(greatest({floor}E0*1000.0E0/r, 0.01E0), 500.0E0) AS z FROM (SELECT region, sqrt(area/pi()) AS r FROM nations))"


@query(f"WITH {Q.NATIONS} " + " UNION ALL ".join(_d_eff_sql(t, s, f) for t, s in K.THETA_SCALE.items() for f in (0.5, 5.0, 50.0)))
def country_d_eff(spark, sf):
    grid = X.nations(spark, sf).withColumn("theta", F.explode(F.array(*[F.lit(t) for t in K.THETA_SCALE]))).withColumn("floor_km", F.explode(F.array(*[F.lit(f) for f in (0.5, 5.0, 50.0)])))
    return rounded(grid.select("region", "theta", "floor_km", geo.country_d_eff("area_km2", "floor_km", "theta").alias("d_eff")), 6)


@query(f"WITH {Q.NATIONS} SELECT region, round(0.67E0*sqrt(area/pi()), 6) AS d_hm FROM nations")
def head_mayer(spark, sf):
    return rounded(X.nations(spark, sf).select("region", geo.head_mayer("area_km2").alias("d_hm")), 6)


@query("SELECT CAST(t AS DOUBLE) AS theta, round(CASE WHEN t <= -2 THEN NULL WHEN t = 0 THEN 1000*exp(-0.5E0) ELSE pow(2/(t + 2), 1/t)*1000 END, 4) AS d FROM (VALUES (1.0E0), (0.0E0), (-0.5E0), (-1.0E0), (-1.5E0), (-1.9E0), (-1.99E0), (-2.0E0)) v(t)")
def disk_closed_form(spark, sf):
    t = spark.createDataFrame([(x,) for x in (1.0, 0.0, -0.5, -1.0, -1.5, -1.9, -1.99, -2.0)], "theta double")
    return rounded(t.select("theta", geo.disk_closed_form("theta", 1000.0).alias("d")))


@query("SELECT gap, theta, round(pow((pow(gap + 200, theta + 2) + pow(gap - 200, theta + 2) - 2*pow(gap, theta + 2))/(40000*(theta + 1)*(theta + 2)), 1/theta), 4) AS d FROM (VALUES (300.0E0), (1000.0E0)) g(gap), (VALUES (-5.0E0), (-3.0E0), (1.0E0)) t(theta)")
def segment_closed_form(spark, sf):
    t = spark.createDataFrame([(g, x) for g in (300.0, 1000.0) for x in (-5.0, -3.0, 1.0)], "gap double, theta double")
    return rounded(t.select("gap", "theta", geo.segment_closed_form("gap", 100.0, "theta").alias("d")))


# Rasters and agglomerations


@query(f"WITH {Q.CELLS} SELECT region, CAST(floor(row/5.0E0) AS INTEGER) AS row, CAST(floor(col/5.0E0) AS INTEGER) AS col, round(sum(value), 2) AS value FROM cells GROUP BY 1, 2, 3")
def block_coarsen(spark, sf):
    return rounded(atoms.coarsen(X.cells(spark, sf), 5, ("region",)), 2)


@query(f"WITH {Q.NATIONS}, {Q.CONSUMPTION} SELECT region, atom, round(weight, 2) AS weight FROM (SELECT *, row_number() OVER (PARTITION BY region ORDER BY weight DESC, atom) AS rn FROM consumption) WHERE rn <= 10")
def top_n_atoms(spark, sf):
    return rounded(atoms.capped(X.consumption(spark, sf), 10).select("region", "atom", "weight"), 2)


_U = "((CAST(('0x' || substr(md5('42:' || atom), 1, 8)) AS BIGINT) + 0.5E0)/4294967296.0E0)"


@query(f"WITH {Q.NATIONS}, {Q.CONSUMPTION} SELECT region, atom FROM (SELECT *, row_number() OVER (PARTITION BY region ORDER BY ln({_U})/weight DESC, atom) AS rn FROM consumption) WHERE rn <= 10")
def weighted_sample(spark, sf):
    return atoms.capped(X.consumption(spark, sf), 10, "stratified").select("region", "atom")


@query(f"WITH {Q.NATIONS}, {Q.CONSUMPTION} SELECT region, atom FROM (SELECT *, row_number() OVER (PARTITION BY region ORDER BY {_U}, atom) AS rn FROM consumption) WHERE rn <= 10")
def uniform_sample(spark, sf):
    return atoms.capped(X.consumption(spark, sf), 10, "uniform").select("region", "atom")


@query(f"WITH {Q.CELLS} SELECT region, round(lat, 4) AS lat, round(lon, 4) AS lon, round(value*area/sum(value*area) OVER (PARTITION BY region), 8) AS weight FROM cells")
def cell_area_weights(spark, sf):
    return rounded(atoms.to_atoms(X.cells(spark, sf)), 4, weight=8)


@query(f"WITH {Q.CELLS} SELECT region, round(sum(value), 2) AS total_mass, round(sum(area), 4) AS total_area_km2, count(*) AS n_cells FROM cells GROUP BY region")
def raster_mass(spark, sf):
    return rounded(atoms.mass(X.cells(spark, sf)), 4, total_mass=2)


@query(f"""WITH {Q.NATIONS}, {Q.CONSUMPTION}, r AS (SELECT *, row_number() OVER w - 1 AS k, sum(weight) OVER (PARTITION BY region) AS tot, coalesce(sum(weight) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM consumption WINDOW w AS (PARTITION BY region ORDER BY weight DESC, atom))
SELECT region, atom, CAST(k AS INTEGER) AS agglom_id, round(sum(weight) OVER (PARTITION BY region)/tot, 6) AS coverage_share FROM r WHERE k < 20 AND (k = 0 OR before/tot < 0.8E0)""")
def coverage_cut(spark, sf):
    return rounded(components.coverage_cut(X.consumption(spark, sf), 0.8, 20, key="atom").select("region", "atom", "agglom_id", "coverage_share"), 6)


_NEAR = f"""WITH RECURSIVE {Q.NATIONS}, {Q.CONSUMPTION}, pts AS (SELECT region, atom, lat, lon, weight FROM consumption),
e AS (SELECT a.atom AS a, b.atom AS b FROM pts a JOIN pts b ON a.region = b.region AND a.atom <> b.atom WHERE {Q.km("a.lat", "a.lon", "b.lat", "b.lon")} <= 25),
reach(n, m) AS (SELECT atom, atom FROM pts UNION SELECT r.n, e.b FROM reach r JOIN e ON e.a = r.m), lab AS (SELECT n, min(m) AS component FROM reach GROUP BY n)"""


@query(f"{_NEAR} SELECT p.region AS region, l.component AS component, round(sum(lat*weight)/sum(weight), 6) AS lat, round(sum(lon*weight)/sum(weight), 6) AS lon, round(sum(weight), 2) AS weight, count(*) AS n_merged FROM pts p JOIN lab l ON l.n = p.atom GROUP BY 1, 2")
def merge_components(spark, sf):
    """Chains of customers within 25 km."""
    return rounded(components.merged(X.consumption(spark, sf).withColumnRenamed("atom", "id")), 6, weight=2)


@query()
def agglomerations(spark, sf):
    lights = X.cells(spark, sf).select("lat", "lon", F.col("value").alias("value"))
    return components.agglomerations(X.cells(spark, sf), lights, density=1.0, least=1000.0)


@query(f"WITH {Q.CELLS}, p AS (SELECT region, lat, lon FROM nations) SELECT p.region AS id, round(coalesce(sum(c.value), 0), 2) AS viirs_radiance FROM p LEFT JOIN cells c ON abs(c.lat - p.lat) <= 0.6E0 AND abs(c.lon - p.lon) <= 0.6E0 GROUP BY 1")
def viirs_window_sum(spark, sf):
    p = X.nations(spark, sf).select(F.col("region").alias("id"), "lat", "lon")
    return rounded(components.window_sum(p, X.cells(spark, sf), 0.6).select("id", "viirs_radiance"), 2)


# Networks


@query(f"WITH {Q.NATIONS}, h AS (SELECT region AS id, row_number() OVER (ORDER BY CAST(bloc AS VARCHAR), lpad(CAST(region AS VARCHAR), 3, 'A')) - 1 AS k, count(*) OVER () AS n FROM nations) SELECT CAST(id AS BIGINT) AS id FROM h WHERE k % greatest(1, n // 10) = 0 AND k < greatest(1, n // 10)*10")
def systematic_hub_sample(spark, sf):
    return atoms.systematic_sample(X.hubs(spark, sf), ("country", "iata"), 10).select("id")


def _flags(a: str, b: str) -> str:
    x1, y1, x2, y2 = f"{a}.lon", f"{a}.lat", f"{b}.lon", f"{b}.lat"
    east_west = f"(({x1} > 43 AND {x2} BETWEEN -80 AND 42 AND {y2} > -10) OR ({x2} > 43 AND {x1} BETWEEN -80 AND 42 AND {y1} > -10))"
    my, mx = f"(({y1}+{y2})/2)", f"(({x1}+{x2})/2)"
    canal = f"({my} BETWEEN 29 AND 32 AND {mx} BETWEEN 31 AND 33)"
    return f"((CASE WHEN ({x1} < -90 AND {x2} > -75) OR ({x2} < -90 AND {x1} > -75) THEN 2 ELSE 0 END) | (CASE WHEN {east_west} OR {canal} THEN 5 ELSE 0 END) | (CASE WHEN {my} BETWEEN 10 AND 32 AND {mx} BETWEEN 32 AND 45 THEN 4 ELSE 0 END))"


_SEA = f"sea AS (SELECT CAST(a.region AS BIGINT) AS src, CAST(b.region AS BIGINT) AS dst, {Q.km('a.lat', 'a.lon', 'b.lat', 'b.lon')} AS length_km, {_flags('a', 'b')} AS flags FROM nations a JOIN nations b ON a.region < b.region)"


@query(f"WITH {Q.NATIONS}, {_SEA} SELECT src, dst, 'maritime' AS mode, round(length_km, 4) AS length_km, round(length_km/24, 4) AS hours, flags FROM sea")
def maritime_edges(spark, sf):
    return rounded(routing.maritime_edges(X.hubs(spark, sf)))


@query(f"WITH {Q.NATIONS} SELECT CAST(a.region AS BIGINT) AS src, CAST(b.region AS BIGINT) AS dst, 'air' AS mode, round({Q.km('a.lat', 'a.lon', 'b.lat', 'b.lon')}, 4) AS length_km, round({Q.km('a.lat', 'a.lon', 'b.lat', 'b.lon')}/850 + 4, 4) AS hours, 0 AS flags FROM nations a JOIN nations b ON a.region < b.region WHERE {Q.km('a.lat', 'a.lon', 'b.lat', 'b.lon')} <= 15000")
def air_edges(spark, sf):
    return rounded(routing.air_edges(X.hubs(spark, sf)))


@query(f"WITH {Q.NATIONS}, {_SEA} SELECT flags, count(*) AS n FROM sea GROUP BY flags")
def chokepoint_flags(spark, sf):
    return routing.maritime_edges(X.hubs(spark, sf)).groupBy("flags").agg(F.count("*").alias("n"))


_PRICE = {"normal": ("1", "1", "1"), "suez_closed": ("1e6", "1", "1"), "panama_drought": ("1", "1.8E0", "1"), "red_sea_crisis": ("1", "1", "2.5E0")}


def _cost(name: str) -> str:
    s, p, r = _PRICE[name]
    return f"length_km/24*8*(CASE WHEN flags & 1 <> 0 THEN {s} ELSE 1 END)*(CASE WHEN flags & 2 <> 0 THEN {p} ELSE 1 END)*(CASE WHEN flags & 12 <> 0 THEN {r} ELSE 1 END)"


@query(f"WITH {Q.NATIONS}, {_SEA} " + " UNION ALL ".join(f"SELECT src, dst, '{n}' AS scenario, round({_cost(n)}, 2) AS cost FROM sea" for n in _PRICE))
def scenario_costs(spark, sf):
    return rounded(routing.scenario_costs(routing.maritime_edges(X.hubs(spark, sf)), {n: geo.Scenario.preset(n) for n in _PRICE}).select("src", "dst", "scenario", "cost"), 2)


@query(f"WITH {Q.NATIONS}, {Q.CONSUMPTION} SELECT c.atom AS id, CAST(arg_min(n.region, ((c.lon-n.lon)*(c.lon-n.lon) + (c.lat-n.lat)*(c.lat-n.lat))) AS BIGINT) AS node FROM consumption c, nations n GROUP BY c.atom")
def nearest_node(spark, sf):
    return routing.nearest_node(X.consumption(spark, sf).select(F.col("atom").alias("id"), "lat", "lon"), X.hubs(spark, sf))


_PATHS = f"""WITH RECURSIVE {Q.NATIONS}, {_SEA}, e AS (SELECT src, dst, {_cost("red_sea_crisis")} AS cost FROM sea UNION ALL SELECT dst, src, {_cost("red_sea_crisis")} FROM sea),
p(source, node, cost, hops) AS (SELECT src, src, 0.0E0, 0 FROM (SELECT DISTINCT src FROM e) UNION ALL SELECT p.source, e.dst, p.cost + e.cost, p.hops + 1 FROM p JOIN e ON e.src = p.node WHERE p.hops < 3),
best AS (SELECT source, node, min(cost) AS cost FROM p GROUP BY source, node)"""


@query(f"{_PATHS} SELECT source, node, round(cost, 2) AS cost FROM best")
def shortest_paths(spark, sf):
    e = routing.priced(routing.undirected(routing.maritime_edges(X.hubs(spark, sf))), geo.Scenario.preset("red_sea_crisis"))
    return rounded(routing.shortest_paths(e, X.hubs(spark, sf).select(F.col("id").alias("node"))), 2)


_GRID = f"""{Q.NATIONS}, {Q.CONSUMPTION}, grid AS (SELECT DISTINCT CAST(floor((lat + 90)/0.5E0) AS BIGINT) AS r, CAST(floor((lon + 180)/0.5E0) AS BIGINT) AS c FROM consumption),
spot AS (SELECT r, c, r*100000 + c AS id, (r + 0.5E0)*0.5E0 - 90 AS lat, (c + 0.5E0)*0.5E0 - 180 AS lon FROM grid),
e AS (SELECT a.id AS src, b.id AS dst, 30*{Q.km('a.lat', 'a.lon', 'b.lat', 'b.lon')}/65 AS cost FROM spot a JOIN (VALUES (-1), (0), (1)) x(i) ON true JOIN (VALUES (-1), (0), (1)) y(j) ON i <> 0 OR j <> 0 JOIN spot b ON b.r = a.r + i AND b.c = a.c + j)"""


@query(f"""WITH RECURSIVE {_GRID}, start AS (SELECT region, max_by(CAST(floor((lat + 90)/0.5E0) AS BIGINT)*100000 + CAST(floor((lon + 180)/0.5E0) AS BIGINT), struct_pack(w := weight, a := -atom)) AS source FROM consumption GROUP BY region),
p(source, node, cost) USING KEY (source, node) AS (SELECT DISTINCT source, source, 0.0E0 FROM start UNION
SELECT s.source, s.node, s.cost FROM (SELECT p.source, e.dst AS node, min(p.cost + e.cost) AS cost FROM p JOIN e ON e.src = p.node GROUP BY 1, 2) s LEFT JOIN recurring.p o ON o.source = s.source AND o.node = s.node WHERE o.cost IS NULL OR s.cost < o.cost - 1E-9)
SELECT source, node, round(cost, 3) AS cost FROM p""")
def road_costs(spark, sf):
    """From each nation's best customer to every cell its roads reach, by contraction and labels."""
    e = routing.road_edges(X.roads(spark, sf))
    cell = lambda c, by: F.floor((F.col(c) + by) / 0.5)
    node = cell("lat", 90) * 100000 + cell("lon", 180)
    best = X.consumption(spark, sf).groupBy("region").agg(F.max_by(node, F.struct("weight", -F.col("atom"))).alias("source")).select("source").distinct()
    # A cell's roads stay among cells that hang together, so only those are asked for.
    parts = components.components(X.cells(spark, sf, 0.5).select((F.col("row").cast("long") * 100000 + F.col("col")).alias("node")).distinct(), e.select(F.col("src").alias("a"), F.col("dst").alias("b")))
    pairs = best.join(parts.withColumnRenamed("node", "source"), "source").join(parts, "component").select("source", "node")
    return rounded(hierarchy.least_costs(routing.priced(e, geo.Scenario()), pairs), 3)


def _lcp_sql(years: dict[int, str]) -> str:
    """Paths of both modes for each year's scenario, and agglomerations with the nation nearest to each."""
    sea = " UNION ALL ".join(f"SELECT CAST({y} AS INTEGER) AS year, 'maritime' AS mode, {a} AS src, {b} AS dst, {_cost(n)} AS cost FROM sea" for y, n in years.items() for a, b in (("src", "dst"), ("dst", "src")))
    km = Q.km("a.lat", "a.lon", "b.lat", "b.lon")
    air = " UNION ALL ".join(f"SELECT CAST({y} AS INTEGER), 'air', CAST(a.region AS BIGINT), CAST(b.region AS BIGINT), 220*({km}/850 + 4) FROM nations a, nations b WHERE a.region <> b.region AND {km} <= 15000" for y in years)
    return f"""WITH RECURSIVE {Q.AGGLOMERATIONS}, {_SEA}, e AS ({sea} UNION ALL {air}),
p(year, mode, source, node, cost, hops) AS (SELECT DISTINCT year, mode, src, src, 0.0E0, 0 FROM e UNION ALL SELECT p.year, p.mode, p.source, e.dst, p.cost + e.cost, p.hops + 1 FROM p JOIN e ON e.src = p.node AND e.year = p.year AND e.mode = p.mode WHERE p.hops < 3),
path AS (SELECT year, mode, source, node, min(cost) + CASE WHEN mode = 'air' THEN 880 ELSE 192 END AS cost FROM p GROUP BY year, mode, source, node),
way AS (SELECT year, source, node, min(cost) AS cost, arg_min(mode, cost + CASE WHEN mode = 'air' THEN 1E-9 ELSE 0 END) AS mode FROM path GROUP BY year, source, node),
spot AS (SELECT g.iso3, g.year, g.lat, g.lon, g.pop/sum(g.pop) OVER (PARTITION BY g.iso3, g.year) AS share, (SELECT arg_min(n.region, (g.lon-n.lon)*(g.lon-n.lon) + (g.lat-n.lat)*(g.lat-n.lat)) FROM nations n) AS node, g.viirs, g.pop FROM agg g)"""


_LCP_YEARS = {2020: "normal", 2021: "red_sea_crisis"}
_LCP_MEAN = "SELECT a.iso3 AS iso_o, b.iso3 AS iso_d, a.year, 1/sum(a.share*b.share/w.cost) AS d FROM spot a JOIN spot b ON a.year = b.year AND a.iso3 <> b.iso3 JOIN way w ON w.year = a.year AND w.source = a.node AND w.node = b.node GROUP BY 1, 2, 3"


def _graphs(spark, sf) -> dict[str, tuple[DataFrame, DataFrame]]:
    h = X.hubs(spark, sf)
    return {"maritime": (h, routing.maritime_edges(h)), "air": (h, routing.air_edges(h))}


@query(f"{_lcp_sql({2024: 'red_sea_crisis'})} SELECT source AS o, node AS d, round(cost, 2) AS cost, mode FROM way WHERE source <> node")
def lcp_min_mode(spark, sf):
    h = X.hubs(spark, sf)
    pairs = measures.pairs_of(h.withColumnRenamed("id", "region"), h.withColumnRenamed("id", "region"), same=False)
    return rounded(routing.least_cost(h, _graphs(spark, sf), geo.Scenario.for_year(2024), pairs), 2)


@query(f"{_lcp_sql(_LCP_YEARS)} SELECT iso_o, iso_d, year, round(d, 4) AS d_lcp_multi_t FROM ({_LCP_MEAN})")
def lcp_multi_t(spark, sf):
    """Each pair of agglomerations has its own cost, each year its own scenario."""
    return rounded(routing.lcp_by_year(X.agglomerations(spark, sf), _graphs(spark, sf), {y: geo.Scenario.preset(n) for y, n in _LCP_YEARS.items()}))


@query(f"""{_lcp_sql(_LCP_YEARS)}, lcp AS ({_LCP_MEAN}),
over AS (SELECT a.iso3 AS iso_o, b.iso3 AS iso_d, a.year, 1/sum(a.share*b.share/greatest(0.5E0, {Q.km("a.lat", "a.lon", "b.lat", "b.lon")})) AS d FROM spot a JOIN spot b ON a.year = b.year AND a.iso3 <> b.iso3 GROUP BY 1, 2, 3)
SELECT o.iso_o, o.iso_d, o.year, round({Q.km("x.lat", "x.lon", "y.lat", "y.lon")}, 4) AS d_cepii_distw, round(s.d, 4) AS d_ovdl, round(o.d, 4) AS d_ovdl_t, CAST(NULL AS DOUBLE) AS d_lcp_road, CAST(NULL AS DOUBLE) AS d_lcp_multi, round(l.d, 4) AS d_lcp_multi_t, CAST(NULL AS DOUBLE) AS d_lcp_act,
  round(CASE WHEN o.year = 2020 THEN l.d/(x.bloc + 1.0E0) ELSE l.d END, 4) AS d_net_adj
FROM over o JOIN over s ON s.iso_o = o.iso_o AND s.iso_d = o.iso_d AND s.year = 2020 JOIN lcp l ON l.iso_o = o.iso_o AND l.iso_d = o.iso_d AND l.year = o.year JOIN nations x ON x.region = o.iso_o JOIN nations y ON y.region = o.iso_d""")
def distance_variants_wide(spark, sf):
    n = X.nations(spark, sf)
    weighted = measures.m1_capital(n, measures.pairs_of(n, n, same=False)).select(F.col("o").alias("iso_o"), F.col("d").alias("iso_d"), F.col("m1").alias("d_cepii_distw"))
    central = n.select(F.col("region").alias("iso3"), F.lit(2020).alias("year"), (F.col("bloc") + 1.0).alias("centrality_norm"))
    return rounded(routing.all_variants(X.agglomerations(spark, sf), _graphs(spark, sf), {y: geo.Scenario.preset(n) for y, n in _LCP_YEARS.items()}, weighted, central))


# Statistics


@query(f"WITH {Q.PANEL} SELECT round(max(sd), 6) AS max_sd, count(*) AS n_groups, coalesce(max(sd) >= 1e-6, false) AS identified FROM (SELECT iso3_o, iso3_d, stddev_samp(X_ij_usd) AS sd FROM panel GROUP BY 1, 2)")
def within_pair_std(spark, sf):
    return stats.within_std(_panel(spark, sf), ("iso3_o", "iso3_d"), "X_ij_usd").withColumn("max_sd", F.round("max_sd", 6))


@query(f"""WITH {Q.PANEL}, r AS (SELECT home, X_ij_usd AS x, dist AS y, rank() OVER (PARTITION BY home ORDER BY X_ij_usd) + (count(*) OVER (PARTITION BY home, X_ij_usd) - 1)/2.0E0 AS rx, rank() OVER (PARTITION BY home ORDER BY dist) + (count(*) OVER (PARTITION BY home, dist) - 1)/2.0E0 AS ry FROM panel)
SELECT home, count(*) AS n, round(corr(x, y), 6) AS pearson, round(corr(rx, ry), 4) AS spearman FROM r GROUP BY home""")
def pearson_spearman(spark, sf):
    return rounded(stats.correlations(_panel(spark, sf), "X_ij_usd", "distw_harmonic", ("home",)), 6, spearman=4)


@query(f"""WITH {Q.MEETINGS}, m AS ({Q.effective('-5')}), r AS (SELECT m.o, m.d_eff/({Q.km("a.lat", "a.lon", "b.lat", "b.lon")}) AS ratio FROM m JOIN nations a ON a.region = m.o JOIN nations b ON b.region = m.d WHERE m.o <> m.d)
SELECT count(ratio) AS n, round(avg(ratio), 6) AS mean, round(median(ratio), 6) AS median, round(quantile_cont(ratio, 0.1), 6) AS p10, round(quantile_cont(ratio, 0.9), 6) AS p90, round(min(ratio), 6) AS least, round(max(ratio), 6) AS greatest FROM r""")
def ratio_quantiles(spark, sf):
    r = ces_directional(spark, sf).join(capital_distance_full(spark, sf), ["o", "d"]).where("o <> d").withColumn("ratio", F.col("d_eff") / F.col("m1"))
    return rounded(stats.summary(r, "ratio"), 6)


def capital_distance_full(spark, sf) -> DataFrame:
    n = X.nations(spark, sf)
    return measures.m1_capital(n, measures.pairs_of(n, n))


@query(f"WITH {Q.NATIONS}, v AS (" + " UNION ALL ".join(_d_eff_sql(t, s, f) for t, s in K.THETA_SCALE.items() for f in (0.5, 5.0, 50.0)) + ") SELECT floor_km, round(avg(d_eff) FILTER (WHERE theta = -7), 4) AS \"-7.0\", round(avg(d_eff) FILTER (WHERE theta = -5), 4) AS \"-5.0\", round(avg(d_eff) FILTER (WHERE theta = -3), 4) AS \"-3.0\" FROM v GROUP BY floor_km")
def pivot_theta_dmin(spark, sf):
    p = stats.pivoted(country_d_eff(spark, sf), "floor_km", "theta", [-7.0, -5.0, -3.0], "d_eff")
    return p.select("floor_km", *[F.round(F.col(f"`{c}`"), 4).alias(c) for c in ("-7.0", "-5.0", "-3.0")])


@query(f"WITH {Q.PANEL} SELECT home, round(regr_slope(ln(X_ij_usd), ln(dist)), 6) AS slope, round(regr_intercept(ln(X_ij_usd), ln(dist)), 6) AS intercept FROM panel WHERE X_ij_usd > 0 GROUP BY home")
def ols_slope(spark, sf):
    p = _panel(spark, sf).where("X_ij_usd > 0").select("home", F.log("X_ij_usd").alias("y"), F.log("distw_harmonic").alias("x"))
    return rounded(stats.slope(p, "y", "x", ("home",)), 6)


# Polygons


@query(f"""WITH {Q.CELLS}, {Q.border_edges(X.BORDER, X.HOLE)}, spots AS (SELECT c.region AS own, c.row, c.col, e.region AS holder, e.x1, e.y1, e.x2, e.y2, c.lat - e.lat AS y, (c.lon - e.lon + 540) % 360 - 180 AS x FROM cells c, edges e)
SELECT own, row, col, holder FROM spots WHERE least(x1, x2) <= x AND x < greatest(x1, x2) AND y1 + (x - x1)*(y2 - y1)/(x2 - x1) > y GROUP BY own, row, col, holder HAVING count(*) % 2 = 1""")
def cells_in_polygons(spark, sf):
    """Which border holds which population cell, some of both across the antimeridian."""
    cells = X.cells(spark, sf).select(F.col("region").alias("own"), "row", "col", (F.col("lon") + 45).alias("lon"), "lat")
    return polygons.containing(cells, X.borders(spark, sf)).select("own", "row", "col", F.col("region").alias("holder"))


@query(f"""WITH {Q.NATIONS}, {Q.border_edges(X.BORDER, X.HOLE)}, ring AS (SELECT region, hole, abs(sum(radians(x2 - x1)*(CASE WHEN y1 = y2 THEN sin(radians(lat + y1)) ELSE (cos(radians(lat + y1)) - cos(radians(lat + y2)))/radians(y2 - y1) END))) AS a FROM edges GROUP BY region, hole)
SELECT region, round(sum(CASE WHEN hole = 1 THEN -a ELSE a END)*{polygons.EQUAL_AREA_KM ** 2!r}, 3) AS area_km2 FROM ring GROUP BY region""")
def polygon_areas(spark, sf):
    return rounded(polygons.areas(X.borders(spark, sf)), 3)


@query(f"""WITH {Q.CELLS}, {Q.border_edges(X.BORDER, X.HOLE)}, spots AS (SELECT c.region AS own, c.row, c.col, c.value, e.region AS holder, e.x1, e.y1, e.x2, e.y2, c.lat - e.lat AS y, (c.lon - e.lon + 540) % 360 - 180 AS x FROM (SELECT min(region) AS region, row, col, sum(value) AS value, min(lat) AS lat, min(lon) AS lon FROM cells GROUP BY row, col) c, edges e),
held AS (SELECT row, col, holder, any_value(value) AS value FROM spots WHERE least(x1, x2) <= x AND x < greatest(x1, x2) AND y1 + (x - x1)*(y2 - y1)/(x2 - x1) > y GROUP BY row, col, holder HAVING count(*) % 2 = 1),
block AS (SELECT holder, CAST(floor(row/2.0E0) AS INTEGER) AS r, CAST(floor(col/2.0E0) AS INTEGER) AS c, sum(value) AS value FROM held GROUP BY 1, 2, 3)
SELECT holder AS region, count(*) AS n_cells, round(sum(value), 2) AS total_mass, round(sum(abs(0.5E0*111.32E0*cos(radians((r + 0.5E0)*0.5E0 - 90))*0.5E0*111.32E0)), 2) AS total_area_km2 FROM block WHERE value > 0 GROUP BY holder""")
def masked_mass(spark, sf):
    """A raster masked by polygons, coarsened by two: cells, mass and area of each region."""
    raster = X.cells(spark, sf).groupBy("row", "col").agg(F.sum("value").alias("value"))
    affine = (0.25, 0.0, -180.0, 0.0, 0.25, -90.0)
    own = polygons.members(raster, affine, X.borders(spark, sf, 0.0))
    return rounded(atoms.mass(atoms.masked(raster, own, affine, k=2)), 2)


_YEARLY_HELD = f"""WITH {Q.YEARLY}, {Q.border_edges(X.BORDER, X.HOLE)}, raster AS (SELECT year, CAST(floor((lat + 90)/0.25E0) AS INTEGER) AS row, CAST(floor((lon + 180)/0.25E0) AS INTEGER) AS col, sum(weight) AS value FROM yearly GROUP BY 1, 2, 3),
spots AS (SELECT c.row, c.col, e.region AS holder, e.x1, e.y1, e.x2, e.y2, (c.row + 0.5E0)*0.25E0 - 90 - e.lat AS y, ((c.col + 0.5E0)*0.25E0 - 180 - e.lon + 540) % 360 - 180 AS x FROM (SELECT DISTINCT row, col FROM raster) c, edges e),
held AS (SELECT row, col, holder FROM spots WHERE least(x1, x2) <= x AND x < greatest(x1, x2) AND y1 + (x - x1)*(y2 - y1)/(x2 - x1) > y GROUP BY row, col, holder HAVING count(*) % 2 = 1)"""


@query(f"""{_YEARLY_HELD},
block AS (SELECT holder AS region, year, CAST(floor(row/5.0E0) AS INTEGER) AS r, CAST(floor(col/5.0E0) AS INTEGER) AS c, sum(value) AS value FROM raster JOIN held USING (row, col) GROUP BY 1, 2, 3, 4),
spot AS (SELECT region, year, (r + 0.5E0)*1.25E0 - 90 AS lat, (c + 0.5E0)*1.25E0 - 180 AS lon, value*abs(1.25E0*111.32E0*cos(radians((r + 0.5E0)*1.25E0 - 90))*1.25E0*111.32E0) AS weight FROM block WHERE value > 0), s AS ({Q.centroid('spot', 'region, year')})
SELECT region, year, round(lat, 6) AS centroid_lat, round(lon, 6) AS centroid_lon, CASE WHEN round(lat - lag(lat) OVER w, 6) = 0 THEN 0.0E0 ELSE round(lat - lag(lat) OVER w, 6) END AS v_lat_deg, CASE WHEN round(lon - lag(lon) OVER w, 6) = 0 THEN 0.0E0 ELSE round(lon - lag(lon) OVER w, 6) END AS v_lon_deg, n AS n_atoms FROM s WINDOW w AS (PARTITION BY region ORDER BY year)""")
def raster_series(spark, sf):
    """Yearly rasters written as GeoTIFF tiles, read back, masked by borders, coarsened, and followed by their centroids."""
    grid = (0.25, 0.0, -180.0, 0.0, 0.25, -90.0)
    slot = lambda c, by: F.floor((F.col(c) + by) / 0.25).cast("int")
    path = f"{components.shared_dir(spark)}/terraflux/rasters-{uuid.uuid4().hex}"
    yearly = X.yearly_atoms(spark, sf).groupBy(F.col("year").cast("string").alias("layer"), slot("lat", 90).alias("row"), slot("lon", 180).alias("col")).agg(F.sum("weight").alias("value"))
    raster.write(yearly, path, grid)
    a, _, west, _, e, south = raster.affine(path)
    down, right = round((south - grid[5]) / e), round((west - grid[2]) / a)
    cells = raster.read(spark, path).select(F.col("layer").cast("int").alias("year"), (F.col("row") + down).alias("row"), (F.col("col") + right).alias("col"), "value")
    series = velocity.raster_series(cells, polygons.members(cells, grid, X.borders(spark, sf, 0.0)), grid)
    unsigned = {c: F.when(F.col(c) == 0, 0.0).otherwise(F.col(c)) for c in ("v_lat_deg", "v_lon_deg")}  # a place of one cell does not move by -0
    return rounded(series.drop("total_mass"), 6).withColumns(unsigned)


@query(f"""{_YEARLY_HELD},
block AS (SELECT holder AS region, year, floor(row/2.0E0) AS r, floor(col/2.0E0) AS c, sum(value) AS value FROM raster JOIN held USING (row, col) GROUP BY 1, 2, 3, 4)
SELECT CAST(year AS VARCHAR) AS layer, CAST(region AS VARCHAR) AS region, count(*) AS n_atoms, round(sum(value), 2) AS total_mass FROM block WHERE value > 0 GROUP BY 1, 2""")
def cached_clouds(spark, sf):
    """Clouds of all years and borders, where the even years are in the cache already."""
    grid = (0.25, 0.0, -180.0, 0.0, 0.25, -90.0)
    slot = lambda c, by: F.floor((F.col(c) + by) / 0.25).cast("int")
    cells = components.written(X.yearly_atoms(spark, sf).groupBy("year", slot("lat", 90).alias("row"), slot("lon", 180).alias("col")).agg(F.sum("weight").alias("value")).select(F.col("year").cast("string").alias("layer"), "row", "col", "value"), "cells")
    members = components.written(polygons.members(cells, grid, X.borders(spark, sf, 0.0)), "members")
    path = f"{components.shared_dir(spark)}/terraflux/clouds-{uuid.uuid4().hex}"
    cloud_cache.through(cells.where("layer % 2 = 0"), members, grid, path, k=2)
    clouds, _ = cloud_cache.through(cells, members, grid, path, k=2)
    return rounded(clouds.groupBy("layer", "region").agg(F.count("*").alias("n_atoms"), F.max("total_mass").alias("total_mass")), 2)


# Estimators

_BALANCED = f"""WITH {Q.PANEL}, b AS (SELECT c.iso3_o, c.iso3_d, ln(1 + coalesce(sum(f.x), 0)) AS y, ln(max(c.dist)) AS x FROM covariates c LEFT JOIN flows f ON f.o = c.iso3_o AND f.d = c.iso3_d AND f.t = c.year GROUP BY 1, 2),
t AS (SELECT y - avg(y) OVER (PARTITION BY iso3_o) - avg(y) OVER (PARTITION BY iso3_d) + avg(y) OVER () AS ty, x - avg(x) OVER (PARTITION BY iso3_o) - avg(x) OVER (PARTITION BY iso3_d) + avg(x) OVER () AS tx FROM b)"""


@query(f"{_BALANCED} SELECT round(sum(tx*ty)/sum(tx*tx), 6) AS slope, count(*) AS n_obs FROM t")
def fe_ols_balanced(spark, sf):
    c = X.covariates(spark, sf).select("iso3_o", "iso3_d", "year", "distw_harmonic")
    b = c.join(X.named_flows(spark, sf), ["iso3_o", "iso3_d", "year"], "left").groupBy("iso3_o", "iso3_d").agg(F.log(1 + F.coalesce(F.sum("X_ij_usd"), F.lit(0.0))).alias("y"), F.log(F.max("distw_harmonic")).alias("x"))
    return rounded(gravity.two_way_balanced(b, "y", "x", "iso3_o", "iso3_d"), 6)


def _sample(spark, sf) -> DataFrame:
    p = panel.composite_keys(panel.estimation_sample(_panel(spark, sf), ("X_ij_usd", "distw_harmonic"), ("distw_harmonic",)))
    return p.withColumn("log_d", F.log("distw_harmonic"))


@query()
def fe_ols(spark, sf):
    logs = _sample(spark, sf).where("X_ij_usd > 0").withColumn("log_X", F.log("X_ij_usd"))
    return rounded(gravity.estimate(logs, gravity.GravitySpec(flow="log_X"), "pair", "ols"), 6)


@query()
def ppml_two_way(spark, sf):
    return rounded(gravity.estimate(_sample(spark, sf), gravity.GravitySpec(), None), 6)


@query()
def ppml_clustered(spark, sf):
    return rounded(gravity.estimate(_sample(spark, sf), gravity.GravitySpec(), "pair"), 6)


@query()
def ppml_three_way(spark, sf):
    p = _sample(spark, sf).withColumn("trend", F.col("contig") * (F.col("year") - 1998) * 1.0)
    return rounded(gravity.estimate(p, gravity.GravitySpec(regressors=("trend",), pair=True), "exp-imp-time"), 6)


_SAMPLE = f"WITH {Q.PANEL}, s AS (SELECT year, iso3_o, iso3_d, X_ij_usd AS y, ln(dist) AS log_d, home FROM panel WHERE dist > 0)"


def _margins_sql(y: str, where: str, shown: str) -> str:
    live = f"{_SAMPLE}, l AS (SELECT year, iso3_o, iso3_d, {y} AS y, log_d, home FROM s WHERE {where})"
    level = lambda e, c: f"SELECT '{e}:' || {c} || '_' || year AS kind, sum(y) AS total FROM l GROUP BY {c}, year"
    parts = [level("oy", "iso3_o"), level("dy", "iso3_d"), "SELECT 'log_d', sum(y*log_d) FROM l", "SELECT 'home', sum(y*home) FROM l"]
    return f"{live} SELECT kind, round(total / (SELECT sum(y) FROM l), 7) AS observed, round(total / (SELECT sum(y) FROM l), 7) AS fitted FROM ({' UNION ALL '.join(parts)}) WHERE {shown}"


@query(_margins_sql("y", "true", "total <> 0"))
def ppml_margins(spark, sf):
    """The first-order conditions: fitted flows have the observed totals by origin-year, destination-year and regressor."""
    return rounded(gravity.margins(_sample(spark, sf), gravity.GravitySpec()), 7)


@query(_margins_sql("ln(y)", "y > 0", "true"))
def fe_ols_margins(spark, sf):
    logs = _sample(spark, sf).where("X_ij_usd > 0").withColumn("log_X", F.log("X_ij_usd"))
    return rounded(gravity.margins(logs, gravity.GravitySpec(flow="log_X"), "ols"), 7)


@query()
def spec_sweep(spark, sf):
    p = _sample(spark, sf)
    for f in (0.5, 5.0, 50.0):
        own = geo.country_d_eff("area_km2", F.lit(f), F.lit(-5.0))
        p = p.withColumn(panel.floor_column(f), F.when(F.col("home") == 1, own).otherwise(F.col("distw_harmonic")))
    grid = [{"spec": "A1", "distance": "distw_harmonic"}, {"spec": "A2", "distance": "distw_harmonic", "intra": False}] + [{"spec": f"B{f:g}", "distance": panel.floor_column(f)} for f in (0.5, 5.0, 50.0)]
    return rounded(gravity.sweep(p, grid, gravity.GravitySpec()), 6)


@query()
def multilateral_resistance(spark, sf):
    return rounded(resistance.resistances(_panel(spark, sf).withColumn("distance", F.col("distw_harmonic")), -1.0, 0.5), 8)


@query(f"""WITH {Q.PANEL}, member AS (SELECT year, c FROM (SELECT year, iso3_o AS c, sum(X_ij_usd) AS x FROM panel GROUP BY 1, 2) JOIN (SELECT year, iso3_d AS c, sum(X_ij_usd) AS y FROM panel GROUP BY 1, 2) USING (year, c) WHERE x > 0 AND y > 0),
inside AS (SELECT * FROM panel p WHERE (year, iso3_o) IN (SELECT year, c FROM member) AND (year, iso3_d) IN (SELECT year, c FROM member)),
total AS (SELECT year, sum(X_ij_usd) AS x FROM inside GROUP BY year), own AS (SELECT year, 'exports' AS side, iso3_o AS iso3, sum(X_ij_usd) AS x FROM inside GROUP BY year, iso3_o UNION ALL SELECT year, 'imports', iso3_d, sum(X_ij_usd) FROM inside GROUP BY year, iso3_d)
SELECT year, side, iso3, round(own.x/total.x, 8) AS observed, round(own.x/total.x, 8) AS fitted FROM own JOIN total USING (year)""")
def resistance_margins(spark, sf):
    """The margin equations, recomputed from the panel's cells and the resistances."""
    return rounded(resistance.margins(_panel(spark, sf).withColumn("distance", F.col("distw_harmonic")), -1.0, 0.5), 8)


@query()
def home_multiplier(spark, sf):
    return rounded(resistance.home_multiplier(_panel(spark, sf).withColumn("distance", F.col("distw_harmonic")), -1.0, 0.5, named=(0, 1)), 6)


# Transport


def _clouds(spark, sf) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Each region's whole clouds, and all pairs of regions."""
    p, c = X.production(spark, sf), X.consumption(spark, sf)
    return p, c, measures.pairs_of(p, c)


@query()
def wasserstein_1(spark, sf):
    return rounded(transport.m6_wasserstein(*_clouds(spark, sf)))


@query()
def wasserstein_iceberg(spark, sf):
    return rounded(transport.m7_iceberg(*_clouds(spark, sf), theta=0.5))


@query()
def sinkhorn_divergence(spark, sf):
    return rounded(transport.m8_sinkhorn(*_clouds(spark, sf)))


_SLICED = f"""WITH {Q.NATIONS}, {Q.CONSUMPTION}, {Q.PRODUCTION}, ways(k, c, s) AS (VALUES {", ".join(f"({k}, cos({a!r}E0), sin({a!r}E0))" for k, a in enumerate(transport.sliced_angles()))}),
po AS (SELECT region AS o, lat, lon, weight/sum(weight) OVER (PARTITION BY region) AS w FROM production), pd AS (SELECT region AS d, lat, lon, weight/sum(weight) OVER (PARTITION BY region) AS w FROM consumption),
xo AS (SELECT o, k, lat*c + lon*s AS x, sum(w) OVER (PARTITION BY o, k ORDER BY lat*c + lon*s, w ROWS UNBOUNDED PRECEDING) AS q FROM po, ways),
xd AS (SELECT d, k, lat*c + lon*s AS x, sum(w) OVER (PARTITION BY d, k ORDER BY lat*c + lon*s, w ROWS UNBOUNDED PRECEDING) AS q FROM pd, ways),
both_sides AS (SELECT o, d, k, q, x AS a, NULL AS b FROM xo, (SELECT DISTINCT d FROM pd) UNION ALL SELECT o, d, k, q, NULL, x FROM xd, (SELECT DISTINCT o FROM po)),
seg AS (SELECT o, d, k, q - coalesce(lag(q) OVER w, 0) AS width, first_value(a IGNORE NULLS) OVER f AS a, first_value(b IGNORE NULLS) OVER f AS b FROM both_sides
  WINDOW w AS (PARTITION BY o, d, k ORDER BY q), f AS (PARTITION BY o, d, k ORDER BY q ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
slice AS (SELECT o, d, k, sum(width*(a - b)*(a - b)) AS square FROM seg GROUP BY o, d, k)
SELECT o, d, round(sqrt(avg(square))*111.32E0*cos(radians((any_value(mo) + any_value(md))/2)), 4) AS m9 FROM slice JOIN (SELECT o, sum(w*lat) AS mo FROM po GROUP BY o) USING (o) JOIN (SELECT d, sum(w*lat) AS md FROM pd GROUP BY d) USING (d) GROUP BY o, d"""


@query(_SLICED)
def sliced_wasserstein(spark, sf):
    return rounded(transport.m9_sliced(*_clouds(spark, sf)))


@query()
def horse_race(spark, sf):
    """All measures against the power mean: plain and rank correlation."""
    p, c, pairs = _clouds(spark, sf)
    wide = measures.all_measures(p, c, pairs, X.nations(spark, sf)).join(measures.m10_effective(p, c, pairs), ["o", "d"])
    long = wide.select("m10", F.explode(F.array(*[F.struct(F.lit(m).alias("measure"), F.col(f"`{m}`").alias("value")) for m in wide.columns if m not in ("o", "d", "m10")])).alias("x")).select("m10", "x.*")
    long = components.checkpointed(long)  # solved once, then ranked
    return rounded(stats.correlations(long, "value", "m10", ("measure",)), 6)


# Studies


_OWN = f"{Q.NATIONS}, {Q.CONSUMPTION}"
_OWN_MET = f"{_OWN}, met AS (SELECT a.region AS o, b.region AS d, a.weight*b.weight AS w, greatest(0.5E0, {Q.km('a.lat', 'a.lon', 'b.lat', 'b.lon')}) AS km FROM consumption a, consumption b)"


@query(f"WITH {_OWN_MET} {Q.effective('-5')}")
def symmetric_matrix(spark, sf):
    return rounded(studies.symmetric_matrix(X.consumption(spark, sf)))


def _internal(t: float) -> str:
    return f"SELECT o AS region, CAST({t} AS DOUBLE) AS theta, d_eff, round(0.67E0*sqrt(n.area/pi()), 4) AS d_hm FROM ({Q.effective(str(t))}) JOIN nations n ON n.region = o WHERE o = d"


@query(f"WITH {_OWN_MET} " + " UNION ALL ".join(map(_internal, (-7, -5, -3, -1, 1))))
def internal_distances(spark, sf):
    return rounded(studies.internal_distances(X.consumption(spark, sf), X.nations(spark, sf)).drop("ratio"))


def _own_sql(source: str, name: str) -> str:
    km = f"greatest(0.5E0, {Q.km('a.lat', 'a.lon', 'b.lat', 'b.lon')})"
    return f"{name} AS (SELECT region, 0.5E0*pow(sum(w*pow(km/0.5E0, -5))/sum(w), -0.2E0) AS d FROM (SELECT a.region, a.weight*b.weight AS w, {km} AS km FROM {source} a JOIN {source} b ON a.region = b.region) GROUP BY region)"


@query(f"""WITH {Q.NATIONS}, {Q.CONSUMPTION}, heaviest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY region ORDER BY weight DESC, atom) AS rn FROM consumption) WHERE rn <= 25),
drawn AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY region ORDER BY ln({_U})/weight DESC, atom) AS rn FROM consumption) WHERE rn <= 25), {_own_sql('consumption', 'base')}, {_own_sql('heaviest', 'top')}, {_own_sql('drawn', 'sampled')}
SELECT region, round(base.d, 4) AS base, round(top.d, 4) AS top, round(sampled.d, 4) AS sampled FROM base JOIN top USING (region) JOIN sampled USING (region)""")
def sampling_bias(spark, sf):
    return rounded(studies.sampling_bias(X.consumption(spark, sf), 25))


_PLANAR = "(111.32E0*sqrt(pow((((b.lon - a.lon + 180) - 360*floor((b.lon - a.lon + 180)/360)) - 180)*cos(radians((a.lat + b.lat)/2)), 2) + pow(b.lat - a.lat, 2)))"


@query(f"WITH {_OWN}, k AS (SELECT a.region, {_PLANAR} AS km FROM consumption a JOIN consumption b ON a.region = b.region) SELECT region, f AS floor_km, round(pow(avg(pow(greatest(km, f), -5)), -0.2E0), 4) AS d_eff FROM k, (VALUES (1.0E0), (10.0E0), (100.0E0)) v(f) GROUP BY 1, 2")
def floor_sweep(spark, sf):
    return rounded(studies.floor_sweep(X.consumption(spark, sf), (1.0, 10.0, 100.0)))


@query(f"""WITH {Q.MEETINGS}, m AS ({Q.effective('-5')}), r AS (SELECT CASE WHEN a.bloc = b.bloc THEN 'touching' ELSE 'separated' END AS regime, m.d_eff/({Q.km("a.lat", "a.lon", "b.lat", "b.lon")}) AS ratio FROM m JOIN nations a ON a.region = m.o JOIN nations b ON b.region = m.d WHERE m.o <> m.d)
SELECT regime, count(ratio) AS n, round(avg(ratio), 6) AS mean, round(median(ratio), 6) AS median, round(quantile_cont(ratio, 0.1), 6) AS p10, round(quantile_cont(ratio, 0.9), 6) AS p90, round(min(ratio), 6) AS least, round(max(ratio), 6) AS greatest FROM r GROUP BY regime""")
def harmonic_regimes(spark, sf):
    n = X.nations(spark, sf)
    bloc = lambda s: n.select(F.col("region").alias(s), F.col("bloc").alias(f"bloc_{s}"))
    r = ces_directional(spark, sf).join(capital_distance_full(spark, sf), ["o", "d"]).where("o <> d").join(bloc("o"), "o").join(bloc("d"), "d")
    r = r.withColumn("ratio", F.col("d_eff") / F.col("m1")).withColumn("contig", (F.col("bloc_o") == F.col("bloc_d")).cast("int"))
    return rounded(studies.regimes(r, "ratio"), 6)


@query(f"WITH {Q.NATIONS}, v AS (" + " UNION ALL ".join(_d_eff_sql(-5.0, 1.0, f) for f in (1.0, 5.0, 10.0, 50.0, 100.0, 200.0)) + """)
SELECT n.region, round(n.area, 6) AS area_km2, round(0.67E0*sqrt(n.area/pi()), 6) AS "d_HM", """ + ", ".join(f'max(d_eff) FILTER (WHERE floor_km = {f}) AS "d_eff_t-5_dmin{f}"' for f in (1, 5, 10, 50, 100, 200)) + " FROM nations n JOIN v ON v.region = n.region GROUP BY n.region, n.area")
def country_diagnostic(spark, sf):
    t = studies.country_table(X.nations(spark, sf))
    return t.select("region", *[F.round(F.col(f"`{c}`"), 6).alias(c) for c in t.columns if c != "region"])


@query(f"""WITH {Q.MEETINGS}, m AS ({Q.effective('-5')}), p AS (SELECT m.o, m.d, m.d_eff, {Q.km("a.lat", "a.lon", "b.lat", "b.lon")} AS distw FROM m JOIN nations a ON a.region = m.o JOIN nations b ON b.region = m.d WHERE m.o <> m.d)
SELECT o, d, round(abs(d_eff - distw)/abs(distw), 6) AS rel_diff FROM p ORDER BY abs(d_eff - distw)/abs(distw) DESC, o, d LIMIT 15""")
def most_different_pairs(spark, sf):
    """The fifteen pairs of a report."""
    published = capital_distance_full(spark, sf).withColumnRenamed("m1", "distw")
    return rounded(studies.against_published(ces_directional(spark, sf), published)[1].select("o", "d", "rel_diff"), 6)


@query()
def border_experiment(spark, sf):
    p = panel.composite_keys(_panel(spark, sf))
    pilot = p.where("(iso3_o + iso3_d) % 3 = 0").groupBy("iso3_o", "iso3_d").agg((F.max("distw_harmonic") * 0.5).alias("d_pilot"))
    return rounded(studies.border_experiment(p, pilot), 6)


@query(f"SELECT o.iso_o, o.iso_d, o.year, round(d_ovdl/(n.n_regionkey*0.37E0 + 1), 4) AS d_net_adj FROM ({_ovdl('pop')}) o JOIN nation n ON n.n_nationkey = o.iso_o")
def net_adjusted(spark, sf):
    """The centrality adjustment, on overland distances rounded to four places."""
    central = X.nations(spark, sf).select(F.col("region").alias("iso_o"), (F.col("bloc") * 0.37 + 1.0).alias("centrality_norm"))
    return rounded(ovdl_pop(spark, sf).join(central, "iso_o", "left").select("iso_o", "iso_d", "year", (F.col("d_ovdl") / F.coalesce("centrality_norm", F.lit(1.0))).alias("d_net_adj")))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE)
