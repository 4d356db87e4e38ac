import math

import pytest
from pyspark.sql import functions as F

from terraflux.operators import atoms, components, panel, routing, stats
from terraflux.functions.geo import Scenario
from terraflux.sources import readers, sinks


def test_flow_levels(spark):
    f = spark.createDataFrame([(2000, 1, 2, "010203", 1.0), (2000, 1, 2, "019999", 2.0), (2000, 1, 2, "020000", 4.0)], "t int, i int, j int, k string, v double")
    assert panel.aggregate_flows(f, "raw").count() == 3
    assert panel.aggregate_flows(f, "pair-year").first().v == 7.0
    assert {r.hs2: r.v for r in panel.aggregate_flows(f, "pair-year-hs2").collect()} == {"01": 3.0, "02": 4.0}
    with pytest.raises(ValueError):
        panel.aggregate_flows(f, "none such")


def test_yearly_flows_skip_what_is_no_number(spark):
    f = spark.createDataFrame([(2000, 1, 2, "1.5"), (2000, 1, 2, "x"), (2000, 1, 2, None), (2001, 1, 2, "9")], "t int, i int, j int, v string")
    assert [(r.X_ij_usd, r.year) for r in panel.yearly_flows(f, 2000).collect()] == [(1500.0, 2000)]


def test_crosswalk_prefers_destinations(spark):
    c = spark.createDataFrame([(1, "AAA", 2, "BBB"), (2, "BB0", 1, "AAZ"), (None, "CCC", 3, None)], "iso3num_o int, iso3_o string, iso3num_d int, iso3_d string")
    assert {r.iso3num: r.iso3 for r in panel.crosswalk(c).collect()} == {1: "AAZ", 2: "BBB"}


def _covariates(spark):
    rows = [(2000, o, d, g, 1.0, 100.0, int(o == "A" and d == "B")) for o, g in (("A", 10.0), ("B", 2.0), ("C", None)) for d in "ABC"]
    return spark.createDataFrame(rows, "year int, iso3_o string, iso3_d string, gdp_o double, gdp_d double, distw_harmonic double, contig int")


def test_gravity_panel(spark):
    flows = spark.createDataFrame([("A", "B", 2000, 4.0), ("B", "A", 2000, 9.0)], "iso3_o string, iso3_d string, year int, X_ij_usd double")
    areas = spark.createDataFrame([("A", math.pi), ("B", None)], "iso3 string, area_km2 double")
    p = panel.gravity_panel(_covariates(spark), flows, areas, gdp_scale=1.0)
    rows = {(r.iso3_o, r.iso3_d): r for r in p.collect()}
    assert len(rows) == 8  # six pairs, two countries with a gdp
    assert rows["A", "C"].X_ij_usd == 0.0 and rows["A", "B"].X_ij_usd == 4.0 and rows["A", "B"].home == 0
    assert rows["A", "A"].X_ij_usd == 6.0 and rows["A", "A"].distw_harmonic == pytest.approx(0.67) and rows["A", "A"].comlang_off == 1
    assert rows["B", "B"].X_ij_usd == 0.0 and rows["B", "B"].distw_harmonic is None
    scaled = panel.gravity_panel(_covariates(spark), flows, areas)
    assert scaled.where("iso3_o = 'A' and home = 1").first().X_ij_usd == 10000.0 - 4.0
    logs = {(r.iso3_o, r.iso3_d): r for r in panel.add_logs(p).collect()}
    assert logs["A", "C"].log_X is None and logs["A", "A"].log_d == 0.0  # under 1 counts as 1
    new = spark.createDataFrame([("A", 7.0)], "iso3 string, d_new double")
    swapped = {(r.iso3_o, r.iso3_d): r.distw_harmonic for r in panel.swap_intra_distance(p, new).collect()}
    assert swapped["A", "A"] == 7.0 and swapped["A", "B"] == 100.0
    pilot = spark.createDataFrame([("A", "B", 1.0), ("B", "A", 2.0)], "iso3_o string, iso3_d string, d_pilot double")
    v = {(r.spec, r.iso3_o, r.iso3_d): r.d for r in panel.distance_variants(p, pilot).collect()}
    assert (v["A", "A", "B"], v["B", "B", "A"], v["C", "A", "B"], v["C", "B", "A"]) == (100.0, 2.0, 1.0, 100.0)
    assert ("D", "A", "B") not in v and ("D", "B", "A") in v


def test_small_helpers(spark):
    assert [panel.floor_column(x) for x in (0.5, 5, 200.0)] == ["dist_dmin_0p5", "dist_dmin_5", "dist_dmin_200"]
    t = spark.createDataFrame([("-99", "XKX"), ("FRA", "FR1")], "ISO_A3 string, ADM0_A3 string")
    assert [r.iso3 for r in panel.boundary_codes(t).orderBy("iso3").collect()] == ["FRA", "XKX"]
    assert {r.column: r.n_unique for r in panel.profile(t).collect()} == {"ISO_A3": 2, "ADM0_A3": 2}


def test_statistics(spark):
    t = spark.createDataFrame([(1, 1.0, 2.0), (1, 2.0, 2.0), (1, 3.0, 5.0), (1, 4.0, 9.0)], "g int, x double, y double")
    c = stats.correlations(t, "x", "y", ("g",)).first()
    assert c.spearman == pytest.approx(0.9486832980505138) and c.n == 4
    assert sorted(r.rank_y for r in stats.average_rank(t, "y").collect()) == [1.5, 1.5, 3.0, 4.0]
    s = stats.summary(t, "x").first()
    assert (s.median, s.p10, s.p90) == pytest.approx((2.5, 1.3, 3.7))
    assert not stats.within_std(t.withColumn("k", F.monotonically_increasing_id()), ("k",), "x").first().identified
    assert stats.extreme(t, "y", "x", greatest=True).first().y == 9.0
    assert stats.percent_change(t, "x", "y").first().pct_change == pytest.approx(100.0)
    assert [r.verdict for r in stats.verdict(t, "x", [(4, "high"), (2, "middle")], "low").orderBy("x").collect()] == ["low", "middle", "middle", "high"]


def test_coarsening_keeps_mass(spark):
    four = spark.createDataFrame([(r, c, float(4 * r + c)) for r in range(4) for c in range(4)], "row int, col int, value double")
    got = {(r.row, r.col): r.value for r in atoms.coarsen(four, 2).collect()}
    assert got[0, 0] == 10 and got[1, 1] == 50
    seven = spark.createDataFrame([(r, c, 1.0) for r in range(7) for c in range(7)], "row int, col int, value double")
    got = {(r.row, r.col): r.value for r in atoms.coarsen(seven, 3).collect()}
    assert got[2, 2] == 1 and sum(got.values()) == 49 and len(got) == 9


def test_mask_and_caps(spark):
    affine = (1.0, 0.0, 10.0, 0.0, -1.0, 50.0)
    cells = spark.createDataFrame([(0, 0, 5.0), (0, 1, float("nan")), (1, 0, -9.0), (1, 1, 3.0)], "row int, col int, value double")
    members = spark.createDataFrame([("X", r, c) for r in (0, 1) for c in (0, 1)], "region string, row int, col int")
    m = atoms.masked(cells, members, affine, nodata=-9.0).orderBy("value").collect()
    assert [(r.lat, r.lon, r.value) for r in m] == [(48.5, 11.5, 3.0), (49.5, 10.5, 5.0)]
    assert m[0].area_km2 == pytest.approx(111.32**2 * math.cos(math.radians(48.5)))
    assert sum(r.weight for r in atoms.to_atoms(atoms.masked(cells, members, affine)).collect()) == pytest.approx(1)
    many = spark.range(100).select(F.lit("r").alias("region"), F.col("id").alias("atom"), (F.col("id") + 1.0).alias("weight"))
    assert sorted(r.atom for r in atoms.capped(many, 3).collect()) == [97, 98, 99]
    drawn = [r.atom for r in atoms.capped(many, 30, "stratified").collect()]
    assert len(drawn) == len(set(drawn)) == 30 and sum(drawn) / 30 > 50
    assert [r.atom for r in atoms.capped(many, 30, "uniform").orderBy("atom").collect()] == [r.atom for r in atoms.capped(many, 30, "uniform").orderBy("atom").collect()]
    with pytest.raises(ValueError):
        atoms.capped(many, 3, "none such")
    raster = atoms.from_raster(cells.withColumn("region", F.lit("X")).where("value > 0"), affine, most=1).first()
    assert raster.total_mass == 8.0 and raster.weight == 1.0


def test_merging_chains(spark):
    lons = {"chain": (0.0, 0.18, 0.36), "near": (0.0, 0.09), "far": (0.0, 5.0)}
    pts = spark.createDataFrame([(g, f"{g}{k}", 0.0, x, 1.0) for g, xs in lons.items() for k, x in enumerate(xs)], "region string, id string, lat double, lon double, weight double")
    got = components.merged(pts, 25.0).groupBy("region").agg(F.count("*").alias("n")).collect()
    assert {r.region: r.n for r in got} == {"chain": 1, "near": 1, "far": 2}


def test_near_pairs_against_brute_force(spark):
    import numpy as np

    from terraflux.operators.transport import distances

    rng = np.random.default_rng(3)
    xy = np.column_stack([rng.uniform(-89, 89, 300), rng.uniform(-180, 180, 300)])
    xy[:60] = np.column_stack([rng.uniform(60, 61, 60), np.where(rng.uniform(size=60) < 0.5, 179.9, -179.9)])
    pts = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(xy)], "id int, lat double, lon double")
    d = distances(xy, xy)
    wanted = {(i, j) for i in range(300) for j in range(i + 1, 300) if d[i, j] <= 40}
    assert {(r.a, r.b) for r in components.near_pairs(pts, 40.0).collect()} == wanted and wanted


def test_agglomerations(spark):
    rows = [("U", 0, 0, 0.0, 0.0, 9000.0, 10.0), ("U", 0, 1, 0.0, 0.25, 9000.0, 10.0), ("U", 9, 9, 9.0, 9.0, 6000.0, 10.0), ("U", 5, 5, 5.0, 5.0, 4000.0, 10.0), ("R", 0, 0, 1.0, 1.0, 10.0, 10.0), ("R", 0, 9, 1.0, 3.0, 30.0, 10.0), ("S", 0, 0, 2.0, 2.0, 4000.0, 10.0)]
    cells = spark.createDataFrame(rows, "region string, row int, col int, lat double, lon double, value double, area_km2 double")
    got = {(r.region, r.agglom_id): r for r in components.agglomerations(cells, target=0.9).collect()}
    assert set(got) == {("U", 0), ("U", 1), ("R", 0)}  # S: all components too small
    assert got["U", 0]["pop"] == 18000 and got["U", 0].lon == pytest.approx(0.125) and got["U", 0].coverage_share == 1.0
    assert got["R", 0]["pop"] == 40 and got["R", 0].lon == pytest.approx(2.5)


def _edges(spark, rows):
    return spark.createDataFrame(rows, "src long, dst long, cost double")


def test_triangle(spark):
    e = _edges(spark, [(0, 1, 30.0), (1, 2, 30.0), (0, 2, 90.0)])
    node = lambda *x: spark.createDataFrame([(i,) for i in x], "node long")
    for solve in (routing.shortest_paths, routing.shortest_paths_local):
        assert {(r.source, r.node): r.cost for r in solve(e, node(0)).collect()} == {(0, 0): 0, (0, 1): 30, (0, 2): 60}
    got = {(r.source, r.target): r.cost for r in routing.many_to_many(e, node(0, 1), node(1, 2)).collect()}
    assert got == {(0, 1): 30, (0, 2): 60, (1, 1): 0, (1, 2): 30}
    assert routing.many_to_many(e, node(2), node(0)).first().cost == math.inf
    ids = spark.createDataFrame([(0,), (1,), (2,)], "id long")
    assert {r.id: r.degree for r in routing.out_degree(e, ids).collect()} == {0: 2, 1: 1, 2: 0}


def test_least_cost_falls_back(spark):
    places = spark.createDataFrame([(0, 0.0, 0.0), (1, 1.0, 0.0), (2, 50.0, 0.0)], "id long, lon double, lat double")
    ports = places.where("id < 2")
    sea = routing.maritime_edges(ports)
    pairs = spark.createDataFrame([(0, 1), (0, 2)], "o long, d long")
    got = {(r.o, r.d): r for r in routing.least_cost(places, {"maritime": (ports, sea)}, Scenario(), pairs).collect()}
    km = 111.19492664455873
    assert got[0, 1].mode == "maritime" and got[0, 1].cost == pytest.approx(km / 24 * 8 + 24 * 8)
    lonely = routing.least_cost(places, {"maritime": (ports, sea.where("false"))}, Scenario(), pairs)
    assert {r.mode for r in lonely.where("d = 1").collect()} == {"gc_fallback"}


def test_hubs(spark):
    rows = [(1, "B", "BBB", 0.0, 0.0, None), (2, "A", "AAA", 1.0, 1.0, "Airport"), (3, "A", "\\N", 1.0, 1.0, "airport"), (4, "A", "AAB", None, 1.0, "airport"), (5, "A", "AAC", 2.0, 2.0, "station")]
    a = spark.createDataFrame(rows, "id long, country string, iata string, lat double, lon double, type string")
    assert {r.id for r in routing.scheduled_airports(a).collect()} == {1, 2}
    many = spark.range(25).withColumn("k", F.col("id"))
    assert [r.id for r in atoms.systematic_sample(many, ("k",), 10).orderBy("id").collect()] == list(range(0, 20, 2))


def test_files(spark, tmp_path):
    (tmp_path / "X_Y2001.csv").write_text("t,i,j,k,v,q\n2001,1,2,010101,1.5,\n2001,1,2,020202,bad,3\n")
    got = readers.flows(spark, str(tmp_path), 2001).orderBy("k").collect()
    assert [r.v for r in got] == [1.5, None]
    assert readers.flows(spark, str(tmp_path), aggregation="pair-year").first().v == 1.5
    with pytest.raises(FileNotFoundError):
        readers.flows(spark, str(tmp_path), 1999)
    (tmp_path / "c.csv").write_text("year,iso3_o,iso3_d,gdp_o,distw_harmonic,other\n2001,A,B,2.0,NaN,1\n2002,A,B,3.0,5.0,1\n")
    c = readers.covariates(spark, str(tmp_path / "c.csv"), [2001], gdp_scale=1000.0).first()
    assert c.gdp_o == 2000.0 and c.distw is None and "other" not in c
    (tmp_path / "a.csv").write_text('1,"N",c,k,\\N,ICAO,1.0,2.0,3,\\N,E,tz,airport,s\n')
    assert readers.airports(spark, str(tmp_path / "a.csv")).first().iata is None
    (tmp_path / "Harmonized_DN_NTL_2015_calDMSP.tif").write_text("")
    assert readers.nightlights_path(spark, str(tmp_path), 2015).endswith("calDMSP.tif")
    with pytest.raises(FileNotFoundError):
        readers.nightlights_path(spark, str(tmp_path), 2010)
    out = str(tmp_path / "out")
    sinks.no_clobber(spark.range(3), out)
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS|already exists"):
        sinks.no_clobber(spark.range(3), out)
    sinks.atom_cache(spark.createDataFrame([("l", "X", 1.0)], "layer string, region string, weight double"), str(tmp_path / "cache"))
    assert readers.atoms(spark, str(tmp_path / "cache"), "l", "X").count() == 1 and readers.atoms(spark, str(tmp_path / "cache"), "l", "Z") is None
    assert readers.fallback_agglomerations(spark, 2020).count() == 20


def test_nearest_node_both_ways(spark):
    import numpy as np

    rng = np.random.default_rng(4)
    p, n = np.column_stack([rng.uniform(-180, 180, 80), rng.uniform(-89, 89, 80)]), np.column_stack([rng.normal(0, 20, 60), rng.normal(0, 10, 60)])
    n[1] = n[0]
    points = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(p)], "id long, lon double, lat double")
    nodes = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(n)], "id long, lon double, lat double")
    wanted = {i: int(((n - x) ** 2).sum(axis=1).argmin()) for i, x in enumerate(p)}
    for most in (10_000, 10):
        assert {r.id: r.node for r in routing.nearest_node(points, nodes, most_broadcast=most, cell=8.0).collect()} == wanted
