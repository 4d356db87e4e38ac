"""Least costs between agglomerations: each pair and each year has its own."""

import pytest

from terraflux.functions import geo
from terraflux.operators import routing

AGGLOMERATIONS = [("A", 2020, 0.0, 0.0, 3.0), ("A", 2020, 5.0, 0.0, 1.0), ("B", 2020, 20.0, 0.0, 1.0), ("B", 2021, 20.0, 0.0, 1.0), ("A", 2021, 0.0, 0.0, 1.0), ("C", 2030, 1.0, 1.0, 1.0)]


@pytest.fixture
def tables(spark):
    rows = spark.createDataFrame(AGGLOMERATIONS, "iso3 string, year int, lon double, lat double, pop double")
    nodes = spark.createDataFrame([(1, 0.0, 0.0), (2, 5.0, 0.0), (3, 20.0, 0.0), (4, 12.0, 0.0)], "id long, lon double, lat double")
    edges = spark.createDataFrame([(1, 4, 2400.0, geo.K.RED_SEA), (2, 4, 1200.0, 0), (4, 3, 1200.0, 0)], "src long, dst long, length_km double, flags int")
    return rows, nodes, edges.selectExpr("src", "dst", "'maritime' as mode", "length_km", "length_km / 24 as hours", "flags")


def by_key(frame):
    return {(r.iso_o, r.iso_d, r.year): r.d_lcp_multi_t for r in frame.collect()}


def test_pairs_and_years_have_their_own_cost(tables):
    rows, nodes, edges = tables
    years = {2020: geo.Scenario(), 2021: geo.Scenario.preset("red_sea_crisis")}
    harmonic = by_key(routing.lcp_by_year(rows, {"maritime": (nodes, edges)}, years))
    plain = by_key(routing.lcp_by_year(rows, {"maritime": (nodes, edges)}, years, theta=1.0))
    far, near, handling = 3600 / 24 * 8, 2400 / 24 * 8, 24 * 8
    assert set(harmonic) == {("A", "B", 2020), ("B", "A", 2020), ("A", "B", 2021), ("B", "A", 2021)}
    assert plain["A", "B", 2020] == pytest.approx(0.75 * (far + handling) + 0.25 * (near + handling))
    assert harmonic["A", "B", 2020] == pytest.approx(1 / (0.75 / (far + handling) + 0.25 / (near + handling)))
    assert plain["B", "A", 2021] == pytest.approx(2400 / 24 * 8 * 2.5 + 1200 / 24 * 8 + handling)


def test_without_a_path_the_road_is_taken(tables):
    rows, nodes, edges = tables
    got = by_key(routing.lcp_by_year(rows, {"maritime": (nodes, edges.where("dst = 4"))}, {2021: geo.Scenario()}))
    assert got["A", "B", 2021] == pytest.approx(2223.9 / 65 * 30, rel=1e-3)
    assert by_key(routing.lcp_by_year(rows, {}, {2021: geo.Scenario()})) == pytest.approx(got)


def test_long_paths_settle_and_negative_costs_do_not_run(spark):
    line = spark.createDataFrame([(k, k + 1, 1.0) for k in range(25)], "src long, dst long, cost double")
    start = spark.createDataFrame([(0,)], "node long")
    assert max(r.cost for r in routing.shortest_paths(line, start).collect()) == 25
    with pytest.raises(ValueError):
        routing.shortest_paths(line.selectExpr("src", "dst", "-cost as cost"), start)


def test_roads_are_contracted_to_the_same_costs(tables, monkeypatch):
    rows, nodes, edges = tables
    graphs = {"road": (nodes, edges.drop("mode").selectExpr("'road' as mode", "*"))}
    years = {2020: geo.Scenario(), 2021: geo.Scenario()}
    contracted = by_key(routing.lcp_by_year(rows, graphs, years))
    monkeypatch.setattr(routing, "SPARSE", ())
    assert by_key(routing.lcp_by_year(rows, graphs, years)) == pytest.approx(contracted) and len(contracted) == 4
    priced = routing.priced(routing.undirected(edges), geo.Scenario())
    ends = [nodes.selectExpr("id as node"), nodes.where("id < 3").selectExpr("id as node")]
    found = [{(r.source, r.target): r.cost for r in routing.many_to_many(priced, *ends, sparse=s).collect()} for s in (True, False)]
    assert found[0] == pytest.approx(found[1]) and len(found[0]) == 8


def test_only_regions_of_both_clouds_are_paired(spark):
    from terraflux.operators.asymmetry import directional_matrix

    cloud = lambda *names: spark.createDataFrame([(n, 1.0 * k, 2.0, 1.0) for k, n in enumerate(names)], "region string, lat double, lon double, weight double")
    assert {(r.o, r.d) for r in directional_matrix(cloud("a", "b", "x"), cloud("b", "y", "a")).collect()} == {(o, d) for o in "ab" for d in "ab"}
