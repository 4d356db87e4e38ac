"""Atoms of one place are one: the work follows the places, and results do not change."""

import time

import numpy as np
import pytest

from terraflux.operators import components, measures, routing, transport
from terraflux.plans import catalog
from terraflux.plans import fixtures as X


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """The same small tables once and in four copies, whose keys are shifted so that places recur."""
    rng, out = np.random.default_rng(3), []
    weights = {"customer": rng.uniform(-500, 9000, 300).round(2), "supplier": rng.uniform(1, 9000, 60).round(2)}
    for copies in (1, 4):
        path = str(tmp_path_factory.mktemp(f"places{copies}"))
        put = lambda name, rows, ddl, path=path: spark.createDataFrame(rows, ddl).coalesce(1).write.parquet(f"{path}/{name}.parquet")
        put("nation", [(k, k % 2) for k in (0, 1, 4)], "n_nationkey int, n_regionkey int")
        for name, w in weights.items():
            rows = [(k + 400 * r, int((0, 1, 4)[k % 3]), float(x)) for r in range(copies) for k, x in enumerate(w)]
            key = {"customer": "c_custkey", "supplier": "s_suppkey"}[name]
            put(name, rows, f"{key} long, {name[0]}_nationkey int, {name[0]}_acctbal double")
        out.append(path)
    return out


def rows(df):
    return {tuple(v for k, v in r.asDict().items() if not isinstance(v, float) or k in ("theta", "floor_km")): [v for k, v in r.asDict().items() if isinstance(v, float) and k not in ("theta", "floor_km")] for r in df.collect()}


def same(a, b):
    assert set(a) == set(b) and a
    assert all(x == pytest.approx(y, rel=1e-9, abs=2e-4) for k in a for x, y in zip(a[k], b[k], strict=True))


def test_meetings_do_not_grow_with_copies(spark, tables):
    once, four = (catalog._meetings(spark, t) for t in tables)
    assert once.count() == four.count()


@pytest.mark.parametrize("name", ["ces_directional", "ces_theta_sweep", "ces_geometric_limit", "asymmetry_index"])
def test_power_means_of_copies(spark, tables, name):
    once, four = (rows(catalog.queries()[name](spark, t)) for t in tables)
    same(once, four)


def test_places_keep_regions_and_drop_negative_weights(spark):
    atoms = spark.createDataFrame([(1, 0.0, 1.0, 2.0), (1, -0.0, 1.0, 3.0), (1, 0.0, 1.0, -9.0), (1, None, 1.0, 1.0), (2, 5.0, 5.0, 0.0), (2, 5.0, 5.0, None)], "region int, lat double, lon double, weight double")
    got = {(r.region, r.lat): r.weight for r in measures.places(atoms).collect()}
    assert got == {(1, 0.0): 5.0, (1, None): 1.0, (2, 5.0): 0.0}
    pairs = measures.pairs_of(atoms, atoms)
    plain = measures.effective_distance(measures.atom_pairs(pairs, atoms, atoms), theta=-1.0)
    same(rows(measures.effective_distance(measures.place_pairs(pairs, atoms, atoms), theta=-1.0)), rows(plain))


def meetings(df) -> int:
    """The most rows that a join of the query has made."""
    df.collect()
    plan, most = [df._jdf.queryExecution().executedPlan()], 0
    while plan:
        node = plan.pop()
        name = node.getClass().getSimpleName()
        if name == "AdaptiveSparkPlanExec":
            plan.append(node.executedPlan())
        elif name.endswith("QueryStageExec"):
            plan.append(node.plan())
        if "Join" in name and node.metrics().contains("numOutputRows"):
            most = max(most, node.metrics().apply("numOutputRows").value())
        children = node.children()
        plan += [children.apply(k) for k in range(children.size())]
    return most


@pytest.mark.parametrize("name", ["floor_sweep", "internal_distances", "symmetric_matrix"])
def test_studies_of_copies(spark, tables, name):
    once, four = (catalog.queries()[name](spark, t) for t in tables)
    same(rows(once), rows(four))
    assert 0 < meetings(four) == meetings(once)


def test_whole_clouds_of_sampling_bias(spark, tables):
    once, four = (catalog.sampling_bias(spark, t) for t in tables)
    same({r.region: [r.base] for r in once.collect()}, {r.region: [r.base] for r in four.collect()})
    assert 0 < meetings(four) == meetings(once)


def test_transport_of_copies(spark, tables):
    for name in ("wasserstein_1", "wasserstein_iceberg", "sinkhorn_divergence"):
        once, four = (catalog.queries()[name](spark, t) for t in tables)
        same(rows(once), rows(four))
        assert 0 < meetings(four) < 2 * meetings(once)


@pytest.mark.parametrize("scale", [1.0, 50.0])
def test_entropic_plan_has_its_margins(scale):
    """Kernel rounds go on where rounds in logarithms left off, also when scalings leave the range."""
    rng = np.random.default_rng(5)
    cost, a, b = scale * rng.uniform(0, 900, (30, 50)), np.full(30, 1 / 30), np.full(50, 1 / 50)
    f, g = np.zeros(30), np.zeros(50)
    for _ in range(1000):
        f = -50 * np.log((np.exp(((g - cost) / 50) - ((g - cost) / 50).max(1)[:, None]) * b).sum(1)) - 50 * ((g - cost) / 50).max(1)
        x = (f[:, None] - cost) / 50
        g = -50 * np.log((np.exp(x - x.max(0)) * a[:, None]).sum(0)) - 50 * x.max(0)
    plan = np.exp((f[:, None] + g - cost) / 50) * a[:, None] * b
    assert transport.entropic(cost, a, b, 50.0) == pytest.approx(float((plan * cost).sum()), rel=1e-9)


@pytest.mark.parametrize("weights", ["equal", "drawn"])
def test_exact_transport_of_hundreds_of_places(weights):
    """Some hundreds a side are certified; the old solver took minutes for one such pair."""
    rng = np.random.default_rng(6)
    x, y = rng.integers(0, 400, 300) / 7.0, rng.integers(0, 400, 300) / 7.0
    a, b = (np.full(300, 1 / 300) if weights == "equal" else (w := rng.uniform(1, 9, 300)) / w.sum() for _ in range(2))
    start = time.process_time()
    assert transport.exact(np.abs(x[:, None] - y), a, b) == pytest.approx(transport.line_transport(x, a, y, b, 1.0), rel=1e-6)
    assert time.process_time() - start < 20


def test_sliced_of_copies(spark, tables):
    once, four = (catalog.sliced_wasserstein(spark, t) for t in tables)
    same(rows(once), rows(four))
    assert 0 < meetings(four) < 2 * meetings(once)


def test_neighbours_are_sought_among_places(spark, tables, monkeypatch):
    asked, near = [], components.near_pairs
    monkeypatch.setattr(components, "near_pairs", lambda points, *a, **k: asked.append(points.count()) or near(points, *a, **k))
    once, four = ({(r.region, r.component): (r.n_merged, r.weight) for r in catalog.merge_components(spark, t).collect()} for t in tables)
    assert asked[0] == asked[1]
    assert {k: 4 * n for k, (n, _) in once.items()} == {k: n for k, (n, _) in four.items()}
    assert all(4 * w == pytest.approx(four[k][1], abs=0.05) for k, (_, w) in once.items())


def test_merged_leaves_points_without_a_place_apart(spark):
    nan = float("nan")
    points = spark.createDataFrame([(1, 7, 1.0, 1.0, 2.0), (1, 5, 1.0, 1.0, 1.0), (1, 9, 1.1, 1.0, 1.0), (1, 3, None, 1.0, 1.0), (1, 4, None, 1.0, 1.0), (1, 6, nan, 1.0, 1.0), (None, 8, 1.0, 1.0, 1.0)], "region int, id long, lat double, lon double, weight double")
    got = {r.component: r.n_merged for r in components.merged(points).collect()}
    assert {k: got.get(k) for k in (3, 4, 5, 6)} == {3: 1, 4: 1, 5: 3, 6: 1}


def test_components_of_long_chains_settle_in_few_rounds(spark):
    """Rounds grew with the chain, and the estimated size doubled its digits in each: the driver's memory went."""
    name = [int(k) for k in np.random.default_rng(4).permutation(60)]
    chain = [(x, y) for x, y in zip(name[:40] + name[40:], name[1:40] + [None] + name[41:], strict=False) if y is not None]  # of 40 and of 20
    nodes = spark.createDataFrame([(k,) for k in [*name, 70, None]], "node long")
    edges = spark.createDataFrame([*chain, *[(y, x) for x, y in chain[:5]], (7, 7), (70, None), (70, 99), (99, 0)], "a long, b long")  # 99 is no node
    found = components.components(nodes, edges, max_rounds=7)
    wanted = {k: min(part) for part in (name[:40], name[40:], [70]) for k in part}
    assert {r.node: r.component for r in found.collect()} == wanted and found.count() == 61
    assert int(str(found._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())).bit_length() < 100
    assert components.components(nodes, edges.where("false")).where("node = component").count() == 61


def test_nearest_node_makes_one_row_a_point(spark, tables):
    got = catalog.nearest_node(spark, tables[0])
    hubs = [(r.id, r.lat, r.lon) for r in X.hubs(spark, tables[0]).collect()]
    wanted = {r.atom: min(((r.lon - x) ** 2 + (r.lat - y) ** 2, i) for i, y, x in hubs)[1] for r in X.consumption(spark, tables[0]).collect()}
    assert {r.id: r.node for r in got.collect()} == wanted
    assert 0 < meetings(got) <= len(wanted)
    assert routing.nearest_node(X.consumption(spark, tables[0]).withColumnRenamed("atom", "id"), X.hubs(spark, tables[0]).where("false")).count() == 0
