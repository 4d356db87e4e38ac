import math

import numpy as np
import pytest

from terraflux.functions.constants import DISK_CURVE
from terraflux.functions.geo import haversine_km
from terraflux.operators import asymmetry, measures, velocity
from terraflux.operators import transport
from terraflux.operators.transport import distances, exact, line_transport, sinkhorn, sliced
from terraflux.sources import synthetic

ATOM = "region string, lat double, lon double, weight double"


def table(spark, rows):
    return spark.createDataFrame([tuple(map(lambda v: float(v) if not isinstance(v, str) else v, r)) for r in rows], ATOM)


def effective(spark, a, b, **options):
    a, b = table(spark, [("a", *x) for x in a]), table(spark, [("b", *x) for x in b])
    return measures.effective_distance(measures.atom_pairs(measures.pairs_of(a, b), a, b), **options).first()


def brute(a, b, theta, floor=0.5):
    a, b = np.array(a, float), np.array(b, float)
    d = np.maximum(distances(a[:, :2], b[:, :2]), floor)
    w = np.outer(a[:, 2] / a[:, 2].sum(), b[:, 2] / b[:, 2].sum())
    return math.exp((w * np.log(d)).sum()) if theta == 0 else (w * d**theta).sum() ** (1 / theta)


A, B = [(0, 0, 0.25), (0, 2, 0.75)], [(0, 1, 0.6), (1, 3, 0.4)]


@pytest.mark.parametrize("theta", [-5.0, -1.0, 0.0, 1.0, 2.0])
def test_power_mean_against_brute_force(spark, theta):
    assert effective(spark, A, B, theta=theta).d_eff == pytest.approx(brute(A, B, theta), rel=1e-9)


def test_power_mean_limits(spark):
    middle = effective(spark, A, B, theta=0.0).d_eff
    for t in (-1e-7, 1e-7):
        assert effective(spark, A, B, theta=t).d_eff == pytest.approx(middle, rel=1e-6)
    values = [effective(spark, A, B, theta=t).d_eff for t in (-400.0, -5.0, -1.0, 1.0, 400.0)]
    assert values == sorted(values) and all(map(math.isfinite, values))
    overlap = effective(spark, [(0, 0, 1), (0, 1, 1)], [(0, 0, 1), (0, 2, 1)], theta=-300.0).d_eff
    assert overlap == pytest.approx(0.5, rel=0.01)


def test_power_mean_edges(spark):
    assert effective(spark, [(0, 0, 0)], B) is None  # no positive weight
    with pytest.raises(ValueError):
        effective(spark, A, B, floor_km=0.0)
    with pytest.raises(ValueError):
        measures.power_mean(spark.range(1), ("id",), 0)


def test_direct_power_mean(spark):
    rows = spark.createDataFrame([(1, c, 0.5, 0.5) for c in (100.0, 200.0, 300.0, 400.0)], "k int, cost double, share_o double, share_d double")
    assert measures.power_mean(rows, ("k",), 1).first().effective == pytest.approx(250.0)
    assert measures.power_mean(rows, ("k",), -1).first().effective == pytest.approx(1 / sum(0.25 / c for c in (100, 200, 300, 400)))


def test_centroids(spark):
    c = measures.spherical_centroid(table(spark, [("x", 0, 179, 1), ("x", 0, -179, 1), ("y", 40, 10, 3)])).collect()
    at = {r.region: r for r in c}
    assert abs(at["x"].centroid_lon) == pytest.approx(180, abs=1e-6)
    assert (at["y"].centroid_lat, at["y"].centroid_lon, at["y"].total_mass) == pytest.approx((40, 10, 3))


def test_shares_of_nothing_are_equal(spark):
    s = measures.shares(table(spark, [("x", 0, 0, 0), ("x", 0, 1, 0), ("y", 0, 0, 3), ("y", 0, 0, 1)])).collect()
    assert sorted(r.share for r in s) == [0.25, 0.5, 0.5, 0.75]


def test_disk_curve_goldens(spark):
    """The published curve, from the same seeded clouds: power mean at theta -5 with a floor."""
    n, found = 1500, []
    xy = synthetic.disk(n, seed=0) * 111.32
    for floor, _ in DISK_CURVE[3:]:
        d = np.maximum(np.sqrt(((xy[:, None] - xy[None]) ** 2).sum(-1)), floor)
        found.append(float((d**-5.0).mean() ** -0.2))
    assert found[-1] == pytest.approx(DISK_CURVE[-1][1], rel=0.05)
    assert found == sorted(found)


def test_directional_index(spark):
    m = spark.createDataFrame([("X", "Y", 800.0), ("Y", "X", 600.0), ("X", "X", 1.0)], "o string, d string, d_eff double")
    rows = asymmetry.asymmetry_index(m).collect()
    assert len(rows) == 1 and rows[0].asi == pytest.approx(math.log(800 / 600))


def test_velocity(spark):
    rows = [("A", 2010, 40, -100, 1), ("A", 2011, 40, -95, 1), ("B", 2010, 40, -80, 1), ("B", 2011, 40, -80, 1), ("C", 2010, 0, 0, 1), ("C", 2012, 5, 5, 1)]
    atoms = spark.createDataFrame([(r, y, float(a), float(b), float(w)) for r, y, a, b, w in rows], "region string, year int, lat double, lon double, weight double")
    s = velocity.centroid_series(atoms)
    assert s.where("region = 'C' and year = 2012").first().v_lat_deg == pytest.approx(5.0)  # over the gap
    p = {(r.o, r.d): r for r in velocity.projection(s).collect()}
    assert set(p) == {("A", "B"), ("B", "A")}  # the gap drops C
    assert [r.v_proj_deg for r in p.values()] == pytest.approx([5.0, 5.0], abs=1e-6)
    assert p["A", "B"].gc_dist_km_lag1 == pytest.approx(distances(np.array([[40.0, -100.0]]), np.array([[40.0, -80.0]]))[0, 0])


def test_transport_identities():
    rng = np.random.default_rng(1)
    a, b = rng.uniform(-5, 5, (30, 2)), rng.uniform(-5, 5, (25, 2))
    wa, wb = rng.dirichlet(np.ones(30)), rng.dirichlet(np.ones(25))
    assert exact(distances(a, a), wa, wa) == pytest.approx(0, abs=1e-6)
    assert exact(distances(a[:1], b[:1]), np.ones(1), np.ones(1)) == pytest.approx(distances(a[:1], b[:1])[0, 0])
    two = np.array([[0.0, -10], [0, 10]])
    assert exact(distances(two, np.zeros((1, 2))), np.array([0.5, 0.5]), np.ones(1)) == pytest.approx(distances(np.zeros((1, 2)), two[:1])[0, 0])
    x, y = a[:, 0], b[:, 0]
    assert exact(np.abs(x[:, None] - y[None]), wa, wb) == pytest.approx(line_transport(x, wa, y, wb, 1.0), rel=1e-6)
    assert sinkhorn(a, wa, a, wa) == pytest.approx(0, abs=1e-6)
    assert sinkhorn(a, wa, b, wb, eps=5.0) == pytest.approx(exact(distances(a, b), wa, wb), rel=0.15)


def test_sliced_ranks_like_exact():
    rng, found = np.random.default_rng(2), []
    for k in range(15):
        a, b = rng.normal(0, 1, (20, 2)), rng.normal(k / 2, 1, (20, 2))
        w = np.full(20, 0.05)
        found.append((exact(distances(a, b), w, w), sliced(a, w, b, w)))
    ranks = np.argsort(np.argsort(np.array(found), axis=0), axis=0)
    assert np.corrcoef(ranks.T)[0, 1] > 0.85


def test_dispatch(spark):
    a = table(spark, [("a", 0, 0, 1), ("a", 0, 1, 1)])
    b = table(spark, [("b", 0, 5, 1)])
    pairs = measures.pairs_of(a, b)
    for name in ("m2", "M3", "m5", "M6", "m7", "M8", "m9", "M10"):
        assert math.isfinite(measures.distance(name, a, b, pairs).first()[2])
    for bad in ("M4", "M1"):
        with pytest.raises(ValueError):
            measures.distance(bad, a, b, pairs)
    assert measures.distance("m6", a, b, pairs).first().m6 == pytest.approx(measures.distance("m7", a, b, pairs, theta=1.0).first().m7)


def test_overland(spark):
    a = spark.createDataFrame([("X", 2020, 0.0, 0.0, 0.0), ("Y", 2020, 10.0, 0.0, 5.0), ("Y", 2021, 10.0, 0.0, 5.0)], "iso3 string, year int, lon double, lat double, pop double")
    rows = measures.overland(a).collect()
    km = spark.range(1).select(haversine_km(0.0, 0.0, 0.0, 10.0).alias("v")).first().v
    assert len(rows) == 2 and rows[0].d_ovdl == pytest.approx(km)


@pytest.mark.parametrize("theta,floor", [(-55.0, 0.01), (-61.0, 0.01), (-55.0, 0.5), (59.0, 0.5), (-5.0, 1e-60)])
def test_power_mean_is_finite_at_any_floor(spark, theta, floor):
    """One pair of atoms: the mean is their distance, whatever theta and floor."""
    a = spark.createDataFrame([(0, 0.0, 0.0, 1.0)], "region int, lat double, lon double, weight double")
    b = spark.createDataFrame([(1, 0.0, 170.0, 1.0)], "region int, lat double, lon double, weight double")
    met = measures.atom_pairs(measures.pairs_of(a, b), a, b)
    wanted = 6371.0 * np.radians(170)
    assert measures.effective_distance(met, theta=theta, floor_km=floor).first().d_eff == pytest.approx(wanted)
    assert measures.theta_sweep(met, (theta,), floor_km=floor).first().d_eff == pytest.approx(wanted)


def test_entropic_terms_of_a_region_are_shared(spark):
    rng = np.random.default_rng(5)
    cloud = {(s, r): (rng.uniform(-5, 5, (6, 2)), rng.uniform(0.1, 1, 6)) for s in "pc" for r in (1, 2)}
    table = lambda s: spark.createDataFrame([(r, float(y), float(x), float(w)) for (k, r), (at, ws) in cloud.items() if k == s for (y, x), w in zip(at, ws, strict=True)] + [(3, 0.0, 0.0, 0.0)], "region long, lat double, lon double, weight double")
    pairs = spark.createDataFrame([(1, 1), (1, 2), (2, 1), (2, 2), (3, 1)], "o long, d long")
    got = {(r.o, r.d): r for r in transport.m6_to_m8(table("p"), table("c"), pairs, (0.5, 1.0)).collect()}
    for o in (1, 2):
        for d in (1, 2):
            (a, wa), (b, wb) = cloud["p", o], cloud["c", d]
            wa, wb = wa / wa.sum(), wb / wb.sum()
            assert got[o, d].m8 == pytest.approx(sinkhorn(a, wa, b, wb), abs=1e-6)
            assert got[o, d]["m7_theta1"] == got[o, d].m6 == pytest.approx(exact(distances(a, b), wa, wb))
            assert got[o, d]["m7_theta0.5"] == pytest.approx(exact(distances(a, b) ** 0.5, wa, wb))
    assert got[3, 1].m8 is None and got[3, 1].m6 is None
    plain = {(r.o, r.d): r.m8 for r in transport.m8_sinkhorn(table("p"), table("c"), pairs).collect()}
    assert plain[1, 2] == pytest.approx(got[1, 2].m8)
