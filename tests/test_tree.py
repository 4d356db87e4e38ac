import numpy as np
import pytest

from terraflux.operators import measures, tree


def cloud(spark, seed, sizes, places):
    rng, rows = np.random.default_rng(seed), []
    for (region, n), (lat, lon, spread) in zip(sizes.items(), places, strict=True):
        at = rng.normal(0, spread, (n, 2))
        rows += [(region, float(np.clip(lat + a, -90, 90)), float((lon + b + 180) % 360 - 180), float(w)) for (a, b), w in zip(at, rng.uniform(-0.2, 5, n), strict=True)]
    return spark.createDataFrame(rows, "region int, lat double, lon double, weight double")


PLACES = [(10, 20, 1.5), (12, 22, 2.0), (-30, 179.5, 1.0), (-10, -160, 0.5), (88, 0, 1.0)]


@pytest.mark.parametrize("theta", [-5.0, -1.0, 0.0, 1.0])
def test_equals_all_pairs_of_atoms(spark, theta):
    a, b = cloud(spark, 1, dict(enumerate((300, 200, 90, 5, 150))), PLACES), cloud(spark, 2, dict(enumerate((250, 1, 100, 70, 120))), PLACES)
    pairs = measures.pairs_of(a, b)
    wanted = {(r.o, r.d): r.d_eff for r in measures.effective_distance(measures.atom_pairs(pairs, a, b), theta=theta).collect()}
    got = {(r.o, r.d): r.d_eff for r in tree.effective_distance(pairs, a, b, theta=theta).collect()}
    assert set(got) == set(wanted)
    assert all(round(got[k], 4) == pytest.approx(round(wanted[k], 4), abs=1.1e-4) for k in wanted)


def test_work_grows_below_the_product(spark):
    own, far = [], []
    for n in (4000, 16000):
        a = cloud(spark, 3, {0: n, 1: n}, [(10, 20, 3.0), (-40, 100, 3.0)])
        nodes = tree._nodes(tree._boxed(a))
        met = tree.node_pairs(spark.createDataFrame([(0, 0), (0, 1)], "o int, d int"), nodes, nodes, 0.5)
        own.append(tree.work(met.where("region_d = 0")))
        far.append(tree.work(met.where("region_d = 1")))
    assert max(far) < 0.01 * 16000**2  # whole clouds, or a few large nodes of them, by their proxies
    assert own[1] < 12 * own[0] and own[1] < 0.7 * (16000 * 0.96) ** 2


def test_plain_plan_and_errors(spark):
    a = cloud(spark, 4, {0: 200}, [(10, 20, 3.0)])
    out = tree.effective_distance(spark.createDataFrame([(0, 0)], "o int, d int"), a, a)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "Python" not in plan and "Cross" not in plan
    with pytest.raises(ValueError):
        tree.effective_distance(out, a, a, floor_km=0)
    assert tree.node_error() < 2e-8
    assert tree.effective_distance(spark.createDataFrame([(0, 7)], "o int, d int"), a, a).collect() == []
