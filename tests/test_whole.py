"""Queries over whole tables, held against plain Python on small ones with over a hundred customers a nation."""

import numpy as np
import pytest

from terraflux.functions import constants as K
from terraflux.operators.transport import distances, exact
from terraflux.plans import catalog
from terraflux.plans import fixtures as X


@pytest.fixture(scope="module")
def small(spark, tmp_path_factory):
    rng, path = np.random.default_rng(7), str(tmp_path_factory.mktemp("small"))
    put = lambda name, rows, ddl: spark.createDataFrame(rows, ddl).coalesce(1).write.parquet(f"{path}/{name}.parquet")
    put("nation", [(k, k % 2) for k in (0, 1, 4)], "n_nationkey int, n_regionkey int")
    put("customer", [(k, int((0, 1, 4)[k % 3]), float(w)) for k, w in enumerate(rng.uniform(1, 9000, 390).round(2))], "c_custkey long, c_nationkey int, c_acctbal double")
    put("supplier", [(k, int((0, 1, 4)[k % 3]), float(w)) for k, w in enumerate(rng.uniform(1, 9000, 135).round(2))], "s_suppkey long, s_nationkey int, s_acctbal double")
    return path


def clouds(df):
    out = {}
    for r in df.collect():
        out.setdefault(r.region, []).append((r.atom, r.lat, r.lon, r.weight))
    return {k: (np.array(v)[:, 1:3], np.array(v)[:, 3], np.array(v)[:, 0].astype(int)) for k, v in out.items()}


def test_merge_components_of_all_customers(spark, small):
    got = {(r.region, r.component): (r.n_merged, r.weight) for r in catalog.merge_components(spark, small).collect()}
    wanted = {}
    for region, (at, w, atom) in clouds(X.consumption(spark, small)).items():
        near, label = distances(at, at) <= 25, atom.copy()
        while (after := np.array([label[row].min() for row in near])).tolist() != label.tolist():
            label = after
        wanted |= {(region, int(c)): (int((label == c).sum()), round(float(w[label == c].sum()), 2)) for c in set(label.tolist())}
    assert {k: v[0] for k, v in got.items()} == {k: v[0] for k, v in wanted.items()}
    assert all(abs(got[k][1] - wanted[k][1]) < 0.011 for k in wanted) and sum(v[0] for v in got.values()) == 390


def test_transport_of_all_pairs_and_atoms(spark, small):
    got = {(r.o, r.d): r.m6 for r in catalog.wasserstein_1(spark, small).collect()}
    p, c = clouds(X.production(spark, small)), clouds(X.consumption(spark, small))
    assert set(got) == {(o, d) for o in p for d in c} and len(c[0][0]) > 100 and (0, 4) in got
    for o, d in ((0, 4), (4, 0), (1, 1)):
        wanted = exact(distances(p[o][0], c[d][0]), p[o][1] / p[o][1].sum(), c[d][1] / c[d][1].sum())
        assert abs(got[o, d] - wanted) < 1e-3


def test_studies_of_whole_clouds(spark, small):
    base = {r.region: r.base for r in catalog.sampling_bias(spark, small).collect()}
    matrix = {(r.o, r.d): r.d_eff for r in catalog.symmetric_matrix(spark, small).collect()}
    c = clouds(X.consumption(spark, small))
    for o in c:
        for d in c:
            km, w = np.maximum(0.5, distances(c[o][0], c[d][0])), np.outer(c[o][1], c[d][1])
            wanted = ((w * km**-5.0).sum() / w.sum()) ** -0.2
            assert abs(matrix[o, d] - wanted) < 1e-3 and (o != d or abs(base[o] - wanted) < 1e-3)
    count = X.agglomerations(spark, small).where("year = 2020").groupBy("iso3").count().collect()
    for r in count:
        w = np.sort(c[r["iso3"]][1])[::-1]
        before = np.concatenate([[0.0], np.cumsum(w)[:-1]]) / w.sum()
        assert r["count"] == min(K.MOST_AGGLOMERATIONS, int((before < K.COVERAGE).sum())) > 3
