import numpy as np
import pandas as pd
import pytest

from terraflux.operators import gravity, resistance

from . import dense


def frame(seed=0, n=8, years=3):
    rng = np.random.default_rng(seed)
    rows = [(t, o, d, rng.uniform(4, 9), float(o == d)) for t in range(years) for o in range(n) for d in range(n)]
    f = pd.DataFrame(rows, columns=["year", "o", "d", "log_d", "home"])
    f["oy"], f["dy"], f["pair_id"] = f.o.astype(str) + "_" + f.year.astype(str), f.d.astype(str) + "_" + f.year.astype(str), f.o.astype(str) + "_" + f.d.astype(str)
    a, b = rng.normal(0, 1, n), rng.normal(0, 1, n)
    mu = np.exp(6 + a[f.o] + b[f.d] - 0.8 * f.log_d + 1.2 * f.home)
    f["X_ij_usd"] = rng.poisson(mu).astype(float)
    return f


def dummies(f, names, effects):
    return np.hstack([f[names].to_numpy(float)] + [pd.get_dummies(f[e]).to_numpy(float) for e in effects])


def test_ppml_first_order_conditions():
    f = frame(years=1)
    got = dense.ppml(f, "X_ij_usd", ["log_d", "home"], ["oy", "dy"], "pair_id", tol=1e-12)
    assert got["converged"]
    x = dummies(f, ["log_d", "home"], ["oy", "dy"])
    y, beta = f.X_ij_usd.to_numpy(), np.zeros(x.shape[1])
    mu = (y + y.mean()) / 2
    for _ in range(60):
        z = np.log(mu) + (y - mu) / mu
        beta = np.linalg.lstsq(np.sqrt(mu)[:, None] * x, np.sqrt(mu) * z, rcond=None)[0]
        mu = np.exp(x @ beta)
    assert [got["coef_log_d"], got["coef_home"]] == pytest.approx(beta[:2].tolist(), abs=1e-5)
    assert np.abs(x.T @ (y - mu)).max() < 1e-5


def test_ppml_of_one_effect_is_closed_form():
    f = frame(years=1)
    got = dense.ppml(f.assign(k=f.home), "X_ij_usd", ["k"], [], None)
    assert got["n_dropped"] == 0


def test_separated_groups_are_dropped():
    f = frame()
    f.loc[f.oy == "0_0", "X_ij_usd"] = 0.0
    got = dense.ppml(f, "X_ij_usd", ["log_d"], ["oy", "dy"], "pair_id")
    assert got["n_dropped"] >= 8 and got["n_obs"] + got["n_dropped"] == len(f)


def test_ols_against_dummies():
    f = frame().assign(y=lambda f: np.log1p(f.X_ij_usd))
    got = dense.ols(f, "y", ["log_d", "home"], ["oy", "dy"], None)
    x = dummies(f, ["log_d", "home"], ["oy", "dy"])
    beta, _, rank, _ = np.linalg.lstsq(x, f.y.to_numpy(), rcond=None)
    assert [got["coef_log_d"], got["coef_home"]] == pytest.approx(beta[:2].tolist(), abs=1e-8)
    residual = f.y.to_numpy() - x @ beta
    cov = np.linalg.pinv(x.T @ x) * (residual @ residual) / (len(f) - rank)
    assert got["se_log_d"] == pytest.approx(float(np.sqrt(cov[0, 0])), rel=0.02)


def test_collinear_regressors_are_dropped():
    f = frame().assign(size=lambda f: f.o.astype(float))
    got = dense.ppml(f, "X_ij_usd", ["log_d", "size"], ["oy", "dy"], "pair_id")
    assert np.isnan(got["coef_size"]) and np.isfinite(got["coef_log_d"])


def test_estimate_and_sweep(spark):
    f = frame()
    f["distance"] = np.exp(f.log_d)
    f["other"] = f.distance * 2
    p = spark.createDataFrame(f)
    whole = gravity.estimate(p, gravity.GravitySpec(), "pair").first()
    assert whole.coef_log_d == pytest.approx(dense.ppml(f, "X_ij_usd", ["log_d", "home"], ["oy", "dy"], "pair_id")["coef_log_d"], abs=1e-7)
    assert whole.home_multiplier == pytest.approx(np.exp(whole.coef_home))
    rows = {r.spec: r for r in gravity.sweep(p.drop("log_d"), [{"spec": "a", "distance": "distance"}, {"spec": "b", "distance": "other"}, {"spec": "c", "distance": "distance", "intra": False}], gravity.GravitySpec()).collect()}
    assert rows["a"].coef_log_d == pytest.approx(rows["b"].coef_log_d, abs=1e-6)  # a scaled distance
    assert rows["c"].n_obs < rows["a"].n_obs and rows["c"].coef_home is None
    with pytest.raises(ValueError):
        gravity.estimate(p, gravity.GravitySpec(), "none such")
    assert gravity.estimate(p, gravity.GravitySpec(regressors=("log_d",), pair=True), "exp-imp-time").first().n_obs > 0
    assert not gravity.choose_spec(0.0, gravity.GravitySpec(pair=True)).pair


def test_separation_as_a_filter(spark):
    f = frame()
    f.loc[f.oy == "0_0", "X_ij_usd"] = 0.0
    kept = gravity.separated_rows(spark.createDataFrame(f), "X_ij_usd", ("oy", "dy")).count()
    assert kept == len(f) - dense.ppml(f, "X_ij_usd", ["log_d"], ["oy", "dy"], None)["n_dropped"]


@pytest.mark.parametrize("n", [1, 9, 197])
def test_resistance(n):
    rng = np.random.default_rng(0)
    log_phi, s, e = rng.normal(0, 2, (n, n)), rng.dirichlet(np.ones(n)), rng.dirichlet(np.ones(n))
    out, into, steps, gap = resistance.balance(log_phi, s, e)
    assert steps < 50 and gap < 1e-11 and into[0] == 1.0
    phi = np.exp(log_phi)
    assert phi @ (e / into) == pytest.approx(out) and phi.T @ (s / out) == pytest.approx(into)


def test_resistance_prunes_incomplete_countries(spark):
    rows = [(1, o, d, float(o == d), 10.0 + abs(o - d), 5.0 + o) for o in range(5) for d in range(5) if (o, d) != (4, 1)]
    p = spark.createDataFrame(rows, "year int, iso3_o int, iso3_d int, home double, distance double, X_ij_usd double")
    got = resistance.resistances(p, -1.0, 0.5)
    assert got.count() == 4 and max(r.gap for r in got.collect()) < 1e-9
    m = resistance.home_multiplier(p, -1.0, 0.5, named=(0, 4)).first()
    named = [m["mult_0"], m["mult_4"]]
    assert m.n_countries == 4 and m.mult_median > 1 and sum(x is None for x in named) <= 1


@pytest.mark.parametrize("method", ["ppml", "ols"])
@pytest.mark.parametrize("cluster,column", [("pair", "pair_id"), (None, None)])
def test_blocks_equal_the_whole_panel(spark, method, cluster, column):
    f = frame(years=4).assign(log_X=lambda f: np.log1p(f.X_ij_usd))
    flow = "X_ij_usd" if method == "ppml" else "log_X"
    wanted = getattr(dense, method)(f, flow, ["log_d", "home"], ["oy", "dy"], column)
    got = gravity.estimate(spark.createDataFrame(f), gravity.GravitySpec(flow=flow), cluster, method).first()
    for c in ("coef_log_d", "coef_home", "fit"):
        assert got[c] == pytest.approx(wanted[c], rel=1e-6)
    assert got.n_obs == wanted["n_obs"] and got.converged
    if cluster or method == "ppml":
        assert got.se_log_d == pytest.approx(wanted["se_log_d"], rel=1e-6)
    assert got.lo_log_d < got.coef_log_d < got.hi_log_d and 0 <= got.p_log_d < 0.01


@pytest.mark.parametrize("method", ["ppml", "ols"])
def test_effects_across_blocks_equal_the_whole_panel(spark, method):
    f = frame(n=6, years=3).assign(log_X=lambda f: np.log1p(f.X_ij_usd), trend=lambda f: f.year * (f.o % 2 == f.d % 3))
    flow = "X_ij_usd" if method == "ppml" else "log_X"
    wanted = getattr(dense, method)(f, flow, ["trend", "log_d"], ["oy", "dy", "pair_id"], None if method == "ols" else "pair_id")
    got = gravity.estimate(spark.createDataFrame(f), gravity.GravitySpec(flow=flow, regressors=("trend", "log_d"), pair=True), None if method == "ols" else "pair", method).first()
    for c in ("coef_trend", "coef_log_d", "fit"):
        assert got[c] == pytest.approx(wanted[c], rel=1e-5)
    assert got.converged and (method == "ols" or got.se_trend == pytest.approx(wanted["se_trend"], rel=1e-4))


@pytest.mark.parametrize("method,spec", [("ols", gravity.GravitySpec(flow="log_X")), ("ppml", gravity.GravitySpec(destination_year=False))])
def test_large_blocks_are_absorbed_by_rows(spark, monkeypatch, method, spec):
    p = spark.createDataFrame(frame(n=5, years=2).assign(log_X=lambda f: np.log1p(f.X_ij_usd)))
    one = gravity.estimate(p, spec, "pair", method).first()
    monkeypatch.setattr(gravity, "BLOCK_ROWS", 10)
    other = gravity.estimate(p, spec, "pair", method).first()
    assert (other.coef_log_d, other.coef_home, other.se_home, other.fit) == pytest.approx((one.coef_log_d, one.coef_home, one.se_home, one.fit), rel=1e-6)


def test_no_task_holds_the_panel(spark):
    f = frame(n=6, years=5)
    rows = gravity._prepared(spark.createDataFrame(f), gravity.GravitySpec(), "pair", ())
    blocks = gravity.packed(rows, "X_ij_usd", ["log_d", "home"], ["oy", "dy"], "_cluster", ["year"], True).collect()
    assert len(blocks) == 5 and max(b.n_obs + b.n_dropped for b in blocks) == 36
    swept = gravity._swept(rows.withColumn("v", rows.log_d).withColumn("w", rows.home + 1), ["oy", "dy"], ["v"], "w")
    plan = swept._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan and "Python" not in plan and "Pandas" not in plan


def test_first_order_conditions(spark):
    f = frame(n=7, years=3)
    rows = gravity.margins(spark.createDataFrame(f), gravity.GravitySpec()).collect()
    assert len(rows) == 2 * 21 + 2
    for r in rows:
        assert r.fitted == pytest.approx(r.observed, rel=1e-8, abs=1e-12)


def test_tails_against_tables():
    for t, dof, p in ((12.7062, 1, 0.05), (2.2281, 10, 0.05), (2.7500, 30, 0.01), (1.9600, None, 0.05), (2.5758, None, 0.01), (0.0, 5, 1.0), (0.7407, 3, 0.5126)):
        assert gravity.tail(t, dof) == pytest.approx(p, abs=2e-4)
        if 0 < p < 0.5:
            assert gravity.quantile(p, dof) == pytest.approx(t, rel=1e-4)
    assert gravity.tail(-2.0, 8) == gravity.tail(2.0, 8)


def test_empty_panel(spark):
    p = spark.createDataFrame(frame()).where("o < 0")
    for spec in (gravity.GravitySpec(), gravity.GravitySpec(pair=True)):
        assert gravity.estimate(p, spec, "pair").first().n_obs == 0
