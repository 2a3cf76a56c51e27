import math

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_operators import one, series

from marketloom.functions.distributions import chi2_sf, t_ppf
from marketloom.operators import conditional, multivariate, systems, volatility


def simulated(seed, n, shocks, omega=0.05, alpha=0.1, gamma=0.0, beta=0.85):
    g, v, out = np.random.default_rng(seed), 1.0, []
    for z in shocks(g, n):
        e = z * math.sqrt(v)
        out.append(e / 100)
        v = omega + (alpha + gamma * (e < 0)) * e * e + beta * v
    return out


def unit_t(nu):
    return lambda g, n: g.standard_t(nu, n) * math.sqrt((nu - 2) / nu)


@pytest.mark.parametrize("shape", [("normal", []), ("t", [5.0]), ("skewt", [6.0, -0.4])])
def test_densities_have_unit_variance(shape):
    z = np.linspace(-200, 200, 2_000_001)
    f = np.exp(conditional.log_density(z, shape[0], np.array(shape[1])))
    mass, mean, second = (float((f * z**k).sum() * (z[1] - z[0])) for k in range(3))
    assert mass == pytest.approx(1, abs=1e-4) and mean == pytest.approx(0, abs=1e-3) and second == pytest.approx(1, abs=2e-2)


def test_intervals_cover_the_parameters_of_t_shocks(spark):
    s = series(spark, {"r": simulated(11, 2500, unit_t(6))})
    fits = conditional.fitted(s, dist="t").persist()
    got = {r.term: r for r in conditional.estimates(fits).collect()}
    assert list(got) == ["mu", "omega", "alpha[1]", "beta[1]", "nu"] and one(fits)["converged"]
    for term, true in (("mu", 0.0), ("alpha[1]", 0.1), ("beta[1]", 0.85), ("nu", 6.0)):
        assert abs(got[term].estimate - true) < 3 * got[term].std_error and got[term].ci_low < got[term].estimate < got[term].ci_high
    paths = conditional.path(s, fits, dist="t").persist()
    assert paths.count() == 2500 and one(paths.agg(F.var_samp("std_residual").alias("v")))["v"] == pytest.approx(1, abs=0.15)
    assert {r.subject: r.p_value > 0.001 for r in conditional.whiteness(paths).collect()} == {"residuals": True, "squares": True}


def test_orders_of_the_three_models(spark):
    s = series(spark, {"r": simulated(12, 600, lambda g, n: g.normal(size=n), gamma=0.1)})
    for model, kw in (("garch", {"p": 2, "q": 0}), ("gjr_garch", {"p": 1, "o": 2, "q": 2}), ("egarch", {"p": 1, "o": 1, "q": 2, "mean": "zero"})):
        fit = one(conditional.fitted(s, model, iterations=1200, **{"o": 0, **kw}))
        assert all(map(math.isfinite, fit["values"])) and len(fit["values"]) == len(fit["names"]) == len(fit["errors"])
    with pytest.raises(ValueError):
        conditional.fitted(s, dist="cauchy")


def test_gjr_holds_garch_and_every_order_is_stationary():
    g = np.random.default_rng(3)
    for o, p, q in ((1, 1, 1), (2, 1, 2), (1, 3, 1)):
        m = conditional.Model("gjr_garch", p, o, q, "normal", "zero")
        x = dict(zip(m.names, m.natural(g.normal(size=len(m.names) + 1)), strict=True))
        alpha, gamma, beta = ([v for k, v in x.items() if k.startswith(w)] for w in ("alpha", "gamma", "beta"))
        assert sum(alpha) + sum(gamma) / 2 + sum(beta) < 1 and min(alpha + beta) >= 0
        assert all(gamma[i] + (alpha[i] if i < p else 0) >= 0 for i in range(o))
    a = conditional._stationary(np.array([0.9, -0.8]))
    assert max(abs(np.roots([1, *-a]))) < 1


def test_constant_and_short_series_are_left_out(spark):
    for r in ([0.1] * 9, [0.1], [None, None]):
        s = series(spark, {"r": r}).withColumn("r", F.col("r").cast("double"))
        assert conditional.fitted(s).count() == 0 and volatility.student_var(s, min_obs=1).count() == 0
        assert conditional.path(s, conditional.fitted(s)).count() == 0


def test_student_var_finds_tails(spark):
    r = np.random.default_rng(5).standard_t(4, 4000) * 0.01 + 0.001
    got, held = one(volatility.student_var(series(spark, {"r": r}), 0.99)), one(volatility.student_var(series(spark, {"r": r}), 0.99, zero_mean=True))
    assert got["nu"] == pytest.approx(4, abs=0.7) and got["sigma"] == pytest.approx(0.01, rel=0.06) and held["mu"] == 0
    assert got["var"] == pytest.approx(-(0.001 + 0.01 * t_ppf(0.01, 4)), rel=0.06)
    assert t_ppf(0.975, 10) == pytest.approx(2.2281, abs=1e-4)


def test_var_of_selected_order_and_its_checks(spark):
    g, a = np.random.default_rng(8), np.array([[0.5, 0.2], [0.0, 0.4]])
    y = [np.zeros(2)]
    for e in g.normal(size=(800, 2)):
        y.append(a @ y[-1] + e)
    y = np.array(y)
    w = series(spark, {"x": y[:, 0], "y": y[:, 1]}).drop("symbol")
    assert systems.selected_order(w, ["x", "y"], 6, "bic") == 1
    assert {r.lags for r in systems.selected_var(w, ["x", "y"], 6, "bic").collect()} == {1}
    got = {r.test: r for r in systems.var_checks(w, ["x", "y"], 1).collect()}
    z = np.column_stack([np.ones(800), y[:-1]])
    e = y[1:] - z @ np.linalg.lstsq(z, y[1:], rcond=None)[0]
    c = [e[h:].T @ e[: len(e) - h] / len(e) for h in range(11)]
    inv = np.linalg.inv(c[0])
    q = len(e) * sum(np.trace(x.T @ inv @ x @ inv) for x in c[1:])
    assert got["whiteness"].statistic == pytest.approx(q) and got["whiteness"].p_value == pytest.approx(chi2_sf(q, 36)) and got["whiteness"].df == 36
    assert got["stability"].passed and 0.3 < got["stability"].statistic < 0.7
    assert not {r.test: r.passed for r in systems.var_checks(w, ["x", "y"], 0).collect()}["whiteness"]
    assert {r.lags for r in systems.selected_var(series(spark, {"x": g.normal(size=300), "y": g.normal(size=300)}).drop("symbol"), ["x", "y"], 3, "bic").collect()} == {0}
    assert multivariate.var_model(w, ["x", "y"], 1).count() == 6
