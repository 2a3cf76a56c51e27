import duckdb
import numpy as np
import pandas as pd
import pytest
from test_operators import one, series

import __spark_entry__
from marketloom.operators import conditional, efficiency, systems
from marketloom.operators.robust import robust_ols
from marketloom.sources import panel


NEW = "transform_log transform_cumsum transform_diff transform_log_diff compound_monthly phillips_perron bds capm_white capm_newey_west".split()
DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", NEW)
def test_queries_agree_with_their_sql(spark, name):
    db = duckdb.connect()
    db.sql(f"CREATE VIEW lineitem AS FROM '{DATA}/lineitem.parquet'")
    want = db.sql(__spark_entry__.oracle_sql()[name]).df()
    got = __spark_entry__.queries()[name](spark, DATA).toPandas()
    assert sorted(got.columns) == sorted(want.columns) and len(got) == len(want) > 0
    keys = [c for c in ("symbol", "ts", "period_end", "term", "dimension") if c in got.columns]
    got, want = (x.assign(**{c: x[c].astype(str).str[:10] for c in keys}).sort_values(keys).reset_index(drop=True) for x in (got, want))
    for c in got.columns:
        if c in keys:
            assert list(got[c]) == list(want[c])
        else:
            assert np.allclose(got[c].astype(float), want[c].astype(float), rtol=1e-6, atol=2e-6)


def test_robust_errors_agree_with_numpy(spark):
    g = np.random.default_rng(1)
    x, z = g.normal(size=300), g.normal(size=300)
    y = 1 + 2 * x - z + g.normal(size=300) * (1 + np.abs(x))
    m = np.column_stack([np.ones(300), x, z])
    inv = np.linalg.inv(m.T @ m)
    e = y - m @ (inv @ m.T @ y)
    u = m * (e / (1 - np.einsum("ij,jk,ik->i", m, inv, m)))[:, None]
    s = series(spark, {"y": y, "x": x, "z": z})
    got = {r.term: r.std_error for r in robust_ols(s, "y", ["x", "z"], ["symbol"]).collect()}
    assert list(got.values()) == pytest.approx(list(np.sqrt(np.diag(inv @ u.T @ u @ inv))))
    u, lags = m * e[:, None], int(4 * 3 ** (2 / 9))
    meat = u.T @ u
    for k in range(1, lags + 1):
        c = u[k:].T @ u[:-k]
        meat += (1 - k / (lags + 1)) * (c + c.T)
    got = {r.term: r.std_error for r in robust_ols(s, "y", ["x", "z"], ["symbol"], "newey_west").collect()}
    assert list(got.values()) == pytest.approx(list(np.sqrt(np.diag(inv @ meat @ inv))))


def test_partial_autocorrelation_solves_yule_walker(spark):
    r = np.random.default_rng(2).normal(size=400)
    got = {x.lag: x.pacf for x in efficiency.partial_autocorrelation(series(spark, {"r": r}), 4).collect()}
    d = r - r.mean()
    c = [d @ d / 400] + [d[k:] @ d[:-k] / (400 - k) for k in range(1, 5)]
    for k in range(1, 5):
        t = np.array([[c[abs(i - j)] for j in range(k)] for i in range(k)])
        assert got[k] == pytest.approx(np.linalg.solve(t, c[1 : k + 1])[-1])


def test_asymmetric_volatility_finds_the_leverage(spark):
    g, v, out = np.random.default_rng(4), 1.0, []
    for z in g.normal(size=2500):
        e = z * np.sqrt(v)
        out.append(e / 100)
        v = 0.05 + (0.02 + 0.16 * (e < 0)) * e * e + 0.85 * v
    s = series(spark, {"r": out})
    gjr, exp = one(conditional.gjr_garch(s)), one(conditional.egarch(s))
    assert gjr["gamma"] == pytest.approx(0.16, abs=0.08) and gjr["persistence"] == pytest.approx(0.95, abs=0.04)
    assert exp["gamma"] < -0.03 and 0.85 < exp["beta"] < 1
    assert conditional.egarch(series(spark, {"r": [0.1] * 9})).count() == 0


def wide(spark, columns):
    return series(spark, columns).drop("symbol")


def test_impulse_responses_and_shares(spark):
    a, g = np.array([[0.5, 0.1], [0.2, 0.3]]), np.random.default_rng(5)
    y = [np.zeros(2)]
    for _ in range(3000):
        y.append(a @ y[-1] + g.normal(size=2))
    w = wide(spark, {"x": [v[0] for v in y], "y": [v[1] for v in y]})
    got = {(r.horizon, r.response, r.impulse): r.value for r in systems.impulse_responses(w, ["x", "y"], 1, 2, orthogonalized=False).collect()}
    for i, p in enumerate("xy"):
        for j, q in enumerate("xy"):
            assert got[1, p, q] == pytest.approx(a[i, j], abs=0.06) and got[2, p, q] == pytest.approx((a @ a)[i, j], abs=0.08)
    shares = systems.variance_shares(w, ["x", "y"], 1, 5).groupBy("horizon", "variable").sum("share").collect()
    assert len(shares) == 10 and all(r[2] == pytest.approx(1) for r in shares)
    assert min(systems.order_selection(w, ["x", "y"], 4).collect(), key=lambda r: r.bic).lags == 1


def test_cointegrated_pair_has_rank_one(spark):
    g = np.random.default_rng(6)
    x, u = np.cumsum(g.normal(size=800)), [0.0]
    for z in g.normal(size=799):
        u.append(0.5 * u[-1] + z)
    w = wide(spark, {"x": x, "y": 1.5 * x + u})
    rows = systems.johansen(w, ["y", "x"]).orderBy("rank").collect()
    assert rows[0].trace > rows[0].trace_95 and rows[1].trace < rows[1].trace_99
    model = {(r.kind, r.equation, r.term): r.value for r in systems.vecm(w, ["y", "x"], 1).collect()}
    assert model["beta", "relation_1", "y"] == pytest.approx(1) and model["beta", "relation_1", "x"] == pytest.approx(-1.5, abs=0.1)
    assert model["alpha", "y", "relation_1"] == pytest.approx(-0.5, abs=0.15)


def test_error_correction_has_the_errors_of_least_squares_with_beta_known(spark):
    g = np.random.default_rng(8)
    x = np.cumsum(g.normal(size=500))
    y = 2 * x + g.normal(size=500)
    rows = systems.vecm(wide(spark, {"x": x, "y": y}), ["y", "x"]).collect()  # the rank is found
    got = {(r.kind, r.equation, r.term): r for r in rows}
    level = np.column_stack([y, x])
    d = np.diff(level, axis=0)
    beta = np.array([1, got["beta", "relation_1", "x"].value])
    m = np.column_stack([np.ones(498), d[:-1], level[1:-1] @ beta])
    inv = np.linalg.inv(m.T @ m)
    for i, equation in enumerate(["y", "x"]):
        b = inv @ m.T @ d[1:, i]
        error = np.sqrt(np.diag(inv) * np.mean((d[1:, i] - m @ b) ** 2))
        own = [got["gamma", equation, t] for t in ("const", "y_D_L1", "x_D_L1")] + [got["alpha", equation, "relation_1"]]
        assert [r.value for r in own] == pytest.approx(list(b), rel=1e-5) and [r.std_error for r in own] == pytest.approx(list(error), rel=1e-5)
        assert all(0 <= r.p_value <= 1 for r in own)
    assert got["beta", "relation_1", "x"].std_error is None and got["beta", "relation_1", "x"].p_value is None
    with pytest.raises(ValueError):
        systems.vecm(wide(spark, {"x": np.cumsum(g.normal(size=300)), "y": np.cumsum(g.normal(size=300))}), ["y", "x"])


def test_transforms_skip_nulls(spark):
    s = series(spark, {"value": [1, None, 3]})
    assert [r.value for r in panel.transformed(s, "diff").collect()] == [2.0]
    with pytest.raises(ValueError):
        panel.transformed(s, "sqrt")


def levels_of(spark, steps):
    rows = [(name, pd.Timestamp("2015-01-01").date() + pd.Timedelta(days=i), float(v)) for name, x in steps.items() for i, v in enumerate(100 * np.exp(np.cumsum(x)))]
    return spark.createDataFrame(rows, "symbol string, ts date, value double")


def test_bds_in_columns_tells_noise_from_a_map(spark):
    g = np.random.default_rng(5)
    tent = [0.3]
    for _ in range(399):
        tent.append(1 - abs(1 - 1.999 * tent[-1]))
    df = series(spark, {"r": g.normal(size=400)}).unionByName(series(spark, {"r": np.array(tent)}).selectExpr("'t' AS symbol", "ts", "r"))
    cut, whole = (efficiency.bds(df, (2, 3), fine=b).toPandas().sort_values(["symbol", "dimension"]) for b in (1, 7))
    assert np.allclose(cut.statistic, whole.statistic)
    noise, tents = cut[cut.symbol != "t"], cut[cut.symbol == "t"]
    assert (noise.statistic.abs() < 3).all() and (tents.statistic > 8).all()


def test_efficiency_score_of_a_walk_and_of_a_trend_with_echoes(spark):
    g = np.random.default_rng(6)
    noise = g.normal(size=900) * 0.01
    echo = noise.copy()
    for i in range(1, 900):
        echo[i] += 0.6 * echo[i - 1]
    levels = levels_of(spark, {"walk": noise, "echo": echo, "short": noise[:200]})
    got = efficiency.efficiency_score(levels, 5, [2, 4, 8, 16], [16, 23, 32, 45, 64, 91]).toPandas()
    assert set(got.symbol) == {"walk", "echo"} and len(got) == 12 and got.sub_score.between(0, 1).all()
    score = got.groupby("symbol").score.first()
    assert np.allclose(got.groupby("symbol").contribution.sum(), score) and score["walk"] >= 70 > 40 > score["echo"]
    assert not got[got.symbol == "echo"].passed.any() and got[got.symbol == "walk"].passed.all()
    with pytest.raises(ValueError, match="positive"):
        efficiency.efficiency_score(levels, 5, [2], [16, 32], weights=dict.fromkeys(efficiency.WEIGHTS, 0.0))


def test_unit_root_p_values_at_published_critical_values(spark):
    from marketloom.functions.distributions import kpss_p, unit_root_sf

    assert [unit_root_sf(t) for t in (-3.43, -2.86, -2.57, 3.0)] == pytest.approx([0.01, 0.05, 0.1, 1.0], abs=1.5e-3)
    x = spark.createDataFrame([(0.1,), (0.347,), (0.405,), (0.463,), (0.9,)], "x double")
    assert [r[0] for r in x.select(kpss_p(x.x)).collect()] == pytest.approx([0.1, 0.1, 0.075, 0.05, 0.01])


@pytest.mark.parametrize("k", [1, 2, 3])
def test_johansen_tables_are_what_simulation_gives(k):
    """Limits of the statistics: Brownian steps on demeaned paths, of which one is a trend, 400 steps long."""
    g, trace, largest = np.random.default_rng(1), [], []
    for _ in range(8):
        steps = g.normal(size=(500, 400, k))
        path = np.cumsum(steps, 1) - steps
        path[:, :, -1] = np.arange(400)
        path, steps = path - path.mean(1, keepdims=True), steps - steps.mean(1, keepdims=True)
        cross = np.einsum("rti,rtj->rij", steps, path)
        values = np.linalg.eigvalsh(np.einsum("rij,rjk,rlk->ril", cross, np.linalg.inv(np.einsum("rti,rtj->rij", path, path)), cross))
        trace.append(values.sum(1))
        largest.append(values[:, -1])
    for found, table in ((trace, systems.TRACE), (largest, systems.MAX_EIGEN)):
        assert np.allclose(np.quantile(np.concatenate(found), [0.9, 0.95]), table[k - 1][:2], rtol=0.05)
