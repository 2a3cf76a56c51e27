import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from marketloom.functions import distributions as dist
from marketloom.operators import diagnostics, efficiency, multivariate, pricing, volatility
from marketloom.operators.gram import ols
from marketloom.sources import panel, upload

DAY = dt.date(2015, 1, 1)


def series(spark, columns, symbol="S"):
    n = len(next(iter(columns.values())))
    rows = [(symbol, DAY + dt.timedelta(days=i), *[None if v[i] is None else float(v[i]) for v in columns.values()]) for i in range(n)]
    return spark.createDataFrame(rows, "symbol string, ts date, " + ", ".join(f"{c} double" for c in columns))


def one(df):
    return df.first().asDict()


@pytest.mark.parametrize(
    ("got", "want"),
    [
        (dist.normal_sf(1.959963984540054), 0.025), (dist.normal_ppf(0.975), 1.959963984540054), (dist.chi2_sf(3.841458820694124, 1), 0.05),
        (dist.chi2_sf(18.307038053275146, 10), 0.05), (dist.t_sf(2.2281388519649385, 10), 0.025), (dist.f_sf(4.964602743730711, 1, 10), 0.05),
        (dist.t_sf(-2.2281388519649385, 10), 0.975), (dist.kolmogorov_sf(1.3580986393225505), 0.05),
    ],
)
def test_distribution_values(got, want):
    assert got == pytest.approx(want, rel=1e-9)


def test_returns_bridge_gaps_and_add_up(spark):
    s = series(spark, {"value": [100, None, 110, 99]})
    assert [round(r.r, 10) for r in panel.returns(s, "simple").orderBy("ts").collect()] == [0.1, -0.1]
    assert panel.returns(s).agg(F.sum("r")).first()[0] == pytest.approx(math.log(0.99))


def test_as_of_takes_the_last_and_fills_the_head(spark):
    left = series(spark, {"value": [1, 2, 3, 4]})
    right = spark.createDataFrame([("S", DAY + dt.timedelta(days=1), 5.0), ("S", DAY + dt.timedelta(days=3), 6.0)], "symbol string, ts date, rate double")
    assert [r.rate for r in panel.as_of(left, right, "rate", by="symbol").orderBy("ts").collect()] == [5.0, 5.0, 5.0, 6.0]


def test_capm_recovers_its_parameters(spark):
    g = np.random.default_rng(1)
    m = g.normal(4e-4, 0.01, 1500)
    a = 2e-4 + 1.3 * m + g.normal(0, 0.004, 1500)
    got = one(pricing.capm(series(spark, {"r": a, "m": m})))
    assert abs(got["beta"] - 1.3) < 3 * got["beta_se"] and abs(got["alpha"] - 2e-4) < 3 * got["alpha_se"]
    x = np.column_stack([np.ones(1500), m])
    b, ssr = np.linalg.lstsq(x, a, rcond=None)[:2]
    assert got["beta"] == pytest.approx(b[1]) and got["beta_se"] == pytest.approx(math.sqrt(ssr[0] / 1498 * np.linalg.inv(x.T @ x)[1, 1]))


def test_least_squares_agrees_with_numpy_and_skips_what_it_cannot_solve(spark):
    g = np.random.default_rng(2)
    x, z = g.normal(size=200), g.normal(size=200)
    y = 1 + 2 * x - z + g.normal(size=200)
    fit = {r.term: r.estimate for r in ols(series(spark, {"y": y, "x": x, "z": z}), "y", ["x", "z"], ["symbol"]).collect()}
    want = np.linalg.lstsq(np.column_stack([np.ones(200), x, z]), y, rcond=None)[0]
    assert list(fit.values()) == pytest.approx(list(want))
    assert ols(series(spark, {"y": y, "x": x, "z": 2 * x}), "y", ["x", "z"], ["symbol"]).count() == 0
    with pytest.raises(ValueError):
        pricing.factor_model(series(spark, {"r": y, "x": x}), ["x", "x"])


def test_historical_var_is_an_order_statistic(spark):
    r = np.random.default_rng(3).normal(size=1000)
    got = one(volatility.historical_var(series(spark, {"r": r})))
    assert got["var"] == -np.sort(r)[49] and got["n_tail"] == 50 and got["cvar"] >= got["var"]


def test_ewma_by_hand(spark):
    s = 0.01**2
    for r in (-0.02, 0.015):
        s = 0.94 * s + 0.06 * r * r
    assert one(volatility.ewma_vol(series(spark, {"r": [0.01, -0.02, 0.015]})))["vol"] == pytest.approx(math.sqrt(s))


def test_drawdown_path(spark):
    got = one(volatility.drawdown(series(spark, {"value": [100, 120, 90, 95, 130]})))
    assert got["max_drawdown"] == 0.25 and got["current"] == 0 and got["episodes"] == 1 and got["longest_days"] == 3
    assert [(got[k] - DAY).days for k in ("peak", "trough", "recovery")] == [1, 2, 4]
    open_ = one(volatility.drawdown(series(spark, {"value": [100, 120, 90, 95]})))
    assert open_["recovery"] is None and open_["longest_days"] == 2 and open_["current"] == pytest.approx(1 - 95 / 120)


def test_kupiec_without_violations_and_strictness(spark):
    s = series(spark, {"r": [-0.1] * 10 + [0.1] * 10})
    assert one(volatility.kupiec(s, F.lit(0.1)))["violations"] == 0
    assert one(volatility.christoffersen(s, F.lit(0.1)))["lr"] == 0.0


def test_garch_recovers_persistence(spark):
    g, v, out = np.random.default_rng(4), 1.0, []
    for z in g.normal(size=3000):
        out.append(z * math.sqrt(v) / 100)
        v = 0.05 + 0.1 * (out[-1] * 100) ** 2 + 0.85 * v
    got = one(volatility.garch(series(spark, {"r": out})))
    assert got["alpha"] == pytest.approx(0.1, abs=0.05) and got["persistence"] == pytest.approx(0.95, abs=0.04)


def test_unit_root_tests_tell_walks_from_stationary_series(spark):
    e = np.random.default_rng(5).normal(size=800)
    ar = [0.0]
    for x in e:
        ar.append(0.5 * ar[-1] + x)
    walk, still = series(spark, {"value": np.cumsum(e)}), series(spark, {"value": ar})
    assert one(efficiency.adf(still, 2))["statistic"] < -3.43 < one(efficiency.adf(walk, 2))["statistic"]
    assert one(efficiency.kpss(still, 8))["statistic"] < 0.463 < one(efficiency.kpss(walk, 8))["statistic"]


def test_variance_ratio_of_a_walk_is_one(spark):
    level = np.exp(np.cumsum(np.random.default_rng(6).normal(0, 0.01, 2000)))
    for r in efficiency.variance_ratio(series(spark, {"value": level}), [2, 4]).collect():
        assert abs(r.vr - 1) < 0.1 and abs(r.z_robust) < 3


def test_granger_direction(spark):
    g = np.random.default_rng(7)
    x, y = g.normal(size=600), [0.0, 0.0]
    for i in range(2, 600):
        y.append(0.3 * y[-1] + 0.8 * x[i - 2] + g.normal())
    wide = series(spark, {"x": x, "y": y}).drop("symbol")
    assert multivariate.granger(wide, "x", "y", 2).where("lags = 2").first().p_value < 1e-6
    assert multivariate.granger(wide, "y", "x", 2).where("lags = 2").first().p_value > 0.001


def test_diagnostics_on_white_noise(spark):
    e = np.random.default_rng(8).normal(size=1000)
    s = series(spark, {"residual": e, "x": np.arange(1000)})
    assert 1.8 < one(diagnostics.durbin_watson(s))["statistic"] < 2.2
    assert one(diagnostics.jarque_bera(s))["p_value"] > 0.01 and one(diagnostics.arch_lm(s))["p_value"] > 0.001


def test_structural_break_is_found(spark):
    e = np.concatenate([np.zeros(40), np.ones(60)]) + np.random.default_rng(9).normal(0, 0.1, 100)
    assert one(diagnostics.structural_break(series(spark, {"residual": e})))["position"] == 40


def test_upload_to_observations(spark):
    df = spark.createDataFrame([("2024-01-02", "1.5", "x"), ("2024-01-03", None, "y")], "date string, close string, note string")
    p = upload.profile(df)
    assert {r.column: r.role for r in upload.roles(p).collect()} == {"date": "date", "close": "ignore", "note": "ignore"}
    rows = upload.observations(df, "date", {"close": "price"}).collect()
    assert [(str(r.ts), r.symbol, r.field, r.value) for r in rows] == [("2024-01-02", "close", "price", 1.5)]
    with pytest.raises(ValueError):
        upload.observations(df, "date", {})


def test_nearest_vectors_of_every_query_agree_with_the_sql(spark, tmp_path):
    import duckdb

    from marketloom.queries import ORACLES, QUERIES

    data = "/root/testdata/sf0.01"
    db = duckdb.connect()
    db.sql(f"CREATE VIEW lineitem AS FROM '{data}/lineitem.parquet'; CREATE VIEW embeddings AS FROM '{data}/embeddings.parquet'")
    want = sorted(db.sql(ORACLES["nearest_vectors_each"]).fetchall())
    got = sorted((r.query_id, r.vec_id, r.distance) for r in QUERIES["nearest_vectors_each"](spark, data).collect())
    assert [x[:2] for x in got] == [x[:2] for x in want] and len({x[0] for x in got}) > 1
    assert np.allclose([x[2] for x in got], [x[2] for x in want], atol=2e-6)
    spark.read.parquet(f"{data}/embeddings.parquet").limit(0).write.parquet(f"{tmp_path}/embeddings.parquet")
    assert all(QUERIES[name](spark, str(tmp_path)).count() == 0 for name in ("nearest_vectors", "nearest_vectors_each"))


def test_hurst_windows_go_up_to_a_quarter_of_each_series(spark):
    def by_hand(x):
        sizes, k = [], 0
        while (w := round(16 * 2.0 ** (k / 2))) <= len(x) // 4:
            sizes, k = [*sizes, w], k + 1
        rs, noise = [], []
        for w in sizes:
            blocks = [x[i * w : (i + 1) * w] for i in range(len(x) // w)]
            rs.append(np.mean([np.ptp(np.cumsum(b - b.mean())) / b.std(ddof=1) for b in blocks]))
            i = np.arange(1, w)
            front = math.exp(math.lgamma((w - 1) / 2) - math.lgamma(w / 2)) / math.sqrt(math.pi) if w <= 340 else 1 / math.sqrt(w * math.pi / 2)
            noise.append((w - 0.5) / w * front * np.sqrt((w - i) / i).sum())
        slope = lambda y: np.polyfit(np.log(sizes), np.log(y), 1)[0]
        return len(sizes), slope(rs), slope(rs) - slope(noise) + 0.5

    x = {"long": np.random.default_rng(1).normal(size=2498), "short": np.random.default_rng(2).normal(size=300)}
    df = series(spark, {"r": x["long"]}, "long").union(series(spark, {"r": x["short"]}, "short"))
    got = {r.symbol: r for r in efficiency.hurst(df).collect()}
    for name, values in x.items():
        n, slope, estimate = by_hand(values)
        assert got[name].windows == n and got[name].slope == pytest.approx(slope) and got[name].hurst == pytest.approx(estimate)
    assert (got["long"].windows, got["short"].windows) == (11, 5)
