"""Results and charts, recursions, the battery of residual checks."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from marketloom.operators import battery, conditional, diagnostics, efficiency, proposals, recursion, results
from marketloom.operators.gram import fitted, ols


def shaped(spark, rows):
    """step, tool, kind, key, points, with an interval: as a result table."""
    out, nth = [], {}
    for step, tool, kind, key, points, interval in rows:
        nth[step] = nth.get(step, -1) + 1
        out += [(step, tool, kind, key, nth[step], None, str(i), 1.0, 0.0 if interval else None, 2.0 if interval else None) for i in range(points)]
    return spark.createDataFrame(out, results.SCHEMA)


def drawn(charts, step):
    rows = charts.where(F.col("step") == step).orderBy("place").collect()
    return [(r.type, r.title, {f"{x.role}": x.key for x in r.refs} if r.type in ("band", "stem") else [x.key for x in r.refs], r.points) for r in rows]


def test_every_rule_fires_on_its_shape(spark):
    rows = [
        ("g", "garch", "series", "conditional_volatility", 5, 0), ("g", "garch", "series", "standardized_residuals", 5, 0), ("g", "garch", "scalar", "aic", 1, 0),
        ("h", "egarch", "series", "conditional_volatility", 5, 0), ("x", "other", "series", "conditional_volatility", 5, 0),
        *[("i", "irf", "series", f"a->{b}", 3, 0) for b in "xyz"], *[("f", "fevd", "series", f"a->{i}", 3, 0) for i in range(10)],
        *[("b", "rolling_beta", "series", k, 4, 0) for k in ("beta_ci_high", "beta", "beta_ci_low")], ("c", "rolling_beta", "series", "beta", 4, 0),
        *[("a", "acf", "series", k + e, 3, 0) for k in ("pacf", "acf") for e in ("", "_upper", "_lower")], ("v", "variance_ratio", "series", "vr_by_horizon", 4, 0), ("d", "dd", "series", "drawdown", 4, 0),
        ("r", "ms", "series", "regime_1", 4, 0), ("r", "ms", "series", "regime_0", 4, 0), ("q", "ms", "series", "regime_0", 4, 0),
        *[("l", "vol", "series", k, 2, 0) for k in ("spread", "ewma_vol", "realized_vol", "rs_by_window")],
        *[("e", "ols", "estimate", k, 1, k != "c") for k in "abc"], ("e", "ols", "series", "residuals", 9, 0), ("o", "ols", "estimate", "a", 1, 1),
        ("t", "vif", "scalar", "n", 1, 0), ("t", "vif", "table", "second_table", 2, 0), ("t", "vif", "table", "a_table", 2, 0),
        ("s", "jb", "scalar", "NOBS", 1, 0), *[("s", "jb", "scalar", k, 1, 0) for k in ("p_value", "stat", "skew", "kurt", "more")], ("n", "none", "scalar", "lags", 1, 0),
    ]
    found = shaped(spark, rows)
    charts = proposals.proposed(found).cache()
    assert drawn(charts, "g") == [("panels", "GARCH fit", ["conditional_volatility", "standardized_residuals"], 10)]
    assert drawn(charts, "h") == [("line", "Conditional volatility", ["conditional_volatility"], 5)] and drawn(charts, "x") == []
    assert drawn(charts, "i") == [("panels", "Impulse responses", ["a->x", "a->y", "a->z"], 9)]
    assert drawn(charts, "f") == [("area_stack", "Forecast error variance decomposition", [f"a->{i}" for i in range(8)], 24)]
    assert drawn(charts, "b") == [("band", "Rolling beta", {"center": "beta", "lower": "beta_ci_low", "upper": "beta_ci_high"}, 12)] and drawn(charts, "c") == []
    assert [x[:2] for x in drawn(charts, "a")] == [("stem", "Autocorrelation"), ("stem", "Partial autocorrelation")]
    assert drawn(charts, "v")[0][0] == "bar" and drawn(charts, "d")[0][0] == "underwater"
    assert drawn(charts, "r") == [("area_stack", "Regime probabilities", ["regime_0", "regime_1"], 8)] and drawn(charts, "q") == []
    assert [x[1] for x in drawn(charts, "l")] == ["Realized volatility", "EWMA volatility", "Cointegrating spread", "Rescaled range by window"]
    assert [(x[0], x[2]) for x in drawn(charts, "e")] == [("forest", ["a", "b"]), ("qq", ["residuals"])] and drawn(charts, "o") == []
    assert drawn(charts, "t") == [("table", "Second table", ["second_table"], 2)]
    assert [x[:2] for x in drawn(charts, "s")] == [("stat_tile", t) for t in ("P value", "Stat", "Skew", "Kurt")] and drawn(charts, "n") == []
    assert {x.label for r in charts.where("step in ('i', 'r')").collect() for x in r.refs} == {"a → x", "a → y", "a → z", "regime 0", "regime 1"}
    assert proposals.unresolved(charts, found).count() == 0 and proposals.refused(charts).count() == 0
    assert {(r.step, r.kind, r.key) for r in proposals.unresolved(charts, found.where("key <> 'beta' and step <> 't'")).collect()} == {("b", "series", "beta"), ("t", "table", "second_table")}
    assert proposals.proposed(found.limit(0)).count() == 0


def test_charts_that_mislead_are_refused(spark):
    def ref(role, n=1):
        return [(role, i, "series", f"k{i}", "l") for i in range(n)]

    rows = [("s", "t", 1, "pie", "x", ref("series"), None, None, None, None), ("s", "t", 2, "line", "x", ref("series", 9), None, None, None, None), ("s", "t", 3, "panels", "x", ref("panel 1"), None, None, None, None),
            ("s", "t", 4, "scatter", "x", ref("x") + ref("y") + ref("group", 4), None, None, None, None), ("s", "t", 5, "heatmap", "x", ref("table"), -1.0, 1.0, "sequential", None), ("s", "t", 6, "heatmap", "x", ref("table"), -1.0, 1.0, "diverging", None),
            ("s", "t", 7, "histogram", "x", ref("series"), None, None, None, 4), ("s", "t", 8, "band", " ", ref("center") + ref("lower"), None, None, None, None), ("s", "t", 9, "line", "x", ref("series", 8), None, None, None, None)]
    schema = "step string, tool string, place int, type string, title string, refs array<struct<role string, rank int, kind string, key string, label string>>, low double, high double, scale string, bins int"
    found = {}
    for r in proposals.refused(spark.createDataFrame(rows, schema)).collect():
        found.setdefault(r.place, set()).add(r.reason)
    assert found == {1: {"unknown type"}, 2: {"more than 8 series"}, 3: {"panels are two or more"}, 4: {"more than 3 groups"}, 5: {"values on both sides of zero need a diverging scale"}, 7: {"5 to 200 bins"}, 8: {"a chart has a title", "a part is missing"}}


def walk(spark, n=500, symbols=("A", "B"), seed=0):
    rng = np.random.default_rng(seed)
    days = pd.bdate_range("2001-01-02", periods=n).date
    rows = [(s, d, float(x)) for s in symbols for d, x in zip(days, rng.standard_t(5, n) * 0.01, strict=True)]
    return spark.createDataFrame(rows, "symbol string, ts date, r double")


@pytest.mark.parametrize("width", [2, 7, 256])
def test_scan_equals_a_loop(spark, width):
    rng = np.random.default_rng(1)
    rows = []
    for s in ("a", "b", None):
        at = sorted(rng.choice(400, 150, replace=False).tolist())
        rows += [(s, int(t) - 100, float(rng.choice([0.0, 0.5, -1.2, 1.0, 1e-200])), float(rng.normal())) for t in at]
    got = {(r.symbol, r.at): r.v for r in recursion.scan(spark.createDataFrame(rows + [("a", 999, None, 1.0)], "symbol string, at long, a double, b double"), width=width).collect()}
    v, last = 0.0, object()
    for s, t, a, b in rows:
        v, last = a * (0.0 if s != last else v) + b, s
        assert got.pop((s, t)) == pytest.approx(v, rel=1e-9, abs=1e-12)
    assert not got


def test_paths_equal_what_runs_along_a_series(spark):
    returns = walk(spark)
    got = recursion.ewma_path(returns).toPandas().sort_values(["symbol", "ts"])
    for s, rows in returns.toPandas().sort_values("ts").groupby("symbol"):
        v = [rows.r.iloc[0] ** 2]
        for x in rows.r.iloc[1:]:
            v.append(0.94 * v[-1] + 0.06 * x * x)
        assert np.allclose(got[got.symbol == s].vol, np.sqrt(v), rtol=1e-10)
    fits = conditional.fitted(returns, "gjr_garch", o=1).cache()
    names = fits.first()["names"]
    own = fits.select("symbol", *[F.col("values")[i].alias(n) for i, n in enumerate(names)])
    own = own.select("symbol", "mu", "omega", F.col("alpha[1]").alias("alpha"), F.col("gamma[1]").alias("gamma"), F.col("beta[1]").alias("beta")) if "alpha[1]" in names else own
    mine = recursion.variance_path(returns.withColumn("r", F.col("r") * 100), own).toPandas().sort_values(["symbol", "ts"])
    theirs = conditional.path(returns, fits, "gjr_garch", o=1).toPandas().sort_values(["symbol", "ts"])
    assert np.allclose(np.sqrt(mine.variance) / 100, theirs.conditional_vol, rtol=1e-8) and np.allclose(mine.std_residual, theirs.std_residual, rtol=1e-8)


def test_ewma_holds_no_series(spark):
    plan = recursion.ewma_path(walk(spark, 50))._jdf.queryExecution().toString()
    assert "Window" not in plan and recursion.ewma_path(walk(spark, 3).limit(0)).count() == 0
    with pytest.raises(ValueError, match="decay"):
        recursion.ewma_path(walk(spark, 3), 1.0)


def test_battery_equals_the_nine(spark):
    rng = np.random.default_rng(2)
    frame = walk(spark, 400).toPandas()
    frame["m"], frame["k"] = rng.normal(size=len(frame)), rng.normal(size=len(frame))
    frame["r"] = frame.r + 0.01 * frame.m
    rows = spark.createDataFrame(frame, "symbol string, ts date, r double, m double, k double")
    res = fitted(rows, ols(rows, "r", ["m", "k"], ["symbol"]), "r", ["m", "k"], ["symbol"])
    got = {(r.symbol, r.check): r for r in battery.report(res, ["m", "k"]).collect()}
    assert {c for _, c in got} == {"jarque_bera", "breusch_pagan", "white", "durbin_watson", "ljung_box", "arch_lm", "vif_m", "vif_k", "cusum", "structural_break"}
    e = res.withColumnRenamed("residual", "e")
    nine = {
        "jarque_bera": diagnostics.jarque_bera(res), "breusch_pagan": diagnostics.breusch_pagan(res, ["m", "k"]), "white": diagnostics.white(res, ["m", "k"]), "durbin_watson": diagnostics.durbin_watson(res),
        "ljung_box": efficiency.ljung_box(e, 10, "e"), "arch_lm": diagnostics.arch_lm(res, 10), "cusum": diagnostics.cusum(res),
    }
    for check, found in nine.items():
        for r in found.collect():
            mine = got[r.symbol, check]
            assert mine.statistic == pytest.approx(r.statistic, rel=1e-6), check
            if check != "durbin_watson":
                assert mine.p_value == pytest.approx(r.p_value, abs=1e-8) and mine.passed == (r.p_value >= 0.05)
    for r in diagnostics.vif(res, ["m", "k"]).collect():
        assert got[r.symbol, f"vif_{r.regressor}"].statistic == pytest.approx(r.vif)
    for r in diagnostics.structural_break(res).collect():
        mine = got[r.symbol, "structural_break"]
        assert mine.statistic == r.position / 400 and mine.detail == pytest.approx(r.effect) and mine.passed == (not r.material)


def test_battery_on_what_cant_be_judged(spark):
    days = pd.bdate_range("2001-01-02", periods=30).date
    rows = [("flat", d, 0.0, float(i), 1.0) for i, d in enumerate(days)] + [("short", d, float(i % 3), float(i), 1.0) for i, d in enumerate(days[:19])] + [("own", d, math.sin(i * i), float(i) if i % 4 else None, 1.0) for i, d in enumerate(days)]
    df = spark.createDataFrame(rows, "symbol string, ts date, residual double, x double, one double")
    got = {(r.symbol, r.check): r for r in battery.report(df, ["x", "one"]).collect()}
    assert {s for s, _ in got} == {"flat", "own"}
    assert all((r.statistic, r.p_value, r.passed) == (0.0, None, None) for (s, _), r in got.items() if s == "flat")
    assert {c for s, c in got if s == "own"} == set(battery.CHECKS) - {"vif"}  # one regressor varies: nothing inflates
    assert got["own", "ljung_box"].lags == 6 and got["own", "jarque_bera"].passed is not None
    alone = {r.check for r in battery.report(df).collect()}
    assert alone == set(battery.CHECKS) - {"breusch_pagan", "white", "vif"}
    with pytest.raises(ValueError, match="need regressors"):
        battery.report(df, checks=["vif"])
    with pytest.raises(ValueError, match="unknown checks"):
        battery.report(df, checks=["nothing"])
    plan = battery.report(df.where("ts > '2000-01-01'"), ["x", "one"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("hashpartitioning(symbol") <= 3


@pytest.mark.parametrize("tasks", ["1", "7"])
def test_percentiles_whatever_the_ranges(spark, tasks):
    from marketloom.operators import telemetry

    rng = np.random.default_rng(5)
    rows = [("a", float(x)) for x in rng.exponential(size=997)] + [("b", float(x)) for x in rng.integers(0, 3, 400)] + [("c", 4.0), (None, 1.0), (None, 2.0), ("d", None)] + [("a", 0.5)] * 300
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", tasks)
    try:
        got = {r.k: tuple(r)[1:] for r in telemetry.percentiles(spark.createDataFrame(rows, "k string, v double"), "k", "v", {"p50": 0.5, "p95": 0.95, "p99": 0.99, "p0": 0.0, "p100": 1.0}).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert set(got) == {"a", "b", "c", None}
    for k in got:
        held = [v for q, v in rows if q == k]
        assert got[k] == pytest.approx(tuple(np.quantile(held, [0.5, 0.95, 0.99, 0.0, 1.0])))


def test_a_set_of_lags_is_each_of_them(spark):
    returns = walk(spark, 200)
    got = {(r.symbol, r.lags): (r.statistic, r.p_value) for r in efficiency.ljung_box_set(returns, [7, 1, 12, 7]).collect()}
    assert {k for _, k in got} == {1, 7, 12}
    for lags in (1, 7, 12):
        for r in efficiency.ljung_box(returns, lags).collect():
            assert got[r.symbol, lags] == pytest.approx((r.statistic, r.p_value), rel=1e-9)
    with pytest.raises(ValueError):
        efficiency.ljung_box_set(returns, [0])


def test_near_pairs_are_all_and_few_are_compared(spark):
    rng = np.random.default_rng(8)
    x = np.concatenate([rng.normal(size=598), [0.0, 0.0]])
    eps = 1.5 * x.std(ddof=1)
    for m in (2, 3):
        points = np.column_stack([x[k : len(x) - m + 1 + k] for k in range(m)]) / eps
        want = int((np.abs(points[:, None] - points[None]).max(2) < 1).sum() - len(points)) // 2
        df = spark.createDataFrame([("s", 600, *map(float, p)) for p in points], "symbol string, n long, " + ", ".join(f"u{k} double" for k in range(m)))
        for fine in (None, 1, 5):
            pairs, compared = efficiency.near_pairs(df, m, fine)
            assert pairs.first().pairs == want
            if fine is None:
                assert compared.count() < len(points) ** 2 / 2 * (0.2 if m == 2 else 0.35)
