import datetime as dt
import math
import re

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_operators import DAY, one, series

from marketloom import queries_data
from marketloom.functions import distributions as dist
from marketloom.operators import charts, diagnostics, efficiency, events, gates, multivariate, pricing, regimes, telemetry, text
from marketloom.operators.gram import ols
from marketloom.sources import panel, store, upload
from marketloom.streaming.metrics import to_parquet, windowed


def test_tails_as_columns(spark):
    rows = spark.createDataFrame([(float(z),) for z in (0, 0.5, -1.96, 2.99, 3.01, 8)], "z double")
    got = rows.select("z", dist.normal_p(F.col("z")), dist.normal_cdf(F.col("z")), *[dist.chi2_p(F.abs("z"), k) for k in (1, 2, 3, 10)], dist.kolmogorov_p(F.abs("z"))).collect()
    for z, p, cdf, *rest in got:
        assert p == pytest.approx(2 * dist.normal_sf(abs(z)), rel=1e-9) and cdf == pytest.approx(1 - dist.normal_sf(z), abs=1e-12)
        assert rest == pytest.approx([*[dist.chi2_sf(abs(z), k) for k in (1, 2, 3, 10)], dist.kolmogorov_sf(abs(z))], rel=1e-9)
    p = spark.createDataFrame([(x,) for x in (1e-4, 0.01, 0.3, 0.5, 0.975)], "p double")
    assert [r[0] for r in p.select(dist.normal_quantile(F.col("p"))).collect()] == pytest.approx([dist.normal_ppf(x) for x in (1e-4, 0.01, 0.3, 0.5, 0.975)], abs=1e-7)
    assert dist.t_ppf(0.975, 10) == pytest.approx(2.2281388519649385)


@pytest.mark.parametrize(("trend", "n"), [("n", 1), ("c", 1), ("c", 2), ("c", 3), ("ct", 1)])
def test_critical_values_have_their_p_values(trend, n):
    for (value, *_), p in zip(dist.CRITICAL[trend, n], (0.01, 0.05, 0.1), strict=True):
        assert dist.unit_root_sf(value, trend, n) == pytest.approx(p, rel=0.06)


@pytest.mark.parametrize("k", [2, 3])
def test_residuals_of_independent_walks_are_rejected_in_a_twentieth_of_cases(k):
    g, n, runs, hits = np.random.default_rng(3), 300, 3000, 0
    for _ in range(runs):
        w = np.cumsum(g.normal(size=(n, k)), axis=0)
        x = np.column_stack([np.ones(n), w[:, 1:]])
        e = w[:, 0] - x @ np.linalg.lstsq(x, w[:, 0], rcond=None)[0]
        d, y = np.diff(e), e[:-1]
        b = d @ y / (y @ y)
        t = b / math.sqrt(((d - b * y) ** 2).sum() / (len(d) - 1) / (y @ y))
        hits += dist.unit_root_sf(t, "c", k) < 0.05
    assert 0.04 <= hits / runs <= 0.06


def test_unit_root_options(spark):
    e = np.random.default_rng(5).normal(size=600)
    walk, still = np.cumsum(e), np.zeros(600)
    for i in range(1, 600):
        still[i] = 0.5 * still[i - 1] + e[i]
    trended = still + 0.1 * np.arange(600)
    df = series(spark, {"value": walk}, "walk").union(series(spark, {"value": still}, "still")).union(series(spark, {"value": trended}, "trended"))
    for trend, want in {"n": {"still"}, "c": {"still"}, "ct": {"still", "trended"}}.items():
        for found in (efficiency.adf(df, 3, trend=trend), efficiency.phillips_perron(df, 5, trend=trend)):
            assert {r.symbol for r in found.where("passed").collect()} == want
    assert {r.symbol for r in efficiency.kpss(df, 12, trend="ct").where("passed").collect()} == {"still", "trended"}
    assert {r.symbol: r.passed for r in efficiency.kpss(df, 12).where("symbol <> 'walk'").collect()} == {"still": True, "trended": False}
    own = efficiency.adf(df.union(series(spark, {"value": still[:100]}, "short"))).collect()
    assert {r.symbol: r.lags for r in own} == {s: efficiency.schwert(n) for s, n in (("walk", 600), ("still", 600), ("trended", 600), ("short", 100))}
    with pytest.raises(ValueError, match="trend"):
        efficiency.adf(df, 1, trend="ctt")


def test_engle_granger_tells_cointegrated_series(spark):
    g = np.random.default_rng(8)
    x, z = np.cumsum(g.normal(size=500)), np.cumsum(g.normal(size=500))
    w = series(spark, {"x": x, "y": 1.5 * x + g.normal(size=500), "z": z}).drop("symbol")
    assert one(multivariate.engle_granger(w, "y", ["x"], 1))["passed"] and not one(multivariate.engle_granger(w, "z", ["x"], 1))["passed"]


def test_least_squares_does_not_cancel_far_from_zero(spark):
    g = np.random.default_rng(9)
    x = 1e8 + g.normal(size=300)
    y = 3 * (x - 1e8) + 1e7 + g.normal(size=300)
    fit = {r.term: r for r in ols(series(spark, {"y": y, "x": x}), "y", ["x"], ["symbol"]).collect()}
    b = np.cov(x, y)[0, 1] / np.var(x, ddof=1)
    assert fit["x"].estimate == pytest.approx(b, rel=1e-7) and fit["x"].p_value < 1e-9
    assert ols(series(spark, {"y": y, "x": np.full(300, 1e8)}), "y", ["x"], ["symbol"]).count() == 0
    assert {r.regressor: round(r.vif, 6) for r in diagnostics.vif(series(spark, {"x": g.normal(size=50), "w": np.arange(50) % 7}), ["x", "w"]).collect()}.keys() == {"x", "w"}


def test_intervals_of_capm(spark):
    g = np.random.default_rng(1)
    m = g.normal(0, 0.01, 300)
    fit = pricing.capm(series(spark, {"r": 1.2 * m + g.normal(0, 0.004, 300), "m": m}))
    row, ends = one(fit), {r.term: r for r in pricing.capm_intervals(fit).collect()}
    q = dist.t_ppf(0.975, 298)
    assert ends["beta"].ci_low == pytest.approx(row["beta"] - q * row["beta_se"]) and row["beta_p"] < 1e-9
    assert (row["alpha_p"] > 0.05) == (ends["alpha"].ci_low < 0 < ends["alpha"].ci_high)


def test_event_study_finds_an_injected_effect(spark):
    g = np.random.default_rng(11)
    m = g.normal(4e-4, 0.01, 600)
    r = 1.1 * m + g.normal(0, 0.002, 600)
    r[400] += 0.02
    df = series(spark, {"r": r, "m": m})
    days = [400, 450, 20]
    named = spark.createDataFrame([("S", DAY + dt.timedelta(days=i)) for i in days] + [("S", DAY - dt.timedelta(days=9))] + [("S", DAY + dt.timedelta(days=450))], "symbol string, event date")
    got = {(x.event - DAY).days: x for x in events.event_study(df, named, before=2, after=2).collect()}
    assert set(got) == {400, 450} and got[400].car == pytest.approx(0.02, abs=0.01) and got[400].passed and not got[450].passed
    why = {(x.event - DAY).days: x.reason for x in events.unusable_events(df, named).collect()}
    assert why == {20: "too early", -9: "no such date", 450: "named twice"}
    path = {x.day: x for x in events.average_path(df, named, before=2, after=2).collect()}
    assert list(sorted(path)) == [-2, -1, 0, 1, 2] and path[2].caar == pytest.approx((got[400].car + got[450].car) / 2)
    mean = one(events.average_effect(events.event_study(df, named, before=2, after=2)))
    assert mean["events"] == 2 and mean["caar"] == pytest.approx(path[2].caar)


def test_percentiles_are_exact_and_skip_nulls(spark):
    g = np.random.default_rng(2)
    values = {"many": np.round(g.lognormal(size=50_000), 4), "ties": g.integers(0, 3, 30_000).astype(float), "few": np.arange(1.0, 101)}
    rows = [(k, float(v)) for k, x in values.items() for v in x] + [("few", None)]
    got = {r.k: r for r in telemetry.percentiles(spark.createDataFrame(rows, "k string, v double"), "k", "v", {"p50": 0.5, "p95": 0.95, "p99": 0.99}).collect()}
    for k, x in values.items():
        assert [got[k].p50, got[k].p95, got[k].p99] == pytest.approx(list(np.percentile(x, [50, 95, 99])))
    assert one(telemetry.rate(spark.createDataFrame([("x",)], "k string"), F.col("k") == "y", F.lit(True), "failed"))["failed"] is None


def test_store(spark):
    rows = spark.createDataFrame([("a", 1, "S", "price", 1.0), ("a", 2, "S", "volume", 9.0), ("b", 1, "T", "volume", 5.0)], "dataset_id string, ts int, symbol string, field string, value double")
    once = store.appended(rows, rows.withColumn("value", F.lit(0.0)), store.KEY)
    assert sorted(once.collect()) == sorted(rows.collect())
    again = store.replaced(rows, rows.where("dataset_id = 'a' and ts = 1"))
    assert sorted((r.dataset_id, r.ts) for r in again.collect()) == [("a", 1), ("b", 1)]
    assert sorted(r.field for r in store.preferred(rows).collect()) == ["price", "volume"]
    chain = spark.createDataFrame([(i, i - 1 if i % 10 else None) for i in range(40)] + [(99, 77)], "id int, parent int")
    assert {(r.id, r.root, r.depth) for r in store.roots(chain, "id", "parent").collect()} == {(i, i - i % 10, i % 10) for i in range(40)} | {(99, 99, 0)}
    digest = lambda df: one(store.fingerprint(df, ["ts", "value"], ["dataset_id"]).where("dataset_id = 'a'"))["digest"]
    assert digest(rows) == digest(rows.orderBy(F.desc("ts"))) != digest(rows.withColumn("value", F.col("value") + 1))
    same = store.reproduced(rows.select("symbol", "ts", "value"), rows.where("ts = 1").select("symbol", "ts", (F.col("value") + (F.col("symbol") == "T").cast("int")).alias("value")), ["symbol", "ts"])
    assert {(r.symbol, r.ts): r.detail for r in same.collect()} == {("S", 1): "", ("S", 2): "missing now", ("T", 1): "the numbers differ"}
    with pytest.raises(ValueError):
        store.in_range(rows, "2020-01-02", "2020-01-01")


def test_stored_datasets_replace_their_own(spark, tmp_path):
    rows = spark.createDataFrame([("a", 1), ("b", 2)], "dataset_id string, value int")
    store.write_observations(rows, f"{tmp_path}/o")
    store.write_observations(rows.where("dataset_id = 'b'").withColumn("value", F.lit(7)), f"{tmp_path}/o")
    assert {(r.dataset_id, r.value) for r in spark.read.parquet(f"{tmp_path}/o").collect()} == {("a", 1), ("b", 7)}


def test_csv_uploads(spark, tmp_path):
    (tmp_path / "long.csv").write_text("﻿Date;Symbol;Adj Close\n2024-01-02;AAPL;1.234,50\n2024-01-03;AAPL;1.240,00\n2024-01-02;MSFT;99,5\n2024-01-03;MSFT;98,25\n")
    df, delimiter = upload.read_csv(spark, str(tmp_path / "long.csv"))
    p = upload.profile(df, delimiter)
    assert delimiter == ";" and {r.column: (r.kind, r.decimal_comma) for r in p.collect()} == {"Date": ("datetime", False), "Symbol": ("text", False), "Adj Close": ("number", True)}
    assert {r.column: (r.role, r.ambiguous) for r in upload.proposed(upload.scores(p)).collect()} == {"Date": ("date", False), "Symbol": ("ticker", False), "Adj Close": ("price", False)}
    for name, content, why in (("empty", "", "empty"), ("one", "price\n1\n", "one column"), ("bare", "a,b\n", "no rows"), ("title", "Prices,,,\ndate,a,b,c\n1,2,3,4\n", "header")):
        (tmp_path / f"{name}.csv").write_text(content)
        with pytest.raises(ValueError, match=why):
            upload.read_csv(spark, str(tmp_path / f"{name}.csv"))
    x = spark.createDataFrame([("1,200",), ("-3,400,500",), ("x",)], "t string")
    assert [r[0] for r in x.select(upload.number(F.col("t"))).collect()] == [1200.0, -3400500.0, None]
    assert [r[0] for r in x.select(upload.number(F.col("t"), True)).collect()] == [1.2, None, None]


def test_profiles_keep_medians_by_column_and_read_days_once_a_value(spark):
    rows = [(i, f"{i % 3 + 1}/{i % 28 + 1}/2020", "n/a" if i % 4 else "5 May 2020", None if i % 5 else "1,200", "x" * 50 if i % 2 else "7 up", " 1e3") for i in range(300)]
    df = spark.createDataFrame(rows, "id long, day string, some string, few string, words string, plain string")
    p = upload.profile(df)
    plan = p._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"ObjectHashAggregate\(keys=\[column#\d+, ", plan) and "SortAggregate(key=[column#" not in plan  # a median for each value
    got = {r.column: r for r in p.collect()}
    assert {c: (r.rows, r.nulls, r.distinct_values, r.date_share, r.kind) for c, r in got.items()} == {
        "id": (300, 0, 300, 0.0, "number"), "day": (300, 0, len({r[1] for r in rows}), 1.0, "datetime"), "some": (300, 0, 2, 0.25, "text"),
        "few": (300, 240, 1, 0.0, "number"), "words": (300, 0, 2, 0.0, "text"), "plain": (300, 0, 1, 0.0, "number"),
    }
    assert (got["id"].least, got["id"].greatest, got["id"].mean, got["id"].size, got["few"].size, got["plain"].mean) == (0.0, 299.0, 149.5, 149.0, 1200.0, 1000.0)
    assert not any(r.decimal_comma for r in got.values())


def test_days_in_all_forms_and_beyond_reach(spark):
    read = {"1/13/2020": "2020-01-13", "13/1/2020": "2020-01-13", "31/2/2020": None, "2020/1/13": "2020-01-13", "13.1.2020": "2020-01-13", "13-1-2020": "2020-01-13", "jan 13, 2020": "2020-01-13",
            "January 13, 2020": "2020-01-13", "13 May 2020": "2020-05-13", "13 August 2020": "2020-08-13", "1/13/2020 3:04": "2020-01-13", "1/13/2020 23:04:05": "2020-01-13", "13.1.2020 3:04": "2020-01-13",
            "13.1.2020 3:04:05": "2020-01-13", " 2020-01-13 04:00 ": "2020-01-13", "1/1/+1000000": None, "1/13/2020 24:00": None, "1.234,50": None, "n/a": None, "a " * 9999 + "1": None}
    rows = spark.createDataFrame([(t,) for t in read], "t string").select("t", upload.day(F.col("t")).cast("string").alias("d")).collect()
    assert {r.t: r.d for r in rows} == read


def test_profiles_cast_only_what_can_be_read(spark):
    read = ["1", "-1.", "+.5", "1e5", "1.5E-3", "1d", "2.5F", "0x1.8p3", "0X.8P-1d", "NaN", "-NaN", "inf", "+Infinity", " \t12 \n", "1e400", "007"]
    others = ["1-URGENT", "5-LOW", "1998-02-06 00:00:00", "1/13/2020", "1.234,50", "1,200", "1.2.3", "1e", "e5", ".", "", "-", "0x1", "1L", "1_000", "n/a", "info", "Nordic", "12 5", "7 up", "\u0661"]
    rows = spark.createDataFrame([(t,) for t in [*read, *others, None]], "t string")
    got = rows.select("t", F.col("t").rlike(upload.DOUBLE).alias("tried"), F.col("t").try_cast("double").alias("cast"), upload.double(F.col("t")).alias("double")).collect()
    assert {r.t for r in got if r.cast is not None} == {r.t for r in got if r.double is not None} == {r.t for r in got if r.tried} == set(read)
    assert all(r.double == r.cast or r.cast != r.cast for r in got)


def test_mapping_profiles_an_upload_once(spark, tmp_path):
    spark.createDataFrame([("2024-01-02", "1,5", "x")] * 30, "date string, close string, note string").write.option("header", True).option("sep", ";").csv(f"{tmp_path}/u")
    df, delimiter = upload.read_csv(spark, f"{tmp_path}/u")
    p = upload.profile(df, delimiter)
    once = len(re.findall("Scan csv", p._jdf.queryExecution().executedPlan().toString()))
    for found in (upload.roles(p), upload.with_roles(p)):
        assert len(re.findall("Scan csv", found._jdf.queryExecution().executedPlan().toString())) == once
        assert {r.column: r.role for r in found.collect()} == {"date": "date", "close": "price", "note": "ticker"}
    assert upload.decimal_commas(df, ["close", "note"], delimiter) == ["close"]


def test_mapping_takes_decimal_commas_from_the_profile(spark, tmp_path, monkeypatch):
    rows = [("2024-01-02", "1.234,5", "1,5" if i else "x", "1,200", None) for i in range(30)]
    spark.createDataFrame(rows, "date string, close string, some string, high string, none string").write.option("header", True).option("sep", ";").csv(f"{tmp_path}/u")
    df, delimiter = upload.read_csv(spark, f"{tmp_path}/u")
    found = upload.roles(upload.profile(df, delimiter)).collect()
    commas = [r["column"] for r in found if r["decimal_comma"]]
    assert sorted(commas) == sorted(upload.decimal_commas(df, ["close", "some", "high", "none"], delimiter)) == ["close", "high"]
    chosen = {"date": "date", "close": "price"}
    counted = upload.mapped(df, chosen, delimiter).collect()
    monkeypatch.setattr(upload, "decimal_commas", None)  # would read the file again
    assert upload.mapped(df, chosen, delimiter, commas).collect() == counted and {r.value for r in counted} == {1234.5}
    assert queries_data.upload_european(spark, "/root/testdata/sf0.001").count() > 0


def test_mappings_are_confirmed(spark):
    columns = ["d", "s", "p"]
    assert upload.confirmed(columns, {"d": "date", "p": "price"}) == {"d": "date", "s": "ignore", "p": "price"}
    for wrong in ({"p": "price"}, {"d": "date"}, {"d": "date", "s": "date", "p": "price"}, {"d": "date", "x": "price"}):
        with pytest.raises(ValueError):
            upload.confirmed(columns, wrong)
    shaped = spark.createDataFrame([(f"c{i}", 0.01 * (-1) ** i, 10_000.0 + i, 50.0 + i / 3) for i in range(40)], "note string, spread double, size double, px double")
    found = {}
    for r in upload.scores(upload.profile(shaped)).collect():
        found.setdefault(r.column, {})[r.role] = r.score
    assert found == {"note": {"ignore": 1.0}, "spread": {"return": 0.85, "factor": 0.4}, "size": {"volume": 0.7, "price": 0.6}, "px": {"price": 0.6}}
    assert {r.column for r in upload.proposed(upload.scores(upload.profile(shaped))).where("ambiguous").collect()} == {"spread", "size"}


def test_steward_flags(spark):
    a = series(spark, {"value": [1.0 + i for i in range(60)]}, "A")
    b = series(spark, {"value": [1.0 + i for i in range(60)]}, "B").withColumn("ts", F.date_add("ts", 10))
    codes = lambda df, end=100, **k: sorted(r.code for r in panel.steward_flags(df, str(DAY), str(DAY + dt.timedelta(days=end)), **k).collect())
    assert codes(a) == [] and codes(a.union(b)) == ["calendar_misalignment"] and codes(a.limit(20)) == ["short_sample"]
    assert codes(a, 40) == ["look_ahead"]
    assert codes(a.withColumn("ts", F.date_add("ts", 31))) == ["late_start"]
    rf = a.where("value <= 50").select("ts", F.col("value").alias("mkt"), F.col("value").alias("rf"))
    assert codes(a, factors=rf, risk_free="DGS3MO") == ["factor_coverage", "mixed_risk_free"]
    made = spark.createDataFrame([("A", "synthetic walk"), ("B", "file")], "symbol string, source string")
    assert codes(a, sources=made) == ["mixed_sources", "synthetic_data"]


def test_rates_and_logs(spark):
    x = spark.createDataFrame([(5.0,), (-0.5,)], "pct double")
    assert [r[0] for r in x.select(panel.period_rate(F.col("pct"), "DGS10", 12)).collect()] == pytest.approx([1.05 ** (1 / 12) - 1, 0.995 ** (1 / 12) - 1])
    with pytest.raises(ValueError, match="convention"):
        panel.period_rate(F.col("pct"), "LIBOR", 12)
    with pytest.raises(Exception, match="positive"):
        panel.transformed(series(spark, {"value": [1.0, -1.0]}), "log").collect()


def test_passages_keep_every_sentence(spark):
    g = np.random.default_rng(4)
    sentences = [" ".join(["word"] * int(g.integers(3, 60))) + f" {i}." for i in range(80)]
    docs = spark.createDataFrame([(1, " ".join(sentences)), (2, None), (3, " "), (4, "One 1.8100 only.")], "doc_id long, text string")
    rows = text.passages(docs, 400, 100).orderBy("doc_id", "ordinal").collect()
    mine = [re.split(r"(?<=[.!?])\s+", r.text) for r in rows if r.doc_id == 1]
    assert [s for i, p in enumerate(mine) for s in p if i == 0 or s not in mine[i - 1]] == sentences
    assert all(len(r.text) <= 400 or len(re.split(r"(?<=\.)\s", r.text)) == 1 for r in rows) and rows[-1].text == "One 1.8100 only."
    for a, b in zip(mine, mine[1:], strict=False):
        shared = [s for s in b if s in a]
        assert len(" ".join(shared)) <= 100 and a[len(a) - len(shared) :] == shared


def test_grounding(spark):
    said = {1: "Beta is 1.24 and the share 83%.", 2: "See table 7, GARCH(1,1) since 2008.", 3: "Beta is 1.25; growth was 17%, size 1,200."}
    docs = spark.createDataFrame([*said.items()], "doc_id int, text string")
    got = {r.doc_id: (r.checked, r.unsupported) for r in text.grounded(docs, spark.createDataFrame([(1.2381,), (0.8304,), (1200.0,)], "value double")).collect()}
    assert got[1] == (2, 0) and got[3] == (3, 2) and got.get(2, (0, 0))[0] <= 1


def test_grounding_reads_texts_once_and_long_words_in_one_pass(spark):
    said = ["Beta 1.24, 5abc 6", "a1b2 c(3) d  4%", "x" * 200_000 + " 7 and 8", "of 1,234,567.5e-3% in\n2008 in 2008.5", "no number", None, "1e5x 7 +-3 --4 e5", "é 5 éa 6 _b 7", "sum(12 a  (3", "a\t\x0b9"]
    docs = spark.createDataFrame(list(enumerate(said)), "doc_id int, text string")
    plain = []
    for i, t in enumerate(said):
        t = t.replace("x" * 200_000, "x") if t else ""
        plain += [(i, n, re.sub(r"[\s(]+$", "", m[1] or "").lower(), m[2]) for n, m in enumerate(re.finditer(text.CITED, t, re.ASCII)) if not (m[1] or "").endswith("(")]
    dated = [x for x in plain if not (x[2] == "in" and x[3] == "2008")]
    got = [(r.doc_id, r.place, "x" if len(r.word) > 9 else r.word, r.cited) for r in text.cited_numbers(docs).orderBy("doc_id", "place").collect()]
    assert got == dated and len(got) > 15
    grounded = text.grounded(docs.union(docs.where("doc_id = 2")), spark.createDataFrame([(7.0,), (0.04,)], "value double"))
    assert {r.doc_id: (r.checked, r.unsupported) for r in grounded.collect() if r.doc_id in (1, 2)} == {1: (3, 2), 2: (4, 2)}
    plan = grounded._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all") == 1


def test_gates(spark):
    g, v, out = np.random.default_rng(4), 1.0, []
    for z in g.normal(size=1500):
        out.append(z * math.sqrt(v))
        v = 0.05 + 0.2 * out[-1] ** 2 + 0.75 * v
    df = series(spark, {"r": out}, "arch").union(series(spark, {"r": g.normal(size=1500)}, "plain"))
    found = {r.symbol: (r.present, r.allowed) for r in gates.allowed(gates.arch_effects(df), "garch").collect()}
    assert found == {"arch": (True, True), "plain": (False, False)}
    levels = series(spark, {"value": np.cumsum(out)})
    verdict = gates.stationarity(levels, lags=2)
    assert one(gates.allowed(verdict, "vecm"))["allowed"] and not one(gates.allowed(verdict, "var_model"))["allowed"]
    unjudged = verdict.withColumn("present", F.lit(None).cast("boolean"))
    assert one(gates.allowed(unjudged, "var_model"))["allowed"]


def test_regimes_are_recovered(spark):
    g, state, out, truth = np.random.default_rng(6), 0, [], []
    for _ in range(1500):
        state = state if g.random() < (0.97, 0.95)[state] else 1 - state
        truth.append(state)
        out.append(g.normal((0.5, -1.0)[state], (0.5, 2.0)[state]))
    df = series(spark, {"r": out})
    low, high = regimes.markov_switching(df).orderBy("regime").collect()
    assert low.mean == pytest.approx(0.5, abs=0.1) and high.mean == pytest.approx(-1.0, abs=0.4) and high.variance == pytest.approx(4, rel=0.3)
    assert low.to_0 == pytest.approx(0.97, abs=0.02) and low.to_0 + low.to_1 == pytest.approx(1) and low.duration == pytest.approx(1 / (1 - low.to_0))
    path = [r.regime for r in regimes.regime_path(df).orderBy("ts").collect()]
    assert np.mean(np.array(path) == truth) > 0.9
    with pytest.raises(ValueError):
        regimes.markov_switching(df, 5)


def test_charts(spark):
    s = series(spark, {"r": [float(i) for i in range(100)] + [None]})
    bins = charts.histogram(s, "r", 10).orderBy("bin").collect()
    assert [b.n for b in bins] == [10] * 10 and bins[0].low == 0 and bins[-1].high == pytest.approx(99)
    assert [b.n for b in charts.histogram(series(spark, {"r": [2.0] * 9}), "r", 10).collect()] == [9]
    points = charts.quantile_points(s, "r").orderBy("i").collect()
    assert points[49].theoretical == pytest.approx(-points[50].theoretical) and points[0].theoretical == pytest.approx(dist.normal_ppf(0.005), abs=1e-6)


def test_event_stream_gives_what_the_table_gives(spark, tmp_path):
    start = dt.datetime(2024, 1, 1)
    rows = [(start + dt.timedelta(minutes=17 * i), "ab"[i % 2], float(i)) for i in range(200)]
    events_ = spark.createDataFrame(rows, "ts timestamp, event_type string, value double")
    events_.write.parquet(f"{tmp_path}/in")
    query = to_parquet(windowed(spark.readStream.schema(events_.schema).parquet(f"{tmp_path}/in")), f"{tmp_path}/out", f"{tmp_path}/checkpoint")
    query.awaitTermination(120)
    got = sorted(spark.read.parquet(f"{tmp_path}/out").collect())
    whole = sorted(windowed(events_).collect())
    assert got and set(got) <= set(whole) and whole[: len(got) // 2] == got[: len(got) // 2]
