"""Factor files, price cache, documents, exports, uploads, plans, claims."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from marketloom.operators import claims, layers
from marketloom.sources import documents, exports, factor_files, price_cache, upload

HEAD = "This file was created by hand, 1926 to now.\nMissing data are indicated by -99.99 or -999.\n\n"
MONTHLY = ",Mkt-RF,SMB,HML,RF\n192607,    2.96,   -2.56,   -2.43,    0.22\n192608,    2.64,  -99.99,    3.82,    0.25\n192609,   -999,   -1.40,    0.13,    0.23\n"
ANNUAL = "\n  Annual Factors: January-December \n,Mkt-RF,SMB,HML,RF\n  1927,   29.47,   -2.04,   -4.54,    3.12\n\nCopyright 2026\n"


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "F-F_Research_Data_Factors.csv").write_text(HEAD + MONTHLY + ANNUAL)
    (tmp_path / "F-F_Momentum_Factor.csv").write_text(HEAD + ",Mom\n192608,  1.00\n192609,  -2.00\n")
    days = "".join(f"200001{d:02d}, 1.00, 0.00, 0.50, 0.01\n" for d in (3, 4, 5, 6, 7, 10))
    (tmp_path / "F-F_Research_Data_Factors_daily.csv").write_text(HEAD + ",Mkt-RF,SMB,HML,RF\n" + days)
    return tmp_path


def test_factor_files_by_sections(spark, folder):
    path = f"{folder}/F-F_Research_Data_Factors.csv"
    monthly = factor_files.read_factors(spark, path)
    assert [tuple(r)[1:] for r in monthly.orderBy("ts").collect()] == [
        (dt.date(1926, 7, 31), 0.0296, -0.0256, pytest.approx(-0.0243), 0.0022), (dt.date(1926, 8, 31), 0.0264, None, pytest.approx(0.0382), 0.0025), (dt.date(1926, 9, 30), None, pytest.approx(-0.014), 0.0013, 0.0023)]
    assert [(r.ts, r["Mkt-RF"]) for r in factor_files.read_factors(spark, path, "annual").collect()] == [(dt.date(1927, 12, 31), pytest.approx(0.2947))]
    with pytest.raises(Exception, match="no section with daily"):
        factor_files.read_factors(spark, path, "daily").collect()


def test_bounds_reach_the_reader(spark, folder):
    rows = factor_files.read_factors(spark, f"file://{folder}/F-F_Research_Data_Factors.csv", start="1926-08-01", end="1926-08-31")
    assert [r.ts for r in rows.collect()] == [dt.date(1926, 8, 31)]
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "Filter" not in plan.replace("PushedFilters", "").replace("PythonFilter", "") or "ts" in plan.split("PushedFilters", 1)[-1]
    reader = factor_files.FactorReader(str(folder), 6, ["RF"])
    from pyspark.sql.datasource import GreaterThan, LessThanOrEqual

    assert list(reader.pushFilters([GreaterThan(("ts",), dt.date(1926, 7, 31)), LessThanOrEqual(("ts",), dt.date(1926, 8, 31)), GreaterThan(("RF",), 0.0)])) == [GreaterThan(("RF",), 0.0)]
    parts = reader.partitions()
    assert len(parts) == 3 and sum(len(list(reader.read(p))) for p in parts) == 2  # the month of two files
    assert factor_files.read_factors(spark, str(folder)).where("file like '%Momentum%'").count() == 2


def test_factor_sets(spark, folder):
    rows = factor_files.factor_set(spark, str(folder), "carhart4", "1926-01-01", "1927-12-31", "M").orderBy("ts").collect()
    assert [r.asDict() for r in rows] == [{"ts": dt.date(1926, 8, 31), "mkt_rf": 0.0264, "smb": None, "hml": pytest.approx(0.0382), "mom": 0.01, "rf": 0.0025}, {"ts": dt.date(1926, 9, 30), "mkt_rf": None, "smb": pytest.approx(-0.014), "hml": 0.0013, "mom": -0.02, "rf": 0.0023}]
    quarter = factor_files.factor_set(spark, str(folder), "ff3", "1926-01-01", "1927-12-31", "Q").first()
    assert quarter.ts == dt.date(1926, 9, 30) and quarter.rf == pytest.approx(1.0022 * 1.0025 * 1.0023 - 1)
    weeks = factor_files.factor_set(spark, str(folder), "ff3", "2000-01-01", "2000-01-31", "W").orderBy("ts").collect()
    assert [(r.ts, round(r.mkt_rf, 9)) for r in weeks] == [(dt.date(2000, 1, 9), round(1.01**5 - 1, 9)), (dt.date(2000, 1, 16), 0.01)]
    for args, why in ((("ff9", "2000-01-01", "2001-01-01"), "unknown set"), (("ff3", "2001-01-01", "2000-01-01"), "is empty"), (("ff3", "1990-01-01", "1991-01-01"), "nothing from")):
        with pytest.raises(ValueError, match=why):
            factor_files.factor_set(spark, str(folder), *args)


REQUEST = "symbol string, low date, high date"


def day(n):
    return dt.date(2020, 1, 1) + dt.timedelta(days=n)


def test_price_cache(spark, tmp_path):
    cache, asked = price_cache.PriceCache(spark, str(tmp_path / "cache")), []

    def fetch(wanted):
        asked.append(sorted((r.symbol, r.low, r.high) for r in wanted.collect()))
        return wanted.select("symbol", F.explode(F.sequence("low", "high")).alias("ts"), F.lit(1.5).alias("value")).distinct()

    def get(rows, now, source=fetch):
        return cache.prices(spark.createDataFrame(rows, REQUEST), source, now).count()

    assert get([("^A", day(0), day(9)), ("_A", day(0), day(9))], "2020-02-01 00:00:00") == 20 and len(asked) == 1
    assert get([("^A", day(2), day(5)), ("^A", day(2), day(5))], "2020-02-01 12:00:00") == 4 and len(asked) == 1  # within, asked for twice
    assert get([("^A", day(5), day(12)), ("_A", day(0), day(9))], "2020-02-01 12:00:00") == 18 and asked[-1] == [("^A", day(5), day(12))]
    assert get([("_A", day(0), day(9))], "2020-02-03 00:00:00") == 10 and asked[-1] == [("_A", day(0), day(9))]  # too old: anew

    def down(wanted):
        raise ConnectionError("no route")

    with pytest.raises(RuntimeError, match="no route.*too old to serve"):
        get([("^A", day(2), day(5))], "2020-03-01 00:00:00", down)
    with pytest.raises(RuntimeError, match="nothing is kept"):
        get([("B", day(2), day(5))], "2020-03-01 00:00:00", down)
    broken = F.udf(lambda x: 1 / 0, "double")
    with pytest.raises(RuntimeError):  # fails while it writes: the manifest stays as it was
        get([("B", day(2), day(5))], "2020-03-01 00:00:00", lambda w: fetch(w).withColumn("value", broken("value")))
    assert cache.manifest().where("symbol = 'B'").count() == 0
    assert get([("B", day(2), day(5))], "2020-03-01 00:00:00") == 4


def test_windows_of_the_cache(spark):
    now = "2020-02-01 00:00:00"
    fresh, old = dt.datetime(2020, 1, 31, 12), dt.datetime(2020, 1, 1)
    held = [("a", "S", day(0), day(5), fresh), ("b", "S", day(6), day(9), fresh), ("c", "S", day(20), day(30), fresh), ("d", "S", day(10), day(19), old), ("e", "T", day(0), day(99), old)]
    manifest = spark.createDataFrame(held, price_cache.MANIFEST)
    asked = spark.createDataFrame([("S", day(0), day(5)), ("S", day(1), day(9)), ("S", day(8), day(25)), ("S", day(12), day(15)), ("T", day(3), day(4)), ("U", day(0), day(1)), ("S", day(40), day(41))], REQUEST)
    got = {(r.symbol, r.low): (r.verdict, r.entry) for r in price_cache.coverage(asked, manifest, now).collect()}
    assert got == {("S", day(0)): ("hit", "a"), ("S", day(1)): ("missing", None), ("S", day(8)): ("missing", None), ("S", day(12)): ("stale", None), ("T", day(3)): ("stale", None), ("U", day(0)): ("missing", None), ("S", day(40)): ("missing", None)}
    assert sorted(tuple(r)[1:] for r in price_cache.islands(manifest, now).collect()) == [(day(0), day(9)), (day(20), day(30))]
    gaps = sorted((r.symbol, r.low, r.gap_low, r.gap_high) for r in price_cache.gaps(asked, manifest, now).collect())
    assert gaps == [("S", day(8), day(10), day(19)), ("S", day(12), day(12), day(15)), ("S", day(40), day(40), day(41)), ("T", day(3), day(3), day(4)), ("U", day(0), day(0), day(1))]
    with pytest.raises(Exception, match="ends before it begins"):
        price_cache.coverage(spark.createDataFrame([("S", day(3), day(2))], REQUEST), manifest, now).collect()


def test_documents_are_read_or_refused(spark, tmp_path):
    files = {"a.txt": b"one\r\ntwo\rthree\n", "b.MD": "﻿é".encode() + b"\xff\xfe end", "c.docx": b"PK", "d.text": b" \r\n ", "plain": b"x", "e.markdown": "ok 中".encode()}
    for name, data in files.items():
        (tmp_path / name).write_bytes(data)
    got = {r.name: (r.text, r.refused) for r in documents.read_documents(spark, str(tmp_path)).collect()}
    assert got == {
        "a.txt": ("one\ntwo\nthree\n", None), "b.MD": (files["b.MD"].decode("utf-8", "replace").lstrip("﻿"), None), "c.docx": (None, "can't index .docx"), "d.text": (None, "has no text to index"),
        "plain": (None, "can't index a file without a suffix"), "e.markdown": ("ok 中", None),
    }


def test_exports_are_whole_or_absent(spark, tmp_path):
    rows = spark.range(1000).select("id", F.concat(F.lit("a|b\n"), "id").alias("said"), F.when(F.col("id") % 7 > 0, F.col("id") / 2).alias("half")).repartition(3)
    for kind in exports.FORMATS:
        path = str(tmp_path / kind)
        exports.write_export(rows, path, kind, {"b": 1, "a": [2]})
        m = exports.read_manifest(spark, path)
        assert (m["rows"], m["columns"], m["params_hash"]) == (1000, ["id", "said", "half"], exports.params_hash('{"a":[2],"b":1}'))
        assert {r.as_written for r in exports.verified(spark, path).collect()} == {True} and not list((tmp_path / kind).glob("_staging*"))
    back = exports.read_export(spark, str(tmp_path / "json"), rows.schema)
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, rows.collect()))
    table = sorted((tmp_path / "markdown").glob("*.md"))[0].read_text().splitlines()
    assert table[:2] == ["| id | said | half |", "| --- | --- | --- |"] and "a\\|b " in table[2]
    with pytest.raises(Exception, match="holds an export already"):
        exports.write_export(rows, str(tmp_path / "json"))
    exports.write_export(rows.limit(10), str(tmp_path / "json"), overwrite=True)
    assert exports.read_export(spark, str(tmp_path / "json"), rows.schema).count() == 10 and len(list((tmp_path / "json").glob("part-*"))) == 1
    part = next((tmp_path / "json").glob("part-*"))
    part.write_text(part.read_text().replace('"id": ', '"id": 1'))
    with pytest.raises(ValueError, match="not as it was written"):
        exports.read_export(spark, str(tmp_path / "json"), rows.schema)
    fails = F.udf(lambda i: i if i < 900 else 1 / 0, "long")
    with pytest.raises(Exception):
        exports.write_export(rows.withColumn("id", fails("id")), str(tmp_path / "failed"))
    assert not list((tmp_path / "failed").glob("*.json*"))  # neither rows nor a manifest; a task that was still at work may leave its staging folder
    with pytest.raises(Exception, match="manifest"):
        exports.read_export(spark, str(tmp_path / "failed"), rows.schema)
    exports.write_export(rows.limit(0), str(tmp_path / "none"))
    assert exports.read_export(spark, str(tmp_path / "none"), rows.schema).count() == 0 and json.loads((tmp_path / "none" / "manifest.json").read_text())["rows"] == 0


def test_uploads_as_people_write_them(spark, tmp_path):
    lines = ["Datum;Wert;Name"] + [f"{d};{v};{n}" for d, v, n in (("01/31/2020", "1.210,5", "A"), ("31/01/2020", "2,5", "B"), ("2020-02-01", "-3", "A"), ("Feb 3, 2020", "1.000.000,25", "B"), ("4 Feb 2020", "", "A"), ("5.2.2020", "7,0", "B"), ("n/a", "8,0", "A"), ("2020/2/7", "x", "B"))]
    (tmp_path / "eu.csv").write_text("\n".join(lines))
    df, delimiter = upload.read_csv(spark, str(tmp_path / "eu.csv"))
    assert delimiter == ";" and upload.decimal_commas(df, ["Wert"], delimiter) == []  # x is no number
    clean = df.where("Wert <> 'x' or Wert is null")
    assert upload.decimal_commas(clean.where("Wert like '%,%'"), ["Wert"], ";") == ["Wert"]
    found = upload.observations(df, "Datum", {"Wert": "price"}, "Name", ["Wert"])
    assert sorted((r.ts, r.symbol, r.value) for r in found.collect()) == [(day(30), "A", 1210.5), (day(30), "B", 2.5), (day(31), "A", -3.0), (day(33), "B", 1000000.25), (day(35), "B", 7.0)]
    assert {r.column: (r.written, r.unread) for r in upload.unread(df, "Datum", {"Wert": "price"}, ["Wert"]).collect()} == {"Datum": (8, 1), "Wert": (7, 1)}
    mapped = upload.mapped(df.where("Wert like '%,%'"), {"Datum": "date", "Wert": "price", "Name": "ticker"}, delimiter)
    assert mapped.count() == 4
    (tmp_path / "quoted.csv").write_text('day,"value, in EUR",note\n2020-01-01,"1,234.50","a;b;c"\n2020-01-02,"2,000.00","d;e;f"\n')
    df, delimiter = upload.read_csv(spark, str(tmp_path / "quoted.csv"))
    assert delimiter == "," and df.columns == ["day", "value, in EUR", "note"]
    assert {r.column: r.kind for r in upload.profile(df, delimiter).collect()}["value, in EUR"] == "number"
    for name, content, why in (("book.xlsx", "PK", "is a xlsx file"), ("big.csv", "a,b\n" + "1,2\n" * 100, "has over 64 bytes"), ("twice.csv", "a,b,a\n1,2,3\n", "several columns named a")):
        (tmp_path / name).write_text(content)
        with pytest.raises(ValueError, match=why):
            upload.read_csv(spark, str(tmp_path / name), most_bytes=64)


STEPS, NEEDS = "plan string, step string, position int", "plan string, step string, need string"


def test_plans_run_in_order(spark):
    steps = [("p", s, i) for i, s in enumerate("dcba")] + [("q", "x", 0), ("q", "y", 1), ("r", "z", 0)]
    needs = [("p", "d", "a"), ("p", "d", "b"), ("p", "c", "a"), ("p", "c", "a"), ("p", "a", "elsewhere"), ("q", "x", "y"), ("nobody", "x", "y")]
    order = layers.run_order(spark.createDataFrame(steps, STEPS), spark.createDataFrame(needs, NEEDS)).orderBy("plan", "place").collect()
    assert [(r.plan, r.step, r.layer) for r in order] == [("p", "b", 0), ("p", "a", 0), ("p", "d", 1), ("p", "c", 1), ("q", "y", 0), ("q", "x", 1), ("r", "z", 0)]
    with pytest.raises(ValueError, match="cycle: q/x, q/y"):
        layers.run_order(spark.createDataFrame(steps, STEPS), spark.createDataFrame([*needs, ("q", "y", "x")], NEEDS))
    assert layers.run_order(spark.createDataFrame([], STEPS), spark.createDataFrame([], NEEDS)).count() == 0


def test_attempts_hang_from_the_one_before(spark):
    rows = [(1, i, a) for i, a in enumerate("ppnnnp")] + [(2, 0, "n")]
    got = layers.chained_attempts(spark.createDataFrame(rows, "run int, at int, agent string"), "run", "agent", "at").orderBy("run", "at").collect()
    assert [(r.attempt, r.parent_at, r.final) for r in got] == [(1, None, False), (2, 0, True), (1, 1, False), (2, 2, False), (3, 3, True), (1, 4, True), (1, None, True)]


PROSE = """1. The beta of 1.2977 is large (s3, s1, s7).
2) In 2008 it fell 5%, the statistic is 2008. Figure 2 shows it. Tables 3, 4 too.
A GARCH(1,1) fit and (1,1); returns rose 5%.
It is significant at the 5% level, with 0.31.
Log Returns (2020-2024) and 2019–2021 but 2020 1,234 and -2024.
1.5 was found\n3"""


def test_numbers_in_their_context(spark):
    docs = spark.createDataFrame([(1, PROSE), (2, None), (3, "")], "doc_id long, text string")
    got = [(r.cited, r.exempt) for r in claims.number_context(docs, ["S1", "s3"]).orderBy("line", "nth").collect()]
    assert got == [
        ("1", "list"), ("1.2977", None), ("3", "step"), ("1", "step"), ("7", None), ("2", "list"), ("2008", "year"), ("5%", None), ("2008", None), ("2", "reference"), ("3", "reference"), ("4", "reference"),
        ("1", None), ("1", None), ("5%", None), ("5%", "level"), ("0.31", None), ("2020", "year"), ("-2024", "year"), ("2019", "year"), ("2021", "year"), ("2020", None), ("1,234", None), ("-2024", None), ("1.5", None), ("3", None),
    ]
    allowed = spark.createDataFrame([(1.29774,), (0.05,), (1234.2,), (None,)], "value double")
    left = [r.cited for r in claims.unsupported(docs, allowed, ["s1", "s3"]).orderBy("line", "nth").collect()]
    assert left == ["7", "2008", "0.31", "2020", "-2024", "1.5", "3"]


def test_neighbours_in_scope_are_exact_and_most_is_skipped(spark, monkeypatch):
    import numpy as np

    from marketloom.operators import retrieval

    monkeypatch.setattr(retrieval, "BLOCK", 50)
    monkeypatch.setattr(retrieval, "ASKED", 7)
    rng = np.random.default_rng(3)
    middle = rng.normal(size=(25, 6))
    rows = [(i, [float(x) for x in middle[i % 25] + 0.05 * rng.normal(size=6)], f"p{i % 2}", None if i % 3 else "m") for i in range(1500)]
    rows += [(2000 + i, rows[0][1], "p0", "m") for i in range(200)] + [(3000, [0.0] * 6, "p0", "m"), (3001, None, "p0", "m"), (3002, [1.0, None, 1.0, 1.0, 1.0, 1.0], "p0", "m"), (3003, [1.0, 2.0], "p0", "m"), (None, rows[0][1], "p0", "m")]
    schema = "vec_id long, embedding array<double>, project string, model string"
    vectors = spark.createDataFrame(rows, schema)
    queries = vectors.where("vec_id % 100 = 0 and vec_id < 2000")
    got = {}
    for r in retrieval.nearest_in_scope(vectors, queries, 4, ["project", "model"]).collect():
        got.setdefault(r.query_id, []).append((r.distance, r.vec_id))
    whole = [(i, np.array([*v, *[0.0] * (6 - len(v))]), p, m) for i, v, p, m in rows if i is not None and v is not None and None not in v and any(v)]
    for q, v, p, m in whole:
        if q % 100 == 0 and q < 2000:
            far = sorted((round(1 - float(v @ w) / float(np.sqrt(v @ v) * np.sqrt(w @ w)), 9) + 0.0, i) for i, w, pp, mm in whole if (pp, mm) == (p, m))[:4]
            assert [i for _, i in sorted(got[q])] == [i for _, i in far] and np.allclose([d for d, _ in sorted(got[q])], [d for d, _ in far], atol=2e-9)
    held, made = retrieval.clustered(vectors, ["project", "model"], 6)
    read = retrieval.visits(held, made, retrieval._usable(queries, ["project", "model"], "vec_id", "embedding", 6), 4).agg(F.sum("n")).first()[0]
    sizes = held.groupBy("scope").agg(F.count("*").alias("n"))
    every = retrieval._usable(queries, ["project", "model"], "vec_id", "embedding", 6).join(sizes, "scope").agg(F.sum("n")).first()[0]
    assert read < 0.5 * every
    assert retrieval.nearest_in_scope(vectors.limit(0), queries, 4, ["project"]).count() == 0
