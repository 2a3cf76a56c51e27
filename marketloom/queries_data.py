"""The registered queries of the data layer: stores, uploads, text, charts, gates and regimes, and the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import sql
from .functions import distributions
from .operators import charts, gates, regimes, telemetry, text
from .queries import DIGITS, _aligned, _levels, _r, _residuals, _returns, register
from .sources import panel, scratch, store, upload
from .streaming.metrics import windowed


def _observations(spark: SparkSession, d: str) -> DataFrame:
    """Lines as observations of a dataset a year: prices of the return flags A and R, quantities of all."""
    lines = panel.table(spark, d, "lineitem").groupBy(F.to_date("l_shipdate").alias("ts"), F.col("l_returnflag").alias("symbol"))
    sums = lines.agg(F.sum("l_extendedprice").alias("price"), F.sum("l_quantity").alias("volume"))
    each = F.explode(F.array(F.struct(F.lit("price").alias("field"), F.when(F.col("symbol") != "N", F.col("price")).alias("value")), F.struct(F.lit("volume").alias("field"), F.col("volume").alias("value"))))
    return sums.select(F.year("ts").cast("string").alias("dataset_id"), "ts", "symbol", each.alias("x")).select("dataset_id", "ts", "symbol", "x.*").where("value is not null")


_OBS = """WITH li AS (SELECT l_shipdate::DATE AS ts, l_returnflag AS symbol, sum(l_extendedprice) AS price, sum(l_quantity) AS volume FROM lineitem GROUP BY 1, 2),
ob AS (SELECT year(ts)::VARCHAR AS dataset_id, ts, symbol, 'price' AS field, price AS value FROM li WHERE symbol <> 'N' UNION ALL SELECT year(ts)::VARCHAR, ts, symbol, 'volume', volume FROM li)"""
_COLUMNS = f"dataset_id, ts, symbol, field, {_r('value')}"


def _on_observations(name: str, query: str):
    """Like register(), for SQL that begins with the observations."""
    from .queries import ORACLES

    def add(f):
        register(name)(f)
        ORACLES[name] = f"{_OBS}\n{query}"
        return f

    return add


@register("outer_align", "SELECT ts, " + ", ".join(f"round(max(value) FILTER (WHERE symbol = '{s}'), {DIGITS}) AS {s}" for s in "ANR") + " FROM lv GROUP BY ts")
def outer_align(spark, d):
    return panel.outer_aligned(_levels(spark, d), ["A", "N", "R"])


@register("excess_returns", f""", q AS (SELECT last_day(o_orderdate::DATE) AS ts, avg(o_totalprice) / 1e5 AS pct FROM orders GROUP BY 1),
a AS (SELECT rt.symbol, rt.ts, r, coalesce(q.pct, (SELECT arg_min(pct, ts) FROM q)) AS pct FROM rt ASOF LEFT JOIN q ON rt.ts >= q.ts)
SELECT symbol, ts, {_r('r - (pow(1 + pct / 100, 1.0::DOUBLE / 252) - 1) AS r')} FROM a""")
def excess_returns(spark, d):
    """Returns less a daily rate made of the latest month-end mean order price, read as per cent a year."""
    rates = panel.table(spark, d, "orders").groupBy(F.last_day(F.to_date("o_orderdate")).alias("ts")).agg((F.avg("o_totalprice") / 1e5).alias("pct"))
    joined = panel.as_of(_returns(spark, d), rates, "pct", by=None)
    return panel.excess(joined.withColumn("rf", panel.period_rate(F.col("pct"), "DGS3MO", 252)), "rf")


@register("unpivoted", f"SELECT ts, symbol, {_r('value')} FROM lv")
def unpivoted(spark, d):
    return panel.unpivoted(panel.outer_aligned(_levels(spark, d), ["A", "N", "R"]), "ts", ["A", "N", "R"])


@_on_observations("observations_in_range", f"SELECT {_COLUMNS} FROM ob WHERE ts BETWEEN DATE '1995-01-01' AND DATE '1996-06-30'")
def observations_in_range(spark, d):
    return store.in_range(_observations(spark, d), "1995-01-01", "1996-06-30")


@_on_observations("preferred_field", f"SELECT {_COLUMNS} FROM ob WHERE field = CASE WHEN symbol = 'N' THEN 'volume' ELSE 'price' END")
def preferred_field(spark, d):
    return store.preferred(_observations(spark, d))


@_on_observations("replaced_datasets", f"""SELECT {_COLUMNS} FROM ob WHERE dataset_id NOT IN (SELECT dataset_id FROM ob WHERE ts >= DATE '1996-01-01')
UNION ALL SELECT dataset_id, ts, symbol, field, round(2 * value, {DIGITS}) FROM ob WHERE ts >= DATE '1996-01-01'""")
def replaced_datasets(spark, d):
    """The years from 1996 on are put in anew, doubled."""
    rows = _observations(spark, d)
    return store.replaced(rows, rows.where("ts >= date '1996-01-01'").withColumn("value", 2 * F.col("value")))


@_on_observations("appended_once", f"SELECT {_COLUMNS} FROM ob")
def appended_once(spark, d):
    """Prices are stored; all observations come in, prices changed: those that are there stay as they are."""
    rows = _observations(spark, d)
    changed = rows.withColumn("value", F.when(F.col("field") == "price", -F.col("value")).otherwise(F.col("value")))
    return store.appended(rows.where("field = 'price'"), changed, store.KEY)


@register("last_writer_wins", f"SELECT user_id, event_id, event_type, ts, {_r('value')} FROM (SELECT * FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1)")
def last_writer_wins(spark, d):
    """The latest event of each user."""
    return store.last_written(panel.table(spark, d, "events").select("user_id", "event_id", "event_type", "ts", "value"), ["user_id"], "ts", "event_id")


@register("distinct_symbols", "SELECT DISTINCT symbol, year(ts)::INT AS year FROM lv")
def distinct_symbols(spark, d):
    return _levels(spark, d).select("symbol", F.year("ts").alias("year")).distinct()


@register("customers_with_orders", "SELECT c_custkey, c_mktsegment FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def customers_with_orders(spark, d):
    orders = panel.table(spark, d, "orders").select("o_custkey")
    return store.with_any(panel.table(spark, d, "customer").select("c_custkey", "c_mktsegment"), orders, F.col("c_custkey") == F.col("o_custkey"))


@register("overlaid_prices", f"""SELECT symbol, ts, {_r('value')}, 'market' AS provenance FROM lv WHERE symbol <> 'N'
UNION ALL SELECT 'N', o_orderdate::DATE, round(sum(o_totalprice), {DIGITS}), 'uploaded' FROM orders GROUP BY 2""")
def overlaid_prices(spark, d):
    """An upload of the symbol N, made of the orders, over the market's levels."""
    uploaded = panel.table(spark, d, "orders").groupBy(F.lit("N").alias("symbol"), F.to_date("o_orderdate").alias("ts")).agg(F.sum("o_totalprice").alias("value"))
    return store.overlaid(_levels(spark, d), uploaded)


@register("turn_roots", """WITH RECURSIVE t AS (SELECT conv_id::VARCHAR || '-' || turn AS id, conv_id::VARCHAR || '-' || (turn - 1) AS parent FROM conversations),
r AS (SELECT id, id AS root, 0 AS depth FROM t WHERE parent NOT IN (SELECT id FROM t) UNION ALL SELECT t.id, root, depth + 1 FROM r JOIN t ON t.parent = r.id) SELECT id, root, depth FROM r""".replace("FROM", "from"))
def turn_roots(spark, d):
    """Turns of conversations as steps: the parent is the turn before."""
    id_ = lambda n: F.concat_ws("-", F.col("conv_id").cast("string"), n.cast("string"))
    turns = panel.table(spark, d, "conversations").select(id_(F.col("turn")).alias("id"), id_(F.col("turn") - 1).alias("parent"))
    return store.roots(turns, "id", "parent")


_STEPS = "st AS (SELECT role, length(text)::BIGINT AS characters, len(regexp_extract_all(coalesce(text, ''), '[^ ]+'))::BIGINT AS words FROM conversations)"


def _steps(spark: SparkSession, d: str) -> DataFrame:
    words = F.regexp_count(F.coalesce("text", F.lit("")), F.lit("[^ ]+"))
    return panel.table(spark, d, "conversations").select("role", F.length("text").cast("long").alias("characters"), words.cast("long").alias("words"))


@register("token_totals", f", {_STEPS} SELECT coalesce(sum(characters), 0)::BIGINT AS characters, coalesce(sum(words), 0)::BIGINT AS words FROM st")
def token_totals(spark, d):
    return telemetry.token_totals(_steps(spark, d), ["characters", "words"])


@register("tokens_by_role", f", {_STEPS} SELECT role, sum(characters)::BIGINT AS characters, sum(words)::BIGINT AS words FROM st WHERE role IS NOT NULL GROUP BY role")
def tokens_by_role(spark, d):
    return telemetry.tokens_by(_steps(spark, d), "role", ["characters", "words"])


@register("failure_rate", f"SELECT count(*) AS population, round(avg((value > 50)::INT), {DIGITS}) AS failure_rate FROM events WHERE event_type = 'click'")
def failure_rate(spark, d):
    return telemetry.rate(panel.table(spark, d, "events"), F.col("event_type") == "click", F.col("value") > 50, "failure_rate")


@register("hourly_metrics", f"SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, {_r('avg(value) AS mean')} FROM events GROUP BY 1, 2")
def hourly_metrics(spark, d):
    """The plan of the event stream, over the table."""
    return windowed(panel.table(spark, d, "events"))


@register("fingerprints", """SELECT o_orderstatus, count(*) AS n, sha256(count(*) || '|' || sum(('0x' || left(md5(o_orderkey || '|' || o_custkey || '|' || o_orderstatus || '|' || o_orderpriority), 12))::BIGINT)) AS digest FROM orders GROUP BY o_orderstatus""")
def fingerprints(spark, d):
    return store.fingerprint(panel.table(spark, d, "orders"), ["o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority"], ["o_orderstatus"])


@register("reproduced_levels", """, l AS (SELECT l_returnflag AS symbol, l_shipdate::DATE AS ts, l_orderkey, l_linenumber FROM lineitem),
b AS (SELECT symbol, ts, count(*) AS n, sum(l_linenumber) AS numbers FROM l WHERE l_orderkey % 50 <> 0 GROUP BY 1, 2), a AS (SELECT symbol, ts, count(*) AS n, sum(l_linenumber) AS numbers FROM l WHERE year(ts) > 1992 GROUP BY 1, 2)
SELECT coalesce(a.symbol, b.symbol) AS symbol, coalesce(a.ts, b.ts) AS ts, coalesce(a.n = b.n AND a.numbers = b.numbers, false) AS reproduced,
CASE WHEN b.n IS NULL THEN 'not in the earlier run' WHEN a.n IS NULL THEN 'missing now' WHEN a.n <> b.n OR a.numbers <> b.numbers THEN 'the numbers differ' ELSE '' END AS detail
FROM a FULL JOIN b ON a.symbol = b.symbol AND a.ts = b.ts""")
def reproduced_levels(spark, d):
    """Counts of lines a day: an earlier run without some orders, and a later one, by way of orders, without the first year."""
    lines = panel.table(spark, d, "lineitem").select(F.col("l_returnflag").alias("symbol"), F.to_date("l_shipdate").alias("ts"), "l_orderkey", "l_linenumber")
    first = lines.where("l_orderkey % 50 <> 0").groupBy("symbol", "ts").agg(F.count("*").alias("n"), F.sum("l_linenumber").alias("numbers"))
    by_order = lines.where("year(ts) > 1992").groupBy("symbol", "ts", "l_orderkey").agg(F.count("*").alias("c"), F.sum("l_linenumber").alias("s"))
    return store.reproduced(first, by_order.groupBy("symbol", "ts").agg(F.sum("c").alias("n"), F.sum("s").alias("numbers")), ["symbol", "ts"])


@register("exported_long", f"""SELECT 's1' AS step_id, 'capm' AS tool, s AS series, x, round(y, {DIGITS}) AS y FROM (
SELECT unnest(['residual', 'm']) AS s, strftime(ts, '%Y-%m-%d') AS x, unnest([e, m]) AS y FROM rs)""")
def exported_long(spark, d):
    return store.long_form(_residuals(spark, d), "s1", "capm", ["residual", "m"], panel.iso_date(F.col("ts")))


@register("parsed_numbers", f"SELECT l_orderkey, l_linenumber, {_r('l_extendedprice AS value')}, {_r('l_extendedprice AS european')} FROM lineitem")
def parsed_numbers(spark, d):
    """Prices written with thousands commas, and with a decimal comma, read back."""
    lines = panel.table(spark, d, "lineitem")
    written = F.format_number("l_extendedprice", 2)
    european = F.translate(written, ",.", ".,")
    return lines.select("l_orderkey", "l_linenumber", upload.number(written).alias("value"), upload.number(european, True).alias("european"))


@register("csv_round_trip", "SELECT o_orderkey, o_orderpriority, o_orderdate::DATE AS day FROM orders")
def csv_round_trip(spark, d):
    """Orders written as a CSV, and read back as an upload is."""
    rows = panel.table(spark, d, "orders").select("o_orderkey", "o_orderpriority", F.date_format("o_orderdate", "M/d/yyyy").alias("day"))
    path = scratch.folder(spark, "orders")
    rows.write.option("header", True).option("sep", ";").csv(path)
    df, _ = upload.read_csv(spark, path, most_bytes=None)
    return df.select(F.col("o_orderkey").cast("long").alias("o_orderkey"), "o_orderpriority", upload.day(F.col("day")).alias("day"))


#: Orders as a European upload: prices with points and decimal commas, one in twenty-three missing; days written in three ways.
_UPLOAD = """, up AS (SELECT o_orderkey, o_orderdate::DATE AS ts, o_orderpriority AS symbol, CASE WHEN o_orderkey % 23 <> 0 THEN round(o_totalprice, 2) END AS value FROM orders WHERE o_orderkey % 29 <> 0)"""


def _european(spark: SparkSession, d: str) -> tuple[DataFrame, str]:
    orders = panel.table(spark, d, "orders")
    price = F.when(F.col("o_orderkey") % 23 != 0, F.translate(F.format_number("o_totalprice", 2), ",.", ".,"))
    forms = F.when(F.col("o_orderkey") % 29 == 0, "n/a").when(F.col("o_orderkey") % 3 == 0, F.date_format("o_orderdate", "MM/dd/yyyy")).when(F.col("o_orderkey") % 3 == 1, F.date_format("o_orderdate", "yyyy-MM-dd")).otherwise(F.date_format("o_orderdate", "d MMM yyyy"))
    path = scratch.folder(spark, "upload")
    orders.select(forms.alias("Day"), F.col("o_orderpriority").alias("Symbol"), price.alias("Close")).write.option("header", True).option("sep", ";").csv(path)
    return upload.read_csv(spark, path, most_bytes=None)


@register("upload_european", f"{_UPLOAD} SELECT ts, symbol, 'price' AS field, {_r('value')} FROM up WHERE value IS NOT NULL")
def upload_european(spark, d):
    """A file with decimal commas and mixed dates through profile, proposal and mapping."""
    df, delimiter = _european(spark, d)
    found = upload.roles(upload.profile(df, delimiter)).collect()  # one row a column
    return upload.mapped(df, {r["column"]: r["role"] for r in found}, delimiter, [r["column"] for r in found if r["decimal_comma"]])


@register("upload_unread", """SELECT * FROM (SELECT 'Close' AS "column", 'price' AS role, count(*) FILTER (WHERE o_orderkey % 23 <> 0) AS written, 0::BIGINT AS unread FROM orders
UNION ALL SELECT 'Day', 'date', count(*), count(*) FILTER (WHERE o_orderkey % 29 = 0) FROM orders)""")
def upload_unread(spark, d):
    df, delimiter = _european(spark, d)
    return upload.unread(df, "Day", {"Close": "price"}, upload.decimal_commas(df, ["Close"], delimiter))


@register("upload_scores")
def upload_scores(spark, d):
    p = upload.profile(panel.table(spark, d, "customer"))
    return upload.scores(p)


@register("upload_mapped", f"SELECT o_orderdate::DATE AS ts, o_orderpriority AS symbol, 'price' AS field, {_r('o_totalprice::DOUBLE AS value')} FROM orders")
def upload_mapped(spark, d):
    """Orders through profile, proposal and confirmation."""
    orders = panel.table(spark, d, "orders").select("o_orderdate", "o_orderpriority", "o_totalprice")
    roles = {r["column"]: r["role"] for r in upload.roles(upload.profile(orders)).collect()}  # one row a column
    return upload.mapped(orders, roles)


@register("steward_flags", """, w AS (SELECT * FROM lv WHERE ts BETWEEN DATE '1992-06-01' AND DATE '1997-12-31'), n AS (SELECT count(DISTINCT symbol) AS k FROM w),
e AS (SELECT symbol, max(ts) AS last, min(ts) FILTER (WHERE ts BETWEEN DATE '1992-06-01' AND DATE '1997-12-31') AS first FROM lv GROUP BY symbol),
c AS (SELECT count(*) AS calendar, count(*) FILTER (WHERE have = (SELECT k FROM n)) AS common FROM (SELECT ts, count(DISTINCT symbol) AS have FROM w GROUP BY ts))
SELECT 'look_ahead' AS code, 'risk' AS severity, symbol FROM e WHERE last > DATE '1997-12-31' UNION ALL SELECT 'late_start', 'risk', symbol FROM e WHERE date_diff('day', DATE '1992-06-01', first) > 30
UNION ALL SELECT 'calendar_misalignment', 'warning', NULL FROM c WHERE common < calendar UNION ALL SELECT 'short_sample', 'warning', NULL FROM c WHERE common < 30
UNION ALL SELECT 'synthetic_data', 'risk', NULL FROM lineitem WHERE l_linestatus = 'O' HAVING count(*) > 0 UNION ALL SELECT 'mixed_sources', 'info', NULL FROM lineitem HAVING count(DISTINCT l_linestatus) > 1
UNION ALL SELECT 'factor_coverage', 'warning', NULL FROM (SELECT avg((q.ts IS NOT NULL)::INT) AS share FROM (SELECT ts FROM w GROUP BY ts HAVING count(DISTINCT symbol) = (SELECT k FROM n)) x
LEFT JOIN (SELECT DISTINCT o_orderdate::DATE AS ts FROM orders WHERE o_orderpriority = '1-URGENT') q USING (ts)) WHERE share < 0.9 UNION ALL SELECT 'mixed_risk_free', 'warning', NULL""")
def steward_flags(spark, d):
    """The levels from June 1992 to 1997, lines of one status taken for synthetic, with urgent orders as factors."""
    lines = panel.table(spark, d, "lineitem")
    sources = lines.select(F.col("l_returnflag").alias("symbol"), F.when(F.col("l_linestatus") == "O", "Synthetic walk").otherwise("uploaded").alias("source")).distinct()
    factors = panel.table(spark, d, "orders").where("o_orderpriority = '1-URGENT'").groupBy(F.to_date("o_orderdate").alias("ts")).agg(F.sum("o_totalprice").alias("mkt"), F.avg("o_totalprice").alias("rf"))
    return panel.steward_flags(_levels(spark, d), "1992-06-01", "1997-12-31", sources, factors, "DGS3MO")


@register("gate_arch_effects", f""", g0 AS (SELECT symbol, ts, r, lag(r) OVER (PARTITION BY symbol ORDER BY ts) AS x FROM rt),
gf AS (SELECT symbol, regr_slope(r, x) AS b, regr_intercept(r, x) AS a FROM g0 GROUP BY symbol), ge AS (SELECT symbol, ts, pow(r - a - b * x, 2) AS e2 FROM g0 JOIN gf USING (symbol) WHERE x IS NOT NULL),
gl AS (SELECT symbol, e2, {", ".join(f"lag(e2, {k}) OVER w AS l{k}" for k in range(1, 11))} FROM ge WINDOW w AS (PARTITION BY symbol ORDER BY ts)),
{sql.least_squares("gm", "gl", ["symbol"], [f"l{k}" for k in range(1, 11)], "e2")}, gs AS (SELECT symbol, n * (1 - ssr / sst) AS st FROM gm)
SELECT symbol, 'arch_effects' AS gate, {_r('st AS statistic')}, round({sql.chi2_p('st', 10)}, {DIGITS}) AS p_value, {sql.chi2_p('st', 10)} < 0.05 AS present, {sql.chi2_p('st', 10)} < 0.05 AS allowed FROM gs""")
def gate_arch_effects(spark, d):
    return gates.allowed(gates.arch_effects(_returns(spark, d)), "garch")


@register("gate_stationarity")
def gate_stationarity(spark, d):
    return gates.allowed(gates.stationarity(_levels(spark, d)), "vecm")


@register("histogram", f""", e AS (SELECT symbol, min(r) AS least, (max(r) - min(r)) / 20 AS width FROM rt GROUP BY symbol),
b AS (SELECT symbol, least, width, least(20, floor((r - least) / width) + 1)::INT AS bin FROM rt JOIN e USING (symbol))
SELECT symbol, bin, {_r('least + (bin - 1) * width AS low', 'least + bin * width AS high')}, count(*) AS n FROM b GROUP BY symbol, bin, least, width""")
def histogram(spark, d):
    return charts.histogram(_returns(spark, d), "r")


_POLY = lambda c, x: f"({' + '.join(f'{k!r} * pow({x}, {len(c) - 1 - i})' for i, k in enumerate(c))})"
_A = distributions


@register("quantile_points", f""", q AS (SELECT symbol, row_number() OVER (PARTITION BY symbol ORDER BY e) - 1 AS i, count(*) OVER (PARTITION BY symbol) AS n, e FROM rs),
p AS (SELECT *, (i + 0.5) / n AS p, sqrt(-2 * ln(least((i + 0.5) / n, 1 - (i + 0.5) / n))) AS t FROM q)
SELECT symbol, i::INT AS i, round(CASE WHEN p < {_A.ACKLAM_EDGE} THEN {_POLY(_A.ACKLAM_TAIL, 't')} / {_POLY(_A.ACKLAM_TAIL_BELOW, 't')} WHEN p > 1 - {_A.ACKLAM_EDGE} THEN -{_POLY(_A.ACKLAM_TAIL, 't')} / {_POLY(_A.ACKLAM_TAIL_BELOW, 't')}
ELSE (p - 0.5) * {_POLY(_A.ACKLAM_MIDDLE, '((p - 0.5) * (p - 0.5))')} / {_POLY(_A.ACKLAM_MIDDLE_BELOW, '((p - 0.5) * (p - 0.5))')} END, {DIGITS}) AS theoretical, {_r('e AS sample')} FROM p""")
def quantile_points(spark, d):
    return charts.quantile_points(_residuals(spark, d), "residual")


@register("stacked_revenue", f"""SELECT ts, symbol, {_r('h - value AS low', 'h AS high')} FROM (SELECT ts, symbol, value, sum(value) OVER (PARTITION BY ts ORDER BY symbol) AS h FROM lv)""")
def stacked_revenue(spark, d):
    return charts.stacked(_levels(spark, d), "ts", "symbol", "value")


_CITED = text.CITED.replace("'", "''")
_IN = lambda words: "(" + ", ".join(f"'{w}'" for w in words) + ")"
_NUMBERS = f""", nn AS (SELECT doc_id, unnest(regexp_extract_all(text, '{_CITED}', 1)) AS before, unnest(regexp_extract_all(text, '{_CITED}', 2)) AS cited, generate_subscripts(regexp_extract_all(text, '{_CITED}', 2), 1) - 1 AS place FROM documents),
nw AS (SELECT doc_id, place, lower(regexp_replace(coalesce(before, ''), '[\\s(]+$', '')) AS word, coalesce(before, '') LIKE '%(' AS ord, cited, try_cast(regexp_replace(cited, '[,%]', '', 'g') AS DOUBLE) AS value,
length(regexp_extract(cited, '\\.(\\d+)', 1)) AS places, cited LIKE '%\\%' ESCAPE '\\' AS percent FROM nn),
nu AS (SELECT doc_id, place, word, cited, value, places, percent FROM nw WHERE NOT (word IN {_IN(text.REFERENCE)} OR (regexp_matches(cited, '^\\d{{4}}$') AND value BETWEEN {text.YEARS[0]} AND {text.YEARS[1]} AND word IN {_IN(text.DATED)}) OR ord))"""


@register("cited_numbers", f"{_NUMBERS} SELECT doc_id, place::INT AS place, word, cited, {_r('value')}, places::INT AS places, percent FROM nu")
def cited_numbers(spark, d):
    return text.cited_numbers(panel.table(spark, d, "documents"))


@register("grounding", f"""{_NUMBERS}, fm AS (SELECT doc_id, place, value AS v, places AS p FROM nu UNION ALL SELECT doc_id, place, value / 100, places + 2 FROM nu WHERE percent),
kn AS (SELECT DISTINCT p, round(p_size * pow(10.0::DOUBLE, p)) AS k FROM part, (SELECT unnest(range(0, {text.PLACES + 1})) AS p)),
ok AS (SELECT DISTINCT doc_id, place FROM fm JOIN kn ON fm.p = kn.p AND round(v * pow(10.0::DOUBLE, fm.p)) = k)
SELECT doc_id, count(*) AS checked, count(*) FILTER (WHERE ok.place IS NULL) AS unsupported FROM nu LEFT JOIN ok USING (doc_id, place) GROUP BY doc_id""")
def grounding(spark, d):
    """Numbers in the documents against the sizes of the parts."""
    return text.grounded(panel.table(spark, d, "documents"), panel.table(spark, d, "part"), value="p_size")


@register("passages")
def passages(spark, d):
    """Passages of every document, by their lengths and digests."""
    return text.passages(panel.table(spark, d, "documents")).select("doc_id", "ordinal", F.length("text").alias("n_chars"), F.md5("text").alias("digest"))


@register("markov_switching")
def markov_switching(spark, d):
    return regimes.markov_switching(_returns(spark, d))


@register("regime_path")
def regime_path(spark, d):
    return regimes.regime_path(_aligned(spark, d).select("symbol", "ts", "r"))
