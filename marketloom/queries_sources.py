"""The registered queries of factor files, the price cache, exports, plans and claims in prose, and the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .operators import claims, layers, retrieval
from .operators.text import DATED, REFERENCE
from .queries import DIGITS, SEGMENTS, _levels, _r, _residuals, register
from .sources import exports, factor_files, panel, price_cache, scratch

_MONTHS = """, mt AS (SELECT c_mktsegment AS g, last_day(o_orderdate::DATE) AS ts, sum(o_totalprice) AS v FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2),
mr AS (SELECT g, ts, round(100 * (v / lag(v) OVER (PARTITION BY g ORDER BY ts) - 1), 4) / 100 AS r FROM mt)"""
#: Cuts of the files' rows that reach the reader.
FROM, TO = "1993-01-01", "1997-06-30"


def _factor_file(spark: SparkSession, d: str) -> str:
    """The segments' monthly changes of orders as a published file, in per cent to four places."""
    orders = panel.table(spark, d, "orders").join(panel.table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    series = orders.groupBy(F.col("c_mktsegment").alias("symbol"), F.last_day(F.to_date("o_orderdate")).alias("ts")).agg(F.sum("o_totalprice").alias("value"))
    changes = series.withColumn("r", 100 * (F.col("value") / F.lag("value").over(Window.partitionBy("symbol").orderBy("ts")) - 1))
    path = scratch.folder(spark, "factors")
    factor_files.write_factor_file(changes.groupBy("ts").pivot("symbol", SEGMENTS).agg(F.first("r")), path, SEGMENTS)
    return path


@register("factor_file", f"{_MONTHS} SELECT ts, " + ", ".join(f"round(max(r) FILTER (WHERE g = '{g}'), {DIGITS}) AS {g}" for g in SEGMENTS) + f" FROM mr WHERE ts BETWEEN DATE '{FROM}' AND DATE '{TO}' GROUP BY ts")
def factor_file(spark, d):
    """A factor file written and read by the data source, with bounds on its dates."""
    return factor_files.read_factors(spark, _factor_file(spark, d), "monthly", FROM, TO).select("ts", *SEGMENTS)


@register("factor_file_quarters", f"{_MONTHS} SELECT g AS symbol, (date_trunc('quarter', ts) + INTERVAL 3 MONTH - INTERVAL 1 DAY)::DATE AS period_end, {_r('product(1 + r) - 1 AS r')}, count(*) AS n FROM mr WHERE r IS NOT NULL GROUP BY 1, 2")
def factor_file_quarters(spark, d):
    rows = factor_files.read_factors(spark, _factor_file(spark, d))
    return panel.compounded(rows.unpivot(["ts"], SEGMENTS, "symbol", "r"), "Q")


NOW = "2000-01-02 12:00:00"


def _cache(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Requests (quarters of each flag), the manifest (its years, of different ages, every third beginning late) and the prices kept."""
    rows = _levels(spark, d)
    year, quarter = F.year("ts"), F.trunc("ts", "quarter")
    requests = rows.groupBy("symbol", quarter.alias("q")).agg(F.min("ts").alias("low"), F.max("ts").alias("high")).drop("q")
    years = rows.groupBy("symbol", year.alias("y")).agg(F.min("ts").alias("low"), F.max("ts").alias("high"), F.count("*").alias("n"))
    entry = F.concat_ws("-", "symbol", "y")
    late = F.when(F.col("y") % 3 == 0, F.date_add("low", 20)).otherwise(F.col("low"))
    age = F.when(F.col("y") % 4 == 0, 200_000).otherwise(F.col("n"))
    manifest = years.select(entry.alias("entry"), "symbol", late.alias("low"), "high", (F.lit(NOW).cast("timestamp") - F.make_interval(secs=age)).alias("fetched_at"))
    prices = rows.select(F.concat_ws("-", "symbol", year).alias("entry"), "symbol", "ts", "value")
    return requests, manifest, prices.join(manifest.select("entry", "low"), "entry").where("ts >= low").drop("low")


_CACHE = """, rq AS (SELECT symbol, min(ts) AS low, max(ts) AS high FROM lv GROUP BY symbol, date_trunc('quarter', ts)),
mf AS (SELECT symbol || '-' || year(ts) AS entry, symbol, (min(ts) + CASE WHEN year(ts) % 3 = 0 THEN 20 ELSE 0 END)::DATE AS low, max(ts) AS high, year(ts) % 4 <> 0 AS fresh FROM lv GROUP BY symbol, year(ts)),
cv AS (SELECT rq.*, max(entry) FILTER (WHERE fresh) AS entry, CASE WHEN count(*) FILTER (WHERE fresh) > 0 THEN 'hit' WHEN count(entry) > 0 THEN 'stale' ELSE 'missing' END AS verdict
FROM rq LEFT JOIN mf ON rq.symbol = mf.symbol AND mf.low <= rq.low AND mf.high >= rq.high GROUP BY rq.symbol, rq.low, rq.high)"""


@register("cache_coverage", f"{_CACHE} SELECT symbol, low, high, verdict, entry FROM cv")
def cache_coverage(spark, d):
    requests, manifest, _ = _cache(spark, d)
    return price_cache.coverage(requests, manifest, NOW)


@register("cache_gaps", f"""{_CACHE}, dy AS (SELECT rq.symbol, rq.low, rq.high, unnest(generate_series(rq.low, rq.high, INTERVAL 1 DAY))::DATE AS day FROM rq),
un AS (SELECT dy.*, day - row_number() OVER (PARTITION BY dy.symbol, dy.low ORDER BY day)::INT AS run FROM dy WHERE NOT EXISTS (SELECT 1 FROM mf WHERE mf.fresh AND mf.symbol = dy.symbol AND day BETWEEN mf.low AND mf.high))
SELECT symbol, low, high, min(day) AS gap_low, max(day) AS gap_high FROM un GROUP BY symbol, low, high, run""")
def cache_gaps(spark, d):
    requests, manifest, _ = _cache(spark, d)
    return price_cache.gaps(requests, manifest, NOW)


@register("cached_prices", f"{_CACHE} SELECT cv.symbol, low, high, ts, {_r('value')} FROM cv JOIN lv ON lv.symbol = cv.symbol AND ts BETWEEN low AND high WHERE verdict = 'hit'")
def cached_prices(spark, d):
    requests, manifest, prices = _cache(spark, d)
    return price_cache.served(requests, manifest, prices, NOW)


@register("exported_residuals", f"SELECT symbol, ts, {_r('e AS residual')} FROM rs")
def exported_residuals(spark, d):
    """Residuals exported with a manifest, checked against it and read back."""
    rows = _residuals(spark, d).select("symbol", "ts", "residual")
    path = scratch.folder(spark, "export")
    exports.write_export(rows, path, "json", {"tool": "capm", "market": "total"})
    return exports.read_export(spark, path, "symbol string, ts date, residual double")


@register("plan_order", """, st AS (SELECT conv_id AS plan, turn AS step, -turn AS position FROM conversations),
nd AS (SELECT conv_id AS plan, turn AS step, turn - 2 AS need FROM conversations UNION SELECT conv_id, turn, turn - 3 FROM conversations WHERE role = 'assistant'),
ly AS (SELECT plan, step, (step // 2)::INT AS layer, position FROM st)
SELECT plan, step, layer, (row_number() OVER (PARTITION BY plan ORDER BY layer, position, step))::INT AS place FROM ly""")
def plan_order(spark, d):
    """Each turn needs the one two before, an assistant's the one three before too; later turns are declared first."""
    turns = panel.table(spark, d, "conversations")
    steps = turns.select(F.col("conv_id").alias("plan"), F.col("turn").alias("step"), (-F.col("turn")).alias("position"))
    two = turns.select(F.col("conv_id").alias("plan"), F.col("turn").alias("step"), (F.col("turn") - 2).alias("need"))
    three = turns.where("role = 'assistant'").select(F.col("conv_id").alias("plan"), F.col("turn").alias("step"), (F.col("turn") - 3).alias("need"))
    return layers.run_order(steps, two.union(three))


@register("chained_attempts", """, o AS (SELECT user_id, event_type, event_id, lag(event_id) OVER w AS parent_at, coalesce(event_type <> lag(event_type) OVER w, true) AS new, coalesce(event_type <> lead(event_type) OVER w, true) AS final FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
t AS (SELECT *, sum(new::INT) OVER (PARTITION BY user_id ORDER BY event_id) AS turn FROM o)
SELECT user_id, event_type, event_id, parent_at, (row_number() OVER (PARTITION BY user_id, turn ORDER BY event_id))::INT AS attempt, final FROM t""")
def chained_attempts(spark, d):
    """A user's events of one type in a row as attempts."""
    return layers.chained_attempts(panel.table(spark, d, "events").select("user_id", "event_type", "event_id"), "user_id", "event_type", "event_id")


_WORD = "[A-Za-z]+"
_IN = lambda words: ", ".join(f"'{w}'" for w in words)
_GAP = f"^\\s*{claims.DASH}?\\s*$"
_CLAIMS = rf""", tx AS (SELECT doc_id, unnest(string_split(regexp_replace(text, '([.!?])\s+([A-Z])', '\1' || chr(10) || '\2', 'g'), chr(10))) AS sentence, unnest(range(0, len(string_split(regexp_replace(text, '([.!?])\s+([A-Z])', '\1' || chr(10) || '\2', 'g'), chr(10))))) AS line FROM documents),
sd AS (SELECT doc_id, line, regexp_replace(sentence, '{claims.ORDER}', '\1()', 'g') AS said FROM tx WHERE regexp_matches(sentence, '\S')),
sp AS (SELECT *, regexp_extract_all(said, '{claims.NUMBER}') AS found, string_split_regex(said, '{claims.NUMBER}') AS gaps, regexp_matches(lower(said), '{"|".join(claims.SIGNIFICANCE)}') AS about FROM sd),
nr AS (SELECT doc_id, line, about, unnest(range(0, len(found))) AS nth, found, gaps FROM sp WHERE len(found) > 0),
nu AS (SELECT doc_id, line, about, nth, found[nth + 1] AS cited, gaps[nth + 1] AS ahead, coalesce(gaps[nth + 2], '') AS behind FROM nr),
wd AS (SELECT *, lower(last_value(nullif(regexp_extract(ahead, '({_WORD})[^A-Za-z]*$', 1), '') IGNORE NULLS) OVER (PARTITION BY doc_id, line ORDER BY nth ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) AS word,
  lead(cited) OVER w AS nx, lag(cited) OVER w AS lx, lead(behind) OVER w AS nb, lag(ahead) OVER w AS la FROM nu WINDOW w AS (PARTITION BY doc_id, line ORDER BY nth)),
vl AS (SELECT *, try_cast(replace(replace(cited, ',', ''), '%', '') AS DOUBLE) AS value, length(regexp_extract(cited, '\.(\d+)', 1)) AS places, ends_with(cited, '%') AS percent,
  regexp_matches(cited, '^[\d,]+(?:[eE][-+]?\d+)?$') AS whole, regexp_extract(cited, '^[-+]?([\d,]+)', 1) AS digits FROM wd),
yr AS (SELECT *, NOT regexp_matches(cited, '\.|%') AND regexp_matches(digits, '^\d{{4}}$') AND try_cast(digits AS INT) BETWEEN 1900 AND 2100 AS fits,
  regexp_matches(behind || regexp_extract(nx, '^([-+]?)', 1), '{_GAP}') AND regexp_matches(nx, '^[-+]?\d{{4}}(?:[^\d,eE]|,$|$)') AND try_cast(regexp_extract(nx, '^[-+]?(\d{{4}})', 1) AS INT) BETWEEN 1900 AND 2100
    AND NOT (regexp_matches(nx, '^[-+]?\d{{4}}$') AND regexp_matches(coalesce(nb, ''), '^\w')) AS after,
  regexp_matches(ahead, '{_GAP}') AND try_cast(regexp_extract(lx, '(?:^|[^\w])(\d{{4}})$', 1) AS INT) BETWEEN 1900 AND 2100 AND NOT (regexp_matches(lx, '^\d{{4}}$') AND regexp_matches(coalesce(la, ''), '\w$')) AS before FROM vl),
cx AS (SELECT doc_id, line, nth, cited, value, places, percent, word, CASE WHEN word IN ({_IN(REFERENCE)}) THEN 'reference'
  WHEN whole AND regexp_extract(ahead, '([A-Za-z]+)$', 1) <> '' AND lower(regexp_extract(ahead, '([A-Za-z]+)$', 1) || digits) IN ('s1', 's2', 's3') THEN 'step'
  WHEN whole AND nth = 0 AND NOT regexp_matches(ahead, '\S') AND regexp_matches(behind, '^[.)](?:\s|$)') AND NOT (length(behind) = 1 AND nx IS NOT NULL) THEN 'list'
  WHEN fits AND ((NOT regexp_matches(cited, '^[-+]') AND word IN ({_IN(DATED)})) OR coalesce(after, false) OR coalesce(before, false)) THEN 'year'
  WHEN value IN (1, 5, 10, 0.01::DOUBLE, 0.05::DOUBLE, 0.1::DOUBLE) AND about THEN 'level' END AS exempt FROM yr)"""
STEPS = ["s1", "s2", "s3"]


@register("number_context", f"{_CLAIMS} SELECT doc_id, line::INT AS line, nth::INT AS nth, cited, {_r('value')}, places::INT AS places, percent, word, exempt FROM cx")
def number_context(spark, d):
    return claims.number_context(panel.table(spark, d, "documents"), STEPS)


@register("unsupported_claims", f"""{_CLAIMS}, fm AS (SELECT doc_id, line, nth, value AS v, places AS p FROM cx WHERE exempt IS NULL UNION ALL SELECT doc_id, line, nth, value / 100, places + 2 FROM cx WHERE exempt IS NULL AND percent),
ok AS (SELECT DISTINCT doc_id, line, nth FROM fm JOIN (SELECT DISTINCT l_quantity AS q FROM lineitem) ON round(v * pow(10, p)) = round(q * pow(10, p)))
SELECT doc_id, line::INT AS line, nth::INT AS nth, cited, {_r('value')} FROM cx ANTI JOIN ok USING (doc_id, line, nth) WHERE exempt IS NULL""")
def unsupported_claims(spark, d):
    """Claims of documents that no quantity of a line bears out."""
    quantities = panel.table(spark, d, "lineitem").select(F.col("l_quantity").alias("value"))
    return claims.unsupported(panel.table(spark, d, "documents"), quantities, STEPS)


@register("nearest_in_scope", f"""SELECT query_id, vec_id, round(distance, {DIGITS}) AS distance FROM (SELECT q.vec_id AS query_id, v.vec_id AS vec_id, round(1 - list_cosine_similarity(v.embedding::DOUBLE[], q.embedding::DOUBLE[]), 9) AS distance
FROM embeddings v JOIN embeddings q ON q.vec_id % 100 = 0 AND v.label % 2 = q.label % 2) QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) <= 10""")
def nearest_in_scope(spark, d):
    """The nearest vectors of the same scope, whether a label is odd, for every vector whose id is divisible by 100."""
    vectors = panel.table(spark, d, "embeddings").withColumn("odd", F.col("label") % 2)
    return retrieval.nearest_in_scope(vectors, vectors.where("vec_id % 100 = 0"), 10, ["odd"])
