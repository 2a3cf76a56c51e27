"""The registered queries of the statistical operators, and the SQL that checks them.

Assets are the daily revenues by return flag; the market is their total. Figures are rounded, as sums of doubles
depend on the order of the rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import sql
from .functions import distributions
from .operators import conditional, diagnostics, efficiency, events, multivariate, pricing, systems, telemetry, volatility
from .operators.gram import fitted, ols
from .operators.robust import robust_ols
from .sources import panel, upload

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

DIGITS = 6

_SERIES = """WITH lv AS (SELECT l_returnflag AS symbol, l_shipdate::DATE AS ts, sum(l_extendedprice * (1 - l_discount)) AS value FROM lineitem GROUP BY 1, 2),
mk AS (SELECT l_shipdate::DATE AS ts, sum(l_extendedprice * (1 - l_discount)) AS value FROM lineitem GROUP BY 1),
r0 AS (SELECT symbol, ts, ln(value / lag(value) OVER (PARTITION BY symbol ORDER BY ts)) AS r FROM lv),
rt AS (SELECT * FROM r0 WHERE r IS NOT NULL),
m0 AS (SELECT ts, ln(value / lag(value) OVER (ORDER BY ts)) AS m FROM mk),
al AS (SELECT symbol, ts, r, m FROM rt JOIN m0 USING (ts) WHERE m IS NOT NULL),
fit AS (SELECT symbol, regr_slope(r, m) AS b, regr_intercept(r, m) AS a FROM al GROUP BY symbol),
rs AS (SELECT symbol, ts, r, m, r - a - b * m AS e FROM al JOIN fit USING (symbol))"""


def register(name: str, sql: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        def query(spark: SparkSession, sf_dir: str) -> DataFrame:
            df = f(spark, sf_dir)
            return df.select(*[F.round(c, DIGITS).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])

        QUERIES[name] = query
        if sql:
            ORACLES[name] = f"{_SERIES}\n{sql}" if "FROM" in sql else sql
        return f

    return add


def _r(*columns: str) -> str:
    return ", ".join(f"round({c.split(' AS ')[0]}, {DIGITS}) AS {c.split(' AS ')[-1]}" for c in columns)


def _levels(spark: SparkSession, d: str) -> DataFrame:
    return panel.levels(panel.table(spark, d, "lineitem"))


def _returns(spark: SparkSession, d: str) -> DataFrame:
    return panel.returns(_levels(spark, d))


def _aligned(spark: SparkSession, d: str) -> DataFrame:
    return panel.aligned(_returns(spark, d), panel.returns(panel.market(panel.table(spark, d, "lineitem"))))


def _residuals(spark: SparkSession, d: str) -> DataFrame:
    a = _aligned(spark, d)
    return fitted(a, ols(a, "r", ["m"], ["symbol"]), "r", ["m"], ["symbol"])


SEGMENTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]


def _factors(spark: SparkSession, d: str) -> DataFrame:
    """Daily log changes of order totals by market segment, as factor columns; null on dates that one lacks."""
    orders = panel.table(spark, d, "orders").join(panel.table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    series = orders.groupBy(F.col("c_mktsegment").alias("symbol"), F.to_date("o_orderdate").alias("ts")).agg(F.sum("o_totalprice").alias("value"))
    return panel.outer_aligned(panel.returns(series), SEGMENTS, "r")


_FACTORS = """, sg AS (SELECT c_mktsegment AS g, o_orderdate::DATE AS ts, sum(o_totalprice) AS value FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2),
sr AS (SELECT g, ts, ln(value / lag(value) OVER (PARTITION BY g ORDER BY ts)) AS f FROM sg),
fp AS (SELECT ts, """ + ", ".join(f"max(f) FILTER (WHERE g = '{g}') AS {g}" for g in SEGMENTS) + """ FROM sr GROUP BY ts),
fr AS (SELECT rt.symbol, rt.ts, r, fp.* EXCLUDE (ts) FROM rt LEFT JOIN fp ON rt.ts = fp.ts)"""


@register("levels", f"SELECT symbol, ts, {_r('value')} FROM lv")
def levels(spark, d):
    return _levels(spark, d)


@register("log_returns", f"SELECT symbol, ts, {_r('r')} FROM rt")
def log_returns(spark, d):
    return _returns(spark, d)


@register("simple_returns", f"""SELECT symbol, ts, {_r('r')} FROM (
SELECT symbol, ts, value / lag(value) OVER (PARTITION BY symbol ORDER BY ts) - 1 AS r FROM lv) WHERE r IS NOT NULL""")
def simple_returns(spark, d):
    return panel.returns(_levels(spark, d), "simple")


for _rule, _end in {
    "W": "(date_trunc('week', ts) + INTERVAL 6 DAY)::DATE", "M": "last_day(ts)",
    "Q": "(date_trunc('quarter', ts) + INTERVAL 3 MONTH - INTERVAL 1 DAY)::DATE", "A": "(date_trunc('year', ts) + INTERVAL 1 YEAR - INTERVAL 1 DAY)::DATE",
}.items():
    register(f"resample_{_rule.lower()}", f"SELECT symbol, {_end} AS period_end, round(arg_max(value, ts), {DIGITS}) AS value, count(*) AS n FROM lv GROUP BY 1, 2")(
        lambda spark, d, rule=_rule: panel.resampled(_levels(spark, d), rule)
    )


@register("quality_report", """, e AS (SELECT *, date_diff('day', lag(ts) OVER (PARTITION BY symbol ORDER BY ts), ts) AS gap FROM lv),
s AS (SELECT symbol, count(*) AS n, min(ts) AS first, max(ts) AS last, max(gap)::INT AS longest_gap, count(*) FILTER (WHERE value <= 0) AS not_positive FROM e GROUP BY 1),
c AS (SELECT ts, count(*) AS have FROM lv GROUP BY 1),
w AS (SELECT count(*) AS calendar, count(*) FILTER (WHERE have = (SELECT count(*) FROM s)) AS common FROM c)
SELECT symbol, n, first, last, longest_gap, not_positive, calendar - common AS dropped, n < 30 AS short_sample,
date_diff('day', (SELECT min(first) FROM s), first) > 30 AS late_start, common < calendar AS calendar_misalignment FROM s, w""")
def quality_report(spark, d):
    return panel.quality(_levels(spark, d))


@register("as_of_rate", f"""SELECT l.symbol, l.ts, {_r('l.value AS value')}, round(coalesce(q.value, (SELECT arg_min(value, ts) FROM q)), {DIGITS}) AS rate
FROM lv l ASOF LEFT JOIN q ON l.ts >= q.ts""".replace("SELECT l.symbol", """, q AS (SELECT last_day(o_orderdate::DATE) AS ts, avg(o_totalprice) / 1e7 AS value FROM orders GROUP BY 1)
SELECT l.symbol""", 1))
def as_of_rate(spark, d):
    """Each level with the latest month-end mean order price as a rate."""
    rates = panel.table(spark, d, "orders").groupBy(F.last_day(F.to_date("o_orderdate")).alias("ts")).agg((F.avg("o_totalprice") / 1e7).alias("rate"))
    return panel.as_of(_levels(spark, d), rates, "rate", by=None)


@register("capm", f"""SELECT symbol, nobs, {_r('alpha', 'beta', 'r2', 'alpha_se', 'beta_se', 'alpha / alpha_se AS alpha_t', 'beta / beta_se AS beta_t')},
round({sql.t_p('(alpha / alpha_se)', '(nobs - 2)')}, {DIGITS}) AS alpha_p, round({sql.t_p('(beta / beta_se)', '(nobs - 2)')}, {DIGITS}) AS beta_p, {_r('pow(1 + alpha, 252) - 1 AS alpha_annualised')}
FROM (SELECT *, sqrt(mse * (1.0 / nobs + mx * mx / sxx)) AS alpha_se, sqrt(mse / sxx) AS beta_se
FROM (SELECT *, (syy - sxy * sxy / sxx) / (nobs - 2) AS mse FROM (SELECT symbol, count(*) AS nobs, regr_slope(r, m) AS beta, regr_intercept(r, m) AS alpha,
regr_r2(r, m) AS r2, regr_sxx(r, m) AS sxx, regr_syy(r, m) AS syy, regr_sxy(r, m) AS sxy, avg(m) AS mx FROM al GROUP BY symbol)) WHERE nobs >= 30)""")
def capm(spark, d):
    return pricing.capm(_aligned(spark, d))


@register("capm_confidence")
def capm_confidence(spark, d):
    return pricing.capm_intervals(pricing.capm(_aligned(spark, d)))


def _factor_query(k: int):
    def query(spark, d):
        rows = _returns(spark, d).join(_factors(spark, d), "ts", "left")
        return pricing.factor_model(rows, SEGMENTS[:k])

    names = SEGMENTS[:k]
    register(f"factor_model_{k}", f"{_FACTORS}, {sql.least_squares('fm', 'fr', ['symbol'], names, 'r')} SELECT * FROM ({sql.terms('fm', ['symbol'], ['const', *names], DIGITS)}) WHERE nobs >= 30")(query)


for _k in (3, 4, 5):
    _factor_query(_k)


@register("rolling_beta", f"""SELECT symbol, ts, {_r('b AS beta', 'sqrt((syy - b * sxy) / 250 / sxx) AS beta_se')} FROM (
SELECT symbol, ts, count(*) OVER w AS n, regr_slope(r, m) OVER w AS b, var_pop(m) OVER w AS sxx, covar_pop(r, m) OVER w AS sxy, var_pop(r) OVER w AS syy FROM al
WINDOW w AS (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 251 PRECEDING AND CURRENT ROW)) WHERE n = 252""")
def rolling_beta(spark, d):
    return pricing.rolling_beta(_aligned(spark, d))


@register("fama_macbeth", f"""SELECT term, count(*) AS periods, {_r('avg(b) AS premium', 'stddev_samp(b) / sqrt(count(*)) AS std_error', 'avg(b) / (stddev_samp(b) / sqrt(count(*))) AS t_stat')},
round({sql.t_p('(avg(b) / (stddev_samp(b) / sqrt(count(*))))', '(count(*) - 1)')}, {DIGITS}) AS p_value
FROM (SELECT y, unnest(['const', 'x']) AS term, unnest([a, b]) AS b FROM (
SELECT year(l_shipdate) AS y, l_suppkey, sum(l_extendedprice) / 1e6 AS r, avg(l_quantity) AS x FROM lineitem GROUP BY 1, 2) JOIN (
SELECT yy, regr_intercept(r, x) AS a, regr_slope(r, x) AS b FROM (SELECT year(l_shipdate) AS yy, l_suppkey, sum(l_extendedprice) / 1e6 AS r, avg(l_quantity) AS x FROM lineitem GROUP BY 1, 2)
GROUP BY yy HAVING count(*) >= 3) ON y = yy GROUP BY y, a, b) GROUP BY term""")
def fama_macbeth(spark, d):
    """Suppliers' yearly revenue on their mean order quantity."""
    lines = panel.table(spark, d, "lineitem").groupBy(F.year("l_shipdate").alias("ts"), F.col("l_suppkey").alias("symbol"))
    return pricing.fama_macbeth(lines.agg((F.sum("l_extendedprice") / 1e6).alias("r"), F.avg("l_quantity").alias("x")), ["x"])


@register("grs_test", f""", w AS (SELECT ts, any_value(m) AS m, max(r) FILTER (WHERE symbol = 'A') AS p1, max(r) FILTER (WHERE symbol = 'N') AS p2, max(r) FILTER (WHERE symbol = 'R') AS p3 FROM al GROUP BY ts),
v AS (SELECT * FROM w WHERE p1 IS NOT NULL AND p2 IS NOT NULL AND p3 IS NOT NULL),
b AS (SELECT regr_slope(p1, m) AS b1, regr_slope(p2, m) AS b2, regr_slope(p3, m) AS b3, regr_intercept(p1, m) AS a1, regr_intercept(p2, m) AS a2, regr_intercept(p3, m) AS a3, avg(m) AS mu, var_pop(m) AS om, count(*) AS t FROM v),
e AS (SELECT p1 - a1 - b1 * m AS e1, p2 - a2 - b2 * m AS e2, p3 - a3 - b3 * m AS e3 FROM v, b),
s AS (SELECT avg(e1 * e1) AS s11, avg(e1 * e2) AS s12, avg(e1 * e3) AS s13, avg(e2 * e2) AS s22, avg(e2 * e3) AS s23, avg(e3 * e3) AS s33 FROM e),
j AS (SELECT *, s22 * s33 - s23 * s23 AS i11, s13 * s23 - s12 * s33 AS i12, s12 * s23 - s13 * s22 AS i13, s11 * s33 - s13 * s13 AS i22, s12 * s13 - s11 * s23 AS i23, s11 * s22 - s12 * s12 AS i33 FROM s, b),
g AS (SELECT t, (t - 4) / 3.0::DOUBLE * ((a1 * a1 * i11 + a2 * a2 * i22 + a3 * a3 * i33 + 2 * (a1 * a2 * i12 + a1 * a3 * i13 + a2 * a3 * i23)) / (s11 * i11 + s12 * i12 + s13 * i13)) / (1 + mu * mu / om) AS grs FROM j)
SELECT 3::INT AS portfolios, t AS nobs, {_r('grs')}, round({sql.f_p('grs', 3, '(t - 4)')}, {DIGITS}) AS p_value FROM g""")
def grs_test(spark, d):
    return pricing.grs(_aligned(spark, d), ["m"])


_TAIL = """, k AS (SELECT symbol, r, row_number() OVER (PARTITION BY symbol ORDER BY r) AS k, count(*) OVER (PARTITION BY symbol) AS n FROM rt),
q AS (SELECT symbol, n, r AS q FROM k WHERE k = floor((n - 1) * (1.0::DOUBLE - 0.95::DOUBLE))::BIGINT + 1)"""


@register("historical_var", f"""{_TAIL} SELECT symbol, n, {_r('-q AS var')}, count(*) AS n_tail, {_r('-avg(r) AS cvar')} FROM rt JOIN q USING (symbol) WHERE r <= q AND n >= 100 GROUP BY symbol, n, q""")
def historical_var(spark, d):
    return volatility.historical_var(_returns(spark, d))


@register("parametric_var", f"""SELECT symbol, count(r) AS n, {_r('avg(r) AS mu', 'stddev_samp(r) AS sigma', '-(avg(r) + stddev_samp(r) * -1.6448536269514722) AS var')} FROM rt GROUP BY symbol""")
def parametric_var(spark, d):
    return volatility.parametric_var(_returns(spark, d))


@register("realized_vol", f"""SELECT symbol, ts, {_r('CASE WHEN count(*) OVER w = 21 THEN sqrt(avg(r * r) OVER w) END AS vol')} FROM rt
WINDOW w AS (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 20 PRECEDING AND CURRENT ROW)""")
def realized_vol(spark, d):
    return volatility.realized_vol(_returns(spark, d))


@register("ewma_vol", f"""SELECT symbol, n, {_r('sqrt(v) AS vol', 'sqrt(v) * sqrt(252) AS annualised')} FROM (SELECT symbol, count(*) AS n,
list_reduce(list(r * r ORDER BY ts), lambda v, x : 0.94::DOUBLE * v + (1 - 0.94::DOUBLE) * x) AS v FROM rt GROUP BY symbol)""")
def ewma_vol(spark, d):
    return volatility.ewma_vol(_returns(spark, d))


_SPELLS = f""", u AS (SELECT symbol, ts, 1 - value / max(value) OVER (PARTITION BY symbol ORDER BY ts) AS dd FROM lv),
y AS (SELECT *, sum((dd <= 0)::INT) OVER (PARTITION BY symbol ORDER BY ts) AS spell FROM u),
tr AS (SELECT symbol, spell, ts AS trough FROM y QUALIFY row_number() OVER (PARTITION BY symbol, spell ORDER BY dd DESC, ts) = 1),
z AS (SELECT symbol, spell, max(dd) AS depth, max(ts) FILTER (WHERE dd <= 0) AS peak, max(ts) AS last FROM y GROUP BY 1, 2),
q AS (SELECT z.*, trough, lead(peak) OVER (PARTITION BY symbol ORDER BY spell) AS recovery FROM z JOIN tr USING (symbol, spell)),
w AS (SELECT * FROM q QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY CASE WHEN depth > 0 THEN depth END DESC NULLS LAST, spell) = 1),
c AS (SELECT symbol, arg_max(dd, ts) AS current FROM u GROUP BY 1),
t AS (SELECT symbol, max(depth) AS max_drawdown, count(*) FILTER (WHERE depth > 0) AS episodes, max(CASE WHEN depth > 0 THEN date_diff('day', peak, coalesce(recovery, last)) ELSE 0 END)::INT AS longest_days FROM q GROUP BY 1)
SELECT symbol, {_r('max_drawdown')}, peak, trough, recovery, episodes, longest_days, {_r('current')} FROM t JOIN w USING (symbol) JOIN c USING (symbol)"""


@register("drawdown", _SPELLS)
def drawdown(spark, d):
    return volatility.drawdown(_levels(spark, d))


@register("drawdown_spells", _SPELLS)
def drawdown_spells(spark, d):
    return volatility.drawdown(_levels(spark, d))


_X = "CASE WHEN {0} > 0 THEN {0} * ln({1}) ELSE 0 END"


_UC = f"-2 * ({_X.format('(n - x)', '0.95')} + {_X.format('x', '0.05')} - {_X.format('(n - x)', '(1 - x / n)')} - {_X.format('x', '(x / n)')})"


@register("kupiec_test", f"""SELECT symbol, n, x AS violations, {_r('lr')}, round({sql.chi2_p('lr', 1)}, {DIGITS}) AS p_value
FROM (SELECT *, {_UC} AS lr FROM (SELECT symbol, count(*) AS n, count(*) FILTER (WHERE r < -0.9) AS x FROM rt GROUP BY symbol))""")
def kupiec_test(spark, d):
    return volatility.kupiec(_returns(spark, d), F.lit(0.9))


@register("christoffersen_test", f""", h AS (SELECT symbol, (r < -0.9)::INT AS h, lag((r < -0.9)::INT) OVER (PARTITION BY symbol ORDER BY ts) AS b FROM rt),
n AS (SELECT symbol, count(*) FILTER (WHERE b = 0 AND h = 0) AS n00, count(*) FILTER (WHERE b = 0 AND h = 1) AS n01,
count(*) FILTER (WHERE b = 1 AND h = 0) AS n10, count(*) FILTER (WHERE b = 1 AND h = 1) AS n11 FROM h WHERE b IS NOT NULL GROUP BY symbol),
p AS (SELECT *, (n01 + n11) / (n00 + n01 + n10 + n11) AS pi, n01 / nullif(n00 + n01, 0) AS p0, n11 / nullif(n10 + n11, 0) AS p1, (n01 + n11 = 0) OR (n00 + n10 = 0) AS bare FROM n),
l AS (SELECT *, CASE WHEN bare THEN 0.0 ELSE -2 * ({_X.format('(n00 + n10)', '(1 - pi)')} + {_X.format('(n01 + n11)', 'pi')} - {_X.format('n00', '(1 - p0)')} - {_X.format('n01', 'p0')} - {_X.format('n10', '(1 - p1)')} - {_X.format('n11', 'p1')}) END AS lr FROM p),
k AS (SELECT symbol, {_UC} AS lr_uc FROM (SELECT symbol, count(*) AS n, count(*) FILTER (WHERE r < -0.9) AS x FROM rt GROUP BY symbol)),
a AS (SELECT *, lr + lr_uc AS lr_cc FROM l JOIN k USING (symbol)), z AS (SELECT *, {sql.chi2_p('lr', 1)} AS p_value, {sql.chi2_p('lr_cc', 2)} AS p_value_cc FROM a)
SELECT symbol, n00, n01, n10, n11, {_r('lr', 'p_value', 'lr_uc', 'lr_cc', 'p_value_cc')}, CASE WHEN NOT bare THEN p_value >= 0.05 AND p_value_cc >= 0.05 END AS passed FROM z""")
def christoffersen_test(spark, d):
    return volatility.christoffersen(_returns(spark, d), F.lit(0.9))


@register("garch")
def garch(spark, d):
    return conditional.garch(_returns(spark, d))


_ACF = """, d AS (SELECT symbol, ts, r - avg(r) OVER (PARTITION BY symbol) AS d FROM rt),
a AS (SELECT symbol, k AS lag, sum(x) / any_value(c0) AS acf, any_value(n) AS n FROM (
SELECT symbol, k, d * lag(d, k) OVER (PARTITION BY symbol, k ORDER BY ts) AS x, sum(d * d) OVER (PARTITION BY symbol, k) AS c0, count(*) OVER (PARTITION BY symbol, k) AS n
FROM d, (SELECT unnest(range(1, 11))::INT AS k)) GROUP BY symbol, k)"""


@register("acf", f"""{_ACF} SELECT symbol, n, lag, {_r('acf')}, round(1.959963984540054 * sqrt((1 + 2 * coalesce(sum(acf * acf) OVER w, 0)) / n), {DIGITS}) AS band FROM a
WINDOW w AS (PARTITION BY symbol ORDER BY lag ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""")
def acf(spark, d):
    return efficiency.autocorrelation(_returns(spark, d), 10)


@register("ljung_box", f"""{_ACF}, q AS (SELECT symbol, n, n * (n + 2) * sum(acf * acf / (n - lag)) AS statistic FROM a GROUP BY symbol, n)
SELECT symbol, n, 10 AS lags, {_r('statistic')}, round({sql.chi2_p('statistic', 10)}, {DIGITS}) AS p_value FROM q""")
def ljung_box(spark, d):
    return efficiency.ljung_box(_returns(spark, d), 10)


@register("runs_test", f"""{_ACF}, u AS (SELECT symbol, ts, d > 0 AS up FROM d WHERE d <> 0),
w AS (SELECT symbol, up, coalesce(up <> lag(up) OVER (PARTITION BY symbol ORDER BY ts), true) AS new FROM u),
s AS (SELECT symbol, count(*) FILTER (WHERE up) AS p, count(*) FILTER (WHERE NOT up) AS q, count(*) FILTER (WHERE new) AS runs FROM w GROUP BY symbol),
e AS (SELECT *, 2.0::DOUBLE * p * q / (p + q) + 1 AS mean, 2.0::DOUBLE * p * q * (2.0::DOUBLE * p * q - (p + q)) / ((p + q)::DOUBLE * (p + q) * (p + q - 1)) AS var FROM s)
SELECT symbol, p AS positive, q AS negative, runs, round(mean, {DIGITS}) AS expected, round((runs - mean) / sqrt(var), {DIGITS}) AS z,
round({sql.normal_p('((runs - mean) / sqrt(var))')}, {DIGITS}) AS p_value FROM e""")
def runs_test(spark, d):
    return efficiency.runs_test(_returns(spark, d))


@register("variance_ratio", f""", x AS (SELECT symbol, ts, ln(value) AS x FROM lv),
y AS (SELECT symbol, k AS horizon, x - lag(x) OVER w AS d, x - lag(x, k) OVER w AS q FROM x, (SELECT unnest([2, 4, 8, 16])::INT AS k) WINDOW w AS (PARTITION BY symbol, k ORDER BY ts)),
s AS (SELECT symbol, horizon, count(d) AS n, avg(d) AS mu, count(d) * var_pop(d) AS s1 FROM y GROUP BY ALL),
z AS (SELECT symbol, horizon, any_value(n) AS n, any_value(s1) AS s1, sum(pow(q - horizon * mu, 2)) AS sq FROM y JOIN s USING (symbol, horizon) GROUP BY ALL),
v AS (SELECT *, (sq / (horizon * (n - horizon + 1) * (1 - horizon::DOUBLE / n))) / (s1 / (n - 1)) AS vr FROM z),
dx AS (SELECT symbol, ts, x - lag(x) OVER (PARTITION BY symbol ORDER BY ts) AS d FROM x),
e0 AS (SELECT dx.symbol, dx.ts, pow(dx.d - s.mu, 2) AS e FROM dx JOIN s ON dx.symbol = s.symbol AND s.horizon = 2 WHERE dx.d IS NOT NULL),
hk AS (SELECT symbol, k, sum(x) AS h FROM (SELECT symbol, k, e * lag(e, k) OVER (PARTITION BY symbol, k ORDER BY ts) AS x FROM e0, (SELECT unnest(range(1, 16))::INT AS k)) GROUP BY 1, 2),
th AS (SELECT v.symbol, horizon, sum(pow(2.0::DOUBLE * (horizon - k) / horizon, 2) * h / (s1 * s1)) AS theta FROM v JOIN hk ON v.symbol = hk.symbol AND k < horizon GROUP BY 1, 2),
vz AS (SELECT v.*, (vr - 1) / sqrt(theta) AS z_robust FROM v JOIN th USING (symbol, horizon))
SELECT symbol, n, horizon, {_r('vr', '(vr - 1) / sqrt(2 * (2 * horizon - 1) * (horizon - 1) / (3.0::DOUBLE * horizon * n)) AS z', 'z_robust')}, round({sql.normal_p('z_robust')}, {DIGITS}) AS p_value FROM vz""")
def variance_ratio(spark, d):
    return efficiency.variance_ratio(_levels(spark, d), [2, 4, 8, 16])


def _unit_root(t: str, n: str, trend: str, series: int = 1) -> str:
    """p_value, critical values and passed."""
    p = sql.unit_root_p(t, distributions.SURFACES[trend, series])
    levels = [" + ".join(f"{x!r} / pow({n}, {i})" for i, x in enumerate(c)) for c in distributions.CRITICAL[trend, series]]
    return f"round({p}, {DIGITS}) AS p_value, " + ", ".join(f"round({v}, {DIGITS}) AS critical_{k}" for v, k in zip(levels, (1, 5, 10), strict=True)) + f", {p} < 0.05 AS passed"


def _dickey_fuller(source: str, column: str, lags: int, trend: str, series: int = 1, judged: str | None = None) -> str:
    """The rows of efficiency.adf() from a CTE of symbol, ts and the column."""
    xs = ["y1", *(["tm"] if trend == "ct" else []), *[f"d{k}" for k in range(1, lags + 1)]]
    at, k = int(trend != "n"), len(xs) + (trend != "n")
    return f""", df0 AS (SELECT symbol, ts, {column} - lag({column}) OVER w AS d, lag({column}) OVER w AS y1, row_number() OVER w AS tm FROM {source} WINDOW w AS (PARTITION BY symbol ORDER BY ts)),
df1 AS (SELECT *, {", ".join(f"lag(d, {i}) OVER w AS d{i}" for i in range(1, lags + 1))} FROM df0 WINDOW w AS (PARTITION BY symbol ORDER BY ts)),
{sql.least_squares("dfl", "df1", ["symbol"], xs, "d", trend != "n")}, dft AS (SELECT symbol, n AS nobs, b_{at} AS estimate, b_{at} / sqrt(v_{at} * ssr / (n - {k})) AS statistic FROM dfl)
SELECT symbol, nobs, {lags} AS lags, {_r("statistic", "estimate")}, {_unit_root("statistic", "nobs", judged or trend, series)} FROM dft"""


@register("adf", _dickey_fuller("lv", "value", 4, "c"))
def adf(spark, d):
    return efficiency.adf(_levels(spark, d), lags=4)


@register("adf_trend", _dickey_fuller("lv", "value", 4, "ct"))
def adf_trend(spark, d):
    return efficiency.adf(_levels(spark, d), lags=4, trend="ct")


@register("adf_none", _dickey_fuller("rt", "r", 2, "n"))
def adf_none(spark, d):
    return efficiency.adf(_returns(spark, d), lags=2, column="r", trend="n")


@register("adf_own_lags")
def adf_own_lags(spark, d):
    return efficiency.adf(_levels(spark, d))


def _kpss(trend: str) -> str:
    time = "row_number() OVER (PARTITION BY symbol ORDER BY ts)"
    centre = "value - avg(value) OVER (PARTITION BY symbol)" if trend == "c" else "value - a - b * tm"
    rows = "lv" if trend == "c" else "tv JOIN (SELECT symbol, regr_slope(value, tm) AS b, regr_intercept(value, tm) AS a FROM tv GROUP BY symbol) USING (symbol)"
    table, p = distributions.KPSS_CRITICAL[trend], ""
    for (a, x), (b, y) in zip(table, table[1:], strict=False):
        p += f" WHEN st < {b} THEN {x} + (st - {a}) * ({y} - {x}) / ({b} - {a})"
    p = f"CASE WHEN st <= {table[0][0]} THEN {table[0][1]}{p} ELSE {table[-1][1]} END"
    return f""", tv AS (SELECT *, {time} AS tm FROM lv), dd AS (SELECT symbol, ts, {centre} AS d FROM {rows}),
c AS (SELECT symbol, d, sum(d) OVER (PARTITION BY symbol ORDER BY ts) AS s FROM dd),
l AS (SELECT symbol, d * lag(d, k) OVER (PARTITION BY symbol, k ORDER BY ts) * 2 * (1 - k / 9.0::DOUBLE) AS x FROM dd, (SELECT unnest(range(1, 9))::INT AS k)),
st AS (SELECT symbol, n, ss / (n * n * ((c0 + x) / n)) AS st FROM (SELECT symbol, count(*) AS n, sum(s * s) AS ss, sum(d * d) AS c0 FROM c GROUP BY 1) JOIN (SELECT symbol, sum(x) AS x FROM l GROUP BY 1) USING (symbol))
SELECT symbol, n, 8 AS lags, {_r("st AS statistic")}, round({p}, {DIGITS}) AS p_value, ({p}) >= 0.05 AS passed FROM st"""


@register("kpss", _kpss("c"))
def kpss(spark, d):
    return efficiency.kpss(_levels(spark, d), lags=8)


@register("kpss_trend", _kpss("ct"))
def kpss_trend(spark, d):
    return efficiency.kpss(_levels(spark, d), lags=8, trend="ct")


@register("hurst", f""", i AS (SELECT symbol, r, row_number() OVER (PARTITION BY symbol ORDER BY ts) - 1 AS i, count(*) OVER (PARTITION BY symbol) AS n FROM rt),
g AS (SELECT DISTINCT symbol, n, round_even(16 * pow(2, k / 2.0::DOUBLE), 0)::INT AS w FROM (SELECT DISTINCT symbol, n FROM i), (SELECT unnest(range(0, 40)) AS k)),
x AS (SELECT i.symbol, w, i // w AS blk, i, r FROM i JOIN g ON i.symbol = g.symbol AND w <= i.n // 4 WHERE i // w < i.n // w),
dm AS (SELECT *, r - avg(r) OVER (PARTITION BY symbol, w, blk) AS d FROM x), cs AS (SELECT *, sum(d) OVER (PARTITION BY symbol, w, blk ORDER BY i) AS c FROM dm),
b AS (SELECT symbol, w, (max(c) - min(c)) / stddev_samp(r) AS rs FROM cs GROUP BY symbol, w, blk HAVING stddev_samp(r) > 0),
s AS (SELECT symbol, w, ln(avg(rs)) AS y, ln((w - 0.5) / w * CASE WHEN w <= {efficiency.EXACT} THEN exp(lgamma((w - 1) / 2.0::DOUBLE) - lgamma(w / 2.0::DOUBLE)) / sqrt(pi()) ELSE 1 / sqrt(w * pi() / 2) END
* list_sum(list_transform(range(1, w), lambda j: sqrt((w - j) / j)))) AS z FROM b GROUP BY symbol, w)
SELECT symbol, count(*) AS windows, {_r('regr_slope(y, ln(w)) AS slope', 'regr_slope(y, ln(w)) - regr_slope(z, ln(w)) + 0.5 AS hurst')} FROM s GROUP BY symbol""")
def hurst(spark, d):
    return efficiency.hurst(_returns(spark, d))


@register("bds", f""", x AS (SELECT symbol, row_number() OVER w AS i, r AS x0, lead(r) OVER w AS x1, lead(r, 2) OVER w AS x2 FROM rt WINDOW w AS (PARTITION BY symbol ORDER BY ts)),
e AS (SELECT symbol, count(*)::DOUBLE AS n, 1.5 * stddev_samp(x0) AS eps FROM x GROUP BY symbol),
t AS (SELECT a.symbol, a.i, any_value(n) AS n, count(*) FILTER (WHERE abs(a.x0 - b.x0) < eps) AS near, count(*) FILTER (WHERE abs(a.x0 - b.x0) < eps AND b.i > a.i) AS one,
count(*) FILTER (WHERE abs(a.x0 - b.x0) < eps AND abs(a.x1 - b.x1) < eps AND b.i > a.i) AS all2,
count(*) FILTER (WHERE abs(a.x0 - b.x0) < eps AND abs(a.x1 - b.x1) < eps AND abs(a.x2 - b.x2) < eps AND b.i > a.i) AS all3
FROM x a JOIN x b USING (symbol) JOIN e USING (symbol) GROUP BY a.symbol, a.i),
g AS (SELECT symbol, any_value(n) AS n, sum(near)::DOUBLE AS s, sum(near * near)::DOUBLE AS s2, sum(one) FILTER (WHERE i >= 2) AS one2, sum(one) FILTER (WHERE i >= 3) AS one3, sum(all2) AS all2, sum(all3) AS all3 FROM t GROUP BY symbol),
h AS (SELECT symbol, n, (s - n) / (n * (n - 1)) AS c, (s2 - 3 * s + 2 * n) / (n * (n - 1) * (n - 2)) AS k, unnest([2, 3]) AS m, unnest([one2, one3])::DOUBLE AS one, unnest([all2, all3])::DOUBLE AS every FROM g),
f AS (SELECT *, (n - m + 1) * (n - m) / 2 AS pairs, 4 * (pow(k, m) + 2 * (pow(k, m - 1) * c * c + CASE WHEN m = 3 THEN k * pow(c, 4) ELSE 0 END) + pow(m - 1, 2) * pow(c, 2 * m) - m * m * k * pow(c, 2 * m - 2)) AS v FROM h)
, o AS (SELECT n, symbol, m, sqrt(n - m + 1) * (every / pairs - pow(one / pairs, m)) / sqrt(v) AS st FROM f)
SELECT symbol, n::BIGINT AS n, m::INT AS dimension, {_r('st AS statistic')}, round({sql.normal_p('st')}, {DIGITS}) AS p_value FROM o""")
def bds(spark, d):
    return efficiency.bds(_returns(spark, d), (2, 3))


@register("efficiency_score")
def efficiency_score(spark, d):
    return efficiency.efficiency_score(_levels(spark, d), lags=8, horizons=[2, 4, 8, 16])


@register("jarque_bera", f"""SELECT symbol, count(e) AS n, round(s, {DIGITS}) AS skewness, round(k, {DIGITS}) AS excess_kurtosis,
round(n / 6.0 * (s * s + k * k / 4), {DIGITS}) AS statistic, round(exp(-n / 6.0 * (s * s + k * k / 4) / 2), {DIGITS}) AS p_value FROM (
SELECT symbol, e, count(e) OVER p AS n, avg(pow(z, 3)) OVER p AS s, avg(pow(z, 4)) OVER p - 3 AS k FROM (
SELECT symbol, e, (e - avg(e) OVER (PARTITION BY symbol)) / stddev_pop(e) OVER (PARTITION BY symbol) AS z FROM rs) WINDOW p AS (PARTITION BY symbol))
GROUP BY symbol, s, k, n""")
def jarque_bera(spark, d):
    return diagnostics.jarque_bera(_residuals(spark, d))


@register("durbin_watson", f"""SELECT symbol, round(sum(x * x) / sum(e * e), {DIGITS}) AS statistic, sum(x * x) / sum(e * e) BETWEEN 1.5 AND 2.5 AS passed FROM (
SELECT symbol, e, e - lag(e) OVER (PARTITION BY symbol ORDER BY ts) AS x FROM rs) GROUP BY symbol""")
def durbin_watson(spark, d):
    return diagnostics.durbin_watson(_residuals(spark, d))


@register("breusch_pagan", f"SELECT symbol, n, {_r('st AS statistic')}, round({sql.chi2_p('st', 1)}, {DIGITS}) AS p_value FROM (SELECT symbol, count(*) AS n, count(*) * regr_r2(e * e, m) AS st FROM rs GROUP BY symbol)")
def breusch_pagan(spark, d):
    return diagnostics.breusch_pagan(_residuals(spark, d), ["m"])


def _lm(rows: str, xs: list[str], y: str) -> str:
    return f""", {sql.least_squares("lm", rows, ["symbol"], xs, y)}, st AS (SELECT symbol, n, n * (1 - ssr / sst) AS st FROM lm)
SELECT symbol, n, {_r("st AS statistic")}, round({sql.chi2_p("st", len(xs))}, {DIGITS}) AS p_value FROM st"""


@register("white_test", f"{_lm('rs', ['m', 'm * m'], 'e * e')}")
def white_test(spark, d):
    return diagnostics.white(_residuals(spark, d), ["m"])


_ARCH = ", ar AS (SELECT symbol, e * e AS e2, " + ", ".join(f"lag(e * e, {k}) OVER w AS l{k}" for k in range(1, 11)) + " FROM rs WINDOW w AS (PARTITION BY symbol ORDER BY ts))"


@register("arch_lm", f"{_ARCH} {_lm('ar', [f'l{k}' for k in range(1, 11)], 'e2')}")
def arch_lm(spark, d):
    return diagnostics.arch_lm(_residuals(spark, d), lags=10)


@register("arch_lm_first", f"{_ARCH} {_lm('ar', ['l1'], 'e2')}")
def arch_lm_first(spark, d):
    return diagnostics.arch_lm(_residuals(spark, d), lags=1)


def _vif() -> str:
    parts, selected = [], []
    for i, g in enumerate(SEGMENTS):
        rest = [x for x in SEGMENTS if x != g]
        whole = f"(SELECT * FROM fr WHERE {g} IS NOT NULL)"
        parts.append(sql.least_squares(f"v{i}", whole, ["symbol"], rest, g))
        selected.append(f"SELECT symbol, '{g}' AS regressor, round(sst / ssr, {DIGITS}) AS vif, sst / ssr <= 10 AS passed FROM v{i}")
    return f"{_FACTORS}, {', '.join(parts)} {' UNION ALL '.join(selected)}"


@register("vif", _vif())
def vif(spark, d):
    return diagnostics.vif(_returns(spark, d).join(_factors(spark, d), "ts"), SEGMENTS)


@register("cusum", f"""SELECT symbol, n, {_r('st AS statistic')}, round(CASE WHEN st > 0.2 THEN greatest(0, least(1, list_sum(list_transform(range(1, 41), lambda k: 2 * pow(-1, k - 1) * exp(-2 * k * k * st * st))))) ELSE 1 END, {DIGITS}) AS p_value FROM (
SELECT symbol, count(*) AS n, max(abs(c)) / sqrt(sum(x * x)) AS st FROM (
SELECT symbol, x, sum(x) OVER (PARTITION BY symbol ORDER BY ts) AS c FROM (SELECT symbol, ts, e - avg(e) OVER (PARTITION BY symbol) AS x FROM rs)) GROUP BY symbol)""")
def cusum(spark, d):
    return diagnostics.cusum(_residuals(spark, d))


@register("structural_break", f""", x AS (SELECT symbol, ts, e - avg(e) OVER (PARTITION BY symbol) AS x FROM rs),
c AS (SELECT symbol, count(*) OVER w AS k, count(*) OVER (PARTITION BY symbol) AS n, sum(x) OVER w AS s, stddev_pop(x) OVER (PARTITION BY symbol) AS sd FROM x WINDOW w AS (PARTITION BY symbol ORDER BY ts)),
g AS (SELECT symbol, k, s * s / k + s * s / (n - k) AS gain, abs(-s / (n - k) - s / k) / sd AS effect FROM c WHERE k >= 2 AND n - k >= 2 AND k % 5 = 0),
h AS (SELECT symbol, k, effect FROM g QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY gain DESC, k) = 1)
SELECT symbol, k AS position, {_r('effect')}, effect >= 0.5 AS material FROM h""")
def structural_break(spark, d):
    return diagnostics.structural_break(_residuals(spark, d))


_THREE = """, wd AS (SELECT ts, max(r) FILTER (WHERE symbol = 'A') AS A, max(r) FILTER (WHERE symbol = 'N') AS N, max(r) FILTER (WHERE symbol = 'R') AS R FROM rt GROUP BY ts),
wh AS (SELECT * FROM wd WHERE A IS NOT NULL AND N IS NOT NULL AND R IS NOT NULL)"""


def _lags(columns: str, deepest: int, source: str = "wh") -> str:
    each = ", ".join(f"lag({c}, {k}) OVER (ORDER BY ts) AS {c}{k}" for k in range(1, deepest + 1) for c in columns)
    return f", lg AS (SELECT *, {each} FROM {source})"


def _granger(deepest: int) -> str:
    parts, selected = [], []
    for p in range(1, deepest + 1):
        for cause, effect in ("AN", "NA"):
            own, both = [f"{effect}{k}" for k in range(1, p + 1)], [f"{c}{k}" for k in range(1, p + 1) for c in "AN"]
            rows, at = f"(SELECT * FROM lg WHERE A{p} IS NOT NULL)", f"{cause}{effect}{p}"
            parts += [sql.least_squares(f"s{at}", rows, [], own, effect), sql.least_squares(f"f{at}", rows, [], both, effect)]
            n, f, df2 = f"f{at}.n", f"((s{at}.ssr - f{at}.ssr) / {p} / (f{at}.ssr / (f{at}.n - {2 * p + 1})))", f"(f{at}.n - {2 * p + 1})"
            chi2, lr = f"({n} * (s{at}.ssr - f{at}.ssr) / f{at}.ssr)", f"({n} * ln(s{at}.ssr / f{at}.ssr))"
            for test, value, tail in (("ssr_ftest", f, sql.f_p(f, p, df2)), ("ssr_chi2test", chi2, sql.chi2_p(chi2, p)), ("lrtest", lr, sql.chi2_p(lr, p)), ("params_ftest", f, sql.f_p(f, p, df2))):
                selected.append(f"SELECT '{cause}' AS cause, '{effect}' AS effect, {p} AS lags, {n} AS nobs, '{test}' AS test, round({value}, {DIGITS}) AS statistic, round({tail}, {DIGITS}) AS p_value FROM s{at}, f{at}")
    return f"{_THREE}{_lags('ANR', deepest)}, {', '.join(parts)} {' UNION ALL '.join(selected)}"


@register("granger", _granger(3))
def granger(spark, d):
    return multivariate.granger(multivariate.wide(_returns(spark, d), ["A", "N", "R"]), "A", "N", 3)


def _var_model(lags: int) -> str:
    xs, parts, selected = [f"{c}{k}" for k in range(1, lags + 1) for c in "ANR"], [], []
    for c in "ANR":
        parts.append(sql.least_squares(f"e{c}", "lg", [], xs, c))
        selected.append(f"SELECT '{c}' AS equation, * FROM ({sql.terms(f'e{c}', [], ['const', *[f'{x[0]}_L{x[1:]}' for x in xs]], DIGITS)})")
    return f"{_THREE}{_lags('ANR', lags)}, {', '.join(parts)} {' UNION ALL '.join(selected)}"


@register("var_model", _var_model(2))
def var_model(spark, d):
    return multivariate.var_model(multivariate.wide(_returns(spark, d), ["A", "N", "R"]), ["A", "N", "R"], 2)


_SPREAD_ROWS = f""", wl AS (SELECT ts, max(value) FILTER (WHERE symbol = 'A') AS A, max(value) FILTER (WHERE symbol = 'N') AS N, max(value) FILTER (WHERE symbol = 'R') AS R FROM lv GROUP BY ts),
wh AS (SELECT * FROM wl WHERE A IS NOT NULL AND N IS NOT NULL AND R IS NOT NULL), {sql.least_squares("eg", "wh", [], ["N", "R"], "A")},
sp AS (SELECT 'A' AS symbol, ts, wh.A - b_0 - b_1 * wh.N - b_2 * wh.R AS value FROM wh, eg)"""


@register("engle_granger", f"{_SPREAD_ROWS}{_dickey_fuller('sp', 'value', 2, 'n', 3, 'c')}")
def engle_granger(spark, d):
    return multivariate.engle_granger(multivariate.wide(_levels(spark, d), ["A", "N", "R"], "value"), "A", ["N", "R"], 2)


_EVENTS = """, p AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts) AS pos FROM al),
ev AS (SELECT symbol, ts AS event, pos AS place FROM p WHERE day(ts) = 1 AND pos > 130),
f AS (SELECT ev.symbol, event, place, regr_slope(r, m) AS b, regr_intercept(r, m) AS a, (regr_syy(r, m) - regr_sxy(r, m) * regr_sxy(r, m) / regr_sxx(r, m)) / 118 AS mse
FROM ev JOIN p ON p.symbol = ev.symbol AND pos BETWEEN place - 130 AND place - 11 GROUP BY ALL),
c AS (SELECT f.symbol, event, count(*) AS n, sum(r - a - b * m) AS car, any_value(mse) AS mse FROM f JOIN p ON p.symbol = f.symbol AND pos BETWEEN place - 5 AND place + 5 GROUP BY ALL)
"""


@register("event_study", f"{_EVENTS} SELECT symbol, event, n, {_r('car', 'se AS std_error', 't AS t_stat')}, round({sql.t_p('t', '118')}, {DIGITS}) AS p_value, {sql.t_p('t', '118')} < 0.05 AS passed FROM (SELECT *, sqrt(n * mse) AS se, car / sqrt(n * mse) AS t FROM c)")
def event_study(spark, d):
    """The first of each month as the event."""
    return events.event_study(*_first_days(spark, d), **_WINDOWS)


_WINDOWS = {"estimation": 120, "gap": 10, "before": 5, "after": 5}


def _first_days(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    rows = _aligned(spark, d)
    return rows, rows.where("day(ts) = 1").select("symbol", F.col("ts").alias("event"))


@register("event_average", f"""{_EVENTS}, s AS (SELECT symbol, count(*) AS events, avg(car) AS caar, sqrt(sum(n * mse)) / count(*) AS se, stddev_samp(car) AS sd FROM c GROUP BY symbol),
z AS (SELECT *, caar / se AS z, caar / (sd / sqrt(events)) AS t FROM s)
SELECT symbol, events, {_r('caar', 'se AS std_error', 'z AS z_stat')}, round({sql.normal_p('z')}, {DIGITS}) AS p_value, {_r('t AS cross_t')}, round({sql.t_p('t', '(events - 1)')}, {DIGITS}) AS cross_p FROM z""")
def event_average(spark, d):
    return events.average_effect(events.event_study(*_first_days(spark, d), **_WINDOWS))


@register("event_path", f"""{_EVENTS}, ab AS (SELECT f.symbol, event, pos - place AS day, r - a - b * m AS x FROM f JOIN p ON p.symbol = f.symbol AND pos BETWEEN place - 5 AND place + 5),
cu AS (SELECT symbol, day, sum(x) OVER (PARTITION BY symbol, event ORDER BY day) AS car FROM ab)
SELECT symbol, day::INT AS day, count(*) AS events, {_r('avg(car) AS caar')} FROM cu GROUP BY symbol, day""")
def event_path(spark, d):
    return events.average_path(*_first_days(spark, d), **_WINDOWS)


@register("event_refusals", """, p AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts) AS pos FROM al)
SELECT symbol, ts AS event, 'too early' AS reason FROM p WHERE day(ts) = 1 AND pos <= 130""")
def event_refusals(spark, d):
    return events.unusable_events(*_first_days(spark, d), estimation=120, gap=10)


@register("span_latency", f"""SELECT event_type, count(*) AS n, {_r('quantile_cont(value, 0.5) AS p50', 'quantile_cont(value, 0.95) AS p95', 'quantile_cont(value, 0.99) AS p99', 'avg((value > 50)::INT) AS failure_rate')}
FROM events GROUP BY event_type""")
def span_latency(spark, d):
    return telemetry.latency(panel.table(spark, d, "events"), "event_type", "value", F.col("value") > 50)


@register("nearest_vectors", f"""SELECT vec_id, round(1 - list_cosine_similarity(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 0)), {DIGITS}) AS distance
FROM embeddings ORDER BY 1 - list_cosine_similarity(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 0)), vec_id LIMIT 10""")
def nearest_vectors(spark, d):
    vectors = panel.table(spark, d, "embeddings")
    query = vectors.where("vec_id = 0").select("embedding").first()
    if query is None:  # without the query there are no neighbours
        return telemetry.nearest(vectors.limit(0), F.col("embedding"), 10)
    return telemetry.nearest(vectors, F.array(*[F.lit(float(x)) for x in query[0]]), 10)


@register("nearest_vectors_each", f"""SELECT query_id, vec_id, round(distance, {DIGITS}) AS distance FROM (
SELECT q.vec_id AS query_id, v.vec_id AS vec_id, round(1 - list_cosine_similarity(v.embedding::DOUBLE[], q.embedding::DOUBLE[]), 9) AS distance
FROM embeddings v, embeddings q WHERE q.vec_id % 100 = 0)
QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) <= 10""")
def nearest_vectors_each(spark, d):
    """Every vector whose id is divisible by 100 as a query."""
    vectors = panel.table(spark, d, "embeddings")
    return telemetry.nearest_each(vectors, vectors.where("vec_id % 100 = 0"), 10)


@register("upload_profile")
def upload_profile(spark, d):
    return upload.with_roles(upload.profile(panel.table(spark, d, "orders")))


@register("upload_observations", f"""SELECT o_orderdate::DATE AS ts, o_orderpriority AS symbol, 'price' AS field, {_r('o_totalprice::DOUBLE AS value')} FROM orders""")
def upload_observations(spark, d):
    return upload.observations(panel.table(spark, d, "orders"), "o_orderdate", {"o_totalprice": "price"}, ticker="o_orderpriority")


for _kind, _sql in {
    "log": "SELECT symbol, ts, ln(value) AS value FROM lv", "cumsum": "SELECT symbol, ts, sum(value) OVER (PARTITION BY symbol ORDER BY ts) AS value FROM lv",
    "diff": "SELECT symbol, ts, value - lag(value) OVER (PARTITION BY symbol ORDER BY ts) AS value FROM lv", "log_diff": "SELECT symbol, ts, r AS value FROM rt",
}.items():
    register(f"transform_{_kind}", f"SELECT symbol, ts, {_r('value')} FROM ({_sql}) WHERE value IS NOT NULL")(
        lambda spark, d, kind=_kind: panel.transformed(_levels(spark, d), kind)
    )


@register("compound_monthly", f"SELECT symbol, last_day(ts) AS period_end, {_r('product(exp(r)) - 1 AS r')}, count(*) AS n FROM rt GROUP BY 1, 2")
def compound_monthly(spark, d):
    return panel.compounded(panel.returns(_levels(spark, d), "simple"), "M")


@register("phillips_perron", f""", w AS (SELECT symbol, ts, value AS y, lag(value) OVER (PARTITION BY symbol ORDER BY ts) AS x FROM lv),
f AS (SELECT symbol, count(*) AS n, regr_slope(y, x) AS b, regr_intercept(y, x) AS a, regr_sxx(y, x) AS sxx FROM w WHERE x IS NOT NULL GROUP BY symbol),
e AS (SELECT symbol, ts, y - f.a - f.b * x AS e FROM w JOIN f USING (symbol) WHERE x IS NOT NULL),
l AS (SELECT symbol, e, k, lag(e, k) OVER (PARTITION BY symbol, k ORDER BY ts) AS el FROM e, (SELECT unnest(range(1, 9))::INT AS k)),
v AS (SELECT symbol, sum(e * el * 2 * (1 - k / 9.0::DOUBLE)) AS cross_sum FROM l GROUP BY symbol), c AS (SELECT symbol, sum(e * e) AS c0 FROM e GROUP BY symbol),
g AS (SELECT symbol, n, b, c0 / n AS g0, (c0 + cross_sum) / n AS l2, sqrt(c0 / (n - 2)) AS s, sqrt(c0 / (n - 2) / sxx) AS se FROM f JOIN v USING (symbol) JOIN c USING (symbol))
, st AS (SELECT symbol, n AS nobs, sqrt(g0 / l2) * (b - 1) / se - (l2 - g0) / (2 * sqrt(l2)) * n * se / s AS statistic FROM g)
SELECT symbol, nobs, 8 AS lags, {_r('statistic')}, {_unit_root('statistic', 'nobs', 'c')} FROM st""")
def phillips_perron(spark, d):
    return efficiency.phillips_perron(_levels(spark, d), lags=8)


def _pacf(lags: int) -> str:
    """Durbin and Levinson's recursion, a CTE for each lag: f_j are the coefficients so far, p_k the last one of lag k."""
    rho = ", ".join(f"max(acf * n / (n - lag)) FILTER (WHERE lag = {k}) AS r{k}" for k in range(1, lags + 1))
    out, held = f"{_ACF}, y0 AS (SELECT symbol, any_value(n) AS n, {rho} FROM a GROUP BY symbol), y1 AS (SELECT *, r1 AS p1, r1 AS f1_1 FROM y0)", "p1"
    for k in range(2, lags + 1):
        last = [f"f{k - 1}_{j}" for j in range(1, k)]
        top = f"(r{k} - ({' + '.join(f'{f} * r{k - j}' for j, f in enumerate(last, 1))}))"
        rest = f"(1 - ({' + '.join(f'{f} * r{j}' for j, f in enumerate(last, 1))}))"
        out += f", x{k} AS (SELECT *, {top} / {rest} AS p{k} FROM y{k - 1}), y{k} AS (SELECT symbol, n, {', '.join(f'r{j}' for j in range(1, lags + 1))}, {held}, p{k}, p{k} AS f{k}_{k}, {', '.join(f'f{k - 1}_{j} - p{k} * f{k - 1}_{k - j} AS f{k}_{j}' for j in range(1, k))} FROM x{k})"
        held += f", p{k}"
    return out + " " + " UNION ALL ".join(f"SELECT symbol, n, {k} AS lag, round(p{k}, {DIGITS}) AS pacf FROM y{lags}" for k in range(1, lags + 1))


@register("pacf", _pacf(10))
def pacf(spark, d):
    return efficiency.partial_autocorrelation(_returns(spark, d), 10)


_POINTS = ", q AS (SELECT symbol, count(*) AS n, avg(m) AS mx, regr_sxx(r, m) AS sxx FROM rs GROUP BY symbol)"
_SPREAD = f"SELECT symbol, term, {_r('estimate', 'std_error', 'estimate / std_error AS z_stat')}, round({sql.normal_p('(estimate / std_error)')}, {DIGITS}) AS p_value, n AS nobs FROM (SELECT symbol, n, unnest(['const', 'm']) AS term, unnest([a, b]) AS estimate, unnest([sa, sb]) AS std_error FROM s JOIN fit USING (symbol))"


@register("capm_white", f"""{_POINTS}, u AS (SELECT symbol, n, e / (1 - 1.0::DOUBLE / n - (m - mx) * (m - mx) / sxx) AS u, (m - mx) / sxx AS w, 1.0::DOUBLE / n - mx * (m - mx) / sxx AS c FROM rs JOIN q USING (symbol)),
s AS (SELECT symbol, n, sqrt(sum(w * w * u * u)) AS sb, sqrt(sum(c * c * u * u)) AS sa FROM u GROUP BY symbol, n) {_SPREAD}""")
def capm_white(spark, d):
    return robust_ols(_aligned(spark, d), "r", ["m"], ["symbol"], "white")


@register("capm_newey_west", f"""{_POINTS}, u AS (SELECT symbol, ts, n, e * (m - mx) / sxx AS w, e * (1.0::DOUBLE / n - mx * (m - mx) / sxx) AS c FROM rs JOIN q USING (symbol)),
l AS (SELECT symbol, n, k, w, c, lag(w, k) OVER p AS w1, lag(c, k) OVER p AS c1 FROM u, (SELECT unnest(range(0, 6))::INT AS k) WINDOW p AS (PARTITION BY symbol, k ORDER BY ts)),
s AS (SELECT symbol, n, sqrt(sum(w * w1 * CASE k WHEN 0 THEN 1 ELSE 2 * (1 - k / 6.0::DOUBLE) END)) AS sb, sqrt(sum(c * c1 * CASE k WHEN 0 THEN 1 ELSE 2 * (1 - k / 6.0::DOUBLE) END)) AS sa
FROM l GROUP BY symbol, n) {_SPREAD}""")
def capm_newey_west(spark, d):
    return robust_ols(_aligned(spark, d), "r", ["m"], ["symbol"], "newey_west", lags=5)


@register("gjr_garch")
def gjr_garch(spark, d):
    return conditional.gjr_garch(_returns(spark, d))


@register("egarch")
def egarch(spark, d):
    return conditional.egarch(_returns(spark, d))


def _three(spark: SparkSession, d: str, column: str) -> DataFrame:
    return multivariate.wide(_returns(spark, d) if column == "r" else _levels(spark, d), ["A", "N", "R"], column)


@register("var_order")
def var_order(spark, d):
    return systems.order_selection(_three(spark, d, "r"), ["A", "N", "R"], 6)


@register("impulse_responses")
def impulse_responses(spark, d):
    return systems.impulse_responses(_three(spark, d, "r"), ["A", "N", "R"], 2)


@register("variance_shares")
def variance_shares(spark, d):
    return systems.variance_shares(_three(spark, d, "r"), ["A", "N", "R"], 2)


@register("johansen")
def johansen(spark, d):
    return systems.johansen(_three(spark, d, "value"), ["A", "N", "R"])


@register("vecm")
def vecm(spark, d):
    return systems.vecm(_three(spark, d, "value"), ["A", "N", "R"], rank=1)


SHAPED = {"model": "gjr_garch", "o": 1, "dist": "skewt"}


@register("garch_estimates")
def garch_estimates(spark, d):
    return conditional.estimates(conditional.fitted(_returns(spark, d), **SHAPED))


@register("conditional_volatility")
def conditional_volatility(spark, d):
    returns = _returns(spark, d)
    return conditional.path(returns, conditional.fitted(returns, dist="t"), dist="t")


@register("student_var")
def student_var(spark, d):
    return volatility.student_var(_returns(spark, d))


@register("selected_var")
def selected_var(spark, d):
    return systems.selected_var(_three(spark, d, "r"), ["A", "N", "R"], 6)


@register("var_checks")
def var_checks(spark, d):
    return systems.var_checks(_three(spark, d, "r"), ["A", "N", "R"], 2)
