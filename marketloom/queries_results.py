"""The registered queries of results and their charts, recursions and the battery of residual checks, and the SQL that checks them."""

from __future__ import annotations

import re
from functools import cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import sql
from .functions import distributions
from .operators import battery, diagnostics, efficiency, pricing, proposals, recursion, results, systems, volatility
from .operators.gram import fitted, ols
from .queries import _ACF, _FACTORS, _SERIES, _THREE, DIGITS, ORACLES, _aligned, _dickey_fuller, _factors, _kpss, _lags, _levels, _r, _residuals, _returns, _three, _unit_root, register
from .sources import panel


def _results(spark: SparkSession, d: str) -> DataFrame:
    """What eleven tools find in the flags' revenues, as one table; a step is a tool and a symbol, or a tool alone."""
    returns, levels = _returns(spark, d), _levels(spark, d)
    step = lambda tool: F.concat(F.lit(f"{tool}:"), "symbol")
    parts, ts = [], F.col("ts")
    fit = pricing.capm(_aligned(spark, d))
    intervals = pricing.capm_intervals(fit)
    parts += [results.scalars(fit, step("capm"), "capm", ["nobs", "r2"]), results.series(_residuals(spark, d), step("capm"), "capm", ts, {"residuals": F.col("residual")})]
    parts.append(results.estimates(intervals, step("capm"), "capm", F.col("term"), F.col("estimate"), F.col("ci_low"), F.col("ci_high")))
    band = pricing.beta_band(pricing.rolling_beta(_aligned(spark, d)))
    parts.append(results.series(band, step("rolling_beta"), "rolling_beta", ts, {c: F.col(c) for c in ("beta", "beta_ci_low", "beta_ci_high")}))
    acf = efficiency.autocorrelation(returns, 10)
    parts.append(results.series(acf, step("acf"), "acf", F.col("lag"), {"acf": F.col("acf"), "acf_upper": F.col("band"), "acf_lower": -F.col("band")}))
    parts.append(results.series(efficiency.variance_ratio(levels, [2, 4, 8, 16]), step("variance_ratio"), "variance_ratio", F.col("horizon"), {"vr_by_horizon": F.col("vr")}))
    upto = F.max("value").over(efficiency.in_time().rowsBetween(Window.unboundedPreceding, 0))
    parts.append(results.series(levels.withColumn("fall", F.col("value") / upto - 1), step("drawdown"), "drawdown", ts, {"drawdown": F.col("fall")}))
    parts.append(results.series(volatility.realized_vol(returns), step("realized_vol"), "realized_vol", ts, {"realized_vol": F.col("vol")}))
    parts.append(results.series(recursion.ewma_path(returns), step("ewma_vol"), "ewma_vol", ts, {"ewma_vol": F.col("vol")}))
    parts.append(results.scalars(diagnostics.jarque_bera(_residuals(spark, d)), step("normality"), "normality", ["n", "statistic", "p_value", "skewness", "excess_kurtosis"]))
    inflation = diagnostics.vif(returns.join(_factors(spark, d), "ts"), ["AUTOMOBILE", "BUILDING"])
    parts.append(results.table(inflation, step("vif"), "vif", "variance_inflation", F.col("regressor"), ["vif"]))
    wide = _three(spark, d, "r")
    place = F.row_number().over(Window.partitionBy("horizon").orderBy("a", "b"))
    for tool, found, names in (("irf", systems.impulse_responses(wide, ["A", "N", "R"], 2), ("impulse", "response", "value")), ("fevd", systems.variance_shares(wide, ["A", "N", "R"], 2), ("shock", "variable", "share"))):
        a, b, y = names
        named = found.withColumns({"a": F.col(a), "b": F.col(b)}).withColumn("nth", place)
        parts.append(results.keyed_series(named, F.lit(tool), tool, F.concat("a", F.lit("->"), "b"), F.col("nth"), F.col("horizon"), F.col(y)))
    parts.append(results.scalars(returns.groupBy("symbol").agg(F.count("*").alias("nobs")), step("counts"), "counts", ["nobs"]))
    return results.together(*parts)


_SHAPE = f""", zs AS (SELECT symbol, count(*) AS nl FROM lv GROUP BY 1), zr AS (SELECT symbol, count(*) AS nr FROM rt GROUP BY 1), za AS (SELECT symbol, count(*) AS na FROM al GROUP BY 1 HAVING count(*) >= 30),
sh(step, tool, kind, key, nth, points) AS (
SELECT 'capm:' || symbol, 'capm', 'scalar', unnest(['nobs', 'r2']), unnest([0, 1]), 1 FROM za UNION ALL SELECT 'capm:' || symbol, 'capm', 'series', 'residuals', 0, na FROM za
UNION ALL SELECT 'capm:' || symbol, 'capm', 'estimate', unnest(['alpha', 'beta']), 0, 1 FROM za
UNION ALL SELECT 'rolling_beta:' || symbol, 'rolling_beta', 'series', unnest(['beta', 'beta_ci_low', 'beta_ci_high']), unnest([0, 1, 2]), na - 251 FROM za WHERE na >= 252
UNION ALL SELECT 'acf:' || symbol, 'acf', 'series', unnest(['acf', 'acf_upper', 'acf_lower']), unnest([0, 1, 2]), 10 FROM zr
UNION ALL SELECT 'variance_ratio:' || symbol, 'variance_ratio', 'series', 'vr_by_horizon', 0, 4 FROM zs
UNION ALL SELECT 'drawdown:' || symbol, 'drawdown', 'series', 'drawdown', 0, nl FROM zs
UNION ALL SELECT t || ':' || symbol, t, 'series', t, 0, nr FROM zr, (VALUES ('realized_vol'), ('ewma_vol')) AS x(t)
UNION ALL SELECT 'normality:' || symbol, 'normality', 'scalar', unnest(['n', 'statistic', 'p_value', 'skewness', 'excess_kurtosis']), unnest([0, 1, 2, 3, 4]), 1 FROM za
UNION ALL SELECT 'vif:' || symbol, 'vif', 'table', 'variance_inflation', 0, 2 FROM zr
UNION ALL SELECT 'counts:' || symbol, 'counts', 'scalar', 'nobs', 0, 1 FROM zr
UNION ALL SELECT t, t, 'series', a || '->' || b, (row_number() OVER (PARTITION BY t ORDER BY a, b))::INT, n FROM (VALUES ('irf', 11), ('fevd', 10)) AS x(t, n), (VALUES ('A'), ('N'), ('R')) AS i(a), (VALUES ('A'), ('N'), ('R')) AS j(b)),
-- rules: rank, type, title, tool it is for, role, key
ru(rule, type, title, meant, role, asked, kind) AS (VALUES (2, 'panels', 'Impulse responses', 'irf', 'panel', '%->%', 'series'), (3, 'area_stack', 'Forecast error variance decomposition', 'fevd', 'series', '%->%', 'series'),
(4, 'band', 'Rolling beta', '%', 'center', 'beta', 'series'), (4, 'band', 'Rolling beta', '%', 'lower', 'beta\\_ci\\_low', 'series'), (4, 'band', 'Rolling beta', '%', 'upper', 'beta\\_ci\\_high', 'series'),
(5, 'stem', 'Autocorrelation', '%', 'series', 'acf', 'series'), (5, 'stem', 'Autocorrelation', '%', 'lower', 'acf\\_lower', 'series'), (5, 'stem', 'Autocorrelation', '%', 'upper', 'acf\\_upper', 'series'),
(7, 'bar', 'Variance ratio by horizon', '%', 'series', 'vr\\_by\\_horizon', 'series'), (8, 'underwater', 'Drawdown', '%', 'series', 'drawdown', 'series'),
(10, 'line', 'Realized volatility', '%', 'series', 'realized\\_vol', 'series'), (11, 'line', 'EWMA volatility', '%', 'series', 'ewma\\_vol', 'series'),
(14, 'forest', 'Coefficients', '%', 'estimate', '%', 'estimate'), (15, 'qq', 'Residual QQ plot', '%', 'series', 'residuals', 'series')),
ca AS (SELECT step, tool, nth, key, points, rule, type, title, role, (SELECT count(DISTINCT o.role) FROM ru o WHERE o.rule = ru.rule) AS roles,
row_number() OVER (PARTITION BY step, rule, role ORDER BY nth, key) AS rank FROM sh JOIN ru ON sh.kind = ru.kind AND tool LIKE meant AND key LIKE asked ESCAPE '\\'),
ch AS (SELECT step, tool, rule, 0 AS within, type, title, string_agg(role || '=' || key, ',' ORDER BY role, rank) AS binds, sum(points) AS points FROM ca WHERE type <> 'area_stack' OR rank <= 8
GROUP BY step, tool, rule, type, title, roles HAVING count(DISTINCT role) = roles AND (type NOT IN ('forest', 'panels') OR count(*) >= 2)),
fa AS (SELECT *, row_number() OVER (PARTITION BY step ORDER BY nth, key) - 1 AS within FROM sh WHERE kind IN ('table', 'scalar') AND key NOT IN ('n', 'nobs') AND step NOT IN (SELECT step FROM ch)),
ev AS (SELECT * FROM ch UNION ALL SELECT step, tool, 99, within, CASE kind WHEN 'table' THEN 'table' ELSE 'stat_tile' END, upper(left(replace(key, '_', ' '), 1)) || substr(replace(key, '_', ' '), 2), kind || '=' || key, points FROM fa WHERE within < 4)
SELECT step, tool, (row_number() OVER (PARTITION BY step ORDER BY rule, within))::INT AS place, type, title, binds, points::BIGINT AS points FROM ev"""


@register("proposed_charts", _SHAPE)
def proposed_charts(spark, d):
    """The charts that the results of eleven tools imply, what they bind, and how many numbers each draws."""
    charts = proposals.proposed(_results(spark, d))
    binds = F.array_join(F.transform("refs", lambda r: F.concat(r["role"], F.lit("="), r["key"])), ",")
    return charts.select("step", "tool", "place", "type", "title", binds.alias("binds"), "points")


def _recursive(start: str, arrived: str, keep: str, rows: str) -> str:
    """v = keep v' + arrived in closed form, from a CTE with symbol, ts and i (0 for the first row)."""
    return f"SELECT *, pow({keep}, i) * ({start} + coalesce(sum(CASE WHEN i > 0 THEN {arrived} * pow({keep}, -i) END) OVER (PARTITION BY symbol ORDER BY ts), 0)) AS v FROM {rows}"


@register("ewma_path", f""", x AS (SELECT symbol, ts, r, row_number() OVER (PARTITION BY symbol ORDER BY ts) - 1 AS i, first(r) OVER (PARTITION BY symbol ORDER BY ts) AS r0 FROM rt),
y AS ({_recursive('r0 * r0', '(1 - 0.94::DOUBLE) * r * r', '0.94::DOUBLE', 'x')}) SELECT symbol, ts, {_r('sqrt(v) AS vol', 'sqrt(v) * sqrt(252) AS annualised')} FROM y""")
def ewma_path(spark, d):
    return recursion.ewma_path(_returns(spark, d))


#: Models to run: the mean and variance of each series' own, and how much of a square, a square of falls and the variance stays.
MODEL = {"alpha": 0.05, "gamma": 0.04, "beta": 0.9}


@register("variance_path", f""", p AS (SELECT symbol, avg(r) AS mu, var_pop(r) * 0.03 AS omega FROM rt GROUP BY symbol),
e AS (SELECT symbol, ts, r - mu AS e, omega, row_number() OVER (PARTITION BY symbol ORDER BY ts) - 1 AS i FROM rt JOIN p USING (symbol)),
bk AS (SELECT symbol, sum(pow(0.94::DOUBLE, i) * e * e) / sum(pow(0.94::DOUBLE, i)) AS back FROM e WHERE i < 75 GROUP BY symbol),
x AS (SELECT e.*, omega + (0.05::DOUBLE + 0.04::DOUBLE * (lag(e) OVER w < 0)::INT) * pow(lag(e) OVER w, 2) AS b, omega + (0.05::DOUBLE + 0.02 + 0.9::DOUBLE) * back AS v0 FROM e JOIN bk USING (symbol) WINDOW w AS (PARTITION BY symbol ORDER BY ts)),
y AS ({_recursive('v0', 'b', '0.9::DOUBLE', 'x')}) SELECT symbol, ts, {_r('v AS variance', 'e / sqrt(v) AS std_residual')} FROM y""")
def variance_path(spark, d):
    returns = _returns(spark, d)
    own = returns.groupBy("symbol").agg(F.avg("r").alias("mu"), (F.var_pop("r") * 0.03).alias("omega"))
    return recursion.variance_path(returns, own.withColumns({k: F.lit(v) for k, v in MODEL.items()}))


_BAND = f"""SELECT symbol, ts, b AS beta, {distributions.t_ppf(0.975, 250)!r} * sqrt((syy - b * sxy) / 250 / sxx) AS wide FROM (
SELECT symbol, ts, count(*) OVER w AS n, regr_slope(r, m) OVER w AS b, var_pop(m) OVER w AS sxx, covar_pop(r, m) OVER w AS sxy, var_pop(r) OVER w AS syy FROM al
WINDOW w AS (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 251 PRECEDING AND CURRENT ROW)) WHERE n = 252"""


@register("rolling_beta_band", f"SELECT symbol, ts, {_r('beta', 'beta - wide AS beta_ci_low', 'beta + wide AS beta_ci_high')} FROM ({_BAND})")
def rolling_beta_band(spark, d):
    return pricing.beta_band(pricing.rolling_beta(_aligned(spark, d))).drop("beta_se")


@register("beta_summary", f"SELECT symbol, count(*) AS windows, {_r('avg(beta) AS mean_beta', 'min(beta) AS min_beta', 'max(beta) AS max_beta', 'arg_max(beta, ts) AS last_beta')} FROM ({_BAND}) GROUP BY symbol")
def beta_summary(spark, d):
    return pricing.beta_summary(pricing.rolling_beta(_aligned(spark, d)))


@cache
def _battery_sql() -> str:
    """The nine checks, one by one, on residuals of the returns on the market and a segment."""
    xs = ["m", "AUTOMOBILE"]
    rows = f"""{_FACTORS}, al2 AS (SELECT al.symbol, al.ts, al.r, al.m, fr.AUTOMOBILE FROM al JOIN fr USING (symbol, ts) WHERE fr.AUTOMOBILE IS NOT NULL), {sql.least_squares('f2', 'al2', ['symbol'], xs, 'r')},
rz AS (SELECT symbol, ts, m, AUTOMOBILE, r - b_0 - b_1 * m - b_2 * AUTOMOBILE AS e FROM al2 JOIN f2 USING (symbol)), rc AS (SELECT *, e - avg(e) OVER (PARTITION BY symbol) AS d FROM rz),
aq AS (SELECT symbol, e * e AS e2, {', '.join(f'lag(e * e, {k}) OVER w AS l{k}' for k in range(1, 11))} FROM rz WINDOW w AS (PARTITION BY symbol ORDER BY ts))"""
    acf = _ACF.replace("FROM rt)", "FROM (SELECT symbol, ts, e AS r FROM rz))")
    lm = {"breusch_pagan": ("rz", xs, "e * e"), "white": ("rz", ["m", "AUTOMOBILE", "m * m", "m * AUTOMOBILE", "AUTOMOBILE * AUTOMOBILE"], "e * e"), "arch_lm": ("aq", [f"l{k}" for k in range(1, 11)], "e2")}
    fits = "".join(f", {sql.least_squares(name, source, ['symbol'], cols, y)}" for name, (source, cols, y) in lm.items())
    out = [f"SELECT symbol, '{c}' AS \"check\", {10 if c == 'arch_lm' else 'NULL'} AS lags, st AS statistic, {sql.chi2_p('st', len(lm[c][1]))} AS p_value, NULL AS detail FROM (SELECT symbol, n * (1 - ssr / sst) AS st FROM {c})" for c in lm]
    out.append(f"SELECT symbol, 'ljung_box', 10, st, {sql.chi2_p('st', 10)}, NULL FROM (SELECT symbol, n * (n + 2) * sum(acf * acf / (n - lag)) AS st FROM a GROUP BY symbol, n)")
    out.append("SELECT symbol, 'jarque_bera', NULL, st, exp(-st / 2), NULL FROM (SELECT symbol, count(*) / 6.0::DOUBLE * (pow(avg(pow(z, 3)), 2) + pow(avg(pow(z, 4)) - 3, 2) / 4) AS st FROM (SELECT symbol, d / stddev_pop(e) OVER (PARTITION BY symbol) AS z FROM rc) GROUP BY symbol)")
    out.append("SELECT symbol, 'durbin_watson', NULL, sum(x * x) / sum(e * e), NULL, NULL FROM (SELECT symbol, e, e - lag(e) OVER (PARTITION BY symbol ORDER BY ts) AS x FROM rz) GROUP BY symbol")
    kolmogorov = "CASE WHEN st > 0.2 THEN greatest(0, least(1, list_sum(list_transform(range(1, 41), lambda k: 2 * pow(-1, k - 1) * exp(-2 * k * k * st * st))))) ELSE 1 END"
    out.append(f"SELECT symbol, 'cusum', NULL, st, {kolmogorov}, NULL FROM (SELECT symbol, max(abs(c)) / sqrt(sum(d * d)) AS st FROM (SELECT symbol, d, sum(d) OVER (PARTITION BY symbol ORDER BY ts) AS c FROM rc) GROUP BY symbol)")
    out.append("""SELECT symbol, 'structural_break', NULL, k / n::DOUBLE, NULL, effect FROM (SELECT symbol, k, n, abs(-s / (n - k) - s / k) / sd AS effect FROM (
SELECT symbol, count(*) OVER w AS k, count(*) OVER p AS n, sum(d) OVER w AS s, stddev_pop(e) OVER p AS sd FROM rc WINDOW w AS (PARTITION BY symbol ORDER BY ts), p AS (PARTITION BY symbol))
WHERE k >= 2 AND n - k >= 2 AND k % 5 = 0 QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY s * s / k + s * s / (n - k) DESC, k) = 1)""")
    out.append("SELECT symbol, unnest(['vif_m', 'vif_AUTOMOBILE']), NULL, 1 / (1 - pow(corr(m, AUTOMOBILE), 2)), NULL, NULL FROM rz GROUP BY symbol")
    passed = "CASE WHEN \"check\" = 'durbin_watson' THEN statistic BETWEEN 1.5 AND 2.5 WHEN \"check\" = 'structural_break' THEN detail < 0.5 WHEN starts_with(\"check\", 'vif') THEN statistic < 10 ELSE p_value >= 0.05 END"
    return f"{rows}{acf}{fits}, every AS ({' UNION ALL '.join(out)}) SELECT symbol, \"check\", lags::INT AS lags, {_r('statistic', 'p_value', 'detail')}, {passed} AS passed FROM every"


@register("diagnostics_report", _battery_sql())
def diagnostics_report(spark, d):
    """All nine checks on the residuals of returns on the market and a segment's orders."""
    rows = _aligned(spark, d).join(_factors(spark, d).select("ts", "AUTOMOBILE"), "ts").na.drop()
    xs = ["m", "AUTOMOBILE"]
    return battery.report(fitted(rows, ols(rows, "r", xs, ["symbol"]), "r", xs, ["symbol"]), xs)


LAG_SETS = [1, 5, 10]


@register("ljung_box_set", f"{_ACF}, q AS (SELECT symbol, n, k AS lags, n * (n + 2) * sum(acf * acf / (n - lag)) AS st FROM a, (SELECT unnest({LAG_SETS})::INT AS k) WHERE lag <= k GROUP BY symbol, n, k) SELECT symbol, n, lags, {_r('st AS statistic')}, round(CASE lags "
          + " ".join(f"WHEN {k} THEN {sql.chi2_p('st', k)}" for k in LAG_SETS) + f" END, {DIGITS}) AS p_value FROM q")
def ljung_box_set(spark, d):
    return efficiency.ljung_box_set(_returns(spark, d), LAG_SETS)


def _unrounded(text: str) -> str:
    return re.sub(rf"(?<!lag\(d), {DIGITS}\)", ", 300)", text)


def _whole(name: str) -> str:
    """The SQL of another query without its rounding."""
    return _unrounded(ORACLES[name])


def _score_sql() -> str:
    """The score as a sum of its six parts, each by the SQL that its own query is checked by."""
    logs = f"{_SERIES}, lx AS (SELECT symbol, ts, ln(value) AS value FROM lv)"
    adf = _unrounded(f"{logs}{_dickey_fuller('lx', 'value', 8, 'c')}")
    kpss = _unrounded(f"{logs}{_kpss('c').replace('FROM lv', 'FROM lx')}")
    usual = "greatest(0, least(1, (p_value - 0.01) / 0.09))"
    parts = {
        "adf": (f"SELECT symbol, statistic, p_value FROM ({adf})", usual), "kpss": (f"SELECT symbol, statistic, p_value FROM ({kpss})", f"1 - {usual}"),
        "variance_ratio": (f"SELECT symbol, arg_min(z_robust, (q, horizon)) AS statistic, 1 - pow(1 - min(q), 4) AS p_value FROM (SELECT *, CASE WHEN p_value = 0 THEN 1 ELSE p_value END AS q FROM ({_whole('variance_ratio')})) GROUP BY symbol", usual),
        "runs": (f"SELECT symbol, z AS statistic, p_value FROM ({_whole('runs_test')})", usual), "ljung_box": (f"SELECT symbol, statistic, p_value FROM ({_whole('ljung_box')})", usual),
        "hurst": (f"SELECT symbol, hurst AS statistic, NULL::DOUBLE AS p_value FROM ({_whole('hurst')})", "greatest(0, 1 - abs(statistic - 0.5) / 0.2)"),
    }
    each = " UNION ALL ".join(f"SELECT symbol, '{c}' AS component, {efficiency.WEIGHTS[c]}::DOUBLE AS weight, statistic, p_value, {sub} AS sub_score FROM ({rows})" for c, (rows, sub) in parts.items())
    total = sum(efficiency.WEIGHTS.values())
    return f"""WITH pa AS ({each}), sc AS (SELECT *, 100 * weight * sub_score / {total} AS contribution, sum(100 * weight * sub_score / {total}) OVER (PARTITION BY symbol) AS score FROM pa),
ve AS (SELECT *, CASE WHEN score >= {efficiency.EFFICIENT} THEN 'efficient' WHEN score < {efficiency.INEFFICIENT} THEN 'inefficient' ELSE 'borderline' END AS verdict FROM sc)
SELECT symbol, component, weight, {_r('statistic', 'p_value', 'sub_score', 'contribution', 'score')}, verdict, CASE WHEN verdict <> 'borderline' THEN verdict = 'efficient' END AS passed FROM ve"""


ORACLES["efficiency_score"] = _score_sql()


def _confidence_sql() -> str:
    """Intervals with Student's quantile found by halving a bracket sixty times."""
    mid = "((s.low + s.high) / 2)"
    halves = f"list_reduce(list_transform(range(0, 61), lambda i: {{'low': 0.0::DOUBLE, 'high': 50.0::DOUBLE}}), lambda s, x: CASE WHEN {sql.t_p(mid, '(nobs - 2)')} > 0.05 THEN {{'low': {mid}, 'high': s.high}} ELSE {{'low': s.low, 'high': {mid}}} END)"
    return f"""WITH f AS ({_whole('capm')}), q AS (SELECT *, {halves} AS h FROM f), w AS (SELECT *, (h.low + h.high) / 2 AS wide FROM q),
t AS (SELECT symbol, unnest(['alpha', 'beta']) AS term, unnest([alpha, beta]) AS estimate, unnest([alpha_se, beta_se]) * wide AS half FROM w)
SELECT symbol, term, {_r('estimate', 'estimate - half AS ci_low', 'estimate + half AS ci_high')} FROM t"""


ORACLES["capm_confidence"] = _confidence_sql()


def _responses_sql(last: str, horizons: int) -> str:
    """Responses of the three returns to shocks of one standard deviation, by a recursion on the coefficients of two lags."""
    names, xs, parts = "ANR", [f"{c}{k}" for k in (1, 2) for c in "ANR"], []
    for c in names:
        parts.append(sql.least_squares(f"e{c}", "lg", [], xs, c))
    residual = {c: f"lg.{c} - e{c}.b_0 - " + " - ".join(f"e{c}.b_{i + 1} * lg.{x}" for i, x in enumerate(xs)) for c in names}
    parts.append(f"rd AS (SELECT {', '.join(f'{v} AS {c}' for c, v in residual.items())} FROM lg, eA, eN, eR WHERE A2 IS NOT NULL)")
    pairs = [(a, b) for i, a in enumerate(names) for b in names[i:]]
    parts.append("sg AS (SELECT " + ", ".join(f"sum({a} * {b}) / (count(*) - 7) AS s{a}{b}" for a, b in pairs) + " FROM rd)")
    parts.append("""ch AS (SELECT lAA, lNA, lRA, lNN, (sNR - lRA * lNA) / lNN AS lRN, sqrt(sRR - lRA * lRA - pow((sNR - lRA * lNA) / lNN, 2)) AS lRR FROM (SELECT *, sqrt(sNN - lNA * lNA) AS lNN FROM (SELECT *, sqrt(sAA) AS lAA, sAN / sqrt(sAA) AS lNA, sAR / sqrt(sAA) AS lRA FROM sg)))""")
    own = lambda i, j: f"p{i}{j}"
    start = ", ".join([f"{1.0 if i == j else 0.0}::DOUBLE AS p{i}{j}" for i in names for j in names] + [f"0.0::DOUBLE AS q{i}{j}" for i in names for j in names])
    step = ", ".join([" + ".join([f"{own(i, k)} * e{k}.b_{1 + names.index(j)} + q{i}{k} * e{k}.b_{4 + names.index(j)}" for k in names]) + f" AS p{i}{j}" for i in names for j in names] + [f"p{i}{j} AS q{i}{j}" for i in names for j in names])
    parts.append(f"ps AS (SELECT 0 AS h, {start} UNION ALL SELECT h + 1, {step} FROM ps, eA, eN, eR WHERE h < {horizons})")
    low = lambda i, j: f"l{i}{j}" if names.index(i) >= names.index(j) else "0"
    cells = " UNION ALL ".join(f"SELECT h, '{j}' AS shock, '{i}' AS variable, {' + '.join(f'p{i}{k} * {low(k, j)}' for k in names)} AS v FROM ps, ch" for i in names for j in names)
    return f"{_SERIES.replace('WITH ', 'WITH RECURSIVE ', 1)}{_THREE}{_lags('ANR', 2)}, {', '.join(parts)}, rp AS ({cells}) {last}"


ORACLES["impulse_responses"] = _responses_sql(f"SELECT h::INT AS horizon, shock AS impulse, variable AS response, {_r('v AS value')} FROM rp", 10)
ORACLES["variance_shares"] = _responses_sql(f"""SELECT (h + 1)::INT AS horizon, variable, shock, round(c / sum(c) OVER (PARTITION BY h, variable), {DIGITS}) AS share FROM (
SELECT h, shock, variable, sum(v * v) OVER (PARTITION BY shock, variable ORDER BY h) AS c FROM rp)""", 9)


_EXCESS = """, q AS (SELECT last_day(o_orderdate::DATE) AS ts, avg(o_totalprice) / 1e5 AS pct FROM orders GROUP BY 1),
ay AS (SELECT al.symbol, al.ts, r, m, pow(1 + coalesce(q.pct, (SELECT arg_min(pct, ts) FROM q)) / 100, 1.0::DOUBLE / 252) - 1 AS rf FROM al ASOF LEFT JOIN q ON al.ts >= q.ts),
ax AS (SELECT symbol, ts, r - rf AS r, m - rf AS m FROM ay)"""


# a p-value that rounds to nothing has no sign
_PLAIN = "SELECT * REPLACE (alpha_p + 0.0::DOUBLE AS alpha_p, beta_p + 0.0::DOUBLE AS beta_p) FROM"


@register("capm_excess", f"{_EXCESS}\n{_PLAIN} ({ORACLES['capm'].removeprefix(_SERIES).replace('FROM al GROUP BY symbol', 'FROM ax GROUP BY symbol')})")
def capm_excess(spark, d):
    """CAPM of returns less a daily rate, which the market's returns are less too."""
    rates = panel.table(spark, d, "orders").groupBy(F.last_day(F.to_date("o_orderdate")).alias("ts")).agg((F.avg("o_totalprice") / 1e5).alias("pct"))
    rows = panel.as_of(_aligned(spark, d), rates, "pct", by=None).withColumn("rf", panel.period_rate(F.col("pct"), "DGS3MO", 252))
    return pricing.capm(rows, risk_free="rf")


def _order_sql(deepest: int) -> str:
    """Criteria of each order from the determinant of the residuals' covariance, all orders on the rows of the longest."""
    rows, parts, out = f"(SELECT * FROM lg WHERE A{deepest} IS NOT NULL)", [], []
    for p in range(deepest + 1):
        parts.append(sql.residual_products(f"or{p}", rows, [f"{c}{k}" for k in range(1, p + 1) for c in "ANR"], list("ANR")))
        each = 1 + 3 * p
        det = "(s_0_0 * (s_1_1 * s_2_2 - s_1_2 * s_1_2) - s_0_1 * (s_0_1 * s_2_2 - s_1_2 * s_0_2) + s_0_2 * (s_0_1 * s_1_2 - s_1_1 * s_0_2))"
        out.append(f"""SELECT {p} AS lags, n AS nobs, round(v + 2.0::DOUBLE * {3 * each} / n, {DIGITS}) AS aic, round(v + ln(n) * {3 * each} / n, {DIGITS}) AS bic, round(v + 2.0::DOUBLE * ln(ln(n)) * {3 * each} / n, {DIGITS}) AS hqic,
round(exp(v) * pow((n + {each})::DOUBLE / (n - {each}), 3), {DIGITS}) AS fpe FROM (SELECT n, ln({det} / pow(n, 3)) AS v FROM or{p})""")
    return f"{_SERIES}{_THREE}{_lags('ANR', deepest)}, {', '.join(parts)} {' UNION ALL '.join(out)}"


ORACLES["var_order"] = _order_sql(6)


def _own_lags(several: list[int]) -> str:
    """CTE ow: symbol, nobs, lags, statistic, estimate of Dickey and Fuller's regression with Schwert's lags of each symbol's own rows."""
    deepest, parts = max(several), []
    changes = ", ".join(f"lag(d, {k}) OVER w AS d{k}" for k in range(1, deepest + 1))
    parts.append("w0 AS (SELECT symbol, ts, value - lag(value) OVER w AS d, lag(value) OVER w AS y1, floor(12 * pow(count(*) OVER (PARTITION BY symbol) / 100::DOUBLE, 0.25)) AS own FROM lv WINDOW w AS (PARTITION BY symbol ORDER BY ts))")
    parts.append(f"w1 AS (SELECT *, {changes} FROM w0 WINDOW w AS (PARTITION BY symbol ORDER BY ts))")
    for n in several:
        parts.append(sql.last_coefficient(f"wf{n}", f"(SELECT * FROM w1 WHERE own = {n})", "symbol", [*[f"d{k}" for k in range(1, n + 1)], "y1"], "d"))
    found = " UNION ALL ".join(f"SELECT symbol, n AS nobs, {n} AS lags, b / sqrt(v * ssr / (n - {n + 2})) AS statistic, b AS estimate FROM wf{n}" for n in several)
    return f", {', '.join(parts)}, ow AS ({found})"


#: Schwert's lags of all lengths from 1,886 to 2,933 dates.
_OWN = _own_lags([25, 26, 27])
ORACLES["adf_own_lags"] = f"{_SERIES}{_OWN} SELECT symbol, nobs, lags, {_r('statistic', 'estimate')}, {_unit_root('statistic', 'nobs', 'c')} FROM ow"
ORACLES["gate_stationarity"] = f"""{_SERIES}{_OWN}, ur AS (SELECT symbol, statistic, {_unit_root('statistic', 'nobs', 'c')} FROM ow)
SELECT symbol, 'stationarity' AS gate, {_r('statistic')}, p_value, passed AS present, NOT passed AS allowed FROM ur"""
