"""Market efficiency of series: unit roots, variance ratios, randomness. Inputs: symbol, ts and value or r."""

from __future__ import annotations

import functools
import math

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.distributions import chi2_p, chi2_p_by, critical_values, kpss_p, normal_p, unit_root_p
from .gram import fitted, ols

def in_time():
    return Window.partitionBy("symbol").orderBy("ts")


def demeaned(df: DataFrame, column: str = "r") -> DataFrame:
    """symbol, ts, d: the column less its symbol's mean."""
    return df.where(F.col(column).isNotNull()).select("symbol", "ts", (F.col(column) - F.avg(column).over(Window.partitionBy("symbol"))).alias("d"))


def autocorrelation(df: DataFrame, lags: int, column: str = "r") -> DataFrame:
    """symbol, n, lag, acf and its Bartlett band (half width at 95 %), from one pass over lagged products."""
    rows = demeaned(df, column)
    sums = [F.sum(F.col("d") * F.col(f"d{k}")).alias(f"c{k}") for k in range(1, lags + 1)]
    rows = rows.select("*", *[F.lag("d", k).over(in_time()).alias(f"d{k}") for k in range(1, lags + 1)])
    s = rows.groupBy("symbol").agg(F.count("*").alias("n"), F.sum(F.col("d") * F.col("d")).alias("c0"), *sums)
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("lag"), (F.col(f"c{k}") / F.col("c0")).alias("acf")) for k in range(1, lags + 1)]))
    s = s.select("symbol", "n", each.alias("x")).select("symbol", "n", "x.lag", "x.acf")
    before = Window.partitionBy("symbol").orderBy("lag").rowsBetween(Window.unboundedPreceding, -1)
    earlier = F.coalesce(F.sum(F.col("acf") * F.col("acf")).over(before), F.lit(0.0))
    return s.withColumn("band", 1.959963984540054 * F.sqrt((1 + 2 * earlier) / F.col("n")))


def ljung_box(df: DataFrame, lags: int = 10, column: str = "r") -> DataFrame:
    r = autocorrelation(df, lags, column)
    s = r.groupBy("symbol", "n").agg(F.sum(F.col("acf") * F.col("acf") / (F.col("n") - F.col("lag"))).alias("q"))
    s = s.select("symbol", "n", F.lit(lags).alias("lags"), (F.col("n") * (F.col("n") + 2) * F.col("q")).alias("statistic"))
    return s.withColumn("p_value", chi2_p(F.col("statistic"), lags))


def ljung_box_set(df: DataFrame, lags: list[int], column: str = "r") -> DataFrame:
    """symbol, n, lags, statistic, p_value: ljung_box() for each number of lags, from one pass up to the greatest."""
    if not lags or min(lags) < 1:
        raise ValueError("numbers of lags, from 1")
    r = autocorrelation(df, max(lags), column)
    part = F.col("acf") * F.col("acf") / (F.col("n") - F.col("lag"))
    sums = [F.struct(F.lit(k).alias("lags"), F.sum(F.when(F.col("lag") <= k, part)).alias("q")) for k in sorted(set(lags))]
    s = r.groupBy("symbol", "n").agg(F.array(*sums).alias("x")).select("symbol", "n", F.explode("x").alias("x")).select("symbol", "n", "x.*")
    s = s.select("symbol", "n", "lags", (F.col("n") * (F.col("n") + 2) * F.col("q")).alias("statistic"))
    return s.withColumn("p_value", chi2_p_by(F.col("statistic"), F.col("lags")))


def runs_test(df: DataFrame) -> DataFrame:
    """Wald-Wolfowitz runs of the signs of demeaned returns; zeros are left out first."""
    rows = demeaned(df).where("d <> 0").withColumn("up", F.col("d") > 0)
    rows = rows.withColumn("new", F.coalesce(F.col("up") != F.lag("up").over(in_time()), F.lit(True)))
    s = rows.groupBy("symbol").agg(F.count_if("up").alias("p"), F.count_if(~F.col("up")).alias("m"), F.count_if("new").alias("runs"))
    p, m = F.col("p").cast("double"), F.col("m").cast("double")
    n = p + m
    mean = 2 * p * m / n + 1
    var = 2 * p * m * (2 * p * m - n) / (n * n * (n - 1))
    out = s.select("symbol", F.col("p").alias("positive"), F.col("m").alias("negative"), "runs", mean.alias("expected"), ((F.col("runs") - mean) / F.sqrt(var)).alias("z"))
    return out.withColumn("p_value", normal_p(F.col("z")))


def variance_ratio(levels: DataFrame, horizons: list[int]) -> DataFrame:
    """Lo-MacKinlay variance ratios of log levels, overlapping and debiased, with homoskedastic and robust z."""
    x = levels.select("symbol", "ts", F.log("value").alias("x"))
    deepest = max(horizons)
    rows = x.select("symbol", "ts", (F.col("x") - F.lag("x").over(in_time())).alias("d"), *[(F.col("x") - F.lag("x", q).over(in_time())).alias(f"q{q}") for q in horizons])
    whole = Window.partitionBy("symbol")
    rows = rows.withColumn("mu", F.avg("d").over(whole)).withColumn("e", F.pow(F.col("d") - F.col("mu"), F.lit(2)))
    rows = rows.select("*", *[F.lag("e", k).over(in_time()).alias(f"e{k}") for k in range(1, deepest)])
    s = rows.groupBy("symbol").agg(
        F.count("d").alias("n"), F.sum("e").alias("s1"), *[F.sum(F.pow(F.col(f"q{q}") - q * F.col("mu"), F.lit(2))).alias(f"s{q}_") for q in horizons],
        *[F.sum(F.col("e") * F.col(f"e{k}")).alias(f"h{k}") for k in range(1, deepest)],
    )
    n = F.col("n")

    def one(q: int) -> Column:
        m = q * (n - q + 1) * (1 - F.lit(float(q)) / n)
        vr = (F.col(f"s{q}_") / m) / (F.col("s1") / (n - 1))
        z = (vr - 1) / F.sqrt(2 * (2 * q - 1) * (q - 1) / (3.0 * q * n))
        theta = sum((F.pow(F.lit(2.0 * (q - k) / q), F.lit(2)) * F.col(f"h{k}") / (F.col("s1") * F.col("s1")) for k in range(1, q)), F.lit(0.0))
        return F.struct(F.lit(q).alias("horizon"), vr.alias("vr"), z.alias("z"), ((vr - 1) / F.sqrt(theta)).alias("z_robust"))

    out = s.select("symbol", "n", F.explode(F.array(*[one(q) for q in sorted(set(horizons))])).alias("x")).select("symbol", "n", "x.*")
    return out.withColumn("p_value", normal_p(F.col("z_robust")))


TRENDS = {"n": "none", "c": "a constant", "ct": "a constant and a trend"}


def _judged(out: DataFrame, trend: str, series: int = 1) -> DataFrame:
    """Adds p_value, critical values and passed, which says that the unit root is rejected at 5 %."""
    out = out.withColumn("p_value", unit_root_p(F.col("statistic"), trend, series))
    return out.select("*", *critical_values(F.col("nobs"), trend, series), (F.col("p_value") < 0.05).alias("passed"))


def adf(df: DataFrame, lags: int | None = None, column: str = "value", trend: str = "c", series: int = 1) -> DataFrame:
    """Augmented Dickey-Fuller t statistic: the change on the level before and lagged changes.

    trend: n none, c a constant, ct a linear trend too. Without lags each symbol has schwert() of its own rows. series: so many
    that the column is the residual of, for its p-value.
    """
    if trend not in TRENDS:
        raise ValueError(f"unknown trend {trend!r}: {', '.join(TRENDS)}")
    rows = df.where(F.col(column).isNotNull()).select("symbol", "ts", F.col(column).alias("y"))
    if lags is not None:
        return _judged(_dickey_fuller(rows, lags, trend), trend, series)
    own = rows.groupBy("symbol").agg(F.floor(12 * F.pow(F.count("*") / 100, F.lit(0.25))).cast("int").alias("own"))
    several = sorted(r.own for r in own.select("own").distinct().collect())  # numbers of lags, a few dozen at most
    each = [_dickey_fuller(rows.join(own.where(F.col("own") == n).select("symbol"), "symbol"), n, trend) for n in several]
    return _judged(functools.reduce(DataFrame.union, each) if each else _dickey_fuller(rows, 0, trend), trend, series)


def _dickey_fuller(rows: DataFrame, lags: int, trend: str) -> DataFrame:
    rows = rows.select("symbol", "ts", (F.col("y") - F.lag("y").over(in_time())).alias("d"), F.lag("y").over(in_time()).alias("y1"), F.row_number().over(in_time()).alias("time"))
    rows = rows.select("symbol", "d", "y1", "time", *[F.lag("d", k).over(in_time()).alias(f"d{k}") for k in range(1, lags + 1)])
    xs = ["y1", *(["time"] if trend == "ct" else []), *[f"d{k}" for k in range(1, lags + 1)]]
    fit = ols(rows, "d", xs, ["symbol"], const=trend != "n").where("term = 'y1'")
    return fit.select("symbol", "nobs", F.lit(lags).alias("lags"), F.col("t_stat").alias("statistic"), "estimate")


def schwert(n: int) -> int:
    return math.floor(12 * (n / 100) ** 0.25)


def kpss(df: DataFrame, lags: int, column: str = "value", trend: str = "c") -> DataFrame:
    """KPSS statistic for stationarity around a level (c) or a trend (ct), with a Bartlett long-run variance; passed: not rejected at 5 %."""
    if trend == "ct":
        timed = df.where(F.col(column).isNotNull()).withColumn("time", F.row_number().over(in_time()))
        rows = fitted(timed, ols(timed, column, ["time"], ["symbol"]), column, ["time"], ["symbol"]).select("symbol", "ts", F.col("residual").alias("d"))
    else:
        rows = demeaned(df, column)
    upto = in_time().rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.select("symbol", "d", F.sum("d").over(upto).alias("s"), *[F.lag("d", k).over(in_time()).alias(f"d{k}") for k in range(1, lags + 1)])
    s = rows.groupBy("symbol").agg(
        F.count("*").alias("n"), F.sum(F.col("s") * F.col("s")).alias("ss"), F.sum(F.col("d") * F.col("d")).alias("c0"),
        *[F.sum(F.col("d") * F.col(f"d{k}")).alias(f"c{k}") for k in range(1, lags + 1)],
    )
    long_run = (F.col("c0") + sum((2 * (1 - k / (lags + 1)) * F.col(f"c{k}") for k in range(1, lags + 1)), F.lit(0.0))) / F.col("n")
    out = s.select("symbol", "n", F.lit(lags).alias("lags"), (F.col("ss") / (F.col("n") * F.col("n") * long_run)).alias("statistic"))
    return out.withColumn("p_value", kpss_p(F.col("statistic"), trend)).withColumn("passed", F.col("p_value") >= 0.05)


def hurst(df: DataFrame, windows: list[int] | None = None, least: int = 16) -> DataFrame:
    """Rescaled range by window: the slope of its logs, and that less the slope expected of noise plus 0.5.

    Without a list of windows, each symbol has every half octave from `least` on, rounded half to even, up to a quarter
    of its own rows. Blocks are whole; those without spread are left out.
    """
    rows = df.where("r is not null").withColumn("i", F.row_number().over(in_time()) - 1)
    rows = rows.withColumn("n", F.count("*").over(Window.partitionBy("symbol")))
    steps = F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil(2 * F.log2(F.col("n") / least))).cast("int"))
    grid = F.transform(steps, lambda k: F.bround(least * F.pow(F.lit(2.0), k / 2)).cast("int"))
    own = F.array_distinct(F.filter(grid, lambda w: w <= F.floor(F.col("n") / 4))) if windows is None else F.array(*map(F.lit, windows))
    rows = rows.select("symbol", "i", "n", "r", F.explode(own).alias("w"))
    rows = rows.withColumn("block", F.floor(F.col("i") / F.col("w"))).where(F.col("block") < F.floor(F.col("n") / F.col("w")))
    block = Window.partitionBy("symbol", "w", "block")
    rows = rows.withColumn("d", F.col("r") - F.avg("r").over(block)).withColumn("c", F.sum("d").over(block.orderBy("i")))
    each = rows.groupBy("symbol", "w", "block").agg((F.max("c") - F.min("c")).alias("range"), F.stddev_samp("r").alias("sd")).where("sd > 0")
    rs = each.groupBy("symbol", "w").agg(F.avg(F.col("range") / F.col("sd")).alias("rs")).withColumn("noise", F.log(_expected_range(F.col("w"))))
    slopes = rs.groupBy("symbol").agg(F.count("*").alias("windows"), F.regr_slope(F.log("rs"), F.log("w")).alias("slope"), F.regr_slope("noise", F.log("w")).alias("noise"))
    return slopes.select("symbol", "windows", "slope", (F.col("slope") - F.col("noise") + 0.5).alias("hurst"))


#: Up to this many values the gamma functions are exact; beyond, Stirling's form.
EXACT = 340


def _front(n: int) -> float:
    return math.exp(math.lgamma((n - 1) / 2) - math.lgamma(n / 2)) / math.sqrt(math.pi) if n <= EXACT else 1 / math.sqrt(n * math.pi / 2)


def expected_range(n: int) -> float:
    """Rescaled range expected of n independent normal values, by Anis and Lloyd, with Peters' factor."""
    ends = sum(math.sqrt((n - i) / i) for i in range(1, n))
    return (n - 0.5) / n * _front(n) * ends


def _expected_range(n: Column) -> Column:
    """expected_range() of a column of 2 and more."""
    ends = F.aggregate(F.sequence(F.lit(1), n - 1), F.lit(0.0), lambda s, i: s + F.sqrt((n - i) / i))
    front = F.when(n <= EXACT, F.get(F.array(*[F.lit(_front(max(i, 2))) for i in range(EXACT + 1)]), n)).otherwise(1 / F.sqrt(n * math.pi / 2))
    return (n - 0.5) / n * front * ends


def phillips_perron(df: DataFrame, lags: int, column: str = "value", trend: str = "c") -> DataFrame:
    """Phillips-Perron Z-tau: the Dickey-Fuller t corrected by a Bartlett long-run variance; trend as for adf()."""
    if trend not in TRENDS:
        raise ValueError(f"unknown trend {trend!r}: {', '.join(TRENDS)}")
    rows = df.select("symbol", "ts", F.col(column).alias("y"), F.lag(column).over(in_time()).alias("x"), F.row_number().over(in_time()).alias("time")).na.drop()
    xs = ["x", *(["time"] if trend == "ct" else [])]
    fit = ols(rows, "y", xs, ["symbol"], const=trend != "n")
    slope = fit.where("term = 'x'").select("symbol", F.col("nobs").alias("n"), F.col("estimate").alias("b"), F.col("std_error").alias("se"))
    e = fitted(rows, fit, "y", xs, ["symbol"]).select("symbol", "ts", F.col("residual").alias("e"))
    e = e.select("*", *[F.lag("e", k).over(in_time()).alias(f"e{k}") for k in range(1, lags + 1)])
    s = e.groupBy("symbol").agg(F.sum(F.col("e") * F.col("e")).alias("c0"), *[F.sum(F.col("e") * F.col(f"e{k}")).alias(f"c{k}") for k in range(1, lags + 1)]).join(slope, "symbol")
    n, se = F.col("n"), F.col("se")
    own = F.col("c0") / n
    long_run = (F.col("c0") + sum((2 * (1 - k / (lags + 1)) * F.col(f"c{k}") for k in range(1, lags + 1)), F.lit(0.0))) / n
    s2 = F.col("c0") / (n - len(xs) - int(trend != "n"))
    stat = F.sqrt(own / long_run) * (F.col("b") - 1) / se - (long_run - own) / (2 * F.sqrt(long_run)) * n * se / F.sqrt(s2)
    return _judged(s.select("symbol", n.alias("nobs"), F.lit(lags).alias("lags"), stat.alias("statistic")), trend)


def partial_autocorrelation(df: DataFrame, lags: int, column: str = "r") -> DataFrame:
    """symbol, n, lag, pacf by Durbin and Levinson's recursion on autocovariances over n - lag rows."""
    adjusted = F.col("acf") * F.col("n") / (F.col("n") - F.col("lag"))
    rows = autocorrelation(df, lags, column).groupBy("symbol", "n").agg(F.array_sort(F.collect_list(F.struct("lag", adjusted.alias("rho")))).alias("a"))
    rows = rows.select("symbol", "n", F.col("a.rho").alias("rho"))

    def recursion(batches):
        for pdf in batches:
            out = []
            for symbol, n, rho in pdf.itertuples(index=False):
                phi: list[float] = []
                for k, r in enumerate(rho):
                    rest = 1 - sum(p * x for p, x in zip(phi, rho[:k], strict=True))
                    last = (r - sum(p * x for p, x in zip(phi, rho[:k][::-1], strict=True))) / rest
                    phi = [*[p - last * q for p, q in zip(phi, phi[::-1], strict=True)], last]
                    out.append((symbol, n, k + 1, last))
            yield pd.DataFrame(out, columns=["symbol", "n", "lag", "pacf"])

    return rows.mapInPandas(recursion, "symbol string, n long, lag int, pacf double")


def _fineness(n: Column, m: int) -> Column:
    """Columns within the distance: so many that steps over columns and comparisons in those at the rim weigh about the same."""
    size = F.sqrt(n) / 4 if m == 2 else F.cbrt(n) / 3
    return F.greatest(F.lit(2), F.round(size)).cast("int")


def near_pairs(points: DataFrame, m: int, fine: int | None = None) -> tuple[DataFrame, DataFrame]:
    """symbol, pairs: pairs of points (symbol, n, u0 .. u{m-1}) less than 1 apart in every coordinate; and the pairs that are compared one by one.

    All coordinates but the last are cut in columns. Points whose columns are surely within the distance are counted in the order of the last
    coordinate, by a window over each column; only points of columns at the rim, which may be or not be, are compared.
    """
    heads, last = [f"u{k}" for k in range(m - 1)], f"u{m - 1}"
    points = points.withColumn("fine", F.lit(fine) if fine else _fineness(F.col("n"), m))
    points = points.withColumns({f"c{k}": F.floor(F.col(h) * F.col("fine")).cast("int") for k, h in enumerate(heads)})
    cells = [f"c{k}" for k in range(m - 1)]
    asked = points
    for k in range(m - 1):
        asked = asked.withColumn(f"o{k}", F.explode(F.sequence(-F.col("fine"), F.col("fine"))))
    off = [F.col(f"o{k}") for k in range(m - 1)]
    rim = F.greatest(F.lit(0), *[F.abs(o) for o in off]) == F.col("fine")
    inner = asked.where(~rim).select("symbol", *[(F.col(c) + o).alias(c) for c, o in zip(cells, off, strict=True)], F.col(last).alias("u"), F.lit(0).alias("own"))
    both = inner.unionByName(points.select("symbol", *cells, F.col(last).alias("u"), F.lit(1).alias("own")))
    around = Window.partitionBy("symbol", *cells).orderBy("u").rangeBetween(-1, 1)
    counted = both.withColumn("met", F.sum("own").over(around)).where("own = 0").groupBy("symbol").agg(F.sum("met").alias("met"))
    # of two opposite columns at the rim one is enough
    ahead = off[0] > 0
    for k in range(1, m - 1):
        ahead = ahead | ((F.greatest(*[F.abs(o) for o in off[:k]], F.lit(0)) == 0) & (off[k] > 0))
    left = asked.where(rim & ahead).select("symbol", *[(F.col(c) + o).alias(c) for c, o in zip(cells, off, strict=True)], *[F.col(u).alias(f"_{u}") for u in [*heads, last]])
    compared = left.join(points.select("symbol", *cells, *heads, last), ["symbol", *cells])
    close = F.lit(True)
    for u in [*heads, last]:
        close = close & (F.abs(F.col(u) - F.col(f"_{u}")) < 1)
    at_rim = compared.where(close).groupBy("symbol").agg(F.count("*").alias("rim"))
    size = points.groupBy("symbol").agg(F.count("*").alias("size"))
    out = size.join(counted, "symbol", "left").join(at_rim, "symbol", "left")
    return out.select("symbol", ((F.coalesce("met", F.lit(0)) - F.col("size")) / 2 + F.coalesce("rim", F.lit(0))).cast("long").alias("pairs")), compared


def bds(df: DataFrame, dimensions: tuple[int, ...] = (2, 3), distance: float = 1.5, column: str = "r", fine: int | None = None) -> DataFrame:
    """symbol, n, dimension, statistic, p_value: Brock, Dechert and Scheinkman's test of independence, in 2 and 3 dimensions.

    Near means closer than `distance` standard deviations. Single values are counted in their own order, by a window; for histories of
    several values see near_pairs(), whose columns within the distance are `fine` if given. The pairs of all dates are never made.
    """
    if not set(dimensions) <= {2, 3}:
        raise ValueError("dimensions are 2 and 3")
    rows = df.where(F.col(column).isNotNull()).select("symbol", "ts", F.col(column).cast("double").alias("x"))
    s = rows.groupBy("symbol").agg(F.count("*").alias("n"), (distance * F.stddev_samp("x")).alias("eps"))
    rows = rows.join(s, "symbol").select("symbol", "n", (F.col("x") / F.col("eps")).alias("u0"), F.row_number().over(in_time()).alias("i"), *[(F.lead("x", k).over(in_time()) / F.col("eps")).alias(f"u{k}") for k in range(1, max(dimensions))])
    around = Window.partitionBy("symbol").orderBy("u0").rangeBetween(-1, 1)
    late = {m: F.count(F.when(F.col("i") >= m, 1)).over(around) for m in dimensions}  # of dates from the m-th on
    each = rows.select("symbol", "n", "i", F.count("*").over(around).alias("near"), *[c.alias(f"late{m}") for m, c in late.items()])
    sums = [((F.sum(F.when(F.col("i") >= m, F.col(f"late{m}"))) - F.count(F.when(F.col("i") >= m, 1))) / 2).cast("long").alias(f"one{m}") for m in dimensions]
    t = each.groupBy("symbol", "n").agg(F.sum("near").alias("near"), F.sum(F.col("near") * F.col("near")).alias("near2"), *sums)
    for m in dimensions:
        pairs, _ = near_pairs(rows.select("symbol", "n", *[f"u{k}" for k in range(m)]).na.drop(), m, fine)
        t = t.join(pairs.withColumnRenamed("pairs", f"all{m}"), "symbol")
    n = F.col("n").cast("double")
    c = (F.col("near") - n) / (n * (n - 1))
    k = (F.col("near2") - 3 * F.col("near") + 2 * n) / (n * (n - 1) * (n - 2))

    def one(m: int) -> Column:
        left = n - m + 1
        effect = F.col(f"all{m}") / (left * (left - 1) / 2) - F.pow(F.col(f"one{m}") / (left * (left - 1) / 2), F.lit(m))
        inner = sum((F.pow(k, F.lit(m - j)) * F.pow(c, F.lit(2 * j)) for j in range(1, m)), F.lit(0.0))
        var = 4 * (F.pow(k, F.lit(m)) + 2 * inner + (m - 1) ** 2 * F.pow(c, F.lit(2 * m)) - m * m * k * F.pow(c, F.lit(2 * m - 2)))
        return F.struct(F.lit(m).alias("dimension"), (F.sqrt(left) * effect / F.sqrt(var)).alias("statistic"))

    out = t.select("symbol", "n", F.explode(F.array(*map(one, dimensions))).alias("x")).select("symbol", "n", "x.*")
    return out.withColumn("p_value", normal_p(F.col("statistic")))


#: Weights of the score's components: the two unit-root tests share one.
WEIGHTS = {"adf": 0.5, "kpss": 0.5, "variance_ratio": 1.0, "runs": 1.0, "ljung_box": 1.0, "hurst": 1.0}
EFFICIENT, INEFFICIENT, LEAST_LEVELS = 70.0, 40.0, 257


def efficiency_score(levels: DataFrame, lags: int, horizons: list[int], windows: list[int] | None = None, lb_lags: int = 10, weights: dict[str, float] | None = None) -> DataFrame:
    """symbol, component, weight, statistic, p_value, sub_score, contribution, score, verdict, passed.

    A p-value scores 0 at 0.01 and 1 at 0.1; KPSS, whose null is the opposite, the other way round; the Hurst
    exponent scores 1 at 0.5 and 0 when 0.2 away. Variance ratios count by their least p-value, corrected for the
    number of horizons; one of exactly 0 is passed over. `passed` is null for a borderline score. Symbols with
    fewer than LEAST_LEVELS levels are left out.
    """
    weights = WEIGHTS | (weights or {})
    if min(weights.values()) < 0 or sum(weights.values()) <= 0:
        raise ValueError("weights must not be negative, and one must be positive")
    x = levels.where("value > 0").withColumn("_n", F.count("*").over(Window.partitionBy("symbol"))).where(F.col("_n") >= LEAST_LEVELS)
    logs = x.select("symbol", "ts", F.log("value").alias("value"))
    r = logs.select("symbol", "ts", (F.col("value") - F.lag("value").over(in_time())).alias("r")).where("r is not null")
    p, s = F.col("p_value"), F.col("statistic")
    usual = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (p - 0.01) / 0.09))
    vr = variance_ratio(x, horizons).withColumn("q", F.when(F.coalesce(p, F.lit(0.0)) == 0, 1.0).otherwise(p))
    vr = vr.groupBy("symbol").agg(F.min_by("z_robust", F.struct("q", "horizon")).alias("statistic"), (1 - F.pow(1 - F.min("q"), F.lit(len(set(horizons))))).alias("p_value"))
    parts = {
        "adf": (adf(logs, lags), usual), "kpss": (kpss(logs, lags), 1 - usual), "variance_ratio": (vr, usual),
        "runs": (runs_test(r).withColumnRenamed("z", "statistic"), usual), "ljung_box": (ljung_box(r, lb_lags), usual),
        "hurst": (hurst(r, windows).select("symbol", F.col("hurst").alias("statistic"), F.lit(None).cast("double").alias("p_value")), F.greatest(F.lit(0.0), 1 - F.abs(s - 0.5) / 0.2)),
    }
    rows = None
    for name, (found, sub) in parts.items():
        part = found.select("symbol", F.lit(name).alias("component"), F.lit(weights[name]).alias("weight"), "statistic", "p_value", sub.alias("sub_score"))
        rows = part if rows is None else rows.union(part)
    rows = rows.withColumn("contribution", 100 * F.col("weight") * F.col("sub_score") / sum(weights.values()))
    rows = rows.withColumn("score", F.sum("contribution").over(Window.partitionBy("symbol")))
    verdict = F.when(F.col("score") >= EFFICIENT, "efficient").when(F.col("score") < INEFFICIENT, "inefficient").otherwise("borderline")
    return rows.withColumn("verdict", verdict).withColumn("passed", F.when(F.col("verdict") != "borderline", F.col("verdict") == "efficient"))
