"""Diagnostics of residuals: symbol, ts, residual (and regressors)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.distributions import chi2_p, kolmogorov_p
from .gram import inflation, ols

def in_time():
    return Window.partitionBy("symbol").orderBy("ts")


def jarque_bera(df: DataFrame, column: str = "residual") -> DataFrame:
    s = df.groupBy("symbol").agg(F.count(column).alias("n"), F.skewness(column).alias("skewness"), F.kurtosis(column).alias("excess_kurtosis"))
    jb = F.col("n") / 6 * (F.col("skewness") * F.col("skewness") + F.col("excess_kurtosis") * F.col("excess_kurtosis") / 4)
    return s.withColumn("statistic", jb).withColumn("p_value", F.exp(-F.col("statistic") / 2))


def durbin_watson(df: DataFrame, column: str = "residual") -> DataFrame:
    e = F.col(column)
    rows = df.select("symbol", e.alias("e"), (e - F.lag(e).over(in_time())).alias("d"))
    s = rows.groupBy("symbol").agg((F.sum(F.col("d") * F.col("d")) / F.sum(F.col("e") * F.col("e"))).alias("statistic"))
    return s.withColumn("passed", F.col("statistic").between(1.5, 2.5))


def _lm(df: DataFrame, xs: list[str]) -> DataFrame:
    """n * R2 of e2 on xs."""
    fit = ols(df, "e2", xs, ["symbol"]).where("term = 'const'")
    out = fit.select("symbol", F.col("nobs").alias("n"), (F.col("nobs") * F.col("r2")).alias("statistic"))
    return out.withColumn("p_value", chi2_p(F.col("statistic"), len(xs)))


def breusch_pagan(df: DataFrame, xs: list[str], column: str = "residual") -> DataFrame:
    return _lm(df.withColumn("e2", F.col(column) * F.col(column)), xs)


def white(df: DataFrame, xs: list[str], column: str = "residual") -> DataFrame:
    products = {f"{a}*{b}": F.col(a) * F.col(b) for i, a in enumerate(xs) for b in xs[i:]}
    named = {f"_w{i}": v for i, v in enumerate(products.values())}
    return _lm(df.withColumns({"e2": F.col(column) * F.col(column), **named}), [*xs, *named])


def arch_lm(df: DataFrame, lags: int = 5, column: str = "residual") -> DataFrame:
    rows = df.select("symbol", "ts", (F.col(column) * F.col(column)).alias("e2"))
    return _lm(rows.select("symbol", "e2", *[F.lag("e2", k).over(in_time()).alias(f"l{k}") for k in range(1, lags + 1)]), [f"l{k}" for k in range(1, lags + 1)])


def vif(df: DataFrame, xs: list[str]) -> DataFrame:
    """Variance inflation of each regressor: 1 / (1 - R2) on the others; over 10 is much."""
    return inflation(df, xs, ["symbol"]).withColumn("passed", F.col("vif") <= 10)


def cusum(df: DataFrame, column: str = "residual") -> DataFrame:
    """Largest absolute cumulative sum of the demeaned residuals over sqrt(n * variance), and its Kolmogorov p-value."""
    whole = Window.partitionBy("symbol")
    rows = df.select("symbol", "ts", (F.col(column) - F.avg(column).over(whole)).alias("d"))
    rows = rows.select("symbol", "d", F.abs(F.sum("d").over(in_time().rowsBetween(Window.unboundedPreceding, 0))).alias("c"))
    out = rows.groupBy("symbol").agg(F.count("*").alias("n"), (F.max("c") / F.sqrt(F.sum(F.col("d") * F.col("d")))).alias("statistic"))
    return out.withColumn("p_value", kolmogorov_p(F.col("statistic")))


def structural_break(df: DataFrame, column: str = "residual", least: int = 2, stride: int = 5) -> DataFrame:
    """The place, a multiple of stride, that splits a series in two with the least squared error, the shift of means in standard deviations, and whether that is material (0.5)."""
    upto = in_time().rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy("symbol")
    x = F.col(column) - F.avg(column).over(whole)
    rows = df.select("symbol", "ts", x.alias("x"))
    x = F.col("x")
    rows = rows.select("symbol", F.count("*").over(upto).alias("k"), F.count("*").over(whole).alias("n"), F.sum(x).over(upto).alias("s"), F.stddev_pop(x).over(whole).alias("sd"))
    rows = rows.where((F.col("k") >= least) & (F.col("n") - F.col("k") >= least) & (F.col("k") % stride == 0))
    left, right = F.col("s") / F.col("k"), -F.col("s") / (F.col("n") - F.col("k"))
    gain = F.col("k") * left * left + (F.col("n") - F.col("k")) * right * right
    rows = rows.select("symbol", "k", gain.alias("gain"), F.try_divide(F.abs(right - left), F.col("sd")).alias("effect"))
    best = F.struct("gain", -F.col("k"))
    out = rows.groupBy("symbol").agg(F.max_by("k", best).alias("position"), F.max_by("effect", best).alias("effect"))
    return out.withColumn("material", F.col("effect") >= 0.5)
