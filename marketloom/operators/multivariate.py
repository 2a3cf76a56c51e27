"""Relations between series: vector autoregression, Granger causality, cointegrating residuals."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.distributions import chi2_sf, critical_values, f_sf, unit_root_p
from .efficiency import adf
from .gram import CONST, fitted, ols


def wide(df: DataFrame, names: list[str], column: str = "r") -> DataFrame:
    """ts and a column for each name, on the dates that all have."""
    return df.where(F.col("symbol").isin(names)).groupBy("ts").pivot("symbol", names).agg(F.first(column)).na.drop()


def lagged(df: DataFrame, columns: list[str], lags: int) -> DataFrame:
    """Adds c_Lk for each column and lag; a single calendar, so one window (its rows are the dates)."""
    order = Window.partitionBy(F.lit(0)).orderBy("ts")
    return df.select("*", *[F.lag(c, k).over(order).alias(f"{c}_L{k}") for k in range(1, lags + 1) for c in columns])


def var_model(df: DataFrame, columns: list[str], lags: int) -> DataFrame:
    """equation, term, estimate, std_error, ...: one least-squares fit an equation over the same lagged rows."""
    rows = lagged(df, columns, lags)
    xs = [f"{c}_L{k}" for k in range(1, lags + 1) for c in columns]
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("equation"), F.col(c).alias("y")) for c in columns]))
    return ols(rows.select(*xs, each.alias("e")).select(*xs, "e.*"), "y", xs, ["equation"])


def granger(df: DataFrame, x: str, y: str, lags: int) -> DataFrame:
    """cause, effect, lags, nobs, test, statistic, p_value: both directions, each number of lags up to `lags`, one pass over the rows.

    Tests: F (ssr_ftest; params_ftest gives the same), chi-squared and likelihood ratio. Each number of lags has its own rows, as many as it can.
    """
    order = Window.partitionBy(F.lit(0)).orderBy("ts")  # a single calendar: its rows are the dates
    rows = lagged(df.select("ts", x, y).na.drop(), [x, y], lags).withColumn("place", F.row_number().over(order))
    names = [CONST, *[f"{c}_L{k}" for k in range(1, lags + 1) for c in (x, y)], x, y]
    value = {n: F.lit(1.0) if n == CONST else F.col(n) for n in names}
    use = {p: [CONST, *[f"{c}_L{k}" for k in range(1, p + 1) for c in (x, y)], x, y] for p in range(1, lags + 1)}
    cells = {(p, i, j): F.sum(F.when(F.col("place") > p, value[a] * value[b])) for p, own in use.items() for i, a in enumerate(own) for j, b in enumerate(own) if j >= i}
    row = rows.agg(*[v.alias("_".join(map(str, k))) for k, v in cells.items()]).first()
    out = []
    for p, own in use.items():
        if not row[f"{p}_0_0"]:
            continue
        g, n = np.empty((len(own), len(own))), int(row[f"{p}_0_0"])
        for i in range(len(own)):
            for j in range(i, len(own)):
                g[i, j] = g[j, i] = row[f"{p}_{i}_{j}"]
        for cause, effect, at in ((x, y, len(own) - 1), (y, x, len(own) - 2)):
            rest = [0, *[own.index(f"{effect}_L{k}") for k in range(1, p + 1)]]
            s0, s1 = (g[at, at] - g[at, use_] @ np.linalg.solve(g[np.ix_(use_, use_)], g[use_, at]) for use_ in (rest, list(range(2 * p + 1))))
            df2 = n - 2 * p - 1
            f, chi2, lr = (s0 - s1) / p / (s1 / df2), n * (s0 - s1) / s1, n * float(np.log(s0 / s1))
            for test, value_, tail in (("ssr_ftest", f, f_sf(f, p, df2)), ("ssr_chi2test", chi2, chi2_sf(chi2, p)), ("lrtest", lr, chi2_sf(lr, p)), ("params_ftest", f, f_sf(f, p, df2))):
                out.append((cause, effect, p, n, test, float(value_), float(tail)))
    return df.sparkSession.createDataFrame(out, "cause string, effect string, lags int, nobs long, test string, statistic double, p_value double")


def engle_granger(df: DataFrame, y: str, xs: list[str], lags: int) -> DataFrame:
    """Dickey-Fuller t of the residuals of y on a constant and xs, without a constant of its own; p-value and critical values for so many series.

    passed: no cointegration is rejected at 5 %.
    """
    spread = fitted(df, ols(df, y, xs), y, xs).select(F.lit(y).alias("symbol"), "ts", F.col("residual").alias("value"))
    out = adf(spread, lags, trend="n").drop("p_value", "passed", "critical_1", "critical_5", "critical_10")
    series = len(xs) + 1
    out = out.withColumn("p_value", unit_root_p(F.col("statistic"), "c", series))
    return out.select("*", *critical_values(F.col("nobs"), "c", series), (F.col("p_value") < 0.05).alias("passed"))
