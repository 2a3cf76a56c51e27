"""Volatility and risk of return series: symbol, ts, r. VaR figures are positive losses."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.distributions import chi2_p, normal_ppf, t_ppf
from .conditional import climb, garch, spread  # noqa: F401  (a model of volatility like the others here)
from .pricing import PERIODS


def _tail(df: DataFrame, confidence: float) -> DataFrame:
    """symbol, n, quantile: the order statistic floor((n - 1) * (1 - confidence)) + 1 of each symbol."""
    counts = df.groupBy("symbol").agg(F.count("r").alias("n"))
    ranked = df.where("r is not null").withColumn("k", F.row_number().over(Window.partitionBy("symbol").orderBy("r")))
    at = F.floor((F.col("n") - 1) * (F.lit(1.0) - F.lit(float(confidence)))) + 1
    return ranked.join(counts, "symbol").where(F.col("k") == at).select("symbol", "n", F.col("r").alias("quantile"))


def historical_var(df: DataFrame, confidence: float = 0.95, min_obs: int = 100) -> DataFrame:
    tail = _tail(df, confidence)
    below = df.join(tail, "symbol").where("r <= quantile").groupBy("symbol", "n", "quantile").agg(F.count("*").alias("n_tail"), F.avg("r").alias("m"))
    return below.where(F.col("n") >= min_obs).select("symbol", "n", (-F.col("quantile")).alias("var"), "n_tail", (-F.col("m")).alias("cvar"))


def parametric_var(df: DataFrame, confidence: float = 0.95, zero_mean: bool = False) -> DataFrame:
    """Under a normal distribution."""
    z = normal_ppf(1 - confidence)
    s = df.groupBy("symbol").agg(F.count("r").alias("n"), F.avg("r").alias("mu"), F.stddev_samp("r").alias("sd"), F.sqrt(F.avg(F.col("r") * F.col("r"))).alias("rms"))
    mu, sd = (F.lit(0.0), F.col("rms")) if zero_mean else (F.col("mu"), F.col("sd"))
    return s.select("symbol", "n", mu.alias("mu"), sd.alias("sigma"), (-(mu + sd * z)).alias("var"))


def student_var(df: DataFrame, confidence: float = 0.95, zero_mean: bool = False, min_obs: int = 100) -> DataFrame:
    """Under Student's t by maximum likelihood: symbol, n, nu (1e4 at most), mu, sigma (the scale, not the deviation), var. Constant series are left out."""

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        r = pdf.r.dropna().to_numpy()
        if len(r) < max(min_obs, 2) or not np.ptp(r):
            return pd.DataFrame([], columns=["symbol", "n", "nu", "mu", "sigma", "var"])
        unit = float(r.std())
        x = r / unit

        def shape(theta: np.ndarray) -> tuple[float, float, float]:
            return math.exp(min(theta[0], math.log(1e4))), math.exp(min(theta[1], 50.0)), 0.0 if zero_mean else theta[2]

        def value(theta: np.ndarray) -> float:
            nu, scale, loc = shape(theta)
            level = math.lgamma((nu + 1) / 2) - math.lgamma(nu / 2) - 0.5 * math.log(nu * math.pi) - math.log(scale)
            total = len(x) * level - (nu + 1) / 2 * float(np.log1p(((x - loc) / scale) ** 2 / nu).sum())
            return total if math.isfinite(total) else -1e300

        theta = np.array([math.log(6.0), -0.3, *([] if zero_mean else [float(np.median(x))])])
        for _ in range(2):
            theta, _, _ = climb(value, theta, 500)
        nu, scale, loc = shape(theta)
        return pd.DataFrame([(pdf.symbol.iloc[0], len(r), nu, loc * unit, scale * unit, -unit * (loc + scale * t_ppf(1 - confidence, nu)))], columns=["symbol", "n", "nu", "mu", "sigma", "var"])

    return spread(df.select("symbol", "r")).groupBy("symbol").applyInPandas(fit, "symbol string, n long, nu double, mu double, sigma double, var double")


def ewma_vol(df: DataFrame, decay: float = 0.94, frequency: str = "D") -> DataFrame:
    """Exponentially weighted volatility of each symbol, from the first squared return on: one row each.

    A recursion, so it runs along each series: the squares in order, folded by a higher-order function.
    """
    squares = df.where("r is not null").groupBy("symbol").agg(F.array_sort(F.collect_list(F.struct("ts", (F.col("r") * F.col("r")).alias("s")))).alias("a"))
    fold = F.aggregate(F.slice("a", 2, F.greatest(F.size("a") - 1, F.lit(0))), F.element_at("a", 1)["s"], lambda v, x: v * decay + x["s"] * (1 - decay))
    vol = F.sqrt(fold)
    return squares.select("symbol", F.size("a").cast("long").alias("n"), vol.alias("vol"), (vol * math.sqrt(PERIODS[frequency])).alias("annualised"))


def realized_vol(df: DataFrame, window: int = 21, demean: bool = False) -> DataFrame:
    w = Window.partitionBy("symbol").orderBy("ts").rowsBetween(-(window - 1), 0)
    vol = F.stddev_samp("r").over(w) if demean else F.sqrt(F.avg(F.col("r") * F.col("r")).over(w))
    return df.where("r is not null").select("symbol", "ts", F.when(F.count("*").over(w) == window, vol).alias("vol"))


def drawdown(levels: DataFrame) -> DataFrame:
    """One row a symbol: deepest fall, its peak, trough and recovery, number of spells, current and longest in days.

    A spell lasts from its peak to the date when that level is reached again; the deepest of equal depth is the first.
    """
    upto = Window.partitionBy("symbol").orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)
    rows = levels.withColumn("top", F.max("value").over(upto)).withColumn("dd", 1 - F.col("value") / F.col("top"))
    rows = rows.withColumn("spell", F.sum(F.when(F.col("dd") <= 0, 1).otherwise(0)).over(upto))
    spells = rows.groupBy("symbol", "spell").agg(
        F.max("dd").alias("depth"), F.max(F.when(F.col("dd") <= 0, F.col("ts"))).alias("peak"), F.max("ts").alias("end"), F.min_by("ts", F.struct(-F.col("dd"), "ts")).alias("trough")
    )
    back = F.lead("peak").over(Window.partitionBy("symbol").orderBy("spell"))
    spells = spells.withColumn("recovery", back).withColumn("days", F.datediff(F.coalesce("recovery", "end"), "peak")).withColumn("fell", F.col("depth") > 0)
    now = rows.groupBy("symbol").agg(F.max_by("dd", "ts").alias("current"))
    deepest = F.struct(F.when(F.col("fell"), F.col("depth")).alias("depth"), (-F.col("spell")).alias("first"))
    out = spells.groupBy("symbol").agg(
        F.max("depth").alias("max_drawdown"), F.max_by("peak", deepest).alias("peak"), F.max_by("trough", deepest).alias("trough"),
        F.max_by("recovery", deepest).alias("recovery"), F.count_if("fell").alias("episodes"), F.max(F.when(F.col("fell"), F.col("days")).otherwise(0)).alias("longest_days"),
    )
    return out.join(now, "symbol")


def _xlogy(n: Column, p: Column) -> Column:
    return F.when(n > 0, n * F.log(p)).otherwise(0.0)


def kupiec(df: DataFrame, var: Column, confidence: float = 0.95) -> DataFrame:
    """Unconditional coverage: violations are returns strictly below -var."""
    p = 1 - confidence
    s = df.where("r is not null").withColumn("hit", F.col("r") < -var).groupBy("symbol").agg(F.count("*").alias("n"), F.count_if("hit").alias("x"))
    n, x = F.col("n"), F.col("x")
    lr = -2 * (_xlogy(n - x, F.lit(1 - p)) + _xlogy(x, F.lit(p)) - _xlogy(n - x, 1 - x / n) - _xlogy(x, x / n))
    return s.select("symbol", "n", F.col("x").alias("violations"), lr.alias("lr")).withColumn("p_value", chi2_p(F.col("lr"), 1))


def christoffersen(df: DataFrame, var: Column, confidence: float = 0.95) -> DataFrame:
    """Independence of violations and conditional coverage: transition counts, lr and p_value (independence), lr_uc, lr_cc and p_value_cc.

    lr is 0 if there are no violations, or only violations; passed is null then, and otherwise says that neither test rejects at 5 %.
    """
    order = Window.partitionBy("symbol").orderBy("ts")
    rows = df.where("r is not null").withColumn("hit", (F.col("r") < -var).cast("int"))
    rows = rows.withColumn("before", F.lag("hit").over(order)).where("before is not null")
    s = rows.groupBy("symbol").agg(*[F.count_if((F.col("before") == a) & (F.col("hit") == b)).alias(f"n{a}{b}") for a in (0, 1) for b in (0, 1)])
    n00, n01, n10, n11 = (F.col(f"n{x}") for x in ("00", "01", "10", "11"))
    pi = (n01 + n11) / (n00 + n01 + n10 + n11)
    p0, p1 = F.try_divide(n01, n00 + n01), F.try_divide(n11, n10 + n11)
    apart = _xlogy(n00, 1 - p0) + _xlogy(n01, p0) + _xlogy(n10, 1 - p1) + _xlogy(n11, p1)
    lr = -2 * (_xlogy(n00 + n10, 1 - pi) + _xlogy(n01 + n11, pi) - apart)
    none = (n01 + n11 == 0) | (n00 + n10 == 0)
    s = s.withColumn("lr", F.when(none, 0.0).otherwise(lr)).withColumn("p_value", chi2_p(F.col("lr"), 1))
    covered = kupiec(df, var, confidence).select("symbol", F.col("lr").alias("lr_uc"))
    s = s.join(covered, "symbol").withColumn("lr_cc", F.col("lr") + F.col("lr_uc")).withColumn("p_value_cc", chi2_p(F.col("lr_cc"), 2))
    return s.withColumn("passed", F.when(~none, (F.col("p_value") >= 0.05) & (F.col("p_value_cc") >= 0.05)))
