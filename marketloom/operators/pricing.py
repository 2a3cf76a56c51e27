"""Asset pricing: CAPM, factor models, rolling beta, Fama-MacBeth. Inputs are long: symbol, ts, r and factor columns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.distributions import t_p, t_ppf, t_quantile
from .gram import CONST, ols

PERIODS = {"D": 252, "W": 52, "M": 12, "Q": 4, "A": 1}


def capm(df: DataFrame, market: str = "m", risk_free: str | None = None, frequency: str = "D", min_obs: int = 30) -> DataFrame:
    """alpha, beta, their standard errors, t and p-values, R2 and annualised alpha of each symbol; a risk-free rate leaves both sides."""
    y, x = F.col("r"), F.col(market)
    if risk_free:
        y, x = y - F.col(risk_free), x - F.col(risk_free)
    pairs = df.select("symbol", y.alias("y"), x.alias("x")).na.drop()
    s = pairs.groupBy("symbol").agg(
        F.count("*").alias("nobs"), F.regr_slope("y", "x").alias("beta"), F.regr_intercept("y", "x").alias("alpha"), F.regr_r2("y", "x").alias("r2"),
        F.regr_sxx("y", "x").alias("sxx"), F.regr_syy("y", "x").alias("syy"), F.regr_sxy("y", "x").alias("sxy"), F.avg("x").alias("mx"),
    )
    s = s.where(F.col("nobs") >= max(3, min_obs)).withColumn("mse", (F.col("syy") - F.col("sxy") * F.col("sxy") / F.col("sxx")) / (F.col("nobs") - 2))
    s = s.withColumns({
        "alpha_se": F.sqrt(F.col("mse") * (1 / F.col("nobs") + F.col("mx") * F.col("mx") / F.col("sxx"))), "beta_se": F.sqrt(F.col("mse") / F.col("sxx")),
        "alpha_annualised": F.pow(1 + F.col("alpha"), F.lit(PERIODS[frequency])) - 1,
    })
    t = {c: F.try_divide(F.col(c), F.col(f"{c}_se")) for c in ("alpha", "beta")}
    s = s.withColumns({f"{c}_t": v for c, v in t.items()}).withColumns({f"{c}_p": t_p(F.col(f"{c}_t"), F.col("nobs") - 2) for c in t})
    return s.select("symbol", "nobs", "alpha", "beta", "r2", "alpha_se", "beta_se", "alpha_t", "beta_t", "alpha_p", "beta_p", "alpha_annualised")


def capm_intervals(fit: DataFrame, level: float = 0.95) -> DataFrame:
    """symbol, term, estimate, ci_low, ci_high of a fit of capm()."""
    wide = t_quantile((1 + level) / 2, F.col("nobs") - 2)
    each = [F.struct(F.lit(c).alias("term"), F.col(c).alias("estimate"), (F.col(c) - F.col("q") * F.col(f"{c}_se")).alias("ci_low"), (F.col(c) + F.col("q") * F.col(f"{c}_se")).alias("ci_high")) for c in ("alpha", "beta")]
    return fit.withColumn("q", wide).select("symbol", F.explode(F.array(*each)).alias("x")).select("symbol", "x.*")


def factor_model(df: DataFrame, factors: list[str], risk_free: str | None = None, min_obs: int = 30) -> DataFrame:
    """Least squares of each symbol on the factors; a risk-free rate leaves the asset's side only."""
    if not factors or len(set(factors)) < len(factors):
        raise ValueError("factors must be named, each once")
    rows = df.withColumn("r", F.col("r") - F.col(risk_free)) if risk_free else df
    return ols(rows, "r", factors, ["symbol"]).where(F.col("nobs") >= max(min_obs, len(factors) + 2))


def rolling_beta(df: DataFrame, market: str = "m", window: int = 252) -> DataFrame:
    """Beta and its standard error over the last `window` observations of each symbol; shorter windows are left out."""
    w = Window.partitionBy("symbol").orderBy("ts").rowsBetween(-(window - 1), 0)
    y, x = F.col("r"), F.col(market)
    n = F.count("*").over(w)
    mean = lambda c: F.sum(c).over(w) / n
    whole = Window.partitionBy("symbol")
    held = df.na.drop(subset=["r", market]).select("symbol", "ts", (y - F.avg(y).over(whole)).alias("r"), (x - F.avg(x).over(whole)).alias(market))
    rows = held.select(
        "symbol", "ts", n.alias("n"), mean(x).alias("mx"), mean(y).alias("my"), mean(x * x).alias("xx"), mean(x * y).alias("xy"), mean(y * y).alias("yy")
    )
    sxx, sxy, syy = (F.col(a) - F.col(b) * F.col(c) for a, b, c in (("xx", "mx", "mx"), ("xy", "mx", "my"), ("yy", "my", "my")))
    beta = sxy / sxx
    return rows.where(F.col("n") == window).select("symbol", "ts", beta.alias("beta"), F.sqrt((syy - beta * sxy) / (window - 2) / sxx).alias("beta_se"))


def beta_band(rolled: DataFrame, window: int = 252, level: float = 0.95) -> DataFrame:
    """Adds beta_ci_low and beta_ci_high to the rows of rolling_beta() with that window, by Student's t with window - 2 degrees of freedom."""
    wide = t_ppf((1 + level) / 2, window - 2) * F.col("beta_se")
    return rolled.withColumns({"beta_ci_low": F.col("beta") - wide, "beta_ci_high": F.col("beta") + wide})


def beta_summary(rolled: DataFrame) -> DataFrame:
    """symbol, windows, mean_beta, min_beta, max_beta, last_beta of the rows of rolling_beta()."""
    beta = F.col("beta")
    return rolled.groupBy("symbol").agg(F.count(beta).alias("windows"), F.avg(beta).alias("mean_beta"), F.min(beta).alias("min_beta"), F.max(beta).alias("max_beta"), F.max_by(beta, "ts").alias("last_beta"))


def fama_macbeth(panel: DataFrame, exposures: list[str], y: str = "r", period: str = "ts", entity: str = "symbol") -> DataFrame:
    """Premium of each exposure: mean of the per-period estimates, with the standard error of that mean, its t and p-value (periods - 1)."""
    held = panel.na.drop(subset=[y, *exposures])
    each = ols(held, y, exposures, [period]).where(F.col("nobs") >= len(exposures) + 2)
    out = each.groupBy("term").agg(F.count("*").alias("periods"), F.avg("estimate").alias("premium"), F.stddev_samp("estimate").alias("sd"))
    se = F.col("sd") / F.sqrt("periods")
    return out.where("periods >= 2").select("term", "periods", "premium", se.alias("std_error"), F.try_divide(F.col("premium"), se).alias("t_stat")).withColumn("p_value", t_p(F.col("t_stat"), F.col("periods") - 1))


def grs(df: DataFrame, factors: list[str]) -> DataFrame:
    """Gibbons-Ross-Shanken statistic that all symbols' alphas are zero, with its p-value: one row.

    The cross products of all series are one pass; symbols are collected only as that matrix of the names.
    """
    import numpy as np

    from ..functions.distributions import f_sf
    from .gram import cross_products

    names = sorted(r[0] for r in df.select("symbol").distinct().collect())
    wide = df.groupBy("ts", *factors).pivot("symbol", names).agg(F.first("r")).na.drop()
    columns = [CONST, *factors, *names]
    wide = wide.select("*", F.lit(1.0).alias(CONST))
    row = wide.agg(*cross_products(columns), F.count("*").alias("n")).first()
    k, m, n, t = len(columns), len(names), len(factors), row["n"]
    g = np.array([[row[f"{min(i, j)}_{max(i, j)}"] or 0.0 for j in range(k)] for i in range(k)])
    schema = "portfolios int, nobs long, grs double, p_value double"
    if t - m - n <= 0:
        return df.sparkSession.createDataFrame([], schema)
    f = n + 1
    b = np.linalg.solve(g[:f, :f], g[:f, f:])
    sigma = (g[f:, f:] - g[f:, :f] @ b) / t
    mu = g[0, 1:f] / t
    omega = g[1:f, 1:f] / t - np.outer(mu, mu)
    stat = (t - m - n) / m * (b[0] @ np.linalg.solve(sigma, b[0])) / (1 + mu @ np.linalg.solve(omega, mu))
    return df.sparkSession.createDataFrame([(m, int(t), float(stat), f_sf(float(stat), m, t - m - n))], schema)
