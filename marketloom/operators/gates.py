"""Gates: preconditions of a model, judged on the series itself. A verdict that can't be made is null and lets the model run."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .diagnostics import arch_lm, in_time
from .efficiency import adf
from .gram import fitted, ols

#: What each model needs: the gate, and whether what it looks for must be there.
NEEDS = {"garch": ("arch_effects", True), "egarch": ("arch_effects", True), "gjr_garch": ("arch_effects", True), "var_model": ("stationarity", True), "vecm": ("stationarity", False)}


def arch_effects(df: DataFrame, column: str = "r", lags: int = 10) -> DataFrame:
    """symbol, gate, statistic, p_value, present: ARCH-LM of the series after its first autoregression is taken out."""
    rows = df.where(F.col(column).isNotNull()).select("symbol", "ts", F.col(column).alias("y"), F.lag(column).over(in_time()).alias("x")).na.drop()
    residuals = fitted(rows, ols(rows, "y", ["x"], ["symbol"]), "y", ["x"], ["symbol"])
    found = arch_lm(residuals, lags)
    return found.select("symbol", F.lit("arch_effects").alias("gate"), "statistic", "p_value", (F.col("p_value") < 0.05).alias("present"))


def stationarity(df: DataFrame, column: str = "value", lags: int | None = None) -> DataFrame:
    """symbol, gate, statistic, p_value, present: whether a unit root is rejected."""
    return adf(df, lags, column).select("symbol", F.lit("stationarity").alias("gate"), "statistic", "p_value", F.col("passed").alias("present"))


def allowed(verdicts: DataFrame, model: str) -> DataFrame:
    """verdicts of the model's gate with allowed: what it needs is there (or not), or couldn't be judged."""
    gate, wanted = NEEDS[model]
    return verdicts.where(F.col("gate") == gate).withColumn("allowed", F.coalesce(F.col("present") == wanted, F.lit(True)))
