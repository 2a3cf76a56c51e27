"""Data of charts: small tables made of long series by aggregation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.distributions import normal_quantile


def histogram(df: DataFrame, column: str, bins: int = 20) -> DataFrame:
    """symbol, bin (from 1), low, high, n: bins of equal width between each symbol's least and greatest value; empty bins are left out."""
    if not 5 <= bins <= 200:
        raise ValueError("5 to 200 bins")
    ends = df.where(F.col(column).isNotNull()).groupBy("symbol").agg(F.min(column).alias("least"), ((F.max(column) - F.min(column)) / bins).alias("width"))
    at = F.least(F.lit(bins), F.floor(F.try_divide(F.col(column) - F.col("least"), F.col("width"))) + 1).cast("int")
    rows = df.where(F.col(column).isNotNull()).join(ends, "symbol").withColumn("bin", F.coalesce(at, F.lit(1)))
    out = rows.groupBy("symbol", "bin", "least", "width").agg(F.count("*").alias("n"))
    return out.select("symbol", "bin", (F.col("least") + (F.col("bin") - 1) * F.col("width")).alias("low"), (F.col("least") + F.col("bin") * F.col("width")).alias("high"), "n")


def quantile_points(df: DataFrame, column: str) -> DataFrame:
    """symbol, i, theoretical, sample: sorted values against normal quantiles at (i + 0.5) / n."""
    order = Window.partitionBy("symbol").orderBy(column)
    rows = df.where(F.col(column).isNotNull()).select("symbol", F.col(column).alias("sample"), (F.row_number().over(order) - 1).alias("i"), F.count("*").over(Window.partitionBy("symbol")).alias("n"))
    return rows.select("symbol", "i", normal_quantile((F.col("i") + 0.5) / F.col("n")).alias("theoretical"), "sample")


def stacked(df: DataFrame, x: str, series: str, value: str) -> DataFrame:
    """x, series, low, high: each series on top of those before it by name."""
    upto = Window.partitionBy(x).orderBy(series).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("high", F.sum(value).over(upto)).select(x, series, (F.col("high") - F.col(value)).alias("low"), "high")
