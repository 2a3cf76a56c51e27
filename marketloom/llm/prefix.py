"""Running sums over large keys: exact prefix sums by (key, slice) totals, so no key lands in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def running(df: DataFrame, key: str, slice_: str, order: list[str | Column], sums: dict[str, str]) -> DataFrame:
    """Adds, for each new: old in sums, the sum of old over the rows of the same key that stand before.

    Rows are ordered by slice_ (an integer with few thousand values, ascending) and then by `order`. Only the
    totals of (key, slice) go through a window over a key; rows are ordered within their slice.
    """
    before = {f"_{new}": F.sum(old) for new, old in sums.items()}
    totals = df.groupBy(key, slice_).agg(*[v.alias(k) for k, v in before.items()])
    over = Window.partitionBy(key).orderBy(slice_).rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        F.col(key).alias("_k"), F.col(slice_).alias("_s"), *[F.coalesce(F.sum(k).over(over), F.lit(0)).alias(k) for k in before]
    )
    inner = Window.partitionBy(key, slice_).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    joined = df.join(offsets, F.col(key).eqNullSafe(F.col("_k")) & (F.col(slice_) == F.col("_s")))
    for new, old in sums.items():
        joined = joined.withColumn(new, F.col(f"_{new}") + F.coalesce(F.sum(old).over(inner), F.lit(0)))
    return joined.drop("_k", "_s", *before)
