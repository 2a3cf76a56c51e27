"""Recursions v = a v' + b along series, as a distributed scan: a step is an affine map, and maps compose.

A series is cut into blocks of WIDTH places by its own order (days, say), so no sort of a whole series is needed. Each block folds its
steps into one map, in an array of at most WIDTH entries; the blocks' maps are a shorter series of the same kind, scanned the same
way, until one block is left. Its values, handed back down, are what the blocks begin with. A series of n places takes log(n)
levels; no task ever holds more of it than a block.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .efficiency import in_time
from .pricing import PERIODS

WIDTH = 256


def day(ts: str = "ts") -> Column:
    return F.datediff(F.col(ts).cast("date"), F.lit("1970-01-01").cast("date")).cast("long")


def _folded(steps: Column) -> Column:
    """For each of the steps (at, a, b) in order: at, and the map from before the block to behind the step, as a and b."""
    empty = F.struct(F.array().cast("array<struct<at:bigint,a:double,b:double>>").alias("done"), F.lit(1.0).alias("a"), F.lit(0.0).alias("b"))

    def more(held: Column, step: Column) -> Column:
        a, b = step["a"] * held["a"], step["a"] * held["b"] + step["b"]
        return F.struct(F.concat(held["done"], F.array(F.struct(step["at"].alias("at"), a.alias("a"), b.alias("b")))).alias("done"), a.alias("a"), b.alias("b"))

    return F.aggregate(steps, empty, more, lambda held: held["done"])


def scan(steps: DataFrame, key: str = "symbol", width: int = WIDTH) -> DataFrame:
    """key, at, v: the value behind each step of steps (key, at, a, b), from 0 before a key's first one.

    at is a whole number, different for each step of a key. A step whose a is 0 begins anew with its b, so a start is given by the first step.
    Steps without numbers are left out. An empty table gives an empty one.
    """
    held = steps.where("at is not null and a is not null and b is not null")
    low, high = held.agg(F.min("at"), F.max("at")).first()  # two numbers
    if low is None:
        return held.select(key, "at", F.col("b").alias("v"))
    return _scan(held.withColumn("at", F.col("at") - low), key, high - low + 1, width).withColumn("at", F.col("at") + low).select(key, "at", "v")


def _scan(steps: DataFrame, key: str, span: int, width: int) -> DataFrame:
    """key, at, v and before, the value ahead of the step."""
    blocks = steps.groupBy(key, F.floor(F.col("at") / width).alias("block"))
    blocks = blocks.agg(_folded(F.array_sort(F.collect_list(F.struct("at", "a", "b")))).alias("done"))  # width entries at most
    if span > width:
        last = F.element_at("done", -1)
        totals = blocks.select(F.col(key), F.col("block").alias("at"), last["a"].alias("a"), last["b"].alias("b"))
        starts = _scan(totals, key, -(-span // width), width).select(F.col(key).alias("_k"), F.col("at").alias("_b"), F.col("before").alias("start"))
        blocks = blocks.join(starts, F.col(key).eqNullSafe(F.col("_k")) & (F.col("block") == F.col("_b")))
    else:
        blocks = blocks.withColumn("start", F.lit(0.0))
    each = F.posexplode("done").alias("nth", "d")
    out = blocks.select(key, "start", "done", each)
    value = lambda d: d["a"] * F.col("start") + d["b"]
    before = F.when(F.col("nth") == 0, F.col("start")).otherwise(value(F.get("done", F.col("nth") - 1)))
    return out.select(key, F.col("d.at").alias("at"), value(F.col("d")).alias("v"), before.alias("before"))


def ewma_path(df: DataFrame, decay: float = 0.94, frequency: str = "D") -> DataFrame:
    """symbol, ts, vol, annualised: the exponentially weighted volatility at each return, the first of which gives its own square."""
    if not 0 < decay < 1:
        raise ValueError("the decay lies between 0 and 1")
    rows = df.where("r is not null")
    first = rows.groupBy("symbol").agg(F.min("ts").alias("first"))
    square, begins = F.col("r") * F.col("r"), F.col("ts") == F.col("first")
    steps = rows.join(first, "symbol").select("symbol", day().alias("at"), F.when(begins, 0.0).otherwise(decay).alias("a"), F.when(begins, square).otherwise((1 - decay) * square).alias("b"))
    vol = F.sqrt("v")
    return scan(steps).select("symbol", F.date_add(F.lit("1970-01-01").cast("date"), F.col("at").cast("int")).alias("ts"), vol.alias("vol"), (vol * math.sqrt(PERIODS[frequency])).alias("annualised"))


#: Fixed value: the squares ahead of a series weigh in its first 75 returns, each 0.94 of the one before.
BACKCAST, BACK_DECAY = 75, 0.94


def variance_path(df: DataFrame, fits: DataFrame) -> DataFrame:
    """symbol, ts, variance, std_residual under given models of first order: v = omega + (alpha + gamma [e' < 0]) e' ** 2 + beta v'.

    fits: symbol, mu, omega, alpha, gamma, beta, for returns as they are in df; symbols without one are left out. Ahead of a series
    stand its early squares, weighed; half of them count as falls.
    """
    rows = df.where("r is not null").join(fits, "symbol").withColumn("e", F.col("r") - F.col("mu"))
    order = in_time()
    means = rows.groupBy("symbol").agg(F.avg("r").alias("mean"))
    early = rows.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= BACKCAST).join(means, "symbol")
    weight, away = F.pow(F.lit(BACK_DECAY), F.col("nth") - 1), F.col("r") - F.col("mean")
    back = early.groupBy("symbol").agg((F.sum(weight * away * away) / F.sum(weight)).alias("back"))
    e1 = F.lag("e").over(order)
    rows = rows.withColumn("e1", e1).join(back, "symbol")
    begins = F.col("e1").isNull()
    arrived = F.col("omega") + (F.col("alpha") + F.col("gamma") * (F.col("e1") < 0).cast("double")) * F.col("e1") * F.col("e1")
    start = F.col("omega") + (F.col("alpha") + F.col("gamma") / 2 + F.col("beta")) * F.col("back")
    steps = rows.select("symbol", day().alias("at"), F.when(begins, 0.0).otherwise(F.col("beta")).alias("a"), F.when(begins, start).otherwise(arrived).alias("b"))
    found = scan(steps).select(F.col("symbol").alias("_s"), "at", F.col("v").alias("variance"))
    out = rows.select("symbol", "ts", "e").join(found, (F.col("symbol") == F.col("_s")) & (day() == F.col("at")))
    return out.select("symbol", "ts", "variance", (F.col("e") / F.sqrt("variance")).alias("std_residual"))

