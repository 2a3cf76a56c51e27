"""Event studies: abnormal returns around dates, in positions of each symbol's calendar."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.distributions import normal_p, t_p


def event_study(df: DataFrame, events: DataFrame, estimation: int = 250, gap: int = 10, before: int = 10, after: int = 10, market: str = "m") -> DataFrame:
    """(symbol, event, n, car, std_error, t_stat, p_value, passed) for events (symbol, event); passed: no effect is rejected at 5 %.

    Events on no date of the series, or too near its start for an estimation window, are left out. An event window
    is cut at the end of the series. unusable_events() says which are left out, and why.
    """
    window = _abnormal(df, events, estimation, gap, before, after, market)
    out = window.groupBy("symbol", "event", "mse").agg(F.count("*").alias("n"), F.sum("abnormal").alias("car"))
    se = F.sqrt(F.col("n") * F.col("mse"))
    out = out.select("symbol", "event", "n", "car", se.alias("std_error"), (F.col("car") / se).alias("t_stat"))
    out = out.withColumn("p_value", t_p(F.col("t_stat"), F.lit(estimation - 2)))
    return out.withColumn("passed", F.col("p_value") < 0.05)


def _placed(df: DataFrame, market: str) -> DataFrame:
    return df.na.drop(subset=["r", market]).withColumn("pos", F.row_number().over(Window.partitionBy("symbol").orderBy("ts")))


def unusable_events(df: DataFrame, events: DataFrame, estimation: int = 250, gap: int = 10, market: str = "m") -> DataFrame:
    """(symbol, event, reason): events on no date of the series, named twice, or without a whole estimation window before them."""
    at = _placed(df, market).select("symbol", F.col("ts").alias("event"), F.col("pos").alias("at"))
    named = events.groupBy("symbol", "event").agg(F.count("*").alias("times")).join(at, ["symbol", "event"], "left")
    reason = F.when(F.col("at").isNull(), "no such date").when(F.col("at") <= gap + estimation, "too early").when(F.col("times") > 1, "named twice")
    return named.select("symbol", "event", reason.alias("reason")).where("reason is not null")


def _abnormal(df: DataFrame, events: DataFrame, estimation: int, gap: int, before: int, after: int, market: str) -> DataFrame:
    """symbol, event, day (relative), abnormal, mse: the rows of the event windows."""
    rows = _placed(df, market)
    at = events.distinct().join(rows.select("symbol", F.col("ts").alias("event"), F.col("pos").alias("at")), ["symbol", "event"]).where(F.col("at") > gap + estimation)
    # a row meets an event by symbol and by coarse position, so that no event meets a whole series
    size = estimation + gap + before + after + 1
    coarse = rows.withColumn("cell", F.floor(F.col("pos") / size))
    cells = at.withColumn("cell", F.explode(F.sequence(F.floor((F.col("at") - gap - estimation) / size), F.floor((F.col("at") + after) / size))))
    met = coarse.join(cells, ["symbol", "cell"])
    y, x = F.col("r"), F.col(market)
    inside = met.where(F.col("pos").between(F.col("at") - gap - estimation, F.col("at") - gap - 1))
    fit = inside.groupBy("symbol", "event").agg(
        F.regr_slope(y, x).alias("b"), F.regr_intercept(y, x).alias("a"), ((F.regr_syy(y, x) - F.regr_sxy(y, x) * F.regr_sxy(y, x) / F.regr_sxx(y, x)) / (estimation - 2)).alias("mse")
    )
    window = met.where(F.col("pos").between(F.col("at") - before, F.col("at") + after)).join(fit, ["symbol", "event"])
    return window.select("symbol", "event", (F.col("pos") - F.col("at")).alias("day"), (y - F.col("a") - F.col("b") * x).alias("abnormal"), "mse")


def average_effect(studied: DataFrame) -> DataFrame:
    """symbol, events, caar, std_error, z_stat, p_value (normal, variances added up) and the cross-sectional t and p of event_study()."""
    s = studied.groupBy("symbol").agg(F.count("*").alias("events"), F.avg("car").alias("caar"), (F.sqrt(F.sum(F.col("std_error") * F.col("std_error"))) / F.count("*")).alias("std_error"), F.stddev_samp("car").alias("sd"))
    s = s.withColumn("z_stat", F.col("caar") / F.col("std_error")).withColumn("p_value", normal_p(F.col("z_stat")))
    s = s.withColumn("cross_t", F.try_divide(F.col("caar"), F.col("sd") / F.sqrt("events"))).withColumn("cross_p", t_p(F.col("cross_t"), F.col("events") - 1))
    return s.drop("sd")


def average_path(df: DataFrame, events: DataFrame, estimation: int = 250, gap: int = 10, before: int = 10, after: int = 10, market: str = "m") -> DataFrame:
    """symbol, day, events, caar: the mean cumulative abnormal return up to each relative day, over the events that reach it."""
    along = Window.partitionBy("symbol", "event").orderBy("day")
    rows = _abnormal(df, events, estimation, gap, before, after, market).withColumn("car", F.sum("abnormal").over(along))
    return rows.groupBy("symbol", "day").agg(F.count("*").alias("events"), F.avg("car").alias("caar"))
