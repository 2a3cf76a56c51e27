"""Price-like series from the supplied tables, and their calendar operations. Series are long: symbol, ts, value."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def levels(lineitem: DataFrame, symbol: str = "l_returnflag") -> DataFrame:
    """Daily revenue of each symbol: a positive level path."""
    revenue = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    return lineitem.groupBy(F.col(symbol).alias("symbol"), F.to_date("l_shipdate").alias("ts")).agg(F.sum(revenue).alias("value"))


def market(lineitem: DataFrame) -> DataFrame:
    return levels(lineitem.withColumn("m", F.lit("MKT")), "m")


def by_time(*more: str) -> Window:
    return Window.partitionBy("symbol", *more).orderBy("ts")


def returns(series: DataFrame, kind: str = "log") -> DataFrame:
    """symbol, ts, r: change against the observation before; gaps are bridged, the first is left out."""
    before = F.lag("value").over(by_time())
    r = F.log(F.col("value") / before) if kind == "log" else F.col("value") / before - 1
    return series.where("value is not null and not isnan(value)").select("symbol", "ts", r.alias("r")).where("r is not null")


def aligned(assets: DataFrame, reference: DataFrame, name: str = "m") -> DataFrame:
    """Each symbol's returns with the reference's on the dates that both have."""
    return assets.join(reference.select("ts", F.col("r").alias(name)), "ts")


def period_end(rule: str) -> Column:
    """The last day of the week (Sunday), month, quarter or year of ts."""
    ts = F.col("ts")
    ends = {
        "W": F.next_day(F.date_sub(ts, 1), "SUN"),
        "M": F.last_day(ts),
        "Q": F.last_day(F.add_months(F.trunc(ts, "quarter"), 2)),
        "A": F.last_day(F.add_months(F.trunc(ts, "year"), 11)),
    }
    return ends[rule].alias("period_end")


def resampled(series: DataFrame, rule: str) -> DataFrame:
    """Last value of each week (ending Sunday), month, quarter or year, labelled with the period's end."""
    return series.groupBy("symbol", period_end(rule)).agg(F.max_by("value", "ts").alias("value"), F.count("*").alias("n"))


def compounded(rates: DataFrame, rule: str) -> DataFrame:
    """Simple returns r of each period, compounded, labelled with the period's end."""
    return rates.where("r is not null").groupBy("symbol", period_end(rule)).agg((F.product(1 + F.col("r")) - 1).alias("r"), F.count("*").alias("n"))


def transformed(series: DataFrame, kind: str) -> DataFrame:
    """symbol, ts, value: none, log, diff, log_diff or cumsum of the values that are there; the log of what isn't positive is an error."""
    held = series.where("value is not null and not isnan(value)")
    x = F.when(F.col("value") > 0, F.log("value")).otherwise(F.raise_error(F.lit("the log of a value that isn't positive"))) if kind.startswith("log") else F.col("value")
    if kind.endswith("diff"):
        x = x - F.lag(x).over(by_time())
    elif kind == "cumsum":
        x = F.sum("value").over(by_time().rowsBetween(Window.unboundedPreceding, 0))
    elif kind not in ("none", "log"):
        raise ValueError(f"unknown transform {kind!r}")
    out = held.select("symbol", "ts", x.alias("value"))
    return out.where("value is not null") if kind.endswith("diff") else out


def as_of(left: DataFrame, right: DataFrame, value: str, by: str | None) -> DataFrame:
    """left with the last `value` of right at or before ts; rows before the first get the first (back-fill).

    A union and a running last value stand for the join, so nothing is compared pairwise. Without `by`, right holds for every row of left: its
    values are found for the dates that left has, and joined by date.
    """
    if by is None:
        calendar = as_of(left.select("ts").distinct().withColumn("_all", F.lit(0)), right.withColumn("_all", F.lit(0)), value, "_all")
        return left.join(calendar.drop("_all"), "ts")
    keys = [by]
    both = left.withColumns({"_own": F.lit(True), value: F.lit(None).cast("double")}).unionByName(
        right.select(*keys, "ts", F.col(value).cast("double").alias(value)).withColumn("_own", F.lit(False)), allowMissingColumns=True
    )
    span = Window.partitionBy(*keys).orderBy("ts", F.col("_own"))
    after = Window.partitionBy(*keys).orderBy("ts", F.col("_own")).rowsBetween(0, Window.unboundedFollowing)
    filled = F.coalesce(F.last(value, ignorenulls=True).over(span), F.first(value, ignorenulls=True).over(after))
    return both.withColumn("_v", filled).where("_own").drop(value, "_own").withColumnRenamed("_v", value)


def outer_aligned(series: DataFrame, names: list[str], column: str = "value") -> DataFrame:
    """ts and a column for each name on every date that any of them has; null where one has none."""
    return series.where(F.col("symbol").isin(names)).groupBy("ts").pivot("symbol", names).agg(F.first(column))


def excess(rates: DataFrame, risk_free: str) -> DataFrame:
    """Returns less the risk-free rate of the date; dates without one are left out."""
    return rates.select("symbol", "ts", (F.col("r") - F.col(risk_free)).alias("r")).where("r is not null")


#: Published rate series, all in per cent a year.
RATES = "DGS1MO DGS3MO DGS6MO DGS1 DGS2 DGS5 DGS10 DGS30 DTB4WK DTB3 DTB6 DTB1YR TB3MS DFF FEDFUNDS EFFR SOFR".split()


def period_rate(published: Column, series: str, periods: int) -> Column:
    """A rate published in per cent a year as a decimal return of one of so many periods in a year."""
    if series not in RATES:
        raise ValueError(f"no convention is declared for {series!r}; known: {', '.join(RATES)}")
    return F.pow(1 + published / 100, F.lit(1.0 / periods)) - 1


def iso_date(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd")


def unpivoted(wide: DataFrame, date: str, columns: list[str]) -> DataFrame:
    return wide.unpivot([date], columns, "symbol", "value").where("value is not null")


def quality(series: DataFrame) -> DataFrame:
    """One row a symbol: observations, span, longest gap in days, share of the common calendar, and flags."""
    gap = F.datediff("ts", F.lag("ts").over(by_time()))
    each = series.withColumn("gap", gap).groupBy("symbol").agg(
        F.count("*").alias("n"), F.min("ts").alias("first"), F.max("ts").alias("last"), F.max("gap").alias("longest_gap"),
        F.count_if(F.col("value") <= 0).alias("not_positive"),
    )
    dates = series.groupBy("ts").agg(F.count("*").alias("have"))
    whole = dates.crossJoin(F.broadcast(each.agg(F.count("*").alias("symbols"), F.min("first").alias("start"))))
    whole = whole.agg(F.count("*").alias("calendar"), F.count_if(F.col("have") == F.col("symbols")).alias("common"), F.first("start").alias("start"))
    out = each.crossJoin(F.broadcast(whole))
    return out.select(
        "symbol", "n", "first", "last", "longest_gap", "not_positive", (F.col("calendar") - F.col("common")).alias("dropped"),
        (F.col("n") < 30).alias("short_sample"), (F.datediff("first", "start") > 30).alias("late_start"),
        (F.col("common") < F.col("calendar")).alias("calendar_misalignment"),
    )


#: The report's thresholds.
LEAST_ROWS, LATE_DAYS, COVERED = 30, 30, 0.9


def steward_flags(series: DataFrame, start: str, end: str, sources: DataFrame | None = None, factors: DataFrame | None = None, risk_free: str | None = None) -> DataFrame:
    """code, severity, symbol (null for the whole frame): what a reader of the aligned series must know.

    Rows after `end` count as looking ahead. sources: symbol, source. factors: ts and factor columns, of which `rf` is a rate of
    their own, mixed with one that is asked for by name.
    """
    window = F.col("ts").between(F.lit(start).cast("date"), F.lit(end).cast("date"))
    each = series.where("value is not null").groupBy("symbol").agg(F.max("ts").alias("last"), F.min(F.when(window, F.col("ts"))).alias("first"))
    flag = lambda df, code, severity, symbol=None: df.select(F.lit(code).alias("code"), F.lit(severity).alias("severity"), (F.col(symbol) if symbol else F.lit(None)).cast("string").alias("symbol"))
    out = flag(each.where(F.col("last") > F.lit(end).cast("date")), "look_ahead", "risk", "symbol")
    out = out.union(flag(each.where(F.datediff("first", F.lit(start).cast("date")) > LATE_DAYS), "late_start", "risk", "symbol"))
    held = series.where(window & F.col("value").isNotNull())
    dates = held.groupBy("ts").agg(F.countDistinct("symbol").alias("have"))
    several = each.where("first is not null").count()  # symbols: one number
    common = dates.agg(F.count("*").alias("calendar"), F.count_if(F.col("have") == several).alias("common"))
    out = out.union(flag(common.where("common < calendar"), "calendar_misalignment", "warning")).union(flag(common.where(F.col("common") < LEAST_ROWS), "short_sample", "warning"))
    if sources is not None:
        named = sources.agg(F.countDistinct("source").alias("n"), F.count_if(F.lower("source").contains("synthetic")).alias("made"))
        out = out.union(flag(named.where("made > 0"), "synthetic_data", "risk")).union(flag(named.where("n > 1"), "mixed_sources", "info"))
    if factors is not None:
        covered = dates.where(F.col("have") == several).join(factors.na.drop().select("ts").distinct().withColumn("f", F.lit(1)), "ts", "left")
        out = out.union(flag(covered.agg(F.avg(F.col("f").isNotNull().cast("double")).alias("share")).where(F.col("share") < COVERED), "factor_coverage", "warning"))
        if risk_free and "rf" in factors.columns:
            out = out.union(flag(factors.limit(1), "mixed_risk_free", "warning"))
    return out
