"""One typed table for the results of all tools: what a chart, an export or a reader needs to know of a number.

A row is a number: step, tool, kind (scalar, series, table, estimate), key (its name), nth (the key's place in the result), part
(the column of a table), x (where a series or a table's row stands, as a string), y (the number), low and high (its interval).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KINDS = ("scalar", "series", "table", "estimate")
SCHEMA = "step string, tool string, kind string, key string, nth int, part string, x string, y double, low double, high double"
NAMES = [c.split()[0] for c in SCHEMA.split(", ")]


def _rows(df: DataFrame, step: Column, tool: str, kind: str, each: list[Column]) -> DataFrame:
    rows = df.select(step.cast("string").alias("step"), F.explode(F.array(*each)).alias("e"))
    return rows.select("step", F.lit(tool).alias("tool"), F.lit(kind).alias("kind"), "e.*").select(*NAMES)


def _cell(key: Column | str, nth: int, y: Column, part: Column | None = None, x: Column | None = None, low: Column | None = None, high: Column | None = None) -> Column:
    nothing = F.lit(None)
    named = {"key": F.lit(key) if isinstance(key, str) else key, "nth": F.lit(nth), "part": (nothing if part is None else part).cast("string"), "x": (nothing if x is None else x).cast("string")}
    numbers = {"y": y, "low": nothing if low is None else low, "high": nothing if high is None else high}
    return F.struct(*[v.alias(k) for k, v in named.items()], *[v.cast("double").alias(k) for k, v in numbers.items()])


def scalars(df: DataFrame, step: Column, tool: str, names: list[str], first: int = 0) -> DataFrame:
    """A row for each name and row of df; nulls are left out."""
    return _rows(df, step, tool, "scalar", [_cell(n, first + i, F.col(n)) for i, n in enumerate(names)]).where("y is not null")


def series(df: DataFrame, step: Column, tool: str, x: Column, named: dict[str, Column], first: int = 0) -> DataFrame:
    """A point for each name and row of df; a null stays a point without a number."""
    return _rows(df, step, tool, "series", [_cell(n, first + i, v, x=x) for i, (n, v) in enumerate(named.items())])


def keyed_series(df: DataFrame, step: Column, tool: str, key: Column, nth: Column, x: Column, y: Column) -> DataFrame:
    """The same for series in long form, with the name in a column."""
    return series(df, step, tool, x, {"": y}).limit(0).union(
        df.select(step.cast("string"), F.lit(tool), F.lit("series"), key.cast("string"), nth.cast("int"), F.lit(None).cast("string"), x.cast("string"), y.cast("double"), F.lit(None).cast("double"), F.lit(None).cast("double"))
    )


def estimates(df: DataFrame, step: Column, tool: str, name: Column, y: Column, low: Column | None = None, high: Column | None = None, nth: int = 0) -> DataFrame:
    return _rows(df, step, tool, "estimate", [_cell(name, nth, y, low=low, high=high)])


def table(df: DataFrame, step: Column, tool: str, name: str, row: Column, columns: list[str], nth: int = 0) -> DataFrame:
    return _rows(df, step, tool, "table", [_cell(name, nth, F.col(c), part=F.lit(c), x=row) for c in columns])


def together(*parts: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def shape(results: DataFrame) -> DataFrame:
    """step, tool, kind, key, nth, points, intervals: what a result has, without its numbers; a row for each key."""
    each = results.groupBy("step", "tool", "kind", "key")
    return each.agg(F.min("nth").alias("nth"), F.count("*").alias("points"), F.count("low").alias("intervals"))
