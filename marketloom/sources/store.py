"""The store of observations: dataset_id, ts, symbol, field, value; appended to, replaced and read as series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KEY = ["dataset_id", "ts", "symbol", "field"]
#: Which field is served where a symbol has several, best first.
PREFERENCE = ["price", "return", "factor", "volume"]


def in_range(rows: DataFrame, start: str, end: str, ts: str = "ts") -> DataFrame:
    """Rows from start to end, both included; the bounds reach the scan."""
    if end <= start:
        raise ValueError(f"the window {start}..{end} is empty")
    return rows.where(F.col(ts).between(F.lit(start).cast("date"), F.lit(end).cast("date")))


def last_written(rows: DataFrame, key: list[str], *order: str) -> DataFrame:
    """The last row of each key in that order; pre-aggregated, so that no key's rows meet in one task."""
    newest = rows.groupBy(*key).agg(F.max_by(F.struct(*rows.columns), F.struct(*order)).alias("row"))
    return newest.select("row.*")


def preferred(rows: DataFrame) -> DataFrame:
    """Of each symbol the rows of the best field it has."""
    rank = F.array_position(F.array(*map(F.lit, PREFERENCE)), F.col("field"))
    best = rows.where(rank > 0).groupBy("symbol").agg(F.min(rank).alias("rank"))
    return rows.withColumn("rank", rank).join(best, ["symbol", "rank"], "left_semi").drop("rank")


def replaced(stored: DataFrame, incoming: DataFrame, by: str = "dataset_id") -> DataFrame:
    """stored with every dataset that incoming brings taken out and put in anew."""
    return stored.join(incoming.select(by).distinct(), by, "left_anti").unionByName(incoming)


def appended(stored: DataFrame, incoming: DataFrame, key: list[str]) -> DataFrame:
    """stored and the rows of incoming whose key it doesn't have yet; doing it again changes nothing."""
    return stored.unionByName(incoming.dropDuplicates(key).join(stored, key, "left_anti").select(*stored.columns))


def with_any(rows: DataFrame, other: DataFrame, on: str | Column) -> DataFrame:
    """Rows for which other has one."""
    return rows.join(other, on, "left_semi")


def overlaid(market: DataFrame, uploaded: DataFrame) -> DataFrame:
    """symbol, ts, value, provenance: a symbol that was uploaded is served from the upload alone, all others by the market."""
    rest = market.join(uploaded.select("symbol").distinct(), "symbol", "left_anti")
    own = uploaded.select("symbol", "ts", "value", F.lit("uploaded").alias("provenance"))
    return own.unionByName(rest.select("symbol", "ts", "value", F.lit("market").alias("provenance")))


def roots(rows: DataFrame, id_col: str, parent: str) -> DataFrame:
    """id, root, depth of a forest given by parents: pointers are doubled, so a chain of n takes log2(n) joins. Orphans are roots."""
    known = rows.select(F.col(id_col).alias("p"))
    at = rows.join(known, F.col(parent) == F.col("p"), "left").select(F.col(id_col).alias("id"), F.coalesce("p", id_col).alias("root"), F.when(F.col("p").isNull(), 0).otherwise(1).alias("depth"))
    deepest = -1
    while True:
        far = at.agg(F.max("depth")).first()[0]  # one number
        if far is None or far == deepest:
            return at
        deepest = far
        up = at.select(F.col("id").alias("root"), F.col("root").alias("above"), F.col("depth").alias("more"))
        at = at.join(up, "root").select("id", F.col("above").alias("root"), (F.col("depth") + F.col("more")).alias("depth"))


def fingerprint(rows: DataFrame, columns: list[str], by: list[str]) -> DataFrame:
    """by, n, digest: the same rows give the same digest in any order, any change another one. Sums of hashes, so nothing is gathered."""
    line = F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("null")) for c in columns])
    part = F.conv(F.substring(F.md5(line), 1, 12), 16, 10).cast("decimal(38,0)")
    sums = rows.groupBy(*by).agg(F.count("*").alias("n"), F.sum(part).alias("sum"))
    return sums.select(*by, "n", F.sha2(F.concat_ws("|", F.col("n").cast("string"), F.col("sum").cast("string")), 256).alias("digest"))


def reproduced(before: DataFrame, after: DataFrame, key: list[str]) -> DataFrame:
    """key, reproduced, detail: whether a result's numbers are exactly those of an earlier run."""
    names = [c for c in after.columns if c not in key]
    a, b = before.select(*key, F.struct(*names).alias("was")), after.select(*key, F.struct(*names).alias("now"))
    same = F.col("was").eqNullSafe(F.col("now"))
    detail = F.when(F.col("was").isNull(), "not in the earlier run").when(F.col("now").isNull(), "missing now").when(~same, "the numbers differ").otherwise("")
    return a.join(b, key, "full").select(*key, (same & F.col("was").isNotNull()).alias("reproduced"), detail.alias("detail"))


def write_observations(rows: DataFrame, path: str) -> None:
    """Datasets are partitions; those in rows replace their own and leave the others."""
    rows.write.partitionBy("dataset_id").option("partitionOverwriteMode", "dynamic").mode("overwrite").parquet(path)


def long_form(rows: DataFrame, step: str, tool: str, series: list[str], x: Column) -> DataFrame:
    """step_id, tool, series, x, y: results as they are exported."""
    each = F.explode(F.array(*[F.struct(F.lit(s).alias("series"), F.col(s).cast("double").alias("y")) for s in series]))
    return rows.select(F.lit(step).alias("step_id"), F.lit(tool).alias("tool"), x.alias("x"), each.alias("e")).select("step_id", "tool", "e.series", "x", "e.y")


def write_csv(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").option("header", True).csv(path)
