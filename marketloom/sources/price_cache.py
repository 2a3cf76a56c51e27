"""A cache of prices by the window that was asked for: a manifest of entries, and which of them serves a request.

manifest: entry, symbol, low, high (dates, both included), fetched_at. An entry serves a request if its window holds the request's and
it isn't older than allowed; what is older is never served, as published prices change. Windows are compared in order, by running
maxima, never pairwise.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

MANIFEST = "entry string, symbol string, low date, high date, fetched_at timestamp"
DAY = 86_400


def _fresh(now, max_age: int):
    return F.unix_timestamp("fetched_at") >= F.unix_timestamp(F.lit(now).cast("timestamp")) - max_age


def coverage(requests: DataFrame, manifest: DataFrame, now: str, max_age: int = DAY) -> DataFrame:
    """requests (symbol, low, high) with verdict and entry: hit and the entry that serves it, stale where only older ones hold the window, else missing.

    Of entries that serve a request the one that reaches farthest is taken, then the newest, then by name. A request that ends before it begins is an error.
    """
    right = F.when(F.col("high") >= F.col("low"), F.col("low")).otherwise(F.raise_error(F.lit("a window ends before it begins")).cast("date"))
    asked = requests.select("symbol", right.alias("low"), "high", F.lit(1).alias("kind"))
    held = manifest.select("symbol", "low", "high", F.lit(0).alias("kind"), _fresh(now, max_age).alias("fresh"), F.struct("high", "fetched_at", "entry").alias("reach"))
    both = held.unionByName(asked, allowMissingColumns=True)
    upto = Window.partitionBy("symbol").orderBy("low", "kind").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    both = both.withColumns({"best": F.max(F.when(F.col("fresh"), F.col("reach"))).over(upto), "any": F.max(F.col("reach")["high"]).over(upto)})
    hit, old = F.col("best.high") >= F.col("high"), F.col("any") >= F.col("high")
    verdict = F.when(hit, "hit").when(old, "stale").otherwise("missing")
    return both.where("kind = 1").select("symbol", "low", "high", verdict.alias("verdict"), F.when(hit, F.col("best.entry")).alias("entry"))


def islands(manifest: DataFrame, now: str, max_age: int = DAY) -> DataFrame:
    """symbol, low, high: the fresh windows of each symbol, run together where they overlap or touch."""
    order = Window.partitionBy("symbol").orderBy("low", "high")
    rows = manifest.where(_fresh(now, max_age)).select("symbol", "low", "high")
    rows = rows.withColumn("before", F.max("high").over(order.rowsBetween(Window.unboundedPreceding, -1)))
    new = F.coalesce(F.col("low") > F.date_add("before", 1), F.lit(True))
    rows = rows.withColumn("island", F.sum(new.cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.groupBy("symbol", "island").agg(F.min("low").alias("low"), F.max("high").alias("high")).drop("island")


def gaps(requests: DataFrame, manifest: DataFrame, now: str, max_age: int = DAY) -> DataFrame:
    """symbol, low, high, gap_low, gap_high: the parts of each request that no fresh window holds. Requests count once each."""
    asked = requests.select("symbol", "low", "high").distinct()
    held = islands(manifest, now, max_age).select(F.col("symbol").alias("_s"), F.col("low").alias("_l"), F.col("high").alias("_h"))
    # islands are apart, so a request meets no more of them than its gaps and one
    met = asked.join(held, (F.col("symbol") == F.col("_s")) & (F.col("_l") <= F.col("high")) & (F.col("_h") >= F.col("low")), "left")
    order = Window.partitionBy("symbol", "low", "high").orderBy("_l")
    begins = F.coalesce(F.date_add(F.lag("_h").over(order), 1), F.col("low"))
    between = met.select("symbol", "low", "high", begins.alias("gap_low"), F.coalesce(F.date_sub("_l", 1), F.col("high")).alias("gap_high"))
    last = met.groupBy("symbol", "low", "high").agg(F.date_add(F.max("_h"), 1).alias("gap_low")).where("gap_low is not null").select("symbol", "low", "high", "gap_low", F.col("high").alias("gap_high"))
    return between.unionByName(last).where("gap_low <= gap_high")


def served(requests: DataFrame, manifest: DataFrame, prices: DataFrame, now: str, max_age: int = DAY) -> DataFrame:
    """symbol, low, high, ts, value: the prices (entry, symbol, ts, value) of the requests that are hits."""
    hits = coverage(requests, manifest, now, max_age).where("verdict = 'hit'").select("entry", "low", "high")
    rows = prices.join(hits, "entry").where(F.col("ts").between(F.col("low"), F.col("high")))
    return rows.select("symbol", "low", "high", "ts", "value")


class PriceCache:
    """A cache in a folder: prices by entry, and the manifest, to which an entry is added once its prices are written."""

    def __init__(self, spark: SparkSession, root: str, max_age: int = DAY):
        self.spark, self.root, self.max_age = spark, root.rstrip("/"), max_age

    def manifest(self) -> DataFrame:
        return self._read("manifest", MANIFEST)

    def entries(self) -> DataFrame:
        return self._read("prices", "symbol string, ts date, value double, entry string")

    def _read(self, what: str, schema: str) -> DataFrame:
        jvm, place = self.spark.sparkContext._jvm, f"{self.root}/{what}"
        where = jvm.org.apache.hadoop.fs.Path(place)
        if not where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(where):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(place)

    def prices(self, requests: DataFrame, fetch: Callable[[DataFrame], DataFrame], now: str) -> DataFrame:
        """symbol, low, high, ts, value of all requests. What isn't served is fetched (symbol, low, high in; symbol, ts, value out) and kept.

        Where a fetch fails, the error says whether an old copy is there, which isn't served all the same. Prices without a row in the manifest,
        which a failed write leaves, are never read.
        """
        verdicts = coverage(requests, self.manifest(), now, self.max_age)
        wanted = verdicts.where("verdict <> 'hit'").select("symbol", "low", "high").distinct()
        if not wanted.isEmpty():
            batch = uuid.uuid4().hex
            entry = F.concat_ws("_", F.lit(batch), F.col("symbol"), F.col("low").cast("string"), F.col("high").cast("string"))
            named = wanted.withColumn("entry", entry)
            try:
                found = fetch(wanted).join(named.select("entry", F.col("symbol"), F.col("low"), F.col("high")), "symbol").where(F.col("ts").between(F.col("low"), F.col("high")))
                found.select("symbol", "ts", "value", "entry").write.mode("append").partitionBy("entry").parquet(f"{self.root}/prices")
            except Exception as error:
                old = not verdicts.where("verdict = 'stale'").isEmpty()
                raise RuntimeError(f"prices can't be fetched ({error}), and " + ("the copies that are kept are too old to serve" if old else "nothing is kept for these windows")) from error
            named.select("entry", "symbol", "low", "high", F.lit(now).cast("timestamp").alias("fetched_at")).write.mode("append").parquet(f"{self.root}/manifest")
        return served(requests.distinct(), self.manifest(), self.entries(), now, self.max_age)
