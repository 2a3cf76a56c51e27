"""Metrics over events as spans, and retrieval over embeddings."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Query vectors in a block and vectors in a chunk: what a task holds at once. Up to BROADCAST blocks are broadcast.
BLOCK, BROADCAST = 1_024, 16


def percentiles(df: DataFrame, key: str, value: str, at: dict[str, float]) -> DataFrame:
    """key and, by name, exact interpolated percentiles of value, without gathering a key's values in one task.

    Equal values are counted first. The different ones are dealt in ranges; each range's total, summed up over the ranges before, says
    which ranks it holds, so a task orders the values of its range alone and all percentiles come out of one pass.
    """
    v = F.col(value).cast("double")
    counted = df.where(v.isNotNull()).groupBy(key, v.alias("v")).agg(F.count("*").alias("c"))
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = counted.repartitionByRange(tasks, key, "v").withColumn("part", F.spark_partition_id())
    before = Window.partitionBy("_k").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    totals = ranged.groupBy(F.col(key).alias("_k"), F.col("part").alias("_part")).agg(F.sum("c").alias("held"))
    totals = totals.select("_k", "_part", F.coalesce(F.sum("held").over(before), F.lit(0)).alias("ahead"), F.sum("held").over(Window.partitionBy("_k")).alias("n"))
    rows = ranged.join(totals, F.col(key).eqNullSafe(F.col("_k")) & (F.col("part") == F.col("_part")))
    upto = Window.partitionBy(key, "part").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("upto", F.col("ahead") + F.sum("c").over(upto))
    holds = lambda k: (F.col("upto") - F.col("c") <= k) & (k < F.col("upto"))
    ends = []
    for name, p in at.items():
        place = F.lit(p) * (F.col("n") - 1)
        ends += [F.max(F.when(holds(F.floor(place)), F.col("v"))).alias(f"low_{name}"), F.max(F.when(holds(F.ceil(place)), F.col("v"))).alias(f"high_{name}"), F.max(place - F.floor(place)).alias(f"part_{name}")]
    out = rows.groupBy(key).agg(*ends)
    return out.select(key, *[(F.col(f"low_{n}") + (F.col(f"high_{n}") - F.col(f"low_{n}")) * F.col(f"part_{n}")).alias(n) for n in at])


def latency(spans: DataFrame, key: str, duration: str, failed: Column) -> DataFrame:
    """Count, exact percentiles and share of failures of each kind of span."""
    s = spans.groupBy(F.col(key).alias("_kind")).agg(F.count("*").alias("n"), F.avg(F.coalesce(failed, F.lit(False)).cast("double")).alias("failure_rate"))
    p = percentiles(spans, key, duration, {"p50": 0.5, "p95": 0.95, "p99": 0.99})
    return s.join(p, F.col("_kind").eqNullSafe(F.col(key)), "left").select(F.col("_kind").alias(key), "n", "p50", "p95", "p99", "failure_rate")


def token_totals(steps: DataFrame, columns: list[str]) -> DataFrame:
    """One row: the sum of each column, 0 where there is none."""
    return steps.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in columns])


def tokens_by(steps: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """key and the sum of each column, 0 where there is none; rows without a key are left out."""
    return steps.where(F.col(key).isNotNull()).groupBy(key).agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in columns])


def rate(steps: DataFrame, population: Column, failure: Column, name: str) -> DataFrame:
    """One row: the share of the population that fails, null where there is no population."""
    return steps.where(population).agg(F.count("*").alias("population"), F.avg(F.coalesce(failure, F.lit(False)).cast("double")).alias(name))


def nearest(vectors: DataFrame, query: Column, k: int, id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """The k vectors with the least cosine distance to a constant one; ties by id. A top-k, so no full sort."""
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)
    v = F.col(vector)
    distance = 1 - dot(v, query) / F.sqrt(dot(v, v) * dot(query, query))
    return vectors.select(id_col, distance.alias("distance")).orderBy("distance", id_col).limit(k)


def nearest_each(vectors: DataFrame, queries: DataFrame, k: int, id_col: str = "vec_id", vector: str = "embedding", digits: int = 9) -> DataFrame:
    """query_id, vec_id, distance: the k vectors with the least cosine distance to each query; ties by id.

    Distances count as equal if they are so to `digits` digits. Every query is scored against every vector, a block
    of queries and a chunk of vectors at a time; each pair of them sends on the k nearest of each query. Null vectors
    are left out. A distance to or from a vector of zeros is null and comes last. Repeated vectors count each;
    queries have an id each. An empty table gives an empty one.
    """
    def packed(df: DataFrame) -> DataFrame:
        def pack(batches):
            for pdf in batches:
                for at in range(0, len(pdf), BLOCK):
                    part = pdf.iloc[at : at + BLOCK]
                    x = np.stack(part["v"].to_list()).astype(np.float64)
                    with np.errstate(all="ignore"):
                        x = x / np.sqrt((x * x).sum(1, keepdims=True))
                    yield pd.DataFrame({"ids": [part["i"].to_numpy().tobytes()], "m": [x.tobytes()]})

        rows = df.where(F.col(id_col).isNotNull() & F.col(vector).isNotNull()).select(F.col(id_col).cast("long").alias("i"), F.col(vector).cast("array<double>").alias("v"))
        return rows.mapInPandas(pack, "ids binary, m binary")

    def score(batches):
        for pdf in batches:
            for ids, m, qids, qm in pdf[["ids", "m", "qids", "qm"]].itertuples(index=False):
                i, q = np.frombuffer(ids, np.int64), np.frombuffer(qids, np.int64)
                x, y = np.frombuffer(m).reshape(len(i), -1), np.frombuffer(qm).reshape(len(q), -1)
                far = 1 - y @ x.T
                order = np.round(far, digits) + 0.0
                top, out = min(k, len(i)), []
                for row in range(len(q)):
                    bound = np.partition(order[row], top - 1)[top - 1]  # NaN sorts last
                    near = np.flatnonzero(~(order[row] > bound)) if bound == bound else np.arange(len(i))
                    near = near[np.lexsort((i[near], order[row][near]))[:top]]
                    out.append((np.full(top, q[row]), i[near], order[row][near]))
                found = pd.DataFrame(dict(zip(("query_id", "vec_id", "distance"), map(np.concatenate, zip(*out, strict=True)), strict=True)))
                yield found.assign(distance=found["distance"].astype("Float64"))

    n = queries.count()
    blocks = packed(queries.repartition(max(1, -(-n // BLOCK)))).select(F.col("ids").alias("qids"), F.col("m").alias("qm"))
    pairs = packed(vectors).crossJoin(F.broadcast(blocks) if n <= BROADCAST * BLOCK else blocks)
    found = pairs.mapInPandas(score, "query_id long, vec_id long, distance double")
    place = Window.partitionBy("query_id").orderBy(F.col("distance").asc_nulls_last(), "vec_id")
    return found.withColumn("nth", F.row_number().over(place)).where(F.col("nth") <= k).drop("nth")
