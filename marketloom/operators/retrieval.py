"""Exact nearest neighbours within a scope, by clusters and the triangle inequality: what can't hold a neighbour isn't read.

Vectors are brought to length 1, where the square of their distance is twice their cosine distance. Centres are chosen from a bounded
sample; every vector belongs to its nearest. A scope (a project and a model, say) keeps for each of its clusters how many vectors it holds
and how far they are from the centre at least and at most. For a query, clusters in the order of what is surely reached give a bound within
which k vectors lie; clusters that begin beyond it are skipped. Bounds decide what is read, never what is found.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources import scratch

#: Vectors that centres are chosen from, centres, vectors and queries in a block.
SAMPLE, CENTRES, BLOCK, ASKED = 2_048, 64, 1_024, 256
SLACK = 1e-7


def centres(sample: np.ndarray) -> np.ndarray:
    """Up to CENTRES of the sample's vectors, each the farthest from those before."""
    if not len(sample):
        return np.zeros((1, sample.shape[1]))
    chosen, far = [0], 1 - sample @ sample[0]
    while len(chosen) < CENTRES and far.max() > 1e-12:
        chosen.append(int(far.argmax()))
        far = np.minimum(far, 1 - sample @ sample[chosen[-1]])
    return sample[chosen]


def _unit(column: pa.Array, dim: int) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
    return flat / np.sqrt((flat * flat).sum(1, keepdims=True))


def _stored(df: DataFrame, name: str) -> DataFrame:
    path = scratch.folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _width(df: DataFrame, vector: str) -> int:
    return df.agg(F.max(F.size(vector))).first()[0] or 0  # a number


def _usable(df: DataFrame, scope: list[str], id_col: str, vector: str, dim: int) -> DataFrame:
    """scope, id, v: shorter vectors are filled with zeros."""
    v = F.col(vector)
    length = F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    whole = v.isNotNull() & F.col(id_col).isNotNull() & ~F.exists(v, lambda x: x.isNull() | F.isnan(x)) & (length > 0) & (length < float("inf"))
    key = F.struct(*[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in scope]) if scope else F.lit("")
    return df.where(whole).select(F.to_json(key).alias("scope") if scope else key.alias("scope"), F.col(id_col).cast("long").alias("id"), F.concat(v.cast("array<double>"), F.array_repeat(F.lit(0.0), F.lit(dim) - F.size(v))).alias("v"))


def clustered(vectors: DataFrame, scope: list[str], dim: int, id_col: str = "vec_id", vector: str = "embedding") -> tuple[DataFrame, np.ndarray]:
    """scope, id, v, cluster, away (from the centre) of every vector, and the centres, which are bounded in number."""
    rows = _usable(vectors, scope, id_col, vector, dim)
    picked = rows.orderBy(F.xxhash64("id", "scope")).limit(SAMPLE).select("v").toArrow().column(0).combine_chunks()
    made = centres(_unit(picked, dim) if len(picked) else np.empty((0, dim)))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _unit(batch.column("v"), dim)
            far = np.sqrt(np.maximum(2 - 2 * (x @ made.T), 0.0))
            nearest = far.argmin(1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(nearest.astype(np.int32)), pa.array(far[np.arange(len(x)), nearest])], names=[*batch.schema.names, "cluster", "away"])

    return _stored(rows.mapInArrow(place, "scope string, id long, v array<double>, cluster int, away double"), "clusters"), made


def visits(held: DataFrame, made: np.ndarray, queries: DataFrame, k: int) -> DataFrame:
    """scope, id, v, cluster, n: for each query the clusters of its scope that may hold one of its k nearest, and their size."""
    dim = made.shape[1]
    stats = held.groupBy("scope", "cluster").agg(F.count("*").alias("n"), F.min("away").alias("least"), F.max("away").alias("most"))

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            far = np.sqrt(np.maximum(2 - 2 * (_unit(batch.column("v"), dim) @ made.T), 0.0))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(list(far), pa.list_(pa.float64()))], names=[*batch.schema.names, "far"])

    asked = queries.mapInArrow(measure, "scope string, id long, v array<double>, far array<double>").withColumn("ask", F.monotonically_increasing_id())
    pairs = _stored(asked, "queries").join(stats, "scope").withColumn("d", F.get("far", F.col("cluster")))  # CENTRES at most for each query
    pairs = pairs.withColumns({"ends": F.col("d") + F.col("most"), "begins": F.greatest(F.lit(0.0), F.col("d") - F.col("most"), F.col("least") - F.col("d"))})
    sure = Window.partitionBy("ask").orderBy("ends", "cluster").rowsBetween(Window.unboundedPreceding, 0)
    pairs = pairs.withColumn("within", F.sum("n").over(sure))
    bound = F.coalesce(F.min(F.when(F.col("within") >= k, F.col("ends"))).over(Window.partitionBy("ask")), F.lit(float("inf")))
    return pairs.withColumn("bound", bound).where(F.col("begins") <= F.col("bound") + SLACK).select("ask", "scope", "id", "v", "cluster", "n")


def nearest_in_scope(vectors: DataFrame, queries: DataFrame, k: int, scope: list[str], id_col: str = "vec_id", vector: str = "embedding", digits: int = 9) -> DataFrame:
    """query_id, the id, distance: the k vectors of the query's own scope with the least cosine distance, ties by id.

    scope: columns that a vector and a query must share (null counts as empty). Distances count as equal if they are so to `digits` digits.
    Shorter vectors are filled with zeros. Vectors and queries that are null, of zeros, or with a component that isn't finite are left out. Repeated ids count each. Queries have an id each.
    """
    dim = max(1, _width(vectors, vector), _width(queries, vector))
    held, made = clustered(vectors, scope, dim, id_col, vector)
    asked = visits(held, made, _usable(queries, scope, id_col, vector, dim), k)
    slices = F.greatest(F.lit(1), F.ceil(F.col("n") / BLOCK)).cast("int")
    sizes = held.groupBy("scope", "cluster").agg(F.count("*").alias("n"))
    dealt = held.join(sizes, ["scope", "cluster"]).withColumn("slice", F.pmod(F.xxhash64("id"), slices).cast("int"))

    def packing(ids: str, matrix: str, part: str):
        def pack(group: pa.Table) -> pa.Table:
            group = group.combine_chunks()
            data = group.column("id").chunk(0).to_numpy().tobytes(), _unit(group.column("v").chunk(0), dim).tobytes()
            return pa.table([group.column("scope").chunk(0)[:1], group.column("cluster").chunk(0)[:1], group.column(part).chunk(0)[:1], *[pa.array([x], pa.binary()) for x in data]], names=["scope", "cluster", part, ids, matrix])

        return pack, f"scope string, cluster int, {part} int, {ids} binary, {matrix} binary"

    blocks = dealt.groupBy("scope", "cluster", "slice").applyInArrow(*packing("ids", "m", "slice"))
    many = F.count("*").over(Window.partitionBy("scope", "cluster"))
    chunked = asked.withColumn("chunk", F.pmod(F.xxhash64("ask"), F.greatest(F.lit(1), F.ceil(many / ASKED))).cast("int"))
    questions = chunked.groupBy("scope", "cluster", "chunk").applyInArrow(*packing("asked", "qm", "chunk"))
    # a block of vectors has a key of its own, so a large cluster is no single task; packed rows are never broadcast
    questions = questions.join(sizes, ["scope", "cluster"]).withColumn("slice", F.explode(F.sequence(F.lit(0), slices - 1))).drop("n")
    pairs = blocks.join(questions.hint("merge"), ["scope", "cluster", "slice"])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                i, q = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["asked"], np.int64)
                far = np.round(1 - np.frombuffer(row["qm"]).reshape(len(q), -1) @ np.frombuffer(row["m"]).reshape(len(i), -1).T, digits) + 0.0
                top, out = min(k, len(i)), []
                for n in range(len(q)):
                    near = np.flatnonzero(far[n] <= np.partition(far[n], top - 1)[top - 1])
                    near = near[np.lexsort((i[near], far[n][near]))[:top]]
                    out.append((np.full(top, q[n]), i[near], far[n][near]))
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in map(np.concatenate, zip(*out, strict=True))], names=["query_id", "found", "distance"])

    found = pairs.mapInArrow(score, "query_id long, found long, distance double")
    place = Window.partitionBy("query_id").orderBy("distance", "found")
    return found.withColumn("nth", F.row_number().over(place)).where(F.col("nth") <= k).select("query_id", F.col("found").alias(id_col), "distance")
