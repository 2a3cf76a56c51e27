"""Sharding by vector bin packing: bytes, tokens and rows balanced jointly, equal texts kept together.

Rows with equal texts form a group. A group stays whole unless it takes more than 1 / PART of a shard's even share
of all bytes, tokens or rows, whatever the size of the table; such a group is cut in the fewest pieces of that size,
its rows dealt in turn, so that rows equal in all else are spread too. There are at most 3 * shards * PART of those. Groups over 1 / FINE of a share are packed one by
one, at most 3 * shards * FINE; the rest is gathered into a fixed number of bundles by a hash of the text, so the
demands to be packed are a table of bounded size. They are placed largest first, each where the dot product of its
demand with the residual capacity is highest among shards that still have room in bytes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, n_bytes, packed, word_count
from .prefix import running

BUNDLES = 8192
FINE = 64
PART = 2
SLICES = 1024


def pack(demand: np.ndarray, shards: int) -> np.ndarray:
    """Shard of each row of demand (rows x dimensions, the first counts for room), largest first."""
    total = demand.sum(axis=0)
    share = demand / np.where(total > 0, total, 1)
    residual = np.full((shards, demand.shape[1]), 1.0 / shards)
    out = np.zeros(len(demand), dtype=np.int64)
    for i in np.argsort(-share.max(axis=1), kind="stable"):
        room = residual[:, 0] >= share[i, 0]
        score = residual @ share[i]
        # without room anywhere, the shard with the most bytes left takes it
        out[i] = np.argmax(np.where(room, score, -np.inf)) if room.any() else np.argmax(residual[:, 0])
        residual[out[i]] -= share[i]
    return out


def shard(docs: DataFrame, shards: int = 16, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard): one row per row of docs.

    The law is `bytes`: the sizes of the shards are near equal. size is the text's UTF-8 bytes plus 1; a null
    text has size 1 and the checksum of the empty text, and groups with empty texts. slot counts from 0
    without gaps in each shard. grown_shard is null under this law. Repeated rows and rows with a null id keep a place each
    and count as any others. Columns other than the id and the text are ignored. An empty table gives an
    empty one.
    """
    rows, *plan = _plan(docs, shards, id_col, text_col)
    rows = _placed(rows, *plan).withColumn("one", F.lit(1).cast("long"))
    rows = rows.withColumn("slice", F.pmod(F.xxhash64("doc_id", "size", "text_crc32"), F.lit(SLICES)))
    rows = running(rows, "shard", "slice", ["doc_id", "size", "text_crc32"], {"slot": "one"})
    return rows.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def with_shards(docs: DataFrame, shards: int = 16, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs, all columns, with shard as shard() gives it (in place of a column of that name), decided in place.

    Columns of any other name are carried along.
    """
    _, *plan = _plan(docs, shards, id_col, text_col)
    rows = packed(docs, _group=_group(F.col(text_col)), _at=F.monotonically_increasing_id())
    kept = [F.col("row")[c].alias(c) for c in docs.columns if c.lower() != "shard"]
    return _placed(rows, *plan).select(*kept, "shard")


def _text(text: Column) -> Column:
    return F.coalesce(text.cast("string"), F.lit(""))


def _group(text: Column) -> Column:
    return F.unhex(F.sha2(_text(text), 256))


def _placed(rows: DataFrame, large: DataFrame, pieces: DataFrame, bundles: DataFrame, cut: bool) -> DataFrame:
    """Adds shard to rows with _group and _at; the tables are bounded by 3 * shards * FINE groups, their pieces, and BUNDLES."""
    small = rows.join(F.broadcast(large), "_group", "left_anti").withColumn("_bundle", _bundle()).join(F.broadcast(bundles), "_bundle").drop("_bundle")
    if not cut:
        return small
    # the rows of a large group are numbered and dealt in turn, so equal rows are spread like any others
    held = rows.join(F.broadcast(large), "_group").withColumns({"_one": F.lit(1).cast("long"), "_slice": F.pmod(F.xxhash64("_at"), F.lit(SLICES))})
    held = running(held, "_group", "_slice", ["_at"], {"_nth": "_one"}).withColumn("_piece", F.col("_nth") % F.col("_pieces"))
    held = held.join(F.broadcast(pieces), ["_group", "_piece"]).drop("_piece", "_pieces", "_one", "_slice", "_nth")
    return small.unionByName(held)


def _bundle() -> Column:
    return F.pmod(F.xxhash64("_group"), F.lit(BUNDLES))


def _bounded(spark: SparkSession, **columns: pa.Array) -> DataFrame:
    """A small table. Made of Arrow columns, as rows of Python would start a second set of Python workers on the executors."""
    return spark.createDataFrame(pa.table(columns))


def _plan(docs: DataFrame, shards: int, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame, bool]:
    """Rows without their texts, large groups with their number of pieces, the shard of each piece and of each bundle, and whether there are large ones."""
    spark, text = docs.sparkSession, _text(F.col(text_col))
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        (n_bytes(text) + 1).alias("size"),
        word_count(text).alias("tokens"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        _group(text).alias("_group"),
        F.monotonically_increasing_id().alias("_at"),
    )
    rows = materialize(rows, "sizes")
    total = rows.agg(F.sum("size"), F.sum("tokens"), F.count("*")).first()
    limits = [max(1.0, (t or 0) / (shards * PART)) for t in total]
    fine = [x * PART / FINE for x in limits]
    groups = rows.groupBy("_group").agg(F.sum("size").alias("b"), F.sum("tokens").alias("t"), F.count("*").alias("n"))
    parts = F.greatest(*[F.ceil(F.col(c) / F.lit(m)) for c, m in zip("btn", limits, strict=True)], F.lit(1))
    over = (F.col("b") > fine[0]) | (F.col("t") > fine[1]) | (F.col("n") > fine[2])
    large = materialize(groups.where(over).select("_group", F.least(parts, F.col("n")).alias("_pieces"), "b", "t", "n"), "large")
    each = large.orderBy("_group").collect()  # bounded by 3 * shards * FINE
    demand = rows.join(F.broadcast(large), "_group", "left_anti").groupBy(_bundle().alias("_bundle"))
    demand = demand.agg(F.sum("size").alias("b"), F.sum("tokens").alias("t"), F.count("*").alias("n"))
    demand = demand.toPandas().sort_values("_bundle")  # BUNDLES: bounded
    pieces = [(bytes(g["_group"]), k) for g in each for k in range(g["_pieces"])]
    # a group's rows have one text, so its pieces differ by a row at most
    shares = [(g["n"] // g["_pieces"] + (k < g["n"] % g["_pieces"])) / g["n"] for g in each for k in range(g["_pieces"])]
    owners = [g for g in each for _ in range(g["_pieces"])]
    wanted = np.array([[g["b"] * x, g["t"] * x, g["n"] * x] for g, x in zip(owners, shares, strict=True)], dtype=float).reshape(-1, 3)
    found = pack(np.concatenate([wanted, demand[["b", "t", "n"]].to_numpy(dtype=float).reshape(-1, 3)]), shards).tolist()
    names, places = zip(*pieces, strict=True) if pieces else ((), ())
    placed = _bounded(spark, _group=pa.array(names, pa.binary()), _piece=pa.array(places, pa.int64()), shard=pa.array(found[: len(pieces)], pa.int32()))
    bundles = _bounded(spark, _bundle=pa.array(demand["_bundle"].to_numpy(), pa.int64()), shard=pa.array(found[len(pieces) :], pa.int32()))
    return rows, large.select("_group", "_pieces"), placed, bundles, bool(each)
