"""Mixing sources to target weights by weighted fair queueing.

Each source's documents are shuffled by a hash of the id and offered up to REPEATS times in a row; an offer's
virtual finish time is the cumulative size of its source, itself included, divided by the source's weight. All
offers are sorted by that time over the whole corpus and cut where the total budget is used up. A source that
has been offered REPEATS times whole has no more to give, so its share falls to the others by weight.
Everything runs as DataFrame expressions; running sums are split by hash slices, so that a source with a third
of all rows is no single task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import materialize, packed, partitions, release, word_count
from .prefix import running

REPEATS = 3
#: Slices that rows equal in id, source and size are numbered in.
SLICES = 1_024


def _in_order(df: DataFrame, order: list, sums: dict[str, str]) -> DataFrame:
    """df with, for each new: old in sums, the sum of old over the rows before; in ranges, so that no task holds all rows."""
    sorted_ = df.repartitionByRange(max(8, 2 * partitions(df.sparkSession)), *order).sortWithinPartitions(*order)
    sorted_ = materialize(sorted_.withColumns({"range": F.spark_partition_id(), "all": F.lit(0)}), "ordered")
    return running(sorted_, "all", "range", order, sums).drop("range", "all")


def targets(sizes: DataFrame, repeats: int = REPEATS) -> DataFrame:
    """Adds weight and target to a table of (source, source_size): one row per source.

    Sources in code-point order, null last, weigh 1, 2, 3, 1, ...; the sum of all sizes is shared by weight, but
    no target exceeds `repeats` times its source's size, and what is over is shared again by weight.
    """
    named = F.col("source").asc_nulls_last()
    sizes = _in_order(sizes.withColumn("one", F.lit(1).cast("long")), [named], {"nth": "one"})
    sizes = sizes.withColumns({"weight": F.col("nth") % 3 + 1, "cap": F.col("source_size") * repeats})
    # Sources reach their cap in the order of cap / weight. With those before one capped, the others get `level` times weight.
    sizes = _in_order(sizes.drop("nth").withColumn("ratio", F.col("cap") / F.col("weight")), [F.col("ratio"), named], {"nth": "one", "capped": "cap", "weighed": "weight"})
    total, weights = sizes.agg(F.sum("source_size"), F.sum("weight")).first()
    sizes = sizes.withColumn("level", F.try_divide(F.lit(total) - F.col("capped"), F.lit(weights) - F.col("weighed")))
    # the level is right for the first source, in that order, which it doesn't cap
    share = sizes.where("level <= ratio").agg(F.min_by("level", "nth")).first()[0] or 0.0
    target = F.least(F.col("cap").cast("double"), F.col("weight") * share)
    return sizes.select("source", "source_size", "weight", target.alias("target"))


def mix(docs: DataFrame, repeats: int = REPEATS, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(doc_id, size, source, source_size, target, copies, taken): one row per row of docs.

    size is the number of words, 0 for a null text; taken = copies * size is what the mix takes of a document,
    repeats counted. Offers are whole documents; the one that the budget falls in is taken if at least half of
    it fits, so the total is within half a document of the sum of all sizes. A null source is a source of its own.
    Equal ids are ordered by size; rows that are equal in both are interchangeable. Documents without words are
    taken once. The same input gives the same result. An empty table gives an empty one. Other columns are
    ignored.
    """
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"), word_count(F.col(text_col)).alias("size")
    )
    rows = rows.withColumn("mark", F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))))
    rows = materialize(rows.withColumn("slice", F.conv(F.substring("mark", 1, 3), 16, 10).cast("int")), "mix")
    shares = materialize(targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), repeats), "targets")
    rows = rows.withColumn("one", F.lit(1).cast("long"))
    rows = running(rows, "source", "slice", ["mark", "size"], {"before": "size", "place": "one"})
    shares = shares.withColumnRenamed("source", "_source")
    rows = materialize(rows.join(shares, F.col("source").eqNullSafe(F.col("_source"))).drop("_source", "one", "slice", "mark"), "queued")
    offers = rows.where("size > 0").select(
        "source", "doc_id", "place", "size", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))).alias("turn"), "before", "source_size", "weight"
    )
    finish = (F.col("turn") * F.col("source_size") + F.col("before") + F.col("size")) / F.col("weight")
    offers = offers.select("source", "place", "size", finish.alias("finish"), "turn")
    budget = rows.agg(F.sum("size")).first()[0] or 0
    queue = _in_order(offers, [F.col("finish"), F.col("source"), F.col("place"), F.col("turn")], {"ahead": "size"})
    took = queue.where(F.col("ahead") * 2 + F.col("size") <= 2 * budget)
    took = took.groupBy("source", "place").agg(F.count("*").alias("copies")).select(F.col("source").alias("_s"), F.col("place").alias("_p"), "copies")
    out = rows.join(took, F.col("source").eqNullSafe(F.col("_s")) & (F.col("place") == F.col("_p")), "left")
    copies = F.when(F.col("size") == 0, F.lit(1)).otherwise(F.coalesce("copies", F.lit(0))).cast("long")
    return out.select("doc_id", "size", "source", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"))


def mixed(docs: DataFrame, repeats: int = REPEATS) -> DataFrame:
    """docs, all columns, each row as often as mix() takes it.

    Rows that are equal in id, source and size share their copies: each has the whole part of the mean, and as many as are over
    have one more, so that none is lost or added. Columns of any name are carried along.
    """
    taken = mix(docs, repeats).groupBy("doc_id", "source", "size").agg(F.sum("copies").alias("copies"), F.count("*").alias("rows"))
    taken = taken.where("copies > 0").withColumnsRenamed({"doc_id": "i", "source": "s", "size": "n"})
    taken = materialize(taken.withColumn("mark", F.md5(F.to_json(F.struct("i", "s", "n")))), "copies")
    rows = packed(docs, doc_id=F.col("doc_id").cast("long"), source=F.col("source").cast("string"), size=word_count(F.col("text")), at=F.monotonically_increasing_id())
    on = F.col("doc_id").eqNullSafe(F.col("i")) & F.col("source").eqNullSafe(F.col("s")) & (F.col("size") == F.col("n"))
    even, whole = F.col("copies") % F.col("rows") == 0, F.floor(F.col("copies") / F.col("rows"))
    out = rows.join(taken.where(even), on).select("row", whole.alias("copies"))
    if not taken.where(~even).isEmpty():
        held = rows.join(taken.where(~even), on).withColumns({"one": F.lit(1).cast("long"), "slice": F.pmod(F.xxhash64("at"), F.lit(SLICES))})
        held = running(held.select("row", "copies", "rows", "mark", "one", "slice", "at"), "mark", "slice", ["at"], {"nth": "one"})
        out = out.union(held.select("row", whole + (F.col("nth") < F.col("copies") % F.col("rows")).cast("int")))
    times = F.explode(F.array_repeat(F.lit(0), F.col("copies").cast("int")))
    return out.select("row", times.alias("time")).select("row.*")
