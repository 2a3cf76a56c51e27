"""Document fingerprints by consistent weighted sampling.

The weighted terms of a document are its words, with weight 1 + ln(count). A sample of a weighted set draws, for
each term, r ~ Gamma(2, 1), c ~ Gamma(2, 1) and beta ~ U(0, 1) from the term's hash, quantises the log weight to
t = floor(ln w / r + beta), and keeps the term and t with the least c / (exp(r (t - beta)) exp(r)): two sets draw
the same sample with a probability equal to their generalised Jaccard similarity. Here a hash deals the terms
to BINS bins and each bin draws one sample of its own terms, so that the cost is one draw a term whatever the
number of bins; the share of equal bins among those that either set fills estimates the similarity.

DataFrame functions only. The document after each one is met by a window over ranges of ids and text hashes; each
range holds a copy of the row that begins the next, so that texts are shuffled once.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import partitions

BINS = 64
#: Keys sampled for each range; they only set where ranges begin.
SAMPLED = 20
EMPTY = "--------"
SPACE = r"[\x20\x09-\x0D]+"


def _uniform(term: Column, salt: int) -> Column:
    """A number in (0, 1) from 53 bits of a hash."""
    return (F.shiftrightunsigned(F.xxhash64(term, F.lit(salt)), 11).cast("double") + 0.5) * F.lit(2.0**-53)


def _draw(term: Column, weight: Column) -> Column:
    """A sample as one long: the quantised log of its key above 27 bits that name the term and t."""
    r = -F.log(_uniform(term, 1) * _uniform(term, 2))
    c = -F.log(_uniform(term, 3) * _uniform(term, 4))
    beta = _uniform(term, 5)
    t = F.floor(F.log(weight) / r + beta)
    key = F.log(c) - r * (t - beta) - r
    level = F.floor((F.greatest(F.least(key, F.lit(127.0)), F.lit(-127.0)) + 128.0) * F.lit(2.0**28)).cast("long")
    return F.shiftleft(level, 27).bitwiseOR(F.xxhash64(term, t).bitwiseAND((1 << 27) - 1))


def signatures(rows: DataFrame, keys: list[str], kinds: int) -> DataFrame:
    """(keys, fingerprint_0, fingerprint_1, ...): BINS marks of 8 hexadecimal digits for each of a row's texts.

    `rows` has the keys, kind (counted from 0) and words, an array. It must already be partitioned by some of the
    keys: then nothing is shuffled here. Keys without any word don't come out.
    """
    # explode_outer, as explode would have Spark split each text again to see whether there are words
    terms = rows.select(*keys, "kind", F.explode_outer("words").alias("term")).where("term <> ''")
    terms = terms.select(*keys, "kind", F.xxhash64("term").alias("term")).groupBy(*keys, "kind", "term").agg(F.count("*").alias("n"))
    bin_ = F.col("kind") * BINS + F.pmod("term", F.lit(BINS)).cast("int")
    drawn = terms.select(*keys, bin_.alias("bin"), _draw(F.col("term"), 1 + F.log(F.col("n"))).alias("draw"))
    least = drawn.groupBy(*keys, "bin").agg(F.min("draw").alias("draw"))
    mark = F.lower(F.lpad(F.hex(F.xxhash64("draw").bitwiseAND(0xFFFFFFFF)), 8, "0"))
    held = least.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("bin", mark.alias("mark")))).alias("m"))

    def joined(kind: int) -> Column:
        at = F.sequence(F.lit(kind * BINS), F.lit(kind * BINS + BINS - 1))
        return F.concat_ws("", F.transform(at, lambda b: F.coalesce(F.try_element_at(F.col("m"), b), F.lit(EMPTY))))

    return held.select(*keys, *[joined(k).alias(f"fingerprint_{k}") for k in range(kinds)])


def likeness(a: Column, b: Column) -> Column:
    """Share of equal marks among the bins that either fingerprint fills; 1 for two empty ones."""
    at = F.sequence(F.lit(1), F.lit(8 * BINS), F.lit(8))
    pairs = F.transform(at, lambda i: F.struct(F.substring(a, i, F.lit(8)).alias("x"), F.substring(b, i, F.lit(8)).alias("y")))
    filled = F.filter(pairs, lambda p: (p["x"] != EMPTY) | (p["y"] != EMPTY))
    same = F.filter(filled, lambda p: p["x"] == p["y"])
    return F.when(a == b, 1.0).otherwise(F.size(same) / F.greatest(F.size(filled), F.lit(1)))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The edited text replaces the last floor(n_chars / 2) code points by the first as many (or all) of the next
    document's by ascending id; the last one is followed by the first. Rows with equal ids are ordered by
    a hash of the text; null ids come first. A null text counts as empty, and texts without words have an empty
    fingerprint: they are alike to each other (1.0) and to nothing else. Other columns are ignored. An empty
    table gives an empty one.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"))
    wide = 8 * partitions(docs.sparkSession)  # so many that a task's terms fit in memory
    rows = rows.withColumn("h", F.xxhash64("text"))
    starts = _starts(rows, wide)
    order = [F.col("last"), F.col("doc_id").asc_nulls_first(), F.col("h")]
    rows = _ranged(rows, starts).withColumn("last", F.lit(False))
    following = [(*k, j - 1 if j else max(0, len(starts) - 1)) for j, k in enumerate(starts)]
    following = docs.sparkSession.createDataFrame(following, "id long, key long, before int")  # one row a range
    heads = rows.join(F.broadcast(following), F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("h") == F.col("key")))
    heads = heads.select("doc_id", "text", F.coalesce("before", F.lit(0)).alias("g"), "h", F.lit(True).alias("last"))
    span = Window.partitionBy("g").orderBy(*order)
    rows = rows.unionByName(heads).repartition(wide, "g")
    rows = rows.withColumns({"i": F.row_number().over(span), "next": F.lead("text").over(span)})
    chars = F.char_length("text")
    half = F.floor(chars / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), chars - half), F.substring("next", F.lit(1), half))
    rows = rows.withColumns({"n_chars": chars.cast("long"), "edited": F.when(~F.col("last"), edited)})
    texts = F.array(F.struct(F.lit(0).alias("kind"), F.col("text").alias("body")), F.struct(F.lit(1).alias("kind"), F.col("edited").alias("body")))
    both = rows.select("g", "i", F.explode(texts).alias("x")).select("g", "i", "x.kind", F.split("x.body", SPACE).alias("words"))
    marked = signatures(both, ["g", "i"], 2).withColumnsRenamed({"fingerprint_0": "f", "fingerprint_1": "e"})
    facts = rows.select("g", "i", "doc_id", "last", "n_chars", F.sha2("edited", 256).alias("edited_sha256"))
    blank = F.lit(EMPTY * BINS)
    out = facts.join(marked, ["g", "i"], "left").withColumns({"fingerprint": F.coalesce("f", blank), "edited_fingerprint": F.coalesce("e", blank)})
    out = out.withColumn("after", F.lead("fingerprint").over(Window.partitionBy("g").orderBy("i"))).where(~F.col("last"))
    return out.select(
        "doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint",
        likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"),
        likeness(F.col("fingerprint"), F.col("after")).alias("near_next"),
    )


def _starts(rows: DataFrame, wide: int) -> list[tuple[int | None, int]]:
    """Keys (doc_id, h) of rows that begin ranges of near equal counts, ascending, the least of all first.

    At most `wide`, from a sample of about SAMPLED * wide rows. Rows equal in both stay in one range.
    """
    first = rows.agg(F.min(F.struct(F.col("doc_id").isNotNull().alias("known"), F.col("doc_id").alias("id"))).alias("m")).first()["m"]
    if first is None:
        return []
    least = rows.where(F.col("doc_id").eqNullSafe(F.lit(first["id"]).cast("long"))).agg(F.min("h")).first()[0]
    share = min(1.0, SAMPLED * wide / max(1, rows.count()))
    keys = sorted({(r["doc_id"] is not None, r["doc_id"] or 0, r["h"]) for r in rows.sample(share, seed=1).select("doc_id", "h").collect()})
    least = (first["id"] is not None, first["id"] or 0, least)
    inner = [keys[i * len(keys) // wide] for i in range(1, wide)] if keys else []
    return [(i if known else None, h) for known, i, h in sorted({least, *inner})]


def _ranged(rows: DataFrame, starts: list[tuple[int | None, int]]) -> DataFrame:
    """Adds g, the number of the range that holds a row, by binary search among the starts.

    A step is a row generated from one: a column made of columns would be written out in full, several times at each
    step, by the optimizer, and lambdas would keep Spark from reading the exchange of the texts twice.
    """
    keys = starts[1:]
    ids, hashes = (F.split(F.lit(",".join(map(str, x))), ",").cast("array<long>") for x in zip(*[(-(2**63) if i is None else i, h) for i, h in keys] or [(0, 0)], strict=True))
    own = F.coalesce("doc_id", F.lit(-(2**63)))
    carried, rows = rows.columns, rows.withColumn("g", F.lit(0))
    for b in reversed(range(len(keys).bit_length())):
        at = F.col("g") + (1 << b)
        id_, h = F.get(ids, at - 1), F.get(hashes, at - 1)
        step = F.when((id_ < own) | ((id_ == own) & (h <= F.col("h"))), at).otherwise(F.col("g"))
        rows = rows.select(*carried, F.explode(F.array(step)).alias("g"))
    return rows
