"""MinHash near-dedup: fast similarity sketches, banding, exact verification, components.

Each document's set of word shingles is sketched by rounds of hashed bin placement: in round i every element
falls into a random bin with a value that any later round's values exceed, so once a bin is filled it stays,
and after t random rounds round t + b places all elements in bin b, so that no coordinate stays empty. Two
sketches agree in a coordinate with probability equal to the Jaccard similarity of the sets.

Sketches are banded: sets of similarity s share a band with probability 1 - (1 - s**rows)**bands, which for the
default 48 bands of 5 rows misses a pair at exactly 0.8 with probability 6e-9. Everything after that is exact:

1. Documents with equal sets form a class; only the class representative goes on.
2. In each bucket every member is compared with the bucket's least member (a star, never all pairs); links are
   confirmed on the full sets and joined into components.
3. Buckets in which more than one component is left may hide links between members of different ones. An exact
   prefix filter with positions (rarest shingles first, only those that several components have) finds for each member
   the larger components that may hold a similar set, by set size. A member stays if enough of its shingles occur
   anywhere in those sets, which drops groups that share no more than a block without comparing their members. Of two
   components the member covered best is compared first; members of components that this has joined are done.
   What is left is compared pair by pair. No cap is needed, and all links are confirmed on full sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import map_arrow, materialize, packed, release
from .components import components
from .words import mix, shingle_sets, words_of

BANDS, ROWS = 48, 5
#: Shingles of a group of sets that are held in one list.
SLICE = 4_096
_U = np.uint64
_EMPTY = _U(2**64 - 1)


def sketch(doc: np.ndarray, element: np.ndarray, docs: int, t: int) -> np.ndarray:
    """Fast similarity sketches (docs x t) of sets given as parallel arrays; rows of empty sets stay unfilled."""
    out = np.full(docs * t, _EMPTY, dtype=np.uint64)
    size = np.bincount(doc, minlength=docs)
    open_ = size > 0
    for i in range(2 * t):
        alive = open_[doc]
        if not alive.all():
            doc, element = doc[alive], element[alive]
        if not len(doc):
            break
        x = mix(element ^ _U(0xA0761D6478BD642F * (i + 1) % 2**64))
        value = (_U(i) << _U(48)) | (x & _U(2**48 - 1))
        bin_ = ((x >> _U(48)) * _U(t) >> _U(16)).astype(np.int64) if i < t else i - t
        np.minimum.at(out, doc * t + bin_, value)
        if i < 4 or i % 8 == 0:
            open_ = (out.reshape(docs, t) == _EMPTY).any(axis=1) & (size > 0)
    return out.reshape(docs, t)


def _signatures(batches: Iterator[pa.RecordBatch], k: int, bands: int, rows: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for w in words_of(batch.column("text"), lower=True):
            doc, grams = shingle_sets(w, k)
            size = np.bincount(doc, minlength=w.docs)
            marks = []
            for salt in (0x1B873593, 0xCC9E2D51):
                total = np.zeros(len(grams) + 1, np.uint64)
                np.cumsum(mix(grams + _U(salt)), out=total[1:])
                edge = np.concatenate([[0], np.cumsum(size)])
                marks.append((total[edge[1:]] - total[edge[:-1]]).view(np.int64))
            coordinates = sketch(doc, grams, w.docs, bands * rows).reshape(w.docs, bands, rows)
            key = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64), (w.docs, bands)).copy()
            for r in range(rows):
                key = mix(key * _U(0x9E3779B97F4A7C15) + coordinates[:, :, r])
            lists = pa.ListArray.from_arrays(
                pa.array(np.arange(w.docs + 1, dtype=np.int32) * bands), pa.array(key.reshape(-1).view(np.int64))
            )
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").slice(w.first, w.docs), pa.array(size.astype(np.int64)), *map(pa.array, marks), lists],
                names=["doc_id", "n", "f1", "f2", "bands"],
            )


def _sets(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for w in words_of(batch.column("text"), lower=True):
            doc, grams = shingle_sets(w, k)
            edge = np.searchsorted(doc, np.arange(w.docs + 1)).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id").slice(w.first, w.docs),
                    pa.ListArray.from_arrays(pa.array(edge), pa.array(grams.view(np.int64))),
                ],
                names=["doc_id", "set"],
            )


def _verified(pairs: DataFrame, sets: DataFrame, percent: int, *more: str) -> DataFrame:
    """Pairs (a, b), and more columns, whose full sets have percent / 100 or more of their union in common."""
    side = lambda x: sets.select(F.col("doc_id").alias(x), F.col("set").alias(f"s{x}"))
    both = F.size(F.array_intersect("sa", "sb"))
    joined = pairs.select("a", "b", *more).join(side("b"), "b").join(side("a"), "a")
    return joined.where(both * 100 >= (F.size("sa") + F.size("sb") - both) * percent).select("a", "b", *more)


def _shared(sets: DataFrame, parts: DataFrame, percent: int) -> DataFrame:
    """(doc_id, part, size, n, token, i, most): the shingles that more than one component has, of sets that may be similar to one elsewhere.

    size: members of the component; n: of the set. i counts from 0, rarest first. most: the largest set that may be
    similar if the shingle is the first one in common, by the s - i shingles left.
    """
    sized = parts.join(parts.groupBy("part").agg(F.count("*").alias("size")), "part")
    rows = sets.join(sized, "doc_id").select("doc_id", "part", "size", F.size("set").alias("n"), F.explode("set").alias("token"))
    common = rows.groupBy("token").agg(F.count("*").alias("df"), F.min("part").alias("p1"), F.max("part").alias("p2"))
    common = materialize(common.where("p1 <> p2").select("token", "df"), "common")
    own = Window.partitionBy("doc_id")
    held = rows.join(common, "token").withColumns({"i": F.row_number().over(own.orderBy("df", "token")) - 1, "s": F.count("*").over(own)})
    held = held.where(F.col("s") * 100 >= F.col("n") * percent)
    most = F.floor(((F.col("s") - F.col("i")) * (100 + percent) - F.col("n") * percent) / percent)
    held = materialize(held.select("doc_id", "part", "size", "n", "token", "i", most.alias("most")), "held")
    release(common)
    return held


def _reach(held: DataFrame, prefix: DataFrame, percent: int) -> DataFrame:
    """(doc_id, part, n, to, m, both): sets and larger components whose sets of m shingles hold enough of theirs, `both`, among them."""
    cells = prefix.groupBy("token", F.col("part").alias("to"), F.col("size").alias("to_size"), F.col("n").alias("m")).agg(F.max("most").alias("to_most"))
    cells = materialize(cells, "cells")
    larger = (F.col("to_size") > F.col("size")) | ((F.col("to_size") == F.col("size")) & (F.col("to") > F.col("part")))
    met = prefix.join(cells, "token").where(larger & (F.col("m") <= F.col("most")) & (F.col("n") <= F.col("to_most")))
    met = materialize(met.select("doc_id", "part", "n", "to", "m").distinct(), "met")
    # the shingles of each of those cells, in lists of about SLICE, against each set's own
    there = held.withColumnsRenamed({"part": "to", "n": "m"}).join(met.select("to", "m").distinct(), ["to", "m"], "left_semi")
    there = materialize(there.select("to", "m", "token").distinct(), "there")
    many = there.groupBy("to", "m").agg(F.ceil(F.count("*") / SLICE).alias("slices"))
    many = materialize(many, "many")
    lists = there.join(many, ["to", "m"]).groupBy("to", "m", F.pmod("token", "slices").alias("slice")).agg(F.collect_list("token").alias("theirs"))
    own = held.join(met.select("doc_id").distinct(), "doc_id", "left_semi").groupBy("doc_id").agg(F.collect_list("token").alias("tokens"))
    lists = materialize(lists, "lists")
    held_there = F.size(F.array_intersect("tokens", "theirs")).alias("c")
    counts = met.join(own, "doc_id").join(lists, ["to", "m"]).select("doc_id", "part", "n", "to", "m", held_there)
    counts = materialize(counts, "counts")  # a table, so that the join may split the sets that meet one group
    cover = counts.groupBy("doc_id", "part", "n", "to", "m").agg(F.sum("c").alias("both"))
    cover = materialize(cover.where(F.col("both") * (100 + percent) >= (F.col("n") + F.col("m")) * percent), "reach")
    release(cells, met, there, many, lists, counts)
    return cover


def _hidden_links(sets: DataFrame, parts: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) of similar sets in different components of `parts`: with them, components that hold similar sets are one."""
    held = _shared(sets, parts, percent)
    prefix = held.where(F.col("most") * 100 >= F.col("n") * percent)
    kinds = materialize(prefix.select("token", "n", "most").distinct(), "kinds")  # by size and place only: few for each token
    other = kinds.select("token", F.col("n").alias("m"), F.col("most").alias("to_most"))
    able = kinds.join(other, "token").where((F.col("m") <= F.col("most")) & (F.col("n") <= F.col("to_most"))).select("token", "n", "most").distinct()
    able = materialize(able, "able")
    prefix = materialize(prefix.join(able, ["token", "n", "most"], "left_semi"), "prefix")
    reach = _reach(held, prefix, percent)
    y = prefix.select("token", F.col("part").alias("to"), F.col("n").alias("m"), F.col("doc_id").alias("other"), F.col("most").alias("to_most"))

    def links(some: DataFrame) -> DataFrame:
        x = prefix.select("doc_id", "token", "most").join(some.select("doc_id", "part", "n", "to", "m"), "doc_id")
        met = x.join(y, ["token", "to", "m"]).where((F.col("m") <= F.col("most")) & (F.col("n") <= F.col("to_most")))
        pairs = met.select(F.least("doc_id", "other").alias("a"), F.greatest("doc_id", "other").alias("b"), "part", "to").distinct()
        return materialize(_verified(pairs, sets, percent, "part", "to"), "links")

    covered = F.struct((F.col("both") / (F.col("n") + F.col("m"))).alias("share"), "doc_id", "n", "m")
    best = reach.groupBy("part", "to").agg(F.max(covered).alias("x")).select("x.doc_id", "part", "x.n", "to", "x.m")
    first = links(best)
    joined = components(first.select(F.col("part").alias("a"), F.col("to").alias("b")))
    now = lambda c: joined.select(F.col("node").alias(c), F.col("component").alias(f"{c}_now"))
    apart = F.coalesce("part_now", "part") != F.coalesce("to_now", "to")
    rest = links(reach.join(now("part"), "part", "left").join(now("to"), "to", "left").where(apart))
    release(held, kinds, able, prefix, reach)
    return first.union(rest).select("a", "b")


def near_duplicates(
    docs: DataFrame, shingle: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text", bands: int = BANDS, rows: int = ROWS
) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept): one row per row of docs.

    Texts are lower-cased in A-Z and split at ASCII white space. A null or empty text, or one without words,
    has an empty set and is linked with nothing. Rows that share an id count as one document. Rows with a
    null id are kept and link to nothing. Other columns are ignored, whatever their names. An empty table
    gives an empty one. kept is true for the least id of a component.
    """
    plain = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    signed = materialize(
        map_arrow(plain, lambda b: _signatures(b, shingle, bands, rows), "doc_id long, n long, f1 long, f2 long, bands array<long>"), "sketches"
    )
    class_of = (
        signed.where("n > 0 and doc_id is not null").groupBy("n", "f1", "f2").agg(F.min("doc_id").alias("class"))
    )
    class_of = materialize(class_of, "classes")
    lead = signed.where("n > 0").join(
        class_of.select(F.col("class").alias("doc_id"), "n", "f1", "f2"), ["doc_id", "n", "f1", "f2"], "left_semi"
    )
    buckets = lead.select("doc_id", F.explode("bands").alias("key"))
    several = buckets.groupBy("key").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("z"), F.count("*").alias("members"))
    several = materialize(several.where("a <> z").drop("z"), "several")
    shared = materialize(buckets.join(several, "key"), "buckets")
    star = shared.where("doc_id <> a").select("a", F.col("doc_id").alias("b")).distinct()
    star = materialize(star, "star")
    members = materialize(star.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct(), "members")
    sets = plain.join(members, "doc_id", "left_semi").dropDuplicates(["doc_id"])
    sets = materialize(map_arrow(sets, lambda b: _sets(b, shingle), "doc_id long, set array<long>"), "sets")
    links = materialize(_verified(star, sets, percent), "links")
    parts = components(links)
    # Buckets of two were settled by the star; larger ones only if one component is left.
    placed = shared.where("members > 2").join(parts.withColumnRenamed("node", "doc_id"), "doc_id", "left")
    placed = materialize(placed.select("key", "doc_id", F.coalesce("component", "doc_id").alias("part")), "placed")
    mixed = placed.groupBy("key").agg(F.min("part").alias("p1"), F.max("part").alias("p2")).where("p1 <> p2").select("key")
    mixed = materialize(mixed, "mixed")
    left = materialize(placed.join(mixed, "key", "left_semi").select("doc_id", "part").distinct(), "left")
    if not left.isEmpty():
        parts = components(links.union(_hidden_links(sets, left, percent)))
    release(several, shared, star, members, sets, links, placed, mixed, left)
    named = class_of.join(parts, class_of["class"] == parts["node"], "left").select(
        "n", "f1", "f2", F.coalesce("component", "class").alias("component_id")
    )
    out = signed.drop("bands").join(named, ["n", "f1", "f2"], "left")
    own = F.when(F.col("doc_id").isNull(), F.col("doc_id")).otherwise(F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), own.alias("component_id"), F.col("doc_id").eqNullSafe(own).alias("kept"))


def drop_near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 80) -> DataFrame:
    """docs, all columns, with one row of each group that near_duplicates() finds; of rows with one id, one stays.

    Rows with a null id stay. Columns of any name are carried along.
    """
    found = materialize(near_duplicates(docs, shingle, percent), "near")
    gone = materialize(found.where("not kept").select("doc_id").distinct(), "gone")
    again = materialize(found.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id"), "again")
    release(found)
    left = packed(docs, doc_id=F.col("doc_id").cast("long")).join(gone, "doc_id", "left_anti")
    if not again.isEmpty():
        one = left.join(again, "doc_id", "left_semi").dropDuplicates(["doc_id"])
        left = left.join(again, "doc_id", "left_anti").unionByName(one)
    return left.select("row.*")
