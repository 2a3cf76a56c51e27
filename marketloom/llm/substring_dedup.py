"""Removal of repeated passages by De Bruijn compaction over word k-mers.

The edges of the graph are windows of `window` consecutive words; an edge that occurs at two places or more is
repeated, and consecutive repeated edges of a document compact to one span. So that not every window is
shuffled, the graph is first built on sampled nodes: of each window, the least of its k-mers by hash (its
minimizer). Equal windows have equal minimizers, so a window whose minimizer occurs once in the corpus is
unique. Consecutive windows with their minimizer at the same place compact to one path, keyed by the hash of
its words; paths with the same words are one class, counted once with its number of places. A node with one
class needs no more: its windows repeat as the class does. Where paths branch (a node with several classes),
the windows of one path of each class are keyed by hash and counted with the classes' weights. Spark joins
bring the classes' repeated windows back to their source coordinates, where they compact to spans.

Windows and paths are told apart by 96 bits of hash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, materialize, release
from .words import Words, mix, pieces, rolling, words_of

WINDOW = 35
NODE = 11
#: A path is cut after so many windows, which a long's bits can mark.
PATH = 62
_U = np.uint64
_NONE = _U(2**64 - 1)


def _slide(x: np.ndarray, n: int, best) -> np.ndarray:
    """best over every n consecutive values."""
    have = 1
    while have < n:
        step = min(have, n - have)
        x = best(x[:-step], x[step:])
        have += step
    return x


def _minimizers(w: Words, window: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """K-mer hashes, the place of the first least one of each window, and whether that window is inside one document."""
    grams = rolling(w.hash, k)
    if len(w.hash) < window:
        return grams, np.zeros(0, int), np.zeros(0, bool)
    grams = np.where(w.doc[: len(grams)] == w.doc[k - 1 :], grams, _NONE)
    inside = w.doc[: len(w.hash) - window + 1] == w.doc[window - 1 :]
    place = _slide(np.arange(len(grams)), window - k + 1, lambda x, y: np.where(grams[y] < grams[x], y, x))
    return grams, place, inside


def _paths(w: Words, window: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first window, number of windows, minimizer) of each path: windows with the minimizer at one place, at most PATH."""
    grams, place, inside = _minimizers(w, window, k)
    at = np.flatnonzero(inside)
    begins = np.flatnonzero(np.diff(place[at], prepend=-1))
    n = np.diff(np.append(begins, len(at)))
    parts = -(-n // PATH)
    nth = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
    first = np.repeat(begins, parts) + nth * PATH
    n = np.minimum(np.repeat(n, parts) - nth * PATH, PATH)
    return at[first], n, grams[place[at[first]]]


def _two_hashes(w: Words, hashed) -> tuple[pa.Array, pa.Array]:
    """A long and an int from a function of the words' hashes: 96 bits in all."""
    second = (hashed(mix(w.hash + _U(77))) >> _U(32)).astype(np.uint32)
    return pa.array(hashed(w.hash).view(np.int64)), pa.array(second.view(np.int32))


def _kept(words: list[bytes]) -> str:
    return hashlib.sha256(b" ".join(words)).hexdigest()


def _nodes(batches: Iterator[pa.RecordBatch], window: int, k: int) -> Iterator[pa.RecordBatch]:
    """Per row: key, number of words, checksum of all words, distinct minimizers and how often each is met."""
    for batch in batches:
        for w in words_of(batch.column("text"), lower=False):
            grams, place, inside = _minimizers(w, window, k)
            chosen = place[inside]
            chosen = chosen[np.diff(chosen, prepend=-1) != 0]
            doc, node = w.doc[chosen], grams[chosen]
            order = np.lexsort((node, doc))
            doc, node = doc[order], node[order]
            new = np.ones(len(doc), bool)
            new[1:] = (doc[1:] != doc[:-1]) | (node[1:] != node[:-1])
            at = np.flatnonzero(new)
            times = np.diff(np.append(at, len(doc)))
            edge = pa.array(np.searchsorted(doc[at], np.arange(w.docs + 1)).astype(np.int32))
            texts = batch.column("text").slice(w.first, w.docs)
            checks = [_kept((t.as_py() or "").encode().split()) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id").slice(w.first, w.docs),
                    batch.column("text_key").slice(w.first, w.docs),
                    pa.array(np.bincount(w.doc, minlength=w.docs).astype(np.int64)),
                    pa.array(checks, pa.string()),
                    pa.ListArray.from_arrays(edge, pa.array(node[at].view(np.int64))),
                    pa.ListArray.from_arrays(edge, pa.array(times.astype(np.int32))),
                ],
                names=["doc_id", "text_key", "n_words", "kept_sha256", "nodes", "times"],
            )


def _at_nodes(batches: Iterator[pa.RecordBatch], window: int, k: int) -> Iterator[pa.RecordBatch]:
    """The paths whose minimizer is among the row's repeated nodes: hashes of their words, and place."""
    for batch in batches:
        nodes = batch.column("nodes")
        for w in words_of(batch.column("text"), lower=False):
            first, n, node = _paths(w, window, k)
            doc = w.doc[first]
            bounds = np.searchsorted(doc, np.arange(w.docs + 1))
            marked = np.zeros(len(first), bool)
            for d in range(w.docs):
                repeated = nodes[w.first + d].values.to_numpy().view(np.uint64)
                marked[bounds[d] : bounds[d + 1]] = np.isin(node[bounds[d] : bounds[d + 1]], repeated)
            first, n, node, doc = first[marked], n[marked], node[marked], doc[marked]
            ids = [batch.column(c).slice(w.first, w.docs).take(pa.array(doc)) for c in ("doc_id", "text_key")]
            words = n + (window - 1)
            places = [pa.array((first - w.bounds()[doc]).astype(np.int32)), pa.array(n.astype(np.int32))]
            yield pa.RecordBatch.from_arrays(
                [*_two_hashes(w, lambda h: pieces(h, first, words)), pa.array(node.view(np.int64)), *ids, *places],  # noqa: B023
                names=["p1", "p2", "node", "doc_id", "text_key", "first", "n"],
            )


def _edges(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    """Per window of the row's paths: hashes, its path and whether that has more places, and its number in the path."""
    for batch in batches:
        paths = batch.column("paths")
        for w in words_of(batch.column("text"), lower=False):
            mine = paths.slice(w.first, w.docs)
            rows = mine.flatten()
            n = rows.field("n").to_numpy()
            begin = rows.field("first").to_numpy() + np.repeat(w.bounds()[:-1], mine.value_lengths().to_numpy())
            path = np.repeat(np.arange(len(n)), n)
            nth = np.arange(len(path)) - np.repeat(np.cumsum(n) - n, n)
            at = begin[path] + nth
            same = [rows.field(c).take(pa.array(path)) for c in ("p1", "p2", "again")]
            yield pa.RecordBatch.from_arrays(
                [*_two_hashes(w, lambda h: rolling(h, window)[at]), *same, pa.array(nth.astype(np.int32))],  # noqa: B023
                names=["h1", "h2", "p1", "p2", "again", "nth"],
            )


def _places(cuts: pa.StructArray) -> np.ndarray:
    """Places of the repeated windows of (first, mask) pairs."""
    first, mask = cuts.field("first").to_numpy(), cuts.field("mask").to_numpy()
    return np.concatenate([first[(mask >> bit) & 1 == 1] + bit for bit in range(int(mask.max()).bit_length())])


def spans(places: np.ndarray, window: int) -> list[tuple[int, int]]:
    """Repeated edges, by place, compacted to maximal [start, end) spans of words."""
    places = np.unique(places)
    cut = np.flatnonzero(np.diff(places) > window) + 1
    return [(int(p[0]), int(p[-1]) + window) for p in np.split(places, cut) if len(p)]


def _removed(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        gone, checks, texts = [], [], []
        for text, cuts in zip(batch.column("text"), batch.column("cuts"), strict=True):
            words = text.as_py().encode().split()
            keep, last, n = [], 0, 0
            for a, b in spans(_places(cuts.values), window):
                keep += words[last:a]
                last, n = b, n + b - a
            keep += words[last:]
            gone.append(n)
            checks.append(_kept(keep))
        ids = [batch.column("doc_id"), batch.column("text_key")]
        yield pa.RecordBatch.from_arrays([*ids, pa.array(gone, pa.int64()), pa.array(checks, pa.string())], names=["doc_id", "text_key", "n_removed", "cut_sha256"])


def _texts_with(plain: DataFrame, found: DataFrame) -> DataFrame:
    """doc_id, text_key, text and found's other column, for the rows in found."""
    found = found.withColumnsRenamed({"doc_id": "_d", "text_key": "_t"})
    return plain.join(found, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("text_key") == F.col("_t"))).drop("_d", "_t")


def remove_repeats(docs: DataFrame, window: int = WINDOW, node: int = NODE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256): one row per row of docs.

    A word is removed if a window that covers it occurs at another place too, in the same document or another.
    A null or empty text has no words. Rows that repeat in id and text are places of their own, so both lose
    what they share. Null ids are treated as one more id. Other columns are ignored. An empty table gives an
    empty one.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    plain = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("text_key"))
    key = ["doc_id", "text_key"]
    base = "doc_id long, text_key long, n_words long, kept_sha256 string, nodes array<long>, times array<int>"
    base = materialize(map_arrow(plain, lambda b: _nodes(b, window, node), base), "nodes")
    met = base.select(*key, F.explode(F.arrays_zip("nodes", "times")).alias("x")).select(*key, F.col("x.nodes").alias("node"), F.col("x.times").alias("times"))
    repeated = met.groupBy("node").agg(F.sum("times").alias("times")).where("times > 1").select("node")
    at = met.join(repeated, "node", "left_semi").groupBy(*key).agg(F.collect_set("node").alias("nodes"))
    texts = materialize(_texts_with(plain, at), "texts")  # the rows that may repeat anything: what follows reads no other text
    paths = map_arrow(texts, lambda b: _at_nodes(b, window, node), "p1 long, p2 int, node long, doc_id long, text_key long, first int, n int")
    paths = materialize(paths, "paths")
    texts = texts.drop("nodes")
    one = F.min(F.struct("doc_id", "text_key", "first"))
    classes = paths.groupBy("p1", "p2").agg(F.count("*").alias("times"), F.min("node").alias("node"), F.min("n").alias("n"), one.alias("at"))
    classes = materialize(classes, "classes")
    forms = classes.groupBy("node").agg(F.count("*").alias("forms"))
    branched = materialize(forms.where("forms > 1").select("node"), "branched")
    at = classes.join(branched, "node", "left_semi").select("at.*", "p1", "p2", (F.col("times") > 1).alias("again"), "n")
    at = materialize(at.groupBy(*key).agg(F.collect_list(F.struct("p1", "p2", "again", "first", "n")).alias("paths")), "sources")
    edges = map_arrow(_texts_with(texts, at), lambda b: _edges(b, window), "h1 long, h2 int, p1 long, p2 int, again boolean, nth int")
    edges = materialize(edges, "edges")
    # No window is twice in one path, and rows that repeat in id and text give the same path again: only other paths count.
    seen = edges.groupBy("h1", "h2").agg(F.max("again").alias("again"), F.min("p1").alias("least"), F.max("p1").alias("most"))
    twice = seen.where("again or least <> most").select("h1", "h2")
    masks = edges.join(twice, ["h1", "h2"], "left_semi").groupBy("p1", "p2").agg(F.bit_or(F.expr("shiftleft(1L, nth)")).alias("mask"))
    plainly = classes.where("times > 1").join(branched, "node", "left_anti").select("p1", "p2", F.expr("shiftleft(1L, n) - 1").alias("mask"))
    cut = paths.join(masks.union(plainly), ["p1", "p2"]).groupBy(*key).agg(F.collect_list(F.struct("first", "mask")).alias("cuts"))
    cut = materialize(cut, "cuts")
    release(paths, classes, branched, at, edges)
    fixed = map_arrow(_texts_with(texts, cut), lambda b: _removed(b, window), "doc_id long, text_key long, n_removed long, cut_sha256 string")
    fixed = fixed.dropDuplicates(key)
    same = base["doc_id"].eqNullSafe(fixed["doc_id"]) & (base["text_key"] == fixed["text_key"])
    out = base.drop("nodes", "times").alias("x").join(fixed.alias("y"), same, "left")
    return out.select(
        F.col("x.doc_id"), "n_words", F.coalesce("n_removed", F.lit(0)).alias("n_removed"), F.coalesce("cut_sha256", "kept_sha256").alias("kept_sha256")
    )
