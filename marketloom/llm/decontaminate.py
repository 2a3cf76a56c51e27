"""Benchmark decontamination: n-gram seeds that no match can be without, then Smith-Waterman alignment of words.

Test items are broadcast in blocks of about BLOCK items or BLOCK_BYTES bytes; the training rows are read once per block, so a
benchmark of any size goes through without a broadcast that grows with it. An alignment with m matched words and e
edits has m - e - 1 or more of the item's bigrams; to reach the score, with m <= n words, that is at least
(2 * score - 1) * n - 1. All bigrams of an item are seeds, and pairs of document and item with fewer of them are left
out; where the bound is 0 (items of few words), single words are the seeds. None of this depends on the corpus. A
passage with seeds is aligned with the item as far as an upper bound, the item's words that occur there at all,
allows the threshold to be reached.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow

from .words import Words, rolling, words_of

SEED = 2
BLOCK, BLOCK_BYTES = 50_000, 32 << 20
MATCH, OTHER, GAP = 2, -1, -1
SCORE = 0.6


def align(item: np.ndarray, passage: np.ndarray) -> tuple[int, int]:
    """Best local alignment score of two word sequences, and where in the passage it ends (exclusive)."""
    slope = np.arange(1, len(passage) + 1) * -GAP
    row = np.zeros(len(passage) + 1, dtype=np.int64)
    best, end = 0, 0
    for word in item:
        now = np.maximum(row[:-1] + np.where(passage == word, MATCH, OTHER), np.maximum(row[1:] + GAP, 0))
        now = np.maximum.accumulate(now + slope) - slope  # gaps along the passage
        row[1:] = now
        at = int(now.argmax())
        if now[at] > best:
            best, end = int(now[at]), at + 1
    return best, end


def _words(column: pa.Array) -> Iterator[Words]:
    return words_of(pc.utf8_lower(column.fill_null("")), lower=True, punctuation=False)


class Items:
    """A block of test items: word hashes, and the seeds as sorted hashes with their places."""

    def __init__(self, ids: list[int], texts: list[str], score: float):
        found = [(ids[w.first + d], w.hash[a:b]) for w in _words(pa.array(texts, pa.string())) for d, (a, b) in enumerate(zip(w.bounds()[:-1], w.bounds()[1:], strict=True))]
        self.ids = [i for i, h in found if len(h)]
        self.words = [h for _, h in found if len(h)]
        bounds = [math.ceil((MATCH * score - 1) * len(h) - 1 - 1e-9) for h in self.words]
        self.least = np.array([max(1, b) for b in bounds], dtype=np.int64)
        seeds = []
        for item, (words, bound) in enumerate(zip(self.words, bounds, strict=True)):
            n = SEED if bound > 0 else 1
            seeds += [(gram, item, i, n) for i, gram in enumerate(rolling(words, n))]
        seeds.sort(key=lambda s: s[0])
        self.lengths = sorted({s[3] for s in seeds})
        self.seed = np.array([s[0] for s in seeds], dtype=np.uint64)
        self.item = np.array([s[1] for s in seeds], dtype=np.int64)
        self.place = np.array([s[2] for s in seeds], dtype=np.int64)

    def hits(self, w: Words) -> np.ndarray:
        """Sorted distinct (document, item, diagonal) of pairs with enough seeds; diagonal: place in w less place in the item."""
        found = []
        for n in self.lengths:
            grams = rolling(w.hash, n)
            a, b = np.searchsorted(self.seed, grams), np.searchsorted(self.seed, grams, side="right")
            at = np.flatnonzero((b > a) & (w.doc[: len(grams)] == w.doc[n - 1 :][: len(grams)]))
            times = (b - a)[at]
            which = np.repeat(a[at], times) + np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
            found.append(np.stack([np.repeat(w.doc[at], times), self.item[which], np.repeat(at, times) - self.place[which], self.place[which]]))
        found = np.concatenate(found, axis=1)
        pair = found[0] * len(self.words) + found[1]
        met, places = np.unique(np.unique(np.stack([pair, found[3]]), axis=1)[0], return_counts=True)  # different places of the item
        enough = met[places >= self.least[met % len(self.words)]] if len(met) else met
        return np.unique(found[:3, np.isin(pair, enough)], axis=1)

    def matches(self, w: Words, score: float) -> Iterator[tuple[int, int, float, int]]:
        """(document, item id, score, end of the passage) of the best alignment that reaches the score."""
        if not len(self.seed) or not len(w.hash):
            return
        bounds, both = w.bounds(), self.hits(w)
        if not both.shape[1]:
            return
        new = np.flatnonzero(np.any(np.diff(both[:2], axis=1) != 0, axis=0)) + 1
        for part in np.split(both, new, axis=1):
            d, i = int(part[0, 0]), int(part[1, 0])
            words = self.words[i]
            pad, best, end = math.ceil((1 - score) * MATCH * len(words)) + 2, 0, 0  # as many edits as a match may have
            need = score * MATCH * len(words)
            for run in np.split(part[2], np.flatnonzero(np.diff(part[2]) > len(words)) + 1):
                a, b = max(bounds[d], run[0] - pad), min(bounds[d + 1], run[-1] + len(words) + pad)
                passage = w.hash[a:b]
                if not len(passage) or MATCH * np.isin(words, passage).sum() < need:
                    continue
                got, at = align(words, passage)
                if got > best:
                    best, end = got, int(a - bounds[d] + at)
            if best >= need:
                yield d, self.ids[i], best / (MATCH * len(words)), end


def _blocks(docs: DataFrame, items: DataFrame, item_col: str, item_text: str, score: float):
    """Broadcast blocks of items with their seeds."""
    spark = docs.sparkSession
    items = items.select(F.col(item_col).cast("long").alias("i"), F.col(item_text).cast("string").alias("t")).where("i is not null and t is not null")
    count, size = items.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("t")), F.lit(0))).first()
    n = max(1, -(-count // BLOCK), -(-size // BLOCK_BYTES))
    for b in range(n):
        rows = items.where(F.pmod(F.xxhash64("i"), F.lit(n)) == b).distinct().orderBy("i", "t").collect()  # one block
        block = Items([r.i for r in rows], [r.t for r in rows], score)
        if not block.words:
            continue
        yield spark.sparkContext.broadcast(block)


def _found(batches: Iterator[pa.RecordBatch], block, score: float) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [(w.first + d, i, s, e) for w in _words(batch.column("text")) for d, i, s, e in block.value.matches(w, score)]
        at, item, got, end = zip(*rows, strict=True) if rows else ([], [], [], [])
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id").take(pa.array(at, pa.int64())), pa.array(item, pa.int64()), pa.array(got, pa.float64()), pa.array(end, pa.int64())],
            names=["doc_id", "item_id", "score", "end_word"],
        )


def contaminated(docs: DataFrame, items: DataFrame, score: float = SCORE, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """(doc_id, item_id, score, end_word): documents with a passage that aligns with a test item.

    Words are lower-cased and split at white space and ASCII punctuation. score is the local alignment score
    against that of a whole copy (1.0); matches of `score` and more are returned, the best for each item and
    row, with the place after its last word. Null or empty texts and items match nothing. Repeated rows are
    reported each; repeated items once. Other columns are ignored. Empty tables give an empty one.
    """
    plain = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    schema = "doc_id long, item_id long, score double, end_word long"
    out = docs.sparkSession.createDataFrame([], schema)
    for block in _blocks(plain, items, item_col, item_text, score):
        out = out.union(map_arrow(plain, lambda b, block=block: _found(b, block, score), schema))
    return out


def _clean(batches: Iterator[pa.RecordBatch], block, score: float, text_col: str) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keep = np.ones(len(batch), bool)
        for w in _words(batch.column(text_col)):
            for d, *_ in block.value.matches(w, score):
                keep[w.first + d] = False
        yield batch.filter(pa.array(keep))


def decontaminate(docs: DataFrame, items: DataFrame, score: float = SCORE, text_col: str = "text") -> DataFrame:
    """docs, all columns, without the rows that contaminated() reports; decided in place, without a join."""
    schema = docs.schema
    for block in _blocks(docs, items, "item_id", "text", score):
        docs = map_arrow(docs, lambda b, block=block: _clean(b, block, score, text_col), schema)
    return docs
