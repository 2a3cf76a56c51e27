"""Token counts by a two-tier lookup on the map side.

The vocabulary's pieces have the space mark only at their start, so merges never cross from a word to the mark
that begins the next, and a text's count is the sum over its pre-tokens (a run of spaces and what follows up to
the next space). The first tier is a broadcast table of the token counts of frequent pre-tokens, of at most
FREQUENT entries, from a sample of at most SAMPLE documents; it only saves time. The second tier is a cache in
each Python worker, which encodes what the first one misses. Pre-tokens are never shuffled.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow

SAMPLE = 2_000
FREQUENT = 60_000
CACHED = 1_000_000
LONGEST = 64

MARK = "▁"
_PRETOKEN = re.compile(f"{MARK}+[^{MARK}]*")


def pretokens(text: str) -> list[str]:
    """The pre-tokens of a text, each without the one mark that the library puts before a text."""
    if not text:
        return []
    if MARK not in text and "  " not in text and text[0] != " " and text[-1] != " ":
        return text.split(" ")
    marked = MARK + text.replace(" ", MARK)
    return [x[1:] for x in _PRETOKEN.findall(marked)]


class Counts(dict):
    """Pre-token to number of tokens; a miss is encoded, and kept while there is room."""

    def __init__(self, known: dict[str, int], model: str):
        import sentencepiece

        super().__init__(known)
        self.pieces = sentencepiece.SentencePieceProcessor(model_file=model)
        self.encode = self.pieces.encode

    def __missing__(self, word: str) -> int:
        n = len(self.encode(word)) if word else 1
        if len(word) <= LONGEST and len(self) < CACHED:
            self[word] = n
        return n


_workers: dict[str, Counts] = {}


def _count(batches: Iterator[pa.RecordBatch], known, model: str) -> Iterator[pa.RecordBatch]:
    if model not in _workers:
        _workers[model] = Counts(known.value, model)
    get = _workers[model].__getitem__
    for batch in batches:
        column = batch.column("text").fill_null("")
        n = [sum(map(get, pretokens(x.as_py()))) for x in column]
        size = pc.binary_length(column).cast(pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), size, pa.array(n, pa.int64())], names=["doc_id", "n_bytes", "n_tokens"])


def _frequent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen: Counter[str] = Counter()
    for batch in batches:
        for x in batch.column("text").drop_null():
            seen.update(w for w in pretokens(x.as_py()) if w and len(w) <= LONGEST)
    yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in seen.most_common(FREQUENT)], pa.string())], names=["word"])


def token_counts(docs: DataFrame, model: str, limit: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit): one row per row of docs, repeated rows and null ids included.

    `model` is a sentencepiece file at the same path on every executor. Counts are those of its encode() on the
    whole text, without begin or end tokens. A null text counts as empty: 0 bytes, 0 tokens. over_limit is
    n_tokens > limit. Other columns are ignored. An empty table gives an empty one.
    """
    plain = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    words = [r.word for r in map_arrow(plain.select("text").limit(SAMPLE), _frequent, "word string").collect()]
    fresh = Counts({}, model)
    if any(MARK in p.lstrip(MARK) for p in map(fresh.pieces.id_to_piece, range(fresh.pieces.get_piece_size()))):
        raise ValueError("a piece spans words in this vocabulary, so counts don't add up over pre-tokens")
    known = docs.sparkSession.sparkContext.broadcast({w: fresh[w] for w in words[:FREQUENT]})
    counted = map_arrow(plain, lambda b: _count(b, known, model), "doc_id long, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
