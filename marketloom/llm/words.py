"""Vectorised word hashing of Arrow text columns, for use inside tasks.

Words are hashed by prefix sums of a polynomial over a random byte table modulo 2**64, so a batch costs a
few numpy passes whatever its words. Work goes in chunks of whole documents of about CHUNK bytes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

CHUNK = 1 << 20

_U = np.uint64
_BASE = _U(0x9E3779B97F4A7C15)
_BASE_INVERSE = _U(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_PLAIN = np.arange(256, dtype=np.uint8)
_LOWER = _PLAIN.copy()
_LOWER[65:91] += 32
_LETTERS = np.array([c if c > 127 or chr(c).isalnum() else 32 for c in _LOWER], dtype=np.uint8)
_powers: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit moves every output bit."""
    x = x ^ (x >> _U(32))
    x *= _U(0xD6E8FEB86659FD93)
    x ^= x >> _U(32)
    x *= _U(0xD6E8FEB86659FD93)
    x ^= x >> _U(32)
    return x


_TABLE = mix(np.arange(1, 257, dtype=np.uint64) * _BASE)


def _power(kind: str, n: int) -> np.ndarray:
    if kind not in _powers or len(_powers[kind]) < n:
        steps = np.full(max(n, CHUNK + 1), _BASE if kind == "up" else _BASE_INVERSE, dtype=np.uint64)
        steps[0] = 1
        _powers[kind] = np.multiply.accumulate(steps)
    return _powers[kind][:n]


@dataclass
class Words:
    """The words of some whole documents: hash, place in `data`, and document, in order."""

    first: int  # index in the batch of the first document
    docs: int
    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    doc: np.ndarray  # counted from `first`
    hash: np.ndarray

    def bounds(self) -> np.ndarray:
        """bounds()[d] : bounds()[d + 1] are the words of document d."""
        return np.searchsorted(self.doc, np.arange(self.docs + 1))


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column, nulls as empty texts."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    column = column.cast(pa.large_string()).fill_null("")
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    return (np.frombuffer(data, dtype=np.uint8) if data else np.zeros(0, np.uint8)), offsets


def chunks(offsets: np.ndarray, limit: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Runs of whole documents of at most `limit` bytes, or one longer document."""
    a, n = 0, len(offsets) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + limit, side="right")) - 1)
        yield a, b
        a = b


def words_of(column: pa.Array, lower: bool, punctuation: bool = True) -> Iterator[Words]:
    """lower: A-Z count as a-z. punctuation: False makes ASCII punctuation white space."""
    data, offsets = text_buffer(column)
    recode = (_LOWER if lower else _PLAIN) if punctuation else _LETTERS
    for a, b in chunks(offsets):
        part = data[offsets[a] : offsets[b]]
        edges = offsets[a : b + 1] - offsets[a]
        yield _words(a, b - a, recode[part], edges)


def _words(first: int, docs: int, data: np.ndarray, edges: np.ndarray) -> Words:
    n = len(data)
    solid = ~_SPACE[data]
    begins = solid.copy()
    begins[1:] &= ~solid[:-1]
    at_edge = edges[(edges > 0) & (edges < n)]
    begins[at_edge] = solid[at_edge]
    ends = solid.copy()
    ends[:-1] &= ~solid[1:]
    ends[at_edge - 1] = solid[at_edge - 1]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    sums = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(_TABLE[data] * _power("up", n), out=sums[1:])
    hashed = (sums[end] - sums[start]) * _power("down", n + 1)[start]
    hashed = mix(hashed ^ (end - start).astype(np.uint64))
    return Words(first, docs, data, start, end, np.searchsorted(edges, start, side="right") - 1, hashed)


def rolling(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash of every k consecutive hashes, by place of the first; order matters."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    sums = np.zeros(len(hashes) + 1, dtype=np.uint64)
    np.cumsum(hashes * _power("up", len(hashes)), out=sums[1:])
    return mix((sums[k:] - sums[:-k]) * _power("down", n) + _U(k))


def pieces(hashes: np.ndarray, first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Hash of count[i] consecutive hashes from first[i] on, for each i; as rolling()."""
    sums = np.zeros(len(hashes) + 1, dtype=np.uint64)
    np.cumsum(hashes * _power("up", len(hashes)), out=sums[1:])
    return mix((sums[first + count] - sums[first]) * _power("down", len(hashes) + 1)[first] + count.astype(np.uint64))


def shingle_sets(w: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(document, hash) of the distinct k-word shingles, sorted; a shorter text's whole word sequence is its one."""
    grams = rolling(w.hash, k)
    doc = w.doc[: len(grams)]
    inside = doc == w.doc[k - 1 :] if len(grams) else np.zeros(0, bool)
    doc, grams = doc[inside], grams[inside]
    sizes = np.bincount(w.doc, minlength=w.docs)
    for n in range(1, k):
        short = np.flatnonzero(sizes == n)
        if len(short):
            whole = rolling(w.hash, n)[np.searchsorted(w.doc, short)]
            doc, grams = np.concatenate([doc, short]), np.concatenate([grams, whole])
    order = np.lexsort((grams, doc))
    doc, grams = doc[order], grams[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (grams[1:] != grams[:-1])
    return doc[new], grams[new]
