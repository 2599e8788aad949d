"""Vectorised word kernels shared by the text operators."""

from __future__ import annotations

import numpy as np
import xxhash

U = np.uint64
GOLDEN = U(0x9E3779B97F4A7C15)
#: Distinct words remembered by one Python worker before its cache starts afresh.
CACHE_WORDS = 100_000
#: Characters worked on at once, so that memory does not follow the batch.
CHUNK_CHARS = 500_000


class WordCache(dict):
    """word -> value, computed on first sight. ``trim`` bounds it between chunks."""

    def __init__(self, make):
        super().__init__()
        self.make = make

    def __missing__(self, word):
        value = self[word] = self.make(word)
        return value

    def trim(self):
        if len(self) > CACHE_WORDS:
            self.clear()


def hash64(word: str) -> int:
    return xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass"))


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64 over an array."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def chunks(texts: list) -> list[tuple[int, int]]:
    """Index ranges of about CHUNK_CHARS characters; a longer text stands alone."""
    out, start, size = [], 0, 0
    for i, t in enumerate(texts):
        n = len(t) if t else 0
        if i > start and size + n > CHUNK_CHARS:
            out.append((start, i))
            start, size = i, 0
        size += n
    if start < len(texts):
        out.append((start, len(texts)))
    return out


def token_hashes(tokens: list[list[str]], cache: WordCache) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all tokens one after another, and where each text starts (n + 1 offsets)."""
    offsets = np.zeros(len(tokens) + 1, np.int64)
    np.cumsum([len(t) for t in tokens], out=offsets[1:])
    flat = np.empty(offsets[-1], U)
    for t, a, b in zip(tokens, offsets[:-1], offsets[1:]):
        if b > a:
            flat[a:b] = np.fromiter(map(cache.__getitem__, t), U, b - a)
    return flat, offsets


def shingles(flat: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct k-word shingles: text index, hash and count, ordered by text and hash.

    A text of 1 to k-1 words is one shingle; a text without words has none.
    """
    n = len(offsets) - 1
    lengths = np.diff(offsets)
    counts = np.where(lengths >= k, lengths - k + 1, (lengths > 0).astype(np.int64))
    doc = np.repeat(np.arange(n), counts)
    if not len(doc):
        return doc, np.empty(0, U), np.empty(0, np.int64)
    first = np.concatenate([[0], np.cumsum(counts)[:-1]])
    at = np.arange(len(doc)) - first[doc] + offsets[:-1][doc]
    padded = np.concatenate([flat, np.zeros(k, U)])
    h = np.zeros(len(doc), U)
    end = offsets[1:][doc]
    for j in range(k):
        h = h * GOLDEN + np.where(at + j < end, mix(padded[at + j] + U(j)), U(j))
    h = mix(h)
    order = np.lexsort((h, doc))
    doc, h = doc[order], h[order]
    new = np.concatenate([[True], (doc[1:] != doc[:-1]) | (h[1:] != h[:-1])])
    start = np.flatnonzero(new)
    return doc[start], h[start], np.diff(np.append(start, len(h)))
