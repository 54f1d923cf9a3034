"""Vectorised word and shingle hashes over Arrow text columns.

All work is done on the UTF-8 bytes of a batch at once; a batch is taken in slices of bounded size, so
that temporary arrays stay small however long the texts are in sum.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1_000_000
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads their bits (splitmix64's finaliser)."""
    x = x.copy()
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _factors(count: int) -> np.ndarray:
    return mix64(np.arange(1, count + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


_FACTORS = _factors(256)


def utf8(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; nulls are empty."""
    texts = texts.cast(pa.large_string()).fill_null("")
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, dtype=np.int64, count=len(texts) + 1, offset=8 * texts.offset) if len(texts) else np.zeros(1, np.int64)
    return (np.frombuffer(data, dtype=np.uint8) if data else np.zeros(0, np.uint8)), at


def slices(offsets: np.ndarray, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Runs of documents of about `most` bytes; a longer document stands alone."""
    first, n = 0, len(offsets) - 1
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + most, side="right")) - 1
        last = min(n, max(last, first + 1))
        yield first, last
        first = last


class Words:
    """The words of a run of documents: hashes, the place of each in data and the number per document."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, first: int, last: int, prefixes: tuple[int, ...] = ()):
        base, end = int(offsets[first]), int(offsets[last])
        raw = _LOWER[data[base:end]]
        bounds = offsets[first : last + 1] - base
        solid = ~_SPACE[raw]
        start = solid.copy()
        start[1:] &= ~solid[:-1]
        heads = bounds[:-1][bounds[:-1] < len(raw)]
        start[heads] = solid[heads]  # a document's first byte starts a word even after a word's last
        self.starts = np.flatnonzero(start)
        self.per_doc = np.diff(np.searchsorted(self.starts, bounds))
        self.bytes, self.hashes, self.prefix = raw, np.zeros(0, np.uint64), {}
        if not len(self.starts):
            self.prefix = {k: self.hashes for k in prefixes}
            return
        number = np.cumsum(start) - 1
        place = np.arange(len(raw), dtype=np.int64)
        place -= self.starts[np.maximum(number, 0)]
        np.maximum(place, 0, out=place)
        longest = int(place.max()) + 1
        factors = _FACTORS if longest <= len(_FACTORS) else _factors(longest)
        terms = factors[place]
        terms *= raw.astype(np.uint64) + np.uint64(1)
        terms[~solid] = 0
        self.hashes = mix64(np.add.reduceat(terms, self.starts))
        self.lengths = np.add.reduceat(solid.astype(np.int64), self.starts)
        for k in prefixes:
            total = np.zeros(len(self.starts), np.uint64)
            for i in range(k):
                at = self.starts + i
                total += np.where(i < self.lengths, terms[np.minimum(at, len(raw) - 1)], np.uint64(0))
            self.prefix[k] = mix64(total + np.uint64(k))

    def doc_of(self) -> np.ndarray:
        """For each word the number of its document in the run."""
        return np.repeat(np.arange(len(self.per_doc)), self.per_doc)


def shingles(words: Words, k: int = 5) -> list[np.ndarray]:
    """Sorted distinct k-word shingles of each document; a shorter document's words make one shingle."""
    h, out = words.hashes, []
    if not len(h):
        return [h] * len(words.per_doc)
    rolled = np.zeros(max(0, len(h) - k + 1), np.uint64)
    for i in range(k):
        rolled += h[i : i + len(rolled)] * _FACTORS[100 + i]
    rolled = mix64(rolled)
    at = 0
    for n in words.per_doc.tolist():
        if n >= k:
            own = np.sort(rolled[at : at + n - k + 1])
            keep = np.ones(len(own), bool)
            np.not_equal(own[1:], own[:-1], out=keep[1:])
            out.append(own[keep])
        elif n:
            out.append(mix64(np.array([(h[at : at + n] * _FACTORS[120 : 120 + n]).sum() + np.uint64(n)], np.uint64)))
        else:
            out.append(h[:0])
        at += n
    return out


def doc_shingles(texts: pa.Array, k: int = 5) -> Iterator[np.ndarray]:
    """Shingle sets of a text column, in its order."""
    data, offsets = utf8(texts)
    for first, last in slices(offsets):
        yield from shingles(Words(data, offsets, first, last), k)
