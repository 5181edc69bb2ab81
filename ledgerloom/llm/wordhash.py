"""Vectorised word and shingle hashing over Arrow string columns.

All functions work on the UTF-8 bytes of a batch of texts. Word separators are
ASCII only, so a byte-level scan finds exactly the words of a code-point-level
pattern. A word's 64-bit hash is a keyed polynomial over its bytes; equal words
have equal hashes and different words differ but for a chance of about 2^-64.

Texts are handled in chunks of about ``CHUNK`` bytes, so memory stays bounded
by one chunk or by the longest single text, whichever is larger.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK = 1 << 18

_BYTES = np.arange(256)
#: Bytes of words `[^\\x20\\x09-\\x0D]+`.
NON_SPACE = ~((_BYTES == 32) | ((_BYTES >= 9) & (_BYTES <= 13)))

_U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on uint64 (public splitmix64 constants)."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


_EXACT = mix(np.arange(1, 257, dtype=np.uint64) * _U(0x9E3779B97F4A7C15))
_FOLDED = _EXACT.copy()
_FOLDED[65:91] = _EXACT[97:123]
_BASE = 0x2545F4914F6CDD1D
_POWERS = np.ones(1, dtype=np.uint64)


def _powers(n: int) -> np.ndarray:
    global _POWERS
    if n > len(_POWERS):
        step = np.full(max(n, 4096), _BASE, dtype=np.uint64)
        step[0] = 1
        _POWERS = np.cumprod(step, dtype=np.uint64)
    return _POWERS


class Words:
    """Words of a chunk of texts.

    ``doc``: index of the text in the chunk; ``start``/``end``: byte places in
    ``data``; ``hash``: uint64. ``n_docs`` texts, with bounds ``offsets``.
    """

    __slots__ = ("data", "doc", "end", "hash", "n_docs", "offsets", "start")

    def __init__(self, data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray, fold_case: bool):
        self.data, self.offsets, self.n_docs = data, offsets, len(offsets) - 1
        w = is_word[data]
        n = len(data)
        edge = np.zeros(n + 1, dtype=bool)
        edge[offsets] = True
        before = np.empty(n, dtype=bool)
        if n:
            before[0] = False
            before[1:] = w[:-1]
            before &= ~edge[:n]
        self.start = np.flatnonzero(w & ~before)
        after = np.empty(n, dtype=bool)
        if n:
            after[-1] = False
            after[:-1] = w[1:]
            after &= ~edge[1:]
        self.end = np.flatnonzero(w & ~after) + 1
        self.doc = np.searchsorted(offsets, self.start, "right") - 1
        length = self.end - self.start
        if len(length):
            at = np.cumsum(length) - length
            place = np.arange(at[-1] + length[-1]) - np.repeat(at, length)
            table = _FOLDED if fold_case else _EXACT
            value = table[data[w]] * _powers(int(length.max()))[place]
            h = np.add.reduceat(value, at)
            self.hash = mix(h ^ (length.astype(np.uint64) * _U(0x9E3779B97F4A7C15)))
        else:
            self.hash = np.zeros(0, dtype=np.uint64)

    def counts(self) -> np.ndarray:
        """Number of words of each text."""
        return np.bincount(self.doc, minlength=self.n_docs)

    def bounds(self) -> np.ndarray:
        """Word index bounds of each text, n_docs + 1 long."""
        return np.concatenate(([0], np.cumsum(self.counts())))

    def windows(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(index of first word, hash) of all windows of k words of one text."""
        n = len(self.hash) - k + 1
        if n <= 0:
            return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64)
        h = np.zeros(n, dtype=np.uint64)
        for i in range(k):
            h = mix(h * _U(0xD6E8FEB86659FD93) + self.hash[i : i + n] + _U(i + 1))
        first = np.flatnonzero(self.doc[:n] == self.doc[k - 1 : k - 1 + n])
        return first, h[first]


def raw(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; null texts count as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    if not len(column):
        return np.zeros(0, dtype=np.uint8), np.zeros(1, dtype=np.int64)
    size = int(at[-1])
    bytes_ = np.frombuffer(data, dtype=np.uint8, count=size) if size else np.zeros(0, dtype=np.uint8)
    return bytes_[at[0] :], at - at[0]


def chunks(column: pa.Array, is_word: np.ndarray = NON_SPACE, fold_case: bool = False) -> Iterator[tuple[int, Words]]:
    """(index of the first text, Words) of consecutive texts of about CHUNK bytes."""
    data, offsets = raw(column)
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + CHUNK, "right")) - 1)
        j = min(j, n)
        yield i, Words(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], is_word, fold_case)
        i = j


def shingle_sets(words: Words, k: int) -> Iterator[np.ndarray]:
    """For each text its sorted distinct k-word shingle hashes.

    A text with fewer words, but not none, has its whole sequence as its one
    shingle; a text without words has none.
    """
    first, h = words.windows(k)
    at = np.searchsorted(words.doc[first], np.arange(words.n_docs + 1))
    bounds = words.bounds()
    for d in range(words.n_docs):
        s = h[at[d] : at[d + 1]]
        if len(s):
            s = np.sort(s)
            keep = np.empty(len(s), dtype=bool)
            keep[0] = True
            np.not_equal(s[1:], s[:-1], out=keep[1:])
            yield s[keep]
        elif bounds[d + 1] > bounds[d]:
            x = _U(0)
            with np.errstate(over="ignore"):
                for v in words.hash[bounds[d] : bounds[d + 1]]:
                    x = mix(x * _U(0xD6E8FEB86659FD93) + v + _U(77))
            yield np.array([x], dtype=np.uint64)
        else:
            yield s
