"""Vectorised word hashing over UTF-8 bytes.

A word's hash is a polynomial of its bytes modulo 2^64, taken from running sums, so that
no Python code runs per word; a finaliser spreads it over all 64 bits. Texts are handled in
pieces of about PIECE bytes that end where a word ends: memory does not depend on a text's
length apart from the eight bytes a word of its result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

PIECE = 1 << 19
_ODD = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on 64 bits."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.ones(n, np.uint64)
    out[1:] = np.uint64(base)
    return np.multiply.accumulate(out)


class WordHasher:
    """Hashes the words of texts. word_byte: of the 256 byte values (after A-Z are lower-cased), those that words are made of."""

    def __init__(self, word_byte: np.ndarray):
        lower = np.arange(256)
        lower[65:91] += 32
        self._word = word_byte[lower]
        values = mix((np.arange(256, dtype=np.uint64) + np.uint64(1)) * np.uint64(_ODD))
        self._value = values[lower]
        self._base = _ODD | 1
        self._inverse = pow(self._base, -1, 1 << 64)
        self._pow = self._inv = np.empty(0, np.uint64)

    def _tables(self, n: int) -> None:
        if len(self._pow) < n:
            n = max(n, PIECE + 4096)
            self._pow, self._inv = _powers(self._base, n), _powers(self._inverse, n)

    def hashes(self, data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(hash of each word, number of its text) for texts that begin at starts in data."""
        n = len(data)
        if not n:
            return np.empty(0, np.uint64), np.empty(0, np.int64)
        inside = self._word[data]
        begins = inside.copy()
        begins[1:] &= ~inside[:-1]
        cut = starts[(starts > 0) & (starts < n)]
        begins[cut] = inside[cut]
        ends = inside.copy()
        ends[:-1] &= ~inside[1:]
        ends[cut - 1] = inside[cut - 1]
        first, last = np.flatnonzero(begins), np.flatnonzero(ends)
        if not len(first):
            return np.empty(0, np.uint64), np.empty(0, np.int64)
        self._tables(n)
        total = np.cumsum(self._value[data] * self._pow[:n], dtype=np.uint64)
        upto = total[last]
        before = np.where(first > 0, total[first - 1], np.uint64(0))
        length = (last - first + 1).astype(np.uint64)
        hashed = mix(((upto - before) * self._inv[first]) ^ (length * np.uint64(0xD6E8FEB86659FD93)))
        return hashed, np.searchsorted(starts, first, side="right") - 1

    def texts(self, column: pa.Array | pa.ChunkedArray) -> Iterator[tuple[int, list[np.ndarray]]]:
        """(number of the first text, word hashes of each of the next texts), null as no words, over a string column."""
        column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
        column = column.cast(pa.large_string())
        rows = len(column)
        if not rows:
            return
        offsets = np.frombuffer(column.buffers()[1], np.int64, rows + 1, column.offset * 8)
        data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
        if column.null_count:
            filled = column.fill_null("")
            offsets = np.frombuffer(filled.buffers()[1], np.int64, rows + 1, filled.offset * 8)
            data = np.frombuffer(filled.buffers()[2] or b"", np.uint8)
        i = 0
        while i < rows:
            j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + PIECE, side="right")) - 1)
            low, high = int(offsets[i]), int(offsets[j])
            if high - low > 2 * PIECE:
                yield i, [np.concatenate([*self._long(data[low:high]), np.empty(0, np.uint64)])]
            else:
                hashed, text = self.hashes(data[low:high], offsets[i:j] - low)
                cuts = np.searchsorted(text, np.arange(j - i + 1))
                yield i, [hashed[cuts[k] : cuts[k + 1]] for k in range(j - i)]
            i = j

    def _long(self, data: np.ndarray) -> Iterator[np.ndarray]:
        low, n, start = 0, len(data), np.zeros(1, np.int64)
        while low < n:
            high = min(n, low + PIECE)
            while high < n and self._word[data[high]] and self._word[data[high - 1]]:
                gaps = np.flatnonzero(~self._word[data[high : high + 4096]])
                high = min(n, high + (int(gaps[0]) if len(gaps) else 4096))
            yield self.hashes(data[low:high], start)[0]
            low = high


def grams(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of k words; empty if there are fewer."""
    n = len(words) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = words[:n] * np.uint64(_ODD) + np.uint64(k)
    for j in range(1, k):
        out = (out ^ (out >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + words[j : n + j]
    return mix(out)


def shingles(words: np.ndarray, k: int) -> np.ndarray:
    """Sorted distinct k-word shingles; of fewer words, the whole sequence as one; of none, none."""
    if not len(words):
        return np.empty(0, np.uint64)
    return np.unique(grams(words, min(k, len(words))))


def bytes_but(*ranges: tuple[int, int]) -> np.ndarray:
    out = np.ones(256, bool)
    for low, high in ranges:
        out[low : high + 1] = False
    return out


#: Fixed values of the contracts: what words are made of, as classes over bytes.
NOT_SPACE = bytes_but((0x20, 0x20), (0x09, 0x0D))
ALNUM = bytes_but((0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F))
