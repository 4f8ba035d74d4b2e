"""Words of many texts as numpy arrays: positions and 64-bit hashes, computed over UTF-8 bytes without a Python loop per word.

A word is a maximal run of characters other than space and U+0009 to U+000D; these are single bytes in UTF-8, so bytes suffice.
The hash of a span is a polynomial with one random 64-bit value per byte value, scrambled by splitmix64's finaliser;
it does not depend on where the span lies.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
BASE = U(0x9E3779B97F4A7C15 | 1)
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, 9, 10, 11, 12, 13]] = True
AS_IS = np.arange(256, dtype=np.uint8)
LOWER = AS_IS.copy()
LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64's finaliser: a bijection on 64 bits."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


BYTE_VALUE = mix(np.arange(1, 257, dtype=U) * BASE)
_powers = [np.ones(1, U), np.ones(1, U)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE ** k and its inverse, for k up to n, modulo 2 ** 64."""
    if len(_powers[0]) <= n:
        for at, b in enumerate((int(BASE), pow(int(BASE), -1, 1 << 64))):
            full = np.full(max(n + 1, 1 << 20), U(b))
            full[0] = U(1)
            _powers[at] = np.multiply.accumulate(full)
    return _powers[0], _powers[1]


class Texts:
    """A run of texts: bytes, text offsets, and the words' starts, ends and text numbers."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.data, self.offsets, self.n = data, offsets, len(offsets) - 1
        self._sums = None

    def words(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return self.spans(~IS_SPACE[self.data])

    def lines(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Lines with at least one byte; empty lines are left out."""
        return self.spans(self.data != 10)

    def spans(self, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Maximal runs of inside within one text: starts, ends, text numbers."""
        if not len(inside):
            none = np.zeros(0, np.int64)
            return none, none, none
        first = np.zeros(len(inside) + 1, bool)
        first[self.offsets] = True
        before = np.empty(len(inside), bool)
        before[0] = False
        before[1:] = inside[:-1]
        starts = np.flatnonzero(inside & (~before | first[:-1]))
        after = np.empty(len(inside), bool)
        after[-1] = False
        after[:-1] = inside[1:]
        ends = np.flatnonzero(inside & (~after | first[1:])) + 1
        return starts, ends, np.searchsorted(self.offsets, starts, side="right") - 1

    def hashes(self, starts: np.ndarray, ends: np.ndarray, table: np.ndarray = AS_IS) -> np.ndarray:
        """64-bit hashes of the spans' bytes after the byte mapping table."""
        up, down = powers(len(self.data))
        if self._sums is None or self._sums[0] is not table:
            sums = np.empty(len(self.data) + 1, U)
            sums[0] = U(0)
            np.cumsum(BYTE_VALUE[table[self.data]] * up[: len(self.data)], out=sums[1:])
            self._sums = (table, sums)
        sums = self._sums[1]
        return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(U))

    def bounds(self, owner: np.ndarray) -> np.ndarray:
        """For items sorted by text number: offsets of each text's items."""
        return np.searchsorted(owner, np.arange(self.n + 1))


def runs(column: pa.Array, limit: int = 1 << 20, rows: int = 1 << 30) -> Iterator[tuple[int, Texts]]:
    """Texts of a large_string column without nulls, cut at text borders into runs of about limit bytes and at most rows texts:
    (first row, texts)."""
    if not len(column):
        return
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    at = 0
    while at < len(column):
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, side="right")) - 1)
        to = min(to, at + rows, len(column))
        yield at, Texts(data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at])
        at = to


_STEP = mix(np.arange(101, 165, dtype=U) * BASE) | U(1)


def windows(words: np.ndarray, owner: np.ndarray, k: int, whole_if_short: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of k consecutive words of one text, first word of each, and text number.
    whole_if_short: a text with 1 to k - 1 words gives its whole sequence as one window."""
    n = len(words)
    if n >= k:
        at = np.flatnonzero(owner[: n - k + 1] == owner[k - 1 :])
        total = np.zeros(len(at), U)
        for j in range(k):
            total += words[at + j] * _STEP[j]
        got = mix(total)
    else:
        at, got = np.zeros(0, np.int64), np.zeros(0, U)
    if whole_if_short and n:
        texts, first, count = np.unique(owner, return_index=True, return_counts=True)
        for r in range(1, k):
            short = first[count == r]
            if len(short):
                total = np.full(len(short), U(r))
                for j in range(r):
                    total += words[short + j] * _STEP[j]
                at, got = np.concatenate([at, short]), np.concatenate([got, mix(total)])
        order = np.argsort(at, kind="stable")
        at, got = at[order], got[order]
    return got, at, owner[at] if n else np.zeros(0, np.int64)
