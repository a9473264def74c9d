"""Whole-batch word arithmetic for Arrow tasks.

A word is a maximal run of bytes outside ``\\x20 \\x09-\\x0D``; UTF-8 never uses
those bytes inside a character, so words are found on bytes.  All of a batch's
texts are handled as one byte array: word bounds, 64-bit word hashes and the
hashes of n consecutive words come from prefix sums, with no Python loop over
words.  Hash of a sequence x_0.. at position p: sum x_i * M^(i-p) (mod 2^64),
finished by a mixing step; M is odd, so the shift by M^-p is exact.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK_BYTES = 1 << 19  # texts are taken this many bytes at a time (one longer text is taken whole)

_SEPARATOR = np.zeros(256, dtype=bool)
_SEPARATOR[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

_U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """Finishing step of a 64-bit hash: every input bit reaches every output bit."""
    x = x ^ (x >> _U(33))
    x = x * _U(0xFF51AFD7ED558CCD)
    x = x ^ (x >> _U(33))
    x = x * _U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> _U(33))


class _Powers:
    """M^0.. and M^-0.. (mod 2^64), grown on demand."""

    def __init__(self, base: int):
        self.base, self.up, self.down = base, np.ones(1, np.uint64), np.ones(1, np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 2 * len(self.up))
            self.up = self._table(self.base, size)
            self.down = self._table(pow(self.base, -1, 1 << 64), size)
        return self.up[:n], self.down[:n]

    @staticmethod
    def _table(base: int, size: int) -> np.ndarray:
        t = np.full(size, base, dtype=np.uint64)
        t[0] = 1
        return np.cumprod(t, dtype=np.uint64)


_BYTES, _WORDS, _WORDS2 = _Powers(0x9E3779B97F4A7C15 | 1), _Powers(0xD6E8FEB86659FD93), _Powers(0xA0761D6478BD642F)
_BYTE_VALUE = mix(np.arange(1, 257, dtype=np.uint64) * _U(0x9E3779B97F4A7C15))


def text_chunks(column: pa.Array, max_bytes: int = CHUNK_BYTES) -> Iterator[tuple[int, pa.Array]]:
    """(first row, rows) of consecutive runs of texts holding about ``max_bytes``."""
    n = len(column)
    if not n:
        return
    ends = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    lo = 0
    while lo < n:
        base = ends[lo - 1] if lo else 0
        hi = max(lo + 1, int(np.searchsorted(ends, base + max_bytes, side="right")))
        yield lo, column.slice(lo, hi - lo)
        lo = hi


class Words:
    """The words of a run of texts (null: no words).

    data   bytes of all texts, one after another
    start, end   byte bounds of each word in ``data``
    doc    row of each word; first   words before each row (len rows + 1)
    """

    def __init__(self, texts: pa.Array, lower: bool = False):
        texts = pc.fill_null(texts.cast(pa.large_binary()), b"")
        n = len(texts)
        _, offsets, data = texts.buffers()
        at = np.frombuffer(offsets, np.int64, n + 1, texts.offset * 8) if n else np.zeros(1, np.int64)
        raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
        self.data = raw[at[0]:at[-1]]
        self.bounds = at - at[0]
        if lower:
            self.data = _LOWER[self.data]
        solid = ~_SEPARATOR[self.data]
        size = len(solid)
        opens, closes = solid.copy(), solid.copy()
        if size:
            opens[1:] &= ~solid[:-1]
            closes[:-1] &= ~solid[1:]
            inner = self.bounds[1:-1]
            at_start = inner[inner < size]
            opens[at_start] |= solid[at_start]
            before = inner[inner > 0] - 1
            closes[before] |= solid[before]
        self.start = np.flatnonzero(opens)
        self.end = np.flatnonzero(closes) + 1
        self.first = np.searchsorted(self.start, self.bounds)
        self.rows = n
        self.counts = np.diff(self.first)
        self.doc = np.repeat(np.arange(n), self.counts)
        self.solid = solid

    def hashes(self) -> np.ndarray:
        """64-bit hash of each word (depends on its bytes and nothing else)."""
        up, down = _BYTES.upto(len(self.data) + 1)
        total = np.zeros(len(self.data) + 1, np.uint64)
        np.cumsum(_BYTE_VALUE[self.data] * up[:-1], out=total[1:])
        return mix((total[self.end] - total[self.start]) * down[self.start])

    def at(self) -> np.ndarray:
        """Place of each word in its row, from 0."""
        return np.arange(len(self.start)) - self.first[self.doc]

    def room(self, n: int) -> np.ndarray:
        """For each word: do ``n`` words of its row begin here?"""
        return np.arange(len(self.start)) + n <= self.first[self.doc + 1]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """M^0.. and M^-0.. of ``sequence_hashes``, ``n`` of each."""
    return _WORDS.upto(n)


def sequence_hashes(words: np.ndarray, n: int, second: bool = False) -> np.ndarray:
    """Hash of each run of ``n`` consecutive values (len(words) - n + 1 of them; rows are not looked at)."""
    if len(words) < n:
        return np.zeros(0, np.uint64)
    up, down = (_WORDS2 if second else _WORDS).upto(len(words) + 1)
    total = np.zeros(len(words) + 1, np.uint64)
    np.cumsum(words * up[:-1], out=total[1:])
    k = len(words) - n + 1
    return mix((total[n:] - total[:k]) * down[:k])


def sliding_min(x: np.ndarray, n: int) -> np.ndarray:
    """Least of each run of ``n`` consecutive values, by doubling."""
    width = 1
    while 2 * width <= n:
        x = np.minimum(x[:-width], x[width:])
        width *= 2
    rest = n - width
    return np.minimum(x[:len(x) - rest], x[rest:]) if rest else x


def signed(x: np.ndarray) -> np.ndarray:
    """The same 64 bits as int64, for a Spark long."""
    return x.view(np.int64)
