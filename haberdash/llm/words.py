"""Words of whole texts as 64-bit hashes, batch by batch, in numpy.

A batch of texts is one byte buffer. Words are runs of bytes of a class, cut at
text borders; a word's hash is a polynomial over its bytes, read off one prefix
sum, so the cost is a few passes over the buffer and no Python loop per word.
UTF-8 keeps bytes of other letters above 0x7F, so byte classes are code point classes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

# Bytes of text handled at once; a single longer text is handled alone.
SLICE_BYTES = 1 << 18

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)
_STEP = 0xD1342543DE82EF95 | 1
_STEP_INVERSE = pow(_STEP, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection on 64-bit values that spreads every bit."""
    x = x ^ (x >> _U(33))
    x = x * _U(0xFF51AFD7ED558CCD)
    x = x ^ (x >> _U(33))
    x = x * _U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> _U(33))


_BYTE = mix(np.arange(1, 257, dtype=_U))

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20

# Everything but ASCII white space.
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[0x20, *range(0x09, 0x0E)]] = False

# Digits, lower-case letters and everything beyond ASCII.
ALNUM = np.zeros(256, bool)
ALNUM[0x30:0x3A] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True

_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    """base ** 0 … base ** (n - 1), modulo 2 ** 64."""
    known = _powers.get(base)
    if known is None or len(known) < n:
        size = max(n, 1 << 16)
        known = np.full(size, base, _U)
        known[0] = 1
        known = np.multiply.accumulate(known)
        _powers[base] = known
    return known[:n]


@dataclass
class Words:
    """Words of some texts: hash, bytes from start to end, and text number."""

    hash: np.ndarray
    start: np.ndarray
    end: np.ndarray
    text: np.ndarray
    bounds: np.ndarray
    """Words of text i are bounds[i] up to bounds[i + 1]."""
    data: np.ndarray
    """The bytes, as they were hashed."""

    def windows(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Position of the first word and hash of each run of ``size`` words of one text."""
        n = len(self.hash) - size + 1
        if n <= 0:
            return np.zeros(0, np.int64), np.zeros(0, _U)
        whole = np.flatnonzero(self.text[:n] == self.text[size - 1 :])
        return whole, run_hash(self.hash, whole, size)


def run_hash(hashes: np.ndarray, first: np.ndarray, size: int | np.ndarray) -> np.ndarray:
    """Hash of ``size`` consecutive hashes from each position of ``first``."""
    sums = np.zeros(len(hashes) + 1, _U)
    np.cumsum(hashes * _power(_STEP, len(hashes)), out=sums[1:])
    run = (sums[first + size] - sums[first]) * _power(_STEP_INVERSE, len(hashes) + 1)[first]
    return mix(run + np.atleast_1d(np.asarray(size, _U)) * _U(_BASE))


def slices(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """First row, last row, bytes and byte offsets of parts of a text column; NULL is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    if not len(column):
        return
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    row = 0
    while row < len(column):
        last = int(np.searchsorted(offsets, offsets[row] + SLICE_BYTES, "right")) - 1
        last = min(max(last, row + 1), len(column))
        part = offsets[row : last + 1]
        yield row, last, data[part[0] : part[-1]], part - part[0]
        row = last


def word_edges(data: np.ndarray, offsets: np.ndarray, kind: np.ndarray = NOT_SPACE) -> tuple[np.ndarray, np.ndarray]:
    """First byte, and the byte after the last, of each word of texts that lie one after the other in ``data``."""
    n = len(data)
    inside = np.zeros(n + 2, bool)
    inside[1:-1] = kind[data]
    fresh = inside[1:] & ~inside[:-1]
    over = inside[:-1] & ~inside[1:]
    # A text border inside a run of word bytes ends one word and starts another.
    border = offsets[1:-1][(offsets[1:-1] > 0) & (offsets[1:-1] < n)]
    border = border[inside[border] & inside[border + 1]]
    fresh[border] = True
    over[border] = True
    return np.flatnonzero(fresh[:n]), np.flatnonzero(over)


def split_words(
    data: np.ndarray, offsets: np.ndarray, kind: np.ndarray = NOT_SPACE, lower: bool = True
) -> Words:
    """The words of texts that lie one after the other in ``data``, with A-Z lower-cased unless told not to."""
    n = len(data)
    data = _LOWER[data] if lower else data
    start, end = word_edges(data, offsets, kind)
    sums = np.zeros(n + 1, _U)
    np.cumsum(_BYTE[data] * _power(_BASE, n), out=sums[1:])
    run = (sums[end] - sums[start]) * _power(_BASE_INVERSE, n + 1)[start]
    hashes = mix(run + (end - start).astype(_U))
    bounds = np.searchsorted(start, offsets)
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(bounds))
    return Words(hashes, start, end, text, bounds, data)


def signed(x: np.ndarray) -> np.ndarray:
    """The same bits as Spark's long."""
    return np.ascontiguousarray(x, _U).view(np.int64)


def unsigned(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x, np.int64).view(_U)
