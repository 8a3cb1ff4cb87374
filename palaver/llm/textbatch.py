"""Whole texts of an Arrow batch as flat byte arrays, and the words in them.

Texts are handled as UTF-8 bytes: word separators and the letters that are lower-cased are ASCII, so bytes give the same
words as characters. Batches are taken in pieces of about a megabyte, so that the working arrays stay small; a text longer
than that is a piece of its own.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa

PIECE_BYTES = 1 << 20
POLYNOMIAL_BYTES = 256
WORD = np.ones(256, dtype=bool)
WORD[[0x20, *range(0x09, 0x0E)]] = False
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_rng = np.random.Generator(np.random.PCG64(20240501))
_TABLE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = pow(0x9E3779B97F4A7C15 | 1, 3, 2**64) | 1
_INVERSE = pow(_BASE, -1, 2**64)
_powers: dict[int, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def _power(base: int, n: int) -> np.ndarray:
    have = _powers.get(base)
    if have is None or len(have) < n:
        steps = np.full(max(n, PIECE_BYTES), base, dtype=np.uint64)
        steps[0] = 1
        have = np.multiply.accumulate(steps)
        if len(have) <= 2 * PIECE_BYTES:
            _powers[base] = have
    return have


def pieces(column: pa.Array, limit: int = PIECE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) over the texts of a column; a null text is empty."""
    if pa.types.is_null(column.type):
        column = column.cast(pa.string())
    column = column.fill_null("") if column.null_count else column
    column = column.cast(pa.large_string())
    n = len(column)
    if n == 0:
        return
    _, offset_buffer, data_buffer = column.buffers()
    offsets = np.frombuffer(offset_buffer, dtype=np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(data_buffer, dtype=np.uint8) if data_buffer is not None and data_buffer.size else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, side="right")) - 1)
        hi = min(hi, n)
        yield lo, hi, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        lo = hi


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and text number of every word; a word never goes over the end of its text."""
    inside = WORD[data]
    filled = offsets[:-1][offsets[1:] > offsets[:-1]]
    before = np.empty_like(inside)
    before[1:] = inside[:-1]
    before[filled] = False
    after = np.empty_like(inside)
    after[:-1] = inside[1:]
    if len(data):
        after[np.append(filled[1:], len(data)) - 1] = False
    starts = np.flatnonzero(inside & ~before)
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(offsets[1:], starts, side="right")


def span_hashes(lowered: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each byte span, equal for equal bytes.

    A polynomial modulo 2^64 has different long texts of one value by its structure (from about a thousand bytes on), so spans
    over ``POLYNOMIAL_BYTES`` are digested one by one.
    """
    n = len(lowered)
    sums = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(_TABLE[lowered] * _power(_BASE, n)[:n], out=sums[1:])
    whole = (sums[ends] - sums[starts]) * _power(_INVERSE, n + 1)[starts]
    out = mix(whole + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    for i in np.flatnonzero(ends - starts > POLYNOMIAL_BYTES).tolist():
        out[i] = int.from_bytes(blake2b(lowered[starts[i] : ends[i]].tobytes(), digest_size=8).digest(), "little")
    return out


def shingles(word_hashes: np.ndarray, size: int = 5) -> np.ndarray:
    """Distinct hashes of the runs of ``size`` words, ascending; a shorter text is one run; none without words."""
    n = len(word_hashes)
    if n == 0:
        return np.zeros(0, dtype=np.uint64)
    width = min(n, size)
    out = np.zeros(n - width + 1, dtype=np.uint64)
    for j in range(width):
        out += word_hashes[j : n - width + 1 + j] * np.uint64((0xA24BAED4963EE407 * (2 * j + 3)) % 2**64 | 1)
    return np.unique(mix(out + np.uint64(width)))
