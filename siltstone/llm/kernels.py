"""NumPy kernels shared by the text operators.

Every function works on one Arrow batch of whole texts, laid end to end as
UTF-8 bytes. Hashes are 64-bit polynomial hashes with wrap-around arithmetic:
``H(b[s:e]) = sum(T[b[j]] * B**(j - s))``. They are equal in every process
because the tables come from a fixed seed.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

_RNG = np.random.Generator(np.random.PCG64(20240607))
#: A random odd value for each byte value.
BYTE_VALUE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
BASE = 0x9E3779B97F4A7C15 | 1
BASE_INVERSE = pow(BASE, -1, 1 << 64)
_STEP = 1 << 16

#: Bytes that belong to a word when words are runs of anything but \x20 and \x09-\x0D.
SPACED = np.ones(256, bool)
SPACED[[0x20, *range(0x09, 0x0E)]] = False
#: Bytes that belong to a word when words are ASCII letters, digits and all non-ASCII text.
ALNUM = np.zeros(256, bool)
ALNUM[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
#: Lower-cases A-Z alone.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32
_LOWER_VALUE = BYTE_VALUE[LOWER]


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_POW, _INV = _powers(BASE, _STEP), _powers(BASE_INVERSE, _STEP)
_POW_STEP, _INV_STEP = pow(BASE, _STEP, 1 << 64), pow(BASE_INVERSE, _STEP, 1 << 64)


def powers(at: np.ndarray, inverse: bool = False) -> np.ndarray:
    """``BASE ** at`` (or its inverse) for non-negative positions."""
    small, step = (_INV, _INV_STEP) if inverse else (_POW, _POW_STEP)
    if not len(at):
        return np.zeros(0, np.uint64)
    if (top := int(at.max())) < _STEP:
        return small[at]
    large = _powers(step, top // _STEP + 1)
    return large[at // _STEP] * small[at % _STEP]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection on 64 bits that spreads every input bit."""
    h = h ^ (h >> np.uint64(33))
    h *= np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(32)
    return h


def laid_out(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts, and where each begins (one more entry than texts); null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, ends, data = column.buffers()
    at = np.frombuffer(ends, np.int64)[column.offset : column.offset + len(column) + 1]
    whole = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    return whole, at - at[0]


def blocks(at: np.ndarray, most: int = 1 << 20) -> list[tuple[int, int]]:
    """Ranges of whole texts of about ``most`` bytes; a longer text is a range of its own."""
    out, first = [], 0
    n = len(at) - 1
    while first < n:
        last = int(np.searchsorted(at, at[first] + most, side="right")) - 1
        last = min(max(last, first + 1), n)
        out.append((first, last))
        first = last
    return out


def prefix_hash(data: np.ndarray, lower: bool = False) -> np.ndarray:
    """Running sums whose differences are hashes of substrings, see substring_hash()."""
    value = (_LOWER_VALUE if lower else BYTE_VALUE)[data]
    value *= powers(np.arange(len(data)))
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(value, out=out[1:])
    return out


def substring_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    return (sums[end] - sums[start]) * powers(start, inverse=True)


def words(data: np.ndarray, at: np.ndarray, kind: np.ndarray, lower: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and hashes of the words of some texts, and where each text's words begin."""
    inside = kind[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    edge = at[1:-1]
    edge = edge[(edge > 0) & (edge < len(data))]
    first[edge] = inside[edge]
    last[edge - 1] = inside[edge - 1]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    h = mix(substring_hash(prefix_hash(data, lower), start, end))
    return start, end, h, np.searchsorted(start, at)


_SLOT = _RNG.integers(1, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingles(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of ``n`` words, given the words' hashes."""
    if len(h) < n:
        return np.zeros(0, np.uint64)
    out = h[: len(h) - n + 1] * _SLOT[0]
    for i in range(1, n):
        out += np.bitwise_xor(h[i : len(h) - n + 1 + i], h[i : len(h) - n + 1 + i] >> np.uint64(31)) * _SLOT[i % 64]
    return mix(out)


def shingle_set(h: np.ndarray, n: int) -> np.ndarray:
    """The sorted set of a text's shingles; with fewer than ``n`` words, the whole sequence as one; empty without words."""
    if not len(h):
        return h
    return np.unique(shingles(h, min(n, len(h)))) if len(h) >= n else mix(shingles(h, len(h)) + np.uint64(len(h)))
