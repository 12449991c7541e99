"""Rolling hashes of byte strings as array operations.

The hash of bytes s to e is sum(T[b_i] * B^(i-s)) modulo 2^64, from prefix sums; a final
mix spreads it over all bits.  T is a table of random numbers, B is odd and so has an
inverse.
"""

from __future__ import annotations

import numpy as np

_RNG = np.random.default_rng(20_240_501)
_TABLE = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    """base^0 .. base^(n-1), kept and doubled as needed."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = 1 << max(16, (n - 1).bit_length())
        have = np.full(size, np.uint64(base), np.uint64)
        have[0] = 1
        np.multiply.accumulate(have, out=have)
        _powers[base] = have
    return have[:n]


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def prefix(data: np.ndarray) -> np.ndarray:
    """Prefix sums for ranges(): one more than the bytes."""
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_TABLE[data] * _power(_BASE, len(data)), out=out[1:])
    return out


def ranges(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of the bytes from start to end."""
    return mixed((sums[end] - sums[start]) * _power(_INVERSE, len(sums))[start])


def rolling(sums: np.ndarray, width: int) -> np.ndarray:
    """Hashes of all windows of that many bytes."""
    n = len(sums) - width
    if n <= 0:
        return np.zeros(0, np.uint64)
    return mixed((sums[width:] - sums[:-width]) * _power(_INVERSE, n))
