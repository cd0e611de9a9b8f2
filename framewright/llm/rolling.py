"""Hashes of stretches of bytes by two look-ups each, and smallest values of sliding windows."""

from __future__ import annotations

import numpy as np

_rng = np.random.Generator(np.random.PCG64(20_250_102))
#: Two independent polynomial hashes modulo 2**64 over random values of the bytes.
VALUES = _rng.integers(0, 2**64, (2, 256), np.uint64)
BASES = _rng.integers(0, 2**63, 2, np.uint64) * np.uint64(2) + np.uint64(1)
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _power(k: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of base k and of its inverse modulo 2**64, n at least."""
    if k not in _powers or len(_powers[k][0]) < n:
        size = max(n, 1 << 16)
        inverse = np.uint64(pow(int(BASES[k]), -1, 2**64))
        _powers[k] = tuple(np.multiply.accumulate(np.concatenate(([np.uint64(1)], np.full(size - 1, b, np.uint64)))) for b in (BASES[k], inverse))
    return _powers[k]


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def prefix_hash(data: np.ndarray, k: int) -> np.ndarray:
    """Sums by which the hash of any stretch is two look-ups: see stretch()."""
    up, _ = _power(k, len(data))
    return np.concatenate(([np.uint64(0)], np.cumsum(VALUES[k][data] * up[: len(data)], dtype=np.uint64)))


def stretch(sums: np.ndarray, k: int, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of data[start:end], the same wherever the stretch stands."""
    _, down = _power(k, len(sums))
    return mix((sums[end] - sums[start]) * down[start] + (end - start).astype(np.uint64))


def smallest(key: np.ndarray, w: int) -> np.ndarray:
    """Smallest of each w values in a row, by running minima of blocks from both sides."""
    n = len(key)
    padded = np.concatenate((key, np.full(-n % w, np.iinfo(key.dtype).max, key.dtype))).reshape(-1, w)
    ahead = np.minimum.accumulate(padded, axis=1).ravel()
    back = np.minimum.accumulate(padded[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[: n - w + 1], ahead[w - 1 : n])
