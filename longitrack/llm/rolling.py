"""Rolling hashes of byte strings and of sequences of token hashes."""

from __future__ import annotations

import numpy as np

_rng = np.random.default_rng(20240101)
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_powers: dict[str, np.ndarray] = {}


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base modulo 2^64, and of its inverse."""
    if len(_powers.get("up", ())) < n:
        n = max(n, 1 << 16)
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            out = np.ones(n, np.uint64)
            out[1:] = np.uint64(base)
            _powers[name] = np.multiply.accumulate(out)
    return _powers["up"][:n], _powers["down"][:n]


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


def sums(data: np.ndarray) -> np.ndarray:
    """Prefix sums from which the hash of any substring follows; data are bytes, or hashes of tokens."""
    up, _ = _power(len(data) + 1)
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((_BYTE[data] if data.dtype == np.uint8 else data) * up[: len(data)], out=out[1:])
    return out


def windows_hash(hashes: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of the substrings [start, end)."""
    _, down = _power(len(hashes))
    return mix((hashes[end] - hashes[start]) * down[start] + (end - start).astype(np.uint64))
