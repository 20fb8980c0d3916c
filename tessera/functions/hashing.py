"""Hashes of spans of bytes for functions that tasks run, vectorized over spans."""

from __future__ import annotations

import sys

import numpy as np


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer (xor-shift, multiply), elementwise."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


# An odd 64-bit base for polynomial hashes, and its inverse modulo 2**64.
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)


def kept(name: str, make):
    """A worker process's own copy of something costly. Functions are pickled by value, so module globals don't outlive a task; this does."""
    store = sys.__dict__.setdefault("_tessera_kept", {})
    if name not in store:
        store[name] = make()
    return store[name]


#: Texts are hashed in stretches of at most so many bytes, so a worker's tables of powers stay small.
STRETCH = 1 << 19


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64, kept and grown by doubling."""
    tables = kept("powers", dict)
    have = tables.get(base)
    if have is None or len(have) < n:
        have = np.full(1 << max(12, (n - 1).bit_length()), base, np.uint64)
        have[0] = 1
        have = np.cumprod(have, dtype=np.uint64)
        if n <= 4 * STRETCH:
            tables[base] = have
    return have[:n]


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """S with S[0] = 0, such that ``(S[e] - S[s]) * BASE**e`` depends on data[s:e] alone, wherever it lies (see ``span_hash``)."""
    s = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers(INVERSE, len(data)), out=s[1:])
    return s


def span_hash(s: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of data[start:end], vectorized over spans; ``s`` is ``prefix_hash(data)``."""
    return mix64((s[end] - s[start]) * powers(BASE, len(s))[end])
