"""Distinct word shingles of a text as sorted 64-bit hashes."""

from __future__ import annotations

import numpy as np
import xxhash

from .cache import Cache

_words = Cache(xxhash.xxh3_64_intdigest, 50_000)
_MIX, _SALT = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def mix(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit values over all 64 bits (in place)."""
    x ^= x >> np.uint64(32)
    x *= _SALT
    x ^= x >> np.uint64(32)
    x *= _SALT
    x ^= x >> np.uint64(32)
    return x


def shingle_set(text: str | bytes | None, size: int = 5) -> np.ndarray:
    """Sorted distinct hashes of the shingles of ``size`` words.

    Words are what ASCII white space parts once A-Z are lower case; a text of fewer words
    is one shingle, one without words has none.
    """
    found = (text.encode() if isinstance(text, str) else text or b"").lower().split()
    if not found:
        return np.empty(0, np.uint64)
    ids = np.fromiter(map(_words.__getitem__, found), np.uint64, len(found))
    size = min(size, len(ids))
    last = len(ids) - size + 1
    out = mix(ids[:last] + np.uint64(size))
    for k in range(1, size):
        out = mix(out * _MIX + ids[k : last + k])
    return np.unique(out)
