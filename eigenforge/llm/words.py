"""Splitting and hashing of words in Python workers."""

from __future__ import annotations

import gc
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import xxhash

#: Entries that a worker keeps at most in a cache of words; a full cache starts anew.
CACHE_LIMIT = 1_400_000
#: The same for hashes, of which a task has its own.
HASH_LIMIT = 300_000

_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


class HashCache(dict):
    """Word bytes to a 64-bit hash; bounded, so a worker's memory does not follow the corpus."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= HASH_LIMIT:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finalizer of 64-bit values (splitmix64)."""
    x = x ^ (x >> np.uint64(30))
    x = x * _M1
    x = x ^ (x >> np.uint64(27))
    x = x * _M2
    return x ^ (x >> np.uint64(31))


def ascii_words(text: str | None) -> list[bytes]:
    """Words of [^\\x20\\x09-\\x0D]+ with A-Z in lower case: just what bytes.split and bytes.lower do."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


@contextmanager
def no_gc() -> Iterator[None]:
    """No cyclic collections while many small objects are made that hold no cycles."""
    on = gc.isenabled()
    gc.disable()
    try:
        yield
    finally:
        if on:
            gc.enable()
