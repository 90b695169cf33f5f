"""Word shingles as sets of 64-bit hashes."""

from __future__ import annotations

import numpy as np
import xxhash

#: Words of a shingle.
WORDS = 5
#: Word hashes that a worker remembers; cleared beyond it.
MAX_WORDS = 100_000

_STEP = np.uint64(0x9E3779B97F4A7C15)


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= MAX_WORDS:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


_HASHES = _Hashes()


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_set(text: str) -> np.ndarray:
    """Sorted distinct hashes of the text's 5-word shingles (A-Z lower-cased,
    words split at ASCII white space); with fewer words, of the whole
    sequence; none without words."""
    words = text.encode().lower().split()
    n = len(words)
    if not n:
        return np.zeros(0, dtype=np.uint64)
    h = np.fromiter(map(_HASHES.__getitem__, words), dtype=np.uint64, count=n)
    width = min(n, WORDS)
    m = n - width + 1
    with np.errstate(over="ignore"):
        acc = np.full(m, width, dtype=np.uint64)
        for k in range(width):
            acc = mix(acc * _STEP + h[k : k + m]) if k == width - 1 else acc * _STEP + h[k : k + m]
    acc.sort()
    return acc[np.concatenate([[True], acc[1:] != acc[:-1]])]
