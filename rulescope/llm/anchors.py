"""Stretches of text around content-chosen anchors.

Every window of ``WINDOW`` bytes has an anchor: the position of the smallest
hash among its ``GRAM``-byte strings (the leftmost of equal ones).  Equal windows have
equal anchors at equal offsets, so a window can only repeat among windows
whose anchor strings are equal.  A *stretch* is a run of neighbouring windows
with one anchor; it is named by the hash of its anchor's string, ``cls``, and
the hash of its own bytes, ``key``.
"""

from __future__ import annotations

import numpy as np

from rulescope.llm.shingles import mix

WINDOW, GRAM = 100, 28
#: Bytes hashed at a time.
BUFFER = 1 << 19
_POS = np.uint64(BUFFER - 1)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.ones(n, dtype=np.uint64)
    k = 1
    while k < n:  # out[k:2k] = out[:k] * base ** k
        out[k : 2 * k] = out[: min(k, n - k)] * np.uint64(pow(base, k, 1 << 64))
        k *= 2
    return out


class Hasher:
    """Rolling 64-bit hashes of all substrings of a buffer."""

    def __init__(self):
        base = 0xD1342543DE82EF95
        self.up = _powers(base, BUFFER + 1)
        self.down = _powers(pow(base, -1, 1 << 64), BUFFER + 1)
        self.code = mix(np.arange(1, 257, dtype=np.uint64))

    def prefix(self, raw: np.ndarray) -> np.ndarray:
        out = np.zeros(len(raw) + 1, dtype=np.uint64)
        np.cumsum(self.code[raw] * self.up[: len(raw)], out=out[1:])
        return out

    def spans(self, prefix: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        return mix((prefix[hi] - prefix[lo]) * self.down[lo])


def stretches(hasher: Hasher, raw: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, ...]:
    """(cls, key, at, n) of the stretches of a buffer of at most ``BUFFER``
    bytes that holds texts beginning at ``starts`` (ascending, from 0)."""
    none = np.zeros(0, dtype=np.int64)
    if len(raw) < WINDOW:
        return none, none, none, none
    prefix = hasher.prefix(raw)
    n = len(raw) - GRAM + 1
    grams = mix((prefix[GRAM:] - prefix[:n]) * hasher.down[:n])
    low = (grams & ~_POS) | np.arange(n, dtype=np.uint64)
    width, span = 1, WINDOW - GRAM + 1
    while 2 * width <= span:
        low = np.minimum(low[:-width], low[width:])
        width *= 2
    if span > width:
        low = np.minimum(low[: len(low) - (span - width)], low[span - width :])
    anchor = (low & _POS).astype(np.int64)
    ends = np.append(starts[1:], len(raw))
    inside = np.zeros(len(raw) + 1, dtype=np.int8)
    long = ends - starts >= WINDOW
    np.add.at(inside, starts[long], 1)
    np.add.at(inside, ends[long] - WINDOW + 1, -1)
    at = np.flatnonzero(np.cumsum(inside[: len(anchor)], dtype=np.int8))
    if not len(at):
        return none, none, none, none
    a = anchor[at]
    cut = np.flatnonzero(np.concatenate([[True], a[1:] != a[:-1]]))
    count = np.diff(np.append(cut, len(a)))
    first = at[cut]
    key = hasher.spans(prefix, first, first + count + WINDOW - 1) ^ mix(count.astype(np.uint64))
    return grams[a[cut]].view(np.int64), key.view(np.int64), first, count
