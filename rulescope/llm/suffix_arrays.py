"""Suffix arrays in numpy: Larsson-Sadakane refinement and Kasai's prefixes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Places that are sorted at a time, or one larger group of equal ones.
PART = 1 << 18


def index_type(n: int) -> type:
    """The integers that hold three times ``n``."""
    return np.int32 if n < 1 << 29 else np.int64


def words_at(text: np.ndarray) -> np.ndarray:
    """The 8 bytes from every position as a big-endian integer (zero padded)."""
    padded = np.concatenate([text, np.zeros(8, np.uint8)])
    out = np.zeros(len(text), dtype=np.uint64)
    for k in range(8):
        out <<= np.uint64(8)
        out |= padded[k : k + len(text)]
    return out


def suffix_array(text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(suffixes in order, rank of each position) of a byte array.

    Starts from the order of 8-byte prefixes; each round sorts only the
    groups that are still equal, by the rank ``h`` further on, and doubles h.
    A round goes part by part: the finer ranks of earlier parts are in the same
    order, so later ones may use them.
    """
    n = len(text)
    kind = index_type(n)
    first = words_at(text)
    order = np.argsort(first, kind="stable").astype(kind)
    word = first[order]
    del first
    new = np.concatenate([[True], word[1:] != word[:-1]]) if n else np.zeros(0, bool)
    # Zero padding ties the last 8 suffixes with texts that hold zeros: they
    # are told apart below, where a suffix that has ended ranks lowest.
    del word
    heads = np.flatnonzero(new).astype(kind)
    rank = np.empty(n, dtype=kind)
    rank[order] = np.repeat(heads, np.diff(np.append(heads, n)))
    del new, heads
    if n and (text[max(0, n - 8) :] == 0).any() or n < 8:
        order, rank = (x.astype(kind) for x in _by_single_bytes(text))
        h = 1
    else:
        h = 8
    todo = _unsorted(rank[order]).astype(kind)
    while len(todo):
        for part in _parts(todo, rank[order[todo]]):
            at = order[part]
            behind = at + h
            nxt = np.where(behind < n, rank[np.minimum(behind, n - 1)], -1) + 1
            key = rank[at].astype(np.int64) * (n + 1) + nxt
            by = np.argsort(key, kind="stable")
            at, key = at[by], key[by]
            order[part] = at
            head = np.concatenate([[True], key[1:] != key[:-1]])
            start = np.flatnonzero(head)
            rank[at] = np.repeat(part[start], np.diff(np.append(start, len(at))))
        todo = todo[_unsorted(rank[order[todo]])]
        h *= 2
    return order, rank


def _parts(todo: np.ndarray, group: np.ndarray) -> Iterator[np.ndarray]:
    """``todo`` in parts of about ``PART`` places, none of them through a group."""
    lo = 0
    while lo < len(todo):
        hi = min(lo + PART, len(todo))
        hi = int(np.searchsorted(group, group[hi - 1], side="right"))
        yield todo[lo:hi]
        lo = hi


def _by_single_bytes(text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(text, kind="stable")
    sorted_text = text[order]
    heads = np.flatnonzero(np.concatenate([[True], sorted_text[1:] != sorted_text[:-1]]))
    rank = np.empty(len(text), dtype=np.int64)
    rank[order] = np.repeat(heads, np.diff(np.append(heads, len(text))))
    return order, rank


def _unsorted(group: np.ndarray) -> np.ndarray:
    """Indexes of members of groups of two or more."""
    if not len(group):
        return np.zeros(0, dtype=np.int64)
    same = group[1:] == group[:-1]
    return np.flatnonzero(np.concatenate([same, [False]]) | np.concatenate([[False], same]))


def common_prefixes(
    text: np.ndarray, order: np.ndarray, rank: np.ndarray, starts: np.ndarray, cap: int
) -> np.ndarray:
    """Kasai's algorithm: for each place in ``order`` the bytes (at most
    ``cap``) that its suffix shares with the one before it.

    Along a text, the prefix shrinks by one at most from a position to the
    next.  The stretches that begin at ``starts`` are walked side by side, a
    position of each at a time, and compared eight bytes at a time.
    """
    n = len(text)
    words = words_at(np.concatenate([text, np.zeros(cap + 8, np.uint8)]))
    before = np.full(n, -1, dtype=order.dtype)
    before[order[1:]] = order[:-1]
    out = np.zeros(n, dtype=np.int32)
    lengths = np.diff(np.append(starts, n))
    by = np.argsort(-lengths, kind="stable")
    starts, lengths = starts[by], lengths[by]
    shared = np.zeros(len(starts), dtype=np.int64)
    alive = len(starts)
    for t in range(int(lengths[0]) if len(lengths) else 0):
        alive = int(np.searchsorted(-lengths, -t, side="left"))
        p = starts[:alive] + t
        q = before[p]
        l = np.maximum(shared[:alive] - 1, 0)
        l[q < 0] = 0
        go = np.flatnonzero((q >= 0) & (l < cap))
        while len(go):
            x = words[p[go] + l[go]] ^ words[q[go] + l[go]]
            equal = x == 0
            l[go[equal]] += 8
            part = go[~equal]
            l[part] += (64 - np.frexp(x[~equal].astype(np.float64))[1]) >> 3
            go = go[equal]
            go = go[l[go] < cap]
        # Past the text's end there are only zeros: a shorter suffix stops.
        l = np.minimum(l, np.minimum(cap, n - np.maximum(p, q)))
        out[rank[p]] = l
        shared[:alive] = l
    return out
