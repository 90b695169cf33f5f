"""Plain versions of the operators, over lists in memory."""

from __future__ import annotations

import re
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lowered(text: str) -> str:
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


def shingles(text: str) -> frozenset:
    words = WORD.findall(lowered(text))
    n = len(words)
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, n - 4))) if n else frozenset()


def near_groups(rows: list[tuple[int, str]]) -> dict[int, tuple[int, int, bool]]:
    sets = {d: shingles(t or "") for d, t in rows}
    parent = {d: d for d in sets}

    def find(x: int) -> int:
        while parent[x] != x:
            x = parent[x]
        return x

    index = defaultdict(list)
    for d, s in sorted(sets.items()):
        shared = Counter(o for g in s for o in index[g])
        for o, k in shared.items():
            if 100 * k >= 75 * (len(s) + len(sets[o]) - k):
                a, b = find(d), find(o)
                parent[max(a, b)] = min(a, b)
        for g in s:
            index[g].append(d)
    return {d: (len(s), find(d), find(d) == d) for d, s in sets.items()}


def without_repeats(rows: list[tuple[int, str]], width: int = 100) -> dict[int, tuple[int, int, int, bytes]]:
    first: dict[bytes, tuple[int, int]] = {}
    out = {}
    for d, t in sorted(rows):
        raw = (t or "").encode()
        gone = [False] * len(raw)
        for i in range(len(raw) - width + 1):
            w = raw[i : i + width]
            if first.setdefault(w, (d, i)) != (d, i):
                gone[i : i + width] = [True] * width
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        out[d] = (len(raw), sum(gone), spans, bytes(b for b, g in zip(raw, gone, strict=True) if not g))
    return out


PII = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        v = int(c) * (1 + i % 2)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


def pii(text: str) -> list[tuple[str, int, int]]:
    out = []
    for kind, pattern in PII.items():
        for m in pattern.finditer(text):
            digits = re.sub("[^0-9]", "", m[0])
            good = {
                "email": lambda m=m: True,
                "ip": lambda m=m: all(int(p) <= 255 for p in m[0].split(".")),
                "card": lambda d=digits: 16 <= len(d) <= 19 and luhn(d),
                "phone": lambda d=digits: 8 <= len(d) <= 15,
            }[kind]
            if good():
                out.append((kind, m.start(), m.end()))
    return out


def quality(text: str) -> tuple[int, int, int, int, int, bool]:
    words = WORD.findall(text)
    n = len(words)
    windows = Counter(tuple(words[i : i + 5]) for i in range(n - 4))
    hit = set()
    for i in range(n - 4):
        if windows[tuple(words[i : i + 5])] > 1:
            hit.update(range(i, i + 5))
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    symbols = sum(c in "#*$%&|<>" for c in text)
    return n, sum(map(len, words)), symbols, dup, len(hit), n < 10 or 100 * len(hit) > 20 * n
