"""Plain Python versions of what the operators compute."""

from __future__ import annotations

import re

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def words(text: str | None) -> list[bytes]:
    return WORD.findall((text or "").encode())


def lowered(text: str | None) -> list[bytes]:
    return WORD.findall(bytes(c + 32 if 65 <= c <= 90 else c for c in (text or "").encode()))


def repeated(rows: list[tuple[int, str | None]], length: int) -> dict[int, list[bool]]:
    """Of each document, which words windows cover that start earlier elsewhere."""
    first: dict[tuple, tuple] = {}
    own = {d: words(t) for d, t in rows}
    for d in sorted(own):
        for i in range(len(own[d]) - length + 1):
            first.setdefault(tuple(own[d][i : i + length]), (d, i))
    out = {}
    for d, w in own.items():
        gone = [False] * len(w)
        for i in range(len(w) - length + 1):
            if first[tuple(w[i : i + length])] != (d, i):
                gone[i : i + length] = [True] * length
        out[d] = gone
    return out


def groups(n: int, links) -> list[int]:
    """The smallest member that each of 0..n-1 reaches."""
    up = list(range(n))

    def top(x: int) -> int:
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a, b in links:
        a, b = top(a), top(b)
        up[max(a, b)] = min(a, b)
    return [top(x) for x in range(n)]


def shingles(text: str | None, k: int) -> set:
    w = lowered(text)
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def distance_within(item: bytes, text: bytes) -> int:
    """Fewest edits from ``item`` to any part of ``text``."""
    row = [0] * (len(text) + 1)
    for i, c in enumerate(item, 1):
        last, row = row, [i] + [0] * len(text)
        for j, d in enumerate(text, 1):
            row[j] = min(last[j - 1] + (c != d), last[j] + 1, row[j - 1] + 1)
    return min(row)
