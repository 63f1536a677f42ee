"""Plain Python versions of what the operators must return."""

from __future__ import annotations

import re
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")
UP, LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
FOLD = str.maketrans(UP, LOW)


def shingle_set(text: str | None, n: int) -> frozenset:
    w = WORD.findall((text or "").translate(FOLD))
    return frozenset(tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))) if w else frozenset()


def near_components(docs: list[tuple[int, str | None]], n: int, percent: int) -> dict[int, int]:
    sets = {d: shingle_set(t, n) for d, t in docs}
    parent = {d: d for d in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    filed = defaultdict(list)
    for d in sorted(sets):
        for e in {e for g in sets[d] for e in filed[g]}:
            both = len(sets[d] & sets[e])
            if 100 * both >= percent * (len(sets[d]) + len(sets[e]) - both):
                a, b = root(d), root(e)
                parent[max(a, b)] = min(a, b)
        for g in sets[d]:
            filed[g].append(d)
    return {d: root(d) for d in sets}


def counts(text: str | None) -> tuple[int, ...]:
    text = text or ""
    w = WORD.findall(text)
    threes = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    repeated = {j for i in range(len(w) - 2) if threes[tuple(w[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(repeated)


def drop_lines(docs: list[tuple[int, str | None]]) -> list[tuple[int, str]]:
    spaces = " \t\n\x0b\x0c\r"
    held = defaultdict(set)
    for d, t in docs:
        for line in (t or "").split("\n"):
            held[line.strip(spaces).translate(FOLD)].add(d)
    hot = {k: max(v) for k, v in held.items() if len(k) >= 40 and len(v) >= 5}
    return [(d, "\n".join(x for x in (t or "").split("\n") if hot.get(x.strip(spaces).translate(FOLD), d) == d)) for d, t in docs]


def edit_distance_inside(item: str, text: str) -> int:
    """Least distance of the whole item to any part of the text."""
    row = [0] * (len(text) + 1)
    for i, a in enumerate(item, 1):
        new = [i]
        for j, b in enumerate(text, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (a != b)))
        row = new
    return min(row)
