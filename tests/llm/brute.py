"""Plain versions of what the queries promise."""

from __future__ import annotations

import re
from collections import Counter

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def _card(value: str) -> bool:
    digits = re.sub("[^0-9]", "", value)
    return 14 <= len(digits) <= 19 and luhn(digits)


PII = (
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda v: True),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda v: all(int(p) <= 255 for p in v.split("."))),
    ("card", r"[0-9]([\x20-]?[0-9])+", _card),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda v: 10 <= len(re.sub("[^0-9]", "", v)) <= 15),
)


def base_spans(text: str | None) -> str:
    found = [
        (m.start(), rank, m.end(), kind)
        for rank, (kind, pattern, good) in enumerate(PII) for m in re.finditer(pattern, text or "") if good(m[0])]
    return ",".join(f"{kind}:{start}:{end}" for start, _, end, kind in sorted(found))


def measures(text: str | None) -> tuple[int, int, int, int, int]:
    text = text or ""
    words = WORD.findall(text)
    seen = Counter(zip(words, words[1:], words[2:]))
    covered: set[int] = set()
    for i in range(len(words) - 2):
        if seen[tuple(words[i:i + 3])] > 1:
            covered |= {i, i + 1, i + 2}
    lines = [line for line in text.split("\n") if WORD.search(line)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def components(links: list[tuple], nodes: list) -> dict:
    root = {n: n for n in nodes}

    def find(n):
        while root[n] != n:
            root[n] = root[root[n]]
            n = root[n]
        return n

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def targets(sizes: dict) -> dict:
    """Words per source by resharing the excess until no source is above three times its size."""
    sources = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: 1 + i % 3 for i, s in enumerate(sources)}
    total, capped = sum(sizes.values()), {}
    while True:
        left = [s for s in sources if s not in capped]
        level = (total - sum(capped.values())) / sum(weight[s] for s in left) if left else 0.0
        over = {s: 3.0 * sizes[s] for s in left if level * weight[s] > 3 * sizes[s]}
        if not over:
            return {s: capped.get(s, level * weight[s]) for s in sources}
        capped |= over
