"""The contracts in plain Python, for small tables."""

import re
from collections import defaultdict


def repeated_spans(texts: list[bytes], match: int = 100) -> list[list[tuple[int, int]]]:
    """Spans covered by strings that start earlier, for texts in order."""
    seen, out = set(), []
    for data in texts:
        spans: list[list[int]] = []
        for s in range(len(data) - match + 1):
            window = data[s : s + match]
            if window in seen:
                if spans and spans[-1][1] >= s:
                    spans[-1][1] = s + match
                else:
                    spans.append([s, s + match])
            seen.add(window)
        out.append([(a, b) for a, b in spans])
    return out


def shingle_set(text: str | None) -> frozenset:
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if len(words) < 5:
        return frozenset([tuple(words)] if words else [])
    return frozenset(tuple(words[i : i + 5]) for i in range(len(words) - 4))


def components(texts: list[str | None]) -> list[int]:
    """The first text that each one reaches by links of 0.75 and more."""
    sets = [shingle_set(t) for t in texts]
    holders = defaultdict(list)
    for i, s in enumerate(sets):
        for x in s:
            holders[x].append(i)
    root = list(range(len(sets)))

    def find(i: int) -> int:
        while root[i] != i:
            i = root[i]
        return i

    for i, s in enumerate(sets):
        both = defaultdict(int)
        for x in s:
            for j in holders[x]:
                if j < i:
                    both[j] += 1
        for j, n in both.items():
            if 100 * n >= 75 * (len(s) + len(sets[j]) - n):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [find(i) for i in range(len(sets))]
