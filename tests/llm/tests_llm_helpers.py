"""Near-duplicate classes by brute force."""

from __future__ import annotations

from collections import Counter


def bag(text):
    w = (text or "").split()
    return Counter(zip(*(w[k:] for k in range(5)), strict=False)) if len(w) >= 5 else Counter([tuple(w)] if w else [])


def classes(rows):
    items = {i: bag(t) for i, t in rows}
    name = {i: i for i in items}

    def top(x):
        while name[x] != x:
            x = name[x]
        return x

    for a in items:
        for b in items:
            if a < b and items[a] and items[b]:
                if sum((items[a] & items[b]).values()) >= 0.8 * sum((items[a] | items[b]).values()):
                    x, y = sorted((top(a), top(b)))
                    name[y] = x
    return {i: top(i) for i in items}
