"""Plain loops that the operators are held against."""

import collections
import re

PLAIN = re.compile("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def shingles(text, width=3):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[i : i + width]) for i in range(len(w) - width + 1)) if len(w) >= width else frozenset([tuple(w)] if w else [])


def near_groups(rows, width=3, percent=90):
    """(id, text) rows -> {id: smallest id reachable}."""
    root = {i: i for i, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    sets = [(i, shingles(t, width)) for i, t in rows]
    for a, (i, x) in enumerate(sets):
        for j, y in sets[:a]:
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                p, q = find(i), find(j)
                root[max(p, q)] = min(p, q)
    return {i: find(i) for i, _ in rows}


def contamination(text, items):
    """(words, hit words, item ids) against [(item_id, text)]."""
    w = PLAIN.findall((text or "").translate(LOWER))
    hit, found = set(), set()
    for item, other in items:
        v = PLAIN.findall((other or "").translate(LOWER))
        m = min(10, len(v))
        for a in range(len(v) - m + 1) if m else ():
            for b in range(len(w) - m + 1):
                if w[b : b + m] == v[a : a + m]:
                    hit.update(range(b, b + m))
                    found.add(str(item))
    return len(w), len(hit), sorted(found)


def word_statistics(text):
    w = re.findall("[^\x20\x09-\x0D]+", text or "")
    tri = [tuple(w[a : a + 3]) for a in range(len(w) - 2)]
    count, inside = collections.Counter(tri), set()
    for a, g in enumerate(tri):
        if count[g] > 1:
            inside.update((a, a + 1, a + 2))
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if re.search("[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), sum((text or "").count(c) for c in "#*$%&|<>"), dup, len(inside)


def filled(sizes, weights, share=1.5, most=2.0):
    """{source: target} by refilling until nothing is above its limit."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    w = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    cap, target, free, total = {s: most * sizes[s] for s in names}, {}, set(names), share * sum(sizes.values())
    while free:
        level = (total - sum(target.values())) / sum(w[s] for s in free)
        over = [s for s in free if level * w[s] > cap[s]]
        target |= {s: cap[s] for s in over} if over else {s: level * w[s] for s in free}
        free -= set(over) if over else set(free)
    return target
