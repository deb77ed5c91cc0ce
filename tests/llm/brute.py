"""Brute-force near-duplicate components."""

from collections import defaultdict


def shingles(text):
    w = (text or "").encode().lower().split()
    if len(w) >= 5:
        return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    return frozenset([tuple(w)]) if w else frozenset()


def components(rows, per_cent=85):
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= per_cent * len(a | b):
                root[find(i)] = find(j)
    groups = defaultdict(list)
    for i, (d, _) in enumerate(rows):
        groups[find(i)].append(d)
    least = {d: min(g) for g in groups.values() for d in g}
    return {d: (len(s), least[d], least[d] == d) for (d, _), s in zip(rows, sets)}
