"""Plain Python versions of the contracts, for small tables."""

from __future__ import annotations

import re
from collections import Counter, defaultdict

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def alnum_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def space_words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def contamination(docs, items):
    """{doc_id: (n_words, n_hit, items)}"""
    wins = defaultdict(set)
    for item, text in items:
        w = alnum_words(text)
        k = min(13, len(w))
        for p in range(len(w) - k + 1 if w else 0):
            wins[tuple(w[p : p + k])].add(item)
    sizes = {len(w) for w in wins}
    out = {}
    for d, text in docs:
        w, hit, found = alnum_words(text), set(), set()
        for k in sizes:
            for p in range(len(w) - k + 1):
                if (x := tuple(w[p : p + k])) in wins:
                    hit |= set(range(p, p + k))
                    found |= wins[x]
        out[d] = (len(w), len(hit), sorted(str(i) for i in found if i is not None))
    return out


def near_copies(docs, n=5, similarity=0.8):
    """{doc_id: (class_id, n_links)}"""
    sets = {}
    for d, text in docs:
        w = alnum_words(text)
        sets[d] = frozenset(tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))) if w else frozenset()
    held = defaultdict(list)
    for d, s in sets.items():
        for g in s:
            held[g].append(d)
    shared = Counter((a, b) for l in held.values() for i, a in enumerate(l) for b in l[i + 1 :])
    up, links = {d: d for d in sets}, Counter()

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for (a, b), c in shared.items():
        if c >= similarity * (len(sets[a]) + len(sets[b]) - c) - 1e-9:
            links[a] += 1
            links[b] += 1
            x, y = top(a), top(b)
            up[max(x, y)] = min(x, y)
    return {d: (top(d), links[d]) for d in sets}


def repeats(docs, window=50):
    """{doc_id: (n_words, n_removed, kept text)}"""
    least = {}
    for d, text in docs:
        w = space_words(text)
        for p in range(len(w) - window + 1):
            x = tuple(w[p : p + window])
            least[x] = min(d, least.get(x, d))
    out = {}
    for d, text in docs:
        w = space_words(text)
        gone = {i for p in range(len(w) - window + 1) if least[tuple(w[p : p + window])] < d for i in range(p, p + window)}
        out[d] = (len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone))
    return out
