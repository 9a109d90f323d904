"""Brute-force versions of the training-data operators, in plain Python."""

import collections
import hashlib
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall(text or "")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def sha(s):
    return hashlib.sha256(s.encode() if isinstance(s, str) else s).hexdigest()


def strike(docs, window):
    """docs: [(id, text)] -> [(n_words, n_removed, kept words)] in the same order."""
    first = {}
    for d, t in docs:
        w = words(t)
        if d is not None:
            for i in range(len(w) - window + 1):
                k = tuple(w[i:i + window])
                first[k] = min(first.get(k, d), d)
    out = []
    for d, t in docs:
        w = words(t)
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            if d is not None and first[tuple(w[i:i + window])] < d:
                gone[i:i + window] = [True] * window
        out.append((len(w), sum(gone), [x for x, g in zip(w, gone) if not g]))
    return out


def shingles(text, k):
    w = words(lower(text))
    if not w:
        return frozenset()
    return frozenset(tuple(w[i:i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)])


def components(nodes, links):
    par = {n: n for n in nodes}

    def find(x):
        while par[x] != x:
            par[x] = par[par[x]]
            x = par[x]
        return x
    for a, b in links:
        a, b = find(a), find(b)
        par[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def near(docs, k, pct):
    """docs: {id: text} -> {id: (size, component)}."""
    sets = {d: shingles(t, k) for d, t in docs.items()}
    inv = collections.defaultdict(list)
    for d in sorted(sets):
        for s in sets[d]:
            inv[s].append(d)
    links = []
    for d in sorted(sets):
        c = collections.Counter(e for s in sets[d] for e in inv[s] if e > d)
        links += [(d, e) for e, n in c.items() if 100 * n >= pct * (len(sets[d]) + len(sets[e]) - n)]
    comp = components(sets, links)
    return {d: (len(sets[d]), comp[d]) for d in sets}


def counts(text):
    t = text or ""
    w = words(t)
    c = collections.Counter(tuple(w[i:i + 5]) for i in range(len(w) - 4))
    mark = [0] * len(w)
    for i in range(len(w) - 4):
        if c[tuple(w[i:i + 5])] > 1:
            mark[i:i + 5] = [1] * 5
    seen, dup = set(), 0
    for x in t.split("\n"):
        if words(x):
            dup += x in seen
            seen.add(x)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, sum(mark)
