"""Plain Python versions of what the operators compute, for small tables."""

import collections
import re

SPACED = re.compile(r"[^\x20\x09-\x0D]+")


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def shingles(text, k):
    w = SPACED.findall(lower(text))
    if not w:
        return frozenset()
    if len(w) < k:
        return frozenset([tuple(w)])
    return frozenset(tuple(w[i:i + k]) for i in range(len(w) - k + 1))


def components(ids, links):
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x
    for a, b in links:
        a, b = find(a), find(b)
        if a != b:
            root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def near_duplicates(docs, k, percent):
    """{doc_id: (n_shingles, component)} over (doc_id, text) rows."""
    sets = {i: shingles(t, k) for i, t in docs}
    rep, link = {}, []
    for i, s in sets.items():
        if s:
            link.append((rep.setdefault(s, i), i))
    post = collections.defaultdict(list)
    for s, i in rep.items():
        for x in s:
            post[x].append(i)
    both = collections.Counter()
    for v in post.values():
        for a in range(len(v)):
            for b in range(a):
                both[v[b], v[a]] += 1
    link += [(a, b) for (a, b), n in both.items() if 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n)]
    comp = components(sets, link)
    return {i: (len(sets[i]), comp[i]) for i in sets}
