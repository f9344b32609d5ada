"""Brute-force near-duplicate components for the pipeline's test."""

import re


def components(rows, percent=75):
    """rows (doc_id, text) -> {doc_id: smallest doc_id reachable}."""
    sets = {}
    for key, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        sets[key] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    parent = {k: k for k in sets}

    def find(k):
        while parent[k] != k:
            k = parent[k]
        return k

    index = {}
    for key in sorted(sets):
        tried = set()
        for s in sets[key]:
            for other in index.get(s, ()):
                if other not in tried:
                    tried.add(other)
                    i = len(sets[key] & sets[other])
                    if 100 * i >= percent * (len(sets[key]) + len(sets[other]) - i):
                        a, b = find(key), find(other)
                        parent[max(a, b)] = min(a, b)
            index.setdefault(s, []).append(key)
    return {k: find(k) for k in sets}
