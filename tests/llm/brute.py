"""Plain versions of the operators' results, over lists."""

import collections
import math
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def shingles(text, width=5):
    w = words(text)
    if len(w) >= width:
        return {tuple(w[i : i + width]) for i in range(len(w) - width + 1)}
    return {tuple(w)} if w else set()


def components(sets):
    """Smallest id reachable, from {id: set}, over links of similarity 0.8 or more."""
    parent = {k: k for k in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                u, v = sorted((find(a), find(b)))
                parent[v] = u
    return {k: find(k) for k in sets}


def quality(text):
    found = WORD.findall(text or "")
    runs = [tuple(found[i : i + 5]) for i in range(len(found) - 4)]
    times = collections.Counter(runs)
    covered = {i + k for i, r in enumerate(runs) if times[r] > 1 for k in range(5)}
    seen, doubled = set(), 0
    for line in (text or "").split("\n"):
        if WORD.search(line):
            doubled += line in seen
            seen.add(line)
    symbols = sum(c in "#*$%&|<>" for c in text or "")
    return len(found), sum(map(len, found)), symbols, doubled, len(covered)


def base_score(tokens, counts):
    total = sum(counts.values())
    return sum(math.log10((counts[t] + 0.5) / (total + 0.5 * (len(counts) + 1))) for t in tokens)
