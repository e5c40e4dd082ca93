"""Plain Python versions of what the operators compute."""

import math
import re
from collections import Counter

SF = "/root/testdata/sf0.001"

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall(text or "")


def stats(text):
    text = text or ""
    w = words(text)
    windows = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
    often = Counter(windows)
    covered = {i + j for i, x in enumerate(windows) if often[x] > 1 for j in range(8)}
    lines, seen, dup = [x for x in text.split("\n") if words(x)], set(), 0
    for line in lines:
        dup += line in seen
        seen.add(line)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered)


def bag(text, size=5):
    w = words(text)
    return Counter(tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))) if w else Counter()


def weighted_jaccard(a, b):
    low = sum((a & b).values())
    return low / (sum(a.values()) + sum(b.values()) - low) if a or b else 0.0


def classes(rows, threshold=0.8):
    """Least doc_id of each document's near-duplicate class."""
    parent = {d: d for d, _ in rows}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    def union(a, b):
        a, b = sorted((find(a), find(b)))
        parent[b] = a

    bags = [(d, t, bag(t)) for d, t in rows]
    where = {}
    for i, (_, _, b) in enumerate(bags):
        for s in b:
            where.setdefault(s, []).append(i)
    pairs = {(i, j) for own in where.values() for i in own for j in own if i < j}
    for i, j in pairs:
        if weighted_jaccard(bags[i][2], bags[j][2]) >= threshold:
            union(bags[i][0], bags[j][0])
    first = {}
    for d, t in rows:
        if t is not None:
            union(first.setdefault(t, d), d)
    return {d: find(d) for d, _ in rows}


def cosine(a, b):
    return sum(x * y for x, y in zip(a, b)) / math.sqrt(sum(x * x for x in a)) / math.sqrt(sum(x * x for x in b))
