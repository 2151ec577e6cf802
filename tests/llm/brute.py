"""Plain versions of the operators, for small fixtures."""

import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall(text or "")


def ascii_lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def shingles(text, k):
    w = words(ascii_lower(text))
    if not w:
        return frozenset()
    if len(w) < k:
        return frozenset([tuple(w)])
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1))


def near_duplicates(docs, k, percent=80):
    """[(id, text)] -> [(id, n, component, kept)]"""
    sets = [(i, shingles(t, k)) for i, t in docs]
    up = list(range(len(sets)))

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for x, (_, a) in enumerate(sets):
        for y in range(x):
            b = sets[y][1]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                up[top(x)] = top(y)
    out = []
    for x, (i, a) in enumerate(sets):
        ids = [sets[y][0] for y in range(len(sets)) if top(y) == top(x) and sets[y][0] is not None]
        c = min(ids) if a and ids else i
        out.append((i, len(a), c, i == c))
    return sorted(out, key=repr)


def base_counts(text):
    text = text or ""
    w = words(text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if words(line):
            dup += line in seen
            seen.add(line)
    grams = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    again = {g for g in grams if grams.count(g) > 1}
    covered = {i + j for i, g in enumerate(grams) if g in again for j in range(5)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered)
