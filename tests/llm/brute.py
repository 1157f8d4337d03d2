"""Plain Python versions of the operators, for small tables."""
import re
from collections import defaultdict

import xxhash

SPACE = " \t\n\x0b\x0c\r"


def lower(s):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in s)


def fingerprint(text, k=3):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", lower(text or "")) if w]
    if not words:
        return 0
    grams = [" ".join(words[i:i + k]) for i in range(max(1, len(words) - k + 1))]
    h = [xxhash.xxh64_intdigest(g.encode(), seed=42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def groups(fps, bits=2):
    """fps: list; the group number of each, linked at ``bits`` or fewer."""
    parent = list(range(len(fps)))

    def root(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for i, a in enumerate(fps):
        for j in range(i):
            if (a ^ fps[j]).bit_count() <= bits:
                parent[root(i)] = root(j)
    return [root(i) for i in range(len(fps))]


def line_dedup(docs, min_docs, min_chars=1):
    """docs: list of (id, text); the kept text of each."""
    seen = defaultdict(set)
    for i, t in docs:
        for x in (t or "").split("\n"):
            seen[lower(x.strip(SPACE))].add(i)
    bad = {k for k, v in seen.items() if len(v) >= min_docs and len(k) >= min_chars}
    return ["\n".join(x for x in (t or "").split("\n") if lower(x.strip(SPACE)) not in bad) for _, t in docs]


def words(text):
    import regex
    return [w for w in regex.split(r"[^\p{L}\p{N}]+", (text or "").lower()) if w]


def contaminated(text, items, window=16, share=0.8):
    """Items of which some window is in the text, position by position, to the share."""
    import math

    import numpy as np
    number, out = {}, set()
    d = [number.setdefault(w, len(number)) for w in words(text)]
    for i, t in items:
        w = np.array([number.setdefault(x, len(number)) for x in words(t)], dtype=int)
        if not len(w):
            continue
        n = min(window, len(w))
        padded = np.array([-1] * len(w) + d + [-1] * len(w), dtype=int)
        equal = np.lib.stride_tricks.sliding_window_view(padded, len(w)) == w  # one row per shift of the item
        runs = np.pad(equal.cumsum(axis=1), ((0, 0), (1, 0)))
        if (runs[:, n:] - runs[:, :-n]).max() >= math.ceil(n * share):
            out.add(i)
    return out


def share_tree(node, budget):
    """node: (cap, weight, children or None) by name; exact water filling by repeated rounds, as fractions."""
    from fractions import Fraction
    children = node
    left, got = Fraction(budget), {}
    todo = {k for k, (cap, w, _) in children.items() if w > 0 and cap > 0}
    while todo:
        total = sum(children[k][1] for k in todo)
        full = {k for k in todo if children[k][0] <= left * children[k][1] / total}
        if not full:
            got |= {k: left * children[k][1] / total for k in todo}
            break
        # the neediest first: taking all that are full at this level keeps the level rising
        for k in full:
            got[k] = Fraction(children[k][0])
        left -= sum(got[k] for k in full)
        todo -= full
    return got
