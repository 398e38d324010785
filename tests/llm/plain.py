"""Plain Python versions of the operators, for small inputs."""

import re
import zlib
from collections import Counter, defaultdict

WORD = re.compile("[^\x20\x09-\x0d]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
BLANKS = " \t\n\x0b\x0c\r"


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def shingles(text, width=5):
    w = words(text)
    if not w:
        return set()
    return {tuple(w[i : i + width]) for i in range(len(w) - width + 1)} or {tuple(w)}


def components(links):
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in links:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    return {x: find(x) for x in list(parent)}


def near_components(docs, percent=85):
    """docs: (doc_id, text) with different ids; doc_id to component."""
    sets = {d: shingles(t) for d, t in docs}
    ids = sorted(sets)
    links = []
    for i, a in enumerate(ids):
        for b in ids[:i]:
            both = len(sets[a] & sets[b])
            if sets[a] and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                links.append((a, b))
    known = components(links)
    return {d: known.get(d, d) for d in ids}


def dedup_lines(docs, least=40, many=5):
    """docs: (doc_id, text); the texts that stay, in order."""
    holders = defaultdict(set)
    key = lambda line: line.strip(BLANKS).translate(LOWER)
    for d, t in docs:
        for line in (t or "").split("\n"):
            if len(key(line)) >= least:
                holders[key(line)].add(d)
    last = {k: max((d for d in v if d is not None), default=None) for k, v in holders.items() if len(v) >= many}
    return ["\n".join(x for x in (t or "").split("\n") if key(x) not in last or last[key(x)] == d) for d, t in docs]


def leaks(docs, items, percent=80):
    found = set()
    for i, t in items:
        wanted = shingles(t)
        for d, text in docs:
            if wanted and 100 * len(wanted & shingles(text)) >= percent * len(wanted):
                found.add((d, i))
    return found


def targets(sizes, weights=(5, 2, 1), repeats=3):
    """sizes: source to words; source to target, excess reshared until none is above."""
    order = sorted(sizes, key=lambda s: (s is None, s))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    total, fixed = sum(sizes.values()), {}
    while True:
        left = [s for s in order if s not in fixed]
        rest = total - sum(fixed.values())
        share = {s: rest * weight[s] / sum(weight[x] for x in left) for s in left}
        over = [s for s in left if share[s] > repeats * sizes[s]]
        if not over:
            return fixed | share
        fixed |= {s: repeats * sizes[s] for s in over}


def fold(d):
    return zlib.crc32(str(d).encode()) % 5


__all__ = ["Counter", "components", "dedup_lines", "fold", "leaks", "near_components", "shingles", "targets", "words"]
