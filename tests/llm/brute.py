"""Plain versions of what the operators compute, for small fixtures."""

from __future__ import annotations

import collections
import hashlib
import math
import re
import zlib

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SPACED = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile("[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+")


def words(text, pattern=SPACED):
    return pattern.findall((text or "").translate(LOW))


def remainder(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 5


def shingle_set(text, k=5):
    w = words(text)
    return frozenset(tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))) if w else frozenset()


def near_duplicates(rows, percent=75):
    """doc_id -> (set size, component)."""
    sets = {d: shingle_set(t) for d, t in rows if d is not None}
    up = {d: d for d in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                up[y] = x
    return {d: (len(sets[d]), find(d)) for d in ids}


def removed_lines(rows, percent=80):
    seen, out = [], collections.defaultdict(list)
    for d, t in sorted((d, t) for d, t in rows if d is not None and t is not None):
        for i, line in enumerate(t.split("\n")):
            s = {x for x in re.split("[ \t\x0b\f\r]+", line.lower()) if x}
            if s:
                if any(100 * len(s & o) >= percent * len(s | o) for o in seen):
                    out[d].append(i)
                seen.append(s)
    return out


def contamination(text, items, size=13):
    windows = collections.defaultdict(set)
    for name, t in items:
        if name is None or t is None:
            continue
        w = words(t, ALNUM)
        for k in range(max(1, len(w) - size + 1) if w else 0):
            windows[tuple(w[k : k + size])].add(str(name))
    w = words(text, ALNUM)
    hit, found = [False] * len(w), set()
    for n in {len(x) for x in windows}:
        for k in range(len(w) - n + 1):
            if (x := tuple(w[k : k + n])) in windows:
                found |= windows[x]
                hit[k : k + n] = [True] * n
    h = sum(hit)
    return len(w), h, len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), h > 0 and 20 * h >= len(w)


def base_scores(rows):
    docs = [(d, [*words(t), None]) for d, t in rows]
    c = collections.Counter(w for d, t in docs if d is not None and remainder(d) != 1 for w in t)
    n, v = sum(c.values()), len(c)
    return n, [(d, len(t), sum(w in c for w in t), sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in t)) for d, t in docs]


def suffix_tree(rows, depth=5, gain=1.0):
    """P(symbol | history) of a probabilistic suffix tree over words, all contexts and symbols in dictionaries; and the contexts that stay."""
    docs = [[*words(t), None] for d, t in rows if d is not None and remainder(d) != 1]
    c = collections.Counter(w for t in docs for w in t)
    n, v = sum(c.values()), len(c)
    least, few = max(n**0.5 / 40, 4.0), max(n**0.5 / 1000, 2.0)
    after = collections.defaultdict(collections.Counter)
    for t in docs:
        for i, w in enumerate(t):
            past = ("<", *t[:i])
            for k in range(1, min(depth, len(past)) + 1):
                after[past[-k:]][w] += 1
    after = {ctx: x for ctx, x in after.items() if sum(x.values()) >= least}
    tree = {}

    def prob(w, ctx):
        while ctx and ctx not in tree:
            ctx = ctx[1:]
        if not ctx:
            return (c[w] + 0.5) / (n + 0.5 * (v + 1))
        listed, rest = tree[ctx]
        return listed[w] if w in listed else rest * prob(w, ctx[1:])

    won = {}
    for ctx in sorted(after, key=len):
        m, listed = sum(after[ctx].values()), {w: x for w, x in after[ctx].items() if x >= few and c[w] >= few}
        below, kinds = {w: prob(w, ctx[1:]) for w in listed}, len(listed) + 1.0
        p = {w: (x + kinds * below[w]) / (m + kinds) for w, x in listed.items()}
        left, left_below = max(1 - sum(p.values()), 1e-12), max(1 - sum(below.values()), 1e-12)
        likely = sum(x * math.log(p[w] / below[w]) for w, x in listed.items()) + (m - sum(listed.values())) * math.log(left / left_below)
        won[ctx] = likely >= gain * kinds * math.log(max(m, 2)) / 2
        tree[ctx] = p, left / left_below
    stays = {ctx[i:] for ctx, yes in won.items() if yes for i in range(len(ctx))}
    for ctx in set(tree) - stays:
        del tree[ctx]
    return prob, tree, c


def suffix_tree_scores(rows, **how):
    prob, _, _ = suffix_tree(rows, **how)
    return [(d, sum(math.log10(prob(w, ("<", *t[:i])[-5:])) for i, w in enumerate(t))) for d, t in ((d, [*words(x), None]) for d, x in rows)]
