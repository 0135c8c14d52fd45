"""Plain versions of the pipeline's stages."""

import math
import re
from collections import Counter

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(t):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def byte_repeats(texts, width):
    data = [t.encode() for t in texts]
    seen = Counter(d[i : i + width] for d in data for i in range(len(d) - width + 1))
    out = []
    for d in data:
        gone = bytearray(len(d))
        for i in range(len(d) - width + 1):
            if seen[d[i : i + width]] > 1:
                gone[i : i + width] = b"\1" * width
        spans, at = [], None
        for i, g in enumerate([*gone, 0]):
            if g and at is None:
                at = i
            elif not g and at is not None:
                spans.append((at, i))
                at = None
        out.append(spans)
    return out


def near_classes(docs, threshold=0.8, common=1000):
    w = {i: words(t) for i, t in docs.items()}
    df = Counter(x for ws in w.values() for x in set(ws))
    idf = {x: 1 + math.log10(len(docs) / c) if c * common >= len(docs) else 1 + math.log10(common) for x, c in df.items()}
    sets, up = {}, {i: i for i in w}
    for i, ws in w.items():
        k = min(5, len(ws))
        c = Counter(tuple(ws[a : a + k]) for a in range(len(ws) - k + 1)) if k else Counter()
        sets[i] = {g: f * sum(idf[x] for x in g) / k for g, f in c.items()}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    ids = sorted(w)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            both = sum(min(v, sets[b][g]) for g, v in sets[a].items() if g in sets[b])
            total = sum(sets[a].values()) + sum(sets[b].values()) - both
            if both and both / total >= threshold:
                x, y = sorted((root(a), root(b)))
                up[y] = x
    return {i: root(i) for i in ids}


def ngram_hits(text, items, n=13):
    w, hit = words(text), set()
    for _, t in items:
        g = words(t)
        k = min(n, len(g))
        have = {tuple(g[a : a + k]) for a in range(len(g) - k + 1)} if k else set()
        for a in range(len(w) - k + 1):
            if tuple(w[a : a + k]) in have:
                hit |= set(range(a, a + k))
    return len(w), len(hit)
