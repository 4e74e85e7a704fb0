"""Plain Python versions of the operators, for small tables."""

import hashlib
import re
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")
BLANK = "\x20\x09\x0a\x0b\x0c\x0d"
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def sha(s: str) -> str:
    return hashlib.sha256(s.encode()).hexdigest()


def lines(docs, min_docs=5, min_chars=40):
    key = lambda x: x.translate(LOWER).strip(BLANK)
    held = defaultdict(list)
    for i, text in docs:
        for k in {key(x) for x in (text or "").split("\n")}:
            held[k].append(i)
    keep = {k: max((-1 if i is None else i) for i in v) for k, v in held.items() if len(k) >= min_chars and len(v) >= min_docs}
    out = []
    for i, text in docs:
        own = (text or "").split("\n")
        kept = [x for x in own if key(x) not in keep or keep[key(x)] == (-1 if i is None else i)]
        out.append((i, len(own), len(own) - len(kept), sha("\n".join(kept))))
    return out


def repeats(docs, k=35):
    words = [(i, WORD.findall(t or "")) for i, t in docs]
    n = Counter(tuple(w[j : j + k]) for _, w in words for j in range(len(w) - k + 1))
    out = []
    for i, w in words:
        gone = set()
        for j in range(len(w) - k + 1):
            if n[tuple(w[j : j + k])] > 1:
                gone.update(range(j, j + k))
        out.append((i, len(w), len(gone), sha(" ".join(x for j, x in enumerate(w) if j not in gone))))
    return out


def shingles(text, n=5):
    w = WORD.findall((text or "").translate(LOWER))
    return {tuple(w[j : j + n]) for j in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())


def near(docs, percent):
    sets = [(i, shingles(t)) for i, t in docs]
    up = {k: k for k in range(len(docs))}

    def root(k):
        while up[k] != k:
            k = up[k]
        return k

    by = defaultdict(list)
    for k, (_, s) in enumerate(sets):
        for x in s:
            by[x].append(k)
    both = Counter((a, b) for v in by.values() for n, a in enumerate(v) for b in v[n + 1 :])
    for (a, b), c in both.items():
        if 100 * c >= percent * (len(sets[a][1]) + len(sets[b][1]) - c):
            up[max(root(a), root(b))] = min(root(a), root(b))
    low = defaultdict(list)
    for k in range(len(docs)):
        low[root(k)].append(docs[k][0])
    return [(i, len(sets[k][1]), min(low[root(k)])) for k, (i, _) in enumerate(docs)]
