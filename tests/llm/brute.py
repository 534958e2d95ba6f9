"""Brute-force versions of the operators, on lists of (doc_id, text)."""

from __future__ import annotations

import hashlib
import re
from collections import Counter, defaultdict

BLANKS = " \t\n\x0b\x0c\r"


def sha(data: str | bytes) -> str:
    return hashlib.sha256(data.encode() if isinstance(data, str) else data).hexdigest()


def lower(text: str) -> str:
    return re.sub("[A-Z]+", lambda m: m[0].lower(), text)


def smallest(nodes, links):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def near(rows, k=4):
    sets = {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        sets[i] = frozenset(tuple(w[j : j + k]) for j in range(max(1, len(w) - k + 1))) if w else frozenset()
    ids = list(sets)
    links = [
        (a, b) for a in ids for b in ids if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])
    ]
    top = smallest(ids, links)
    return {i: (len(sets[i]), top[i], top[i] == i) for i in ids}


def lines(rows, min_chars=20, min_docs=3):
    own = defaultdict(set)
    key = lambda x: lower(x.strip(BLANKS))
    for i, t in rows:
        for x in (t or "").split("\n"):
            own[key(x)].add(i)
    out = {}
    for i, t in rows:
        every = (t or "").split("\n")
        kept = [x for x in every if len(key(x)) < min_chars or len(own[key(x)]) < min_docs or max(own[key(x)]) == i]
        out[i] = (len(every), len(every) - len(kept), sha("\n".join(kept)))
    return out


def covered(n, starts, width):
    gone = [False] * n
    for s in starts:
        gone[s : s + width] = [True] * width
    return gone


def suffix(rows, width=50):
    texts = {i: (t or "").encode() for i, t in rows}
    first = {}
    for i in sorted(texts):
        for s in range(len(texts[i]) - width + 1):
            first.setdefault(texts[i][s : s + width], i)
    out = {}
    for i, t in texts.items():
        gone = covered(len(t), [s for s in range(len(t) - width + 1) if first[t[s : s + width]] < i], width)
        spans = sum(g and (j == 0 or not gone[j - 1]) for j, g in enumerate(gone))
        out[i] = (len(t), sum(gone), spans, sha(bytes(b for b, g in zip(t, gone, strict=True) if not g)))
    return out


def substrings(rows, width=35):
    words = [(i, [w.decode() for w in (t or "").encode().split()]) for i, t in rows]
    seen = Counter(tuple(w[s : s + width]) for _, w in words for s in range(len(w) - width + 1))
    out = []
    for i, w in words:
        gone = covered(len(w), [s for s in range(len(w) - width + 1) if seen[tuple(w[s : s + width])] > 1], width)
        out.append((i, len(w), sum(gone), sha(" ".join(x for x, g in zip(w, gone, strict=True) if not g))))
    return out


def leaks(rows, items, width=10):
    words = lambda t: re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").encode().lower())
    windows = defaultdict(set)
    for i, t in items:
        w = words(t)
        for s in range(max(1, len(w) - width + 1) if w else 0):
            windows[tuple(w[s : s + width])].add(str(i))
    out = {}
    for i, t in rows:
        w, hit, names = words(t), set(), set()
        for n in {len(x) for x in windows}:
            for s in range(len(w) - n + 1):
                if found := windows.get(tuple(w[s : s + n])):
                    hit.update(range(s, s + n))
                    names |= found
        out[i] = (len(w), len(hit), len(names), sha(",".join(sorted(names))), bool(hit))
    return out


def pages(rows):
    top = defaultdict(list)
    for i, h in rows:
        top[(h or "").encode()].append(i)
    out = {}
    for i, h in rows:
        data = (h or "").encode()
        again = len(data) >= 1000 and max(top[data]) != i
        out[i] = (
            len(data),
            hashlib.sha1(data).hexdigest(),
            "revisit" if again else "response",
            max(top[data]) if again else None,
        )
    return out
