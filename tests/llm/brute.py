"""Plain Python models of the operators, written from the contracts."""

import hashlib
import re
from collections import Counter, defaultdict

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall((text or "").encode())


def suffix(rows, window=400):
    raw = [(i, (t or "").encode()) for i, t in rows]
    seen = Counter(b[j : j + window] for _, b in raw for j in range(len(b) - window + 1))
    out = []
    for i, b in raw:
        gone = bytearray(len(b))
        for j in range(len(b) - window + 1):
            if seen[b[j : j + window]] > 1:
                gone[j : j + window] = b"\1" * window
        spans = sum(1 for k in range(len(gone)) if gone[k] and (k == 0 or not gone[k - 1]))
        out.append((i, len(b), sum(gone), spans, hashlib.sha256(bytes(x for x, g in zip(b, gone) if not g)).hexdigest()))
    return sorted(out)


def substring(rows, window=50):
    first, cut = {}, []
    for i, t in sorted(rows, key=lambda r: r[0]):
        w = words(t)
        cut.append((i, w))
        for j in range(len(w) - window + 1):
            first.setdefault(tuple(w[j : j + window]), i)
    out = []
    for i, w in cut:
        gone = bytearray(len(w))
        for j in range(len(w) - window + 1):
            if first[tuple(w[j : j + window])] < i:
                gone[j : j + window] = b"\1" * window
        out.append((i, len(w), sum(gone), hashlib.sha256(b" ".join(x for x, g in zip(w, gone) if not g)).hexdigest()))
    return sorted(out)


def shingles(text, k=5):
    low = bytes(range(65, 91))
    w = WORD.findall((text or "").encode().translate(bytes.maketrans(low, low.lower())))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def jaccard(rows, similar=80, k=5):
    sets = [(i, shingles(t, k)) for i, t in rows]
    parent = {i: i for i, _ in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    post = defaultdict(list)
    for n, (_, s) in enumerate(sets):
        for x in s:
            post[x].append(n)
    for n, (i, s) in enumerate(sets):
        for m, c in Counter(m for x in s for m in post[x] if m > n).items():
            if 100 * c >= similar * (len(s) + len(sets[m][1]) - c):
                a, b = find(i), find(sets[m][0])
                parent[max(a, b)] = min(a, b)
    return sorted((i, len(s), find(i)) for i, s in sets)


def repeat_words(w, window=8):
    seen = Counter(tuple(w[i : i + window]) for i in range(len(w) - window + 1))
    gone = bytearray(len(w))
    for i in range(len(w) - window + 1):
        if seen[tuple(w[i : i + window])] > 1:
            gone[i : i + window] = b"\1" * window
    return sum(gone)


def quality(text):
    t = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    r = repeat_words(w)
    return len(w), sum(map(len, w)), sum(t.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), r, len(w) < 20 or 100 * r > 30 * len(w)
