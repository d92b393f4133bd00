"""Plain versions of the operators' contracts, for small inputs."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

GAP = re.compile(r"[\x20\x09-\x0D]+")


def words(text):
    return [w for w in GAP.split(text or "") if w]


def substring_dedup(rows, length=20):
    first = {}
    texts = {(d, i): words(t) for i, (d, t) in enumerate(rows)}
    for (d, i), w in texts.items():
        for s in range(len(w) - length + 1):
            k = tuple(w[s:s + length])
            if k not in first or (d, s) < first[k]:
                first[k] = (d, s)
    out = []
    for (d, i), w in texts.items():
        gone = [False] * len(w)
        for s in range(len(w) - length + 1):
            if first[tuple(w[s:s + length])] < (d, s):
                gone[s:s + length] = [True] * length
        kept = " ".join(x for x, g in zip(w, gone) if not g)
        out.append((d, len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out


def byte_dedup(rows, length=200):
    n = Counter()
    for _, t in rows:
        b = (t or "").encode()
        for s in range(len(b) - length + 1):
            n[b[s:s + length]] += 1
    out = []
    for d, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for s in range(len(b) - length + 1):
            if n[b[s:s + length]] > 1:
                gone[s:s + length] = b"\1" * length
        spans = len(re.findall(rb"\x01+", bytes(gone)))
        kept = bytes(x for x, g in zip(b, gone) if not g)
        out.append((d, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


def jaccard_components(rows, n=4, percent=85):
    sets = []
    for _, t in rows:
        w = words(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append({tuple(w[i:i + n]) for i in range(max(len(w) - n + 1, 1))} if w else set())
    group = list(range(len(rows)))

    def root(i):
        while group[i] != i:
            i = group[i]
        return i

    holders = defaultdict(list)
    for i, s in enumerate(sets):
        for g in s:
            holders[g].append(i)
    shared = defaultdict(int)
    for h in holders.values():
        for a in range(len(h)):
            for b in range(a):
                shared[h[b], h[a]] += 1
    for (a, b), k in shared.items():
        if 100 * k >= percent * (len(sets[a]) + len(sets[b]) - k):
            group[root(a)] = root(b)
    low = {}
    for i, (d, _) in enumerate(rows):
        low[root(i)] = min(low.get(root(i), d), d)
    return [(d, len(sets[i]), low[root(i)]) for i, (d, _) in enumerate(rows)]


def crc(text):
    return zlib.crc32(str(text).encode())
