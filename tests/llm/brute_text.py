"""Plain versions of the run detection and the tokenizer alignment."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter


def words_of(text):
    return re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode())


def sha(data):
    return hashlib.sha256(data if isinstance(data, bytes) else data.encode()).hexdigest()


def runs(w, exponent=4, least=6):
    """All runs, period by period: stretches of equal words q apart."""
    n, found = len(w), {}
    for q in range(1, n // exponent + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            if j + q - i >= max(least, exponent * q) and j > i:
                found.setdefault((i, j + q), q)
            i = j + 1
    return sorted((s, e - s, q) for (s, e), q in found.items())


def runs_row(doc_id, text):
    w = words_of(text)
    n = len(w)
    if doc_id is not None:
        h = zlib.crc32(str(doc_id).encode())
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    found = runs(w)
    gone = set()
    for s, size, q in found:
        gone |= set(range(s + q, s + size))
    best = min(found, key=lambda r: (-r[1], r[0], r[2]), default=None)
    listed = "".join(f"{s},{size},{q}\n" for s, size, q in found)
    return (doc_id, len(found), *(best or (None,) * 3), best and 1000 * best[1] // best[2], sha(listed),
            sha(b" ".join(x for i, x in enumerate(w) if i not in gone)))


def alignment_rows(docs, a, a_bytes, b, b_bytes):
    """``docs``: (id, text); ``a`` and ``b`` encode, ``*_bytes`` spell an id."""
    lined, counts = [], Counter()
    for doc_id, text in docs:
        found = None
        if text:
            x, y = a(" " + text), b(text)
            whole = (" " + text).encode()
            if b"".join(map(a_bytes, x)) == whole == b"".join(map(b_bytes, y)):
                found = _align([(i, len(a_bytes(i))) for i in x], [(i, len(b_bytes(i))) for i in y])
                counts.update(found[1])
        lined.append((doc_id, found))
    highest = {}
    for (_, j), n in counts.items():
        highest[j] = max(highest.get(j, 0), n)
    for doc_id, found in lined:
        if found is None:
            yield (doc_id, 0, 0, 0, 0, 0, 0, "")
            continue
        groups, links = found
        yield (doc_id, sum(len(g[0]) for g in groups), sum(len(g[1]) for g in groups), len(groups), len(links),
               sum(counts[k] == highest[k[1]] for k in links), sum(counts[k] for k in links),
               sha(";".join(",".join(map(str, g)) + "|" + ",".join(map(str, h)) for g, h in groups)))


def _align(x, y):
    def ranges(tokens):
        at, out = 0, []
        for i, size in tokens:
            out.append((i, at, at + size))
            at += size
        return out
    xs, ys = ranges(x), ranges(y)
    ends = sorted({e for _, _, e in xs} & {e for _, _, e in ys})
    groups, i, j = [], 0, 0
    for end in ends:
        g, h = [], []
        while i < len(xs) and xs[i][2] <= end:
            g.append(xs[i][0])
            i += 1
        while j < len(ys) and ys[j][2] <= end:
            h.append(ys[j][0])
            j += 1
        groups.append((g, h))
    links, low = [], 0
    for i, s, e in xs:
        while ys[low][2] <= s:
            low += 1
        k = low
        while k < len(ys) and ys[k][1] < e:
            links.append((i, ys[k][0]))
            k += 1
    return groups, links
