"""Plain-Python versions of what the document operators compute, for small tables."""

from __future__ import annotations

import hashlib
import re
from collections import Counter

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall(text or "")


def shingles(text, size=3):
    w = words("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} or ({tuple(w)} if w else set())


def linked_components(rows, num=90, den=100, size=3):
    """{id: (set size, smallest id reachable)} from (id, text) rows."""
    sets = {}
    for i, t in rows:
        sets[i] = shingles(t, size)
    up = {i: i for i in sets}

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    ids = sorted(sets)
    for k, i in enumerate(ids):
        for j in ids[:k]:
            both = len(sets[i] & sets[j])
            if both and den * both >= num * (len(sets[i]) + len(sets[j]) - both):
                a, b = find(i), find(j)
                up[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), find(i)) for i in ids}


def removed_bytes(rows, limit=100):
    """{id: (bytes, removed, spans, digest of the rest)} from (id, text) rows with distinct ids."""
    seen, out = set(), {}
    for i, t in sorted(rows):
        data = (t or "").encode()
        gone = bytearray(len(data))
        for k in range(len(data) - limit + 1):
            w = data[k : k + limit]
            if w in seen:
                gone[k : k + limit] = b"\1" * limit
            seen.add(w)
        spans = sum(1 for k, g in enumerate(gone) if g and (not k or not gone[k - 1]))
        out[i] = (len(data), sum(gone), spans, hashlib.sha256(bytes(b for b, g in zip(data, gone) if not g)).hexdigest())
    return out


def fill(total, rows):
    """Targets by repeated sharing: rows of (key, weight, cap); what is above a cap is shared again by weight."""
    out, open_ = {}, dict((k, (w, c)) for k, w, c in rows)
    while open_:
        level = total / sum(w for w, _ in open_.values())
        over = [k for k, (w, c) in open_.items() if level * w > c]
        if not over:
            return out | {k: level * w for k, (w, _) in open_.items()}
        for k in over:
            out[k] = open_[k][1]
            total -= open_.pop(k)[1]
    return out


def repeated_words(w):
    count = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    return len({i + o for i in range(len(w) - 2) if count[tuple(w[i : i + 3])] > 1 for o in range(3)})
