"""Slow, plain versions of the operators, for small inputs."""

import hashlib
import re
from collections import Counter

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {i: i + 32 for i in range(65, 91)}


def shingles(text):
    w = [x.translate(LOWER) for x in WORD.findall(text or "")]
    return set(zip(w, w[1:], strict=False)) if len(w) > 1 else {(x,) for x in w}


def near(rows):
    """{doc_id: (size of set, component)}"""
    sets = {k: shingles(t) for k, t in rows}
    comp = {k: k for k in sets}

    def find(k):
        while comp[k] != k:
            k = comp[k]
        return k

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 80 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                comp[max(x, y)] = min(x, y)
    return {k: (len(sets[k]), find(k)) for k in ids}


def repeated_bytes(rows, window):
    data = [(k, (t or "").encode()) for k, t in rows]
    seen = Counter(b[i : i + window] for _, b in data for i in range(len(b) - window + 1))
    out = {}
    for k, b in data:
        gone = bytearray(len(b))
        for i in range(len(b) - window + 1):
            if seen[b[i : i + window]] > 1:
                gone[i : i + window] = b"\1" * window
        spans = sum(1 for i in range(len(gone)) if gone[i] and (not i or not gone[i - 1]))
        out[k] = (len(b), sum(gone), spans, hashlib.sha256(bytes(x for x, g in zip(b, gone, strict=True) if not g)).hexdigest())
    return out


def earlier_words(rows, window):
    seen, out = set(), {}
    for k, t in sorted(rows):
        w = WORD.findall(t or "")
        gone = [0] * len(w)
        for i in range(len(w) - window + 1):
            g = tuple(w[i : i + window])
            if g in seen:
                gone[i : i + window] = [1] * window
            seen.add(g)
        kept = " ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out[k] = (len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest())
    return out


def components(links):
    label = {}
    for a, b in links:
        label.setdefault(a, a)
        label.setdefault(b, b)
    changed = True
    while changed:
        changed = False
        for a, b in links:
            m = min(label[a], label[b])
            changed |= label[a] != m or label[b] != m
            label[a] = label[b] = m
    return label
