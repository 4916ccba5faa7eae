"""Plain single-process versions of the operators' contracts."""

import hashlib
import re
from collections import Counter

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words_removed(docs, n=13):
    """{doc_id: (n_words, n_removed, sha256)} for unique ids."""
    first = {}
    split = {d: WORD.findall(t or "") for d, t in docs}
    for d in sorted(split):
        w = split[d]
        for i in range(len(w) - n + 1):
            first.setdefault(tuple(w[i:i + n]), d)
    out = {}
    for d, w in split.items():
        gone = set()
        for i in range(len(w) - n + 1):
            if first[tuple(w[i:i + n])] < d:
                gone.update(range(i, i + n))
        kept = [x for i, x in enumerate(w) if i not in gone]
        out[d] = (len(w), len(gone), hashlib.sha256(" ".join(kept).encode()).hexdigest())
    return out


def bytes_removed(docs, n=100):
    """{doc_id: (n_bytes, n_removed, n_spans, sha256)} for unique ids."""
    seen, out = set(), {}
    for d, t in sorted(docs):
        b = (t or "").encode()
        gone = bytearray(len(b))
        for i in range(len(b) - n + 1):
            s = b[i:i + n]
            if s in seen:
                gone[i:i + n] = b"\x01" * n
            seen.add(s)
        kept = bytes(x for x, g in zip(b, gone) if not g)
        out[d] = (len(b), sum(gone), len(re.findall(rb"\x01+", bytes(gone))), hashlib.sha256(kept).hexdigest())
    return out


def gram_set(text, n=5):
    w = WORD.findall(text or "")
    return {tuple(w[i:i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def near_classes(docs, threshold=0.8):
    """{doc_id: (class_id, links)}"""
    sets = {d: gram_set(t) for d, t in docs}
    root, links = {d: d for d in sets}, Counter()

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    index = {}
    for d, s in sets.items():
        for g in s:
            index.setdefault(g, []).append(d)
    for d, s in sets.items():
        common = Counter(o for g in s for o in index[g] if o < d)
        for o, c in common.items():
            if c >= threshold * (len(s) + len(sets[o]) - c):
                links[d] += 1
                links[o] += 1
                a, b = find(d), find(o)
                root[max(a, b)] = min(a, b)
    return {d: (find(d), links[d]) for d in sets}
